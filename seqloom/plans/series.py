"""Queries for ordered-series, segment and window operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import postprocess, segments, series
from ..operators.quantiles import quantiles
from .base import Tables, query
from .fusion import labelled, model

KEY = ["sequence_id", "track_id"]
_RUNS = """r0 AS (SELECT *, CASE WHEN pos = 0 OR true_label <> lag(true_label) OVER (PARTITION BY sequence_id, track_id ORDER BY pos) THEN 1 ELSE 0 END AS chg FROM frames),
r AS (SELECT *, sum(chg) OVER (PARTITION BY sequence_id, track_id ORDER BY pos)::BIGINT AS run FROM r0)"""


def truth(t: Tables) -> DataFrame:
    return t.frames.select("sequence_id", "track_id", "frame_id", "pos", "event_id", F.col("true_label").alias("label"))


def voted(t: Tables) -> DataFrame:
    """Model a's labels: noisy, with gaps."""
    return model(t, "model_a").select("sequence_id", "track_id", "frame_id", "event_id", "label")


@query("SELECT event_id, row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY frame_id) - 1 AS frame_idx FROM labelled WHERE model_name = 'model_a'", "labelled")
def w01_frame_index(t):
    return series.position(voted(t)).select("event_id", "frame_idx")


def _mode_sql(size: int) -> str:
    """The first most frequent label of each centred window."""
    h = size // 2
    return f"""i AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY frame_id) AS k, count(*) OVER (PARTITION BY sequence_id, track_id) AS n FROM labelled WHERE model_name = 'model_a'),
j AS (SELECT a.event_id, a.sequence_id, a.track_id, a.frame_id, a.k, a.n, a.label AS original_label, b.label, count(*) AS c, min(b.k) AS f FROM i a JOIN i b ON a.sequence_id = b.sequence_id AND a.track_id = b.track_id AND b.k BETWEEN a.k - {h} AND a.k + {h} GROUP BY ALL),
sm AS (SELECT event_id, sequence_id, track_id, frame_id, k, original_label, CASE WHEN n < {size} THEN original_label ELSE label END AS label FROM j QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY c DESC, f) = 1)"""


@query(f"WITH {_mode_sql(7)} SELECT event_id, label, original_label, label <> original_label AS smoothed FROM sm", "labelled")
def w02_mode_smoothing(t):
    return series.mode_smooth(voted(t), 7).select("event_id", "label", "original_label", "smoothed")


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY frame_id) AS k FROM labelled WHERE model_name = 'model_a')
SELECT a.event_id, count(DISTINCT b.label) >= 3 AND a.k > 1 AS rapid FROM i a JOIN i b ON a.sequence_id = b.sequence_id AND a.track_id = b.track_id AND b.k BETWEEN a.k - 5 AND a.k GROUP BY a.event_id, a.k""", "labelled")
def w03_rapid_change(t):
    p = voted(t)
    return p.select("event_id", series.rapid_change(p).alias("rapid"))


@query(f"WITH {_RUNS} SELECT sequence_id, track_id, true_label AS label, min(pos) AS start, max(pos) AS \"end\", count(*) AS num_frames, row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY min(pos)) AS event_ord FROM r WHERE true_label <> 'none' GROUP BY sequence_id, track_id, run, true_label", "frames")
def w04_events(t):
    return series.events(truth(t))


def _episode_sql(signal: str, k: int) -> str:
    return f"""h{k} AS (SELECT *, CASE WHEN label = '{signal}' AND (lag(p) OVER w IS NULL OR p - lag(p) OVER w - 1 > 2) THEN 1 ELSE 0 END AS s FROM i WHERE label = '{signal}' WINDOW w AS (PARTITION BY sequence_id, track_id ORDER BY p)),
g{k} AS (SELECT sequence_id, track_id, min(p) AS a, max(p) AS b FROM (SELECT *, sum(s) OVER (PARTITION BY sequence_id, track_id ORDER BY p) AS e FROM h{k}) GROUP BY sequence_id, track_id, e HAVING count(*) >= 3)"""


@query(f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY frame_id) - 1 AS p FROM labelled WHERE model_name = 'model_a'), {', '.join(_episode_sql(s, k) for k, s in enumerate(('left', 'right', 'hazard')))}
SELECT i.event_id, CASE WHEN bool_or(g2.a IS NOT NULL) THEN 'hazard' WHEN bool_or(g1.a IS NOT NULL) THEN 'right' WHEN bool_or(g0.a IS NOT NULL) THEN 'left' ELSE i.label END AS label, i.label AS original_label FROM i
LEFT JOIN g0 ON g0.track_id = i.track_id AND i.p BETWEEN g0.a AND g0.b LEFT JOIN g1 ON g1.track_id = i.track_id AND i.p BETWEEN g1.a AND g1.b LEFT JOIN g2 ON g2.track_id = i.track_id AND i.p BETWEEN g2.a AND g2.b GROUP BY i.event_id, i.label""", "labelled")
def w05_episodes(t):
    return series.episodes(voted(t), 2, 3).select("event_id", "label", "original_label")


_PRUNS = """i AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY frame_id) AS p FROM labelled WHERE model_name = 'model_a'),
r0 AS (SELECT *, CASE WHEN p = 1 OR label <> lag(label) OVER (PARTITION BY sequence_id, track_id ORDER BY p) THEN 1 ELSE 0 END AS chg FROM i),
r AS (SELECT *, sum(chg) OVER (PARTITION BY sequence_id, track_id ORDER BY p) AS run FROM r0)"""


@query(f"WITH {_PRUNS}, x AS (SELECT *, label <> 'none' AND count(*) OVER (PARTITION BY sequence_id, track_id, run) < 3 AS hit FROM r) SELECT event_id, CASE WHEN hit THEN 'none' ELSE label END AS label, CASE WHEN hit THEN label END AS original_label, hit AS constraint_enforced FROM x", "labelled")
def w06_minimum_duration(t):
    return series.minimum_duration(voted(t), 3).select("event_id", "label", "original_label", "constraint_enforced")


@query(f"WITH {_RUNS}, x AS (SELECT *, true_label <> 'none' AND row_number() OVER (PARTITION BY sequence_id, track_id, run ORDER BY pos) > 4 AS hit FROM r) SELECT event_id, CASE WHEN hit THEN 'none' ELSE true_label END AS label, hit AS constraint_enforced FROM x", "frames")
def w07_maximum_duration(t):
    return series.maximum_duration(truth(t), 4).select("event_id", "label", "constraint_enforced")


@query("""WITH x AS (SELECT *, CASE WHEN pos % 7 = 3 THEN true_label END AS l FROM frames)
SELECT event_id, l IS NOT NULL AS direct, coalesce(last_value(l IGNORE NULLS) OVER (PARTITION BY sequence_id, track_id ORDER BY pos ROWS UNBOUNDED PRECEDING), first_value(l IGNORE NULLS) OVER (PARTITION BY sequence_id, track_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'none') AS label FROM x""", "frames")
def w08_propagation(t):
    return series.propagate(truth(t).withColumn("label", F.when(F.col("pos") % 7 == 3, F.col("label")))).select("event_id", "direct", "label")


@query("""WITH x AS (SELECT *, CASE WHEN pos % 9 = 4 OR pos = 0 THEN CASE WHEN pos % 18 = 4 THEN 'hazard' ELSE true_label END END AS s FROM frames)
SELECT event_id, last_value(s IGNORE NULLS) OVER (PARTITION BY sequence_id, track_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS active_label FROM x""", "frames")
def w09_anchor_carry(t):
    x = truth(t).withColumn("anchor", F.col("pos") % 9 == 4).withColumn("correction", F.when(F.col("pos") % 18 == 4, "hazard"))
    return series.carry_anchors(x, "anchor", "correction").select("event_id", "active_label")


@query("WITH s AS (SELECT *, count(*) OVER (PARTITION BY sequence_id, track_id) AS n FROM frames WHERE pos >= 3 AND (pos - 3) % 5 = 0) SELECT event_id FROM s WHERE n >= 11", "frames")
def w10_stride_sample(t):
    return series.stride_sample(truth(t), 5, 3, 11).select("event_id")


@query("""WITH n AS (SELECT sequence_id, track_id, count(*) AS n, least(greatest(1, round_even(count(*) * (4.0::DOUBLE / 10.0::DOUBLE), 0)::INT), count(*))::INT AS m FROM frames GROUP BY ALL),
g AS (SELECT sequence_id, track_id, n, m, unnest(range(m)) AS i FROM n), x AS (SELECT *, CASE WHEN m = 1 THEN 0 WHEN i = m - 1 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / (m - 1)))::BIGINT END AS pos FROM g)
SELECT sequence_id, track_id, i::INT AS new_idx, f.frame_id FROM x JOIN frames f USING (sequence_id, track_id, pos)""", "frames")
def w11_resample(t):
    return series.resample(truth(t).drop("label"), 10.0, 4.0).select("sequence_id", "track_id", "new_idx", "frame_id")


@query("SELECT sequence_id, track_id, (pos // 4)::BIGINT AS block, min_by(true_label, pos) AS label, min(frame_id) AS first_frame, max(frame_id) AS last_frame, count(*) AS num_frames FROM frames GROUP BY ALL", "frames")
def w12_blocks(t):
    return series.blocks(truth(t), 4)


@query("""WITH s AS (SELECT sequence_id, track_id, list(frame_id ORDER BY frame_id) AS f FROM frames GROUP BY ALL), x AS (SELECT *, unnest(range(0, greatest(len(f) - 16, 0) + 1, 5)) AS start FROM s)
SELECT sequence_id, track_id, start::INT AS start, f[start + 8 + 1] AS centre_frame, len(f[start + 1:start + 16])::INT AS size FROM x""", "frames")
def w13_sliding_windows(t):
    return series.sliding_windows(truth(t), 16, 5).select("sequence_id", "track_id", "start", "centre_frame", F.size("frames").alias("size"))


@query("""WITH s AS (SELECT sequence_id, track_id, count(*) AS n FROM frames GROUP BY ALL HAVING count(*) >= 10), w AS (SELECT *, unnest(range(0, n - 9, 3)) AS start FROM s),
c AS (SELECT w.sequence_id, w.track_id, start, true_code AS code, count(*) AS k FROM w JOIN frames f ON f.sequence_id = w.sequence_id AND f.track_id = w.track_id AND f.pos >= start AND f.pos < start + 10 GROUP BY ALL)
SELECT sequence_id, track_id, start::INT AS start, code, k / 10.0::DOUBLE AS purity FROM c QUALIFY row_number() OVER (PARTITION BY sequence_id, track_id, start ORDER BY k DESC, code) = 1""", "frames")
def w14_training_windows(t):
    return series.training_windows(t.frames, 10, 3)


@query("""WITH RECURSIVE s AS (SELECT sequence_id, track_id, pos, list(true_code) OVER w AS c, count(*) OVER w AS n FROM frames WINDOW w AS (PARTITION BY sequence_id, track_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
x AS (SELECT sequence_id, track_id, pos, pos + CASE WHEN list_max(c) > 0 THEN 1 ELSE 3 END AS next, [len(list_filter(c, lambda v: v = k)) FOR k IN range(4)] AS n FROM s WHERE n = 10),
r AS (SELECT * FROM x WHERE pos = 0 UNION ALL SELECT x.* FROM r JOIN x ON x.sequence_id = r.sequence_id AND x.track_id = r.track_id AND x.pos = r.next)
SELECT sequence_id, track_id, pos::INTEGER AS start, (list_position(n, list_max(n)) - 1)::INTEGER AS code, list_max(n) / 10.0::DOUBLE AS purity FROM r WHERE list_max(n) >= 6""", "frames")
def w14_training_windows_dynamic(t):
    """The step depends on the window before."""
    return series.training_windows(t.frames, 10, 3, 0.6, True)


_WINDOWS = """s AS (SELECT sequence_id, track_id, count(*) AS n FROM frames GROUP BY ALL), w AS (SELECT *, unnest(range(0, greatest(n - 9, 1), 4)) AS start FROM s),
pr AS (SELECT sequence_id, track_id, start, [((start * 7 + track_id + c * 3) % 10 + 1) / (sum_all) FOR c IN range(4)] AS p FROM (SELECT *, list_sum([((start * 7 + track_id + c * 3) % 10 + 1)::DOUBLE FOR c IN range(4)]) AS sum_all FROM w))"""


def _window_probs(t: Tables) -> DataFrame:
    w = series.sliding_windows(t.frames, 10, 4).drop("frames", "centre_frame")
    raw = F.array(*[((F.col("start") * 7 + F.col("track_id") + c * 3) % 10 + 1).cast("double") for c in range(4)])
    return w.select(*KEY, "start", F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, y: a + y)).alias("p"))


@query(f"""WITH {_WINDOWS}, e AS (SELECT f.event_id, round(avg(p[1]), 6) AS p0, round(avg(p[2]), 6) AS p1, round(avg(p[3]), 6) AS p2, round(avg(p[4]), 6) AS p3, count(p) > 0 AS covered FROM frames f LEFT JOIN pr ON f.sequence_id = pr.sequence_id AND f.track_id = pr.track_id AND f.pos >= start AND f.pos < start + 10 GROUP BY 1)
SELECT event_id, CASE WHEN NOT covered THEN 0 WHEN p0 >= greatest(p1, p2, p3) THEN 0 WHEN p1 >= greatest(p2, p3) THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END AS code, CASE WHEN covered THEN greatest(p0, p1, p2, p3) ELSE 0 END AS confidence, covered FROM e""", "frames")
def w15_overlap_average(t):
    return series.overlap_average(t.frames.select(*KEY, "pos", "event_id"), _window_probs(t), 10, 4).select("event_id", "code", "confidence", "covered")


@query(f"WITH {_WINDOWS} SELECT s.sequence_id, s.track_id, round(coalesce(avg(p[1]), 0.25), 6) AS p0, round(coalesce(avg(p[4]), 0.25), 6) AS p3 FROM s LEFT JOIN pr USING (sequence_id, track_id) GROUP BY ALL", "frames")
def w16_sequence_mean(t):
    m = _window_probs(t).groupBy(*KEY).agg(*[F.avg(F.get("p", F.lit(c))).alias(f"p{c}") for c in (0, 3)])
    ids = t.frames.select(*KEY).distinct()
    return ids.join(m, KEY, "left").select(*KEY, *[F.round(F.coalesce(f"p{c}", F.lit(0.25)), 6).alias(f"p{c}") for c in (0, 3)])


@query("""SELECT a.event_id, string_agg(b.frame_id, ',' ORDER BY b.frame_id) AS context, count(*)::INT AS context_size, least(a.pos, 3)::INT AS target_pos FROM frames a JOIN frames b ON a.sequence_id = b.sequence_id AND a.track_id = b.track_id AND b.pos BETWEEN a.pos - 3 AND a.pos + 3 GROUP BY a.event_id, a.pos""", "frames")
def w17_context(t):
    c = series.context(truth(t), 3, "frame_id")
    return c.select("event_id", F.array_join("context", ",").alias("context"), "context_size", F.col("target_pos").cast("int").alias("target_pos"))


_HITS = "h AS (SELECT sequence_id, track_id, pos, count(*) OVER (PARTITION BY sequence_id, track_id) AS n, event_id % 17 = 0 AS hit FROM frames), w AS (SELECT sequence_id, track_id, greatest(pos - 3, 0) AS s, least(pos + 3, n - 1) AS e FROM h WHERE hit)"


@query(f"""WITH {_HITS}, g AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY sequence_id, track_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, -1) THEN 1 ELSE 0 END AS new FROM w),
k AS (SELECT *, sum(new) OVER (PARTITION BY sequence_id, track_id ORDER BY s, e) AS grp FROM g) SELECT sequence_id, track_id, min(s) AS start, max(e) AS "end" FROM k GROUP BY sequence_id, track_id, grp""", "frames")
def w18_merged_windows(t):
    return series.merged_windows(truth(t), F.col("event_id") % 17 == 0, 6)


@query("WITH x AS (SELECT *, min(CASE WHEN event_id % 17 = 0 THEN frame_id END) OVER (PARTITION BY sequence_id, track_id) AS first_hit FROM frames) SELECT event_id, first_hit FROM x WHERE frame_id >= first_hit", "frames")
def w19_trim_to_hit(t):
    return series.trim_to_hit(truth(t), F.col("event_id") % 17 == 0).select("event_id", "first_hit")


@query("""WITH b AS (SELECT event_id, sequence_id, track_id, pos // 4 AS batch, CASE WHEN (pos // 4) % 3 = 0 THEN 'error' ELSE true_label END AS l, pos FROM frames)
SELECT event_id, coalesce(min_by(l, pos) FILTER (l <> 'error') OVER (PARTITION BY sequence_id, track_id), 'none') AS track_label FROM b""", "frames")
def w20_back_label(t):
    b = F.floor(F.col("pos") / 4)
    x = truth(t).withColumn("label", F.when(b % 3 == 0, "error").otherwise(F.col("label")))
    return series.back_label(x, "pos").select("event_id", "track_label")


def _segment_rows(t: Tables) -> DataFrame:
    """Segments as a model may give them: overlapping, with gaps, beyond the end."""
    before = F.lag("true_label").over(series.along(order="pos"))
    s = t.frames.withColumn("before", before).where("not true_label <=> before").select(*KEY, "pos", F.col("pos").cast("int").alias("seg_ord"), F.col("true_label").alias("label"))
    return s.select(*KEY, "seg_ord", "label", (F.col("pos") - 4).cast("int").alias("start_frame"), (F.col("pos") + F.col("track_id") % 14).cast("int").alias("end_frame"))


_SEGS = "segs AS (SELECT sequence_id, track_id, pos::INT AS seg_ord, true_label AS label, (pos - 4)::INT AS s, (pos + track_id % 14)::INT AS e FROM (SELECT *, lag(true_label) OVER (PARTITION BY sequence_id, track_id ORDER BY pos) AS before FROM frames) WHERE true_label IS DISTINCT FROM before)"


def _segment_lists(t: Tables) -> DataFrame:
    s = _segment_rows(t).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("seg_ord", "label", "start_frame", "end_frame"))).alias("x"))
    n = t.frames.groupBy(*KEY).agg(F.count("*").cast("int").alias("n"))
    return s.join(n, KEY).select(*KEY, "n", F.transform("x", lambda x: segments.segment(x["label"], x["start_frame"], x["end_frame"])).alias("segments"))


def _text(c) -> F.Column:
    return F.array_join(F.transform(c, lambda s: F.concat(s["label"], F.lit(":"), s["start_frame"], F.lit("-"), s["end_frame"])), ",")


@query(f"""WITH {_SEGS}, o AS (SELECT *, CASE WHEN label = lag(label) OVER w AND s <= max(e) OVER (PARTITION BY sequence_id, track_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM segs WINDOW w AS (PARTITION BY sequence_id, track_id ORDER BY s)),
g AS (SELECT *, sum(new) OVER (PARTITION BY sequence_id, track_id ORDER BY s) AS grp FROM o), m AS (SELECT sequence_id, track_id, grp, min(label) AS label, min(s) AS s, max(e) AS e FROM g GROUP BY ALL)
SELECT sequence_id, track_id, string_agg(label || ':' || s || '-' || e, ',' ORDER BY grp) AS merged FROM m GROUP BY ALL""", "frames")
def w21_merge_adjacent(t):
    return _segment_lists(t).select(*KEY, _text(segments.merge_adjacent(F.col("segments"))).alias("merged"))


@query(f"WITH {_SEGS} SELECT sequence_id, track_id, string_agg(label || ':' || least(greatest(s + 10, 10), 59) || '-' || least(greatest(e + 10, 10), 59), ',' ORDER BY seg_ord) AS moved, 'none:10-59' AS empty FROM segs GROUP BY ALL", "frames")
def w22_chunk_offset(t):
    return _segment_lists(t).select(*KEY, _text(segments.offset_chunk(F.col("segments"), F.lit(10), F.lit(59))).alias("moved"), _text(segments.offset_chunk(F.lit(None).cast(segments.TYPE), F.lit(10), F.lit(59))).alias("empty"))


def _expand_sql(order: str) -> str:
    return f"""WITH {_SEGS}, n AS (SELECT sequence_id, track_id, count(*) AS n FROM frames GROUP BY ALL), c AS (SELECT g.* REPLACE (least(greatest(s, 0), n - 1) AS s, least(greatest(e, 0), n - 1) AS e) FROM segs g JOIN n USING (sequence_id, track_id)),
x AS (SELECT f.event_id, c.label, row_number() OVER (PARTITION BY f.event_id ORDER BY seg_ord {order}) AS k FROM frames f LEFT JOIN c ON f.sequence_id = c.sequence_id AND f.track_id = c.track_id AND f.pos BETWEEN s AND e)
SELECT event_id, coalesce(label, 'none') AS label FROM x WHERE k = 1"""


@query(_expand_sql("ASC"), "frames")
def w23_segments_to_frames(t):
    return segments.to_frames(t.frames.select(*KEY, "pos", "event_id"), _segment_rows(t), KEY).select("event_id", "label")


@query(_expand_sql("DESC"), "frames")
def w23_segments_last_wins(t):
    return segments.to_frames(t.frames.select(*KEY, "pos", "event_id"), _segment_rows(t), KEY, overlap="last").select("event_id", "label")


@query(f"""WITH RECURSIVE {_SEGS}, n AS (SELECT sequence_id, track_id, count(*)::INT - 1 AS last FROM frames GROUP BY ALL),
x AS (SELECT segs.*, last, row_number() OVER w AS k, count(*) OVER (PARTITION BY sequence_id, track_id) AS m FROM segs JOIN n USING (sequence_id, track_id) WINDOW w AS (PARTITION BY sequence_id, track_id ORDER BY seg_ord)),
r AS (SELECT sequence_id, track_id, 0::BIGINT AS k, 0 AS cursor, []::STRUCT(l VARCHAR, s INT, e INT)[] AS parts FROM n
  UNION ALL SELECT sequence_id, track_id, k, CASE WHEN cursor > last THEN cursor ELSE b + 1 END, CASE WHEN cursor > last THEN parts ELSE list_append(parts, {{'l': label, 's': a, 'e': b}}) END
  FROM (SELECT *, CASE WHEN k = m THEN last ELSE least(greatest(e, a), last) END AS b FROM (SELECT x.*, r.cursor, r.parts, least(greatest(x.s, r.cursor), x.last) AS a FROM r JOIN x ON x.sequence_id = r.sequence_id AND x.track_id = r.track_id AND x.k = r.k + 1))),
z AS (SELECT r.*, last, len(parts) AS n FROM r JOIN n USING (sequence_id, track_id) QUALIFY k = max(k) OVER (PARTITION BY sequence_id, track_id))
SELECT sequence_id, track_id, array_to_string(list_transform(parts, lambda p, i: p.l || ':' || p.s || '-' || CASE WHEN i = n THEN last ELSE p.e END), ',') AS repaired FROM z""", "frames")
def w24_segment_repair(t):
    return _segment_lists(t).select(*KEY, _text(segments.repair(F.col("segments"), F.col("n"))).alias("repaired"))


@query("""WITH x AS (SELECT event_id, true_label AS l, CASE WHEN event_id % 5 > 0 THEN least(greatest(pos - 10, 0), 39) END AS s, pos + 5 AS e0 FROM frames), y AS (SELECT *, greatest(least(e0, 39), s) AS e FROM x)
SELECT event_id, CASE WHEN l = 'none' OR s IS NULL THEN l || ':0-39' ELSE CASE WHEN s > 0 THEN 'none:0-' || (s - 1) || ',' ELSE '' END || l || ':' || s || '-' || e || CASE WHEN e < 39 THEN ',none:' || (e + 1) || '-39' ELSE '' END END AS parts FROM y""", "frames")
def w25_single_to_segments(t):
    start = F.when(F.col("event_id") % 5 > 0, F.col("pos") - 10)
    return t.frames.select("event_id", _text(segments.from_single(F.col("true_label"), start, F.col("pos") + 5, F.lit(40))).alias("parts"))


@query(f"WITH {_SEGS} SELECT sequence_id, track_id, label, s AS start_frame FROM segs QUALIFY row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY (label = 'none'), seg_ord) = 1", "frames")
def w26_primary_segment(t):
    p = segments.primary(F.col("segments"))
    return _segment_lists(t).select(*KEY, p["label"].alias("label"), p["start_frame"].alias("start_frame"))


def _viterbi_sql() -> str:
    """Two recursions: scores with the states before, forward; the states themselves, backward."""
    log = lambda p: f"'{math.log(p) if p else '-Infinity'}'::DOUBLE"
    total = series.SEEN + 3 * series.OTHER
    emit = lambda s: f"CASE WHEN c = {s} THEN {log(series.SEEN / total)} ELSE {log(series.OTHER / total)} END"
    ways = ", ".join("[" + ", ".join(f"f.score[{r + 1}] + {log(series.TRANSITIONS[r][s])}" for r in range(4)) + f"] AS w{s}" for s in range(4))
    return f"""WITH RECURSIVE o AS (SELECT sequence_id, track_id, frame_id, label, row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY frame_id) - 1 AS k,
  greatest(coalesce(list_position(['none', 'left', 'right', 'hazard'], CASE WHEN label = 'both' THEN 'hazard' ELSE label END), 1), 1) - 1 AS c FROM labelled WHERE model_name = 'model_a'),
f AS (SELECT sequence_id, track_id, k, [{', '.join(f'{emit(s)} + {log(0.25)}' for s in range(4))}] AS score, NULL::INTEGER[] AS back FROM o WHERE k = 0
  UNION ALL SELECT sequence_id, track_id, k, [{', '.join(f'list_max(w{s}) + {emit(s)}' for s in range(4))}], [{', '.join(f'list_position(w{s}, list_max(w{s}))::INTEGER' for s in range(4))}]
  FROM (SELECT o.sequence_id, o.track_id, o.k, o.c, {ways} FROM f JOIN o ON o.sequence_id = f.sequence_id AND o.track_id = f.track_id AND o.k = f.k + 1)),
b AS (SELECT sequence_id, track_id, k, list_position(score, list_max(score))::INTEGER AS at, back FROM f QUALIFY k = max(k) OVER (PARTITION BY sequence_id, track_id)
  UNION ALL SELECT f.sequence_id, f.track_id, f.k, b.back[b.at], f.back FROM b JOIN f ON f.sequence_id = b.sequence_id AND f.track_id = b.track_id AND f.k = b.k - 1)
SELECT o.sequence_id, o.track_id, o.frame_id, ['none', 'left', 'right', 'hazard'][b.at] AS label, o.label AS original_label, ['none', 'left', 'right', 'hazard'][b.at] <> o.label AS smoothed
FROM o JOIN b ON o.sequence_id = b.sequence_id AND o.track_id = b.track_id AND o.k = b.k"""


@query(_viterbi_sql(), "labelled")
def w27_hmm_smoothing(t):
    return series.hmm_smooth(voted(t))


@query("SELECT run_id, 'exp_' || (row_number() OVER (PARTITION BY model_name ORDER BY strptime(run_ts, '%Y%m%d_%H%M%S'), run_id) - 1) AS experiment FROM runs", "runs")
def w28_run_numbers(t):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("model_name").orderBy(F.to_timestamp("run_ts", "yyyyMMdd_HHmmss"), "run_id")) - 1
    return t.runs.select("run_id", F.concat(F.lit("exp_"), n).alias("experiment"))


@query("SELECT run_id, round(frame_accuracy - lag(frame_accuracy) OVER w, 6) AS delta, round(frame_accuracy - first_value(frame_accuracy) OVER w, 6) AS gap FROM runs WINDOW w AS (PARTITION BY model_name ORDER BY run_id)", "runs")
def w29_epoch_deltas(t):
    from pyspark.sql import Window

    w = Window.partitionBy("model_name").orderBy("run_id")
    a = F.col("frame_accuracy")
    return t.runs.select("run_id", F.round(a - F.lag(a).over(w), 6).alias("delta"), F.round(a - F.first(a).over(w), 6).alias("gap"))


@query("WITH d AS (SELECT sequence_id, track_id, abs(intensity - lag(intensity) OVER (PARTITION BY sequence_id, track_id ORDER BY pos)) AS d FROM frames) SELECT sequence_id, track_id, round(coalesce(sum(d), 0), 4) AS energy, round(coalesce(var_pop(d), 0), 4) AS variance FROM d GROUP BY ALL", "frames")
def w30_difference_energy(t):
    return series.difference_energy(t.frames, "intensity").withColumn("energy", F.round("energy", 4)).withColumn("variance", F.round("variance", 4))


@query("""WITH s AS (SELECT sequence_id, count(*) AS n, avg(intensity) AS m FROM frames GROUP BY 1), k AS (SELECT *, unnest(range(1, (n - 1) // 2 + 1)) AS k FROM s),
p AS (SELECT k.sequence_id, k.n, k.k, sqrt(pow(sum((f.intensity - m) * cos(2 * pi() * k.k * f.pos / n)), 2) + pow(sum((f.intensity - m) * sin(2 * pi() * k.k * f.pos / n)), 2)) AS a FROM k JOIN frames f USING (sequence_id) GROUP BY ALL),
b AS (SELECT *, k * 10.0 / n AS f FROM p), x AS (SELECT sequence_id, max(a) FILTER (f BETWEEN 1 AND 2.5) AS top, arg_max(f, a) FILTER (f BETWEEN 1 AND 2.5) AS tf, avg(a) AS mean FROM b GROUP BY 1)
SELECT sequence_id, top > 2 * mean AS is_periodic, round(tf, 6)::DOUBLE AS peak_frequency, round(mean, 3) AS mean_power FROM x""", "frames")
def w31_periodogram(t):
    s = t.frames.groupBy("sequence_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "intensity"))), lambda x: x["intensity"]).alias("a"))
    p = s.select("sequence_id", arrays.periodicity(F.col("a")).alias("p"))
    return p.select("sequence_id", "p.is_periodic", F.round("p.peak_frequency", 6).alias("peak_frequency"), F.round("p.mean_power", 3).alias("mean_power"))


@query("WITH n AS (SELECT sequence_id, track_id, count(*) AS num_frames, (count(*) // 5)::BIGINT AS bucket FROM frames GROUP BY 1, 2) SELECT *, ((row_number() OVER (PARTITION BY bucket ORDER BY num_frames, sequence_id, track_id) - 1) // 8)::BIGINT AS batch FROM n", "frames")
def w32_length_batches(t):
    return series.length_batches(t.frames, 5, 8)


@query("SELECT event_id, round(avg(intensity) OVER (PARTITION BY sequence_id, track_id ORDER BY pos ROWS 2 PRECEDING), 6) AS average FROM frames QUALIFY pos >= 2", "frames")
def w33_moving_average(t):
    return series.moving_average(t.frames, "intensity").select("event_id", F.round("average", 6).alias("average"))


@query("WITH i AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY frame_id) AS k FROM labelled WHERE model_name = 'model_a'), x AS (SELECT a.event_id, a.label IN ('both', 'hazard') AS bs, count(DISTINCT b.label) >= 3 AND a.k > 1 AS rc, a.event_id % 10 = 0 AS rs FROM i a JOIN i b ON a.sequence_id = b.sequence_id AND a.track_id = b.track_id AND b.k BETWEEN a.k - 5 AND a.k GROUP BY ALL, a.k) SELECT event_id, array_to_string(list_filter([CASE WHEN bs THEN 'both_signals' END, CASE WHEN rc THEN 'rapid_change' END, CASE WHEN rs THEN 'random_sample' END], lambda v: v IS NOT NULL), ',') AS flags, bs OR rc OR rs AS flagged FROM x".replace("GROUP BY ALL, a.k", "GROUP BY a.event_id, a.label, a.k"), "labelled")
def d09_quality_flags(t):
    q = postprocess.quality_flags(voted(t), F.col("event_id") % 10 == 0)
    return q.select("event_id", F.array_join("flags", ",").alias("flags"), "flagged")


@query(f"""WITH {_mode_sql(5)}, q0 AS (SELECT *, CASE WHEN k = 1 OR label <> lag(label) OVER (PARTITION BY sequence_id, track_id ORDER BY k) THEN 1 ELSE 0 END AS chg FROM sm),
q AS (SELECT *, sum(chg) OVER (PARTITION BY sequence_id, track_id ORDER BY k) AS run FROM q0), m AS (SELECT *, CASE WHEN label <> 'none' AND count(*) OVER (PARTITION BY sequence_id, track_id, run) < 3 THEN 'none' ELSE label END AS l2 FROM q),
z0 AS (SELECT *, CASE WHEN k = 1 OR l2 <> lag(l2) OVER (PARTITION BY sequence_id, track_id ORDER BY k) THEN 1 ELSE 0 END AS chg2 FROM m), z AS (SELECT *, sum(chg2) OVER (PARTITION BY sequence_id, track_id ORDER BY k) AS run2 FROM z0)
SELECT event_id, CASE WHEN l2 <> 'none' AND row_number() OVER (PARTITION BY sequence_id, track_id, run2 ORDER BY k) > 6 THEN 'none' ELSE l2 END AS label FROM z""", "labelled")
def d10_postprocessing_chain(t):
    return postprocess.chain(voted(t), 5, 3, 6).select("event_id", "label")


@query("""WITH n AS (SELECT sequence_id, track_id, true_label, event_id, count(*) OVER (PARTITION BY sequence_id, track_id) AS n, (event_id * 7919 + 42) % 1000003 AS h FROM frames)
SELECT event_id FROM n QUALIFY row_number() OVER (PARTITION BY sequence_id, track_id, true_label ORDER BY h, event_id) <= greatest(1, floor(n * 0.2::DOUBLE)::BIGINT // 4)""", "frames")
def r03_review_sample(t):
    return postprocess.review_sample(truth(t), 0.2, key="event_id").select("event_id")


@query("SELECT sequence_id, count(*) AS frames, count(*) FILTER (label IN ('hazard')) AS flagged FROM labelled WHERE model_name = 'model_a' GROUP BY 1", "labelled")
def s18_run_manifest(t):
    q = postprocess.quality_flags(voted(t), before=0)
    return q.groupBy("sequence_id").agg(F.count("*").alias("frames"), F.count_if("flagged").alias("flagged"))


@query("SELECT label, sum(e - s + 1)::BIGINT AS frames FROM segs GROUP BY 1".join(["WITH " + _SEGS + " ", ""]), "frames")
def a20_label_totals(t):
    return segments.label_totals(_segment_rows(t))


@query("WITH f AS (SELECT CASE WHEN label = 'hazard' THEN 'both_signals' END AS a, CASE WHEN event_id % 10 = 0 THEN 'random_sample' END AS b FROM labelled WHERE model_name = 'model_a'), u AS (SELECT a AS flag FROM f UNION ALL SELECT b FROM f) SELECT flag, count(*) AS n, round(count(*) / (SELECT count(*) FROM f), 6) AS rate FROM u WHERE flag IS NOT NULL GROUP BY 1", "labelled")
def a21_flag_counts(t):
    q = postprocess.quality_flags(voted(t), F.col("event_id") % 10 == 0, before=0)
    total = q.agg(F.count("*").alias("total"))
    n = q.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("flag", "n", F.round(F.col("n") / F.col("total"), 6).alias("rate"))


@query(f"WITH {_RUNS}, d AS (SELECT sequence_id, track_id, true_label, count(*) AS n, min(frame_id) AS f FROM frames GROUP BY ALL), b AS (SELECT sequence_id, track_id, true_label AS dominant, n AS top FROM d QUALIFY row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY n DESC, f) = 1), e AS (SELECT sequence_id, track_id, count(DISTINCT run) FILTER (true_label <> 'none') AS events, count(*) AS num_frames, count(*) FILTER (true_label <> 'none') AS signal_frames, count(*) FILTER (true_label = 'none') AS n_none, count(*) FILTER (true_label = 'left') AS n_left, count(*) FILTER (true_label = 'right') AS n_right, count(*) FILTER (true_label = 'hazard') AS n_hazard FROM r GROUP BY ALL) SELECT e.*, dominant, round(top / num_frames, 6) AS dominant_share, round(signal_frames / num_frames, 6) AS signal_share FROM e JOIN b USING (sequence_id, track_id)", "frames")
def a23_sequence_summary(t):
    return sequence_summary(t)


def sequence_summary(t: Tables) -> DataFrame:
    from ..operators import fusion

    f = truth(t)
    r = series.run_ids(f, "label")
    starts = series.along()
    e = r.withColumn("new", (F.col("run") != F.coalesce(F.lag("run").over(starts), F.lit(0))) & (F.col("label") != "none"))
    e = e.groupBy(*KEY).agg(F.count_if("new").alias("events"), F.count("*").alias("num_frames"), F.count_if(F.col("label") != "none").alias("signal_frames"), *[F.count_if(F.col("label") == x).alias(f"n_{x}") for x in ("none", "left", "right", "hazard")])
    b = fusion.sequence_label(f).select(*KEY, F.col("label").alias("dominant"), F.col("votes").alias("top"))
    out = e.join(b, KEY)
    return out.select(*e.columns, "dominant", F.round(F.col("top") / F.col("num_frames"), 6).alias("dominant_share"), F.round(F.col("signal_frames") / F.col("num_frames"), 6).alias("signal_share"))


@query(f"WITH {_RUNS}, d AS (SELECT sequence_id, track_id, true_label, count(*) AS n FROM frames GROUP BY ALL), x AS (SELECT sequence_id, track_id, round(max(n) / sum(n), 6) AS share FROM d GROUP BY ALL), e AS (SELECT count(*) AS total_events, count(DISTINCT track_id) AS with_signal FROM (SELECT DISTINCT track_id, run FROM r WHERE true_label <> 'none')), h AS (SELECT count(*) FILTER (true_label = 'none') AS n_none, count(*) FILTER (true_label = 'left') AS n_left, count(*) FILTER (true_label = 'right') AS n_right, count(*) FILTER (true_label = 'hazard') AS n_hazard FROM frames) SELECT total_events, with_signal, n_none, n_left, n_right, n_hazard, round(avg(share), 5) AS mean_share, round(median(share), 5) AS median_share FROM x, e, h GROUP BY ALL", "frames")
def a24_dataset_summary(t):
    s = sequence_summary(t)
    return s.agg(F.sum("events").alias("total_events"), F.count_if(F.col("events") > 0).alias("with_signal"), *[F.sum(f"n_{x}").alias(f"n_{x}") for x in ("none", "left", "right", "hazard")], F.round(F.avg("dominant_share"), 5).alias("mean_share")).crossJoin(F.broadcast(quantiles(s, [], "dominant_share", {"m": 0.5}))).withColumn("median_share", F.round("m", 5)).drop("m")


@query("SELECT f.event_id, f.sequence_id || '__track_' || f.track_id AS key, coalesce(l.label, 'none') AS label, l.label IS NOT NULL AS matched FROM frames f LEFT JOIN labelled l ON l.event_id = f.event_id AND l.model_name = 'model_b'", "labelled")
def j03_frames_with_predictions(t):
    """Every original frame; one without a prediction is none."""
    p = labelled(t).where("model_name = 'model_b'").select("sequence_id", "frame_id", "label")
    f = t.frames.select("sequence_id", "track_id", "frame_id", "event_id").join(p, ["sequence_id", "frame_id"], "left")
    return f.select("event_id", F.concat("sequence_id", F.lit("__track_"), "track_id").alias("key"), F.coalesce("label", F.lit("none")).alias("label"), F.col("label").isNotNull().alias("matched"))


@query("""WITH p AS (SELECT f.sequence_id, f.track_id, l.label IS NOT NULL AS direct, bool_or(l.label IS NOT NULL) OVER (PARTITION BY f.sequence_id, f.track_id) AS found FROM frames f LEFT JOIN labelled l ON l.event_id = f.event_id AND l.model_name = 'model_b')
SELECT count(DISTINCT (sequence_id, track_id)) FILTER (found) AS matched, count(DISTINCT (sequence_id, track_id)) FILTER (NOT found) AS unmatched, count(*) FILTER (direct) AS direct, count(*) FILTER (found AND NOT direct) AS propagated FROM p""", "labelled")
def j03_match_counts(t):
    """Tracks with and without predictions, frames with their own and with a propagated label."""
    p = labelled(t).where("model_name = 'model_b'").select("sequence_id", "frame_id", "label")
    f = t.frames.select(*KEY, "frame_id").join(p, ["sequence_id", "frame_id"], "left")
    n = f.groupBy(*KEY).agg(F.count("label").alias("d"), F.count("*").alias("n"))
    some = F.col("d") > 0
    return n.agg(F.count_if(some).alias("matched"), F.count_if(~some).alias("unmatched"), F.coalesce(F.sum("d"), F.lit(0)).alias("direct"), F.coalesce(F.sum(F.when(some, F.col("n") - F.col("d"))), F.lit(0)).alias("propagated"))


@query("""WITH p AS (SELECT f.event_id, f.sequence_id, f.track_id, f.pos, l.label AS l FROM frames f LEFT JOIN labelled l ON l.event_id = f.event_id AND l.model_name = 'model_b')
SELECT event_id, l IS NOT NULL AS direct, coalesce(last_value(l IGNORE NULLS) OVER (PARTITION BY sequence_id, track_id ORDER BY pos ROWS UNBOUNDED PRECEDING), first_value(l IGNORE NULLS) OVER (PARTITION BY sequence_id, track_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'none') AS label FROM p""", "labelled")
def d12_reconstruction(t):
    """Predictions on every original frame: join, then propagation inside the track."""
    p = labelled(t).where("model_name = 'model_b'").select("sequence_id", "frame_id", "label")
    f = t.frames.select(*KEY, "frame_id", "event_id").join(p, ["sequence_id", "frame_id"], "left")
    return series.propagate(f).select("event_id", "direct", "label")
