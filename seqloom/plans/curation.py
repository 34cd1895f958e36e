"""Queries for curation: joins with corrections, track filters, splits, rules, rankings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays, keys, labels
from ..operators import edits, fusion, rules, sampling, series, tracks
from ..operators.quantiles import quantiles
from .base import Tables, query

KEY = ["sequence_id", "track_id"]
_R6 = lambda c: F.round(c, 6)


def lengths(t: Tables) -> DataFrame:
    return t.frames.groupBy(*KEY).agg(F.count("*").alias("n"))


@query("SELECT sequence_id, track_id, min(frame_id) AS start_frame, max(frame_id) AS end_frame, count(*) AS num_frames, max(frame_id) - min(frame_id) + 1 AS duration FROM frames GROUP BY ALL", "frames")
def a01_sequences(t):
    f = F.col("frame_id")
    return t.frames.groupBy(*KEY).agg(F.min(f).alias("start_frame"), F.max(f).alias("end_frame"), F.count("*").alias("num_frames"), (F.max(f) - F.min(f) + 1).alias("duration"))


@query("WITH n AS (SELECT sequence_id, track_id, count(*) AS n, count(*) FILTER (true_label <> 'none') AS s FROM frames GROUP BY ALL) SELECT count(*) AS sequences, sum(n)::BIGINT AS frames, round(avg(n), 6) AS mean, min(n) AS low, max(n) AS high, sum(s)::BIGINT AS signal FROM n", "frames")
def a02_dataset_statistics(t):
    n = t.frames.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(F.col("true_label") != "none").alias("s"))
    return n.agg(F.count("*").alias("sequences"), F.sum("n").alias("frames"), _R6(F.avg("n")).alias("mean"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum("s").alias("signal"))


@query("WITH n AS (SELECT split_part(sequence_id, '/', 1) AS recording, sequence_id, count(*) AS n FROM frames GROUP BY ALL) SELECT recording, count(*) AS sequences, sum(n)::BIGINT AS frames, round(avg(n), 6) AS mean FROM n GROUP BY 1", "frames")
def a22_dataset_rollup(t):
    n = t.frames.groupBy(keys.recording_of(F.col("sequence_id")).alias("recording"), "sequence_id").agg(F.count("*").alias("n"))
    return n.groupBy("recording").agg(F.count("*").alias("sequences"), F.sum("n").alias("frames"), _R6(F.avg("n")).alias("mean"))


_SEQ = "sl AS (SELECT sequence_id, track_id, true_label, count(*) AS v, min(frame_id) AS f FROM frames GROUP BY ALL), st AS (SELECT sequence_id, track_id, true_label FROM sl QUALIFY row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY v DESC, f) = 1), pl AS (SELECT sequence_id, track_id, label, count(*) AS v, min(frame_id) AS f FROM labelled WHERE model_name = 'model_a' GROUP BY ALL), sp AS (SELECT sequence_id, track_id, label FROM pl QUALIFY row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY v DESC, f) = 1)"


@query(f"WITH {_SEQ} SELECT round(avg((label = true_label)::INT), 6) AS accuracy, count(*) AS n FROM st JOIN sp USING (sequence_id, track_id)", "labelled")
def a26_sequence_accuracy(t):
    from .fusion import model

    truth = fusion.sequence_label(t.frames, "true_label").select(*KEY, F.col("label").alias("truth"))
    return fusion.sequence_label(model(t, "model_a")).join(truth, KEY).agg(_R6(F.avg((F.col("label") == F.col("truth")).cast("double"))).alias("accuracy"), F.count("*").alias("n"))


@query("WITH n AS (SELECT true_label AS label, count(DISTINCT sequence_id) AS sequences FROM frames GROUP BY 1) SELECT *, round(sequences / sum(sequences) OVER (), 6) AS share FROM n", "frames")
def a27_sequences_per_label(t):
    n = t.frames.groupBy(F.col("true_label").alias("label")).agg(F.count_distinct("sequence_id").alias("sequences"))
    return n.withColumn("share", _R6(F.col("sequences") / F.sum("sequences").over(Window.partitionBy())))


@query("SELECT coalesce(split_part(sequence_id, '/', 1), 'TOTAL') AS session, count(*) AS n FROM frames GROUP BY ROLLUP (split_part(sequence_id, '/', 1))", "frames")
def a28_session_counts(t):
    return t.frames.rollup(keys.recording_of(F.col("sequence_id")).alias("session")).agg(F.count("*").alias("n")).withColumn("session", F.coalesce("session", F.lit("TOTAL")))


@query("SELECT split_part(sequence_id, '/', 1) AS recording, count(*) FILTER (true_label = 'none') AS none, count(*) FILTER (true_label = 'left') AS \"left\", count(*) FILTER (true_label = 'right') AS \"right\", count(*) FILTER (true_label = 'hazard') AS hazard, count(DISTINCT sequence_id) AS scenarios, count(*) AS total, count(DISTINCT crop_path) AS images FROM frames GROUP BY 1", "frames")
def a29_annotation_pivot(t):
    f = t.frames.withColumn("recording", keys.recording_of(F.col("sequence_id")))
    n = f.groupBy("recording").pivot("true_label", ["none", "left", "right", "hazard"]).count().na.fill(0)
    return n.join(f.groupBy("recording").agg(F.count_distinct("sequence_id").alias("scenarios"), F.count("*").alias("total"), F.count_distinct("crop_path").alias("images")), "recording")


@query("SELECT min(x2 - x1) AS min_w, max(x2 - x1) AS max_w, round(avg(x2 - x1), 6) AS mean_w, min(y2 - y1) AS min_h, max(y2 - y1) AS max_h, round(avg(y2 - y1), 6) AS mean_h FROM frames", "frames")
def a30_size_statistics(t):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return t.frames.agg(*[x for c, s in ((w, "w"), (h, "h")) for x in (F.min(c).alias(f"min_{s}"), F.max(c).alias(f"max_{s}"), _R6(F.avg(c)).alias(f"mean_{s}"))])


@query("WITH n AS (SELECT sequence_id, track_id, count(*) AS n FROM frames GROUP BY ALL) SELECT min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean, median(n)::DOUBLE AS median, count(*) FILTER (n >= 65) AS long_enough FROM n", "frames")
def a31_track_lengths(t):
    return lengths(t).agg(F.min("n").alias("low"), F.max("n").alias("high"), _R6(F.avg("n")).alias("mean"), F.median("n").alias("median"), F.count_if(F.col("n") >= 65).alias("long_enough"))


@query("SELECT event_id FROM frames QUALIFY count(*) OVER (PARTITION BY sequence_id, track_id) >= 65", "frames")
def a31_drop_short_tracks(t):
    return tracks.drop_short(t.frames, KEY, 65).select("event_id")


@query("WITH m AS (SELECT *, (x2 - x1)::DOUBLE AS w, (y2 - y1)::DOUBLE AS h FROM frames), q AS (SELECT *, median(w) OVER p AS mw, median(h) OVER p AS mh FROM m WINDOW p AS (PARTITION BY sequence_id, track_id)) SELECT event_id FROM q WHERE abs(w - mw) <= mw * 0.3::DOUBLE AND abs(h - mh) <= mh * 0.3::DOUBLE", "frames")
def a32_consistent_sizes(t):
    return tracks.consistent_sizes(t.frames, KEY).select("event_id")


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def a33_category_combinations(t):
    return t.labels.groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT sequence_id, track_id, count(*) AS n, bool_or(true_label = 'hazard') AS s FROM frames GROUP BY ALL) SELECT round(avg(s::INT), 6) AS with_signal, quantile_cont(n, 0.25)::DOUBLE AS q1, quantile_cont(n, 0.75)::DOUBLE AS q3, round(avg((n >= 65)::INT), 6) AS long_share FROM n", "frames")
def a34_sequence_shares(t):
    n = t.frames.groupBy(*KEY).agg(F.count("*").alias("n"), F.bool_or(F.col("true_label") == "hazard").alias("s"))
    share = lambda c: _R6(F.avg(c.cast("int").cast("double")))
    return n.agg(share(F.col("s")).alias("with_signal"), F.percentile("n", 0.25).alias("q1"), F.percentile("n", 0.75).alias("q3"), share(F.col("n") >= 65).alias("long_share"))


@query("WITH n AS (SELECT sequence_id, count(*) AS n FROM frames GROUP BY 1), sl AS (SELECT sequence_id, true_label, count(*) AS v, min(frame_id) AS f FROM frames GROUP BY ALL), st AS (SELECT * FROM sl QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY v DESC, f) = 1), v AS (SELECT split_part(sequence_id, '/', 1) AS bucket, count(*) AS n FROM n GROUP BY 1 ORDER BY n DESC, bucket LIMIT 10) SELECT 'length' AS kind, ((n // 10) * 10)::VARCHAR AS bucket, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'camera', split_part(sequence_id, '/', 2)[:8], count(*) FROM n GROUP BY 2 UNION ALL SELECT 'label', true_label, count(*) FROM st GROUP BY 2 UNION ALL SELECT 'video', bucket, n FROM v", "frames")
def a35_curation_histograms(t):
    n = fusion.sequence_label(t.frames, "true_label").join(lengths(t), KEY)
    h = lambda kind, c: n.groupBy(F.lit(kind).alias("kind"), c.alias("bucket")).agg(F.count("*").alias("n"))
    video = h("video", keys.recording_of(F.col("sequence_id"))).orderBy(F.desc("n"), "bucket").limit(10)
    return h("length", (F.floor(F.col("n") / 10) * 10).cast("string")).unionByName(h("camera", F.substring(keys.camera_of(F.col("sequence_id")), 1, 8))).unionByName(h("label", F.col("label"))).unionByName(video)


@query("SELECT ground_truth AS label, min(left_activity) AS low, max(left_activity) AS high, median(left_activity) AS median, round(avg(left_activity), 6) AS mean FROM params GROUP BY 1", "params")
def a36_feature_statistics(t):
    c, rows = F.col("left_activity"), t.params.withColumnRenamed("ground_truth", "label")
    rest = rows.groupBy("label").agg(F.min(c).alias("low"), F.max(c).alias("high"), _R6(F.avg(c)).alias("mean"))
    return rest.join(quantiles(rows, ["label"], "left_activity", {"median": 0.5}), "label")


@query("WITH n AS (SELECT true_label AS label, count(*) AS n FROM frames GROUP BY 1) SELECT label, coalesce(n, 0) AS n, round(sum(n) OVER ()::DOUBLE / (4 * greatest(coalesce(n, 0), 1)), 6) AS weight FROM domain LEFT JOIN n USING (label)", "frames", "domain")
def a37_class_weights(t):
    grid = t.spark.createDataFrame([(x,) for x in ("none", "left", "right", "hazard")], "label string")
    n = t.frames.groupBy(F.col("true_label").alias("label")).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(n, "label", "left").na.fill(0).withColumn("weight", _R6(F.sum("n").over(Window.partitionBy()) / (4 * F.greatest("n", F.lit(1)))))


@query("SELECT event_type, count(*) AS calls, round(avg((event_id % 9 <> 0)::INT), 6) AS parsed, round(sum(value) / count(*), 6) AS per_call, round(sum(value) / sum(user_id % 5 + 1), 6) AS per_frame FROM events GROUP BY 1")
def a38_inference_metrics(t):
    v = F.col("value")
    return t.events.groupBy("event_type").agg(F.count("*").alias("calls"), _R6(F.avg((F.col("event_id") % 9 != 0).cast("double"))).alias("parsed"), _R6(F.sum(v) / F.count("*")).alias("per_call"), _R6(F.sum(v) / F.sum(F.col("user_id") % 5 + 1)).alias("per_frame"))


def _periodic(source: str) -> str:
    """SQL for whether series are periodic: source has g (the series), i (places from 0) and v (values)."""
    return f"""sn AS (SELECT g, count(*) AS n, avg(v) AS m FROM {source} GROUP BY 1), sk AS (SELECT *, unnest(range(1, (n - 1) // 2 + 1)) AS k FROM sn WHERE n >= 4),
sp AS (SELECT sk.g, sk.n, sk.k, sqrt(pow(sum((x.v - m) * cos(2 * pi() * sk.k * x.i / n)), 2) + pow(sum((x.v - m) * sin(2 * pi() * sk.k * x.i / n)), 2)) AS a FROM sk JOIN {source} x USING (g) GROUP BY ALL),
per AS (SELECT sn.g, coalesce(max(a) FILTER (k * 10.0 / sp.n BETWEEN 1 AND 2.5) > 2 * avg(a), false) AS is_periodic FROM sn LEFT JOIN sp USING (g) GROUP BY 1)"""


def sides(t: Tables) -> DataFrame:
    """Two intensity series for each track."""
    s = F.array_sort(F.collect_list(F.struct("pos", "intensity", "event_id")))
    return t.frames.groupBy(*KEY).agg(s.alias("s")).select(*KEY, F.transform("s", lambda x: x["intensity"]).alias("left"), F.transform("s", lambda x: x["intensity"] * (x["event_id"] % 3)).alias("right"))


_SIDES = "a AS (SELECT sequence_id, track_id, stddev_pop(intensity) AS l, stddev_pop(intensity * (event_id % 3)) AS r, avg(intensity) AS ml, avg(intensity * (event_id % 3)) AS mr FROM frames GROUP BY ALL)"


@query(f"WITH {_SIDES} SELECT sequence_id, track_id, round(l, 4) AS left_activity, round(r, 4) AS right_activity, round(CASE WHEN ml > 0 THEN l / ml ELSE 0 END, 4) AS left_cv, round(CASE WHEN mr > 0 THEN r / mr ELSE 0 END, 4) AS right_cv, round(greatest(l, r), 4) AS max_activity, round(least(l, r), 4) AS min_activity, round(least(l, r) / greatest(l, r), 4) AS activity_ratio FROM a", "frames")
def a39_series_activity(t):
    a = sides(t).select(*KEY, *rules.activity(F.col("left"), F.col("right")))
    return a.select(*KEY, *[F.round(c, 4).alias(c) for c in a.columns[2:]])


def _rule_sql(blinking: str) -> str:
    why = f"CASE WHEN NOT ({blinking}) THEN 'not blinking' WHEN greatest(l, r) < 20 THEN 'low activity' WHEN least(l, r) / greatest(l, r) > 0.7::DOUBLE THEN 'both sides alike' ELSE 'one side more active' END"
    return f"WITH {_SIDES}, ser AS (SELECT sequence_id AS g, pos AS i, intensity AS v FROM frames), {_periodic('ser')}, y AS (SELECT *, {why} AS reason FROM a JOIN per ON sequence_id = g) SELECT sequence_id, track_id, CASE reason WHEN 'both sides alike' THEN 'hazard' WHEN 'one side more active' THEN CASE WHEN l > r THEN 'left' ELSE 'right' END ELSE 'none' END AS label, reason, is_periodic FROM y"


def _rule(t: Tables, strict: bool) -> DataFrame:
    f = sides(t).select("*", *rules.activity(F.col("left"), F.col("right")))
    return rules.classify(f, "left", 20.0, 0.7, variance=0.58, strict=strict).select(*KEY, "label", "reason", "is_periodic")


@query(_rule_sql("is_periodic OR (ml > 0 AND l > ml * 0.58::DOUBLE)"), "frames")
def d01_signal_rule(t):
    return _rule(t, False)


@query(_rule_sql("is_periodic"), "frames")
def d01_signal_rule_strict(t):
    return _rule(t, True)


@query(f"WITH ser AS (SELECT sequence_id AS g, pos AS i, intensity AS v FROM frames), {_periodic('ser')}, {_SEQ.split(', pl AS')[0]} SELECT true_label AS label, count(*) AS sequences, round(avg(is_periodic::INT), 6) AS share_periodic FROM st JOIN per ON sequence_id = g GROUP BY 1", "frames")
def a36_share_periodic(t):
    p = sides(t).select(*KEY, arrays.periodicity(F.col("left"))["is_periodic"].alias("is_periodic"))
    n = p.join(fusion.sequence_label(t.frames, "true_label").select(*KEY, "label"), KEY)
    return n.groupBy("label").agg(F.count("*").alias("sequences"), _R6(F.avg(F.col("is_periodic").cast("int").cast("double"))).alias("share_periodic"))


@query("WITH x AS (SELECT *, CASE WHEN greatest(left_activity, right_activity) > 0 THEN least(left_activity, right_activity) / greatest(left_activity, right_activity) ELSE 0 END AS ratio FROM params) SELECT sequence_key, CASE WHEN greatest(left_activity, right_activity) < 5000 THEN 'none' WHEN ratio > 0.6::DOUBLE THEN 'hazard' WHEN left_activity > right_activity THEN 'left' ELSE 'right' END AS label FROM x", "params")
def d02_threshold_rule(t):
    return rules.with_ratio(t.params).select("sequence_key", rules.threshold_rule(F.lit(5000.0), F.lit(0.6)).alias("label"))


_GRID = "g AS (SELECT a * 3 + h AS grid_ord, (a + 1) * 2500.0::DOUBLE AS t, (h + 4) / 10.0::DOUBLE AS hr FROM range(4) x(a), range(3) y(h)), e AS (SELECT grid_ord, t, hr, ground_truth AS true_label, CASE WHEN greatest(left_activity, right_activity) < t THEN 'none' WHEN greatest(left_activity, right_activity) > 0 AND least(left_activity, right_activity) / greatest(left_activity, right_activity) > hr THEN 'hazard' WHEN left_activity > right_activity THEN 'left' ELSE 'right' END AS label FROM params CROSS JOIN g), c AS (SELECT grid_ord, t, hr, d.label, count(*) FILTER (true_label = d.label AND e.label = d.label) AS tp, count(*) FILTER ((true_label = d.label) <> (e.label = d.label)) AS w, sum(count(*) FILTER (true_label = d.label AND e.label = d.label)) OVER (PARTITION BY grid_ord)::DOUBLE / count(*) AS acc FROM e CROSS JOIN domain d GROUP BY 1, 2, 3, 4), s AS (SELECT grid_ord::INT AS grid_ord, t AS activity_threshold, hr AS hazard_ratio, round(max(acc), 6) AS accuracy, round(avg(CASE WHEN 2 * tp + w > 0 THEN 2.0 * tp / (2 * tp + w) ELSE 0 END), 6) AS macro_f1 FROM c GROUP BY ALL)"


def searched(t: Tables) -> DataFrame:
    grid = t.spark.createDataFrame([(a * 3 + h, (a + 1) * 2500.0, (h + 4) / 10.0) for a in range(4) for h in range(3)], "grid_ord int, activity_threshold double, hazard_ratio double")
    return rules.grid_search(rules.with_ratio(t.params), grid)


@query(f"WITH {_GRID} SELECT * FROM s", "params", "domain")
def d03_grid_search(t):
    return searched(t)


@query(f"WITH {_GRID} SELECT * FROM s ORDER BY macro_f1 DESC, grid_ord LIMIT 10", "params", "domain")
def k02_top_configurations(t):
    return searched(t).orderBy(F.desc("macro_f1"), "grid_ord").limit(10)


@query("SELECT sequence_key, count(*) AS n, count(DISTINCT t) AS thresholds FROM params CROSS JOIN (SELECT unnest([1, 2, 3]) AS t) GROUP BY 1", "params")
def j17_parameter_grid(t):
    return t.params.crossJoin(F.broadcast(t.spark.range(1, 4).withColumnRenamed("id", "t"))).groupBy("sequence_key").agg(F.count("*").alias("n"), F.count_distinct("t").alias("thresholds"))


@query("WITH p AS (SELECT sequence_id, track_id, bool_or(code IS NULL) AS e, bool_or(event_id % 19 = 0) AS tr, bool_or(event_id % 23 = 0) AS f FROM predictions GROUP BY 1, 2) SELECT 'empty' AS kind, count(*) FILTER (e) AS n FROM p UNION ALL SELECT 'truncated', count(*) FILTER (tr) FROM p UNION ALL SELECT 'failed', count(*) FILTER (f) FROM p", "predictions")
def a40_result_diagnosis(t):
    raw = F.when(F.col("event_id") % 19 == 0, '{"label": ').otherwise('{"label": "left"}')
    p = t.predictions.withColumn("raw", raw).groupBy(*KEY).agg(F.bool_or(F.col("raw") == "").alias("empty"), F.bool_or(~F.rtrim("raw").endswith("}")).alias("truncated"), F.bool_or(F.col("event_id") % 23 == 0).alias("failed"))
    return p.agg(*[F.count_if(c).alias(c) for c in ("empty", "truncated", "failed")]).unpivot([], ["empty", "truncated", "failed"], "kind", "n")


@query("SELECT event_id, model_name, label, true_label FROM labelled JOIN frames USING (event_id) WHERE label <> true_label", "labelled")
def a41_failure_cases(t):
    from .fusion import labelled

    return labelled(t).join(t.frames.select("event_id", "true_label"), "event_id").where("label <> true_label").select("event_id", "model_name", "label", "true_label")


@query("WITH m AS (SELECT model_name, count(*) AS n, sum((label = true_label)::INT)::BIGINT AS correct FROM labelled JOIN frames USING (event_id) GROUP BY 1) SELECT *, round(correct / n, 6) AS accuracy, row_number() OVER (ORDER BY correct / n DESC, model_name) AS place FROM m", "labelled")
def a41_prompt_table(t):
    """Models (or prompts) by falling accuracy: one row for each, so ranking them takes one task."""
    from .fusion import labelled

    m = labelled(t).join(t.frames.select("event_id", "true_label"), "event_id").groupBy("model_name").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("true_label")).alias("correct"))
    share = F.col("correct") / F.col("n")
    return m.withColumn("accuracy", _R6(share)).withColumn("place", F.row_number().over(Window.orderBy(share.desc(), "model_name")).cast("long"))


@query("SELECT sequence_id, track_id, bool_or(true_label IN ('left', 'right')) AS positive, count(*) AS n FROM frames GROUP BY ALL", "frames")
def a42_positive_sequences(t):
    return t.frames.groupBy(*KEY).agg(F.bool_or(F.col("true_label").isin("left", "right")).alias("positive"), F.count("*").alias("n"))


@query("WITH m AS (SELECT s_suppkey AS k, s_acctbal::DOUBLE AS a, (s_suppkey * 37 % 100 + 1)::DOUBLE AS b FROM supplier), v AS (SELECT k, a / sqrt(sum(a * a) OVER ()) * 0.6::DOUBLE AS a, b / sqrt(sum(b * b) OVER ()) * 0.4::DOUBLE AS b FROM m), e AS (SELECT *, max(a) OVER () AS pa, min(a) OVER () AS wa, min(b) OVER () AS pb, max(b) OVER () AS wb FROM v), d AS (SELECT k, sqrt((a - pa) ** 2 + (b - pb) ** 2) AS p, sqrt((a - wa) ** 2 + (b - wb) ** 2) AS w FROM e) SELECT k AS run_id, round(w / (p + w), 6) AS closeness FROM d")
def a43_topsis(t):
    m = t.supplier.select(F.col("s_suppkey").alias("run_id"), F.col("s_acctbal").cast("double").alias("a"), (F.col("s_suppkey") * 37 % 100 + 1).cast("double").alias("b"))
    return rules.topsis(m, {"a": (0.6, True), "b": (0.4, False)}).select("run_id", "closeness")


@query("""WITH m AS (SELECT s_suppkey AS k, s_acctbal::DOUBLE AS a, (s_suppkey * 37 % 100 + 1)::DOUBLE AS b FROM supplier),
g AS (SELECT criterion, change::DOUBLE AS change, wa::DOUBLE / (wa + wb)::DOUBLE AS xa, wb::DOUBLE / (wa + wb)::DOUBLE AS xb
  FROM (VALUES ('', 0, 0.6, 0.4), ('a', -0.2, 0.48, 0.4), ('a', 0.2, 0.72, 0.4), ('b', -0.2, 0.6, 0.32), ('b', 0.2, 0.6, 0.48)) t(criterion, change, wa, wb)),
v AS (SELECT criterion, change, k, a / sqrt(sum(a * a) OVER w) * xa AS a, b / sqrt(sum(b * b) OVER w) * xb AS b FROM m CROSS JOIN g WINDOW w AS (PARTITION BY criterion, change)),
e AS (SELECT *, max(a) OVER w AS pa, min(a) OVER w AS wa, min(b) OVER w AS pb, max(b) OVER w AS wb FROM v WINDOW w AS (PARTITION BY criterion, change)),
d AS (SELECT criterion, change, k, sqrt((a - pa) ** 2 + (b - pb) ** 2) AS p, sqrt((a - wa) ** 2 + (b - wb) ** 2) AS w FROM e),
r AS (SELECT criterion, change, k, row_number() OVER (PARTITION BY criterion, change ORDER BY round(w / (p + w), 6) DESC, k) AS r FROM d)
SELECT y.criterion, y.change, round(corr(x.r, y.r), 6) AS spearman, arg_min(x.k, x.r) <> arg_min(y.k, y.r) AS top_changed
FROM r x JOIN r y USING (k) WHERE x.criterion = '' AND y.criterion <> '' GROUP BY y.criterion, y.change""")
def a43_topsis_sensitivity(t):
    m = t.supplier.select(F.col("s_suppkey").alias("run_id"), F.col("s_acctbal").cast("double").alias("a"), (F.col("s_suppkey") * 37 % 100 + 1).cast("double").alias("b"))
    return rules.topsis_sensitivity(m, "run_id", {"a": (0.6, True), "b": (0.4, False)})


@query("SELECT model_name, arg_max(run_id, (frame_accuracy, -run_id)) AS best_run, max(frame_accuracy) AS best, max_by(frame_accuracy, run_id) AS final, round(max(frame_accuracy) - max_by(frame_accuracy, run_id), 6) AS lost FROM runs GROUP BY 1", "runs")
def a44_training_history(t):
    a = F.col("frame_accuracy")
    return t.runs.groupBy("model_name").agg(F.max_by("run_id", F.struct(a, -F.col("run_id"))).alias("best_run"), F.max(a).alias("best"), F.max_by(a, "run_id").alias("final"), _R6(F.max(a) - F.max_by(a, "run_id")).alias("lost"))


@query("SELECT sequence_id, track_id, round(avg((event_id % 13 <> 0)::INT), 6) AS loaded, bool_and(event_id % 13 <> 0) AS complete, count(DISTINCT (x2 - x1, y2 - y1)) AS sizes FROM frames GROUP BY ALL", "frames")
def a46_completeness(t):
    ok = F.col("event_id") % 13 != 0
    return t.frames.groupBy(*KEY).agg(_R6(F.avg(ok.cast("double"))).alias("loaded"), F.bool_and(ok).alias("complete"), F.count_distinct(F.struct(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("sizes"))


@query("SELECT l.l_orderkey AS crop, l.l_linenumber AS line, CASE WHEN o.o_orderkey IS NULL THEN 'no_label_file' WHEN o.o_custkey % 10 = 0 THEN 'no_image' WHEN l.l_linenumber > 4 THEN 'line_out_of_range' ELSE 'ok' END AS status FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) o ON l.l_orderkey = o.o_orderkey")
def j04_crops_to_detections(t):
    files = t.orders.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("crop"), F.lit(True).alias("file"), (F.col("o_custkey") % 10 != 0).alias("image"))
    crops = t.lineitem.select(F.col("l_orderkey").alias("crop"), F.col("l_linenumber").alias("line"))
    status = F.when(F.col("file").isNull(), "no_label_file").when(~F.col("image"), "no_image").when(F.col("line") > 4, "line_out_of_range").otherwise("ok")
    return crops.join(files, "crop", "left").select("crop", "line", status.alias("status"))


@query("SELECT o_orderkey AS a, event_id AS b FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) JOIN (SELECT *, row_number() OVER (ORDER BY event_id) AS k FROM events) USING (k)")
def j05_positional_zip(t):
    """Rows of two tables paired by place."""
    placed = lambda df, c, name: sampling.numbered(df.select(F.col(c).alias(name)), name, "k")
    return placed(t.orders, "o_orderkey", "a").join(placed(t.events, "event_id", "b"), "k").select("a", "b")


_IOU = "greatest(least(d.x2, t.x2) - greatest(d.x1, t.x1), 0) * greatest(least(d.y2, t.y2) - greatest(d.y1, t.y1), 0)"


@query(f"WITH f AS (SELECT split_part(sequence_id, '/', 1) AS rec, * FROM frames), t AS (SELECT rec, pos, event_id AS trk_id, x1 + event_id % 9 AS x1, y1 + event_id % 5 AS y1, x2 + event_id % 9 AS x2, y2 + event_id % 5 AS y2 FROM f), p AS (SELECT d.rec, d.pos, d.event_id AS det_id, trk_id, {_IOU} AS i, (d.x2 - d.x1) * (d.y2 - d.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS s FROM f d JOIN t USING (rec, pos)), q AS (SELECT *, i::DOUBLE / (s - i) AS iou FROM p) SELECT rec, pos, det_id, trk_id, round(iou, 6) AS iou FROM q WHERE iou >= 0.8 QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY iou DESC, trk_id) = 1", "frames")
def j06_best_iou_match(t):
    """Inside a frame (recording and place in it), the boxes of all its tracks."""
    e, by = F.col("event_id"), [keys.recording_of(F.col("sequence_id")).alias("rec"), "pos"]
    trk = t.frames.select(*by, e.alias("trk_id"), *[(F.col(c) + e % k).alias(c) for c, k in (("x1", 9), ("y1", 5), ("x2", 9), ("y2", 5))])
    dets = t.frames.select(*by, e.alias("det_id"), "x1", "y1", "x2", "y2")
    return tracks.best_match(dets, trk, ["rec", "pos"]).withColumn("iou", _R6("iou"))


@query("WITH a AS (SELECT event_id AS anchor, sequence_id, track_id, frame_id AS af FROM frames WHERE event_id IN (SELECT event_id FROM events WHERE event_type = 'signup')), w AS (SELECT a.anchor, f.event_id, row_number() OVER (PARTITION BY a.anchor ORDER BY f.frame_id) - 1 AS k FROM a JOIN frames f ON f.sequence_id = a.sequence_id AND f.track_id = a.track_id AND f.frame_id BETWEEN greatest(0, af - 10) AND af + 10) SELECT anchor, event_id FROM w WHERE k % 2 = 0", "frames")
def j07_anchor_windows(t):
    a = t.frames.join(t.events.where("event_type = 'signup'").select("event_id"), "event_id", "left_semi").select(F.col("event_id").alias("anchor"), *KEY, F.col("frame_id").alias("af"))
    f, cell = F.col("frame_id"), lambda c: F.floor(c / 21)
    a = a.withColumn("low", F.greatest(F.lit(0), F.col("af") - 10)).withColumn("high", F.col("af") + 10)
    a = a.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))  # two at most
    near = t.frames.withColumn("cell", cell(f)).join(a, [*KEY, "cell"]).where(f.between(F.col("low"), F.col("high")))
    return series.stride_sample(near, 2, by=("anchor",)).select("anchor", "event_id")


@query("SELECT event_id FROM frames WHERE track_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 2500)", "frames")
def j08_id_set_semi(t):
    ids = t.supplier.where("s_acctbal > 2500").select(F.col("s_suppkey").alias("track_id"))
    return t.frames.join(ids, "track_id", "left_semi").select("event_id")


@query("SELECT event_id FROM frames WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')", "frames")
def j09_deleted_anti(t):
    return t.frames.join(t.events.where("event_type = 'click'").select("event_id"), "event_id", "left_anti").select("event_id")


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'hazard' ELSE true_label END AS label, event_id % 6 = 0 AS was_corrected FROM frames", "frames")
def j10_correction_overlay(t):
    c = t.frames.where("event_id % 6 = 0").select("event_id", F.lit("hazard").alias("new_label"))
    return edits.overlay(t.frames.select("event_id", F.col("true_label").alias("label")), c, ["event_id"])


@query("WITH x AS (SELECT event_id, frame_id, CASE WHEN event_id % 6 = 0 THEN 'hazard' ELSE true_label END AS label, CASE WHEN track_id % 10 = 1 THEN 'merged' ELSE sequence_id END AS s, track_id FROM frames WHERE event_id % 11 <> 0) SELECT event_id, label, CASE WHEN track_id % 10 = 2 AND frame_id >= 40 THEN s || '_b' ELSE s END AS sequence_id FROM x", "frames")
def j11_edit_order(t):
    f = t.frames.select("event_id", "crop_path", "sequence_id", "track_id", "frame_id", F.col("true_label").alias("label"))
    ids = f.select("sequence_id", "track_id").distinct()
    merges = ids.where("track_id % 10 = 1").select("sequence_id", F.lit("merged").alias("into"))
    splits = ids.where("track_id % 10 = 2").select("sequence_id", F.lit(40).alias("at"), F.concat("sequence_id", F.lit("_b")).alias("new_id"))
    fixes = f.where("event_id % 6 = 0").select("crop_path", F.lit("hazard").alias("new_label"))
    return edits.apply_edits(f, f.where("event_id % 11 = 0"), fixes, merges, splits).select("event_id", "label", "sequence_id")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN true_label WHEN event_id % 3 = 0 THEN 'redo' ELSE '' END AS label FROM frames WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, 'redo' FROM frames WHERE event_id % 5 = 0 AND event_id % 3 = 0", "frames")
def j12_annotation_upsert(t):
    f = t.frames.select("event_id", F.col("true_label").alias("label"))
    return edits.upsert(f.where("event_id % 5 <> 0"), f.where("event_id % 3 = 0").withColumn("label", F.lit("redo")), "event_id", "label", F.col("event_id") % 2 == 0)


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j13_category_names(t):
    # nation and region are fixed lists of a few rows.
    n = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.supplier.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("SELECT f.event_id, e.event_id IS NOT NULL AS hit FROM frames f LEFT JOIN (SELECT event_id FROM events WHERE event_type = 'click') e USING (event_id)", "frames")
def j14_positive_flag(t):
    pos = t.events.where("event_type = 'click'").select("event_id", F.lit(True).alias("hit"))
    return t.frames.select("event_id").join(pos, "event_id", "left").na.fill(False, ["hit"])


@query("SELECT sequence_id, split_part(sequence_id, '/', 2)[:8] AS camera, n FROM (SELECT sequence_id, count(*) AS n FROM frames GROUP BY 1 HAVING count(*) >= 60) JOIN (SELECT DISTINCT sequence_id FROM frames WHERE true_label = 'hazard') USING (sequence_id)", "frames")
def j15_feature_index(t):
    f = t.frames.withColumn("camera", F.substring(keys.camera_of(F.col("sequence_id")), 1, 8))
    index = f.groupBy("sequence_id", "camera").agg(F.count("*").alias("n")).where("n >= 60")
    return index.join(f.where("true_label = 'hazard'").select("sequence_id", "camera").distinct(), ["sequence_id", "camera"])


@query("WITH b AS (SELECT sequence_id, track_id, pos // 8 AS w, min_by(true_label, pos) AS pred, list(DISTINCT true_label) AS seen FROM frames GROUP BY ALL), m AS (SELECT sequence_id, track_id, pos // 8 AS w, true_label, count(*) AS n FROM frames GROUP BY ALL), t AS (SELECT sequence_id, track_id, w, true_label AS truth FROM m QUALIFY row_number() OVER (PARTITION BY sequence_id, track_id, w ORDER BY n DESC, true_label) = 1) SELECT sequence_id, track_id, w::BIGINT AS w, pred, truth, list_contains(seen, pred) AS correct FROM b JOIN t USING (sequence_id, track_id, w)", "frames")
def j16_window_results(t):
    f = t.frames.withColumn("w", F.floor(F.col("pos") / 8))
    return f.groupBy(*KEY, "w").agg(F.min_by("true_label", "pos").alias("pred"), F.mode("true_label", True).alias("truth"), F.collect_set("true_label").alias("seen")).withColumn("correct", F.array_contains("seen", F.col("pred"))).drop("seen")


@query("SELECT a.model_name AS a, b.model_name AS b, count(*) AS n FROM labelled a JOIN labelled b USING (sequence_id, frame_id) WHERE a.model_name < b.model_name AND a.label <> b.label GROUP BY ALL", "labelled")
def j18_model_pairs(t):
    from .fusion import labelled

    p = labelled(t)
    side = lambda s: p.select("sequence_id", "frame_id", F.col("model_name").alias(s), F.col("label").alias(f"label_{s}"))
    return side("a").join(side("b"), ["sequence_id", "frame_id"]).where("a < b and label_a <> label_b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("SELECT run_id, model_name, frame_accuracy FROM runs ORDER BY frame_accuracy DESC, run_id LIMIT 5", "runs")
def k01_top_models(t):
    return t.runs.select("run_id", "model_name", "frame_accuracy").orderBy(F.desc("frame_accuracy"), "run_id").limit(5)


@query("SELECT run_id, dense_rank() OVER (ORDER BY best DESC, model_name) AS model_place, row_number() OVER (PARTITION BY model_name ORDER BY frame_accuracy DESC, run_ts, run_id) AS run_place FROM (SELECT *, max(frame_accuracy) OVER (PARTITION BY model_name) AS best FROM runs)", "runs")
def k03_leaderboard(t):
    # Models are ranked on one row each, runs inside their model.
    models = t.runs.groupBy("model_name").agg(F.max("frame_accuracy").alias("best"))
    models = models.withColumn("model_place", F.row_number().over(Window.orderBy(F.desc("best"), "model_name")).cast("long"))
    place = F.row_number().over(Window.partitionBy("model_name").orderBy(F.desc("frame_accuracy"), "run_ts", "run_id")).cast("long")
    return t.runs.withColumn("run_place", place).join(models, "model_name").select("run_id", "model_place", "run_place")


@query("SELECT sequence_id, track_id, count(*) AS n FROM frames GROUP BY ALL ORDER BY n DESC, sequence_id LIMIT 10", "frames")
def k04_longest_tracks(t):
    return lengths(t).orderBy(F.desc("n"), "sequence_id").limit(10)


@query("WITH s AS (SELECT sequence_id, bool_or(true_label = 'hazard' AND track_id % 5 = 0) AS signal, count(*) AS n FROM frames GROUP BY 1) SELECT sequence_id, signal FROM s QUALIFY signal OR row_number() OVER (ORDER BY signal DESC, n DESC, sequence_id) <= 40", "frames")
def k05_two_tier_selection(t):
    s = t.frames.groupBy("sequence_id").agg(F.bool_or((F.col("true_label") == "hazard") & (F.col("track_id") % 5 == 0)).alias("signal"), F.count("*").alias("n"))
    top = s.orderBy(F.desc("signal"), F.desc("n"), "sequence_id").limit(40)
    return s.where("signal").select("sequence_id", "signal").unionByName(top.where("not signal").select("sequence_id", "signal"))


@query("WITH n AS (SELECT sequence_id, count(*) AS n FROM frames GROUP BY 1 ORDER BY n DESC, sequence_id LIMIT 15) SELECT event_id, n.n AS length FROM frames JOIN n USING (sequence_id)", "frames")
def k06_longest_sequences(t):
    n = t.frames.groupBy("sequence_id").agg(F.count("*").alias("length")).orderBy(F.desc("length"), "sequence_id").limit(15)
    return t.frames.join(n, "sequence_id").select("event_id", "length")


@query("SELECT sequence_id FROM (SELECT DISTINCT sequence_id FROM frames) WHERE sequence_id < (SELECT min(sequence_id) FROM frames WHERE track_id % 9 = 4)", "frames")
def k07_prefix_before_cutoff(t):
    cut = t.frames.where("track_id % 9 = 4").agg(F.min("sequence_id").alias("cut"))
    return t.frames.select("sequence_id").distinct().join(F.broadcast(cut), F.col("sequence_id") < F.col("cut")).select("sequence_id")


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 7919 + 42) % 1000003, doc_id) <= floor(count(*) OVER (PARTITION BY quality) * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM labels")
def r01_stratified_split(t):
    return sampling.stratified_split(t.labels, 0.2, "quality", "doc_id").select("doc_id", "split")


@query("WITH k AS (SELECT split_part(sequence_id, '/', 1) AS rec, track_id % 4 AS cam, min(track_id) AS k FROM frames GROUP BY ALL), r AS (SELECT rec, cam, row_number() OVER (ORDER BY (k * 7919 + 42) % 1000003, cam, rec) AS r, count(*) OVER () AS n FROM k) SELECT event_id, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM frames JOIN r ON split_part(sequence_id, '/', 1) = rec AND track_id % 4 = cam", "frames")
def r02_recording_split(t):
    f = t.frames.withColumn("rec", keys.recording_of(F.col("sequence_id"))).withColumn("cam", F.col("track_id") % 4)
    return sampling.recording_split(f, ["cam", "rec"], F.col("track_id")).select("event_id", "split")


@query("WITH s AS (SELECT sequence_id, track_id, min_by(true_label, pos) AS label FROM frames GROUP BY ALL) SELECT sequence_id, label FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY (track_id * 7919 + 42) % 1000003, track_id) <= 5", "frames")
def r04_per_label(t):
    s = t.frames.groupBy(*KEY).agg(F.min_by("true_label", "pos").alias("label"))
    return sampling.take(s, ["label"], 5, "track_id").select("sequence_id", "label")


@query("WITH s AS (SELECT sequence_id, track_id, min_by(true_label, pos) AS label, count(*) AS n, split_part(sequence_id, '/', 1) AS v, track_id % 4 AS c, (track_id * 7919 + 42) % 1000003 AS h FROM frames GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY h, track_id) AS a, row_number() OVER (PARTITION BY c ORDER BY h, track_id) AS b, row_number() OVER (PARTITION BY label ORDER BY h, track_id) AS d FROM s) SELECT sequence_id, (CASE WHEN a = 1 THEN 3 ELSE 0 END + CASE WHEN b = 1 THEN 2 ELSE 0 END + CASE d WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 0 END + CASE WHEN n BETWEEN 20 AND 65 THEN 1 ELSE 0 END)::INT AS score FROM r ORDER BY score DESC, track_id LIMIT 20", "frames")
def r05_diverse_selection(t):
    s = t.frames.groupBy(*KEY).agg(F.min_by("true_label", "pos").alias("label"), F.count("*").alias("n")).withColumn("v", keys.recording_of(F.col("sequence_id"))).withColumn("c", F.col("track_id") % 4)
    return sampling.diverse(s, 20, "v", "c", "label", F.col("n"), "track_id", (20, 65)).select("sequence_id", "score")


@query("SELECT doc_id, quality, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY quality, toxic ORDER BY (doc_id * 7919 + 42) % 1000003, doc_id) <= 10 + quality * 5")
def r06_quota_sample(t):
    quotas = t.spark.createDataFrame([(q, x, 10 + q * 5) for q in (0, 1) for x in (0, 1)], "quality int, toxic int, quota int")
    return sampling.quota_sample(t.labels, quotas, ["quality", "toxic"], "doc_id").select("doc_id", "quality", "toxic")


@query("SELECT event_id FROM events ORDER BY (event_id * 7919 + 42) % 1000003, event_id LIMIT 100")
def r07_random_sample(t):
    return t.events.orderBy(sampling.order_hash("event_id"), "event_id").limit(100).select("event_id")


@query(f"""WITH w AS (SELECT event_id, true_label, CASE WHEN true_label = 'none' THEN 1 ELSE 4 END::DOUBLE AS w, (event_id * {sampling.MULT} + 42) % {sampling.PRIME} % {sampling.PARTS} AS b FROM frames),
c AS (SELECT *, sum(w) OVER (PARTITION BY b ORDER BY event_id) AS hi FROM w), s AS (SELECT b, max(hi) AS s FROM c GROUP BY b), p AS (SELECT b, sum(s) OVER (ORDER BY b) AS shi, sum(s) OVER (ORDER BY b) - s AS slo FROM s),
d AS (SELECT range AS draw, ((range * range % {sampling.DRAWS} * {sampling.SQUARE} + range * {sampling.LINEAR} + 42) % {sampling.DRAWS} + 0.5::DOUBLE) / {sampling.DRAWS}::DOUBLE * (SELECT max(shi) FROM p) AS y FROM range((SELECT count(*) FROM frames)))
SELECT draw, event_id, true_label FROM d JOIN p ON y >= slo AND y < shi JOIN c ON c.b = p.b AND y - slo >= hi - w AND y - slo < hi""", "frames")
def r08_weighted_resample(t):
    """Seeded draws with replacement."""
    f = t.frames.withColumn("w", F.when(F.col("true_label") == "none", 1.0).otherwise(4.0))
    return sampling.weighted_resample(f, f.count(), F.col("w"), "event_id").select("draw", "event_id", "true_label")


@query("WITH m AS (SELECT vec_id, embedding AS e, coalesce(lead(embedding) OVER w, first_value(embedding) OVER w) AS p FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY (vec_id * 7919 + 42) % 1000003, vec_id)) SELECT vec_id, len(e)::INT AS size, round(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i]::DOUBLE * 0.7::DOUBLE + p[i]::DOUBLE * (1 - 0.7::DOUBLE))), 3) AS total FROM m")
def r09_mixed_windows(t):
    mixed = sampling.mix_partners(t.embeddings, ["label"], "vec_id", "embedding")
    return mixed.select("vec_id", F.size("mixed").alias("size"), F.round(F.aggregate("mixed", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("SELECT count(DISTINCT crop_path) AS crops, count(DISTINCT sequence_id) AS sequences FROM frames", "frames")
def s19_download_lists(t):
    return t.frames.agg(F.count_distinct("crop_path").alias("crops"), F.count_distinct("sequence_id").alias("sequences"))


@query("SELECT sequence_id, track_id, '[' || string_agg(true_code, ',' ORDER BY pos) || ']' AS frame_labels, mode_label AS clip_label FROM frames JOIN (SELECT sequence_id, true_label AS mode_label FROM (SELECT sequence_id, true_label, count(*) AS n, min(frame_id) AS f FROM frames GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY n DESC, f) = 1) USING (sequence_id) GROUP BY ALL", "frames")
def d13_training_tables(t):
    f = t.frames.groupBy(*KEY).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "true_code"))), lambda x: x["true_code"])).alias("frame_labels"))
    return f.join(fusion.sequence_label(t.frames, "true_label").select(*KEY, F.col("label").alias("clip_label")), KEY)


@query("WITH sl AS (SELECT sequence_id, true_code, count(*) AS v, min(frame_id) AS f FROM frames GROUP BY ALL), st AS (SELECT sequence_id, true_code AS code FROM sl QUALIFY row_number() OVER (PARTITION BY sequence_id ORDER BY v DESC, f) = 1) SELECT crop_path || ' ' || code AS line FROM frames JOIN st USING (sequence_id)", "frames")
def d13_path_list(t):
    """A line for each crop: its path and its clip's code."""
    clip = fusion.sequence_label(t.frames, "true_label").select(*KEY, labels.label_code(F.col("label")).alias("code"))
    return t.frames.join(clip, KEY).select(F.concat_ws(" ", "crop_path", "code").alias("line"))


@query(f"""WITH s AS (SELECT sequence_id, track_id, pos // 8 AS b, row_number() OVER (PARTITION BY sequence_id, pos // 8 ORDER BY pos) - 1 AS i, intensity AS v, intensity * (event_id % 3) AS w FROM frames WHERE pos % 2 = 0),
ser AS (SELECT sequence_id || '#' || b AS g, i, v FROM s), {_periodic('ser')},
k AS (SELECT sequence_id, track_id, b, count(*) AS n, stddev_pop(v) AS l, stddev_pop(w) AS r, avg(v) AS ml FROM s GROUP BY ALL),
y AS (SELECT k.*, CASE WHEN n < 4 THEN 'error' WHEN NOT (is_periodic OR (ml > 0 AND l > ml * 0.58::DOUBLE)) OR greatest(l, r) < 20 THEN 'none' WHEN least(l, r) / greatest(l, r) > 0.7::DOUBLE THEN 'hazard' WHEN l > r THEN 'left' ELSE 'right' END AS label FROM k JOIN per ON g = sequence_id || '#' || b)
SELECT sequence_id, track_id, coalesce(min_by(label, b) FILTER (label <> 'error'), 'none') AS track_label FROM y GROUP BY ALL""", "frames")
def d14_auto_labels(t):
    """Sample, block, rule on each block's series, back-label, along one partitioning by track. A block of under
    four frames is too short to judge."""
    s = series.stride_sample(t.frames, 2).withColumn("b", F.floor(F.col("pos") / 8))
    k = s.groupBy(*KEY, "b").agg(F.array_sort(F.collect_list(F.struct("pos", "intensity", "event_id"))).alias("s"))
    k = k.select(*KEY, "b", F.transform("s", lambda x: x["intensity"]).alias("left"), F.transform("s", lambda x: x["intensity"] * (x["event_id"] % 3)).alias("right"))
    k = rules.classify(k.select("*", *rules.activity(F.col("left"), F.col("right"))), "left", 20.0, 0.7, variance=0.58)
    k = k.withColumn("label", F.when(F.size("left") < 4, "error").otherwise(F.col("label"))).select(*KEY, "b", "label")
    return series.back_label(k, "b").select(*KEY, "track_label").distinct()


_BOX = "{'id': %s, 'x1': d.x1, 'y1': d.y1, 'x2': d.x2, 'y2': d.y2, 'f': d.frame_id}"
_SHARED = "greatest(least(o.x2, d.x2) - greatest(o.x1, d.x1), 0) * greatest(least(o.y2, d.y2) - greatest(o.y1, d.y1), 0)"


@query(f"""WITH RECURSIVE d AS (SELECT sequence_id AS sequence, pos AS frame_id, event_id AS det_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY sequence_id ORDER BY pos) AS k FROM frames WHERE score >= 0.5),
s AS (SELECT sequence, k, frame_id, det_id, 0::BIGINT AS track_id, 1::BIGINT AS next, [{_BOX % '0::BIGINT'}] AS open FROM d WHERE k = 1
  UNION ALL SELECT sequence, k, frame_id, det_id, coalesce(id, next), next + (id IS NULL)::BIGINT, list_append(list_filter(near, lambda o: o.id IS DISTINCT FROM id), {_BOX.replace('d.', '') % 'coalesce(id, next)'})
  FROM (SELECT *, list_sort(list_filter(list_transform(near, lambda o: {{'o': -({_SHARED.replace('d.', '')})::DOUBLE / ((o.x2 - o.x1) * (o.y2 - o.y1) + (x2 - x1) * (y2 - y1) - {_SHARED.replace('d.', '')}), 'id': o.id}}), lambda p: p.o <= -0.3::DOUBLE))[1].id AS id
    FROM (SELECT d.*, s.next, list_filter(s.open, lambda o: d.frame_id - o.f <= 5) AS near FROM s JOIN d ON d.sequence = s.sequence AND d.k = s.k + 1)))
SELECT sequence, frame_id, det_id, track_id FROM s""", "frames")
def d08_linked_boxes(t):
    """Tracker over each sequence's detections, one in a frame; tests hold frames of many against brute force."""
    d = t.frames.select(F.col("sequence_id").alias("sequence"), F.col("pos").alias("frame_id"), F.col("event_id").alias("det_id"), "score", "x1", "y1", "x2", "y2")
    return tracks.link_boxes(d, confirm=1)


@query("SELECT sequence_id, count(*) AS n FROM frames WHERE split_part(sequence_id, '/', 1) IN ('rec1', 'rec2') GROUP BY 1", "frames")
def a01_recording_filter(t):
    return t.frames.where(keys.recording_of(F.col("sequence_id")).isin("rec1", "rec2")).groupBy("sequence_id").agg(F.count("*").alias("n"))


