"""Queries for label fusion, metrics and disagreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import harmonize_label
from ..operators import fusion, metrics, series
from .base import Tables, query


def labelled(t: Tables) -> DataFrame:
    return t.predictions.withColumn("label", harmonize_label(F.col("raw_label"))).drop("raw_label", "code")


def truth(t: Tables) -> DataFrame:
    return t.frames.select("sequence_id", "frame_id", "true_label")


def model(t: Tables, name: str) -> DataFrame:
    return labelled(t).where(F.col("model_name") == name)


_VOTE = """v AS (SELECT sequence_id, frame_id, label, count(*) AS n, avg(confidence) AS c, min(pred_ord) AS o FROM labelled GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY sequence_id, frame_id)::BIGINT AS total FROM v),
vote AS (SELECT sequence_id, frame_id, label, c AS confidence, n AS agreement_count, total AS total_models FROM w
  QUALIFY row_number() OVER (PARTITION BY sequence_id, frame_id ORDER BY (n * 2 > total) DESC, c DESC, o) = 1)"""
_SCORED = "scored AS (SELECT p.*, f.true_label FROM labelled p JOIN frames f USING (sequence_id, frame_id))"


def _metrics_sql(source: str, by: str = "") -> str:
    """SQL of frame metrics over a relation with true_label and label."""
    k = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    keys = f"(SELECT DISTINCT {by} FROM {source})" if by else "(SELECT 1)"
    join = " AND ".join(f"s.{c} = k.{c}" for c in by.split(", ")) if by else "true"
    pick = "".join(f"k.{c}, " for c in by.split(", ")) if by else ""
    return f"""c AS (SELECT {pick}d.label, count(*) FILTER (s.true_label = d.label AND s.label = d.label) AS tp, count(*) FILTER (s.true_label <> d.label AND s.label = d.label) AS fp,
   count(*) FILTER (s.true_label = d.label AND s.label <> d.label) AS fn FROM {keys} k CROSS JOIN domain d LEFT JOIN {source} s ON {join} GROUP BY ALL),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS q FROM c),
m AS (SELECT {k}label, tp + fn AS support, tp, fp, fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM r
 UNION ALL SELECT {k}'macro', count(*), count(*) FILTER (true_label = label), count(*) FILTER (true_label <> label), count(*) FILTER (true_label <> label), NULL,
   round(avg((true_label = label)::INT), 6), NULL FROM {source} {g}),
a AS (SELECT {k}round(avg(CASE WHEN tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS f FROM r {g}),
metrics AS (SELECT m.* REPLACE (CASE WHEN m.label = 'macro' THEN a.f ELSE m.f1 END AS f1) FROM m JOIN a ON {' AND '.join(f'm.{c} = a.{c}' for c in by.split(', ')) if by else 'true'})"""


@query(f"WITH {_VOTE}, ev AS (SELECT v.label, f.true_label FROM vote v JOIN frames f USING (sequence_id, frame_id)), {_metrics_sql('ev')} SELECT * FROM metrics", "labelled", "domain")
def flagship_vote_metrics(t):
    """Three models' labels, harmonised, voted, joined with the truth and scored."""
    return metrics.frame_metrics(fusion.with_truth(fusion.majority_vote(labelled(t)), truth(t)))


@query("SELECT sequence_id, frame_id, model_name, label, true_label FROM labelled JOIN frames USING (sequence_id, frame_id)", "labelled")
def j01_truth_inner(t):
    return fusion.with_truth(labelled(t), truth(t)).select("sequence_id", "frame_id", "model_name", "label", "true_label")


@query("SELECT p.sequence_id, p.frame_id, model_name, label, f.true_label FROM labelled p LEFT JOIN (SELECT * FROM frames WHERE true_label <> 'none') f ON p.sequence_id = f.sequence_id AND p.frame_id = f.frame_id", "labelled")
def j01_truth_left(t):
    signals = t.frames.where("true_label <> 'none'").select("sequence_id", "frame_id", "true_label")
    return fusion.with_truth(labelled(t), signals, how="left").select("sequence_id", "frame_id", "model_name", "label", "true_label")


_AGREE = """both_ AS (SELECT coalesce(a.sequence_id, b.sequence_id) AS sequence_id, coalesce(a.frame_id, b.frame_id) AS frame_id, a.label AS label_a, a.confidence AS confidence_a, b.label AS label_b, b.confidence AS confidence_b,
  CASE WHEN b.label IS NULL THEN 'only_in_a' WHEN a.label IS NULL THEN 'only_in_b' WHEN a.label = b.label THEN 'agreed' ELSE 'disagreed' END AS status
  FROM (SELECT * FROM labelled WHERE model_name = 'model_a') a FULL JOIN (SELECT * FROM labelled WHERE model_name = 'model_b') b ON a.sequence_id = b.sequence_id AND a.frame_id = b.frame_id)"""


def agreed(t: Tables) -> DataFrame:
    return fusion.agreement(model(t, "model_a"), model(t, "model_b"))


@query(f"WITH {_AGREE} SELECT sequence_id, frame_id, label_a, label_b, status, CASE WHEN status = 'agreed' THEN label_a END AS label FROM both_", "labelled")
def j02_two_model_agreement(t):
    return agreed(t).select("sequence_id", "frame_id", "label_a", "label_b", "status", "label")


@query(f"WITH {_AGREE} SELECT count(*) FILTER (status IN ('agreed', 'disagreed')) AS common_frames, count(*) FILTER (status = 'agreed') AS agreed, count(*) FILTER (status = 'disagreed') AS disagreed, count(*) FILTER (status = 'only_in_a') AS only_in_a, count(*) FILTER (status = 'only_in_b') AS only_in_b, round(count(*) FILTER (status = 'agreed') / count(*) FILTER (status IN ('agreed', 'disagreed')), 6) AS agreement_rate FROM both_", "labelled")
def a10_agreement_report(t):
    return fusion.agreement_report(agreed(t))


@query(f"WITH {_AGREE} SELECT label_a || ' -> ' || label_b AS pair, count(*) AS n FROM both_ WHERE status = 'disagreed' GROUP BY 1 ORDER BY n DESC, pair LIMIT 10", "labelled")
def a11_disagreement_pairs(t):
    d = agreed(t).where("status = 'disagreed'").groupBy(F.concat("label_a", F.lit(" -> "), "label_b").alias("pair")).agg(F.count("*").alias("n"))
    return d.orderBy(F.desc("n"), "pair").limit(10)


@query(f"WITH {_AGREE}, n AS (SELECT label_a AS label, count(*) AS total, count(*) FILTER (status = 'agreed') AS agreed FROM both_ WHERE status IN ('agreed', 'disagreed') GROUP BY 1) SELECT label, coalesce(total, 0) AS total, coalesce(agreed, 0) AS agreed, round(coalesce(agreed / total, 0), 6) AS rate FROM domain LEFT JOIN n USING (label)", "labelled", "domain")
def a12_label_agreement(t):
    n = agreed(t).where("status in ('agreed', 'disagreed')").groupBy(F.col("label_a").alias("label")).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "agreed").alias("agreed"))
    grid = t.spark.createDataFrame([(x,) for x in ("none", "left", "right", "hazard")], "label string")
    return F.broadcast(grid).join(n, "label", "left").na.fill(0).withColumn("rate", F.round(F.coalesce(F.col("agreed") / F.nullif("total", F.lit(0)), F.lit(0.0)), 6))


@query(f"WITH {_AGREE} SELECT sequence_id, count(*) FILTER (status = 'agreed') AS agreed, count(*) FILTER (status = 'disagreed') AS disagreed, count(*) AS total, round(count(*) FILTER (status = 'agreed') / count(*), 4) AS rate FROM both_ WHERE status IN ('agreed', 'disagreed') GROUP BY 1", "labelled")
def a13_sequence_agreement(t):
    s = F.col("status")
    n = agreed(t).where(s.isin("agreed", "disagreed")).groupBy("sequence_id").agg(F.count_if(s == "agreed").alias("agreed"), F.count_if(s == "disagreed").alias("disagreed"), F.count("*").alias("total"))
    return n.withColumn("rate", F.round(F.col("agreed") / F.col("total"), 4))


@query("""WITH n AS (SELECT sequence_id, track_id, true_label, count(*) AS votes, min(frame_id) AS f FROM frames GROUP BY ALL)
SELECT sequence_id, track_id, true_label AS label, votes FROM n QUALIFY row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY votes DESC, f) = 1""", "frames")
def a03_sequence_label(t):
    return fusion.sequence_label(t.frames, "true_label")


@query(f"WITH {_VOTE} SELECT sequence_id, frame_id, label, round(confidence, 6) AS confidence, agreement_count, total_models FROM vote", "labelled")
def a04_majority_vote(t):
    return fusion.majority_vote(labelled(t)).withColumn("confidence", F.round("confidence", 6))


@query("""WITH n AS (SELECT sequence_id, frame_id, label, count(*) AS n FROM labelled GROUP BY ALL)
SELECT sequence_id, frame_id, string_agg(label || ':' || n, ',' ORDER BY label) AS distribution FROM n GROUP BY ALL""", "labelled")
def a05_vote_distribution(t):
    d = fusion.vote_distribution(labelled(t))
    e = F.array_sort(F.map_entries("distribution"))
    return d.select("sequence_id", "frame_id", F.array_join(F.transform(e, lambda x: F.concat(x["key"], F.lit(":"), x["value"])), ",").alias("distribution"))


@query(f"WITH {_SCORED}, {_metrics_sql('scored', 'model_name')} SELECT * FROM metrics", "labelled", "domain")
def a06_frame_metrics(t):
    return metrics.frame_metrics(fusion.with_truth(labelled(t), truth(t)), by=("model_name",))


@query("SELECT d.label AS true_label, count(*) FILTER (s.label = 'none') AS pred_none, count(*) FILTER (s.label = 'left') AS pred_left, count(*) FILTER (s.label = 'right') AS pred_right, count(*) FILTER (s.label = 'hazard') AS pred_hazard FROM domain d LEFT JOIN scored s ON s.true_label = d.label GROUP BY 1".join(["WITH " + _SCORED + " ", ""]), "labelled", "domain")
def a07_confusion(t):
    return metrics.confusion(fusion.with_truth(labelled(t), truth(t)))


@query(f"WITH {_SCORED} SELECT true_label, count(*) AS support, round(avg((label = true_label)::INT), 6) AS accuracy FROM scored WHERE event_id % 7 <> 0 GROUP BY 1", "labelled")
def a08_class_accuracy(t):
    rows = fusion.with_truth(labelled(t), truth(t)).withColumn("label", F.when(F.col("event_id") % 7 == 0, "error").otherwise(F.col("label")))
    return metrics.class_accuracy(rows)


@query(f"""WITH {_VOTE}, every AS (SELECT model_name, sequence_id, frame_id, label FROM labelled UNION ALL SELECT 'ensemble', sequence_id, frame_id, label FROM vote),
ev AS (SELECT e.model_name, e.label, f.true_label FROM every e JOIN frames f USING (sequence_id, frame_id)), {_metrics_sql('ev', 'model_name')}
SELECT model_name, recall AS accuracy, f1 AS macro_f1, support FROM metrics WHERE label = 'macro'""", "labelled", "domain")
def a09_model_comparison(t):
    p = labelled(t)
    every = p.select("model_name", "sequence_id", "frame_id", "label").unionByName(fusion.majority_vote(p).select(F.lit("ensemble").alias("model_name"), "sequence_id", "frame_id", "label"))
    m = metrics.frame_metrics(fusion.with_truth(every, truth(t)), by=("model_name",))
    return m.where("label = 'macro'").select("model_name", F.col("recall").alias("accuracy"), F.col("f1").alias("macro_f1"), "support")


_ENTROPY = """n AS (SELECT sequence_id, frame_id, label, count(*) AS n FROM labelled GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY sequence_id, frame_id) AS t FROM n),
e AS (SELECT sequence_id, frame_id, sum(n)::BIGINT AS models, round(abs(sum(-(n / t) * ln(n / t))), 6) AS entropy, string_agg(label || ':' || n, ',' ORDER BY label) AS pattern, count(*) = 1 AS unanimous FROM m GROUP BY ALL)"""


@query(f"WITH {_ENTROPY} SELECT * FROM e", "labelled")
def a14_vote_entropy(t):
    return metrics.entropy(labelled(t)).withColumn("entropy", F.abs("entropy"))


@query(f"WITH {_ENTROPY} SELECT count(*) AS total, count(*) FILTER (unanimous) AS unanimous, count(*) FILTER (entropy > 0.5) AS high, round(avg(entropy), 6) AS mean, round(stddev_pop(entropy), 6) AS std, max(entropy) AS max, min(entropy) AS min FROM e", "labelled")
def a14_entropy_summary(t):
    return metrics.entropy_summary(metrics.entropy(labelled(t)).withColumn("entropy", F.abs("entropy")))


@query(f"WITH {_ENTROPY}, p AS (SELECT sequence_id, frame_id, string_agg(model_name || '=' || label, ',' ORDER BY model_name) AS votes FROM labelled GROUP BY ALL) SELECT e.sequence_id, e.frame_id, entropy, votes, true_label FROM e JOIN p USING (sequence_id, frame_id) LEFT JOIN frames USING (sequence_id, frame_id) WHERE entropy >= 0.6", "labelled")
def a15_high_entropy_frames(t):
    p = labelled(t)
    votes = p.groupBy("sequence_id", "frame_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("model_name", F.lit("="), "label"))), ",").alias("votes"))
    e = metrics.entropy(p).where("entropy >= 0.6").join(votes, ["sequence_id", "frame_id"])
    return fusion.with_truth(e, truth(t), how="left").select("sequence_id", "frame_id", "entropy", "votes", "true_label")


@query(f"WITH {_ENTROPY}, x AS (SELECT pattern, true_label, entropy, sequence_id || '@' || lpad(frame_id::VARCHAR, 6, '0') AS f FROM e JOIN frames USING (sequence_id, frame_id)) SELECT pattern, true_label, count(*) AS n, round(avg(entropy), 6) AS mean_entropy, array_to_string(list_slice(list_sort(list(f)), 1, 3), ',') AS examples FROM x GROUP BY 1, 2", "labelled")
def a16_pattern_categories(t):
    e = fusion.with_truth(metrics.entropy(labelled(t)).withColumn("entropy", F.abs("entropy")), truth(t))
    f = F.concat("sequence_id", F.lit("@"), F.lpad(F.col("frame_id").cast("string"), 6, "0"))
    key = ["pattern", "true_label"]
    n = e.groupBy(*key).agg(F.count("*").alias("n"), F.round(F.avg("entropy"), 6).alias("mean_entropy"))
    # The three smallest of each group: Spark cuts to three per task before the shuffle.
    first = e.select(*key, f.alias("f")).withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("f"))).where("r <= 3")
    return n.join(first.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("f")), ",").alias("examples")), key)


@query(f"WITH {_SCORED} SELECT model_name, count(*) AS total, count(*) FILTER (label = true_label) AS correct, count(*) FILTER (label <> 'none' AND true_label = 'none') AS false_positives, count(*) FILTER (label = 'none' AND true_label <> 'none') AS false_negatives, count(*) FILTER (label <> 'none' AND true_label <> 'none' AND label <> true_label) AS confusions, round(avg((label = true_label)::INT), 6) AS accuracy, round(avg((label = true_label)::INT), 6) AS accuracy_on_truth FROM scored GROUP BY 1", "labelled")
def a17_error_profile(t):
    return metrics.error_profile(fusion.with_truth(labelled(t), truth(t)))


@query(f"""WITH {_SCORED}, w AS (SELECT DISTINCT sequence_id, frame_id, model_name AS m FROM scored WHERE (label = 'none') <> (true_label = 'none')), s AS (SELECT m, count(*) AS n FROM w GROUP BY 1),
p AS (SELECT a.m AS a, b.m AS b, count(*) AS shared FROM w a JOIN w b USING (sequence_id, frame_id) WHERE a.m < b.m GROUP BY 1, 2)
SELECT a, b, shared, round(shared::DOUBLE / (x.n + y.n - shared), 6) AS jaccard FROM p JOIN s x ON x.m = a JOIN s y ON y.m = b""", "labelled")
def a18_error_overlap(t):
    return metrics.error_overlap(fusion.with_truth(labelled(t), truth(t)))


@query("SELECT model_name, label, count(*) AS n, round(avg(confidence), 6) AS mean, round(stddev_pop(confidence), 6) AS std, min(confidence) AS low, max(confidence) AS high FROM labelled GROUP BY 1, 2", "labelled")
def a19_prediction_set(t):
    c = F.col("confidence")
    return labelled(t).groupBy("model_name", "label").agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("std"), F.min(c).alias("low"), F.max(c).alias("high"))


@query("SELECT m.model_name, count(*) AS missing FROM frames f CROSS JOIN (SELECT DISTINCT model_name FROM labelled) m LEFT JOIN labelled p ON p.sequence_id = f.sequence_id AND p.frame_id = f.frame_id AND p.model_name = m.model_name WHERE p.label IS NULL GROUP BY 1", "labelled")
def a19_missing_frames(t):
    p = labelled(t)
    grid = truth(t).select("sequence_id", "frame_id").crossJoin(F.broadcast(p.select("model_name").distinct()))
    return grid.join(p, ["sequence_id", "frame_id", "model_name"], "left_anti").groupBy("model_name").agg(F.count("*").alias("missing"))


@query("SELECT round(avg((a.label = b.label)::INT), 6) AS agreement, count(*) AS n FROM labelled a JOIN labelled b ON a.sequence_id = b.sequence_id AND a.frame_id = b.frame_id AND a.model_name = 'model_a' AND b.model_name = 'model_c'", "labelled")
def a45_labeller_agreement(t):
    b = model(t, "model_c").select("sequence_id", "frame_id", F.col("label").alias("other"))
    return model(t, "model_a").join(b, ["sequence_id", "frame_id"]).agg(F.round(F.avg((F.lower(F.trim("label")) == F.lower(F.trim("other"))).cast("double")), 6).alias("agreement"), F.count("*").alias("n"))


@query("SELECT sequence_id, frame_id, min_by(label, pred_ord) AS label, count(*) AS sets FROM labelled GROUP BY ALL", "labelled")
def u01_merge_prediction_sets(t):
    sets = [model(t, m) for m in ("model_a", "model_b", "model_c")]
    bag = fusion.merge_sets(*sets)
    first = fusion.merge_sets(*sets, keys=("sequence_id", "frame_id"))
    n = bag.groupBy("sequence_id", "frame_id").agg(F.count("*").alias("sets"))
    return first.select("sequence_id", "frame_id", "label").join(n, ["sequence_id", "frame_id"])


@query("SELECT split_part(split_part(sequence_id, '/', 2), '_', 2) AS camera, count(*) AS n FROM frames GROUP BY 1", "frames")
def u02_tagged_union(t):
    f = t.frames
    return fusion.tagged_union({str(k): f.where(F.col("track_id") % 4 == k) for k in range(4)}, "camera").groupBy("camera").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT sequence_id, frame_id FROM labelled WHERE model_name = 'model_a'), b AS (SELECT sequence_id, frame_id FROM labelled WHERE model_name = 'model_b')
SELECT 'both' AS kind, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'b', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""", "labelled")
def u03_key_sets(t):
    a, b = (model(t, m).select("sequence_id", "frame_id") for m in ("model_a", "model_b"))
    n = lambda k, df: df.agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return n("both", a.intersect(b)).unionByName(n("a", a.subtract(b))).unionByName(n("b", b.subtract(a)))


@query("SELECT 'events' AS src, event_id AS id, value, NULL::DOUBLE AS total FROM events UNION ALL SELECT 'orders', o_orderkey, NULL, o_totalprice FROM orders")
def u05_heterogeneous_union(t):
    a = t.events.select(F.lit("events").alias("src"), F.col("event_id").alias("id"), "value")
    b = t.orders.select(F.lit("orders").alias("src"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("total"))
    return a.unionByName(b, allowMissingColumns=True)


@query(f"""WITH {_VOTE}, {_ENTROPY.replace('n AS (', 'en AS (', 1).replace('FROM n)', 'FROM en)', 1).replace(' m AS (', ' em AS (', 1).replace('FROM m GROUP', 'FROM em GROUP', 1)}
SELECT v.sequence_id, v.frame_id, v.label, v.agreement_count, e.entropy, f.true_label, v.label = f.true_label AS correct FROM vote v JOIN e USING (sequence_id, frame_id) JOIN frames f USING (sequence_id, frame_id)""", "labelled")
def d11_ensemble_experiment(t):
    """Union of the sets, vote, evaluation and disagreement in one plan; all steps share the frame's key."""
    p = fusion.merge_sets(*[model(t, m) for m in ("model_a", "model_b", "model_c")])
    e = metrics.entropy(p).select("sequence_id", "frame_id", F.abs("entropy").alias("entropy"))
    out = fusion.with_truth(fusion.majority_vote(p).join(e, ["sequence_id", "frame_id"]), truth(t))
    return out.select("sequence_id", "frame_id", "label", "agreement_count", "entropy", "true_label", (F.col("label") == F.col("true_label")).alias("correct"))


_EV = """r AS (SELECT *, sum(chg) OVER (PARTITION BY sequence_id, track_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN true_label IS DISTINCT FROM lag(true_label) OVER (PARTITION BY sequence_id, track_id ORDER BY pos) OR pos = 0 THEN 1 ELSE 0 END AS chg FROM frames)),
te AS (SELECT sequence_id, track_id, true_label AS label, min(pos) AS s, max(pos) AS e FROM r WHERE true_label <> 'none' GROUP BY sequence_id, track_id, run, true_label),
pp AS (SELECT sequence_id, track_id, frame_id, label, row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY frame_id) - 1 AS q FROM labelled WHERE model_name = 'model_a'),
pr AS (SELECT *, sum(chg) OVER (PARTITION BY sequence_id, track_id ORDER BY q) AS run FROM (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY sequence_id, track_id ORDER BY q) OR q = 0 THEN 1 ELSE 0 END AS chg FROM pp)),
pe AS (SELECT sequence_id, track_id, label, min(q) AS s, max(q) AS e FROM pr WHERE label <> 'none' GROUP BY sequence_id, track_id, run, label)"""


def _events(t: Tables) -> tuple[DataFrame, DataFrame]:
    return series.events(model(t, "model_a")), series.events(t.frames.withColumn("label", F.col("true_label")))


@query(f"""WITH {_EV}, p AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY s) AS o FROM pe), q AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY s) AS o FROM te)
SELECT p.sequence_id, p.track_id, p.label, p.o AS pred_ord, q.o AS true_ord FROM p JOIN q ON p.sequence_id = q.sequence_id AND p.track_id = q.track_id AND p.label = q.label
WHERE greatest(least(p.e, q.e) - greatest(p.s, q.s) + 1, 0)::DOUBLE / (p.e - p.s + 1 + q.e - q.s + 1 - greatest(least(p.e, q.e) - greatest(p.s, q.s) + 1, 0)) >= 0.5 OR (abs(p.s - q.s) <= 2 AND abs(p.e - q.e) <= 2)""", "labelled")
def j19_event_candidates(t):
    return metrics.event_candidates(*_events(t), series.KEY)


_RATIO = "coalesce(round({a} / nullif({b}, 0), 6), 0)::DOUBLE"


@query(f"""WITH RECURSIVE {_EV}, p AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY s) AS o FROM pe), q AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY s) AS o FROM te),
x AS (SELECT p.*, q.o AS t, greatest(least(p.e, q.e) - greatest(p.s, q.s) + 1, 0) AS shared, q.s AS ts, q.e AS te FROM p JOIN q ON p.sequence_id = q.sequence_id AND p.track_id = q.track_id AND p.label = q.label),
c0 AS (SELECT sequence_id, track_id, o, list(t ORDER BY t) AS c FROM x WHERE shared::DOUBLE / (e - s + 1 + te - ts + 1 - shared) >= 0.5 OR (abs(s - ts) <= 2 AND abs(e - te) <= 2) GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, track_id ORDER BY o) AS k FROM c0),
g AS (SELECT sequence_id, track_id, 0::BIGINT AS k, []::BIGINT[] AS used FROM c WHERE k = 1
  UNION ALL SELECT g.sequence_id, g.track_id, c.k, CASE WHEN len(list_filter(c.c, lambda i: NOT list_contains(g.used, i))) > 0 THEN list_append(g.used, list_filter(c.c, lambda i: NOT list_contains(g.used, i))[1]) ELSE g.used END
  FROM g JOIN c ON c.sequence_id = g.sequence_id AND c.track_id = g.track_id AND c.k = g.k + 1),
m AS (SELECT sequence_id, track_id, max(len(used)) AS tp FROM g GROUP BY ALL), a AS (SELECT sequence_id, track_id, count(*) AS n_pred FROM p GROUP BY ALL), b AS (SELECT sequence_id, track_id, count(*) AS n_true FROM q GROUP BY ALL),
f AS (SELECT sequence_id, track_id, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp FROM a FULL JOIN b USING (sequence_id, track_id) LEFT JOIN m USING (sequence_id, track_id))
SELECT *, n_pred - tp AS fp, n_true - tp AS fn, {_RATIO.format(a='tp', b='n_pred')} AS precision, {_RATIO.format(a='tp', b='n_true')} AS recall, coalesce(round(2 * (tp / nullif(n_pred, 0)) * (tp / nullif(n_true, 0)) / nullif(tp / nullif(n_pred, 0) + tp / nullif(n_true, 0), 0), 6), 0)::DOUBLE AS f1 FROM f""", "labelled")
def a25_event_metrics(t):
    return metrics.scores(metrics.match_events(*_events(t), series.KEY))
