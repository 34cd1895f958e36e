"""Frame, event and sequence metrics in one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import LABELS


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def frame_metrics(df: DataFrame, truth: str = "true_label", pred: str = "label", by=(), labels=LABELS, macro: bool = True) -> DataFrame:
    """Per label of the fixed list: support, tp, fp, fn, precision, recall, f1; with macro, a row `macro`
    with the accuracy as recall and the mean F1. Zero divisions give 0. One aggregation over the rows."""
    t, p = F.col(truth), F.col(pred)
    each = [F.struct(F.lit(x).alias("label"), F.count_if((t == x) & (p == x)).alias("tp"), F.count_if((t != x) & (p == x)).alias("fp"), F.count_if((t == x) & (p != x)).alias("fn")) for x in labels]
    sums = df.groupBy(*by).agg(F.array(*each).alias("m"), F.count("*").alias("n"), F.count_if(t == p).alias("right"))
    rows = sums.select(*by, F.explode("m").alias("m")).select(*by, "m.*")
    prec, rec = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = rows.select(*by, "label", (F.col("tp") + F.col("fn")).alias("support"), "tp", "fp", "fn", F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"), F.round(_ratio(2 * prec * rec, prec + rec), 6).alias("f1"))
    if not macro:
        return out
    f1 = lambda m: F.coalesce(2 * m["tp"] / F.nullif(2 * m["tp"] + m["fp"] + m["fn"], F.lit(0)), F.lit(0.0))
    mean = F.aggregate(F.transform("m", f1), F.lit(0.0), lambda a, x: a + x) / len(labels)
    whole = sums.select(*by, F.lit("macro").alias("label"), F.col("n").alias("support"), F.col("right").alias("tp"), (F.col("n") - F.col("right")).alias("fp"), (F.col("n") - F.col("right")).alias("fn"), F.lit(None).cast("double").alias("precision"), F.round(_ratio(F.col("right"), F.col("n")), 6).alias("recall"), F.round(mean, 6).alias("f1"))
    return out.unionByName(whole)


def confusion(df: DataFrame, truth: str = "true_label", pred: str = "label", labels=LABELS) -> DataFrame:
    """One row per true label with a column per predicted one; all cells exist."""
    counts = df.groupBy(F.col(truth).alias("true_label")).agg(*[F.count_if(F.col(pred) == x).alias(f"pred_{x}") for x in labels])
    grid = df.sparkSession.createDataFrame([(x,) for x in labels], "true_label string")
    return F.broadcast(grid).join(counts, "true_label", "left").na.fill(0)


def class_accuracy(df: DataFrame, truth: str = "true_label", pred: str = "label", error: str = "error") -> DataFrame:
    """Share of right answers per true label, rows that failed left out."""
    return df.where(F.col(pred) != error).groupBy(F.col(truth).alias("true_label")).agg(F.count("*").alias("support"), F.round(F.avg((F.col(truth) == F.col(pred)).cast("double")), 6).alias("accuracy"))


def event_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """IoU of two closed stretches of positions."""
    shared = F.greatest(F.least(e1, e2) - F.greatest(s1, s2) + 1, F.lit(0))
    return shared / (e1 - s1 + 1 + e2 - s2 + 1 - shared)


#: Positions of a cell of time in which events meet.
CELL = 16


def _candidates(pred: DataFrame, truth: DataFrame, by, iou: float, tolerance: int) -> DataFrame:
    """Events are listed in each cell that they reach, predicted ones wider by the tolerance, and meet there; the
    cell in which both have begun counts. Events of one label follow each other, so cells hold a few of them."""
    p = pred.select(*by, "label", F.col("event_ord").alias("pred_ord"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    t = truth.select(*by, "label", F.col("event_ord").alias("true_ord"), F.col("start").alias("ts"), F.col("end").alias("te"))
    cell = lambda c: F.floor(c / CELL)
    p = p.withColumn("__cell", F.explode(F.sequence(cell(F.col("ps") - tolerance), cell(F.col("pe") + tolerance))))
    t = t.withColumn("__cell", F.explode(F.sequence(cell(F.col("ts")), cell(F.col("te")))))
    here = F.col("__cell") == cell(F.greatest(F.col("ps") - tolerance, F.col("ts")))
    ok = (event_overlap(F.col("ps"), F.col("pe"), F.col("ts"), F.col("te")) >= iou) | ((F.abs(F.col("ps") - F.col("ts")) <= tolerance) & (F.abs(F.col("pe") - F.col("te")) <= tolerance))
    return p.join(t, [*by, "label", "__cell"]).where(here & ok).drop("__cell")


def event_candidates(pred: DataFrame, truth: DataFrame, by, iou: float = 0.5, tolerance: int = 2) -> DataFrame:
    """Pairs of events of one key and label that overlap by `iou` (over 0) or agree at both ends within the
    tolerance: pred_ord, true_ord."""
    return _candidates(pred, truth, by, iou, tolerance).select(*by, "label", "pred_ord", "true_ord")


def match_events(pred: DataFrame, truth: DataFrame, by, iou: float = 0.5, tolerance: int = 2) -> DataFrame:
    """Greedy one-to-one matching per key: predicted events in order take their first free candidate.
    n_pred, n_true, tp, fp, fn. Events come in the order of their positions, those of a label without overlap, as
    events() gives them. A sweep over each label's predicted events: of the events that are taken it keeps those
    that a later one can still reach, a few at any time."""
    c = _candidates(pred, truth, by, iou, tolerance).groupBy(*by, "label", "pred_ord").agg(F.min("ps").alias("ps"), F.array_sort(F.collect_list(F.struct("true_ord", "te"))).alias("c"))
    lists = c.groupBy(*by, "label").agg(F.array_sort(F.collect_list(F.struct("pred_ord", "ps", "c"))).alias("ps"))
    zero = F.struct(F.lit(0).cast("long").alias("tp"), F.array().cast("array<struct<true_ord:bigint,te:bigint>>").alias("used"))

    def step(state: Column, x: Column) -> Column:
        near = F.filter(state["used"], lambda u: u["te"] + tolerance >= x["ps"])
        free = F.get(F.filter(x["c"], lambda i: ~F.exists(state["used"], lambda u: u["true_ord"] == i["true_ord"])), F.lit(0))
        taken = F.struct((state["tp"] + 1).alias("tp"), F.concat(near, F.array(F.struct(free["true_ord"].cast("long").alias("true_ord"), free["te"].cast("long").alias("te")))).alias("used"))
        return F.when(free.isNotNull(), taken).otherwise(F.struct(state["tp"].alias("tp"), near.alias("used")))

    tp = lists.select(*by, F.aggregate("ps", zero, step)["tp"].alias("tp")).groupBy(*by).agg(F.sum("tp").alias("tp"))
    n = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    out = n(pred, "n_pred").join(n(truth, "n_true"), list(by), "full_outer").join(tp, list(by), "left").na.fill(0, ["n_pred", "n_true", "tp"])
    return out.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_true") - F.col("tp"))


def scores(df: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp, fn."""
    prec, rec = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumn("precision", F.round(prec, 6)).withColumn("recall", F.round(rec, 6)).withColumn("f1", F.round(_ratio(2 * prec * rec, prec + rec), 6))


def entropy(predictions: DataFrame, by=("sequence_id", "frame_id"), label: str = "label") -> DataFrame:
    """Vote entropy (natural logarithm) and pattern of each frame: models, entropy, pattern `label:votes`."""
    n = predictions.groupBy(*by, F.col(label).alias("__l")).agg(F.count("*").alias("n"))
    parts = n.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__l", "n"))).alias("v"), F.sum("n").alias("models"))
    p = lambda x: x["n"] / F.col("models")
    h = F.aggregate("v", F.lit(0.0), lambda a, x: a - p(x) * F.ln(p(x)))
    pattern = F.array_join(F.transform("v", lambda x: F.concat(x["__l"], F.lit(":"), x["n"].cast("string"))), ",")
    return parts.select(*by, "models", F.round(h, 6).alias("entropy"), pattern.alias("pattern"), (F.size("v") == 1).alias("unanimous"))


def entropy_summary(e: DataFrame, cut: float = 0.5) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return e.agg(F.count("*").alias("total"), F.count_if("unanimous").alias("unanimous"), F.count_if(F.col("entropy") > cut).alias("high"), r(F.avg("entropy")).alias("mean"), r(F.stddev_pop("entropy")).alias("std"), r(F.max("entropy")).alias("max"), r(F.min("entropy")).alias("min"))


def error_profile(df: DataFrame, model: str = "model_name", truth: str = "true_label", pred: str = "label", none: str = "none") -> DataFrame:
    """Per model: total, correct, false positives and negatives of signals, confusions between signals, and
    accuracy over all predictions and over those with a truth."""
    t, p = F.col(truth), F.col(pred)
    n = F.count("*")
    right = F.count_if(t == p)
    return df.groupBy(model).agg(n.alias("total"), right.alias("correct"), F.count_if((p != none) & (t == none)).alias("false_positives"), F.count_if((p == none) & (t != none)).alias("false_negatives"), F.count_if((p != none) & (t != none) & (p != t)).alias("confusions"), F.round(right / n, 6).alias("accuracy"), F.round(_ratio(right, F.count(t)), 6).alias("accuracy_on_truth"))


def error_overlap(df: DataFrame, by=("sequence_id", "frame_id"), model: str = "model_name", truth: str = "true_label", pred: str = "label", none: str = "none") -> DataFrame:
    """Pairs of models: frames that both get wrong by a false positive or negative, and their Jaccard share."""
    wrong = df.where((F.col(truth) == none) != (F.col(pred) == none)).select(*by, model).distinct()
    sizes = wrong.groupBy(model).agg(F.count("*").alias("n"))
    pairs = wrong.select(*by, F.col(model).alias("a")).join(wrong.select(*by, F.col(model).alias("b")), list(by)).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    side = lambda s: sizes.select(F.col(model).alias(s), F.col("n").alias(f"n_{s}"))
    grid = side("a").crossJoin(F.broadcast(side("b"))).where("a < b")  # one row per pair of models
    out = grid.join(pairs, ["a", "b"], "left").na.fill(0, ["shared"])
    return out.select("a", "b", "shared", F.round(_ratio(F.col("shared"), F.col("n_a") + F.col("n_b") - F.col("shared")), 6).alias("jaccard"))
