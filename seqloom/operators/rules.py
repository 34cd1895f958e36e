"""Rule classifiers of signal series, and their tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from . import metrics
from .sampling import numbered


def activity(left: Column, right: Column) -> list[Column]:
    """left/right activity (population deviation), CVs, largest, smallest, and their ratio."""
    l, r = arrays.deviation(left), arrays.deviation(right)
    cv = lambda s, a: F.when(arrays.mean(a) > 0, s / arrays.mean(a)).otherwise(F.lit(0.0))
    high, low = F.greatest(l, r), F.least(l, r)
    return [l.alias("left_activity"), r.alias("right_activity"), cv(l, left).alias("left_cv"), cv(r, right).alias("right_cv"), high.alias("max_activity"), low.alias("min_activity"), F.when(high > 0, low / high).otherwise(F.lit(0.0)).alias("activity_ratio")]


def _sided(hazard_ratio: Column, min_hazard: Column) -> Column:
    l, r = F.col("left_activity"), F.col("right_activity")
    return F.when((F.col("activity_ratio") > hazard_ratio) & (F.least(l, r) >= min_hazard), "hazard").when(l > r, "left").otherwise("right")


def classify(df: DataFrame, intensity: str, activity_threshold: float = 500.0, hazard_ratio: float = 0.7, min_hazard: float = 0.0, min_cv: float = 0.0, variance: float = 0.3, strict: bool = False, fps: float = 10.0) -> DataFrame:
    """Label and reason from the whole series (is it blinking?) and the activity of its sides."""
    a = F.col(intensity)
    known = df.withColumn("__s", F.struct(arrays.mean(a).alias("m"), arrays.deviation(a).alias("s"), arrays.periodicity(a, fps)["is_periodic"].alias("periodic")))
    m, s, periodic = F.col("__s.m"), F.col("__s.s"), F.col("__s.periodic")
    blinking = periodic if strict else periodic | ((m > 0) & (s > m * variance))
    high, cv = F.greatest("left_activity", "right_activity"), F.greatest("left_cv", "right_cv")
    none = F.when(~blinking, "not blinking").when(high < activity_threshold, "low activity").when(cv < min_cv, "constant light")
    out = known.withColumn("label", F.when(none.isNotNull(), "none").otherwise(_sided(F.lit(hazard_ratio), F.lit(min_hazard))))
    reason = none.when(F.col("label") == "hazard", "both sides alike").otherwise("one side more active")
    return out.withColumn("reason", reason).withColumn("is_periodic", periodic).drop("__s")


def threshold_rule(activity_threshold: Column, hazard_ratio: Column, min_hazard: Column | None = None) -> Column:
    """The label from precomputed features, without the blinking test."""
    high = F.greatest("left_activity", "right_activity")
    return F.when(high < activity_threshold, "none").otherwise(_sided(hazard_ratio, min_hazard if min_hazard is not None else F.lit(0.0)))


def with_ratio(df: DataFrame) -> DataFrame:
    high = F.greatest("left_activity", "right_activity")
    return df.withColumn("max_activity", high).withColumn("min_activity", F.least("left_activity", "right_activity")).withColumn("activity_ratio", F.when(high > 0, F.col("min_activity") / high).otherwise(F.lit(0.0)))


def grid_search(features: DataFrame, grid: DataFrame, truth: str = "ground_truth") -> DataFrame:
    """Metrics of every configuration of a grid (grid_ord, activity_threshold, hazard_ratio): features once,
    the grid (a parameter list) broadcast, one aggregation. accuracy and macro_f1 per configuration."""
    each = features.crossJoin(F.broadcast(grid)).withColumn("label", threshold_rule(F.col("activity_threshold"), F.col("hazard_ratio")))
    m = metrics.frame_metrics(each, truth, "label", by=("grid_ord", "activity_threshold", "hazard_ratio"))
    return m.where("label = 'macro'").select("grid_ord", "activity_threshold", "hazard_ratio", F.col("recall").alias("accuracy"), F.col("f1").alias("macro_f1"))


def topsis(df: DataFrame, criteria: dict[str, tuple[float, bool]]) -> DataFrame:
    """Closeness to the ideal: columns scaled by their norm and weight; criteria: name -> (weight, benefit)."""
    names = list(criteria)
    norms = df.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"__n_{c}") for c in names])
    v = df.crossJoin(F.broadcast(norms))
    for c in names:
        v = v.withColumn(f"__v_{c}", F.col(c) / F.col(f"__n_{c}") * criteria[c][0])
    ends = v.agg(*[f(f"__v_{c}").alias(f"__{k}_{c}") for c in names for k, f in (("p", F.max if criteria[c][1] else F.min), ("w", F.min if criteria[c][1] else F.max))])
    far = lambda k: F.sqrt(sum(((F.col(f"__v_{c}") - F.col(f"__{k}_{c}")) * (F.col(f"__v_{c}") - F.col(f"__{k}_{c}")) for c in names), F.lit(0.0)))
    out = v.crossJoin(F.broadcast(ends)).withColumn("closeness", F.round(far("w") / (far("p") + far("w")), 6))
    return out.select(*df.columns, "closeness")


def topsis_sensitivity(df: DataFrame, key: str, criteria: dict[str, tuple[float, bool]], by: float = 0.2) -> DataFrame:
    """Rank correlation (Spearman) with the base ranking when one weight changes by +-by and all are scaled to
    sum to 1: criterion, change, spearman, top_changed."""
    ranked = lambda d, name: numbered(d.select(key, (-F.col("closeness")).alias("__far")), "__far", name, key).drop("__far")
    base, out = ranked(topsis(df, criteria), "r0"), None
    for c in criteria:
        for m in (1 - by, 1 + by):
            w = {k: v[0] * (m if k == c else 1) for k, v in criteria.items()}
            varied = {k: (x / sum(w.values()), criteria[k][1]) for k, x in w.items()}
            both = base.join(ranked(topsis(df, varied), "r1"), key)
            row = both.agg(F.lit(c).alias("criterion"), F.lit(round(m - 1, 6)).alias("change"), F.round(F.corr("r0", "r1"), 6).alias("spearman"), (F.min_by(key, "r0") != F.min_by(key, "r1")).alias("top_changed"))
            out = row if out is None else out.unionByName(row)
    return out
