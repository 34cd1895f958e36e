"""Label fusion of several models' predictions, long tables with one row per frame and model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FRAME = ("sequence_id", "frame_id")


def first_per(df: DataFrame, by, *order) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__r = 1").drop("__r")


def sequence_label(df: DataFrame, label: str = "label", by=("sequence_id", "track_id"), order: str = "frame_id") -> DataFrame:
    """Each track's most frequent label that is not empty; of equals the one seen first."""
    counts = df.where(F.col(label).isNotNull() & (F.col(label) != "")).groupBy(*by, F.col(label).alias("label")).agg(F.count("*").alias("votes"), F.min(order).alias("__first"))
    return first_per(counts, by, F.desc("votes"), "__first").drop("__first")


def majority_vote(predictions: DataFrame, by=FRAME, label: str = "label", confidence: str = "confidence", order: str = "pred_ord") -> DataFrame:
    """The label of over half the votes, else the one of the highest mean confidence (then first seen):
    label, confidence (its mean), agreement_count, total_models."""
    votes = predictions.groupBy(*by, F.col(label).alias("label")).agg(F.count("*").alias("agreement_count"), F.avg(confidence).alias("confidence"), F.min(order).alias("__first"))
    total = F.sum("agreement_count").over(Window.partitionBy(*by))
    votes = votes.withColumn("total_models", total)
    return first_per(votes, by, F.desc(F.col("agreement_count") * 2 > F.col("total_models")), F.desc("confidence"), "__first").drop("__first")


def vote_distribution(predictions: DataFrame, by=FRAME, label: str = "label") -> DataFrame:
    """A map from label to votes for each frame."""
    n = predictions.groupBy(*by, label).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("distribution"))


def with_truth(predictions: DataFrame, truth: DataFrame, by=FRAME, how: str = "inner") -> DataFrame:
    """Predictions with the true label: inner for scoring, left for export."""
    return predictions.join(truth.select(*by, "true_label"), list(by), how)


def agreement(a: DataFrame, b: DataFrame, by=FRAME, label: str = "label", confidence: str = "confidence") -> DataFrame:
    """All frames of two models side by side (one prediction each): status agreed, disagreed, only_in_a or
    only_in_b; agreed frames have the label and the rounded mean confidence."""
    side = lambda df, s: df.select(*by, F.col(label).alias(f"label_{s}"), F.col(confidence).alias(f"confidence_{s}"))
    both = side(a, "a").join(side(b, "b"), list(by), "full_outer")
    status = F.when(F.col("label_b").isNull(), "only_in_a").when(F.col("label_a").isNull(), "only_in_b").when(F.col("label_a") == F.col("label_b"), "agreed").otherwise("disagreed")
    out = both.withColumn("status", status)
    agreed = F.col("status") == "agreed"
    return out.withColumn("label", F.when(agreed, F.col("label_a"))).withColumn("confidence", F.when(agreed, F.round((F.col("confidence_a") + F.col("confidence_b")) / 2, 4)))


def agreement_report(both: DataFrame) -> DataFrame:
    """Totals and rates of agreement(): one row."""
    n = lambda s: F.count_if(F.col("status") == s)
    common = n("agreed") + n("disagreed")
    return both.agg(common.alias("common_frames"), n("agreed").alias("agreed"), n("disagreed").alias("disagreed"), n("only_in_a").alias("only_in_a"), n("only_in_b").alias("only_in_b"), F.coalesce(F.round(n("agreed") / F.nullif(common, F.lit(0)), 6), F.lit(0.0)).alias("agreement_rate"))


def merge_sets(*sets: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A bag union; with keys, the first set that has a key wins."""
    tagged = [s.withColumn("__src", F.lit(k)) for k, s in enumerate(sets)]
    out = tagged[0]
    for s in tagged[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return (first_per(out, keys, "__src") if keys else out).drop("__src")


def tagged_union(sources: dict[str, DataFrame], name: str) -> DataFrame:
    """Sources under one schema with the source's name as a column."""
    out = None
    for tag, df in sources.items():
        df = df.withColumn(name, F.lit(tag))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


