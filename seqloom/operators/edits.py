"""Human corrections as joins: deletion, relabelling, merging, splitting, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlay(df: DataFrame, corrections: DataFrame, keys: list[str], label: str = "label", new: str = "new_label") -> DataFrame:
    """A correction wins over the stored label; was_corrected tells where."""
    out = df.join(corrections.select(*keys, F.col(new).alias("__new")), keys, "left")
    return out.withColumn("was_corrected", F.col("__new").isNotNull()).withColumn(label, F.coalesce("__new", label)).drop("__new")


def apply_edits(df: DataFrame, deleted: DataFrame, corrections: DataFrame, merges: DataFrame, splits: DataFrame, crop: str = "crop_path", seq: str = "sequence_id", order: str = "frame_id") -> DataFrame:
    """Remove crops, relabel, merge (seq -> into), then split (seq, at -> new_id from that frame on). A split
    names the sequence as it is after merging; merges are honoured."""
    out = overlay(df.join(deleted.select(crop), crop, "left_anti"), corrections, [crop])
    out = out.join(merges.select(seq, F.col("into").alias("__into")), seq, "left").withColumn(seq, F.coalesce("__into", seq)).drop("__into")
    out = out.join(splits.select(seq, F.col("at").alias("__at"), F.col("new_id").alias("__id")), seq, "left")
    return out.withColumn(seq, F.when(F.col(order) >= F.col("__at"), F.col("__id")).otherwise(F.col(seq))).drop("__at", "__id")


def upsert(stored: DataFrame, redo: DataFrame, key: str, value: str, keep: Column) -> DataFrame:
    """Stored rows that satisfy `keep` stay; others take the redone value or become blank; new keys follow."""
    new = redo.select(key, F.col(value).alias("__new"))
    old = stored.join(new, key, "left").withColumn(value, F.when(keep, F.col(value)).otherwise(F.coalesce("__new", F.lit("")))).drop("__new")
    return old.unionByName(redo.join(stored.select(key), key, "left_anti").select(*old.columns), allowMissingColumns=True)
