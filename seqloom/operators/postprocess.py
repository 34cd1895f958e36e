"""Quality flags and the post-processing chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sampling, series


def quality_flags(df: DataFrame, sampled: Column | None = None, label: str = "label", raw: str | None = None, before: int = 5) -> DataFrame:
    """flags: both_signals, rapid_change, random_sample, as they apply; flagged tells whether any does."""
    both = F.lower(F.trim(F.col(raw or label))).isin("both", "hazard")
    named = F.array(F.when(both, "both_signals"), F.when(series.rapid_change(df, before, label=label), "rapid_change"), F.when(sampled if sampled is not None else F.lit(False), "random_sample"))
    return df.withColumn("flags", F.filter(named, lambda x: x.isNotNull())).withColumn("flagged", F.size("flags") > 0)


def chain(df: DataFrame, window: int = 5, least: int = 3, most: int = 50, label: str = "label") -> DataFrame:
    """Smoothing, flags, then duration constraints; the flags see the labels before the constraints."""
    out = series.mode_smooth(df, window, label)
    out = quality_flags(out.drop("original_label"), label=label)
    return series.maximum_duration(series.minimum_duration(out, least, label), most, label)


def review_sample(df: DataFrame, rate: float, by=("sequence_id", "track_id"), label: str = "label", key: str = "frame_id", n_labels: int = 4) -> DataFrame:
    """A stratified review sample: of each track and label max(1, int(n * rate) // labels) frames."""
    quota = F.greatest(F.lit(1), F.floor(F.floor(F.count("*").over(Window.partitionBy(*by)) * rate) / n_labels))
    place = F.row_number().over(Window.partitionBy(*by, label).orderBy(sampling.order_hash(key), key))
    return df.withColumn("__q", quota).withColumn("__r", place).where("__r <= __q").drop("__q", "__r")
