"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import discard, materialise
from .sampling import matched

#: Bins of a histogram.
BINS = 4096


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row for each group, with a column for each share: the value at place (n - 1) * share, between two
    places on the straight line. Nulls and values that are not finite are passed over; a group without values has
    no row. Values are compared as doubles.

    Exact selection by nested histograms: for each wanted rank the values of its interval are counted in BINS bins
    between the least and the largest of them, and the bin that holds the rank becomes the interval, until it
    holds one value only. Counting combines on the map side, so BINS counts for each task and rank are what moves,
    however many values there are; two or three rounds do unless values differ by many orders of magnitude."""
    v = F.col("__v")
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where(v.isNotNull() & (F.abs(v) < float("inf")))
    place = {name: (F.col("__n") - 1) * F.lit(float(share)) for name, share in shares.items()}
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    sizes = materialise(sizes.where("__n > 0"))
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)]))
    targets = sizes.select(*by, F.explode(ranks).alias("__rank"), F.lit(0).cast("long").alias("__below"), "__lo", "__hi")
    targets = materialise(targets)
    while not (wide := targets.where("__lo < __hi")).isEmpty():
        # Without groups there are two ranks for each share.
        near = (matched(rows, wide, by) if by else rows.crossJoin(F.broadcast(wide))).where(v.between(F.col("__lo"), F.col("__hi")))
        at = F.floor((v / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2) * BINS)
        counts = near.groupBy(*by, "__rank", "__below", F.least(at, F.lit(BINS - 1)).alias("__bin")).agg(F.count("*").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        upto = F.sum("__c").over(Window.partitionBy(*by, "__rank").orderBy("__bin"))  # BINS rows at most
        held = counts.withColumn("__upto", F.col("__below") + upto).where((F.col("__upto") > F.col("__rank")) & (F.col("__upto") - F.col("__c") <= F.col("__rank")))
        found = held.select(*by, "__rank", (F.col("__upto") - F.col("__c")).alias("__below"), "__lo", "__hi")
        before = targets
        targets = materialise(targets.where("__lo = __hi").unionByName(found))
        discard(before)
    values = targets.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__lo"))).alias("__at"))
    out = matched(sizes, values, by) if by else sizes.crossJoin(F.broadcast(values))
    low = {name: F.element_at("__at", F.floor(p).cast("long")) for name, p in place.items()}
    high = {name: F.element_at("__at", F.ceil(p).cast("long")) for name, p in place.items()}
    return out.select(*by, *[(low[k] + (high[k] - low[k]) * (place[k] - F.floor(place[k]))).alias(k) for k in shares])
