"""Splits and samples. Draws are ordered by integer arithmetic on keys, never by rand(): reruns and other
engines agree. Sizes and guarantees are the contract."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialise

#: A prime and a multiplier: (key * MULT + seed) % PRIME orders keys.
PRIME, MULT = 1_000_003, 7919


def order_hash(key: str | Column, seed: int = 42) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.pmod(c.cast("long") * MULT + seed, F.lit(PRIME))


#: Ranges of the hash into which a group is divided.
PARTS = 1024


def part_of(key: str | Column, seed: int = 42) -> Column:
    """The range of the hash that a key falls into; null keys come first."""
    return F.coalesce(F.floor(order_hash(key, seed) * PARTS / PRIME), F.lit(-1))


def matched(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Equi-join that keeps null keys; the keys of `right` go."""
    other = right.withColumnsRenamed({c: f"__right_{c}" for c in by})
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__right_{c}")) for c in by])
    return left.join(other, on).drop(*[f"__right_{c}" for c in by])


def with_counts(df: DataFrame, by: list[str], key: str, seed: int = 42) -> DataFrame:
    """__part, and the number of rows of the group: in lower parts (__before) and in all (__all). They come from
    at most PARTS + 1 counts of each group."""
    parted = df.withColumn("__part", part_of(key, seed))
    counts = parted.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part"))
    counts = counts.select(*by, "__part", (upto - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(*by)).alias("__all"))
    return matched(parted, counts, [*by, "__part"])


def rank_in(by: list[str], key: str, *ties: str, seed: int = 42) -> Column:
    """The row number in a group in hash order, for rows that have __part and __before: a window over a part
    of a group only, so that a class of any size is dealt over many tasks."""
    return F.col("__before") + F.row_number().over(Window.partitionBy(*by, "__part").orderBy(order_hash(key, seed), *(ties or (key,))))


def numbered(df: DataFrame, order: str, name: str, *ties: str, parts: int = PARTS) -> DataFrame:
    """The row number over all rows by a numeric column, ties by others. Rows are dealt to ranges between
    approximate quantiles (`parts` numbers), numbered in their range, and moved by the rows of lower ranges."""
    fractions = [k / parts for k in range(1, parts)]
    cuts = sorted(set(df.select(F.col(order).cast("double").alias("__o")).approxQuantile("__o", fractions, 1 / parts))) or [0.0]
    ranged = df.withColumn("__o", F.col(order).cast("double"))
    ranged = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__o", outputCol="__part", handleInvalid="keep").transform(ranged)
    ranged = ranged.withColumn("__part", F.coalesce("__part", F.lit(-1.0)))  # nulls come first
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))  # at most parts + 1 rows
    counts = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(order, *ties))
    return ranged.join(F.broadcast(counts), "__part").withColumn(name, F.col("__before") + inner).drop("__o", "__part", "__before")


def take(df: DataFrame, by: list[str], quota: Column | int, key: str, seed: int = 42) -> DataFrame:
    """The first `quota` rows of each group in hash order. Parts behind the quota are left out before any sort."""
    q = F.lit(quota) if isinstance(quota, int) else quota
    near = with_counts(df, by, key, seed).withColumn("__q", q).where("__before < __q")
    return near.withColumn("__r", rank_in(by, key, seed=seed)).where("__r <= __q").drop("__q", "__r", "__part", "__before", "__all")


def stratified_split(df: DataFrame, share: float, label: str, key: str, seed: int = 42) -> DataFrame:
    """split: val for int(n * share) rows of each class, train for the rest."""
    counted = with_counts(df, [label], key, seed)
    split = F.when(rank_in([label], key, seed=seed) <= F.floor(F.col("__all") * share), "val").otherwise("train")
    return counted.withColumn("split", split).drop("__part", "__before", "__all")


def recording_split(df: DataFrame, by: list[str], key: Column, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """No recording is in two splits: int(n * train), int(n * val), and the rest as test. Only the distinct
    recordings are ranked, and joined back."""
    recordings = df.select(*by, key.cast("long").alias("__k")).groupBy(*by).agg(F.min("__k").alias("__k"))
    recordings = with_counts(recordings, [], "__k", seed)
    rank, n = rank_in([], "__k", "__k", *by, seed=seed), F.col("__all")
    split = F.when(rank <= F.floor(n * train), "train").when(rank <= F.floor(n * train) + F.floor(n * val), "val").otherwise("test")
    return df.join(recordings.withColumn("split", split).drop("__k", "__part", "__before", "__all"), by)


def mirrored_training(df: DataFrame, flip) -> DataFrame:
    """Rows with is_flipped false, and of the train split a mirrored copy."""
    return df.withColumn("is_flipped", F.lit(False)).unionByName(flip(df.where("split = 'train'")).withColumn("is_flipped", F.lit(True)))


def diverse(df: DataFrame, n: int, video: str, camera: str, label: str, length: Column, key: str, middle: tuple[int, int] = (20, 100)) -> DataFrame:
    """The n sequences of the highest score: unseen video +3, camera +2, label +5 (+2 for the second), middle
    length +1. Unseen is the first in hash order inside its video, camera or label."""
    out = df.withColumn("score", F.when(length.between(*middle), 1).otherwise(0))
    for by, scores in ((video, (3,)), (camera, (2,)), (label, (5, 2))):
        out = with_counts(out, [by], key).withColumn("__r", rank_in([by], key))
        gain = F.get(F.array(*map(F.lit, scores)), (F.col("__r") - 1).cast("int"))
        out = out.withColumn("score", F.col("score") + F.coalesce(gain, F.lit(0))).drop("__r", "__part", "__before", "__all")
    return out.orderBy(F.desc("score"), key).limit(n)


def quota_sample(df: DataFrame, quotas: DataFrame, by: list[str], key: str) -> DataFrame:
    """As many rows of each category combination as the table of quotas says."""
    return take(df.join(F.broadcast(quotas), by), by, F.col("quota"), key).drop("quota")


def falls_into(points: DataFrame, x: str, intervals: DataFrame, low: str, high: str, width: str, by: list[str]) -> DataFrame:
    """Each point joined with the interval [low, high) it lies in. Both are dealt to cells of a width, a column
    of points and intervals alike, and meet in the cell; an interval is listed in every cell it reaches."""
    cell = lambda c: F.floor(F.col(c) / F.nullif(F.col(width), F.lit(0.0)))
    listed = intervals.withColumn("__cell", F.explode(F.sequence(cell(low), cell(high)))).drop(width)
    return points.withColumn("__cell", cell(x)).join(listed, [*by, "__cell"]).where((F.col(x) >= F.col(low)) & (F.col(x) < F.col(high))).drop("__cell", width)


#: A prime for draws, 2^31 - 1, and factors of a square and a number modulo it.
DRAWS, SQUARE, LINEAR = 2_147_483_647, 48_271, 69_621


def uniform(number: Column, seed: int = 42) -> Column:
    """A number in (0, 1) for each whole number: a square modulo a prime, so that other engines agree."""
    d = F.pmod(number, F.lit(DRAWS))
    return ((d * d % DRAWS * SQUARE + d * LINEAR + seed) % DRAWS + 0.5) / DRAWS


def placed(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """The row number in a group by columns of any kind, from 1. Rows are dealt by ranges of group and order and
    written, numbered in their range, and moved by the group's rows in lower ranges: no group is one task."""
    dealt = materialise(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part"))  # one row for each range
    counts = counts.select(*by, "__part", (upto - F.col("__n")).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))
    return matched(dealt.withColumn("__inner", inner), counts, [*by, "__part"]).withColumn(name, F.col("__before") + F.col("__inner")).drop("__inner", "__part", "__before")


def weighted_resample(df: DataFrame, n: int, weight: Column, key: str, seed: int = 42) -> DataFrame:
    """n draws with replacement, in proportion to weight. Weights are summed by hash buckets, each draw falls
    into one bucket, and inside it into one row; no window runs over the whole table. Cells are as wide as a
    mean row, so a draw meets two rows or so at any size."""
    rows = df.withColumn("__w", weight.cast("double")).withColumn("__b", F.coalesce(order_hash(key, seed) % PARTS, F.lit(-1)))
    w = Window.partitionBy("__b").orderBy(key)
    rows = rows.withColumn("__hi", F.sum("__w").over(w)).withColumn("__lo", F.col("__hi") - F.col("__w"))
    sums = rows.groupBy("__b").agg(F.max("__hi").alias("__s"), F.count("*").alias("__n"))  # at most PARTS rows
    sums = sums.withColumn("__shi", F.sum("__s").over(Window.orderBy("__b"))).withColumn("__slo", F.col("__shi") - F.col("__s"))
    sums = sums.withColumn("__t", F.max("__shi").over(Window.partitionBy())).withColumn("__step", F.col("__t") / PARTS)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), uniform(F.col("id"), seed).alias("__u"))
    whole = sums.agg(F.max("__t").alias("__total"), F.max("__step").alias("__step"))  # one row
    draws = draws.crossJoin(F.broadcast(whole)).withColumn("__y", F.col("__u") * F.col("__total")).select("draw", "__y", "__step")
    placed = falls_into(draws, "__y", F.broadcast(sums), "__slo", "__shi", "__step", [])
    placed = placed.select("draw", "__b", (F.col("__y") - F.col("__slo")).alias("__x"), (F.col("__s") / F.col("__n")).alias("__width"))
    widths = sums.select("__b", (F.col("__s") / F.col("__n")).alias("__width"))
    found = falls_into(placed, "__x", rows.join(F.broadcast(widths), "__b"), "__lo", "__hi", "__width", ["__b"])
    return found.drop("__b", "__x", "__w", "__lo", "__hi")


def mix_partners(df: DataFrame, by: list[str], key: str, values: str, lam: float = 0.7) -> DataFrame:
    """Each window blended with another of its class and camera: lam * own + (1 - lam) * partner. The partner
    is the next in hash order, the first for the last. Windows run over parts of a class: the partner of a
    part's last row is the first row of the next part."""
    parted = df.withColumn("__part", part_of(key))
    order, one = F.struct(order_hash(key), F.col(key)), F.struct(F.col(values).alias("v"))
    firsts = parted.groupBy(*by, "__part").agg(F.min_by(one, order).alias("__first"))
    w = Window.partitionBy(*by).orderBy("__part")
    after = F.coalesce(F.lead("__first").over(w), F.first("__first").over(w))
    both = matched(parted, firsts.select(*by, "__part", after.alias("__after")), [*by, "__part"])
    mate = F.coalesce(F.lead(one).over(Window.partitionBy(*by, "__part").orderBy(order_hash(key), key)), F.col("__after"))["v"]
    return both.withColumn("mixed", F.zip_with(F.col(values), mate, lambda a, b: a * lam + b * (1 - lam))).drop("__part", "__after")
