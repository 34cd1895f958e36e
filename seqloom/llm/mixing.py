"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed hash. A source takes every document floor(target / size) times and, once
more, those whose hash lies under the source's threshold. The threshold comes from nested histograms:
words are summed by source and hash bucket, the bucket in which the budget runs out is found with a
running sum over at most BUCKETS rows, and only that bucket is summed again, more finely. Nothing is
sorted, and the last pass is a filter. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialise, quoted

#: Bits of the hash that one histogram resolves, and the number of histograms.
BITS, LEVELS = 12, 5
#: The hash has BITS * LEVELS = 60 bits: 15 hex digits of an MD5.
MOST_TIMES = 3
WEIGHTS = (1, 2, 3)


def words(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: Column) -> Column:
    """A fixed 60-bit hash of an id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """sizes(source, size) by source: source, source_size, target.

    Sources by code point, null last, weigh weights[0], weights[1], ..., repeating, and share the sum of
    all sizes. A target stops at most * source_size; what is above is shared again by weight, until none
    is above. That fixed point is min(cap, level * weight); level is found with running sums over the
    sources in the order in which they reach their caps.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    capped = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    before = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    sums = (
        capped.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.sum("source_size").over(whole) - F.col("spent")) / F.col("left"))
    )
    # The first source, in that order, that does not reach its cap sets the level.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    return sums.withColumn("reached", level).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("reached") * F.col("weight"), F.col("cap").cast("double"))).alias("target")
    )


def thresholds(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with base (whole copies) and threshold: documents whose hash is under it are taken once more.

    docs has source, size, hash. The extra copies are the run of documents, by rising hash, whose words come
    nearest to target - base * source_size: the first document that does not fit is taken too if more than
    half of it fits, so a source misses its target by half of that document at most.
    """
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = goals.withColumn("base", base).withColumn("prefix", F.lit(0).cast("long"))
    state = state.withColumn("room", F.col("target") - F.col("base") * F.col("source_size"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bucket = F.shiftright("hash", shift)
        inside = docs.join(
            state.select(F.col("source").alias("s"), "prefix"),
            F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + BITS) == F.col("prefix")),
            "left_semi",
        )
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
        running = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        # The first bucket that does not fit as a whole; one past the last if all fit.
        over = sums.withColumn("upto", running).select(F.col("source").alias("s"), "bucket", F.col("size").alias("bucket_size"), "upto")
        found = (
            state.join(over, F.col("source").eqNullSafe(F.col("s")), "left")
            .groupBy(*state.columns)
            .agg(
                F.min(F.when(F.col("upto") > F.col("room"), F.struct("bucket", "bucket_size"))).alias("at"),
                F.max(F.when(F.col("upto") <= F.col("room"), F.col("upto"))).alias("used"),
            )
        )
        full = F.shiftleft(F.col("prefix"), BITS) + (1 << BITS)
        found = (
            found.withColumn("room", F.col("room") - F.coalesce("used", F.lit(0)))
            .withColumn("prefix", F.coalesce("at.bucket", full))
            .withColumn("next", F.col("at.bucket_size"))
            .drop("at", "used")
        )
        state = materialise(found if level == LEVELS - 1 else found.drop("next"))
        # Where all buckets fitted, the prefix is past the range: later levels find no rows and keep it so.
    # The last bucket is one hash: `next` is the size of the document that no longer fits.
    nearer = F.coalesce(2 * F.col("room") > F.col("next"), F.lit(False)).cast("long")
    return state.withColumn("threshold", F.col("prefix") + nearer).drop("prefix", "room", "next")


def mix_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words, repeats counted).

    A null text has size 0, a null source is a source of its own, last in order. Rows that repeat a
    doc_id in a source are taken together. If all sizes are 0, so are all targets. An empty table gives
    an empty result. Extra columns are ignored. Reruns agree, as the hash depends on doc_id only.
    """
    sized = materialise(docs.select(quoted(doc_id).alias("doc_id"), quoted(source).alias("source"), words(quoted(text)).alias("size"), hash60(quoted(doc_id)).alias("hash")))
    goals = materialise(targets(sized.select("source", "size"), weights, most))
    found = thresholds(sized, goals)
    right = found.select(F.col("source").alias("s"), "source_size", "target", "base", "threshold")
    times = F.least(F.lit(most), F.col("base") + (F.col("hash") < F.col("threshold")).cast("long"))
    joined = sized.join(right, F.col("source").eqNullSafe(F.col("s")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"), "source")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """docs itself, each row as often as the mix takes it (0 to most times); all columns stay."""
    src, base, limit, times = fresh(docs, "src", "base", "limit", "times")
    sized = materialise(docs.select(quoted(doc_id).alias("doc_id"), quoted(source).alias("source"), words(quoted(text)).alias("size"), hash60(quoted(doc_id)).alias("hash")))
    found = thresholds(sized, materialise(targets(sized.select("source", "size"), weights, most)))
    right = found.select(F.col("source").alias(src), F.col("base").alias(base), F.col("threshold").alias(limit))
    taken = F.least(F.lit(most), F.col(base) + (hash60(quoted(doc_id)) < F.col(limit)).cast("long"))
    joined = docs.join(right, quoted(source).eqNullSafe(F.col(src))).withColumn(times, taken.cast("int")).where(F.col(times) > 0)
    return joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[quoted(c) for c in docs.columns])
