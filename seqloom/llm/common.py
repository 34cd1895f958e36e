"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import discard, materialise, shared_dir  # noqa: F401

#: Words are maximal runs of bytes other than ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


#: No key of fewer rows counts as a large one.
LARGE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """For each stem a column name that df does not have yet (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its exact name, dots and back-quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, so that what a worker makes of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow for columns of any name: it takes dots in them for nested fields."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, out = df.columns, [f"o{i}" for i in range(len(schema.fields))]
    inner = T.StructType([T.StructField(o, f.dataType) for o, f in zip(out, schema.fields)])

    def renamed(batches):
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(out)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, inner).toDF(*schema.names)


def join_skewed(rows: DataFrame, one: DataFrame, key: str | list[str], n: str, total: int, how: str = "inner", alike: bool = False) -> DataFrame:
    """rows joined with `one`, which has, as column n, how many of the `total` rows have a key, and one row per
    key of more than LARGE rows. Keys of more than a thousandth of all rows, of which there are under a thousand, are broadcast,
    so that no task gets all rows of a key; the others are joined by exchange. Column n goes. With how="left" rows
    without a partner stay. With `alike` the others are joined by exchange also where they would fit a broadcast,
    so that cost grows in proportion."""
    large = F.col(n) > max(total // 1000, LARGE)
    hot = F.broadcast(one.where(large).drop(n))
    names = [key] if isinstance(key, str) else key
    rest = rows.join(F.broadcast(one.where(large).select(*names)), key, "left_anti")
    small = one.where(~large).drop(n)
    return rows.join(hot, key).unionByName(rest.join(small.hint("merge") if alike else small, key, how))


def numbered(df: DataFrame, group: str, order: list[str], idx: str) -> DataFrame:
    """df with idx, each row's place from 0 in its group (a string, never null) by `order`, nulls first; equal
    rows follow each other in any order. Rows are dealt by ranges of group and order, so a group of any size is
    spread over the tasks; what a group has in earlier tasks is a number for each task, which is broadcast.
    Writes the rows once."""
    row, part, local, before = fresh(df, "row", "part", "local", "before")
    by = [F.col(group).asc(), *[quoted(c).asc_nulls_first() for c in order], F.col(row).asc()]
    dealt = df.withColumn(row, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop(row)
    dealt = dealt.withColumn(part, F.spark_partition_id())
    at = df.columns.index(group)

    def count(batches):
        last, n = None, 0
        for batch in batches:
            places = np.empty(batch.num_rows, dtype=np.int64)
            names = batch.column(at)
            starts = [0, *(np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                if (name := names[a].as_py()) != last:
                    last, n = name, 0
                places[a:b] = np.arange(n, n + b - a)
                n += b - a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], names=[*batch.schema.names, local])

    rows = materialise(map_arrow(dealt, count, T.StructType([*dealt.schema.fields, T.StructField(local, T.LongType())])))
    ends = rows.groupBy(part).agg(F.min(group), F.max(F.struct(group, local))).collect()  # one row for each task
    earlier, last, n = [], None, 0
    for task, first, (name, place) in sorted(ends):
        if first == last:
            earlier.append((task, first, n))
        n = place + 1 + (n if name == last else 0)
        last = name
    starts = df.sparkSession.createDataFrame(earlier, T.StructType([T.StructField(part, T.IntegerType()), T.StructField(group, T.StringType()), T.StructField(before, T.LongType())]))
    return rows.join(F.broadcast(starts), [part, group], "left").select(*map(quoted, df.columns), (F.col(local) + F.coalesce(before, F.lit(0))).alias(idx))
