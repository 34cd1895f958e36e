"""Incremental jobs: file streams with a checkpoint, and their batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.fusion import first_per


def append_new_files(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Process the files that have come since the last run and append the result: exactly once per file, also
    after a failure. A file that is written anew under its old name is not read again."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return transform(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unprocessed(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The batch form: inputs whose key has no result yet."""
    return inputs.join(done.select(key), key, "left_anti")


#: Settings of the state of reviews: what a batch changes goes to a log, whole snapshots are written now and then
#: in the background, and old versions are removed.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def upsert_reviews(spark: SparkSession, source: str, schema, checkpoint: str, key: str = "sequence_id", order: str = "reviewed_at", files_per_batch: int = 100, retained: int = 10) -> StreamingQuery:
    """Review decisions as a stream of files; the latest one of each key is kept in Spark's keyed state, which lies
    in the checkpoint. A batch writes what it changes and no more, however many keys there are; a batch that was
    cut off runs again from the version before it, with the same result. Of decisions with equal `order` the
    largest row counts. The versions of the last `retained` batches stay. read_reviews() reads the state."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    row = F.struct(order, *[c for c in stream.columns if c not in (key, order)])
    latest = stream.groupBy(key).agg(F.max(row).alias("row"))
    settings = STATE | {"spark.sql.streaming.minBatchesToRetain": str(retained)}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return latest.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_reviews(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """The latest decision of each key, as of the last batch that ended, or of an earlier one."""
    reader = spark.read.format("statestore")
    state = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    (row,) = state.schema["value"].dataType.names
    return state.select("key.*", F.col(f"value.`{row}`").alias("row")).select(*state.schema["key"].dataType.names, "row.*")
