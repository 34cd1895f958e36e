"""File sinks: all are Spark writers, one task per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import safe_key
from ..operators.fusion import agreement_report

#: Category ids of annotation files.
CATEGORIES = (("none", 0), ("left", 1), ("right", 2), ("hazard", 3))


def _have(df: DataFrame, *names: str) -> list[str]:
    return [c for c in names if c in df.columns]


def write_csv(predictions: DataFrame, path: str, key: str = "sequence_key") -> None:
    """A folder per sequence: frame_id, label and what there is of confidence, original_label, smoothed, flagged."""
    cols = ["frame_id", "label", *_have(predictions, "confidence", "original_label", "smoothed", "flagged")]
    predictions.withColumn(key, safe_key(F.col(key))).select(key, *cols).write.mode("overwrite").partitionBy(key).option("header", True).csv(path)


def write_json(predictions: DataFrame, path: str, key: str = "sequence_key", raw_output: bool = False) -> None:
    """A document per sequence: metadata, num_predictions, predictions in order of frames."""
    cols = [c for c in predictions.columns if c != key and (raw_output or c != "raw_output")]
    order = ["frame_id", *[c for c in cols if c != "frame_id"]]
    one = predictions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("predictions"))
    one.select(F.struct(F.col(key).alias("sequence_id")).alias("metadata"), F.size("predictions").alias("num_predictions"), "predictions").write.mode("overwrite").json(path)


def write_coco(predictions: DataFrame, path: str, key: str = "sequence_key") -> None:
    """Annotation documents: a sequence's images and annotations with the fixed categories; unknown labels are 0."""
    code = F.coalesce(F.create_map(*[F.lit(x) for kv in CATEGORIES for x in kv])[F.col("label")], F.lit(0))
    rows = predictions.select(key, F.col("frame_id").alias("id"), code.alias("category_id"))
    one = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "category_id"))).alias("r"))
    images = F.transform("r", lambda x: F.struct(x["id"].alias("id"), F.concat(F.col(key), F.lit("/"), x["id"]).alias("file_name")))
    notes = F.transform("r", lambda x, i: F.struct((i + 1).alias("id"), x["id"].alias("image_id"), x["category_id"].alias("category_id")))
    cats = F.array(*[F.struct(F.lit(c).alias("id"), F.lit(n).alias("name")) for n, c in CATEGORIES])
    one.select(key, images.alias("images"), notes.alias("annotations"), cats.alias("categories")).write.mode("overwrite").partitionBy(key).json(path)


def write_review_queue(flagged: DataFrame, path: str, key: str = "sequence_key") -> None:
    """The flagged frames, a document per sequence."""
    write_json(flagged.where("flagged"), path, key)


def write_list(df: DataFrame, column: str, path: str) -> None:
    """The distinct values of a column, one per line, in `path`/list, and their counts in `path`/counts."""
    values = df.select(F.col(column).cast("string").alias("value"))
    values.where("value is not null").distinct().write.mode("overwrite").text(f"{path}/list")
    values.agg(F.count("*").alias("rows"), F.count("value").alias("values"), F.count_distinct("value").alias("distinct")).write.mode("overwrite").json(f"{path}/counts")


def write_agreement(both: DataFrame, path: str) -> None:
    """Agreed predictions, disagreed frames, the report, and metadata (numbers of frames by status and of
    sequences), side by side."""
    status = lambda x: F.count_if(F.col("status") == x).alias(x)
    both.agg(F.count("*").alias("frames"), F.count_distinct("sequence_id").alias("sequences"), *map(status, ("agreed", "disagreed", "only_in_a", "only_in_b"))).write.mode("overwrite").json(f"{path}/metadata")
    both.where("status = 'agreed'").select("sequence_id", "frame_id", "label", "confidence").write.mode("overwrite").option("header", True).csv(f"{path}/predictions")
    both.where("status = 'disagreed'").drop("label", "confidence", "status").write.mode("overwrite").option("header", True).csv(f"{path}/disagreed")
    agreement_report(both).write.mode("overwrite").json(f"{path}/report")
