"""File readers. Paths go to Spark's own readers only, so any store that Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import canonical_sequence_id
from ..functions.labels import PLACEHOLDERS, harmonize_label
from ..operators.fusion import first_per
from .json_parts import read_objects
from .zips import read_members

FRAME_COLUMNS = {"sequence": "string", "track_id": "long", "frame_id": "long", "class_id": "int", "score": "double", "x1": "double", "y1": "double", "x2": "double", "y2": "double", "crop_path": "string", "img_path": "string", "width": "int", "height": "int", "sequence_id": "string"}
OPTIONAL_COLUMNS = {"true_label": "string", "sampled_frame_id": "long", "signal_start_frame": "long"}
#: Names of files beside predictions that hold none.
NOT_PREDICTIONS = "(?i)(summary|report|review|metadata|config|metrics)"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """The frame table: missing required columns raise, missing optional ones are null, and a truth of
    placeholders only is blanked."""
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in FRAME_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    cols = [F.col(c).cast(k).alias(c) for c, k in FRAME_COLUMNS.items()]
    cols += [(F.col(c) if c in raw.columns else F.lit(None)).cast(k).alias(c) for c, k in OPTIONAL_COLUMNS.items()]
    return blank_placeholders(raw.select(*cols), "true_label")


def blank_placeholders(df: DataFrame, label: str) -> DataFrame:
    """Null for the whole column if it holds placeholders only."""
    empty = df.agg(F.bool_and(F.coalesce(F.lower(F.trim(label)).isin(*PLACEHOLDERS), F.lit(True))).alias("__blank"))
    return df.crossJoin(F.broadcast(empty)).withColumn(label, F.when(~F.col("__blank"), F.col(label))).drop("__blank")


def _stem(path: Column | None = None) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path") if path is None else path, "/"), -1), r"\.[A-Za-z]+$", "")


def read_predictions(spark: SparkSession, path: str, model: str) -> DataFrame:
    """A folder of one CSV or JSON file per sequence. The id is the file's stem, or the one in its metadata;
    labels and ids are normalised; files named like reports are passed over. A JSON file of any size is read by as
    many tasks as it has splits."""
    found = read_objects(spark, path, "*.json").withColumn("stem", _stem(F.col("path"))).where(~F.col("stem").rlike(NOT_PREDICTIONS))
    parsed = lambda key, shape: found.where(F.col("key") == key).select("path", "stem", F.from_json("object", shape).alias("p"))
    ids = parsed("metadata", "sequence_id string").select("path", F.col("p.sequence_id").alias("id"))
    js = parsed("predictions", "frame_id long, label string, confidence double, raw_output string").join(ids, "path", "left").select(F.coalesce("id", "stem").alias("id"), "p.*")
    cs = spark.read.option("header", True).option("pathGlobFilter", "*.csv").schema("frame_id long, label string, confidence double").option("enforceSchema", False).csv(path).withColumn("id", _stem())
    cs = cs.where(~F.col("id").rlike(NOT_PREDICTIONS)).withColumn("raw_output", F.lit(None).cast("string"))
    both = js.unionByName(cs.select(*js.columns))
    conf = F.least(F.greatest(F.coalesce("confidence", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    return both.select(canonical_sequence_id(F.col("id")).alias("sequence_id"), "frame_id", F.lit(model).alias("model_name"), harmonize_label(F.col("label")).alias("label"), conf.alias("confidence"), "raw_output")


RESULT = "sequence_id string, track_id long, num_frames int, ground_truth string, prediction struct<label:string,segments:array<struct<label:string,start_frame:int,end_frame:int>>>"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Nested results: one row per sequence with its label and segments. A file of any size is read by as many
    tasks as it has splits."""
    r = read_objects(spark, path).where("key = 'results'").select(F.from_json("object", RESULT).alias("r"))
    return r.select("r.sequence_id", "r.track_id", "r.num_frames", "r.ground_truth", F.col("r.prediction.label").alias("label"), F.col("r.prediction.segments").alias("segments"))


def result_frames(results: DataFrame) -> DataFrame:
    """Results as one row per frame: segments as they are (all that overlap), else the overall label."""
    own = F.when(F.size("segments") > 0, F.col("segments")).otherwise(F.array(F.struct("label", F.lit(0).alias("start_frame"), (F.col("num_frames") - 1).alias("end_frame"))))
    s = results.select("sequence_id", "track_id", F.posexplode(own).alias("seg_ord", "s"))
    return s.where("s.start_frame <= s.end_frame").select("sequence_id", "track_id", "seg_ord", harmonize_label(F.col("s.label")).alias("label"), F.explode(F.sequence(F.col("s.start_frame").cast("long"), F.col("s.end_frame").cast("long"))).alias("frame_id"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file matches, asked through Hadoop's file systems."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def read_any_predictions(spark: SparkSession, run_dir: str, model: str) -> DataFrame:
    """A run's frame predictions: frame_predictions.csv, else results.json, else files per sequence."""
    cols = ["sequence_id", "frame_id", "model_name", "label"]
    if exists(spark, f"{run_dir}/frame_predictions.csv"):
        df = spark.read.option("header", True).csv(f"{run_dir}/frame_predictions.csv")
        return df.select("sequence_id", F.col("frame_id").cast("long").alias("frame_id"), F.lit(model).alias("model_name"), harmonize_label(F.col("label")).alias("label"))
    if exists(spark, f"{run_dir}/results.json"):
        return result_frames(read_results(spark, f"{run_dir}/results.json")).withColumn("model_name", F.lit(model)).select(*cols)
    return read_predictions(spark, run_dir, model).select(*cols)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """True labels from a column label or true_label; the last of repeated frames counts: files by name, rows by
    their place in them."""
    raw = spark.read.option("header", True).csv(path)
    name = next(c for c in ("label", "true_label") if c in raw.columns)
    rows = raw.select("sequence_id", F.col("frame_id").cast("long").alias("frame_id"), harmonize_label(F.col(name)).alias("true_label"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("__line"))
    return first_per(rows, ("sequence_id", "frame_id"), F.desc("__line")).drop("__line")


def latest_runs(paths: DataFrame) -> DataFrame:
    """paths(path) like .../MODEL/.../YYYYMMDD_HHMMSS to the newest of each model: model_name, path."""
    p = F.regexp_extract("path", r"(\d{8}_\d{6})/?$", 1)
    m = F.regexp_extract("path", r"([^/]+)/(?:[^/]+/)?\d{8}_\d{6}/?$", 1)
    return paths.where(p != "").groupBy(m.alias("model_name")).agg(F.max_by("path", p).alias("path"))


def read_path_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def read_labelled_paths(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a path and a whole number, split at the last space."""
    v = F.col("value")
    return spark.read.text(path).where(v.rlike(r"^.* \d+\s*$")).select(F.regexp_extract(v, r"^(.*) (\d+)\s*$", 1).alias("path"), F.regexp_extract(v, r"^(.*) (\d+)\s*$", 2).cast("int").alias("label"))


COCO = "images array<struct<id:long,file_name:string>>, annotations array<struct<id:long,image_id:long,category_id:int>>, categories array<struct<id:int,name:string>>"


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """One row per annotation with its category's name; group and scenario from the path."""
    raw = spark.read.schema(COCO).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    part = F.split("path", "/")
    names = F.map_from_entries(F.transform("categories", lambda c: F.struct(c["id"], c["name"])))
    rows = raw.select(F.element_at(part, -3).alias("group"), F.element_at(part, -2).alias("scenario"), names.alias("names"), F.explode("annotations").alias("a"))
    return rows.select("group", "scenario", "a.image_id", F.element_at("names", F.col("a.category_id")).alias("category"))


def read_zipped(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """Members of zip files as rows: archive, member, text. Archives of any size are read by as many tasks as they
    have splits: the reader cuts them before each member, and a task holds one member at a time (see zips)."""
    return read_members(spark, path, suffix)


def read_detector_labels(spark: SparkSession, path: str) -> DataFrame:
    """Detection lines `class cx cy w h [score]`; line_idx counts lines from 0, those of under five fields
    are dropped, the score is 1 if missing."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("frame"), F.posexplode(F.split("value", "\n")).alias("line_idx", "line"))
    f = F.split(F.trim("line"), r"\s+")
    num = lambda k: F.get(f, F.lit(k)).try_cast("double")
    return raw.where(F.size(f) >= 5).select("frame", "line_idx", num(0).cast("int").alias("class_id"), num(1).alias("cx"), num(2).alias("cy"), num(3).alias("w"), num(4).alias("h"), F.coalesce(num(5), F.lit(1.0)).alias("score"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("image string, turn_signal string, tail_light string").option("multiLine", True).json(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images: origin, width, height, channels and BGR bytes."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path)
    return raw.select(F.col("image.origin").alias("origin"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def landscape(images: DataFrame, least: int = 50) -> DataFrame:
    """Images wider than high, with both sides over `least`."""
    return images.where((F.col("width") > least) & (F.col("height") > least) & (F.col("width") > F.col("height")))


def resolve_images(frames: DataFrame, images: DataFrame, path: str = "crop_path", base: str = "") -> DataFrame:
    """Frames with their image, found by the path as it is, under the base, or by name under the base. Which image
    a path stands for is settled with names alone; then each image's bytes are moved once."""
    origin = F.regexp_replace("origin", r"^file:/*", "/").alias("__o")
    tries = [F.col("__p"), F.concat(F.lit(f"{base}/"), F.col("__p")), F.concat(F.lit(f"{base}/"), F.element_at(F.split("__p", "/"), -1))]
    paths = frames.select(F.col(path).alias("__p")).where("__p is not null").distinct()
    named = paths.select("__p", F.posexplode(F.array(*tries)).alias("__k", "__o")).join(images.select(origin).distinct(), "__o")
    found = named.groupBy("__p").agg(F.min_by("__o", "__k").alias("__o"))
    out = frames.join(found, F.col(path) == F.col("__p"), "left").drop("__p")
    return out.join(images.select(origin, F.struct(*images.columns).alias("image")), "__o", "left").drop("__o")


def read_run_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Run summaries under a folder, with the folder of each."""
    shape = "prompt_file string, timestamp string, model string, inference_mode string, num_sequences long, accuracy double, frame_metrics struct<accuracy:double,macro_f1:double>, event_metrics struct<precision:double,recall:double,f1:double>"
    raw = spark.read.schema(shape).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return raw.withColumn("run_dir", F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1))


def compare_runs(evaluations: DataFrame, models: DataFrame, key: str = "run_dir") -> DataFrame:
    """Evaluation and model metrics of runs side by side, by the folder they are in; a run that has one kind
    only has nulls for the other, and columns of both are told apart by prefix."""
    e = evaluations.select(key, *[F.col(f"`{c}`").alias(f"eval_{c}") for c in evaluations.columns if c != key])
    m = models.select(key, *[F.col(f"`{c}`").alias(f"model_{c}") for c in models.columns if c != key])
    return e.join(m, key, "full")


def read_parts(spark: SparkSession, glob: str) -> DataFrame:
    """Checkpoint parts as one table, with the part each row came from; parts sort by name."""
    return spark.read.option("header", True).csv(glob).withColumn("part", _stem())
