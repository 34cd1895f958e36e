"""How queries are registered, and the views that they read.

The views are derived from the given tables: Spark builds them with the DataFrame API, the checking SQL
with common table expressions, so the two sides are independent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import shipped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The given tables and derived views of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        return VIEWS[name](self) if name in VIEWS else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def frames(t: Tables) -> DataFrame:
    """Events as frames of tracks: one sequence per user."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = t.events.select("event_id", "user_id", "value", pos.cast("long").alias("pos"))
    user, event = F.col("user_id").cast("long"), F.col("event_id").cast("long")
    b = (F.col("user_id") * 7 + F.floor(F.col("pos") / 6) * 13) % 10
    code = F.when(b <= 5, 0).when(b <= 7, 1).when(b == 8, 2).otherwise(3)
    x1, y1 = event * 37 % 1000, event * 53 % 700
    return e.select(
        F.concat(F.lit("rec"), (user % 12).cast("string"), F.lit("/camera_"), (user % 4).cast("string"), F.lit("_"), user.cast("string")).alias("sequence_id"),
        user.alias("track_id"),
        (F.col("pos") * 2).alias("frame_id"),
        "pos",
        event.alias("event_id"),
        ((50 + event % 50) / F.lit(100.0)).alias("score"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + 60 + event * 31 % 60).alias("x2"),
        (y1 + 40 + event * 17 % 50).alias("y2"),
        F.concat(F.lit("crops/car/"), event.cast("string"), F.lit(".jpg")).alias("crop_path"),
        F.element_at(F.array(*map(F.lit, ("none", "left", "right", "hazard"))), code + 1).alias("true_label"),
        code.alias("true_code"),
        F.col("value").alias("intensity"),
    )


def predictions(t: Tables) -> DataFrame:
    """Three models' labels of the frames, with errors and gaps."""
    models = F.explode(F.array(*[F.struct(F.lit(n).alias("model_name"), F.lit(o).alias("pred_ord"), F.lit(k).alias("k"), F.lit(e).alias("err")) for n, o, k, e in (("model_a", 0, 17, 20), ("model_b", 1, 29, 35), ("model_c", 2, 41, 50))]))
    p = t.frames.withColumn("m", models).where((F.col("event_id") + F.col("m.pred_ord")) % 11 != 0)
    draw = F.col("event_id") * F.col("m.k") % 100
    code = F.when(draw < F.col("m.err"), ((F.col("true_code") + 1 + F.col("event_id") % 3) % 4).cast("int")).otherwise(F.col("true_code"))
    raw = F.when(F.col("code") == 0, "none").when(F.col("code") == 1, "left").when(F.col("code") == 2, "right").when(F.col("event_id") % 2 == 0, "hazard").otherwise("Both ")
    return p.select("sequence_id", "track_id", "frame_id", "pos", "event_id", "m.model_name", "m.pred_ord", code.alias("code"), ((30 + F.col("event_id") * F.col("m.k") % 70) / F.lit(100.0)).alias("confidence")).withColumn("raw_label", raw)


def params(t: Tables) -> DataFrame:
    """Features of a rule classifier, one row per part."""
    key, name = F.col("p_partkey").cast("long"), F.array(*map(F.lit, ("none", "left", "right", "hazard")))
    return t.part.select(key.alias("sequence_key"), (key * 7919 % 20000).cast("double").alias("left_activity"), (key * 104729 % 20000).cast("double").alias("right_activity"), F.element_at(name, (F.col("p_size").cast("int") % 4 + 1)).alias("ground_truth"))


def runs(t: Tables) -> DataFrame:
    """Runs of models with their scores, one row per supplier."""
    key = F.col("s_suppkey").cast("long")
    return t.supplier.select(key.alias("run_id"), F.concat(F.lit("model_"), (F.col("s_nationkey") % 5).cast("string")).alias("model_name"), F.concat(F.lit("202601"), (10 + key % 19).cast("string"), F.lit("_1200"), (10 + key % 49).cast("string")).alias("run_ts"), (key * 37 % 100 / F.lit(100.0)).alias("frame_accuracy"))


VIEWS = {"frames": frames, "predictions": predictions, "params": params, "runs": runs}

_SQL_VIEWS = {
    "frames": """frames AS (
  WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
  t AS (SELECT *, ((user_id * 7 + CAST(floor(pos / 6) AS BIGINT) * 13) % 10)::INT AS b FROM e)
  SELECT 'rec' || (user_id % 12)::VARCHAR || '/camera_' || (user_id % 4)::VARCHAR || '_' || user_id::VARCHAR AS sequence_id,
    user_id::BIGINT AS track_id, (pos * 2)::BIGINT AS frame_id, pos::BIGINT AS pos, event_id::BIGINT AS event_id,
    (50 + event_id % 50)::DOUBLE / 100::DOUBLE AS score, ((event_id * 37) % 1000)::BIGINT AS x1, ((event_id * 53) % 700)::BIGINT AS y1,
    ((event_id * 37) % 1000 + 60 + (event_id * 31) % 60)::BIGINT AS x2, ((event_id * 53) % 700 + 40 + (event_id * 17) % 50)::BIGINT AS y2,
    'crops/car/' || event_id::VARCHAR || '.jpg' AS crop_path,
    CASE WHEN b <= 5 THEN 'none' WHEN b <= 7 THEN 'left' WHEN b = 8 THEN 'right' ELSE 'hazard' END AS true_label,
    CASE WHEN b <= 5 THEN 0 WHEN b <= 7 THEN 1 WHEN b = 8 THEN 2 ELSE 3 END AS true_code, value AS intensity
  FROM t)""",
    "predictions": """predictions AS (
  WITH m AS (SELECT 'model_a' AS model_name, 0 AS pred_ord, 17 AS k, 20 AS err UNION ALL SELECT 'model_b', 1, 29, 35 UNION ALL SELECT 'model_c', 2, 41, 50),
  p AS (SELECT f.sequence_id, f.track_id, f.frame_id, f.pos, f.event_id, m.model_name, m.pred_ord,
      CASE WHEN (f.event_id * m.k) % 100 < m.err THEN ((f.true_code + 1 + f.event_id % 3) % 4)::INT ELSE f.true_code END AS code,
      (30 + (f.event_id * m.k) % 70)::DOUBLE / 100::DOUBLE AS confidence
    FROM frames f CROSS JOIN m WHERE (f.event_id + m.pred_ord) % 11 <> 0)
  SELECT *, CASE code WHEN 0 THEN 'none' WHEN 1 THEN 'left' WHEN 2 THEN 'right' ELSE CASE WHEN event_id % 2 = 0 THEN 'hazard' ELSE 'Both ' END END AS raw_label FROM p)""",
    "params": """params AS (
  SELECT p_partkey::BIGINT AS sequence_key, (p_partkey * 7919 % 20000)::DOUBLE AS left_activity, (p_partkey * 104729 % 20000)::DOUBLE AS right_activity,
    CASE p_size::INT % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'left' WHEN 2 THEN 'right' ELSE 'hazard' END AS ground_truth FROM part)""",
    "runs": """runs AS (
  SELECT s_suppkey::BIGINT AS run_id, 'model_' || (s_nationkey % 5)::VARCHAR AS model_name,
    '202601' || (10 + s_suppkey % 19)::VARCHAR || '_1200' || (10 + s_suppkey % 49)::VARCHAR AS run_ts,
    (s_suppkey * 37 % 100)::DOUBLE / 100::DOUBLE AS frame_accuracy FROM supplier)""",
    # The predictions with harmonised labels, and the same without a model's gaps in the truth.
    "labelled": """labelled AS (
  SELECT * EXCLUDE (raw_label, code), CASE WHEN lower(trim(raw_label)) IN ('both', 'signal', 'multiple') THEN 'hazard' WHEN lower(trim(raw_label)) IN ('none', 'left', 'right', 'hazard') THEN lower(trim(raw_label)) ELSE 'none' END AS label
  FROM predictions)""",
    "domain": "domain AS (SELECT unnest(['none', 'left', 'right', 'hazard']) AS label)",
}
_NEEDS = {"predictions": ["frames"], "labelled": ["frames", "predictions"]}


def query(sql: str | None = None, *views: str):
    """Register a function of Tables under its own name, with DuckDB SQL over the named views."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = shipped(lambda spark, sf_dir: f(Tables(spark, sf_dir)))
        if sql is not None:
            needed: list[str] = []
            for v in views:
                needed += [x for x in [*_NEEDS.get(v, []), v] if x not in needed]
            body = sql.strip()
            if needed:
                ctes = ",\n".join(_SQL_VIEWS[v] for v in needed)
                start = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.upper().startswith(w)), None)
                body = f"{start}{ctes},\n{body[len(start) :]}" if start else f"WITH {ctes}\n{body}"
            SQL[f.__name__] = body
        return f

    return put
