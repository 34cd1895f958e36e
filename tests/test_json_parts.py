"""Large JSON documents against Spark's own multi-line reader and against json."""

import json
import random

import pytest
from pyspark.sql import functions as F

from seqloom.sources import json_parts, readers


def listed(text):
    """What read_objects lists of a document."""
    doc, out = json.loads(text), []
    for key, value in doc.items() if isinstance(doc, dict) else [(None, doc)]:
        out += [(key, v) for v in (value if isinstance(value, list) else [value]) if isinstance(v, dict)]
    return sorted((k or "", json.dumps(v, sort_keys=True)) for k, v in out)


def document(r, n):
    odd = ['}', '{"', '\\"', "\\\\", "[]", "é中", "\n", "", "a}b{c", '"}']
    value = lambda d: r.choice([None, 1, -2.5, True, "".join(r.choice(odd) for _ in range(r.randint(0, 4))), *([[value(d - 1) for _ in range(r.randint(0, 3))], {r.choice("abc}"): value(d - 1) for _ in range(r.randint(0, 3))}] if d else [])])
    item = lambda: {"id": r.random(), "x": value(3), "y": [{"z": value(1)}]}
    return {"metadata": {"a": {"b": [1, {"c": "}"}]}, "results": "results"}, "note": "not [ { a key", "results": [item() for _ in range(n)], "n": n, "empty": [], "mixed": [1, "x", item(), [item()], None], "last": item()}


@pytest.mark.parametrize("size", [64, 97, 1000, 1 << 20])
def test_objects_of_documents_in_splits(spark, tmp_path, size):
    r = random.Random(size)
    texts = [json.dumps(document(r, 60), ensure_ascii=k % 2 == 0, indent=[None, 1, 3][k % 3]) for k in range(3)] + ["[{\"a\": 1}, 2, {\"b\": {\"c\": []}}]\n", "{}", "", "{\"results\": []}"]
    for k, t in enumerate(texts):
        (tmp_path / f"d{k}.json").write_text(t)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = json_parts.read_objects(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by = {}
    for x in got:
        by.setdefault(x.path.rsplit("/", 1)[1], []).append((x.key or "", json.dumps(json.loads(x.object), sort_keys=True)))
    for k, t in enumerate(texts):
        assert sorted(by.get(f"d{k}.json", [])) == (listed(t) if t else [])


def test_splits_make_tasks(spark, tmp_path):
    """One file of 20 MB: equal to the multi-line reader, and read by several tasks."""
    seg = [{"label": "left", "start_frame": 0, "end_frame": 2}, {"label": "both", "start_frame": 2, "end_frame": 3}]
    rows = [{"sequence_id": f"s{k}", "track_id": k, "num_frames": 4, "ground_truth": None, "prediction": {"label": "left" + "}" * (k % 3), "segments": seg[: k % 3]}} for k in range(100_000)]
    (tmp_path / "results.json").write_text(json.dumps({"config": {"a": 1}, "results": rows}))
    shape = f"results array<struct<{readers.RESULT.replace(' ', ':').replace(',:', ',')}>>"
    want = spark.read.schema(shape).option("multiLine", True).json(str(tmp_path)).select(F.explode("results").alias("r")).select("r.sequence_id", "r.track_id", "r.num_frames", "r.ground_truth", F.col("r.prediction.label").alias("label"), F.col("r.prediction.segments").alias("segments"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        got = readers.read_results(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 4
        assert got.count() == 100_000
        assert got.exceptAll(want).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
