import itertools
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.operators import assignment, fusion, models, rules, tracks
from seqloom.sources import images, readers, sinks
from seqloom.streaming import jobs

HEAD = ",".join(readers.FRAME_COLUMNS)


def test_frame_table(spark, tmp_path):
    (tmp_path / "f.csv").write_text(f"{HEAD},true_label\nrec,1,2,3,0.5,1,2,3,4,c.jpg,i.jpg,640,480,rec/cam_1, None\n")
    r = readers.read_frames(spark, str(tmp_path / "f.csv")).first()
    assert r.track_id == 1 and r.true_label is None and r.sampled_frame_id is None
    (tmp_path / "bad.csv").write_text("sequence\nx\n")
    with pytest.raises(ValueError, match="track_id"):
        readers.read_frames(spark, str(tmp_path / "bad.csv"))


def test_prediction_files(spark, tmp_path):
    d = tmp_path / "run"
    d.mkdir()
    (d / "a_camera_w__track_7.csv").write_text("frame_id,label,confidence\n0,Both ,1.5\n1,odd,\n")
    (d / "x.json").write_text(json.dumps({"metadata": {"sequence_id": "v/cam"}, "predictions": [{"frame_id": 3, "label": "left", "confidence": 0.4}]}))
    (d / "summary.json").write_text("{}")
    got = {(r.sequence_id, r.frame_id): (r.label, r.confidence) for r in readers.read_predictions(spark, str(d), "m").collect()}
    assert got == {("a/camera_w_7", 0): ("hazard", 1.0), ("a/camera_w_7", 1): ("none", 0.5), ("v/cam", 3): ("left", 0.4)}


def test_results_and_dispatch(spark, tmp_path):
    seg = [{"label": "left", "start_frame": 0, "end_frame": 2}, {"label": "both", "start_frame": 2, "end_frame": 3}]
    rows = [{"sequence_id": "s", "track_id": 1, "num_frames": 4, "prediction": {"label": "left", "segments": seg}}, {"sequence_id": "t", "track_id": 2, "num_frames": 2, "prediction": {"label": "right", "segments": []}}]
    (tmp_path / "results.json").write_text(json.dumps({"results": rows}))
    got = readers.read_any_predictions(spark, str(tmp_path), "m").orderBy("sequence_id", "frame_id").collect()
    assert [(r.sequence_id, r.frame_id, r.label) for r in got][:3] == [("s", 0, "left"), ("s", 1, "left"), ("s", 2, "left")] or len(got) == 7
    assert len(got) == 7
    (tmp_path / "frame_predictions.csv").write_text("sequence_id,track_id,frame_id,label\ns,1,0,right\n")
    assert readers.read_any_predictions(spark, str(tmp_path), "m").first().label == "right"


def test_truth_last_wins(spark, tmp_path):
    (tmp_path / "t.csv").write_text("sequence_id,frame_id,true_label\ns,1,left\ns,1,right\n")
    assert [r.true_label for r in readers.read_truth(spark, str(tmp_path / "t.csv")).collect()] == ["right"]


def test_lists_and_latest_runs(spark, tmp_path):
    (tmp_path / "p.txt").write_text("a b.jpg 1\n\nplain\nc.jpg 0\n")
    assert readers.read_path_list(spark, str(tmp_path / "p.txt")).count() == 3
    assert {(r.path, r.label) for r in readers.read_labelled_paths(spark, str(tmp_path / "p.txt")).collect()} == {("a b.jpg", 1), ("c.jpg", 0)}
    paths = spark.createDataFrame([("/r/m1/20260101_120000",), ("/r/m1/video/20260102_120000",), ("/r/m2/20250101_000000/",), ("/r/m2/other",)], "path string")
    assert {(r.model_name, r.path[-15:].strip("/")) for r in readers.latest_runs(paths).collect()} >= {("m1", "20260102_120000")}


def test_coco_zip_and_labels(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 2}], "categories": [{"id": 2, "name": "car"}]}
    (tmp_path / "g" / "s1").mkdir(parents=True)
    (tmp_path / "g" / "s1" / "a.json").write_text(json.dumps(doc))
    r = readers.read_coco(spark, str(tmp_path / "g" / "*" / "*.json")).first()
    assert (r.group, r.scenario, r.category) == ("g", "s1", "car")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.json", json.dumps(doc))
        z.writestr("in/a.txt", "no")
    assert [x.member for x in readers.read_zipped(spark, str(tmp_path / "z.zip")).collect()] == ["in/a.json"]
    (tmp_path / "000123.txt").write_text("2 0.5 0.5 0.1 0.2 0.9\nbad\n1 0.1 0.1 0.1 0.1\n")
    got = [(x.frame, x.line_idx, x.class_id, x.score) for x in readers.read_detector_labels(spark, str(tmp_path / "000123.txt")).orderBy("line_idx").collect()]
    assert got == [("000123", 0, 2, 0.9), ("000123", 2, 1, 1.0)]


def test_sinks_read_back(spark, tmp_path):
    p = spark.createDataFrame([("a/b__track_1", 2, "left", 0.5, True, "raw"), ("a/b__track_1", 0, "odd", 0.4, False, "raw")], "sequence_key string, frame_id long, label string, confidence double, flagged boolean, raw_output string")
    sinks.write_csv(p, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 2 and "raw_output" not in back.columns and back.first().sequence_key == "a_b__track_1"
    sinks.write_json(p, str(tmp_path / "json"))
    doc = spark.read.json(str(tmp_path / "json")).first()
    assert doc.num_predictions == 2 and [x.frame_id for x in doc.predictions] == [0, 2]
    sinks.write_review_queue(p, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).first().num_predictions == 1
    sinks.write_coco(p, str(tmp_path / "coco"))
    assert sorted(x.category_id for x in spark.read.json(str(tmp_path / "coco")).first().annotations) == [0, 1]
    sinks.write_list(p, "label", str(tmp_path / "list"))
    assert spark.read.text(str(tmp_path / "list" / "list")).count() == 2
    assert spark.read.json(str(tmp_path / "list" / "counts")).first().distinct == 2
    a = p.select(F.lit("s").alias("sequence_id"), "frame_id", "label", "confidence")
    sinks.write_agreement(fusion.agreement(a, a), str(tmp_path / "agree"))
    assert spark.read.json(str(tmp_path / "agree/report")).first().agreed == 2
    meta = spark.read.json(str(tmp_path / "agree/metadata")).first()
    assert (meta.frames, meta.agreed, meta.disagreed, meta.sequences) == (2, 2, 0, 1)


def test_parts_and_metrics(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"part_{k}.csv").write_text(f"x\n{k}\n")
    assert {r.part for r in readers.read_parts(spark, str(tmp_path / "part_*.csv")).collect()} == {"part_1", "part_2"}
    (tmp_path / "m" / "r1").mkdir(parents=True)
    (tmp_path / "m" / "r1" / "eval.json").write_text(json.dumps({"model": "a", "accuracy": 0.5, "frame_metrics": {"accuracy": 0.6, "macro_f1": 0.4}}))
    r = readers.read_run_metrics(spark, str(tmp_path / "m")).first()
    assert r.frame_metrics.macro_f1 == 0.4 and r.run_dir.endswith("r1")
    runs = readers.read_run_metrics(spark, str(tmp_path / "m")).select("run_dir", "accuracy")
    other = spark.createDataFrame([(r.run_dir, 0.7), ("elsewhere", 0.1)], "run_dir string, accuracy double")
    got = {x.run_dir: (x.eval_accuracy, x.model_accuracy) for x in readers.compare_runs(runs, other).collect()}
    assert got == {r.run_dir: (0.5, 0.7), "elsewhere": (None, 0.1)}


def test_hand_annotations(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"image": "x.jpg", "turn_signal": "left"}, {"image": "y.jpg", "tail_light": "on", "more": 1}]))
    got = readers.read_annotations(spark, str(tmp_path / "a.json")).orderBy("image").collect()
    assert [tuple(x) for x in got] == [("x.jpg", "left", None), ("y.jpg", None, "on")]


def image_rows(spark):
    left = np.zeros((60, 100, 3), np.uint8)
    left[40:50, :20] = (0, 220, 255)  # yellow, BGR
    tall = np.zeros((100, 60, 3), np.uint8)
    rows = [("l", 100, 60, 3, bytearray(left.tobytes())), ("t", 60, 100, 3, bytearray(tall.tobytes()))]
    return spark.createDataFrame(rows, "origin string, width int, height int, channels int, data binary")


def test_image_jobs(spark):
    df = image_rows(spark)
    assert [r.origin for r in readers.landscape(df).collect()] == ["l"]
    e = {r.origin: r for r in images.colour_energy(df).collect()}
    assert e["l"].whole_energy == e["l"].left_energy == 200 * 255 and e["l"].right_energy == 0 and e["t"].whole_energy == 0
    ranges = spark.createDataFrame([(0, 15, 35, 100, 100), (1, 60, 90, 100, 100)], "range_id int, h0 int, h1 int, s0 int, v0 int")
    got = {(r.origin, r.range_id): r.energy for r in images.range_energies(images.colour_histogram(df), ranges).collect()}
    assert got[("l", 0)] == 200 * 255 and got[("l", 1)] == 0
    for variant in images.VARIANTS:
        n = images.normalised(df, 16, variant).collect()
        assert all(len(r["values"]) == 16 * 16 * 3 and 0 <= min(r["values"]) and max(r["values"]) <= 1 for r in n)
    n = images.normalised(df, 4).withColumn("k", F.lit("a"))
    assert len(images.difference_maps(n, "k", "origin").first().difference) == 48


def test_inference_failures_become_rows(spark):
    def predict(pdf):
        if (pdf["k"] == 3).any():
            raise RuntimeError("no")
        return pdf.assign(label="left", confidence=1.0, raw_output="")[["k", "label", "confidence", "raw_output"]]

    got = images.infer(spark.range(6, numPartitions=6).withColumnRenamed("id", "k"), predict, "k long, label string, confidence double, raw_output string", ["k"]).collect()
    assert {r.k: r.label for r in got} == {k: "error" if k == 3 else "left" for k in range(6)}


def test_energies_equal_pixel_counts(spark):
    """Summed volumes against counting pixels, for ranges on and off the edges of bins, also beyond the scale."""
    r = np.random.default_rng(3)
    pictures = {f"i{k}": r.integers(0, 256, (20 + k, 30, 3)).astype(np.uint8) for k in range(3)}
    df = spark.createDataFrame([(k, 30, len(p), 3, bytearray(p.tobytes())) for k, p in pictures.items()], "origin string, width int, height int, channels int, data binary")
    rows = [(0, 0, 179, 0, 255, 0, 255), (1, 10, 40, 50, 200, 100, 255), (2, 0, 0, 0, 0, 0, 0), (3, 175, 300, 255, 300, 0, 255), (4, 60, 20, 0, 255, 0, 255), (5, -5, 90, 3, 77, 4, 78)]
    rows += [(6 + k, *sorted(r.integers(0, 180, 2).tolist()), *sorted(r.integers(0, 256, 2).tolist()), *sorted(r.integers(0, 256, 2).tolist())) for k in range(40)]
    names = "range_id int, h0 int, h1 int, s0 int, s1 int, v0 int, v1 int"
    for step in (5, 7):
        hist = images.colour_histogram(df, step)
        got = {(x.origin, x.range_id): x.energy for x in images.range_energies(hist, spark.createDataFrame(rows, names), step).collect()}
        bins = {k: images.hsv(p).reshape(-1, 3).astype(int) // step * step for k, p in pictures.items()}
        for k, b in bins.items():
            for i, h0, h1, s0, s1, v0, v1 in rows:
                assert got[k, i] == 255 * int(((b >= (h0, s0, v0)) & (b <= (h1, s1, v1))).all(axis=1).sum()), (k, i)
        assert len(got) == len(rows) * 3
        assert images.colour_volumes(hist, step).count() == 3


def test_only_rows_at_fault_are_errors(spark):
    calls = spark.sparkContext.accumulator(0)

    def predict(pdf):
        calls.add(1)
        if pdf["k"].isin([3, 700, 701]).any():
            raise RuntimeError("no")
        return pdf.assign(label="left", confidence=1.0, raw_output="")[["k", "label", "confidence", "raw_output"]]

    got = images.infer(spark.range(1000, numPartitions=1).withColumnRenamed("id", "k"), predict, "k long, label string, confidence double, raw_output string", ["k"]).collect()
    assert len(got) == 1000 and {r.k for r in got if r.label == "error"} == {3, 700, 701}
    assert calls.value < 70


def test_models_are_loaded_once_for_each_worker(spark):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda pdf: pdf.assign(label="left", confidence=1.0, raw_output="")[["k", "label", "confidence", "raw_output"]]

    df = spark.range(40, numPartitions=40).withColumnRenamed("id", "k")
    assert images.infer(df, load, "k long, label string, confidence double, raw_output string", ["k"], load=True).where("label = 'left'").count() == 40
    assert 0 < loads.value < 20


def test_stream_reads_each_file_once(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("src", "out", "chk"))
    spark.range(10).write.parquet(f"{src}/a")
    schema = spark.range(1).schema
    run = lambda: jobs.append_new_files(spark, f"{src}/*", schema, lambda d: d.withColumn("y", F.col("id") * 2), out, chk).awaitTermination()
    run()
    run()
    assert spark.read.parquet(out).count() == 10
    spark.range(10, 15).write.parquet(f"{src}/b")
    run()
    assert spark.read.parquet(out).count() == 15
    assert jobs.unprocessed(spark.range(20), spark.read.parquet(out), "id").count() == 5


def test_reviews_keep_the_latest(spark, tmp_path):
    src, chk = (str(tmp_path / x) for x in ("src", "chk"))
    make = lambda *rows: spark.createDataFrame(rows, "sequence_id string, label string, reviewed_at long").coalesce(1)
    first = make(("a", "left", 1), ("b", "none", 1))
    first.write.parquet(f"{src}/1")
    jobs.upsert_reviews(spark, f"{src}/*", first.schema, chk).awaitTermination()
    make(("a", "right", 2), ("c", "none", 2), ("b", "left", 0)).write.parquet(f"{src}/2")
    jobs.upsert_reviews(spark, f"{src}/*", first.schema, chk).awaitTermination()
    labels = lambda **at: {r.sequence_id: r.label for r in jobs.read_reviews(spark, chk, **at).collect()}
    assert labels() == {"a": "right", "b": "none", "c": "none"}
    assert labels(batch=0) == {"a": "left", "b": "none"}
    assert jobs.unprocessed(make(("a", "", 0), ("d", "", 0)), jobs.read_reviews(spark, chk), "sequence_id").count() == 1


def files(folder):
    return {str(p): p.stat().st_size for p in folder.rglob("*") if p.is_file() and p.suffix != ".crc"}


def test_a_batch_of_reviews_writes_what_it_changes(spark, tmp_path):
    src, chk = str(tmp_path / "src"), tmp_path / "chk"
    many = spark.range(60_000).select(F.concat(F.lit("sequence "), "id").alias("sequence_id"), F.sha2(F.col("id").cast("string"), 256).alias("label"), F.lit(1).cast("long").alias("reviewed_at"))
    run = lambda: jobs.upsert_reviews(spark, f"{src}/*", many.schema, str(chk)).awaitTermination()
    many.write.parquet(f"{src}/1")
    run()
    before = files(chk / "state")
    many.where("sequence_id = 'sequence 7'").withColumn("reviewed_at", F.lit(2).cast("long")).withColumn("label", F.lit("left")).coalesce(1).write.parquet(f"{src}/2")
    run()
    wrote = sum(n for p, n in files(chk / "state").items() if p not in before)
    assert 0 < wrote < sum(before.values()) / 50
    got = jobs.read_reviews(spark, str(chk))
    assert got.count() == 60_000 and got.where("label = 'left'").count() == 1


def test_reviews_after_a_killed_run(spark, tmp_path):
    """A run that dies before its batch is committed leaves the batch to the next run."""
    src, chk = str(tmp_path / "src"), tmp_path / "chk"
    make = lambda *rows: spark.createDataFrame(rows, "sequence_id string, label string, reviewed_at long").coalesce(1)
    first = make(("a", "left", 1))
    run = lambda: jobs.upsert_reviews(spark, f"{src}/*", first.schema, str(chk)).awaitTermination()
    first.write.parquet(f"{src}/1")
    run()
    make(("a", "right", 2), ("b", "none", 2)).write.parquet(f"{src}/2")
    run()
    want = sorted(map(tuple, jobs.read_reviews(spark, str(chk)).collect()))
    for p in (chk / "commits").iterdir():
        if p.name.strip(".").split(".")[0] == "1":
            p.unlink()
    run()
    assert sorted(map(tuple, jobs.read_reviews(spark, str(chk)).collect())) == want == [("a", 2, "right"), ("b", 2, "none")]
    assert (chk / "commits" / "1").exists()


def test_tracker_links_and_confirms(spark):
    rows = [("r", f, 10 * f + k, 0.9, 100.0 * k + f, 0.0, 100.0 * k + f + 50, 50.0) for f in range(6) for k in range(2)]
    rows += [("r", 3, 99, 0.9, 900.0, 900.0, 950.0, 950.0), ("r", 2, 98, 0.1, 0.0, 0.0, 5.0, 5.0)]
    got = tracks.link_boxes(spark.createDataFrame(rows, "sequence string, frame_id long, det_id long, score double, x1 double, y1 double, x2 double, y2 double")).collect()
    by = {r.det_id: r.track_id for r in got}
    assert 99 not in by and 98 not in by and len(by) == 12
    assert all(by[10 * f + k] == by[k] for f in range(6) for k in range(2)) and by[0] != by[1]


@pytest.mark.parametrize("least", [0.8, 0.3, 0.5])
def test_best_match_meets_all_pairs(spark, least):
    """Boxes of very unlike sizes, on the edges of cells, equal ones and empty ones, against all pairs."""
    r = np.random.default_rng(8)
    rows = []
    for frame in range(3):
        corner, size = r.integers(-64, 64, (60, 2)) * r.choice([1, 0.5, 0.1]), 2.0 ** r.integers(-3, 7, (60, 2)) * r.choice([1.0, 0.9, 1.1], (60, 2))
        boxes = np.hstack([corner, corner + size])
        moved = boxes + r.normal(0, 0.05, boxes.shape) * np.hstack([size, size]) * (r.random((60, 1)) < 0.7)
        rows += [(frame, k, *map(float, b), *map(float, m)) for k, (b, m) in enumerate(zip(boxes, moved))]
        rows += [(frame, 98, 1.0, 1.0, 1.0, 5.0, 1.0, 1.0, 1.0, 5.0), (frame, 99, *rows[-1][2:6], *rows[-1][6:])]
    df = spark.createDataFrame(rows, "f int, k long, ax1 double, ay1 double, ax2 double, ay2 double, bx1 double, by1 double, bx2 double, by2 double")
    side = lambda p, name: df.select("f", F.col("k").alias(name), *[F.col(f"{p}{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    got = {(x.f, x.det_id): (x.trk_id, round(x.iou, 9)) for x in tracks.best_match(side("a", "det_id"), side("b", "trk_id"), ["f"], least).collect()}
    want = {}
    for f, k, *a in rows:
        ways = [(-assignment.overlap(a[:4], b[6:]), b[1]) for b in rows if b[0] == f]
        o, trk = min(ways)
        if -o >= least:
            want[f, k] = (trk, round(-o, 9))
    assert got == want and len(want) > 30


def test_near_pairs_are_all_pairs():
    r = np.random.default_rng(5)
    for scale, least in ((30, 0.3), (200, 0.05), (5, 0.8), (0.01, 0.3)):
        corner, size = r.uniform(-100, 100, (120, 2)), r.uniform(0, 1, (120, 2)) ** 3 * scale
        boxes = np.hstack([corner, corner + size]).tolist() + [[0, 0, 0, 0], [5, 5, 4, 9]]
        a, b = boxes[:60] + boxes[120:], boxes[60:] + boxes[:20]
        want = sorted((i, k, assignment.overlap(x, y)) for i, x in enumerate(a) for k, y in enumerate(b) if assignment.overlap(x, y) >= least)
        assert sorted(assignment.near_pairs(a, b, least)) == want


def test_pairs_have_the_largest_weight():
    r = np.random.default_rng(6)
    for _ in range(150):
        n, m = map(int, r.integers(1, 5, 2))
        pairs = [(i, k, round(float(r.uniform(-0.2, 1)), 3)) for i in range(n) for k in range(m) if r.random() < 0.6]
        weight = {(i, k): w for i, k, w in pairs}
        got = assignment.best_pairs(pairs)
        assert len({i for i, _ in got}) == len({k for _, k in got}) == len(got)
        best = max(sum(max(weight.get((i, k), 0), 0) for i, k in zip(range(n), p) if k < m) for p in itertools.permutations(range(m + n), n))
        assert abs(sum(weight[p] for p in got) - best) < 1e-9


def test_crowded_frames(spark):
    """10,000 boxes in each frame that move a little: all are followed, and few pairs are looked at."""
    r = np.random.default_rng(7)
    corner, size = r.uniform(0, 4000, (10_000, 2)), r.uniform(20, 40, (10_000, 2))
    frames = [corner + f * r.normal(0, 0.5, corner.shape) for f in range(3)]
    assert len(assignment.near_pairs(np.hstack([frames[0], frames[0] + size]).tolist(), np.hstack([frames[1], frames[1] + size]).tolist(), 0.3)) < 60_000
    pdf = pd.concat([pd.DataFrame({"sequence": "r", "frame_id": f, "det_id": f * 10_000 + np.arange(10_000), "score": 0.9, "x1": c[:, 0], "y1": c[:, 1], "x2": c[:, 0] + size[:, 0], "y2": c[:, 1] + size[:, 1]}) for f, c in enumerate(frames)])
    got = tracks.link_boxes(spark.createDataFrame(pdf), confirm=1).toPandas().set_index("det_id").track_id.sort_index()
    right = (got.loc[:9_999].to_numpy() == got.loc[10_000:19_999].to_numpy()).mean()
    assert len(got) == 30_000 and right > 0.995


def test_appearance_tells_crossing_tracks_apart(spark):
    """Two boxes that change places between frames: vectors decide, overlap alone does not."""
    look = {0: [1.0, 0.0], 1: [0.0, 1.0]}
    rows = [("r", f, 2 * f + k, 0.9, 10.0 * (k if f < 2 else 1 - k), 0.0, 10.0 * (k if f < 2 else 1 - k) + 50, 50.0, look[k]) for f in range(4) for k in range(2)]
    df = spark.createDataFrame(rows, "sequence string, frame_id long, det_id long, score double, x1 double, y1 double, x2 double, y2 double, look array<double>")
    with_look = {r.det_id: r.track_id for r in tracks.link_boxes(df, appearance="look").collect()}
    without = {r.det_id: r.track_id for r in tracks.link_boxes(df).collect()}
    assert all(with_look[2 * f + k] == with_look[k] for f in range(4) for k in range(2))
    assert without[6] == without[1]


def test_classifier_and_rule(spark):
    rows = [(float(k % 2), [float(k % 2) * 3 + (k % 7) * 0.1, 1.0]) for k in range(60)]
    df = spark.createDataFrame(rows, "label double, features array<double>")
    out = models.predict_windows(models.fit_windows(df), df)
    assert out.where("prediction = label").count() == 60
    blink = [100.0 + 80 * (k // 5 % 2) for k in range(40)]
    s = spark.createDataFrame([(blink, [100.0] * 40), ([100.0] * 40, [100.0] * 40)], "left array<double>, right array<double>")
    s = s.select("*", *rules.activity(F.col("left"), F.col("right")))
    assert [r.label for r in rules.classify(s, "left", 10.0, 0.7).collect()] == ["left", "none"]


def test_image_resolution(spark):
    frames = spark.createDataFrame([("/d/a.jpg",), ("b.jpg",), ("x/c.jpg",), ("no.jpg",)], "crop_path string")
    imgs = spark.createDataFrame([("file:///d/a.jpg", 1), ("file:///base/b.jpg", 2), ("file:///base/c.jpg", 3)], "origin string, width int")
    got = {r.crop_path: r.image.width if r.image else None for r in readers.resolve_images(frames, imgs, base="/base").collect()}
    assert got == {"/d/a.jpg": 1, "b.jpg": 2, "x/c.jpg": 3, "no.jpg": None}
