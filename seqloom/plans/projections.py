"""Queries for scalar expressions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, boxes, keys, labels
from ..operators import series
from .base import query

_HARM = "CASE WHEN lower(trim(raw_label)) IN ('both','signal','multiple') THEN 'hazard' WHEN lower(trim(raw_label)) IN ('none','left','right','hazard') THEN lower(trim(raw_label)) ELSE 'none' END"


@query(f"SELECT event_id, model_name, raw_label, {_HARM} AS label FROM predictions", "predictions")
def p01_harmonize_label(t):
    return t.predictions.select("event_id", "model_name", "raw_label", labels.harmonize_label(F.col("raw_label")).alias("label"))


@query("""SELECT event_id, model_name, CASE WHEN lower(trim(raw_label)) = 'both' THEN 'hazard' ELSE raw_label END AS narrow,
CASE lower(trim(raw_label)) WHEN 'both' THEN 3 WHEN 'none' THEN 0 WHEN 'left' THEN 1 WHEN 'right' THEN 2 WHEN 'hazard' THEN 3 END AS code FROM predictions""", "predictions")
def p02_narrow_and_code(t):
    c = F.col("raw_label")
    return t.predictions.select("event_id", "model_name", labels.narrow_label(c).alias("narrow"), labels.label_code(c).alias("code"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'd' || user_id || '_camera_w_' || user_id || '__track_' || user_id
  WHEN 1 THEN 'd' || user_id || '_camera_w__track_' || user_id WHEN 2 THEN 'd' || user_id || '/cam__track_' || user_id ELSE 'plain' || user_id END AS raw FROM events)
SELECT event_id, raw, CASE WHEN raw LIKE 'plain%' THEN raw WHEN raw LIKE '%/%' THEN split_part(raw, '__track_', 1) || '_' || split_part(raw, '__track_', 2)
  WHEN event_id % 4 = 0 THEN replace(split_part(raw, '__track_', 1), '_camera_', '/camera_')
  ELSE replace(split_part(raw, '__track_', 1), '_camera_', '/camera_') || '_' || split_part(raw, '__track_', 2) END AS canonical FROM x""")
def p03_canonical_sequence_id(t):
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("d"), u, F.lit("_camera_w_"), u, F.lit("__track_"), u)).when(k == 1, F.concat(F.lit("d"), u, F.lit("_camera_w__track_"), u)).when(k == 2, F.concat(F.lit("d"), u, F.lit("/cam__track_"), u)).otherwise(F.concat(F.lit("plain"), u))
    return t.events.select("event_id", raw.alias("raw")).withColumn("canonical", keys.canonical_sequence_id(F.col("raw")))


@query("""SELECT event_id, sequence_id || '__track_' || track_id AS key, replace(sequence_id, '/', '_') || '__track_' || track_id AS safe, sequence_id AS parsed_id, track_id AS parsed_track FROM frames""", "frames")
def p04_sequence_keys(t):
    f = t.frames.select("event_id", keys.sequence_key(F.col("sequence_id"), F.col("track_id")).alias("key"))
    p = keys.parse_key(F.col("key"))
    return f.select("event_id", "key", keys.safe_key(F.col("key")).alias("safe"), p["sequence_id"].alias("parsed_id"), p["track_id"].alias("parsed_track"))


@query("""SELECT event_id, split_part(sequence_id, '/', 1) AS video, split_part(sequence_id, '/', 2) AS camera, 'unknown' AS video2 FROM frames""", "frames")
def p05_video_and_camera(t):
    s = F.col("sequence_id")
    return t.frames.select("event_id", keys.video_of(s).alias("video"), keys.camera_of(s).alias("camera"), keys.video_of(F.col("true_label")).alias("video2"))


@query("SELECT event_id, sequence_id || '_' || track_id AS a, sequence_id || '__' || track_id || '_' || frame_id AS b FROM frames", "frames")
def p06_composite_ids(t):
    return t.frames.select("event_id", F.concat_ws("_", "sequence_id", "track_id").alias("a"), F.concat(F.concat_ws("__", "sequence_id", "track_id"), F.lit("_"), F.col("frame_id")).alias("b"))


@query("""SELECT event_id, 's' || user_id AS session_dir, lpad((event_id % 1000000)::VARCHAR, 6, '0') AS frame,
CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 3 END::INT AS line_idx FROM events""")
def p07_crop_parts(t):
    e = F.col("event_id")
    suffix = F.when(e % 3 == 0, "").otherwise((e % 3 + 1).cast("string"))
    path = F.concat(F.lit("s"), F.col("user_id"), F.lit("/predict/crops/car/"), F.lpad((e % 1000000).cast("string"), 6, "0"), suffix, F.lit(".jpg"))
    return t.events.select("event_id", keys.crop_parts(path).alias("p")).select("event_id", "p.*")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN crop_path ELSE 'car/' || event_id || '.jpg' END AS rel FROM frames", "frames")
def p08_relative_path(t):
    p = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/data/root/"), F.col("crop_path"))).otherwise(F.concat(F.lit("/other/"), F.col("crop_path")))
    return t.frames.select("event_id", keys.relative_path(p, "root").alias("rel"))


@query("""WITH b AS (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS cx, (event_id % 67) / 66.0::DOUBLE AS cy, (event_id % 13) / 20.0::DOUBLE AS w, (event_id % 7) / 10.0::DOUBLE AS h FROM events)
SELECT event_id, trunc(greatest(0.0::DOUBLE, least(639, cx * 640 - w * 640 / 2)))::INT AS x1, trunc(greatest(0.0::DOUBLE, least(479, cy * 480 - h * 480 / 2)))::INT AS y1,
 trunc(greatest(0.0::DOUBLE, least(639, cx * 640 + w * 640 / 2)))::INT AS x2, trunc(greatest(0.0::DOUBLE, least(479, cy * 480 + h * 480 / 2)))::INT AS y2 FROM b""")
def p09_corner_box(t):
    e = F.col("event_id")
    return t.events.select("event_id", *boxes.corners((e % 101) / F.lit(100.0), (e % 67) / F.lit(66.0), (e % 13) / F.lit(20.0), (e % 7) / F.lit(10.0), F.lit(640.0), F.lit(480.0)))


@query("SELECT event_id, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy FROM frames", "frames")
def p10_box_geometry(t):
    return t.frames.select("event_id", *boxes.geometry(boxes.box()))


@query("""WITH p AS (SELECT a.event_id AS a, b.event_id AS b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM frames a JOIN frames b ON a.sequence_id = b.sequence_id AND a.track_id = b.track_id AND b.pos = a.pos + 1)
SELECT a, b, round(CASE WHEN s - i > 0 THEN i::DOUBLE / (s - i) ELSE 0 END, 6) AS iou FROM p""", "frames")
def p11_box_iou(t):
    f = t.frames
    c = ["x1", "y1", "x2", "y2"]
    nxt = f.select("sequence_id", "track_id", (F.col("pos") - 1).alias("pos"), F.col("event_id").alias("b"), *[F.col(x).alias(f"n_{x}") for x in c])
    return f.join(nxt, ["sequence_id", "track_id", "pos"]).select(F.col("event_id").alias("a"), "b", F.round(boxes.iou(boxes.box(), boxes.box("n_")), 6).alias("iou"))


@query("SELECT event_id, least(greatest(coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 50.0::DOUBLE - 0.5::DOUBLE END, 0.5::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) AS confidence FROM events")
def p12_clamp_confidence(t):
    raw = F.when(F.col("event_id") % 5 != 0, F.col("value") / F.lit(50.0) - 0.5)
    return t.events.select("event_id", labels.clamp_confidence(raw).alias("confidence"))


@query("SELECT event_id, CASE WHEN true_label <> 'none' OR event_id % 3 = 0 THEN 1 ELSE 0 END AS light FROM frames", "frames")
def p13_light_on(t):
    return t.frames.select("event_id", labels.light_on(F.col("true_label"), F.when(F.col("event_id") % 3 == 0, "On").otherwise("off")).alias("light"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN true_label WHEN 1 THEN 'hazard' WHEN 2 THEN 'left' WHEN 3 THEN 'none' ELSE 'none' END AS label,
CASE event_id % 5 WHEN 0 THEN 'r' || event_id WHEN 4 THEN 'Parse failed' ELSE '' END AS reasoning, event_id % 5 IN (0, 1, 3) AS parsed FROM frames""", "frames")
def p15_parse_answer(t):
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.concat(F.lit('Sure: {"label": "'), F.col("true_label"), F.lit('", "reasoning": "r'), F.col("event_id"), F.lit('"} ok'))).when(k == 1, '{"label": "BOTH"}').when(k == 2, "It turns LEFT, not right {").when(k == 3, 'x {"label": "sideways"} left').otherwise("nothing seen?")
    a = labels.parse_answer(F.when(k == 4, F.lit("?")).otherwise(text))
    return t.frames.select("event_id", a["label"].alias("label"), a["reasoning"].alias("reasoning"), a["parsed"].alias("parsed"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN true_label ELSE 'unclassified' END AS word, CASE WHEN event_id % 2 = 0 THEN true_label ELSE 'right' END AS held FROM frames""", "frames")
def p17_clean_answers(t):
    a = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("answer is "), F.col("true_label"), F.lit("."))).otherwise("Rightish or so")
    return t.frames.select("event_id", labels.one_word_answer(a).alias("word"), labels.contained_answer(a).alias("held"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'both' WHEN 2 THEN 'right' ELSE 'none' END AS turn, CASE WHEN event_id % 4 IN (0, 3) THEN 'on' ELSE 'off' END AS tail FROM events""")
def p18_phrase_labels(t):
    k = F.col("event_id") % 4
    a = lambda *x: F.array(*map(F.lit, x))
    p = F.when(k == 0, a("Left signal", "brake light")).when(k == 1, a("left signal", "right lamp")).when(k == 2, a("RIGHT lamp")).otherwise(a("taillight"))
    return t.events.select("event_id", labels.phrase_labels(p).alias("p")).select("event_id", "p.*")


@query("SELECT event_id, true_code AS code, true_label AS name, NULL::VARCHAR AS outside FROM frames", "frames")
def p19_encode_decode(t):
    return t.frames.select("event_id", labels.label_code(F.col("true_label")).alias("code"), labels.label_name(F.col("true_code")).alias("name"), labels.label_name(F.col("true_code") + 4).alias("outside"))


@query("""SELECT event_id, true_label AS label, false AS is_flipped FROM frames UNION ALL
SELECT event_id, CASE true_label WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' ELSE true_label END, true FROM frames""", "frames")
def p20_mirrored_copy(t):
    f = t.frames.select("event_id", F.col("true_label").alias("label"))
    return f.withColumn("is_flipped", F.lit(False)).unionByName(f.withColumn("label", labels.mirror_label(F.col("label"))).withColumn("is_flipped", F.lit(True)))


@query("SELECT event_id, true_label AS a, NULL::VARCHAR AS b FROM frames", "frames")
def p21_placeholder_blanking(t):
    f = t.frames.select("event_id", F.col("true_label").alias("a"), F.when(F.col("event_id") % 2 == 0, "none").otherwise(" Unknown").alias("b"))
    blank = f.agg(*[F.bool_and(F.coalesce(F.lower(F.trim(c)).isin(*labels.PLACEHOLDERS), F.lit(True))).alias(f"_{c}") for c in ("a", "b")])
    return f.crossJoin(F.broadcast(blank)).select("event_id", *[F.when(~F.col(f"_{c}"), F.col(c)).alias(c) for c in ("a", "b")])


@query("""SELECT event_id FROM (SELECT event_id, dense_rank() OVER (ORDER BY sequence_id, track_id) AS r FROM frames) WHERE r <= 20""", "frames")
def p22_sequence_filter(t):
    ids = t.frames.select("sequence_id", "track_id").distinct()
    return t.frames.join(ids.orderBy("sequence_id", "track_id").limit(20), ["sequence_id", "track_id"], "left_semi").select("event_id")


@query("SELECT event_id, round_even(pos / 8.0::DOUBLE, 2) AS seconds FROM frames", "frames")
def p23_seconds(t):
    return t.frames.select("event_id", labels.seconds(F.col("pos"), 8.0).alias("seconds"))


@query("""WITH m AS (SELECT run_id, model_name, CASE run_id % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'single' WHEN 2 THEN 'video' ELSE 'unknown' END AS mode FROM runs)
SELECT run_id, mode, model_name || '_' || mode AS display FROM m""", "runs")
def p24_model_names(t):
    k = F.col("run_id") % 4
    mode = labels.inference_mode(F.when(k == 0, " Video").when(k == 1, "single-image"), F.col("model_name"), F.when(k == 2, "/runs/VIDEO_7").otherwise("/runs/7"))
    return t.runs.select("run_id", mode.alias("mode"), "model_name").select("run_id", "mode", labels.display_name(F.col("model_name"), F.col("mode")).alias("display"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0::DOUBLE ELSE event_id::DOUBLE END AS number FROM events")
def p25_numeric_coercion(t):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), F.col("event_id"))).otherwise(F.col("event_id").cast("string"))
    return t.events.select("event_id", labels.number_or_zero(raw).alias("number"))


@query("""WITH s AS (SELECT sequence_id, list(true_code ORDER BY pos) AS a FROM frames GROUP BY sequence_id)
SELECT sequence_id, array_to_string(list_transform(range(64), lambda i: CASE WHEN i < len(a) THEN a[i + 1] ELSE -1 END), ',') AS padded, least(len(a), 64)::INT AS used FROM s""", "frames")
def p26_padded_series(t):
    s = t.frames.groupBy("sequence_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "true_code"))), lambda x: x["true_code"]).alias("a"))
    return s.select("sequence_id", F.array_join(arrays.fitted(F.col("a"), 64, F.lit(-1)), ",").alias("padded"), F.size(F.filter(arrays.mask(F.col("a"), 64), lambda x: x)).alias("used"))


@query("""WITH s AS (SELECT sequence_id, list(true_code ORDER BY pos) AS a, max(track_id) % 10 AS p FROM frames GROUP BY sequence_id)
SELECT sequence_id, array_to_string([a[1]] || a[1:-2], ',') AS later, array_to_string(a[2:] || [a[-1]], ',') AS earlier,
 array_to_string(a[1:p] || a[p + 2:] || [a[-1]], ',') AS dropped, array_to_string((a[1:p + 1] || a[p + 1:])[1:len(a)], ',') AS doubled FROM s""", "frames")
def p27_series_augmentation(t):
    s = t.frames.groupBy("sequence_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "true_code"))), lambda x: x["true_code"]).alias("a"), (F.max("track_id") % 10).alias("p"))
    a, p = F.col("a"), F.col("p")
    out = {"later": arrays.shifted(a, 1), "earlier": arrays.shifted(a, -1), "dropped": arrays.dropped(a, p), "doubled": arrays.doubled(a, p)}
    return s.select("sequence_id", *[F.array_join(v, ",").alias(k) for k, v in out.items()])


@query("SELECT event_id, x1 >= 0 AND y1 >= 0 AND x2 <= 800 AND y2 <= 600 AND x2 > x1 AND y2 > y1 AS valid FROM frames", "frames")
def p28_region_validity(t):
    return t.frames.select("event_id", boxes.inside(boxes.box(), F.lit(800), F.lit(600)).alias("valid"))


@query("SELECT event_id, m AS mode, m || '/' || crop_path AS path FROM frames CROSS JOIN (SELECT unnest(['edges', 'halves', 'raw']) AS m)", "frames")
def p29_variant_paths(t):
    modes = F.explode(F.array(F.lit("edges"), F.lit("halves"), F.lit("raw")))
    return t.frames.select("event_id", "crop_path", modes.alias("mode")).select("event_id", "mode", keys.prefixed_path(F.col("mode"), F.col("crop_path")).alias("path"))


@query("""WITH s AS (SELECT sequence_id, track_id, count(*) AS n, bool_or(true_label = 'left') AS has FROM frames GROUP BY ALL)
SELECT sequence_id, track_id, n AS num_frames FROM s WHERE has AND n BETWEEN 50 AND 80""", "frames")
def p30_browse_filter(t):
    s = t.frames.groupBy(*series.KEY).agg(F.count("*").alias("num_frames"), F.bool_or(F.col("true_label") == "left").alias("has"))
    return s.where("has and num_frames between 50 and 80").drop("has")
