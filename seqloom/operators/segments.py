"""Segments: labelled stretches of positions, as arrays of structs or as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import LABELS, harmonize_label

TYPE = "array<struct<label:string,start_frame:int,end_frame:int>>"
NONE = "none"


def segment(label: Column, start: Column, end: Column) -> Column:
    return F.struct(label.alias("label"), start.cast("int").alias("start_frame"), end.cast("int").alias("end_frame"))


def merge_adjacent(segments: Column) -> Column:
    """Neighbours of one label that touch or overlap the merged one before become one."""
    ordered = F.array_sort(F.transform(segments, lambda s: F.struct(s["start_frame"], s["end_frame"], s["label"])))

    def step(out: Column, s: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        here = segment(s["label"], s["start_frame"], s["end_frame"])
        joined = segment(last["label"], last["start_frame"], F.greatest(last["end_frame"], s["end_frame"]))
        touches = F.coalesce((last["label"] == s["label"]) & (s["start_frame"] <= last["end_frame"] + 1), F.lit(False))
        before = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(touches, F.concat(before, F.array(joined))).otherwise(F.concat(out, F.array(here)))

    return F.aggregate(ordered, F.array().cast(TYPE), step)


def offset_chunk(segments: Column, start: Column, end: Column) -> Column:
    """A chunk's segments at their places in the whole, inside [start, end]; a chunk without any is none."""
    moved = F.transform(segments, lambda s: segment(s["label"], F.least(F.greatest(s["start_frame"] + start, start), end), F.least(F.greatest(s["end_frame"] + start, start), end)))
    return F.when(F.coalesce(F.size(segments), F.lit(0)) > 0, moved).otherwise(F.array(segment(F.lit(NONE), start, end)))


def repair(segments: Column, num_frames: Column) -> Column:
    """Segments in their given order without overlap: each starts at the cursor at least, the last one ends
    with the last frame, and nothing follows once all is covered. Missing bounds come from the cursor."""
    last = (num_frames - 1).cast("int")
    n = F.size(segments)
    numbered = F.transform(segments, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    zero = F.struct(F.lit(0).alias("cursor"), F.array().cast(TYPE).alias("out"))

    def step(state: Column, x: Column) -> Column:
        s = F.least(F.greatest(F.coalesce(x["s"]["start_frame"], state["cursor"]), state["cursor"]), last)
        e = F.when(x["i"] == n - 1, last).otherwise(F.least(F.greatest(F.coalesce(x["s"]["end_frame"], s), s), last))
        done = F.struct((e + 1).cast("int").alias("cursor"), F.concat(state["out"], F.array(segment(harmonize_label(x["s"]["label"]), s, e))).alias("out"))
        return F.when(state["cursor"] > last, state).otherwise(done)

    out = F.aggregate(numbered, zero, step)["out"]
    end = F.get(out, F.size(out) - 1)
    stretched = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(segment(end["label"], end["start_frame"], last)))
    return F.when(F.coalesce(F.size(out), F.lit(0)) > 0, stretched).otherwise(F.array(segment(F.lit(NONE), F.lit(0), last)))


def from_single(label: Column, start: Column, end: Column, num_frames: Column, labels=LABELS) -> Column:
    """One label with its bounds as up to three segments: none before, the signal, none after."""
    last, name = num_frames - 1, harmonize_label(label, labels)
    s = F.least(F.greatest(start, F.lit(0)), last)
    e = F.greatest(F.least(end, last), s)
    three = F.array(segment(F.lit(NONE), F.lit(0), s - 1), segment(name, s, e), segment(F.lit(NONE), e + 1, last))
    parts = F.filter(three, lambda x: x["end_frame"] >= x["start_frame"])
    return F.when((name == NONE) | start.isNull() | end.isNull(), F.array(segment(name, F.lit(0), last))).otherwise(parts)


def primary(segments: Column) -> Column:
    """The first segment of a signal, else the first one."""
    return F.coalesce(F.get(F.filter(segments, lambda s: s["label"] != NONE), F.lit(0)), F.get(segments, F.lit(0)))


def to_frames(spine: DataFrame, segments: DataFrame, by, pos: str = "pos", overall: str | None = None, overlap: str = "first", clamp: bool = True) -> DataFrame:
    """A label for each frame of the spine. segments: `by`, seg_ord, label, start_frame, end_frame (places).

    Of overlapping segments the first wins, or the last if asked. Frames in gaps get none; frames of a key
    without segments get the column `overall` of the spine, else none. With clamp, bounds beyond the track
    are moved to its ends; else they cover nothing there.
    """
    n = spine.groupBy(*by).agg((F.max(pos) + 1).alias("__n"))
    s = segments.join(n, list(by))
    if clamp:
        hold = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.col("__n") - 1)
        s = s.withColumn("start_frame", hold("start_frame")).withColumn("end_frame", hold("end_frame"))
    else:
        s = s.withColumn("start_frame", F.greatest("start_frame", F.lit(0))).withColumn("end_frame", F.least(F.col("end_frame"), F.col("__n") - 1))
    s = s.where("start_frame <= end_frame").withColumn(pos, F.explode(F.sequence(F.col("start_frame").cast("long"), F.col("end_frame").cast("long"))))
    pick = F.min_by if overlap == "first" else F.max_by
    hit = s.groupBy(*by, pos).agg(pick("label", "seg_ord").alias("__hit"))
    has = segments.select(*by).distinct().withColumn("__has", F.lit(True))
    rest = F.when(F.col("__has"), NONE).otherwise(F.coalesce(F.col(overall), F.lit(NONE)) if overall else F.lit(NONE))
    return spine.join(hit, [*by, pos], "left").join(has, list(by), "left").withColumn("label", F.coalesce("__hit", rest)).drop("__hit", "__has")


def label_totals(segments: DataFrame, by=()) -> DataFrame:
    """Frames per label from segments."""
    return segments.groupBy(*by, "label").agg(F.sum(F.col("end_frame") - F.col("start_frame") + 1).cast("long").alias("frames"))


def balanced_object(c: Column) -> Column:
    """The first balanced {...} of a text, else what lies between the first { and the last }; null if there
    are no braces. Braces inside strings count like others."""
    body = F.when(F.regexp_extract(c, r"(?s)<answer>(.*?)</answer>", 1) != "", F.regexp_extract(c, r"(?s)<answer>(.*?)</answer>", 1)).otherwise(c)
    tail = F.when(F.instr(body, "{") > 0, F.substring(body, F.instr(body, "{"), F.length(body)))
    marks = F.transform(F.split(tail, r"(?<=[{}])"), lambda p: F.struct(F.length(p).alias("n"), F.when(p.endswith("{"), 1).when(p.endswith("}"), -1).otherwise(0).alias("d")))
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(s: Column, m: Column) -> Column:
        depth = s["depth"] + m["d"]
        at = s["at"] + m["n"]
        end = F.when((s["end"] == 0) & (depth == 0) & (m["d"] == -1), at).otherwise(s["end"])
        return F.struct(at.alias("at"), depth.alias("depth"), end.alias("end"))

    end = F.aggregate(marks, zero, step)["end"]
    greedy = F.nullif(F.regexp_extract(tail, r"(?s)^\{.*\}", 0), F.lit(""))
    return F.when(end > 0, F.substring(tail, F.lit(1), end)).otherwise(greedy)


def parse_segments(c: Column) -> Column:
    """(segments, label, reasoning, start_frame, end_frame) of a model's answer; null if it holds no JSON."""
    shape = f"segments {TYPE}, label string, reasoning string, start_frame int, end_frame int"
    got = F.from_json(balanced_object(c), shape)
    think = F.nullif(F.trim(F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1)), F.lit(""))
    return F.when(got["segments"].isNotNull() | got["label"].isNotNull(), F.struct(got["segments"].alias("segments"), got["label"].alias("label"), F.coalesce(got["reasoning"], think).alias("reasoning"), got["start_frame"].alias("start_frame"), got["end_frame"].alias("end_frame")))
