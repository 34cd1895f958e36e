"""Sequence keys, crop names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACK = r"^(.*)__track_(\d+)$"


def canonical_sequence_id(c: Column) -> Column:
    """`x_camera_y__track_n` to `x/camera_y_n`; n is appended only if it is missing. Ids with a slash only
    lose the track mark; ids without a camera stay as they are."""
    base = F.when(F.instr(c, "__track_") > 0, F.substring_index(c, "__track_", 1)).otherwise(c)
    track = F.when(F.instr(c, "__track_") > 0, F.regexp_extract(c, r"^.*?__track_(.*)$", 1)).otherwise("")
    tailed = lambda x: F.when((track == "") | x.endswith(F.concat(F.lit("_"), track)), x).otherwise(F.concat(x, F.lit("_"), track))
    slashed = F.concat(F.substring_index(base, "/", 1), F.lit("/"), tailed(F.regexp_extract(base, r"^[^/]*/(.*)$", 1)))
    camera = F.instr(base, "_camera_")
    joined = F.concat(F.substring(base, F.lit(1), camera - 1), F.lit("/"), tailed(F.substring(base, camera + 1, F.length(base))))
    return F.when((F.instr(c, "/") > 0) & (track == ""), base).when(F.instr(c, "/") > 0, slashed).when((F.instr(c, "__track_") > 0) & (camera > 0), joined).otherwise(c)


def sequence_key(sequence_id: Column, track_id: Column) -> Column:
    """`id__track_n`; an id that has its track already keeps it."""
    own = F.regexp_extract(sequence_id, TRACK, 2)
    base = F.when(own == "", sequence_id).otherwise(F.regexp_extract(sequence_id, TRACK, 1))
    return F.concat(base, F.lit("__track_"), F.when(own == "", track_id.cast("string")).otherwise(own.try_cast("long").cast("string")))


def safe_key(key: Column) -> Column:
    return F.translate(key, "/\\", "__")


def parse_key(key: Column) -> Column:
    """(sequence_id, track_id) of a key; a key without a track has none."""
    own = F.regexp_extract(key, TRACK, 2)
    return F.struct(F.when(own == "", key).otherwise(F.regexp_extract(key, TRACK, 1)).alias("sequence_id"), own.try_cast("long").alias("track_id"))


def video_of(sequence_id: Column) -> Column:
    return F.when(F.instr(sequence_id, "/") > 0, F.substring_index(sequence_id, "/", 1)).otherwise("unknown")


def camera_of(sequence_id: Column) -> Column:
    return F.when(F.instr(sequence_id, "/") > 0, F.get(F.split(sequence_id, "/"), F.lit(1))).otherwise("unknown")


def recording_of(sequence_id: Column) -> Column:
    return F.substring_index(sequence_id, "/", 1)


def crop_parts(path: Column) -> Column:
    """(session_dir, frame, line_idx) of a crop's path: the first six characters name the frame, what
    follows is the detection's number (none: 0, n: n - 1)."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.(jpg|png)$", "")
    rest = F.substring(name, 7, 1 << 20)
    return F.struct(
        F.when(F.instr(path, "predict/crops") > 0, F.rtrim(F.substring_index(path, "predict/crops", 1), F.lit("/"))).alias("session_dir"),
        F.substring(name, 1, 6).alias("frame"),
        F.when(rest == "", F.lit(0)).otherwise(rest.try_cast("int") - 1).alias("line_idx"),
    )


def relative_path(path: Column, root: str) -> Column:
    """What follows the data set's folder; the last two parts if it is not there."""
    return F.when(F.instr(path, f"{root}/") > 0, F.substring_index(path, f"{root}/", -1)).otherwise(F.array_join(F.slice(F.split(path, "/"), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1)), 2), "/"))


def prefixed_path(prefix: Column, path: Column) -> Column:
    return F.concat(prefix, F.lit("/"), path)
