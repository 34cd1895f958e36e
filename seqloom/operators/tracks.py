"""Detections and tracks: matching, filters, and a tracker."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import box, iou
from .assignment import best_pairs, near_pairs


def _cells(low: str, high: str, least: float, look: bool) -> Column:
    """Cells (level, place) along one axis. A side of length w lies on the level of the next power of two, in the
    cell of that width where it begins; one that looks lists the levels and cells where a side may lie that shares
    `least` of their union with it: its length is between w * least and w / least, it begins at most
    w (1 / least - 1) before and w (1 - least) after it."""
    w, x = (F.col(high) - F.col(low)).cast("double"), F.col(low).cast("double")
    level = lambda v: F.ceil(F.log2(v))
    cell = lambda v, k: F.floor(v / F.pow(F.lit(2.0), k))
    if not look:
        return F.array(F.struct(level(w).alias("level"), cell(x, level(w)).alias("cell")))
    slack = w * 1e-6  # more than rounding moves
    levels = F.sequence(level(w * least - slack), level(w / least + slack))
    each = lambda k: F.transform(F.sequence(cell(x - w * (1 / least - 1) - slack, k), cell(x + w * (1 - least) + slack, k)), lambda c: F.struct(k.alias("level"), c.alias("cell")))
    return F.flatten(F.transform(levels, each))


def best_match(dets: DataFrame, tracks: DataFrame, by: list[str], least: float = 0.8) -> DataFrame:
    """Each detection's track of the largest overlap in its frame, from `least` (over 0) on; the first track wins
    ties. Boxes of a frame meet in cells of a grid, by size and place, so pairs grow with the overlaps in a frame
    and not with the square of its boxes."""
    sides = ("x1", "y1", "x2", "y2")

    def gridded(df: DataFrame, prefix: str, look: bool) -> DataFrame:
        c = lambda k: f"{prefix}{k}"
        full = df.where((F.col(c("x2")) > F.col(c("x1"))) & (F.col(c("y2")) > F.col(c("y1"))))
        return full.withColumn("__x", F.explode(_cells(c("x1"), c("x2"), least, look))).withColumn("__y", F.explode(_cells(c("y1"), c("y2"), least, look)))

    d = gridded(dets.select(*by, "det_id", *[F.col(c).alias(f"d_{c}") for c in sides]), "d_", True)
    t = gridded(tracks.select(*by, "trk_id", *[F.col(c).alias(f"t_{c}") for c in sides]), "t_", False)
    pairs = d.join(t, [*by, "__x", "__y"]).withColumn("iou", iou(box("d_"), box("t_"))).where(F.col("iou") >= least)
    rank = F.row_number().over(Window.partitionBy(*by, "det_id").orderBy(F.desc("iou"), "trk_id"))
    return pairs.withColumn("__r", rank).where("__r = 1").select(*by, "det_id", "trk_id", "iou")


def consistent_sizes(df: DataFrame, by: list[str], most: float = 0.3) -> DataFrame:
    """Without boxes whose width or height is over `most` off the track's median; single boxes stay."""
    w = Window.partitionBy(*by)
    out = df.withColumn("__w", (F.col("x2") - F.col("x1")).cast("double")).withColumn("__h", (F.col("y2") - F.col("y1")).cast("double"))
    out = out.withColumn("__mw", F.median("__w").over(w)).withColumn("__mh", F.median("__h").over(w)).withColumn("__n", F.count("*").over(w))
    near = lambda c, m: F.abs(F.col(c) - F.col(m)) <= F.col(m) * most
    return out.where((F.col("__n") == 1) | (near("__w", "__mw") & near("__h", "__mh"))).drop("__w", "__h", "__mw", "__mh", "__n")


def drop_short(df: DataFrame, by: list[str], least: int) -> DataFrame:
    return df.withColumn("__n", F.count("*").over(Window.partitionBy(*by))).where(F.col("__n") >= least).drop("__n")


def link_boxes(dets: DataFrame, by: str = "sequence", min_score: float = 0.5, min_iou: float = 0.3, max_lost: int = 5, confirm: int = 3, appearance: str | None = None, max_distance: float = 0.3, share: float = 0.5) -> DataFrame:
    """Track ids for one recording's detections (by, frame_id, det_id, score, box): frame after frame, open
    tracks and boxes are paired so that the sum of overlaps above min_iou is the largest; a track without a box
    for over max_lost frames ends, and those of fewer than `confirm` boxes drop out. With a vector column
    `appearance`, pairs whose cosine distance is over max_distance are left out, and likeness counts with that
    share. Rows of a recording stream through its task frame by frame; only open tracks are held until the last
    filter, a window. Boxes meet in a grid, so a frame's work grows with the overlaps in it. Parallel over
    recordings."""
    cols = ["x1", "y1", "x2", "y2"]

    def likeness(a, b) -> float:
        """Cosine; without a vector on either side nothing speaks against the pair."""
        if a is None or b is None:
            return 1.0
        a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
        size = np.sqrt(a @ a) * np.sqrt(b @ b)
        return float(a @ b / size) if size else 0.0

    def paired(tracks: list, boxes: list) -> list[tuple[int, int]]:
        pairs = near_pairs([t[0] for t in tracks], [b[3:7] for b in boxes], min_iou)
        if not appearance:
            return best_pairs([(t, b, o - min_iou + 1e-9) for t, b, o in pairs])
        alike = [(t, b, o, likeness(tracks[t][2], boxes[b][7])) for t, b, o in pairs]
        return best_pairs([(t, b, (1 - share) * (o - min_iou) + share * (x - 1 + max_distance) + 1e-9) for t, b, o, x in alike if 1 - x <= max_distance])

    def run(batches):
        rows = (r for pdf in batches for r in pdf.itertuples(index=False))
        for name, group in itertools.groupby(rows, key=lambda r: r[0]):
            open_tracks, next_id, out = {}, 0, []
            for frame, here in itertools.groupby(group, key=lambda r: r[1]):
                here = list(here)
                open_tracks = {k: v for k, v in open_tracks.items() if frame - v[1] <= max_lost}
                ids = list(open_tracks)
                found = {b: ids[t] for t, b in paired([open_tracks[k] for k in ids], here)}
                for i, d in enumerate(here):
                    if i not in found:
                        found[i] = next_id
                        next_id += 1
                    open_tracks[found[i]] = (d[3:7], frame, d[7])
                    out.append((name, frame, d[2], found[i]))
                if len(out) > 10_000:
                    yield pd.DataFrame(out, columns=[by, "frame_id", "det_id", "track_id"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=[by, "frame_id", "det_id", "track_id"])

    look = F.col(appearance).cast("array<double>") if appearance else F.lit(None).cast("array<double>")
    good = dets.where(F.col("score") >= min_score).select(by, F.col("frame_id").cast("long"), F.col("det_id").cast("long"), *[F.col(c).cast("double") for c in cols], look.alias("__look"))
    found = good.repartition(by).sortWithinPartitions(by, "frame_id", "det_id").mapInPandas(run, f"`{by}` string, frame_id long, det_id long, track_id long")
    return drop_short(found, [by, "track_id"], confirm)
