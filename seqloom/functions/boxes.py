"""Boxes as four columns (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def geometry(b: Box) -> list[Column]:
    """width, height, area, cx, cy."""
    w, h = b[2] - b[0], b[3] - b[1]
    return [w.alias("width"), h.alias("height"), (w * h).alias("area"), ((b[0] + b[2]) / 2).alias("cx"), ((b[1] + b[3]) / 2).alias("cy")]


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 if the union is empty."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, (w * h) / union).otherwise(F.lit(0.0))


def corners(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """A normalised centre box as whole corner pixels inside the image."""
    def side(c: Column, half: Column, size: Column, sign: int) -> Column:
        return F.greatest(F.lit(0.0), F.least(size - 1, c * size + sign * half * size / 2)).cast("int")

    return [side(cx, w, width, -1).alias("x1"), side(cy, h, height, -1).alias("y1"), side(cx, w, width, 1).alias("x2"), side(cy, h, height, 1).alias("y2")]


def inside(b: Box, width: Column, height: Column) -> Column:
    """A region of positive size within the image."""
    return (b[0] >= 0) & (b[1] >= 0) & (b[2] <= width) & (b[3] <= height) & (b[2] > b[0]) & (b[3] > b[1])
