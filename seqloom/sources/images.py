"""Image jobs: per-image numpy inside Arrow batches; no image library is needed.

Images come from Spark's `image` source as BGR bytes. Hue is on the scale 0-179, like the thresholds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower and upper bound of (hue, saturation, value) of a yellow lamp.
YELLOW = ((15, 100, 100), (35, 255, 255))
#: Where the lamps are, as shares of height and width.
TOP, LEFT, RIGHT = 0.4, 0.4, 0.6


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Height x width x 3, BGR."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, :3]


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue 0-179, saturation and value 0-255."""
    x = bgr.astype(np.float64)
    b, g, r = x[..., 0], x[..., 1], x[..., 2]
    v, low = x.max(axis=2), x.min(axis=2)
    d = v - low
    safe = np.where(d == 0, 1, d)
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    h = np.where(d == 0, 0, np.where(h < 0, h + 360, h)) / 2
    s = np.where(v == 0, 0, d / np.where(v == 0, 1, v) * 255)
    return np.stack([np.rint(h) % 180, np.rint(s), v], axis=2).astype(np.uint8)


def lamp(bgr: np.ndarray, side: str) -> np.ndarray:
    """The bottom 60 % and the outer 40 % of a side; the whole image for another name."""
    h, w = bgr.shape[:2]
    low = bgr[int(h * TOP) :]
    return low[:, : int(w * LEFT)] if side == "left" else low[:, int(w * RIGHT) :] if side == "right" else bgr


def energy(bgr: np.ndarray, box=YELLOW) -> int:
    """255 for each pixel inside the colour box."""
    x = hsv(bgr)
    return int(((x >= np.array(box[0])) & (x <= np.array(box[1]))).all(axis=2).sum()) * 255


def colour_energy(images: DataFrame, sides=("whole", "left", "right"), box=YELLOW) -> DataFrame:
    """origin and one energy per side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [[r.origin, *[energy(lamp(pixels(r.data, r.height, r.width, r.channels), s), box) for s in sides]] for r in pdf.itertuples()]
            yield pd.DataFrame(rows, columns=["origin", *[f"{s}_energy" for s in sides]])

    return images.mapInPandas(run, "origin string, " + ", ".join(f"{s}_energy long" for s in sides))


def colour_histogram(images: DataFrame, step: int = 5, side: str = "whole") -> DataFrame:
    """origin, hue, saturation and value bins with their pixels: images are decoded once, and any colour
    range on bin edges is a sum of bins afterwards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                x = hsv(lamp(pixels(r.data, r.height, r.width, r.channels), side)).reshape(-1, 3) // step
                bins, n = np.unique(x, axis=0, return_counts=True)
                yield pd.DataFrame({"origin": r.origin, "h": bins[:, 0].astype(int), "s": bins[:, 1].astype(int), "v": bins[:, 2].astype(int), "n": n})

    return images.mapInPandas(run, "origin string, h int, s int, v int, n long")


def _places(step: int) -> tuple[int, int, int]:
    """Bins of hue, saturation and value, with a layer of zeros below each."""
    return (179 // step + 2, 255 // step + 2, 255 // step + 2)


def colour_volumes(histogram: DataFrame, step: int = 5) -> DataFrame:
    """origin and volume, the summed-volume table of each image: at (h, s, v) the pixels of all bins below, laid
    out in one array. A group is one image's bins, of which there are some 100,000 at most."""
    shape = _places(step)

    def run(bins: pa.Table) -> pa.Table:
        n = np.zeros(shape, dtype=np.int64)
        at = tuple(bins[c].to_numpy() + 1 for c in "hsv")
        np.add.at(n, at, bins["n"].to_numpy())
        total = n.cumsum(0).cumsum(1).cumsum(2).astype(np.int32)
        return pa.table({"origin": bins["origin"][:1], "volume": pa.array([total.ravel()], pa.list_(pa.int32()))})

    return histogram.groupBy("origin").applyInArrow(run, "origin string, volume array<int>")


def range_energies(histogram: DataFrame, ranges: DataFrame, step: int = 5) -> DataFrame:
    """Energies of every image in every colour range (range_id, h0, h1, s0, v0 and maybe s1, v1), a parameter
    list: eight look-ups in the image's summed volumes. A bin is inside by its lower edges. Images keep one row
    each until the last step, which lists the ranges; no image is read again."""
    nh, ns, nv = _places(step)
    first = lambda c, n: F.least(F.greatest(F.ceil(F.col(c) / step), F.lit(0)), F.lit(n - 1)).cast("int")
    after = lambda c, n: (F.least(F.greatest(F.floor(F.col(c) / step), F.lit(-1)), F.lit(n - 2)) + 1).cast("int") if c in ranges.columns else F.lit(n - 1)
    edges = {"h0": first("h0", nh), "h1": after("h1", nh), "s0": first("s0", ns), "s1": after("s1", ns), "v0": first("v0", nv), "v1": after("v1", nv)}
    listed = ranges.select("range_id", *[c.alias(k) for k, c in edges.items()])
    one = F.broadcast(listed.agg(F.collect_list(F.struct(*listed.columns)).alias("ranges")))
    below = lambda r, h, s, v: F.get("volume", (r[h] * ns + r[s]) * nv + r[v])

    def pixels_in(r: Column) -> Column:
        full = (r["h0"] < r["h1"]) & (r["s0"] < r["s1"]) & (r["v0"] < r["v1"])
        corners = [(sign * t * u, below(r, h, s, v)) for sign, h in ((1, "h1"), (-1, "h0")) for t, s in ((1, "s1"), (-1, "s0")) for u, v in ((1, "v1"), (-1, "v0"))]
        return F.when(full, sum((x if sign > 0 else -x for sign, x in corners[1:]), corners[0][1])).otherwise(0)

    each = colour_volumes(histogram, step).crossJoin(one)  # one row
    found = F.transform("ranges", lambda r: F.struct(r["range_id"].alias("range_id"), (pixels_in(r).cast("long") * 255).alias("energy")))
    return each.select("origin", F.explode(found).alias("r")).select("origin", "r.*")


def resized(bgr: np.ndarray, size: int, letterbox: bool = True) -> np.ndarray:
    """size x size in [0, 1] by nearest neighbours: the whole image inside grey bars, or stretched."""
    h, w = bgr.shape[:2]
    scale = size / max(h, w)
    nh, nw = (max(1, round(h * scale)), max(1, round(w * scale))) if letterbox else (size, size)
    rows, cols = (np.arange(nh) * h // nh).clip(0, h - 1), (np.arange(nw) * w // nw).clip(0, w - 1)
    out = np.full((size, size, 3), 114, np.uint8)
    top, left = (size - nh) // 2, (size - nw) // 2
    out[top : top + nh, left : left + nw] = bgr[rows][:, cols]
    return out.astype(np.float32) / 255


def contrasted(bgr: np.ndarray) -> np.ndarray:
    """Values spread over the whole range between the 1st and 99th percentile."""
    lo, hi = np.percentile(bgr, (1, 99))
    return ((bgr.astype(np.float64) - lo) / max(hi - lo, 1) * 255).clip(0, 255).astype(np.uint8)


def brightest(bgr: np.ndarray, share: float = 0.5) -> np.ndarray:
    """The window of that share of each side with the largest sum."""
    h, w = max(1, int(bgr.shape[0] * share)), max(1, int(bgr.shape[1] * share))
    sums = np.pad(bgr.sum(axis=2, dtype=np.int64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    box = sums[h:, w:] - sums[:-h, w:] - sums[h:, :-w] + sums[:-h, :-w]
    y, x = np.unravel_index(box.argmax(), box.shape)
    return bgr[y : y + h, x : x + w]


VARIANTS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"raw": lambda x: x, "contrast": contrasted, "left": lambda x: x[:, : x.shape[1] // 2], "right": lambda x: x[:, x.shape[1] // 2 :], "bright": brightest}


def normalised(images: DataFrame, size: int = 64, variant: str = "raw", letterbox: bool = True) -> DataFrame:
    """origin and the image as size * size * 3 numbers in [0, 1]."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                x = resized(VARIANTS[variant](pixels(r.data, r.height, r.width, r.channels)), size, letterbox)
                yield pd.DataFrame({"origin": [r.origin], "values": [x.ravel().tolist()]})

    return images.mapInPandas(run, "origin string, values array<float>")


def difference_maps(normal: DataFrame, by: str, order: str) -> DataFrame:
    """The mean absolute difference of neighbours along a track, value by value."""
    from pyspark.sql import Window

    before = F.lag("values").over(Window.partitionBy(by).orderBy(order))
    d = normal.withColumn("d", F.zip_with("values", before, lambda a, b: F.abs(a - b))).where("d is not null")
    each = d.select(by, F.posexplode("d").alias("place", "x")).groupBy(by, "place").agg(F.avg("x").alias("x"))
    return each.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda v: v["x"]).alias("difference"))


def infer(df: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame] | Callable[[], Callable], schema: str, keys: list[str], load: bool = False) -> DataFrame:
    """A user's batch function over rows; rows that it fails on become rows with label `error`. A batch that fails
    is halved until the rows at fault stand alone, so all others keep their predictions: k bad rows of a batch of n
    cost about 2 k log n further calls. schema names keys, label, confidence and raw_output. With `load`, predict
    is called without arguments once for each Python worker and gives the batch function: for models that take
    long to load."""
    name = uuid.uuid4().hex

    def halves(f: Callable, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        todo = [pdf]
        while todo:
            part = todo.pop()
            try:
                yield f(part)
            except Exception as e:  # noqa: BLE001  a failed row is told, not lost
                if len(part) == 1:
                    yield part[keys].assign(label="error", confidence=0.0, raw_output=f"{type(e).__name__}: {e}")
                else:
                    todo += [part.iloc[len(part) // 2 :], part.iloc[: len(part) // 2]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = predict
        if load:
            from seqloom.sources import images as here

            if name not in here.LOADED:
                here.LOADED[name] = predict()
            f = here.LOADED[name]
        for pdf in batches:
            if len(pdf):
                yield from halves(f, pdf)

    return df.mapInPandas(run, schema)


#: Batch functions of this Python worker, by call of infer().
LOADED: dict[str, Callable] = {}
