"""Expressions on series held as arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fitted(a: Column, size: Column | int, fill: Column) -> Column:
    """The first `size` values, filled up at the end."""
    n = F.lit(size) if isinstance(size, int) else size
    return F.concat(F.slice(a, F.lit(1), n), F.array_repeat(fill, F.greatest(n - F.size(a), F.lit(0)).cast("int")))


def mask(a: Column, size: Column | int) -> Column:
    """True where fitted() has a value of the series."""
    n = F.lit(size) if isinstance(size, int) else size
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i < F.size(a))


def shifted(a: Column, by: int) -> Column:
    """Moved by one place, the edge value repeated; the length stays."""
    if by > 0:
        return F.concat(F.slice(a, 1, 1), F.slice(a, F.lit(1), F.size(a) - 1))
    return F.concat(F.slice(a, F.lit(2), F.size(a) - 1), F.slice(a, -1, 1))


def dropped(a: Column, place: Column) -> Column:
    """Without the value at a place (from 0), the last value repeated."""
    kept = F.filter(a, lambda x, i: i != place)
    return F.concat(kept, F.slice(a, -1, 1))


def doubled(a: Column, place: Column) -> Column:
    """The value at a place (from 0) twice, the last one cut off."""
    p = place.cast("int")
    return F.slice(F.concat(F.slice(a, F.lit(1), p + 1), F.slice(a, p + 1, F.size(a) - p)), F.lit(1), F.size(a))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: a lambda works out again, for each of its elements, whatever it
    takes from outside that is no variable of a lambda or plain column."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mean(a: Column) -> Column:
    """Null for an empty series."""
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))


def deviation(a: Column) -> Column:
    """Population standard deviation."""
    return let(F.struct(a.alias("a"), mean(a).alias("m")), lambda v: F.sqrt(F.try_divide(F.aggregate(v["a"], F.lit(0.0), lambda s, x: s + (x - v["m"]) * (x - v["m"])), F.size(v["a"]))))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _magnitudes(series: pd.Series) -> pd.Series:
    def one(a):
        if a is None or len(a) < 3:
            return None if a is None else []
        x = np.asarray(a, dtype=float)
        return np.abs(np.fft.rfft(x - x.mean()))[1 : (len(x) - 1) // 2 + 1]

    return series.map(one)


def periodogram(a: Column) -> Column:
    """DFT magnitudes of the series less its mean, at the positive frequencies k / n below one half; none of under
    three values. A fast transform of any length, n log n steps, on Arrow batches."""
    return _magnitudes(a.cast("array<double>"))


def periodicity(a: Column, fps: float = 10.0, f_min: float = 1.0, f_max: float = 2.5, times: float = 2.0) -> Column:
    """(is_periodic, peak_frequency, mean_power): the largest magnitude in [f_min, f_max] against `times` the
    mean of all. Series of under four values are not periodic; the first of equal peaks counts."""

    def judged(v: Column) -> Column:
        band = F.filter(F.transform(v["power"], lambda p, i: F.struct(p.alias("p"), ((i + 1) * F.lit(float(fps)) / v["n"]).alias("f"))), lambda x: (x["f"] >= f_min) & (x["f"] <= f_max))
        # The largest power first; of equal ones the lowest frequency.
        peak = F.array_max(F.transform(band, lambda x: F.struct(x["p"].alias("p"), (-x["f"]).alias("f"))))
        return let(F.struct(peak.alias("peak"), mean(v["power"]).alias("mean"), v["n"].alias("n")), told)

    def told(v: Column) -> Column:
        ok = (v["n"] >= 4) & v["peak"].isNotNull()
        return F.struct((ok & F.coalesce(v["peak"]["p"] > times * v["mean"], F.lit(False))).alias("is_periodic"), F.when(ok, -v["peak"]["f"]).otherwise(F.lit(0.0)).alias("peak_frequency"), v["mean"].alias("mean_power"))

    return let(F.struct(F.size(a).alias("n"), periodogram(a).alias("power")), judged)
