"""Expressions over one curve held as two arrays (axis and intensity) in a row.

A curve is one measurement of bounded length, so it stays inside its row: the
operators are projections without shuffle, and a stage over many curves splits
by rows. ``let`` binds a computed array once so that later lambdas read it
instead of computing it again for each element.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Fn = Callable[[Column], Column]


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def let(value: Column, body: Fn) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unnest(df: DataFrame, keep, array: Column, name: str = "p") -> DataFrame:
    """One row per element of a computed array.

    A plain ``explode`` makes the optimiser add a size filter and push it below
    the projections that compute the array, where the whole chain is inlined
    into it. The outer form plus a null filter above it keeps the chain as it is.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def unnest_pos(df: DataFrame, keep, array: Column, pos: str = "idx", name: str = "p") -> DataFrame:
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).where(F.col(pos).isNotNull())


def doubles(*values: float) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def at(arr: Column, i) -> Column:
    """Element at a 0-based index, null outside."""
    return F.get(arr, i if isinstance(i, Column) else F.lit(int(i)))


def indices(arr: Column) -> Column:
    """0..n-1, empty for an empty array."""
    return F.transform(arr, lambda v, i: i)


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def mean(arr: Column) -> Column:
    return F.try_divide(total(arr), F.size(arr))


def quantile(arr: Column, fraction: float) -> Column:
    """Linear-interpolated quantile of an array; null when empty."""
    def pick(s):
        pos = F.lit(float(fraction)) * (F.size(s) - 1)
        low = F.floor(pos).cast("int")
        a = at(s, low)
        return a + (F.coalesce(at(s, low + 1), a) - a) * (pos - low)
    return let(F.array_sort(arr), pick)


def median(arr: Column) -> Column:
    return quantile(arr, 0.5)


def differences(arr: Column) -> Column:
    return let(arr, lambda a: F.transform(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda v, i: v - at(a, i)))


def moving_average(y: Column, window: int) -> Column:
    """Centred mean whose frame shrinks at both ends."""
    if window <= 1:
        return y
    half = max(1, window // 2)

    def one(v, i):
        start = F.greatest(i - half, F.lit(0))
        stop = F.least(i + half, F.size(y) - 1)
        return mean(F.slice(y, start + 1, stop - start + 1))
    return F.when(F.size(y) <= 2, y).otherwise(F.transform(y, one))


def smoothing_kernel(window: int, order: int) -> list[float]:
    """Least-squares polynomial smoothing weights of the window centre."""
    half = window // 2
    basis = np.vander(np.arange(-half, half + 1, dtype=float), order + 1, increasing=True)
    return [float(x) for x in np.linalg.pinv(basis)[0]]


def polynomial_smooth(y: Column, window: int = 5, order: int = 2) -> Column:
    """Polynomial smoothing inside, moving average at the edges, never below zero."""
    window = window + 1 if window % 2 == 0 else window
    half = window // 2
    kernel = doubles(*smoothing_kernel(window, order))

    def one(v, i):
        start = F.greatest(i - half, F.lit(0))
        stop = F.least(i + half, F.size(y) - 1)
        frame = F.slice(y, start + 1, stop - start + 1)
        inside = (i >= half) & (i < F.size(y) - half)
        fit = total(F.zip_with(frame, kernel, lambda a, b: a * b))
        return F.when(inside, F.greatest(fit, F.lit(0.0))).otherwise(mean(frame))
    return F.when(F.size(y) < 3, y).when(F.size(y) < window, moving_average(y, window)).otherwise(F.transform(y, one))


def percentile_background(y: Column, fraction: float = 0.10) -> Column:
    """Constant background: a low percentile of the curve."""
    return let(quantile(y, fraction), lambda q: F.transform(y, lambda v: q))


def asymmetric_background(y: Column, half: int = 5, p: float = 0.01, passes: int = 10) -> Column:
    """Iterated weighted moving mean; points above the estimate weigh ``p``, others ``1 - p``.

    This is a windowed definition of its own, not a penalised least-squares fit.
    Window sums are differences of running sums, so a pass costs one step per
    point whatever the window; batches of curves go through Arrow.
    """
    def window_sums(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0.0], np.cumsum(v)))
        return run[high] - run[low]

    def background(curve):
        if curve is None or not len(curve):
            return curve
        v, i = np.asarray(curve, dtype=float), np.arange(len(curve))
        low, high = np.maximum(i - half, 0), np.minimum(i + half, len(v) - 1) + 1
        z = window_sums(v, low, high) / (high - low) if len(v) > 2 else v
        for _ in range(passes):
            w = np.where(v > z, p, 1.0 - p)
            z = window_sums(w * v, low, high) / window_sums(w, low, high)
        return z

    def batch(curves: pd.Series) -> pd.Series:
        return curves.map(background)
    return F.pandas_udf(batch, T.ArrayType(T.DoubleType()))(y)


def subtract_background(y: Column, background: Column) -> Column:
    return F.zip_with(y, background, lambda a, b: F.greatest(a - b, F.lit(0.0)))


def normalize_max(y: Column) -> Column:
    """Scale to the maximum; all zeros when nothing is positive."""
    return let(F.array_max(y), lambda m: F.transform(
        y, lambda v: F.when(m > 0, F.greatest(v, F.lit(0.0)) / m).otherwise(F.lit(0.0))))


def area(x: Column, y: Column) -> Column:
    """Trapezoid area of the non-negative curve."""
    return total(F.transform(F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(0))), lambda v, i: (
        F.abs(at(x, i + 1) - at(x, i)) * (F.greatest(v, F.lit(0.0)) + F.greatest(at(y, i), F.lit(0.0))) / 2)))


def normalize_area(x: Column, y: Column) -> Column:
    return let(area(x, y), lambda s: F.transform(
        y, lambda v: F.when(s > 0, F.greatest(v, F.lit(0.0)) / s).otherwise(F.lit(0.0))))


def local_maxima(x: Column, y: Column, threshold: float = 0.02, start: float = 4.0, strict: bool = False) -> Column:
    """Indices of inner points not lower than both neighbours and above a threshold."""
    def hit(i):
        v, left, right = at(y, i), at(y, i - 1), at(y, i + 1)
        ok = (i > 0) & (i < F.size(y) - 1) & (at(x, i) >= start) & (v >= threshold) & (v >= left) & (v >= right)
        return ok & ((v > left) | (v > right)) if strict else ok
    return F.filter(indices(y), hit)


def strongest_apart(x: Column, y: Column, candidates: Column, distance: float, limit: int | None = None) -> Column:
    """Strongest first, dropping a candidate nearer than ``distance`` to a kept one.

    Equal heights are taken in axis order. The result lists indices by strength.
    """
    ranked = F.transform(
        F.array_sort(F.transform(candidates, lambda i: F.struct((-at(y, i)).alias("h"), at(x, i).alias("x"), i.alias("i")))),
        lambda s: s["i"])

    def fold(kept, i):
        near = F.exists(kept, lambda k: F.abs(at(x, k) - at(x, i)) < distance)
        full = near if limit is None else near | (F.size(kept) >= limit)
        return F.when(full, kept).otherwise(F.array_append(kept, i))
    return F.aggregate(ranked, F.expr("cast(array() as array<int>)"), fold)


def nearest_low(y: np.ndarray, peak: int, level: float, step: int) -> int:
    """Index of the nearest point at or under ``level`` on one side of a peak, else the end of the curve.

    Looks at stretches that double in length, so a peak costs about as many points as its foot is away.
    """
    end = len(y) if step > 0 else -1
    at, width = peak + step, 16
    while at != end and (end - at) * step > 0:
        stop = at + step * min(width, (end - at) * step)
        part = y[at:stop] if step > 0 else y[stop + 1:at + 1][::-1]
        low = np.flatnonzero(part <= level)
        if len(low):
            return at + step * int(low[0])
        at, width = stop, width * 2
    return len(y) - 1 if step > 0 else 0


def shape_of(x: np.ndarray, y: np.ndarray, run: np.ndarray, peak: int, fraction: float):
    """(fwhm, left, right, area) of a peak; ``run`` is the running trapezoid sum of ``y``."""
    top = y[peak]
    fwhm = left = right = None
    level = top / 2
    lo, hi = nearest_low(y, peak, level, -1), nearest_low(y, peak, level, 1)
    if top > 0 and lo != peak and hi != peak:
        def cross(i, j, flat):
            return flat if abs(y[j] - y[i]) < 1e-12 else x[i] + (x[j] - x[i]) * ((level - y[i]) / (y[j] - y[i]))
        left, right = float(cross(lo, lo + 1, x[lo])), float(cross(hi - 1, hi, x[hi - 1]))
        fwhm = right - left if right > left else None
    level = top * fraction
    lo, hi = nearest_low(y, peak, level, -1), nearest_low(y, peak, level, 1)
    return fwhm, left, right, float(run[hi] - run[lo]) if top > 0 else 0.0


SHAPES = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("fwhm", "left", "right", "area")])


@F.pandas_udf(SHAPES)
def shapes(x: pd.Series, y: pd.Series, peaks: pd.Series, fraction: pd.Series) -> pd.DataFrame:
    """Arrays of width at half height, its ends, and area down to ``fraction`` of the height, one value per peak index.

    One pass per curve; Arrow batches of curves in numpy, for long axes are too slow in interpreted array functions.
    """
    out = []
    for a, b, found, f in zip(x, y, peaks, fraction, strict=True):
        if a is None or b is None or found is None or not len(found):
            out.append(([], [], [], []))
            continue
        a, b = np.asarray(a, float), np.asarray(b, float)
        run = np.concatenate(([0.0], np.cumsum((b[1:] + b[:-1]) / 2 * np.abs(np.diff(a)))))
        out.append(tuple(map(list, zip(*(shape_of(a, b, run, int(i), f) for i in found), strict=True))))
    return pd.DataFrame(out, columns=["fwhm", "left", "right", "area"])


def with_shapes(found, y: str = "corrected", fraction: float = 0.005, out: str = "shape"):
    """Adds the ``shapes`` of ``peak_idx`` on a curve column."""
    return found.withColumn(out, shapes(F.col("two_theta"), F.col(y), F.col("peak_idx"), F.lit(float(fraction))))


def median_step(x: Column) -> Column:
    """Median absolute step of an axis."""
    return median(F.filter(F.transform(differences(x), lambda v: F.abs(v)), lambda v: v > 0))


def refined_position(x: Column, y: Column, peak: Column, step: Column) -> Column:
    """Vertex of the parabola through a maximum and its neighbours, within one step."""
    a, b, c = at(y, peak - 1), at(y, peak), at(y, peak + 1)
    curvature = a - b * 2 + c
    shift = F.least(F.greatest(F.try_divide((a - c) * 0.5, curvature), F.lit(-1.0)), F.lit(1.0))
    inner = (peak > 0) & (peak < F.size(y) - 1) & (F.abs(curvature) >= 1e-12)
    return F.when(inner, at(x, peak) + shift * step).otherwise(at(x, peak))


def noise_level(y: Column) -> Column:
    """Robust noise of a curve: scaled median deviation of its first differences."""
    def spread(resid):
        mid = median(resid)
        sigma = let(mid, lambda m: median(F.transform(resid, lambda v: F.abs(v - m))) * 1.4826)
        mu = mean(resid)
        std = let(mu, lambda m: F.sqrt(mean(F.transform(resid, lambda v: (v - m) * (v - m)))))
        return F.greatest(F.when(sigma > 0, sigma).otherwise(std), F.lit(1e-12))
    def residual(v):
        return F.when(F.size(v) > 2, F.transform(differences(v), lambda e: e / F.sqrt(F.lit(2.0)))).otherwise(v)
    return let(y, lambda v: let(residual(v), spread))


def correlation_similarity(a: Column, b: Column) -> Column:
    """Correlation of two equally long arrays mapped to 0..1; 0 when one is constant."""
    def build(m):
        num = total(F.zip_with(a, b, lambda u, v: (u - m["a"]) * (v - m["b"])))
        den = F.sqrt(total(F.transform(a, lambda u: (u - m["a"]) * (u - m["a"])))) * F.sqrt(
            total(F.transform(b, lambda v: (v - m["b"]) * (v - m["b"]))))
        c = F.try_divide(num, den)
        return F.coalesce(F.least(F.greatest((c + 1) / 2, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return let(F.struct(mean(a).alias("a"), mean(b).alias("b")), build)


def distance_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + root mean square difference)."""
    mse = F.try_divide(total(F.zip_with(a, b, lambda u, v: (u - v) * (u - v))), F.size(a))
    return F.coalesce(F.lit(1.0) / (F.sqrt(mse) + 1), F.lit(0.0))
