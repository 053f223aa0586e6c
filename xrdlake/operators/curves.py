"""Curve operators. Input: one row per curve with ``two_theta`` and ``intensity`` arrays.

Everything here is a projection of a row (no shuffle), apart from the joins that
bring a second curve or a correction table to a curve.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xrdlake.functions import series as S
from xrdlake.functions.geometry import bragg_d, bragg_two_theta, scherrer_nm
from xrdlake.operators import rule_tables as R

# Limits of a usable curve and of a rendered one.
MIN_POINTS = 10
MAX_RENDER_POINTS = 3000
QUARTZ_MIN_OFFSET = 0.02
ANCHOR_MIN_OFFSET = 0.05


def pack_points(points: DataFrame, key: str = "curve_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Long points to one row per curve, ordered by axis value."""
    packed = points.groupBy(key, *keep).agg(F.array_sort(F.collect_list(F.struct("two_theta", "intensity"))).alias("p"))
    return packed.select(key, *keep, F.col("p.two_theta").alias("two_theta"), F.col("p.intensity").alias("intensity"))


def explode_points(curves: DataFrame, *arrays: str, keep: tuple[str, ...] = ("curve_id",)) -> DataFrame:
    """One row per point with the named arrays as columns."""
    z = S.unnest_pos(curves, keep, F.arrays_zip(*arrays))
    return z.select(*keep, "idx", *[F.col(f"p.{a}").alias(a) for a in arrays])


def clean(curves: DataFrame) -> DataFrame:
    """Finite pairs only, intensity at least zero, sorted by axis."""
    def ok(v):
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    pairs = F.arrays_zip(F.col("two_theta"), F.col("intensity"))
    pairs = F.filter(pairs, lambda p: ok(p["two_theta"]) & ok(p["intensity"]))
    pairs = F.array_sort(F.transform(pairs, lambda p: F.struct(
        p["two_theta"].alias("x"), F.greatest(p["intensity"], F.lit(0.0)).alias("y"))))
    out = curves.withColumn("_p", pairs)
    return out.withColumn("two_theta", F.col("_p.x")).withColumn("intensity", F.col("_p.y")).drop("_p")


def validate(curves: DataFrame) -> DataFrame:
    """Point count, order, domains and warnings per curve."""
    x, y = F.col("two_theta"), F.col("intensity")
    rising = F.forall(S.indices(x), lambda i: (i == 0) | (S.at(x, i - 1) <= S.at(x, i)))
    n = F.least(F.size(x), F.size(y))
    warnings = F.array_compact(F.array(
        F.when(F.size(x) != F.size(y), "length_mismatch"), F.when(~rising, "axis_not_monotonic"),
        F.when(n < MIN_POINTS, "too_few_points")))
    return curves.select(
        "curve_id", n.alias("points"), rising.alias("monotonic"), F.when(n < 2, "invalid").otherwise("valid").alias("status"),
        F.array_min(x).alias("x_min"), F.array_max(x).alias("x_max"), F.array_min(y).alias("y_min"), F.array_max(y).alias("y_max"),
        warnings.alias("warnings"))


def smooth(curves: DataFrame, window: int = 5, order: int = 2, out: str = "smoothed", source: str = "intensity") -> DataFrame:
    return curves.withColumn(out, S.polynomial_smooth(F.col(source), window, order))


def process(curves: DataFrame, fraction: float = 0.10) -> DataFrame:
    """Smooth, remove the background, scale: adds ``smoothed``, ``corrected``, ``normalized``."""
    c = smooth(curves)
    c = c.withColumn("corrected", S.subtract_background(F.col("smoothed"), S.percentile_background(F.col("smoothed"), fraction)))
    return c.withColumn("normalized", S.normalize_max(F.col("corrected")))


def find_peaks(processed: DataFrame, threshold: float = 0.02, start: float = 4.0, distance: float = 0.18, limit: int | None = None) -> DataFrame:
    """Adds ``peak_idx``: indices of all maxima that stand apart (or the first ``limit``), strongest first."""
    x, y = F.col("two_theta"), F.col("normalized")
    return processed.withColumn("peak_idx", S.let(
        S.local_maxima(x, y, threshold, start), lambda c: S.strongest_apart(x, y, c, distance, limit)))


def peak_rows(found: DataFrame, keep: tuple[str, ...] = ("curve_id",), wavelength: float = 1.5406) -> DataFrame:
    """One row per peak: position, spacing, heights, width, area, crystallite size."""
    x, y = F.col("two_theta"), F.col("corrected")

    def row(i, k):
        return F.struct(
            (k + 1).alias("peak_index"), i.alias("source_index"), S.at(x, i).alias("two_theta"), S.at(y, i).alias("intensity"),
            (S.at(F.col("normalized"), i) * 100).alias("relative_intensity"),
            F.get("shape.fwhm", k).alias("fwhm"), F.get("shape.area", k).alias("area"))
    p = S.unnest(S.with_shapes(found), keep, F.transform("peak_idx", row)).select(*keep, "p.*")
    return p.withColumn("d", bragg_d("two_theta", wavelength)).withColumn("tau_nm", scherrer_nm("fwhm", "two_theta", wavelength))


def peaks(curves: DataFrame, keep: tuple[str, ...] = ("curve_id",), **opts) -> DataFrame:
    """Peak table of raw curves."""
    return peak_rows(find_peaks(process(curves), **opts), keep)


def light_peaks(found: DataFrame, keep: tuple[str, ...] = ("curve_id",)) -> DataFrame:
    """Positions and heights only, for window rules that need neither width nor area."""
    x = F.col("two_theta")
    p = S.unnest(found, keep, F.transform("peak_idx", lambda i, k: F.struct(
        (k + 1).alias("peak_index"), S.at(x, i).alias("two_theta"), S.at(F.col("corrected"), i).alias("intensity"),
        (S.at(F.col("normalized"), i) * 100).alias("relative_intensity")))).select(*keep, "p.*")
    return p.withColumn("d", bragg_d("two_theta"))


def compact_points(curves: DataFrame, limit: int | None = None) -> DataFrame:
    """Adds ``compact``: the points of a curve by height, all or the first ``limit``."""
    ranked = F.array_sort(F.transform(F.arrays_zip("two_theta", "intensity"), lambda p: F.struct(
        (-p["intensity"]).alias("h"), p["two_theta"].alias("two_theta"), p["intensity"].alias("intensity"))))
    return curves.withColumn("compact", ranked if limit is None else F.slice(ranked, 1, limit))


def targeted_quality(relative_height: Column, contrast: Column, is_max: Column) -> Column:
    """Quality of the strongest point of a window."""
    return (F.when(contrast < 0.003, "not_found")
            .when(~is_max & ((relative_height >= 0.008) | (contrast >= 0.008)), "shoulder")
            .when((relative_height >= 0.05) & (contrast >= 0.02) & is_max, "strong")
            .when((contrast >= 0.006) | ((relative_height >= 0.006) & is_max), "weak")
            .otherwise("not_found"))


def targeted_scan(processed: DataFrame, keep: tuple[str, ...] = ("curve_id",)) -> DataFrame:
    """Best point of each diagnostic window on the corrected curve, one row per curve and window."""
    x, y = F.col("two_theta"), F.col("corrected")
    windows = R.literal_rows(
        [(rid, mineral, bragg_two_theta(F.lit(hi)), bragg_two_theta(F.lit(lo))) for rid, mineral, lo, hi in R.targeted_rows()],
        ("range_id", "mineral", "lo", "hi"))

    def scan(w):
        inside = F.filter(S.indices(x), lambda i: (S.at(x, i) >= w["lo"]) & (S.at(x, i) <= w["hi"]))
        return S.let(inside, lambda idx: measure(w, idx))

    def measure(w, idx):
        heights = F.transform(idx, lambda i: S.at(y, i))
        best = F.array_min(F.transform(idx, lambda i: F.struct((-S.at(y, i)).alias("h"), i.alias("i"))))["i"]
        return S.let(F.struct(best.alias("i"), F.array_max(heights).alias("hi"), F.array_min(heights).alias("lo")), lambda m: F.struct(
            w["range_id"].alias("range_id"), w["mineral"].alias("mineral"), F.size(idx).alias("window_points"), m["i"].alias("i"),
            S.at(x, m["i"]).alias("x"), m["hi"].alias("height"), ((m["hi"] - m["lo"]) / F.col("top")).alias("contrast"),
            F.coalesce((m["i"] > 0) & (m["i"] < F.size(y) - 1) & (m["hi"] >= S.at(y, m["i"] - 1)) & (m["hi"] >= S.at(y, m["i"] + 1)),
                       F.lit(False)).alias("is_max")))
    t = processed.withColumn("top", F.when(F.array_max(y) > 0, F.array_max(y)).otherwise(F.lit(1.0)))
    w = S.unnest(t, (*keep, "top"), F.transform(windows, scan)).select(*keep, "top", "p.*")
    w = w.withColumn("relative_height", F.col("height") / F.col("top"))
    w = w.withColumn("quality", F.when(F.col("i").isNull(), "not_found").otherwise(
        targeted_quality(F.col("relative_height"), F.col("contrast"), F.col("is_max"))))
    seen = F.col("quality") != "not_found"
    return w.select(
        *keep, "range_id", "mineral", "quality", "window_points", "contrast",
        F.when(seen, F.col("x")).alias("two_theta"), F.when(seen, bragg_d("x")).alias("d"),
        F.when(seen, F.col("height")).alias("intensity"), F.when(seen, F.col("relative_height") * 100).alias("relative_intensity"),
        F.when(seen, F.col("i")).alias("source_index"))


def merge_targeted(listed: DataFrame, targeted: DataFrame, tolerance: float = 0.04) -> DataFrame:
    """Listed peaks plus the targeted ones with no peak within ``tolerance`` angstrom.

    Targeted rows of one curve are taken in window order and also block each
    other. Windows per curve are fixed in number, so the fold is small.
    """
    order = {rid: n for n, (rid, *_rest) in enumerate(R.TARGETED_WINDOWS)}
    rank = F.create_map(*[F.lit(v) for kv in order.items() for v in kv])
    a = listed.select("curve_id", F.lit(-1).alias("o"), "two_theta", "d", "intensity", F.lit("detected").alias("source"))
    b = targeted.where("d IS NOT NULL").select(
        "curve_id", F.element_at(rank, F.col("range_id")).alias("o"), "two_theta", "d", "intensity",
        F.concat(F.lit("targeted:"), "range_id").alias("source"))
    rows = a.unionByName(b).groupBy("curve_id").agg(
        F.array_sort(F.collect_list(F.struct("o", "two_theta", "d", "intensity", "source"))).alias("all"))
    empty = F.expr("cast(array() as array<struct<o:int,two_theta:double,d:double,intensity:double,source:string>>)")
    kept = F.aggregate("all", empty, lambda acc, p: F.when(
        (p["o"] >= 0) & F.exists(acc, lambda k: F.abs(k["d"] - p["d"]) <= tolerance), acc).otherwise(F.array_append(acc, p)))
    return S.unnest(rows, ("curve_id",), kept).select("curve_id", "p.two_theta", "p.d", "p.intensity", "p.source")


def quartz_offset(curves: DataFrame, window: int = 25, order: int = 2, min_percent: float = 2.0) -> DataFrame:
    """Axis offset from the strongest maximum of the quartz 101 window; null when none qualifies."""
    lo, hi = R.NAMED_RANGES["quartz_101"]
    x = F.col("two_theta")
    c = smooth(curves, window, order, out="sq")
    y = F.col("sq")
    inside = F.filter(S.indices(x), lambda i: (S.at(x, i) >= bragg_two_theta(F.lit(hi))) & (S.at(x, i) <= bragg_two_theta(F.lit(lo))))
    c = c.withColumn("inside", inside).withColumn("level", F.array_max(y) * (min_percent / 100.0))
    maxima = F.filter("inside", lambda i: (S.at(y, i) >= F.col("level"))
                      & (S.at(y, i) >= F.coalesce(S.at(y, i - 1), S.at(y, i))) & (S.at(y, i) >= F.coalesce(S.at(y, i + 1), S.at(y, i))))
    strongest = lambda idx: F.array_min(F.transform(idx, lambda i: F.struct((-S.at(y, i)).alias("h"), i.alias("i"))))["i"]
    c = c.withColumn("best", F.coalesce(strongest(maxima), strongest(F.col("inside"))))
    ok = (F.size(y) >= MIN_POINTS) & (F.array_max(y) > 0) & (S.at(y, F.col("best")) >= F.col("level"))
    seen = F.when(ok, S.at(x, F.col("best")))
    out = [c for c in curves.columns if c not in ("two_theta", "intensity")]
    return c.select(*out, seen.alias("observed_two_theta"), bragg_d(seen).alias("observed_d"),
                    (bragg_two_theta(F.lit(R.QUARTZ_TARGET)) - seen).alias("offset"))


def align_axis(curves: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Shift the axis by the first offset that applies.

    Order: manual correction of the curve; anchor of a glycolated or calcined
    curve at the start of the natural curve of its sample (more than 0.05
    degrees); quartz 101 offset (more than 0.02 degrees). A sample with an
    anchor does not use its quartz line. ``manual`` holds ``curve_id, offset``.
    """
    q = quartz_offset(curves.select("curve_id", "two_theta", "intensity")).select("curve_id", F.col("offset").alias("quartz"))
    natural = curves.where("preparation = 'natural'").groupBy("sample_base").agg(
        F.min_by(F.array_min("two_theta"), "curve_id").alias("target_start"))
    c = curves.join(natural, "sample_base", "left").join(q, "curve_id", "left")
    if manual is None:
        c = c.withColumn("manual", F.lit(None).cast("double"))
    else:
        c = c.join(manual.select("curve_id", F.col("offset").alias("manual")), "curve_id", "left")
    anchored = F.col("preparation").isin("glicolado", "calcinado") & F.col("target_start").isNotNull()
    shift = F.col("target_start") - F.array_min("two_theta")
    method = (F.when(F.col("manual").isNotNull(), "manual_offset")
              .when(anchored & (F.abs(shift) > ANCHOR_MIN_OFFSET), "ngc_natural_start_anchor")
              .when(~anchored & (F.abs("quartz") > QUARTZ_MIN_OFFSET), "quartz_101_absolute_anchor"))
    c = c.withColumn("method", method).withColumn("offset", F.round(
        F.when(F.col("method") == "manual_offset", F.col("manual")).when(F.col("method") == "ngc_natural_start_anchor", shift)
        .when(F.col("method") == "quartz_101_absolute_anchor", F.col("quartz")), 6))
    moved = F.transform("two_theta", lambda v: F.round(v + F.coalesce("offset", F.lit(0.0)), 6))
    return c.withColumn("original_start", F.array_min("two_theta")).withColumn("two_theta", moved).drop("quartz", "manual", "target_start")


def align_batch(curves: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Axes of a batch of treatment series, one anchor per sample.

    The natural curve moves by its quartz offset, whatever its size (0 where no quartz is seen); the others move so that they start
    where it then starts. A sample without a natural curve is anchored to the start of the first of calcined
    and glycolated. A manual correction of a curve (``curve_id, offset``) goes before all that.
    """
    q = quartz_offset(curves.where("preparation = 'natural'").select("curve_id", "two_theta", "intensity")).select("curve_id", F.coalesce("offset", F.lit(0.0)).alias("moved"))
    order = F.when(F.col("preparation") == "natural", 0).when(F.col("preparation") == "calcinado", 1).otherwise(2)
    starts = curves.join(q, "curve_id", "left").groupBy("sample_base").agg(
        F.min(F.struct(order.alias("o"), "curve_id", F.array_min("two_theta").alias("start"), F.coalesce("moved", F.lit(0.0)).alias("moved"))).alias("anchor"))
    c = curves.join(starts, "sample_base")
    shift = F.col("anchor.start") + F.col("anchor.moved") - F.array_min("two_theta")
    if manual is not None:
        c = c.join(manual.select("curve_id", F.col("offset").alias("by_hand")), "curve_id", "left")
        shift = F.coalesce("by_hand", shift)
    c = c.withColumn("offset", F.round(shift, 6))
    return c.withColumn("two_theta", F.transform("two_theta", lambda v: F.round(v + F.col("offset"), 6))).drop("anchor", "by_hand")


def shift_peaks(peak_table: DataFrame, offset: str = "offset") -> DataFrame:
    """Move the angles of a peak table and recompute the spacing."""
    tt = F.round(F.col("two_theta") + F.coalesce(F.col(offset), F.lit(0.0)), 6)
    return peak_table.withColumn("two_theta", tt).withColumn("d", F.round(bragg_d("two_theta"), 5))


def decimate(curves: DataFrame, max_points: int = MAX_RENDER_POINTS, arrays: tuple[str, ...] = ("two_theta", "intensity")) -> DataFrame:
    """Every k-th point so that at most ``max_points`` stay."""
    out = curves.withColumn("_k", F.greatest(F.ceil(F.size(arrays[0]) / max_points), F.lit(1)))
    for a in arrays:
        out = out.withColumn(a, F.filter(F.col(a), lambda v, i: F.pmod(i, F.col("_k")) == 0))
    return out.drop("_k")


def common_grid(left_x: Column, right_x: Column, max_points: int = 1200) -> Column:
    """Axis shared by two curves: their overlap at the coarser step."""
    def mid(x):
        return S.let(F.array_sort(F.filter(F.transform(S.differences(x), lambda v: F.round(v, 8)), lambda v: v > 0)),
                     lambda s: S.at(s, F.floor(F.size(s) / 2).cast("int")))

    def build(g):
        n = (F.floor((g["hi"] - g["lo"]) / g["step"]) + 1).cast("int")
        return F.when(g["hi"] > g["lo"], F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.round(g["lo"] + i * g["step"], 6))).otherwise(
            F.expr("cast(array() as array<double>)"))
    lo = F.greatest(F.array_min(left_x), F.array_min(right_x))
    hi = F.least(F.array_max(left_x), F.array_max(right_x))
    step = F.greatest(mid(left_x), mid(right_x), (hi - lo) / (max_points - 1))
    return S.let(F.struct(lo.alias("lo"), hi.alias("hi"), step.alias("step")), build)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def resample(x: pd.Series, y: pd.Series, grid: pd.Series) -> pd.Series:
    """Linear interpolation of a sorted curve onto a grid, constant outside."""
    return pd.Series([
        np.interp(g, a, b) if g is not None and a is not None and len(a) else np.empty(0)
        for a, b, g in zip(x, y, grid)])


@F.pandas_udf(T.StructType([T.StructField("correlation", T.DoubleType()), T.StructField("distance", T.DoubleType())]))
def shapes_of(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.DataFrame:
    """What :func:`shape_similarity` has before rounding, for many pairs: curves on a shared axis, scaled, then correlation and distance."""
    out = np.zeros((len(x1), 2))
    for k, (xa, ya, xb, yb) in enumerate(zip(x1, y1, x2, y2)):
        if not all(v is not None and len(v) > 1 for v in (xa, ya, xb, yb)):
            continue
        lo, hi = max(xa.min(), xb.min()), min(xa.max(), xb.max())
        if hi <= lo:
            continue
        middles = [np.sort(d[d > 0]) for d in (np.round(np.diff(xa), 8), np.round(np.diff(xb), 8))]
        step = max([(hi - lo) / 1199] + [d[len(d) // 2] for d in middles if len(d)])
        grid = np.round(lo + np.arange(int((hi - lo) / step) + 1) * step, 6)
        if len(grid) < 3:
            continue
        u, v = (np.maximum(np.interp(grid, x, y), 0.0) for x, y in ((xa, ya), (xb, yb)))
        u, v = (w / w.max() if w.max() > 0 else w for w in (u, v))
        du, dv = u - u.mean(), v - v.mean()
        size = np.sqrt((du * du).sum()) * np.sqrt((dv * dv).sum())
        out[k] = min(max(((du * dv).sum() / size + 1) / 2, 0.0), 1.0) if size else 0.0, 1 / (1 + np.sqrt(((u - v) ** 2).mean()))
    return pd.DataFrame(out, columns=["correlation", "distance"])


def shape_scores(pairs: DataFrame) -> DataFrame:
    """:func:`shape_similarity` for large numbers of pairs, in numpy on Arrow batches; the other columns stay."""
    p = pairs.withColumn("_s", shapes_of("x1", "y1", "x2", "y2")).drop("x1", "y1", "x2", "y2")
    return p.withColumn("shape", F.round(F.round("_s.correlation", 4) * 0.60 + F.round("_s.distance", 4) * 0.40, 4)).drop("_s")


def shape_similarity(pairs: DataFrame) -> DataFrame:
    """Similarity of two curves per row (columns ``x1, y1, x2, y2``) over their shared axis."""
    p = pairs.withColumn("grid", common_grid(F.col("x1"), F.col("x2")))
    p = p.withColumn("r1", resample("x1", "y1", "grid")).withColumn("r2", resample("x2", "y2", "grid"))
    p = p.withColumn("n1", S.normalize_max(F.col("r1"))).withColumn("n2", S.normalize_max(F.col("r2")))
    ok = F.size("grid") >= 3
    corr = F.round(S.correlation_similarity(F.col("n1"), F.col("n2")), 4)
    dist = F.round(S.distance_similarity(F.col("n1"), F.col("n2")), 4)
    p = p.withColumn("correlation", F.when(ok, corr).otherwise(F.lit(0.0))).withColumn("distance", F.when(ok, dist).otherwise(F.lit(0.0)))
    p = p.withColumn("shape", F.round(F.col("correlation") * 0.60 + F.col("distance") * 0.40, 4))
    return p.drop("x1", "y1", "x2", "y2", "r1", "r2", "n1", "n2", "grid")


def compare_profiles(pairs: DataFrame) -> DataFrame:
    """Residuals of an observed against a calculated profile (arrays ``observed``, ``calculated``)."""
    both = F.least(F.size("observed"), F.size("calculated"))
    obs, calc = F.slice("observed", 1, both), F.slice("calculated", 1, both)
    resid = F.zip_with(obs, calc, lambda a, b: F.abs(a - b))
    p = pairs.withColumn("resid", resid)
    rmse = F.sqrt(S.mean(F.transform("resid", lambda v: v * v)))
    return p.withColumn("points", F.size("resid")).withColumn("mae", S.mean(F.col("resid"))).withColumn(
        "max_error", F.array_max("resid")).withColumn("rmse", rmse).withColumn(
        "status", F.when(F.col("points") == 0, "insufficient_data").when(F.size("observed") != F.size("calculated"), "shape_mismatch")
        .otherwise("valid")).withColumn(
        "fit", F.when(F.col("mae") <= 0.25, "good").when(F.col("mae") <= 0.45, "fair").otherwise("poor")).drop("resid", "observed", "calculated")


# Vertical order of treatments in a stacked display.
STACK_ORDER = {"natural": 0, "glicolado": 1, "calcinado": 2, "indeterminado": 3}


def stacked(curves: DataFrame, gap: float = 1.2) -> DataFrame:
    """Scaled curve lifted by the rank of its treatment."""
    rank = F.create_map(*[F.lit(v) for kv in STACK_ORDER.items() for v in kv])
    lift = F.coalesce(F.try_element_at(rank, F.col("preparation")), F.lit(3)) * F.lit(gap)
    return curves.withColumn("display", S.let(S.normalize_max(F.col("intensity")), lambda n: F.transform(n, lambda v: v + lift)))


def display_series(curves: DataFrame, max_points: int = 5000) -> DataFrame:
    """Cleaned, decimated, scaled curve with spacing axis and axis provenance."""
    c = decimate(clean(curves).withColumn("source_points", F.size("two_theta")), max_points)
    c = c.withColumn("normalized", F.transform(S.normalize_max(F.col("intensity")), lambda v: F.round(v * 100, 6)))
    c = c.withColumn("d_spacing", F.transform("two_theta", lambda t: F.round(bragg_d(t), 6)))
    mode = F.when(F.col("offset").isNotNull(), "classified_or_aligned_axis") if "offset" in curves.columns else F.when(F.lit(False), "")
    return c.withColumn("axis_mode", mode.otherwise("loaded_axis")).withColumn("decimated", F.size("two_theta") < F.col("source_points"))


def detector(curves: DataFrame, window: int = 11, order: int = 3, half: int = 10, min_snr: float = 5.0, distance: float = 0.10,
             keep: tuple[str, ...] = ("curve_id",)) -> DataFrame:
    """Peaks above a noise gate: refined position, width, local area, signal-to-noise."""
    x = F.col("two_theta")
    c = curves.withColumn("corrected", S.subtract_background(F.col("intensity"), S.asymmetric_background(F.col("intensity"), half)))
    c = c.withColumn("smoothed", S.polynomial_smooth(F.col("corrected"), window, order))
    c = c.withColumn("noise", S.noise_level(F.zip_with("corrected", "smoothed", lambda a, b: a - b)))
    c = c.withColumn("step", S.median_step(x))
    c = c.withColumn("peak_idx", S.let(
        F.filter(S.local_maxima(x, F.col("smoothed"), 0.0, -1e9), lambda i: F.greatest(S.at(F.col("smoothed"), i), S.at(F.col("corrected"), i)) / F.col("noise") >= min_snr),
        lambda k: S.strongest_apart(x, F.col("smoothed"), k, distance)))

    # a generator in between: kernels can't be planned when one's input is nested in another's lambdas
    worked = ("corrected", "smoothed", "noise", "step", "peak_idx")
    c = c.select(*dict.fromkeys((*keep, "two_theta")), F.explode(F.array(F.struct(*worked))).alias("w")).select(*dict.fromkeys((*keep, "two_theta")), *[F.col(f"w.{k}").alias(k) for k in worked])
    c = S.with_shapes(S.with_shapes(c, "smoothed", out="wide"), "corrected", 0.5, "local")

    def row(i, k):
        y = F.col("smoothed")
        return F.struct(
            (k + 1).alias("peak_id"), S.refined_position(x, y, i, F.col("step")).alias("position"), F.get("wide.fwhm", k).alias("fwhm"),
            F.get("local.area", k).alias("area"),
            (F.greatest(S.at(y, i), S.at(F.col("corrected"), i)) / F.col("noise")).alias("snr"))
    return S.unnest(c, (*keep, "noise", "step"), F.transform("peak_idx", row)).select(*keep, "noise", "step", "p.*")


def explain_peaks(detected: DataFrame) -> DataFrame:
    """Medians per curve and the influence window of every peak."""
    med = detected.groupBy("curve_id").agg(F.median("snr").alias("snr_median"), F.median("fwhm").alias("fwhm_median"), F.count("*").alias("n_peaks"))
    d = detected.withColumn("window_low", F.col("position") - 2 * F.col("fwhm")).withColumn("window_high", F.col("position") + 2 * F.col("fwhm"))
    return d.join(med, "curve_id")


def broad_flags(peak_table: DataFrame, by: tuple[str, ...] = ("curve_id",)) -> DataFrame:
    """Counts of broad peaks under the three width rules."""
    w, d = F.col("fwhm"), F.col("d")
    return peak_table.groupBy(*by).agg(
        F.count_if(w > 0.5).alias("over_0_5"), F.count_if(w >= 0.6).alias("over_0_6"),
        F.count_if((w >= 0.8) & d.between(9.0, 18.6)).alias("over_0_8_basal"))
