"""Matching of peaks, lines and windows.

Window tables are literals of known size. Joins of two large peak sets go
through :func:`near_join`, an equi join on buckets of the tolerance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xrdlake.functions import series as S
from xrdlake.functions.geometry import bragg_two_theta, cubic_d, tetragonal_d
from xrdlake.functions.text import formula_compatible, mineral_name_key
from xrdlake.functions.values import curation_status
from xrdlake.operators import rule_tables as R
from xrdlake.operators.assignment import POSITION_2THETA, POSITION_D, WEIGHT_INTENSITY, WEIGHT_POSITION, WEIGHT_WIDTH, References, numbers, picked
from xrdlake.operators.cells import in_cells
from xrdlake.operators.hot import looked_up
from xrdlake.session import written


def window_hits(peaks: DataFrame, windows: Column, condition=None, value: str = "d") -> DataFrame:
    """Peaks x literal windows that hold their spacing; windows carry ``d_min`` and ``d_max``."""
    def inside(w):
        ok = (F.col(value) >= w["d_min"]) & (F.col(value) <= w["d_max"])
        return ok if condition is None else ok & condition(w)
    return peaks.select("*", F.explode_outer(F.filter(windows, inside)).alias("w")).where("w IS NOT NULL")


def diagnostic_matches(peaks: DataFrame) -> DataFrame:
    """Peaks inside a diagnostic window; some windows ask for one treatment."""
    rows = R.literal_rows(R.diagnostic_rows(), ("rule_id", "mineral", "required", "d_min", "d_max"))
    hit = window_hits(peaks, rows, lambda w: (w["required"] == "any") | F.col("preparation").isNull() | (F.col("preparation") == w["required"]))
    return hit.select("*", "w.rule_id", "w.mineral", F.abs(F.col("d") - (F.col("w.d_min") + F.col("w.d_max")) / 2).alias("delta_center")).drop("w")


#: Curves and references of a cell that gives all their pairs.
CELL_CURVES, CELL_REFERENCES = 1_000, 2_000
#: Left rows of one bucket that one task joins; fuller buckets are split.
BUCKET_ROWS = 50_000


def near_join(left: DataFrame, right: DataFrame, value: str, right_value: str, tolerance: float, salt_by=("curve_id",), on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs whose values differ by at most ``tolerance``, as an equi join on buckets of that width.

    The right side (a library of lines) is put into its own and both neighbouring buckets. The left side is written once and its buckets are
    counted: a bucket of more than ``BUCKET_ROWS`` rows is split by hashes of ``salt_by``, and only there the right side is repeated.
    The list of full buckets has at most a row per ``BUCKET_ROWS`` left rows, so it may be broadcast.
    """
    width = float(tolerance)
    bucket = lambda c: F.floor(F.col(c) / width)
    a = written(left.withColumn("_b", bucket(value)), "near-left")
    b = right.withColumn("_b", F.explode(F.array(*[bucket(right_value) + k for k in (-1, 0, 1)])))
    key = [*on, "_b"]
    full = written(a.groupBy(*key).agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("_k")).where("_k > 1"), "near-full")
    if not full.isEmpty():
        shares = F.coalesce("_k", F.lit(1))
        a = a.join(F.broadcast(full), key, "left").withColumn("_s", F.pmod(F.hash(*salt_by), shares)).drop("_k")
        b = b.join(F.broadcast(full), key, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_k")
        key = [*key, "_s"]
    j = a.join(b, key)
    return j.where(F.abs(F.col(value) - F.col(right_value)) <= tolerance).drop("_b", "_s")


def match_reference_lines(peaks: DataFrame, lines: DataFrame, tolerance: float = 0.25, line_limit: int | None = None) -> DataFrame:
    """Score every curve against every reference that shares a line position.

    ``lines``: reference_id, line_index, ref_two_theta, ref_intensity. Lines take, in their order, the nearest peak that is still free.
    Slices of curves meet shards of references in bounded cells, so no pair of a peak and a line is shuffled.
    """
    lib = (lines if line_limit is None else lines.where(F.col("line_index") < line_limit)).where("reference_id IS NOT NULL")
    weight = F.coalesce(F.col("ref_intensity").cast("double"), F.lit(1.0))
    kept = lib.groupBy("reference_id").agg(
        F.collect_list(F.struct(F.col("line_index").cast("double").alias("k"), F.col("ref_two_theta").cast("double").alias("x"), weight.alias("w"))).alias("lines"),
        F.count("*").alias("reference_lines"), F.sum(weight).alias("total_weight"))
    kept = written(kept, "matched-lines")
    sets = peaks.where("two_theta IS NOT NULL AND NOT isnan(two_theta)").groupBy("curve_id").agg(
        F.collect_list(F.struct(F.col("two_theta").cast("double").alias("x"), F.col("peak_index").cast("double").alias("k"))).alias("peaks"))
    sets = written(sets, "matched-peaks")
    slices = max(math.ceil(sets.count() / CELL_CURVES), peaks.sparkSession.sparkContext.defaultParallelism)
    shards = max(math.ceil(kept.count() / CELL_REFERENCES), 1)
    out = T.StructType([T.StructField("curve_id", sets.schema["curve_id"].dataType), T.StructField("reference_id", kept.schema["reference_id"].dataType),
                        T.StructField("matched_lines", T.IntegerType()), T.StructField("reference_lines", T.LongType()), T.StructField("total_weight", T.DoubleType()),
                        T.StructField("weight", T.DoubleType())])

    def cell(curves: pa.Table, library: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        return match_cell(curves, library, to_arrow_schema(out), tolerance)

    g = in_cells(sets, "curve_id", slices, kept, "reference_id", shards, cell, out)
    coverage = F.col("matched_lines") / F.col("reference_lines")
    weighted = F.try_divide(F.col("weight"), F.col("total_weight"))
    return g.select("curve_id", "reference_id", "matched_lines", "reference_lines", coverage.alias("coverage"),
                    weighted.alias("weighted_coverage"), (coverage * 0.45 + weighted * 0.55).alias("score"))


def match_cell(curves: pa.Table, library: pa.Table, schema: pa.Schema, tolerance: float) -> pa.Table:
    """All curves of a cell against its references."""
    if not curves.num_rows or not library.num_rows:
        return schema.empty_table()
    curves, library = curves.combine_chunks(), library.combine_chunks()
    lists, peaks = library.column("lines").combine_chunks(), curves.column("peaks").combine_chunks()
    sizes = lambda v: pc.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
    lines, flat = lists.flatten(), peaks.flatten()
    refs = References(sizes(lists), *(numbers(lines.field(k)) for k in "kxw"), tolerance)
    found = []
    for strip, n, weight in refs.match(sizes(peaks), *(numbers(flat.field(k)) for k in "xk")):
        at, owner = np.nonzero(n)
        matched, weight, at = n[at, owner], weight[at, owner], at + strip.start
        of = [picked(library.column(k), at) for k in ("reference_id", "reference_lines", "total_weight")]
        found.append(pa.table([picked(curves.column("curve_id"), owner), of[0], pa.array(matched), *of[1:], pa.array(weight)], schema=schema))
    return pa.concat_tables(found)


def peak_set(found: DataFrame, limit: int | None = None) -> Column:
    """The peaks of a processed curve with ``shape`` (``series.with_shapes``), all or the strongest ``limit``, as an array of structs."""
    from xrdlake.functions.geometry import bragg_d

    x = F.col("two_theta")
    return F.transform("peak_idx" if limit is None else F.slice("peak_idx", 1, limit), lambda i, k: F.struct(
        S.at(x, i).alias("t"), bragg_d(S.at(x, i)).alias("d"), (S.at(F.col("normalized"), i) * 100).alias("i"),
        F.get("shape.fwhm", k).alias("w")))


def _pair_score(a, b) -> Column:
    """Similarity of two peaks; null when their positions do not meet."""
    dt, dd = F.abs(a["t"] - b["t"]), F.abs(a["d"] - b["d"])
    pos = F.greatest(F.when(dt <= POSITION_2THETA, 1 - dt / POSITION_2THETA), F.when(dd <= POSITION_D, 1 - dd / POSITION_D))

    def rel(u, v):
        return F.abs(u - v) / F.greatest(F.abs(u), F.abs(v), F.lit(1.0))

    def closeness(u, v, span):
        r = rel(u, v)
        return F.when(r.isNotNull(), F.greatest(F.lit(0.0), 1 - r / span))
    si, sw = closeness(a["i"], b["i"], 0.50), closeness(a["w"], b["w"], 0.75)
    num = pos * WEIGHT_POSITION + F.coalesce(si * WEIGHT_INTENSITY, F.lit(0.0)) + F.coalesce(sw * WEIGHT_WIDTH, F.lit(0.0))
    den = F.lit(WEIGHT_POSITION) + F.when(si.isNotNull(), F.lit(WEIGHT_INTENSITY)).otherwise(F.lit(0.0)) + F.when(
        sw.isNotNull(), F.lit(WEIGHT_WIDTH)).otherwise(F.lit(0.0))
    return num / den


def peak_set_similarity(left: Column, right: Column) -> Column:
    """Struct(score, matched): greedy one-to-one match of two peak arrays, left order first."""
    start = F.expr("cast(array() as array<struct<s:double,j:int>>)")

    def best(acc, a):
        scored = F.transform(right, lambda b, j: F.struct((-_pair_score(a, b)).alias("n"), j.alias("j")))
        free = F.filter(scored, lambda c: c["n"].isNotNull() & ~F.exists(acc, lambda k: k["j"] == c["j"]))
        return S.let(F.array_min(free), lambda m: F.when(m.isNull(), acc).otherwise(
            F.array_append(acc, F.struct((-m["n"]).alias("s"), m["j"].alias("j")))))
    matched = F.aggregate(left, start, best)
    return S.let(matched, lambda m: F.struct(
        F.when(F.size(m) > 0, F.round(F.size(m) / F.greatest(F.size(left), F.lit(1)) * S.mean(F.transform(m, lambda k: k["s"])), 4))
        .otherwise(F.lit(0.0)).alias("score"), F.size(m).alias("matched")))


def nearest_window(value: Column, limit: float | None = None) -> Column:
    """Struct(delta, range_id): the named window whose centre is nearest, optionally within a limit."""
    centres = R.literal_rows([(rid, (lo + hi) / 2) for rid, (lo, hi) in R.NAMED_RANGES.items()], ("range_id", "center"))
    near = F.array_min(F.transform(centres, lambda w: F.struct(F.abs(value - w["center"]).alias("delta"), w["range_id"].alias("range_id"))))
    return near if limit is None else S.let(near, lambda n: F.when(n["delta"] <= limit, n))


def strongest_in_windows(peaks: DataFrame, windows: Column, keys: list[str]) -> DataFrame:
    """Strongest peak per key and window; equal heights go to the larger spacing."""
    hit = window_hits(peaks, windows)
    return hit.groupBy(*keys, F.col("w.range_id").alias("range_id")).agg(
        F.max_by(F.struct("d", "intensity", "two_theta"), F.struct("intensity", "d")).alias("p")).select(*keys, "range_id", "p.*")


def compare_sources(peaks: DataFrame, sources: dict[str, Column]) -> DataFrame:
    """Peaks inside the windows of several sources (arrays of range_id, mineral, preparation, d_min, d_max)."""
    rows = F.flatten(F.array(*[F.transform(w, lambda r, name=None: F.struct(
        r["mineral"].alias("mineral"), r["range_id"].alias("range_id"), r["preparation"].alias("preparation"),
        r["d_min"].alias("d_min"), r["d_max"].alias("d_max"), r["source"].alias("source"))) for w in sources.values()]))
    need = lambda w: (w["preparation"] == "") | (w["preparation"] == F.col("preparation"))
    return window_hits(peaks, rows, need).select(
        "curve_id", "peak_index", F.col("preparation").alias("preparation"), "d", F.col("w.source").alias("source"), F.col("w.mineral").alias("mineral"),
        F.col("w.range_id").alias("range_id"))


def hkl_lines(cells: DataFrame, max_index: int = 6, wavelength: float = 1.5406) -> DataFrame:
    """Reflections of each lattice cell (cell_id, crystal_system, a, c)."""
    axis = F.sequence(F.lit(0), F.lit(max_index))
    t = cells.withColumn("h", F.explode(axis)).withColumn("k", F.explode(axis)).withColumn("l", F.explode(axis)).where("h + k + l > 0")
    d = F.when(F.col("crystal_system") == "cubic", cubic_d("a", "h", "k", "l")).when(
        F.col("crystal_system") == "tetragonal", tetragonal_d("a", "c", "h", "k", "l"))
    return t.withColumn("line_d", d).withColumn("line_two_theta", bragg_two_theta("line_d", wavelength)).where("line_two_theta IS NOT NULL")


def index_peaks(peaks: DataFrame, cells: DataFrame, tolerance: float = 0.2, max_index: int = 6) -> DataFrame:
    """The nearest reflection within ``tolerance`` degrees of each peak, and how many there are.

    Cells of equal parameters have equal reflections and peaks of one position have one answer, so cells count once per lattice, lines once per position, and
    positions of peaks are joined once; the answers then go to the peaks. Of equally near reflections the first by cell and indices stands.
    """
    peaks = written(peaks.select("curve_id", "peak_index", "two_theta"), "indexed-peaks")
    lattices = cells.groupBy("crystal_system", "a", "c").agg(F.count("*").alias("cells"), F.min("cell_id").alias("cell_id"))
    lines = hkl_lines(lattices, max_index).groupBy("line_two_theta").agg(F.sum("cells").alias("lines"), F.min(F.struct("cell_id", "h", "k", "l")).alias("first"))
    j = near_join(peaks.select("two_theta").distinct(), lines, "two_theta", "line_two_theta", tolerance, salt_by=("two_theta",))
    delta = F.round(F.abs(F.col("two_theta") - F.col("line_two_theta")), 9)
    best = j.groupBy("two_theta").agg(F.sum("lines").alias("matches"), F.min(F.struct(delta.alias("delta"), "first")).alias("b"))
    best = written(best.select("two_theta", "matches", "b.delta", "b.first.*"), "indexed-positions")
    return looked_up(peaks, best, "two_theta").where("matches IS NOT NULL").select("curve_id", "peak_index", "matches", "delta", "cell_id", "h", "k", "l")


def pattern_match_score(df: DataFrame) -> DataFrame:
    """Score of an external pattern against a vocabulary term, with curation status.

    Columns: mineral, matched_name, formula, external_formula, family,
    external_family, category, has_measured_xrd, has_dif, has_cif, has_error.
    A partial name adds and takes away the same amount, so it counts nothing.
    """
    # keys and formula comparison are computed once, as columns of their own
    df = df.withColumn("_a", F.coalesce(mineral_name_key("mineral"), F.lit(""))).withColumn("_b", F.coalesce(mineral_name_key("matched_name"), F.lit("")))
    df = df.withColumn("_comp", formula_compatible("formula", "external_formula"))
    a, b, comp = F.col("_a"), F.col("_b"), F.col("_comp")
    exact = (a != "") & (a == b)
    partial = (a != "") & (b != "") & (a != b) & (b.contains(a) | a.contains(b))
    fam = F.coalesce((F.col("family") != "") & (F.col("family") == F.col("external_family")), F.lit(False))
    pts = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    score = (pts(exact, 0.50) + pts(comp, 0.20) + pts(~comp, -0.40) + pts(fam, 0.15) + pts(F.col("has_measured_xrd"), 0.10)
             + pts(F.col("has_dif"), 0.10) + pts(F.col("has_cif"), 0.05) + pts(F.col("has_error"), -0.30)
             + pts(F.lower("category").isin("group", "clay_material") & (b != "") & (a != b), -0.30))
    basis = F.array_compact(F.array(
        F.when(exact, "exact_name").when(partial, "partial_name"), F.when(comp, "formula_compatible"), F.when(fam, "family_compatible"),
        F.when(F.col("has_measured_xrd"), "has_powder_xrd"), F.when(F.col("has_dif"), "has_dif"), F.when(F.col("has_cif"), "has_cif")))
    out = df.withColumn("match_score", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4)).withColumn("match_basis", basis)
    return out.withColumn("curation_status", curation_status("match_score")).drop("_a", "_b", "_comp")


def load_difference(left: DataFrame, right: DataFrame, key: str = "curve_id") -> DataFrame:
    """Compare the point count, span and maximum of one curve read by two loaders."""
    def facts(df, p):
        return df.select(key, F.size("two_theta").alias(p + "n"), F.array_min("two_theta").alias(p + "lo"), F.array_max("two_theta").alias(p + "hi"),
                         F.array_max("intensity").alias(p + "mx"))
    j = facts(left, "a_").join(facts(right, "b_"), key)
    j = j.withColumn("points_delta", F.abs(F.col("a_n") - F.col("b_n")))
    j = j.withColumn("span_delta", F.greatest(F.abs(F.col("a_lo") - F.col("b_lo")), F.abs(F.col("a_hi") - F.col("b_hi"))))
    j = j.withColumn("max_delta", F.abs(F.col("a_mx") - F.col("b_mx")) / F.greatest(F.abs("a_mx"), F.abs("b_mx"), F.lit(1.0)))
    status = (F.when((F.col("points_delta") == 0) & (F.col("span_delta") <= 0.001) & (F.col("max_delta") <= 0.01), "compatible")
              .when((F.col("points_delta") <= 2) & (F.col("span_delta") <= 0.05), "minor_difference").otherwise("major_difference"))
    return j.select(key, "points_delta", "span_delta", "max_delta", status.alias("status"))


def metadata_similarity(a, b) -> Column:
    """Share of agreeing facts of two curves: start, end, step and point count."""
    near = lambda f, tol: F.when(F.abs(F.round(a[f], 8) - F.round(b[f], 8)) <= tol, 1.0).otherwise(0.0)
    diff = F.abs(a["points"] - b["points"])
    pts = F.when(diff == 0, 1.0).when(F.try_divide(diff, F.greatest(a["points"], b["points"])) <= 0.02, 0.75).otherwise(0.0)
    return (near("start", 0.02) + near("end", 0.05) + near("step", 0.0005) + F.coalesce(pts, F.lit(0.0))) / 4


def name_overlap(left: Column, right: Column) -> Column:
    """Share of the left names that the right side also holds; 0 when either is empty."""
    low = lambda c: F.array_distinct(F.transform(c, lambda v: F.lower(F.trim(v))))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.size(F.array_intersect(low(left), low(right))) / F.size(low(left))).otherwise(F.lit(0.0))
