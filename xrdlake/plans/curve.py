"""Curve operators over the curve view."""

from __future__ import annotations

from pyspark.sql import functions as F

from xrdlake.functions import series as S
from xrdlake.operators import curves as C
from xrdlake.operators import rule_tables as R
from xrdlake.plans.registry import query
from xrdlake.plans.sqlbits import MAXIMA, PEAKS, PROCESSED, PTS, bragg_d, bragg_tt
from xrdlake.plans.views import curves

r = lambda c, n=6: F.round(c, n)


def _pts(df, **cols):
    """Explode named arrays to rounded point columns."""
    d = C.explode_points(df, *cols.values())
    return d.select("curve_id", "idx", *[r(F.col(v)).alias(k) for k, v in cols.items()])


@query("c1_clean_curve", f"""
WITH {PTS}, raw AS (SELECT curve_id, tt, CASE WHEN idx % 13 = 5 THEN 'NaN'::DOUBLE WHEN idx % 11 = 3 THEN -y ELSE y END AS v FROM pts)
SELECT curve_id, CAST(row_number() OVER (PARTITION BY curve_id ORDER BY tt) - 1 AS INTEGER) AS idx, round(tt, 6) AS two_theta,
  round(greatest(v, 0), 6) AS intensity FROM raw WHERE NOT isnan(v)""")
def c1(spark, d):
    c = curves(spark, d)
    c = c.withColumn("intensity", F.transform("intensity", lambda v, i: F.when(i % 13 == 5, F.lit(float("nan"))).when(i % 11 == 3, -v).otherwise(v)))
    return _pts(C.clean(c.withColumn("two_theta", F.col("two_theta"))), two_theta="two_theta", intensity="intensity")


@query("c2_validate_curve", f"""
WITH {PTS} SELECT curve_id, count(*) AS points, bool_and(coalesce(tt >= p, true)) AS monotonic, 'valid' AS status,
  round(min(tt), 6) AS x_min, round(max(tt), 6) AS x_max, round(min(y), 6) AS y_min, round(max(y), 6) AS y_max, '' AS warnings
FROM (SELECT *, lag(tt) OVER (PARTITION BY curve_id ORDER BY idx) AS p FROM pts) GROUP BY curve_id""")
def c2(spark, d):
    v = C.validate(curves(spark, d))
    return v.select("curve_id", F.col("points").cast("long").alias("points"), "monotonic", "status",
                    *[r(F.col(k)).alias(k) for k in ("x_min", "x_max", "y_min", "y_max")], F.array_join("warnings", ",").alias("warnings"))


@query("c3_moving_average", f"""
WITH {PTS} SELECT curve_id, idx, round(avg(y) OVER (PARTITION BY curve_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS ma FROM pts""")
def c3(spark, d):
    return _pts(curves(spark, d).withColumn("m", S.moving_average(F.col("intensity"), 7)), ma="m")


@query("c4_polynomial_smoothing", f"WITH {PROCESSED} SELECT curve_id, idx, round(ys, 6) AS smoothed FROM sm")
def c4(spark, d):
    return _pts(C.smooth(curves(spark, d)), smoothed="smoothed")


def _asym_sql(passes=10, half=5):
    frame = f"(PARTITION BY curve_id ORDER BY idx ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    parts = [PTS, f"z0 AS (SELECT curve_id, idx, y, avg(y) OVER {frame} AS z FROM pts)"]
    for k in range(passes):
        parts.append(f"w{k} AS (SELECT *, CASE WHEN y > z THEN 0.01e0 ELSE 1 - 0.01e0 END AS w FROM z{k})")
        parts.append(f"z{k + 1} AS (SELECT curve_id, idx, y, sum(w * y) OVER {frame} / sum(w) OVER {frame} AS z FROM w{k})")
    return f"WITH {', '.join(parts)} SELECT curve_id, idx, round(z, 5) AS baseline, round(greatest(y - z, 0), 5) AS corrected FROM z{passes}"


@query("c5_background_asymmetric", _asym_sql())
def c5a(spark, d):
    c = curves(spark, d).withColumn("b", S.asymmetric_background(F.col("intensity")))
    c = c.withColumn("c", S.subtract_background(F.col("intensity"), F.col("b")))
    p = C.explode_points(c, "b", "c")
    return p.select("curve_id", "idx", r(F.col("b"), 5).alias("baseline"), r(F.col("c"), 5).alias("corrected"))


@query("c5_background_percentile", f"WITH {PROCESSED} SELECT curve_id, idx, round(yc, 6) AS corrected FROM cor")
def c5b(spark, d):
    return _pts(C.process(curves(spark, d)), corrected="corrected")


@query("c6_normalise", f"""
WITH {PTS}, a AS (SELECT *, max(y) OVER (PARTITION BY curve_id) AS mx,
    sum(dx) OVER (PARTITION BY curve_id) AS ar FROM (SELECT *, coalesce((tt - lag(tt) OVER w) * (y + lag(y) OVER w) / 2, 0) AS dx FROM pts WINDOW w AS (PARTITION BY curve_id ORDER BY idx)))
SELECT curve_id, idx, round(y / mx, 6) AS by_max, round(y / ar, 6) AS by_area, round(100 * y / mx, 6) AS percent,
  round(y / mx + 1.2e0 * CASE preparation WHEN 'natural' THEN 0 WHEN 'glicolado' THEN 1 ELSE 2 END, 6) AS stacked FROM a""")
def c6(spark, d):
    c = C.stacked(curves(spark, d)).withColumn("m", S.normalize_max(F.col("intensity")))
    c = c.withColumn("a", S.normalize_area(F.col("two_theta"), F.col("intensity"))).withColumn("p", F.transform("m", lambda v: v * 100))
    return _pts(c, by_max="m", by_area="a", percent="p", stacked="display")


@query("c7_local_maxima", f"WITH {MAXIMA} SELECT curve_id, idx, round(tt, 6) AS two_theta, round(yn, 6) AS height FROM mxm")
def c7(spark, d):
    c = C.process(curves(spark, d))
    x, y = F.col("two_theta"), F.col("normalized")
    m = S.unnest(c, ("curve_id", "two_theta", "normalized"), S.local_maxima(x, y), "idx")
    return m.select("curve_id", "idx", r(S.at(x, F.col("idx"))).alias("two_theta"), r(S.at(y, F.col("idx"))).alias("height"))


@query("c8_strongest_apart", f"""
WITH RECURSIVE {MAXIMA}, ranked AS (SELECT curve_id, idx, tt, row_number() OVER (PARTITION BY curve_id ORDER BY yn DESC, tt) AS k FROM mxm),
fold AS (
  SELECT curve_id, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS kept, CAST([] AS INTEGER[]) AS ids FROM (SELECT DISTINCT curve_id FROM ranked)
  UNION ALL
  SELECT f.curve_id, r.k, CASE WHEN len(list_filter(f.kept, lambda x: abs(x - r.tt) < 2.0)) > 0 THEN f.kept ELSE list_append(f.kept, r.tt) END,
    CASE WHEN len(list_filter(f.kept, lambda x: abs(x - r.tt) < 2.0)) > 0 THEN f.ids ELSE list_append(f.ids, r.idx) END
  FROM fold f JOIN ranked r ON r.curve_id = f.curve_id AND r.k = f.k + 1),
last AS (SELECT curve_id, arg_max(ids, k) AS ids FROM fold GROUP BY 1)
SELECT curve_id, unnest(ids) AS idx, generate_subscripts(ids, 1) AS rank FROM last""")
def c8(spark, d):
    f = C.find_peaks(C.process(curves(spark, d)), distance=2.0)
    return S.unnest_pos(f, ("curve_id",), F.col("peak_idx"), "k", "idx").select("curve_id", "idx", (F.col("k") + 1).cast("long").alias("rank"))


_ENDS = f"""
WITH {MAXIMA}, ends AS (
  SELECT m.curve_id, m.idx, m.tt, m.yc, coalesce(max(CASE WHEN n.idx < m.idx AND n.yc <= m.yc * FRAC THEN n.idx END), 0) AS l,
    coalesce(min(CASE WHEN n.idx > m.idx AND n.yc <= m.yc * FRAC THEN n.idx END), max(n.idx)) AS r
  FROM mxm m JOIN nrm n USING (curve_id) GROUP BY ALL)
"""


@query("c9_width_at_half_height", _ENDS.replace('FRAC', '0.5e0') + """
, x AS (SELECT e.*, a.tt AS x0, a.yc AS y0, b.tt AS x1, b.yc AS y1, c.tt AS x2, c.yc AS y2, z.tt AS x3, z.yc AS y3 FROM ends e
  JOIN nrm a ON a.curve_id = e.curve_id AND a.idx = e.l JOIN nrm b ON b.curve_id = e.curve_id AND b.idx = e.l + 1
  JOIN nrm c ON c.curve_id = e.curve_id AND c.idx = e.r - 1 JOIN nrm z ON z.curve_id = e.curve_id AND z.idx = e.r),
y AS (SELECT *, CASE WHEN abs(y1 - y0) < 1e-12 THEN x0 ELSE x0 + (x1 - x0) * (yc / 2 - y0) / (y1 - y0) END AS lx,
  CASE WHEN abs(y3 - y2) < 1e-12 THEN x2 ELSE x2 + (x3 - x2) * (yc / 2 - y2) / (y3 - y2) END AS rx FROM x)
SELECT curve_id, idx, round(lx, 5) AS left_x, round(rx, 5) AS right_x, CASE WHEN rx - lx > 0 THEN round(rx - lx, 5) END AS fwhm FROM y""")
def c9(spark, d):
    f = S.with_shapes(C.find_peaks(C.process(curves(spark, d))))
    w = S.unnest(f, ("curve_id",), F.transform("peak_idx", lambda i, k: F.struct(
        i.alias("idx"), *[F.get(f"shape.{n}", k).alias(n) for n in ("left", "right", "fwhm")])))
    return w.select("curve_id", "p.idx", r(F.col("p.left"), 5).alias("left_x"), r(F.col("p.right"), 5).alias("right_x"), r(F.col("p.fwhm"), 5).alias("fwhm"))


@query("c10_peak_area", _ENDS.replace('FRAC', '0.005e0') + """
, s AS (SELECT curve_id, idx, tt, yc, lead(tt) OVER w AS nt, lead(yc) OVER w AS ny FROM nrm WINDOW w AS (PARTITION BY curve_id ORDER BY idx))
SELECT e.curve_id, e.idx, round(sum((s.yc + s.ny) / 2 * (s.nt - s.tt)), 5) AS area FROM ends e
JOIN s ON s.curve_id = e.curve_id AND s.idx >= e.l AND s.idx < e.r GROUP BY ALL""")
def c10(spark, d):
    f = S.with_shapes(C.find_peaks(C.process(curves(spark, d))))
    w = S.unnest(f, ("curve_id",), F.transform("peak_idx", lambda i, k: F.struct(i.alias("idx"), F.get("shape.area", k).alias("a"))))
    return w.select("curve_id", "p.idx", r(F.col("p.a"), 5).alias("area"))


@query("c11_noise_and_signal", f"""
WITH {PTS}, df AS (SELECT curve_id, y, (y - lag(y) OVER (PARTITION BY curve_id ORDER BY idx)) / sqrt(2) AS e FROM pts),
md AS (SELECT curve_id, median(e) AS m FROM df WHERE e IS NOT NULL GROUP BY 1),
ns AS (SELECT curve_id, 1.4826e0 * median(abs(e - m)) AS sigma FROM df JOIN md USING (curve_id) WHERE e IS NOT NULL GROUP BY 1)
SELECT curve_id, round(sigma, 6) AS noise, round(max(y) / sigma, 6) AS snr, max(y) / sigma >= 5 AS passes, round(sqrt(avg(y * y)), 6) AS rms FROM pts JOIN ns USING (curve_id) GROUP BY curve_id, sigma""")
def c11(spark, d):
    c = curves(spark, d).withColumn("n", S.noise_level(F.col("intensity"))).withColumn("top", F.array_max("intensity"))
    rms = F.sqrt(S.mean(F.transform("intensity", lambda v: v * v)))
    return c.select("curve_id", r(F.col("n")).alias("noise"), r(F.col("top") / F.col("n")).alias("snr"), (F.col("top") / F.col("n") >= 5).alias("passes"), r(rms).alias("rms"))


@query("c12_refined_position", f"""
WITH {MAXIMA}, nb AS (SELECT *, lag(yc) OVER w AS pl, lead(yc) OVER w AS pr, tt - lag(tt) OVER w AS dx FROM nrm WINDOW w AS (PARTITION BY curve_id ORDER BY idx)),
st AS (SELECT curve_id, median(dx) AS step FROM nb WHERE dx IS NOT NULL GROUP BY 1)
SELECT curve_id, m.idx, round(CASE WHEN abs(pl - 2 * n.yc + pr) < 1e-12 THEN n.tt ELSE n.tt + least(greatest(0.5e0 * (pl - pr) / (pl - 2 * n.yc + pr), -1), 1) * step END, 6) AS position
FROM mxm m JOIN nb n USING (curve_id, idx) JOIN st USING (curve_id)""")
def c12(spark, d):
    f = C.find_peaks(C.process(curves(spark, d))).withColumn("step", S.median_step(F.col("two_theta")))
    p = S.unnest(f, ("curve_id",), F.transform("peak_idx", lambda i: F.struct(i.alias("idx"), S.refined_position(
        F.col("two_theta"), F.col("corrected"), i, F.col("step")).alias("x"))))
    return p.select("curve_id", "p.idx", r(F.col("p.x")).alias("position"))


@query("c13_peak_table", f"""
WITH {PEAKS} SELECT curve_id, preparation, peak_index, idx AS source_index, round(two_theta, 5) AS two_theta, round(d, 5) AS d,
  round(intensity, 5) AS intensity, round(relative_intensity, 4) AS relative_intensity FROM pk""")
def c13(spark, d):
    p = C.peaks(curves(spark, d), keep=("curve_id", "preparation"))
    return p.select("curve_id", "preparation", "peak_index", "source_index", *[r(F.col(k), 5).alias(k) for k in ("two_theta", "d", "intensity")],
                    r(F.col("relative_intensity"), 4).alias("relative_intensity"))


def _targeted_values():
    return ", ".join(f"('{a}', '{b}', {lo}e0, {hi}e0)" for a, b, lo, hi in R.targeted_rows())


TARGETED_SQL = PROCESSED + f"""
, win(range_id, mineral, d_min, d_max) AS (VALUES {_targeted_values()}),
nbr AS (SELECT *, lag(yc) OVER w AS lf, lead(yc) OVER w AS rt FROM nrm WINDOW w AS (PARTITION BY curve_id ORDER BY idx)),
tops AS (SELECT curve_id, any_value(preparation) AS preparation, any_value(sample_base) AS sample_base, CASE WHEN max(yc) > 0 THEN max(yc) ELSE 1 END AS top FROM nrm GROUP BY 1),
hit AS (SELECT t.curve_id, t.preparation, t.sample_base, w.range_id, w.mineral, top, count(n.idx) AS window_points, max(n.yc) - min(n.yc) AS span,
    arg_min(n.idx, (-n.yc, n.idx)) AS i
  FROM tops t CROSS JOIN win w LEFT JOIN nrm n ON n.curve_id = t.curve_id AND n.tt BETWEEN {bragg_tt('w.d_max')} AND {bragg_tt('w.d_min')} GROUP BY ALL),
q AS (SELECT h.*, span / top AS contrast, b.tt, b.yc, b.yc / top AS rh, coalesce(b.yc >= b.lf AND b.yc >= b.rt, false) AS is_max FROM hit h LEFT JOIN nbr b ON b.curve_id = h.curve_id AND b.idx = h.i),
tg AS (SELECT *, CASE WHEN i IS NULL OR contrast < 0.003 THEN 'not_found' WHEN NOT is_max AND (rh >= 0.008 OR contrast >= 0.008) THEN 'shoulder'
    WHEN rh >= 0.05 AND contrast >= 0.02 AND is_max THEN 'strong' WHEN contrast >= 0.006 OR (rh >= 0.006 AND is_max) THEN 'weak' ELSE 'not_found' END AS quality FROM q)
"""


@query("c14_targeted_windows", f"""
WITH {TARGETED_SQL} SELECT curve_id, range_id, mineral, quality, window_points, round(contrast, 6) AS contrast,
  CASE WHEN quality <> 'not_found' THEN round({bragg_d('tt')}, 5) END AS d, CASE WHEN quality <> 'not_found' THEN round(100 * rh, 4) END AS relative_intensity FROM tg""")
def c14(spark, d):
    t = C.targeted_scan(C.process(curves(spark, d)))
    return t.select("curve_id", "range_id", "mineral", "quality", "window_points", r(F.col("contrast")).alias("contrast"),
                    r(F.col("d"), 5).alias("d"), r(F.col("relative_intensity"), 4).alias("relative_intensity"))


_WINDOW_ORDER = ", ".join(f"('{rid}', {n})" for n, (rid, *_rest) in enumerate(R.TARGETED_WINDOWS))


@query("c15_merge_targeted", f"""
WITH RECURSIVE {PEAKS} {TARGETED_SQL[len(PROCESSED):]}, wo(range_id, o) AS (VALUES {_WINDOW_ORDER}),
tt0 AS (SELECT curve_id, range_id, o, {bragg_d('tt')} AS d, tt AS x, yc FROM tg JOIN wo USING (range_id) WHERE quality <> 'not_found'),
fr AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY o) AS k FROM tt0 WHERE NOT EXISTS (SELECT 1 FROM pk WHERE pk.curve_id = tt0.curve_id AND abs(pk.d - tt0.d) <= 0.04)),
f AS (SELECT curve_id, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS kd, CAST([] AS BIGINT[]) AS ks FROM (SELECT DISTINCT curve_id FROM fr)
  UNION ALL SELECT f.curve_id, r.k, CASE WHEN len(list_filter(f.kd, lambda x: abs(x - r.d) <= 0.04)) > 0 THEN f.kd ELSE list_append(f.kd, r.d) END, CASE WHEN len(list_filter(f.kd, lambda x: abs(x - r.d) <= 0.04)) > 0 THEN f.ks ELSE list_append(f.ks, r.k) END
  FROM f JOIN fr r ON r.curve_id = f.curve_id AND r.k = f.k + 1),
kp AS (SELECT curve_id, unnest(ks) AS k FROM (SELECT curve_id, arg_max(ks, k) AS ks FROM f GROUP BY 1))
SELECT curve_id, 'detected' AS source, round(d, 5) AS d, round(two_theta, 5) AS two_theta, round(intensity, 5) AS intensity FROM pk
UNION ALL SELECT fr.curve_id, 'targeted:' || range_id, round(d, 5), round(x, 5), round(yc, 5) FROM kp JOIN fr ON fr.curve_id = kp.curve_id AND fr.k = kp.k""")
def c15(spark, d):
    p = C.process(curves(spark, d))
    listed = C.light_peaks(C.find_peaks(p))
    m = C.merge_targeted(listed, C.targeted_scan(p))
    return m.select("curve_id", "source", r(F.col("d"), 5).alias("d"), r(F.col("two_theta"), 5).alias("two_theta"), r(F.col("intensity"), 5).alias("intensity"))


_K25 = S.smoothing_kernel(25, 2)
QUARTZ_SQL = PTS + f"""
, q0 AS (SELECT *, count(*) OVER (PARTITION BY curve_id) AS n, avg(y) OVER (PARTITION BY curve_id ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS ma FROM pts),
kern(k, wt) AS (VALUES {', '.join(f'({i - 12}, {w!r}::DOUBLE)' for i, w in enumerate(_K25))}),
cv AS (SELECT a.curve_id, a.idx, greatest(sum(b.y * wt), 0) AS s FROM q0 a JOIN kern ON true JOIN q0 b ON b.curve_id = a.curve_id AND b.idx = a.idx + k
   WHERE a.idx >= 12 AND a.idx < a.n - 12 GROUP BY ALL),
sq AS (SELECT q0.curve_id, preparation, sample_base, q0.idx, tt, coalesce(s, ma) AS s FROM q0 LEFT JOIN cv ON cv.curve_id = q0.curve_id AND cv.idx = q0.idx),
sn AS (SELECT *, coalesce(lag(s) OVER w, s) AS lf, coalesce(lead(s) OVER w, s) AS rt, max(s) OVER (PARTITION BY curve_id) * 0.02e0 AS lvl FROM sq WINDOW w AS (PARTITION BY curve_id ORDER BY idx)),
bs AS (SELECT curve_id, coalesce(arg_min(tt, (-s, idx)) FILTER (s >= lvl AND s >= lf AND s >= rt), arg_min(tt, (-s, idx)) FILTER (s >= lvl)) AS seen FROM sn
   WHERE tt BETWEEN {bragg_tt('3.44e0')} AND {bragg_tt('3.24e0')} GROUP BY 1)
"""


@query("c16_quartz_offset", f"""
WITH {QUARTZ_SQL} SELECT c.curve_id, round(seen, 6) AS observed_two_theta, round({bragg_d('seen')}, 5) AS observed_d, round({bragg_tt('3.34e0')} - seen, 6) AS offset_two_theta
FROM (SELECT DISTINCT curve_id FROM pts) c LEFT JOIN bs USING (curve_id)""")
def c16(spark, d):
    q = C.quartz_offset(curves(spark, d))
    return q.select("curve_id", r(F.col("observed_two_theta")).alias("observed_two_theta"), r(F.col("observed_d"), 5).alias("observed_d"), r(F.col("offset")).alias("offset_two_theta"))


def shifted_curves(spark, d):
    """Curves whose axis starts at different values, so that alignment has work to do."""
    return curves(spark, d).withColumn("two_theta", F.transform("two_theta", lambda v: v + (F.col("curve_id") % 5).cast("double") * 0.03))


@query("c17_axis_alignment", f"""
WITH {QUARTZ_SQL.replace('3.0e0 + 0.4e0 * CAST(pos - 1 AS DOUBLE) AS tt', '3.0e0 + 0.4e0 * CAST(pos - 1 AS DOUBLE) + CAST(vec_id % 5 AS DOUBLE) * 0.03e0 AS tt')},
st AS (SELECT curve_id, sample_base, preparation, min(tt) AS x0 FROM pts GROUP BY ALL),
nat AS (SELECT sample_base, arg_min(x0, curve_id) AS tgt FROM st WHERE preparation = 'natural' GROUP BY 1),
al AS (SELECT st.*, tgt, {bragg_tt('3.34e0')} - seen AS q, CASE WHEN curve_id % 10 = 0 THEN l.quality * 0.1e0 END AS man
  FROM st LEFT JOIN nat USING (sample_base) LEFT JOIN bs USING (curve_id) LEFT JOIN labels l ON l.doc_id = curve_id),
mt AS (SELECT *, CASE WHEN man IS NOT NULL THEN 'manual_offset' WHEN preparation <> 'natural' AND tgt IS NOT NULL AND abs(tgt - x0) > 0.05 THEN 'ngc_natural_start_anchor'
   WHEN (preparation = 'natural' OR tgt IS NULL) AND abs(q) > 0.02 THEN 'quartz_101_absolute_anchor' END AS method FROM al),
o AS (SELECT *, round(CASE method WHEN 'manual_offset' THEN man WHEN 'ngc_natural_start_anchor' THEN tgt - x0 WHEN 'quartz_101_absolute_anchor' THEN q END, 6) AS off FROM mt)
SELECT curve_id, method, off AS offset_two_theta, round(x0, 6) AS original_start, round(x0 + coalesce(off, 0), 6) AS new_start FROM o""")
def c17(spark, d):
    from xrdlake.plans.views import table

    manual = table(spark, d, "labels").where("doc_id % 10 = 0").select(F.col("doc_id").alias("curve_id"), (F.col("quality") * 0.1).alias("offset"))
    a = C.align_axis(shifted_curves(spark, d), manual)
    return a.select("curve_id", "method", F.col("offset").alias("offset_two_theta"), r(F.col("original_start")).alias("original_start"),
                    r(F.array_min("two_theta")).alias("new_start"))


@query("c18_shift_peaks", f"""
WITH {PEAKS}, s AS (SELECT curve_id, peak_index, round(two_theta + (curve_id % 5) * 0.03e0, 6) AS t FROM pk)
SELECT curve_id, peak_index, t AS two_theta, round({bragg_d('t')}, 5) AS d FROM s""")
def c18(spark, d):
    p = C.light_peaks(C.find_peaks(C.process(curves(spark, d)))).withColumn("offset", (F.col("curve_id") % 5) * 0.03)
    return C.shift_peaks(p).select("curve_id", "peak_index", "two_theta", "d")


@query("c19_decimate", f"WITH {PTS} SELECT curve_id, round(tt, 6) AS two_theta, round(y, 6) AS intensity FROM pts WHERE idx % 4 = 0")
def c19(spark, d):
    p = C.explode_points(C.decimate(curves(spark, d), 20), "two_theta", "intensity")
    return p.select("curve_id", r(F.col("two_theta")).alias("two_theta"), r(F.col("intensity")).alias("intensity"))


def _pairs(spark, d):
    """Natural against glycolated curve of a sample, the second on a coarser, shifted axis."""
    c = curves(spark, d)
    a = c.where("preparation = 'natural'").select("sample_base", F.col("two_theta").alias("x1"), F.col("intensity").alias("y1"))
    b = c.where("preparation = 'glicolado'").select(
        "sample_base", F.transform("two_theta", lambda v: F.lit(3.5) + (v - 3.0) * 1.25).alias("x2"), F.col("intensity").alias("y2"))
    return a.join(b, "sample_base")


PAIR_SQL = PTS + """
, a AS (SELECT sample_base, idx, tt AS x, y FROM pts WHERE preparation = 'natural'),
b AS (SELECT sample_base, idx, 3.5e0 + (tt - 3.0e0) * 1.25e0 AS x, y FROM pts WHERE preparation = 'glicolado'),
bd AS (SELECT sample_base, greatest(min(a.x), min(b.x)) AS lo, least(max(a.x), max(b.x)) AS hi FROM a JOIN b USING (sample_base) GROUP BY 1),
gr AS (SELECT sample_base, CAST(i AS INTEGER) AS i, round(lo + i * 0.5e0, 6) AS g FROM bd, range(0, 200) t(i) WHERE i <= floor((hi - lo) / 0.5e0)),
sa AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM a WINDOW w AS (PARTITION BY sample_base ORDER BY x)),
sb AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM b WINDOW w AS (PARTITION BY sample_base ORDER BY x)),
ra AS (SELECT gr.sample_base, i, g, any_value(s.y + (s.y2 - s.y) * (g - s.x) / (s.x2 - s.x)) AS v FROM gr JOIN sa s ON s.sample_base = gr.sample_base AND g > s.x AND g <= s.x2 GROUP BY ALL
   UNION ALL SELECT gr.sample_base, i, g, s.y FROM gr JOIN sa s ON s.sample_base = gr.sample_base AND s.idx = 0 AND g <= s.x),
rb AS (SELECT gr.sample_base, i, g, any_value(s.y + (s.y2 - s.y) * (g - s.x) / (s.x2 - s.x)) AS v FROM gr JOIN sb s ON s.sample_base = gr.sample_base AND g > s.x AND g <= s.x2 GROUP BY ALL
   UNION ALL SELECT gr.sample_base, i, g, s.y FROM gr JOIN sb s ON s.sample_base = gr.sample_base AND s.idx = 0 AND g <= s.x)
"""


@query("c20_common_grid", f"WITH {PAIR_SQL} SELECT sample_base, i AS idx, g AS two_theta FROM gr")
def c20(spark, d):
    p = _pairs(spark, d).withColumn("g", C.common_grid(F.col("x1"), F.col("x2")))
    return S.unnest_pos(p, ("sample_base",), F.col("g"), "idx", "two_theta")


@query("c21_resample", f"WITH {PAIR_SQL} SELECT ra.sample_base, ra.i AS idx, round(ra.v, 5) AS natural, round(rb.v, 5) AS glycolated FROM ra JOIN rb USING (sample_base, i)")
def c21(spark, d):
    p = _pairs(spark, d).withColumn("g", C.common_grid(F.col("x1"), F.col("x2")))
    p = p.select("sample_base", C.resample("x1", "y1", "g").alias("a"), C.resample("x2", "y2", "g").alias("b"))
    return S.unnest_pos(p, ("sample_base",), F.arrays_zip("a", "b")).select(
        "sample_base", "idx", r(F.col("p.a"), 5).alias("natural"), r(F.col("p.b"), 5).alias("glycolated"))


@query("c22_shape_similarity", f"""
WITH {PAIR_SQL}, n AS (SELECT sample_base, ra.v / max(ra.v) OVER p AS u, rb.v / max(rb.v) OVER p AS v FROM ra JOIN rb USING (sample_base, i) WINDOW p AS (PARTITION BY sample_base)),
s AS (SELECT sample_base, round((corr(u, v) + 1) / 2, 4) AS c, round(1 / (1 + sqrt(avg((u - v) * (u - v)))), 4) AS e FROM n GROUP BY 1)
SELECT sample_base, c AS correlation, e AS distance, round(0.6e0 * c + 0.4e0 * e, 4) AS shape FROM s""")
def c22(spark, d):
    return C.shape_similarity(_pairs(spark, d)).select("sample_base", "correlation", "distance", "shape")


@query("c23_observed_vs_calculated", f"""
WITH {PTS}, n AS (SELECT curve_id, sample_base, preparation, idx, y / max(y) OVER (PARTITION BY curve_id) AS y FROM pts),
j AS (SELECT sample_base, a.y AS o, b.y AS c FROM n a JOIN n b USING (sample_base, idx) WHERE a.preparation = 'natural' AND b.preparation = 'calcinado')
SELECT sample_base, count(*) AS points, round(avg(abs(o - c)), 6) AS mae, round(max(abs(o - c)), 6) AS max_error, round(sqrt(avg((o - c) * (o - c))), 6) AS rmse,
  round((corr(o, c) + 1) / 2, 6) AS correlation, 'valid' AS status, CASE WHEN avg(abs(o - c)) <= 0.25 THEN 'good' WHEN avg(abs(o - c)) <= 0.45 THEN 'fair' ELSE 'poor' END AS fit FROM j GROUP BY 1""")
def c23(spark, d):
    c = curves(spark, d).withColumn("n", S.normalize_max(F.col("intensity")))
    a = c.where("preparation = 'natural'").select("sample_base", F.col("n").alias("observed"))
    b = c.where("preparation = 'calcinado'").select("sample_base", F.col("n").alias("calculated"))
    p = a.join(b, "sample_base").withColumn("correlation", S.correlation_similarity(F.col("observed"), F.col("calculated")))
    p = C.compare_profiles(p)
    return p.select("sample_base", F.col("points").cast("long").alias("points"), *[r(F.col(k)).alias(k) for k in ("mae", "max_error", "rmse", "correlation")], "status", "fit")


@query("c24_spacing_axis", f"WITH {PTS} SELECT curve_id, idx, round({bragg_d('tt')}, 6) AS d FROM pts")
def c24(spark, d):
    from xrdlake.functions.geometry import bragg_d as bd

    return _pts(curves(spark, d).withColumn("d", F.transform("two_theta", lambda t: bd(t))), d="d")


_K11 = S.smoothing_kernel(11, 3)
_DETECTOR_SQL = _asym_sql(10, 10).rsplit(" SELECT curve_id, idx, round(z", 1)[0] + f"""
, bc AS (SELECT p.curve_id, p.idx, p.tt, greatest(p.y - b.z, 0) AS c, count(*) OVER (PARTITION BY p.curve_id) AS n,
    avg(greatest(p.y - b.z, 0)) OVER (PARTITION BY p.curve_id ORDER BY p.idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS ma FROM pts p JOIN z10 b USING (curve_id, idx)),
k11(k, wt) AS (VALUES {', '.join(f'({i - 5}, {w!r}::DOUBLE)' for i, w in enumerate(_K11))}),
sv AS (SELECT a.curve_id, a.idx, greatest(sum(b.c * wt), 0) AS s FROM bc a JOIN k11 ON true JOIN bc b ON b.curve_id = a.curve_id AND b.idx = a.idx + k WHERE a.idx >= 5 AND a.idx < a.n - 5 GROUP BY ALL),
sm AS (SELECT bc.*, coalesce(s, ma) AS s FROM bc LEFT JOIN sv ON sv.curve_id = bc.curve_id AND sv.idx = bc.idx),
df AS (SELECT curve_id, ((c - s) - lag(c - s) OVER (PARTITION BY curve_id ORDER BY idx)) / sqrt(2) AS e FROM sm),
md AS (SELECT curve_id, median(e) AS m, stddev_pop(e) AS sd FROM df WHERE e IS NOT NULL GROUP BY 1),
ns AS (SELECT curve_id, any_value(sd) AS sd, 1.4826e0 * median(abs(e - m)) AS sg FROM df JOIN md USING (curve_id) WHERE e IS NOT NULL GROUP BY 1),
nz AS (SELECT curve_id, greatest(CASE WHEN sg > 0 THEN sg ELSE sd END, 1e-12) AS noise FROM ns),
nb AS (SELECT *, lag(s) OVER w AS pl, lead(s) OVER w AS pr FROM sm WINDOW w AS (PARTITION BY curve_id ORDER BY idx)),
pk AS (SELECT nb.*, greatest(s, c) / noise AS snr, row_number() OVER (PARTITION BY curve_id ORDER BY s DESC, tt) AS k FROM nb JOIN nz USING (curve_id) WHERE pl IS NOT NULL AND pr IS NOT NULL AND s >= 0 AND s >= pl AND s >= pr AND greatest(s, c) / noise >= 5),
en AS (SELECT p.curve_id, p.idx, p.k, p.tt, p.s, p.c, p.snr, p.pl, p.pr, coalesce(max(CASE WHEN n.idx < p.idx AND n.s <= p.s / 2 THEN n.idx END), 0) AS l, coalesce(min(CASE WHEN n.idx > p.idx AND n.s <= p.s / 2 THEN n.idx END), max(n.idx)) AS r,
    coalesce(max(CASE WHEN n.idx < p.idx AND n.c <= p.c / 2 THEN n.idx END), 0) AS al, coalesce(min(CASE WHEN n.idx > p.idx AND n.c <= p.c / 2 THEN n.idx END), max(n.idx)) AS ar FROM pk p JOIN sm n USING (curve_id) GROUP BY ALL),
sg AS (SELECT curve_id, idx, tt, c, lead(tt) OVER w AS nt, lead(c) OVER w AS nc FROM sm WINDOW w AS (PARTITION BY curve_id ORDER BY idx)),
aa AS (SELECT e.curve_id, e.idx, CASE WHEN any_value(e.c) > 0 THEN sum((sg.c + nc) / 2 * (nt - sg.tt)) ELSE 0 END AS area FROM en e JOIN sg ON sg.curve_id = e.curve_id AND sg.idx >= e.al AND sg.idx < e.ar GROUP BY ALL),
cr AS (SELECT e.*, a.tt AS x0, a.s AS y0, b.tt AS x1, b.s AS y1, q.tt AS x2, q.s AS y2, z.tt AS x3, z.s AS y3 FROM en e JOIN sm a ON a.curve_id = e.curve_id AND a.idx = e.l JOIN sm b ON b.curve_id = e.curve_id AND b.idx = e.l + 1
   JOIN sm q ON q.curve_id = e.curve_id AND q.idx = e.r - 1 JOIN sm z ON z.curve_id = e.curve_id AND z.idx = e.r),
st AS (SELECT curve_id, median(dx) AS step FROM (SELECT curve_id, tt - lag(tt) OVER (PARTITION BY curve_id ORDER BY idx) AS dx FROM sm) WHERE dx IS NOT NULL GROUP BY 1),
ro AS (SELECT cr.curve_id, cr.k AS peak_id, CASE WHEN abs(pl - 2 * cr.s + pr) < 1e-12 THEN cr.tt ELSE cr.tt + least(greatest(0.5e0 * (pl - pr) / (pl - 2 * cr.s + pr), -1), 1) * step END AS position,
   nullif(greatest(0, (CASE WHEN abs(y3 - y2) < 1e-12 THEN x2 ELSE x2 + (x3 - x2) * (cr.s / 2 - y2) / (y3 - y2) END) - (CASE WHEN abs(y1 - y0) < 1e-12 THEN x0 ELSE x0 + (x1 - x0) * (cr.s / 2 - y0) / (y1 - y0) END)), 0) AS fwhm, snr, area
   FROM cr JOIN st USING (curve_id) JOIN aa ON aa.curve_id = cr.curve_id AND aa.idx = cr.idx)
SELECT curve_id, peak_id, count(*) OVER c AS n_peaks, round(position, 5) AS position, round(fwhm, 5) AS fwhm, round(snr, 5) AS snr, round(area, 5) AS area, round(position - 2 * fwhm, 5) AS window_low, round(position + 2 * fwhm, 5) AS window_high,
  round(median(snr) OVER c, 5) AS snr_median, round(median(fwhm) OVER c, 5) AS fwhm_median FROM ro WINDOW c AS (PARTITION BY curve_id)"""


@query("c25_detector_explanation", _DETECTOR_SQL)
def c25(spark, d):
    e = C.explain_peaks(C.detector(curves(spark, d)))
    return e.select("curve_id", "peak_id", "n_peaks", *[r(F.col(k), 5).alias(k) for k in ("position", "fwhm", "snr", "area", "window_low", "window_high", "snr_median", "fwhm_median")])


@query("c26_broad_peaks", _ENDS.replace("FRAC", "0.5e0") + f"""
, x AS (SELECT e.*, a.tt AS x0, a.yc AS y0, b.tt AS x1, b.yc AS y1, c.tt AS x2, c.yc AS y2, z.tt AS x3, z.yc AS y3 FROM ends e
  JOIN nrm a ON a.curve_id = e.curve_id AND a.idx = e.l JOIN nrm b ON b.curve_id = e.curve_id AND b.idx = e.l + 1 JOIN nrm c ON c.curve_id = e.curve_id AND c.idx = e.r - 1 JOIN nrm z ON z.curve_id = e.curve_id AND z.idx = e.r),
y AS (SELECT curve_id, {bragg_d('tt')} AS d, (CASE WHEN abs(y3 - y2) < 1e-12 THEN x2 ELSE x2 + (x3 - x2) * (yc / 2 - y2) / (y3 - y2) END) - (CASE WHEN abs(y1 - y0) < 1e-12 THEN x0 ELSE x0 + (x1 - x0) * (yc / 2 - y0) / (y1 - y0) END) AS w FROM x)
SELECT curve_id, CASE curve_id % 3 WHEN 0 THEN 'natural' WHEN 1 THEN 'glicolado' ELSE 'calcinado' END AS preparation, count(*) FILTER (w > 0.5) AS over_0_5, count(*) FILTER (w >= 0.6) AS over_0_6, count(*) FILTER (w >= 0.8 AND d BETWEEN 9 AND 18.6) AS over_0_8_basal FROM y GROUP BY 1, 2""")
def c26(spark, d):
    return C.broad_flags(C.peaks(curves(spark, d), keep=("curve_id", "preparation")), by=("curve_id", "preparation"))


@query("c27_display_series", f"""
WITH {PTS}, s AS (SELECT *, y / max(y) OVER (PARTITION BY curve_id) AS n FROM pts WHERE idx % 2 = 0)
SELECT curve_id, CAST(idx // 2 AS INTEGER) AS idx, round(tt, 6) AS two_theta, round(100 * n, 6) AS normalized, round({bragg_d('tt')}, 6) AS d_spacing, 'loaded_axis' AS axis_mode, true AS decimated FROM s""")
def c27(spark, d):
    s = C.display_series(curves(spark, d), 32)
    p = C.explode_points(s, "two_theta", "normalized", "d_spacing", keep=("curve_id", "axis_mode", "decimated"))
    return p.select("curve_id", "idx", r(F.col("two_theta")).alias("two_theta"), "normalized", "d_spacing", "axis_mode", "decimated")
