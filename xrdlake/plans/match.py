"""Matching operators over the peaks of the curve view."""

from __future__ import annotations

from pyspark.sql import functions as F

from xrdlake.functions import series as S
from xrdlake.functions.values import rounded
from xrdlake.operators import curves as C, library as Y, matching as M, rule_tables as R
from xrdlake.plans.registry import query
from xrdlake.plans.sqlbits import PEAKS, PTS, bragg_d, bragg_tt
from xrdlake.plans.views import curves, table

r = lambda c, n=6: F.round(c, n)


def half_up(c):
    """Round at 8 digits; exact halves are nudged so that both engines round them alike."""
    return rounded(c + 1e-11, 8)


def found(spark, d):
    return C.find_peaks(C.process(curves(spark, d)))


def peaks(spark, d):
    return C.light_peaks(found(spark, d), keep=("curve_id", "sample_base", "preparation"))


def reference_lines(spark, d):
    """Ten lines per reference, from parts."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.floor(k / 10).alias("reference_id"), (k % 10).cast("int").alias("line_index"),
        (F.lit(4.0) + (k * 7919 % 2400) / 100).alias("ref_two_theta"), F.col("p_size").cast("double").alias("ref_intensity"), F.col("p_brand").alias("mineral"))


LINES_SQL = """
rl AS (SELECT p_partkey // 10 AS reference_id, CAST(p_partkey % 10 AS INTEGER) AS line_index, 4e0 + ((p_partkey * 7919) % 2400) / 100e0 AS rt,
  CAST(p_size AS DOUBLE) AS ri, p_brand AS mineral FROM part)
"""


def values_sql(rows):
    def one(v):
        return f"'{v}'" if isinstance(v, str) else f"{v}e0"
    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


@query("d1_diagnostic_windows", f"""
WITH {PEAKS}, rw(rule_id, mineral, need, lo, hi) AS (VALUES {values_sql(R.diagnostic_rows())})
SELECT curve_id, peak_index, preparation, rule_id, mineral, round(d, 5) AS d, round(abs(d - (lo + hi) / 2), 5) AS delta_center
FROM pk JOIN rw ON d BETWEEN lo AND hi AND (need = 'any' OR need = preparation)""")
def d1(spark, d):
    return M.diagnostic_matches(peaks(spark, d)).select("curve_id", "peak_index", "preparation", "rule_id", "mineral", r(F.col("d"), 5).alias("d"), r(F.col("delta_center"), 5).alias("delta_center"))


_LIT = [("literature", label, fam, "", lo, hi) for fam, label, lo, hi in R.PEAK_SETS]
_EMP = [("empirical", rid, m, {"n": "natural", "g": "glicolado", "c": "calcinado"}.get(rid.split("_")[1], ""), lo, hi) for rid, m, lo, hi in R.targeted_rows()]
_LOC = [("local", refl, m, need, lo, hi) for m, refl, _t, lo, hi, need in R.CONFIRMATORY_REFLECTIONS]


@query("d2_three_source_comparison", f"""
WITH {PEAKS}, w(source, range_id, mineral, need, lo, hi) AS (VALUES {values_sql(_LIT + _EMP + _LOC)})
SELECT curve_id, source, mineral, count(*) AS hits, round(min(d), 5) AS d_first FROM pk JOIN w ON d BETWEEN lo AND hi AND (need = '' OR need = preparation) GROUP BY ALL""")
def d2(spark, d):
    names = ("source", "range_id", "mineral", "preparation", "d_min", "d_max")
    m = M.compare_sources(peaks(spark, d), {k: R.literal_rows(v, names) for k, v in (("literature", _LIT), ("empirical", _EMP), ("local", _LOC))})
    return m.groupBy("curve_id", "source", "mineral").agg(F.count("*").alias("hits"), r(F.min("d"), 5).alias("d_first"))


NAMED_VALUES = values_sql([(k, lo, hi) for k, (lo, hi) in R.NAMED_RANGES.items()])


def named_windows():
    return R.literal_rows([(k, lo, hi) for k, (lo, hi) in R.NAMED_RANGES.items()], ("range_id", "d_min", "d_max"))


@query("d3_strongest_in_window", f"""
WITH {PEAKS}, w(range_id, lo, hi) AS (VALUES {NAMED_VALUES})
SELECT sample_base, preparation, range_id, round(arg_max(d, (intensity, d)), 5) AS d, round(max(intensity), 5) AS intensity FROM pk JOIN w ON d BETWEEN lo AND hi GROUP BY ALL""")
def d3(spark, d):
    s = M.strongest_in_windows(peaks(spark, d), named_windows(), ["sample_base", "preparation"])
    return s.select("sample_base", "preparation", "range_id", r(F.col("d"), 5).alias("d"), r(F.col("intensity"), 5).alias("intensity"))


@query("d4_reference_line_match", f"""
WITH RECURSIVE {PEAKS}, {LINES_SQL},
pr AS (SELECT curve_id, reference_id, line_index, ri, peak_index, row_number() OVER (PARTITION BY curve_id, reference_id ORDER BY line_index, abs(two_theta - rt), peak_index) AS k
  FROM pk JOIN rl ON abs(two_theta - rt) <= 0.25),
f AS (SELECT curve_id, reference_id, CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS ur, CAST([] AS BIGINT[]) AS uo, 0e0 AS w FROM (SELECT DISTINCT curve_id, reference_id FROM pr)
  UNION ALL SELECT f.curve_id, f.reference_id, pr.k,
    CASE WHEN list_contains(ur, line_index) OR list_contains(uo, peak_index) THEN ur ELSE list_append(ur, line_index) END,
    CASE WHEN list_contains(ur, line_index) OR list_contains(uo, peak_index) THEN uo ELSE list_append(uo, peak_index) END,
    CASE WHEN list_contains(ur, line_index) OR list_contains(uo, peak_index) THEN w ELSE w + ri END
  FROM f JOIN pr ON pr.curve_id = f.curve_id AND pr.reference_id = f.reference_id AND pr.k = f.k + 1),
l AS (SELECT curve_id, reference_id, arg_max(len(ur), k) AS n, arg_max(w, k) AS w FROM f GROUP BY ALL),
t AS (SELECT reference_id, count(*) AS m, sum(ri) AS tw FROM rl GROUP BY 1)
SELECT curve_id, reference_id, n AS matched_lines, round(n / CAST(m AS DOUBLE) + 1e-11, 8) AS coverage, round(w / tw + 1e-11, 8) AS weighted_coverage, round(0.45e0 * n / m + 0.55e0 * w / tw + 1e-11, 8) AS score FROM l JOIN t USING (reference_id)""")
def d4(spark, d):
    m = M.match_reference_lines(peaks(spark, d), reference_lines(spark, d))
    return m.select("curve_id", "reference_id", F.col("matched_lines").cast("long").alias("matched_lines"), *[half_up(F.col(k)).alias(k) for k in ("coverage", "weighted_coverage", "score")])


_LIBRARY = f"""
WITH {PEAKS}, {LINES_SQL}, b AS (SELECT curve_id, reference_id, line_index, any_value(ri) AS ri, min(abs(two_theta - rt)) AS delta FROM pk JOIN rl ON abs(two_theta - rt) <= 0.25 GROUP BY ALL),
t AS (SELECT reference_id, count(*) AS m, sum(ri) AS tw FROM rl GROUP BY 1),
s AS (SELECT curve_id, reference_id, count(*) AS n, m, sum(ri * (1 - delta / 0.25)) / tw AS q FROM b JOIN t USING (reference_id) GROUP BY curve_id, reference_id, m, tw),
z AS (SELECT *, n / CAST(m AS DOUBLE) AS cov, q * (0.55e0 + 0.45e0 * n / m) AS score FROM s),
a AS (SELECT curve_id, reference_id, n AS matched_lines, round(cov, 6) AS coverage, round(score, 8) AS score, CASE WHEN score >= 0.72 AND cov >= 0.66 AND n >= 2 THEN 'alta' WHEN score >= 0.45 AND n >= 2 THEN 'media' ELSE 'baixa' END AS confidence,
  row_number() OVER (PARTITION BY curve_id ORDER BY round(score, 9) DESC, reference_id) AS place FROM z)
"""


def classified(spark, d, best=None):
    found = Y.classify(peaks(spark, d), reference_lines(spark, d), best=best)
    return found.select("curve_id", "reference_id", "matched_lines", rounded("coverage", 6).alias("coverage"), rounded("score", 8).alias("score"), "confidence")


@query("d6_library_classifier", _LIBRARY + "SELECT * EXCLUDE place FROM a")
def d6(spark, d):
    return classified(spark, d)


@query("d6_best_references", _LIBRARY + "SELECT * EXCLUDE place FROM a WHERE place <= 3")
def d6b(spark, d):
    return classified(spark, d, best=3)


@query("d7_nearest_row", f"""
WITH {PEAKS}, w(range_id, lo, hi) AS (VALUES {NAMED_VALUES}), n AS (SELECT curve_id, peak_index, d, arg_min(range_id, (abs(d - (lo + hi) / 2), range_id)) AS range_id, min(abs(d - (lo + hi) / 2)) AS delta FROM pk CROSS JOIN w GROUP BY ALL)
SELECT curve_id, peak_index, round(d, 5) AS d, CASE WHEN delta <= 0.25 THEN range_id END AS range_id, CASE WHEN delta <= 0.25 THEN round(delta, 5) END AS delta FROM n""")
def d7(spark, d):
    p = peaks(spark, d).withColumn("n", M.nearest_window(F.col("d"), 0.25))
    return p.select("curve_id", "peak_index", r(F.col("d"), 5).alias("d"), "n.range_id", r(F.col("n.delta"), 5).alias("delta"))


@query("d16_index_peaks", f"""
WITH {PEAKS}, cells AS (SELECT s_suppkey AS cell_id, CASE s_nationkey % 2 WHEN 0 THEN 'cubic' ELSE 'tetragonal' END AS sys, 3e0 + s_nationkey / 5e0 AS a, 5e0 + s_suppkey % 7 AS c FROM supplier),
ax AS (SELECT CAST(i AS BIGINT) AS i FROM range(0, 7) t(i)),
ln AS (SELECT cell_id, h.i AS h, k.i AS k, l.i AS l, CASE sys WHEN 'cubic' THEN a / sqrt(h.i*h.i + k.i*k.i + l.i*l.i) ELSE 1 / sqrt((h.i*h.i + k.i*k.i) / (a*a) + l.i*l.i / (c*c)) END AS ld
  FROM cells, ax h, ax k, ax l WHERE h.i + k.i + l.i > 0),
lt AS (SELECT *, {bragg_tt('ld')} AS lt FROM ln)
SELECT curve_id, peak_index, count(*) AS matches, arg_min(cell_id, (dl, cell_id, h, k, l)) AS cell_id, arg_min(h, (dl, cell_id, h, k, l)) AS h, arg_min(k, (dl, cell_id, h, k, l)) AS k, arg_min(l, (dl, cell_id, h, k, l)) AS l, round(min(dl), 6) AS delta
FROM (SELECT *, round(abs(two_theta - lt), 9) AS dl FROM pk JOIN lt ON abs(two_theta - lt) <= 0.2) GROUP BY 1, 2""")
def d16(spark, d):
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("cell_id"), F.when(F.col("s_nationkey") % 2 == 0, "cubic").otherwise("tetragonal").alias("crystal_system"),
        (F.col("s_nationkey") / 5 + 3.0).alias("a"), (F.col("s_suppkey") % 7 + 5.0).alias("c"))
    return M.index_peaks(peaks(spark, d), s).select("curve_id", "peak_index", "matches", "cell_id", *[F.col(i).cast("long").alias(i) for i in "hkl"], r(F.col("delta")).alias("delta"))


@query("d17_pattern_match_score", r"""
WITH t AS (SELECT l_orderkey, l_linenumber, lower(trim(regexp_replace(regexp_replace(p_name, '[''`]', '', 'g'), '[^A-Za-z0-9+]+', ' ', 'g'))) AS a,
   lower(CASE l_linenumber % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' b' ELSE 'other' END) AS b, 'Si' || CASE WHEN p_size % 2 = 0 THEN 'Al' ELSE 'Fe' END || 'O4' AS f1,
   CASE l_returnflag WHEN 'A' THEN 'SiAlO4' WHEN 'N' THEN 'CaF2' ELSE '' END AS f2, p_type = CASE l_linestatus WHEN 'O' THEN 'LARGE' ELSE 'SMALL' END AS fam,
   l_tax > 0.04 AS x1, l_discount > 0.05 AS x2, l_quantity > 25 AS x3, l_tax = 0 AS x4, CASE p_size % 5 WHEN 0 THEN 'group' ELSE 'species' END AS cat FROM lineitem JOIN part ON l_partkey = p_partkey),
e AS (SELECT *, CASE WHEN f2 = '' THEN NULL ELSE len(list_intersect(list_distinct(regexp_extract_all(f1, '[A-Z][a-z]?')), list_distinct(regexp_extract_all(f2, '[A-Z][a-z]?')))) /
   CAST(greatest(len(list_distinct(regexp_extract_all(f1, '[A-Z][a-z]?'))), len(list_distinct(regexp_extract_all(f2, '[A-Z][a-z]?')))) AS DOUBLE) >= 0.6 END AS comp FROM t),
s AS (SELECT *, (a = b)::INT * 50 + CASE WHEN comp THEN 20 WHEN NOT comp THEN -40 ELSE 0 END + fam::INT * 15 + x1::INT * 10 + x2::INT * 10 + x3::INT * 5 - x4::INT * 30 - (cat = 'group' AND a <> b)::INT * 30 AS p FROM e)
SELECT l_orderkey, l_linenumber, match_score, CASE WHEN match_score >= 0.8 THEN 'accepted' WHEN match_score >= 0.6 THEN 'provisional' WHEN match_score >= 0.4 THEN 'needs_review' ELSE 'rejected' END AS curation_status,
  match_basis FROM (SELECT *, round(least(greatest(p / 100e0, 0), 1), 4) AS match_score, concat_ws(',', CASE WHEN a = b THEN 'exact_name' WHEN contains(a, b) OR contains(b, a) THEN 'partial_name' END, CASE WHEN comp THEN 'formula_compatible' END, CASE WHEN fam THEN 'family_compatible' END,
  CASE WHEN x1 THEN 'has_powder_xrd' END, CASE WHEN x2 THEN 'has_dif' END, CASE WHEN x3 THEN 'has_cif' END) AS match_basis FROM s)""")
def d17(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size")
    j = table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    m = F.col("l_linenumber") % 3
    j = j.select(
        "l_orderkey", "l_linenumber", F.col("p_name").alias("mineral"),
        F.when(m == 0, F.col("p_name")).when(m == 1, F.concat("p_name", F.lit(" b"))).otherwise("other").alias("matched_name"),
        F.concat(F.lit("Si"), F.when(F.col("p_size") % 2 == 0, "Al").otherwise("Fe"), F.lit("O4")).alias("formula"),
        F.when(F.col("l_returnflag") == "A", "SiAlO4").when(F.col("l_returnflag") == "N", "CaF2").otherwise("").alias("external_formula"),
        F.col("p_type").alias("family"), F.when(F.col("l_linestatus") == "O", "LARGE").otherwise("SMALL").alias("external_family"),
        F.when(F.col("p_size") % 5 == 0, "group").otherwise("species").alias("category"), (F.col("l_tax") > 0.04).alias("has_measured_xrd"),
        (F.col("l_discount") > 0.05).alias("has_dif"), (F.col("l_quantity") > 25).alias("has_cif"), (F.col("l_tax") == 0).alias("has_error"))
    return M.pattern_match_score(j).select("l_orderkey", "l_linenumber", "match_score", "curation_status", F.array_join("match_basis", ",").alias("match_basis"))


@query("d22_load_reconciliation", f"""
WITH {PTS}, a AS (SELECT curve_id, count(*) AS n, min(tt) AS lo, max(tt) AS hi, max(y) AS mx FROM pts GROUP BY 1),
b AS (SELECT curve_id, count(*) AS n, min(tt) AS lo, max(tt) AS hi, max(y) AS mx FROM pts WHERE idx < 64 - curve_id % 4 GROUP BY 1),
j AS (SELECT curve_id, abs(a.n - b.n) AS pd, greatest(abs(a.lo - b.lo), abs(a.hi - b.hi)) AS sd, abs(a.mx - b.mx) / greatest(abs(a.mx), abs(b.mx), 1) AS md FROM a JOIN b USING (curve_id))
SELECT curve_id, pd AS points_delta, round(sd, 6) AS span_delta, round(md, 6) AS max_delta, CASE WHEN pd = 0 AND sd <= 0.001 AND md <= 0.01 THEN 'compatible' WHEN pd <= 2 AND sd <= 0.05 THEN 'minor_difference' ELSE 'major_difference' END AS status FROM j""")
def d22(spark, d):
    c = curves(spark, d)
    n = F.size("two_theta") - (F.col("curve_id") % 4).cast("int")
    other = c.withColumn("n", n).withColumn("two_theta", F.slice("two_theta", F.lit(1), F.col("n"))).withColumn("intensity", F.slice("intensity", F.lit(1), F.col("n")))
    m = M.load_difference(c, other)
    return m.select("curve_id", F.col("points_delta").cast("long").alias("points_delta"), r(F.col("span_delta")).alias("span_delta"), r(F.col("max_delta")).alias("max_delta"), "status")


@query("d23_metadata_similarity", """
WITH m AS (SELECT vec_id // 3 AS sample_base, vec_id % 3 AS p, 3e0 + (vec_id % 5) * 0.01e0 AS s, 28e0 + (vec_id % 7) * 0.02e0 AS e, 0.4e0 + (vec_id % 2) * 0.001e0 AS st, 64 - vec_id % 4 AS n FROM embeddings)
SELECT sample_base, round(((abs(a.s - b.s) <= 0.02)::INT + (abs(a.e - b.e) <= 0.05)::INT + (abs(a.st - b.st) <= 0.0005)::INT +
  CASE WHEN a.n = b.n THEN 1 WHEN abs(a.n - b.n) / CAST(greatest(a.n, b.n) AS DOUBLE) <= 0.02 THEN 0.75e0 ELSE 0 END) / 4e0, 6) AS similarity
FROM (SELECT sample_base, round(s, 8) AS s, round(e, 8) AS e, round(st, 8) AS st, n FROM m WHERE p = 0) a JOIN (SELECT sample_base, round(s, 8) AS s, round(e, 8) AS e, round(st, 8) AS st, n FROM m WHERE p = 1) b USING (sample_base)""")
def d23(spark, d):
    v = F.col("vec_id")
    m = table(spark, d, "embeddings").select(
        F.floor(v / 3).alias("sample_base"), (v % 3).alias("p"), F.struct(
            ((v % 5) * 0.01 + 3.0).alias("start"), ((v % 7) * 0.02 + 28.0).alias("end"), ((v % 2) * 0.001 + 0.4).alias("step"), (F.lit(64) - v % 4).alias("points")).alias("f"))
    a, b = m.where("p = 0").select("sample_base", F.col("f").alias("a")), m.where("p = 1").select("sample_base", F.col("f").alias("b"))
    return a.join(b, "sample_base").select("sample_base", r(M.metadata_similarity(F.col("a"), F.col("b"))).alias("similarity"))


@query("d24_name_overlap", """
WITH m AS (SELECT o_custkey, list_distinct(list(lower(o_orderpriority)) FILTER (o_orderstatus = 'O')) AS a, list_distinct(list(lower(o_orderpriority)) FILTER (o_orderstatus = 'F')) AS b FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(len(list_intersect(a, b)) / CAST(len(a) AS DOUBLE), 6) ELSE 0 END AS overlap FROM m""")
def d24(spark, d):
    pri = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    g = table(spark, d, "orders").groupBy("o_custkey").agg(pri("O").alias("a"), pri("F").alias("b"))
    return g.select("o_custkey", r(M.name_overlap(F.col("a"), F.col("b"))).alias("overlap"))
