"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from xrdlake.functions import geochem, geometry as G, minerals as M, text as T, values as V
from xrdlake.plans.registry import query
from xrdlake.plans.sqlbits import PTS, bragg_d, bragg_tt
from xrdlake.plans.views import points, table


def r(c, digits=6):
    return F.round(c, digits)


@query("b1_bragg_spacing", f"""
WITH {PTS} SELECT curve_id, idx, round({bragg_d('tt')}, 6) AS d FROM pts""")
def b1(spark, d):
    return points(spark, d).select("curve_id", "idx", r(G.bragg_d("two_theta")).alias("d"))


@query("b2_bragg_angle", f"""
SELECT p_partkey, round(p_retailprice / 300 - 2.9e0, 6) AS d, round({bragg_tt('p_retailprice / 300 - 2.9e0')}, 6) AS two_theta,
       1.5406e0 < 2 * (p_retailprice / 300 - 2.9e0) AS observable FROM part""")
def b2(spark, d):
    p = table(spark, d, "part").withColumn("v", F.col("p_retailprice") / 300 - 2.9)
    return p.select("p_partkey", r(F.col("v")).alias("d"), r(G.bragg_two_theta("v")).alias("two_theta"),
                    G.observable("v").alias("observable"))


@query("b3_angles_and_wavelength_units", f"""
WITH {PTS}, u AS (SELECT *, CASE idx % 4 WHEN 0 THEN 'angstrom' WHEN 1 THEN 'A*' WHEN 2 THEN 'kX' ELSE 'nm' END AS unit FROM pts)
SELECT curve_id, idx, round(tt / 2, 6) AS theta, round(tt * 2, 6) AS doubled,
       round(CASE WHEN unit IN ('angstrom', 'A*') THEN tt WHEN unit = 'kX' THEN tt * 1.002056e0 END, 6) AS wavelength FROM u""")
def b3(spark, d):
    unit = (F.when(F.col("idx") % 4 == 0, "angstrom").when(F.col("idx") % 4 == 1, "A*")
            .when(F.col("idx") % 4 == 2, "kX").otherwise("nm"))
    return points(spark, d).withColumn("unit", unit).select(
        "curve_id", "idx", r(G.theta("two_theta")).alias("theta"), r(G.two_theta_of("two_theta")).alias("doubled"),
        r(G.wavelength_in_angstrom("two_theta", "unit")).alias("wavelength"))


@query("b4_lattice_spacing", """
WITH c AS (SELECT p_partkey, p_retailprice / 200 AS a, p_retailprice / 150 AS c, p_size % 4 AS h, p_size % 3 AS k, p_size % 5 AS l FROM part)
SELECT p_partkey, round(CASE WHEN h*h + k*k + l*l > 0 THEN a / sqrt(h*h + k*k + l*l) END, 6) AS cubic_d,
       round(CASE WHEN h*h + k*k + l*l > 0 THEN 1 / sqrt((h*h + k*k) / (a*a) + (l*l) / (c*c)) END, 6) AS tetragonal_d FROM c""")
def b4(spark, d):
    p = table(spark, d, "part").select(
        "p_partkey", (F.col("p_retailprice") / 200).alias("a"), (F.col("p_retailprice") / 150).alias("c"),
        (F.col("p_size") % 4).alias("h"), (F.col("p_size") % 3).alias("k"), (F.col("p_size") % 5).alias("l"))
    return p.select("p_partkey", r(G.cubic_d("a", "h", "k", "l")).alias("cubic_d"),
                    r(G.tetragonal_d("a", "c", "h", "k", "l")).alias("tetragonal_d"))


@query("b5_geometry_scalars", """
WITH c AS (SELECT p_partkey, p_retailprice / 1000 AS d, CAST(p_size AS DOUBLE) AS ang, p_size % 4 AS h FROM part)
SELECT p_partkey, round(1 / d, 6) AS s_from_d, round(2 * sin(radians(ang)) / 1.5406e0, 6) AS s_from_theta,
       round(1 / 1.5406e0, 6) AS ewald_radius, 1 / d <= 2 / 1.5406e0 AS reachable, round(2 / 1.5406e0, 6) AS limit_radius,
       round(h / d, 6) AS recip_x, round(d * (cos(radians(ang)) - cos(radians(90))) / 1.5406e0, 6) AS laue,
       round(1.66042e0 * ang / d, 6) AS density, round(2 * d * sin(radians(ang)), 6) AS wavelength FROM c""")
def b5(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 1000).alias("d"),
                                       F.col("p_size").cast("double").alias("ang"), (F.col("p_size") % 4).alias("h"))
    return p.select(
        "p_partkey", r(G.scattering_vector_of_d("d")).alias("s_from_d"),
        r(G.scattering_vector_of_theta("ang")).alias("s_from_theta"), r(G.ewald_radius()).alias("ewald_radius"),
        G.ewald_reachable("d").alias("reachable"), r(G.limiting_sphere_radius()).alias("limit_radius"),
        r(G.reciprocal_cubic_point("d", "h", "h", "h")["x"]).alias("recip_x"),
        r(G.laue_integer("d", "ang", 90.0)).alias("laue"), r(G.xray_density("ang", "d")).alias("density"),
        r(G.wavelength_from_d("d", "ang")).alias("wavelength"))


@query("b6_scherrer_size", f"""
WITH {PTS} SELECT curve_id, idx, round(CASE WHEN y > 0 AND cos(radians(tt / 2)) > 0
  THEN 0.9e0 * 0.15406e0 / (radians(y / 1000) * cos(radians(tt / 2))) END, 6) AS size_nm FROM pts""")
def b6(spark, d):
    return points(spark, d).select("curve_id", "idx", r(G.scherrer_nm(F.col("intensity") / 1000, "two_theta")).alias("size_nm"))


@query("b7_lenient_number", r"""
WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN replace(CAST(value AS VARCHAR), '.', ',') || ' %'
    WHEN 1 THEN CAST(value AS VARCHAR) WHEN 2 THEN '' ELSE event_type END AS txt FROM events)
SELECT event_id, txt, try_cast(replace(replace(trim(txt), '%', ''), ',', '.') AS DOUBLE) AS number FROM t""")
def b7(spark, d):
    m = F.col("event_id") % 4
    v = F.format_string("%s", F.col("value"))
    e = table(spark, d, "events").select("event_id", F.when(m == 0, F.concat(F.replace(v, F.lit("."), F.lit(",")), F.lit(" %")))
                                         .when(m == 1, v).when(m == 2, "").otherwise(F.col("event_type")).alias("txt"))
    return e.select("event_id", "txt", T.parse_number("txt").alias("number"))


@query("b8_lookup_keys", r"""
SELECT doc_id,
  nullif(trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')), '') AS lookup_key,
  nullif(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')), '') AS ascii_key,
  replace(nullif(lower(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g'), '[''`]', '', 'g'), '[^A-Za-z0-9+]+', ' ', 'g'))), ''), ' ', '_') AS slug
FROM documents""")
def b8(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.fold_accents("text").alias("plain"))
    return t.select("doc_id", *[key("plain", folded=True).alias(name) for name, key in (("lookup_key", T.lookup_key), ("ascii_key", T.ascii_key), ("slug", T.mineral_slug))])


NAMES_SQL = """
names AS (SELECT l_orderkey, l_linenumber, l_partkey,
  CASE l_linenumber % 5 WHEN 0 THEN 'data/S' || l_partkey || ' (' || x || ').raw' WHEN 1 THEN 'raw/S' || l_partkey || '-' || x || '.RAW'
    WHEN 2 THEN 'S' || l_partkey || x || '.csv' WHEN 3 THEN 'C:\\lab\\S' || l_partkey || ' ' || lower(p) || '.dat'
    ELSE 'S' || l_partkey || '.xy' END AS path
  FROM (SELECT *, CASE l_returnflag WHEN 'N' THEN 'N' WHEN 'R' THEN 'G' ELSE 'C' END AS x,
               CASE l_returnflag WHEN 'N' THEN 'NATURAL' WHEN 'R' THEN 'GLICOLADA' ELSE 'CALC' END AS p FROM lineitem))
"""


def names(spark, d):
    """File names built from order lines, one naming style per line number."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    f = F.col("l_returnflag")
    x = F.when(f == "N", "N").when(f == "R", "G").otherwise("C")
    p = F.when(f == "N", "NATURAL").when(f == "R", "GLICOLADA").otherwise("CALC")
    s = F.col("l_partkey").cast("string")
    m = F.col("l_linenumber") % 5
    path = (F.when(m == 0, F.concat(F.lit("data/S"), s, F.lit(" ("), x, F.lit(").raw")))
            .when(m == 1, F.concat(F.lit("raw/S"), s, F.lit("-"), x, F.lit(".RAW")))
            .when(m == 2, F.concat(F.lit("S"), s, x, F.lit(".csv")))
            .when(m == 3, F.concat(F.lit("C:\\lab\\S"), s, F.lit(" "), F.lower(p), F.lit(".dat")))
            .otherwise(F.concat(F.lit("S"), s, F.lit(".xy"))))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", path.alias("path"))


def _treatment_sql(col, out):
    i = {"treatment": 1, "evidence": 2}[out]
    arms = " ".join(f"WHEN regexp_matches({col}, '{p[0]}') THEN '{p[i]}'" for p in T.TREATMENT_PATTERNS)
    return f"CASE {arms} ELSE '{'indeterminado' if i == 1 else 'none'}' END"


@query("b9_treatment_from_name", f"""
WITH {NAMES_SQL}, n AS (SELECT *, upper(path) AS u FROM names),
t AS (SELECT l_orderkey, l_linenumber, path, {_treatment_sql('u', 'treatment')} AS treatment, {_treatment_sql('u', 'evidence')} AS evidence FROM n)
SELECT l_orderkey, l_linenumber, path, treatment, evidence, CASE treatment WHEN 'indeterminado' THEN 'baixa' ELSE 'alta' END AS confidence FROM t""")
def b9(spark, d):
    return names(spark, d).select("l_orderkey", "l_linenumber", "path", T.infer_treatment("path").alias("t")).select(
        "l_orderkey", "l_linenumber", "path", "t.treatment", "t.evidence", "t.confidence")


@query("b10_sample_base", rf"""
WITH {NAMES_SQL}, s AS (SELECT *, trim(regexp_replace(regexp_replace(replace(path, '\', '/'), '^.*/', ''), '\.[A-Za-z0-9]+$', '')) AS raw FROM names),
b AS (SELECT *, trim(regexp_replace(regexp_replace(raw, '[\s._-]*\(?\b(N|G|C|NAT|NATURAL|GLY|GLICOL|GLICOLADA|CAL|CALC|CALCINADA)\b\)?$', '', 'i'), '\s+', ' ', 'g')) AS base FROM s)
SELECT l_orderkey, l_linenumber, CASE WHEN base <> '' THEN base ELSE raw END AS sample_base FROM b""")
def b10(spark, d):
    return names(spark, d).select("l_orderkey", "l_linenumber", T.sample_base("path").alias("sample_base"))


_PK = r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(trim({0})), '\', '/'), '^[a-z]:/', ''), '\.(raw|csv|dat|json)$', ''), '[^a-z0-9]+', ' ', 'g')), '')"


@query("b11_lookup_variants", rf"""
WITH {NAMES_SQL}, p AS (SELECT l_orderkey, l_linenumber, replace(path, '\', '/') AS p FROM names),
k AS (SELECT l_orderkey, l_linenumber, [{_PK.format('p')}, {_PK.format("regexp_replace(p, '^.*/', '')")},
  {_PK.format("regexp_extract(p, '(?:^|/)raw/(.+)$', 1)")}, {_PK.format("regexp_extract(p, '(?:^|/)data/(.+)$', 1)")}] AS ks FROM p)
SELECT l_orderkey, l_linenumber, unnest(list_distinct(list_filter(ks, lambda x: x IS NOT NULL))) AS k FROM k""")
def b11(spark, d):
    return names(spark, d).select("l_orderkey", "l_linenumber", F.explode(T.lookup_variants("path")).alias("k"))


_OX_TEXT_SQL = "'SiO2: ' || replace(CAST(l_quantity AS VARCHAR), '.', ',') || ' %; al2o3 = ' || CAST(l_discount AS VARCHAR) || ' LOI ' || CAST(l_tax AS VARCHAR)"


def _ox_text():
    s = lambda c: F.format_string("%s", F.col(c))
    return F.concat(F.lit("SiO2: "), F.replace(s("l_quantity"), F.lit("."), F.lit(",")), F.lit(" %; al2o3 = "),
                    s("l_discount"), F.lit(" LOI "), s("l_tax"))


@query("b12_oxides_from_text", rf"""
WITH t AS (SELECT l_orderkey, l_linenumber, {_OX_TEXT_SQL} AS txt FROM lineitem)
SELECT l_orderkey, l_linenumber,
  try_cast(replace(regexp_extract(txt, '(?i)\bSiO2\b\s*[:=]?\s*(-?\d+(?:[.,]\d+)?)', 1), ',', '.') AS DOUBLE) AS sio2,
  try_cast(replace(regexp_extract(txt, '(?i)\bAl2O3\b\s*[:=]?\s*(-?\d+(?:[.,]\d+)?)', 1), ',', '.') AS DOUBLE) AS al2o3,
  try_cast(replace(regexp_extract(txt, '(?i)\bLOI\b\s*[:=]?\s*(-?\d+(?:[.,]\d+)?)', 1), ',', '.') AS DOUBLE) AS loi,
  try_cast(replace(regexp_extract(txt, '(?i)\bMgO\b\s*[:=]?\s*(-?\d+(?:[.,]\d+)?)', 1), ',', '.') AS DOUBLE) AS mgo FROM t""")
def b12(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _ox_text().alias("txt"))
    t = t.withColumn("m", geochem.oxides(F.lit(None).cast("map<string,double>"), "txt"))
    g = lambda k: F.try_element_at("m", F.lit(k))
    return t.select("l_orderkey", "l_linenumber", g("SiO2").alias("sio2"), g("Al2O3").alias("al2o3"),
                    g("LOI").alias("loi"), g("MgO").alias("mgo"))


@query("b12_second_text_source", rf"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS few, {_OX_TEXT_SQL} AS txt FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN few THEN 77.5e0 ELSE try_cast(replace(regexp_extract(txt, '(?i)\bSiO2\b\s*[:=]?\s*(-?\d+(?:[.,]\d+)?)', 1), ',', '.') AS DOUBLE) END AS sio2,
  CASE WHEN NOT few THEN try_cast(regexp_extract(txt, '(?i)\bLOI\b\s*[:=]?\s*(-?\d+(?:[.,]\d+)?)', 1) AS DOUBLE) END AS loi, CASE WHEN few THEN CAST(l_linenumber AS DOUBLE) END AS mgo FROM t""")
def b12_sources(spark, d):
    """Lines whose first text names fewer than three oxides go on to a second one."""
    few = F.col("l_linenumber") % 2 == 0
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(few, "SiO2 5 %").otherwise(_ox_text()).alias("a"), F.format_string("SiO2 77,5; MgO: %s", "l_linenumber").alias("b"))
    t = t.withColumn("m", geochem.oxides(F.lit(None).cast("map<string,double>"), "a", "b"))
    g = lambda k: F.try_element_at("m", F.lit(k))
    return t.select("l_orderkey", "l_linenumber", g("SiO2").alias("sio2"), g("LOI").alias("loi"), g("MgO").alias("mgo"))


@query("b13_split_terms", r"""
WITH p AS (SELECT doc_id, trim(v) AS v, pos,
    nullif(trim(regexp_replace(lower(regexp_replace(strip_accents(v), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')), '') AS k
  FROM (SELECT doc_id, unnest(l) AS v, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '[;,/|\n]+') AS l FROM documents))),
f AS (SELECT doc_id, k, arg_min(v, pos) AS v FROM p WHERE k IS NOT NULL GROUP BY ALL)
SELECT d.doc_id, count(f.k) AS n_terms, coalesce(md5(string_agg(f.v, '|' ORDER BY f.k)), md5('')) AS terms_md5
FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""")
def b13(spark, d):
    from xrdlake.operators.sets import split_terms_table

    docs = table(spark, d, "documents").select("doc_id", "text")
    terms = split_terms_table(docs, "doc_id", "text")
    agg = terms.groupBy("doc_id").agg(
        F.count("k").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda p: p["v"]), "|")).alias("h"))
    return docs.select("doc_id").join(agg, "doc_id", "left").select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("n_terms"), F.coalesce("h", F.md5(F.lit(""))).alias("terms_md5"))


_TOK = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower(regexp_replace(strip_accents({0}), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: len(w) >= 3))"


@query("b14_token_overlap", rf"""
WITH t AS (SELECT conv_id, turn, {_TOK.format('text')} AS w FROM conversations),
p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM t)
SELECT conv_id, turn, len(w) AS n_tokens, CASE WHEN prev IS NULL THEN NULL WHEN len(w) = 0 OR len(prev) = 0 THEN 0e0
  ELSE round(len(list_intersect(w, prev)) / CAST(len(list_distinct(list_concat(w, prev))) AS DOUBLE), 4) END AS overlap FROM p""")
def b14(spark, d):
    from pyspark.sql import Window as W

    c = table(spark, d, "conversations").select("conv_id", "turn", T.tokens("text").alias("w"))
    c = c.withColumn("prev", F.lag("w").over(W.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", F.size("w").cast("long").alias("n_tokens"),
                    F.when(F.col("prev").isNotNull(), T.jaccard("w", "prev")).alias("overlap"))


@query("b15_numeric_similarity", """
SELECT l_orderkey, l_linenumber, round(1 - least(abs(l_discount - l_tax) / greatest(abs(l_discount), abs(l_tax), 1e0), 1), 4) AS default_scale,
  round(1 - least(abs(l_quantity - 25) / 20e0, 1), 4) AS fixed_scale,
  round(CASE WHEN greatest(abs(l_discount), abs(l_tax)) = 0 THEN 0 ELSE abs(l_discount - l_tax) / greatest(abs(l_discount), abs(l_tax)) END, 6) AS delta FROM lineitem""")
def b15(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", V.numeric_similarity("l_discount", "l_tax").alias("default_scale"),
        V.numeric_similarity("l_quantity", F.lit(25.0), scale=20).alias("fixed_scale"),
        r(V.relative_delta("l_discount", "l_tax")).alias("delta"))


_EL = "list_sort(list_distinct(regexp_extract_all({0}, '[A-Z][a-z]?')))"


@query("b16_formula_tokens", f"""
WITH t AS (SELECT doc_id, {_EL.format('text')} AS a, {_EL.format("lang || ' ' || upper(source) || ' SiO2 Fe'")} AS b FROM documents)
SELECT doc_id, array_to_string(a, ' ') AS elements, CASE WHEN len(a) > 0 AND len(b) > 0
  THEN len(list_intersect(a, b)) / CAST(greatest(len(a), len(b)) AS DOUBLE) >= 0.6 END AS compatible FROM t""")
def b16(spark, d):
    other = F.concat(F.col("lang"), F.lit(" "), F.upper("source"), F.lit(" SiO2 Fe"))
    return table(spark, d, "documents").select(
        "doc_id", F.array_join(T.formula_elements("text"), " ").alias("elements"),
        T.formula_compatible("text", other).alias("compatible"))


@query("b17_peak_field_aliases", f"""
WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS two_theta,
    CASE WHEN event_id % 3 = 0 THEN value END AS center_2theta, CASE WHEN event_id % 5 = 0 THEN 7.1e0 END AS d_angstrom,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS fwhm FROM events)
SELECT event_id, round(coalesce(two_theta, center_2theta), 6) AS two_theta, round(fwhm, 6) AS fwhm, coalesce(fwhm > 0.5, false) AS broad,
  round(coalesce(d_angstrom, CASE WHEN coalesce(two_theta, center_2theta) > 0 THEN {bragg_d('coalesce(two_theta, center_2theta)')} END), 6) AS d FROM e""")
def b17(spark, d):
    from xrdlake.operators.peaks import normalize_peak_fields

    m = F.col("event_id")
    e = table(spark, d, "events").select(
        "event_id", F.when(m % 3 != 0, F.col("value")).alias("two_theta"), F.when(m % 3 == 0, F.col("value")).alias("center_2theta"),
        F.when(m % 5 == 0, F.lit(7.1)).alias("d_angstrom"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("fwhm"))
    return normalize_peak_fields(e).select("event_id", r(F.col("two_theta")).alias("two_theta"), r(F.col("d")).alias("d"),
                                           r(F.col("fwhm")).alias("fwhm"), "broad")


@query("b18_payload_hash", """
SELECT event_id, sha256(event_id || '|' || event_type || '|' || user_id || '|' || props) AS payload_hash FROM events""")
def b18(spark, d):
    return table(spark, d, "events").select("event_id", V.stable_hash("event_id", "event_type", "user_id", "props").alias("payload_hash"))


@query("b19_validators", r"""
WITH v AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y') || '-02-30'
     WHEN 2 THEN '' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS dt,
   CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%y') END AS yr,
   CASE o_orderkey % 3 WHEN 0 THEN '10.1000/' || o_orderkey WHEN 1 THEN '10.1000' ELSE NULL END AS doi,
   CASE o_orderkey % 2 WHEN 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'c' || o_custkey END AS ext, o_orderkey FROM orders),
w AS (SELECT *, 'https://example.org/min-' || ext || '.html' AS uri FROM v)
SELECT o_orderkey, dt = '' OR (regexp_matches(dt, '^\d{4}-\d{2}-\d{2}$') AND try_strptime(dt, '%Y-%m-%d') IS NOT NULL) AS date_ok,
  regexp_matches(yr, '^\d{4}$') AS year_ok, coalesce(regexp_matches(doi, '^10\.\S+/\S+$'), false) AS doi_ok,
  regexp_matches(ext, '^[0-9]+$') AS id_ok, uri, nullif(regexp_extract(uri, '^https://example\.org/min-([0-9]+)\.html$', 1), '') AS parsed_id,
  starts_with(uri, 'https://') AS url_ok FROM w""")
def b19(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        k, F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k % 4 == 1, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-02-30")))
        .when(k % 4 == 2, "").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("dt"),
        F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy")).otherwise(F.date_format("o_orderdate", "yy")).alias("yr"),
        F.when(k % 3 == 0, F.concat(F.lit("10.1000/"), k.cast("string"))).when(k % 3 == 1, "10.1000").alias("doi"),
        F.when(k % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("ext"))
    o = o.withColumn("uri", T.external_uri("ext", "https://example.org/min-"))
    return o.select(
        "o_orderkey", T.is_iso_date("dt").alias("date_ok"), T.is_year("yr").alias("year_ok"), T.is_doi("doi").alias("doi_ok"),
        T.is_numeric_id("ext").alias("id_ok"), "uri",
        T.external_id_of("uri", r"^https://example\.org/min-([0-9]+)\.html$").alias("parsed_id"), T.is_url("uri").alias("url_ok"))


@query("b20_flatten_text", r"""
SELECT p_partkey, concat_ws(chr(10) || chr(10), nullif(p_name, ''), CASE WHEN p_size % 3 > 0 THEN p_brand END, p_type) AS flat,
  CASE WHEN p_size % 3 > 0 THEN 3 ELSE 2 END AS n_blocks FROM part""")
def b20(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.array(
        F.col("p_name"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).otherwise("  "), F.col("p_type")).alias("v"))
    return p.select("p_partkey", T.flatten_texts("v").alias("flat"),
                    F.size(F.filter("v", lambda x: F.trim(x) != "")).alias("n_blocks"))


@query("b21_score_bands", """
SELECT l_orderkey, l_linenumber, CASE WHEN s >= 0.75 THEN 'alta' WHEN s >= 0.5 THEN 'media' ELSE 'baixa' END AS confidence,
  CASE WHEN s >= 0.8 THEN 'accepted' WHEN s >= 0.6 THEN 'provisional' WHEN s >= 0.4 THEN 'needs_review' ELSE 'rejected' END AS curation,
  CASE WHEN s <= 0 THEN 'rejected' WHEN s >= 0.8 THEN 'probable' WHEN s >= 0.6 THEN 'possible' ELSE 'ambiguous' END AS mixed_status,
  CASE WHEN s * 100 <= 40 THEN 'possible_by_rules' WHEN s * 100 <= 70 THEN 'probable_by_rules' ELSE 'confirmed_by_rules' END AS rule_level,
  CASE WHEN s >= 0.72 AND c >= 0.72 AND l_linenumber >= 3 THEN 'confirmada' WHEN s >= 0.5 AND c >= 0.5 AND l_linenumber >= 2 THEN 'provavel' ELSE 'exploratoria' END AS analogy,
  CASE WHEN s >= 0.78 AND l_linestatus = 'O' THEN 'alta' WHEN s >= 0.58 THEN 'media' WHEN s >= 0.35 THEN 'baixa/media' ELSE 'baixa' END AS group_confidence,
  CASE WHEN l_linenumber = 7 THEN 'ambíguo' WHEN l_linestatus = 'F' AND s >= 0.4 THEN 'provisório' WHEN l_linestatus = 'F' THEN 'possível'
       WHEN s >= 0.6 THEN 'provável' WHEN s >= 0.4 THEN 'possível' ELSE 'descartado' END AS status
FROM (SELECT *, round(l_quantity / 50, 4) AS s, round(1 - l_tax * 8, 4) AS c FROM lineitem)""")
def b21(spark, d):
    li = table(spark, d, "lineitem").withColumn("s", F.round(F.col("l_quantity") / 50, 4)).withColumn("c", F.round(1 - F.col("l_tax") * 8, 4))
    return li.select(
        "l_orderkey", "l_linenumber", V.confidence_class("s").alias("confidence"), V.curation_status("s").alias("curation"),
        V.mixed_layer_status("s").alias("mixed_status"), V.rule_level(F.col("s") * 100).alias("rule_level"),
        V.analogy_class("s", "c", "l_linenumber").alias("analogy"),
        V.group_confidence("s", F.col("l_linestatus") == "O").alias("group_confidence"),
        V.candidate_status("s", F.col("l_linestatus") == "F", F.col("l_linenumber") == 7).alias("status"))


@query("b22_clamp_and_rescale", f"""
WITH {PTS} SELECT curve_id, idx, round(least(greatest(y / 500 - 0.5e0, 0), 1), 6) AS clamped,
  round(CASE WHEN mx > 0 THEN 100 * y / mx ELSE 0 END, 6) AS percent FROM (SELECT *, max(y) OVER (PARTITION BY curve_id) AS mx FROM pts)""")
def b22(spark, d):
    from xrdlake.plans.views import curves

    c = curves(spark, d).withColumn("mx", F.array_max("intensity"))
    p = c.select("curve_id", "mx", F.posexplode("intensity").alias("idx", "y"))
    return p.select("curve_id", "idx", r(V.clamp01(F.col("y") / 500 - 0.5)).alias("clamped"), r(V.to_percent_of("y", "mx")).alias("percent"))


@query("b23_octahedral_class", """
SELECT p_partkey, d060, kind, CASE WHEN expected = kind OR (kind = 'intermediate') THEN 'supports' WHEN kind <> 'unknown' THEN 'contradicts' END AS agreement
FROM (SELECT *, CASE WHEN d060 BETWEEN 1.475 AND 1.515 THEN 'dioctahedral' WHEN d060 BETWEEN 1.505 AND 1.535 THEN 'intermediate'
    WHEN d060 BETWEEN 1.525 AND 1.555 THEN 'trioctahedral' ELSE 'unknown' END AS kind
  FROM (SELECT p_partkey, round(1.4601e0 + p_size * 0.002e0, 6) AS d060, CASE p_partkey % 2 WHEN 0 THEN 'dioctahedral' ELSE 'trioctahedral' END AS expected FROM part))""")
def b23(spark, d):
    p = table(spark, d, "part").select(
        "p_partkey", F.round(F.lit(1.4601) + F.col("p_size") * 0.002, 6).alias("d060"),
        F.when(F.col("p_partkey") % 2 == 0, "dioctahedral").otherwise("trioctahedral").alias("expected"))
    p = p.withColumn("kind", G.octahedral_class("d060"))
    return p.select("p_partkey", "d060", "kind", G.octahedral_agreement("kind", "expected").alias("agreement"))


@query("b24_serpentine_percent", """
SELECT l_orderkey, l_linenumber, round(br, 6) AS beta_r, round(greatest(0e0, -0.51e0 + 24.27e0 * br), 6) AS serpentine
FROM (SELECT *, pow(greatest(pow(l_tax, 1.25e0) - pow(l_discount, 1.25e0), 0e0), 0.8e0) AS br FROM lineitem)""")
def b24(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(G.beta_r("l_tax", "l_discount")).alias("beta_r"),
                                              r(G.serpentine_percent("l_tax", "l_discount")).alias("serpentine"))


@query("b25_method_and_conditions", """
SELECT l_orderkey, l_linenumber, CASE WHEN w = 'variable' AND a = 'fixed' THEN 'laue_method' WHEN w = 'fixed' AND a = 'variable' AND s = 'powder' THEN 'powder_method'
    WHEN w = 'fixed' AND a = 'variable' AND s = 'single crystal' THEN 'rotating_crystal_method' ELSE 'unknown' END AS method,
  concat_ws(',', CASE WHEN l_tax > 0.06 THEN 'beam_divergence' END, CASE WHEN l_discount > 0.08 THEN 'strain' END) AS warnings,
  CASE WHEN l_tax > 0.06 OR l_discount > 0.08 THEN 'nonideal' ELSE 'ideal_assumed' END AS status
FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'variable' ELSE 'fixed' END AS w, CASE WHEN l_linenumber % 2 = 0 THEN 'fixed' ELSE 'variable' END AS a,
  CASE l_linestatus WHEN 'O' THEN 'powder' ELSE 'single crystal' END AS s FROM lineitem)""")
def b25(spark, d):
    w = G.nonideal_warnings({"beam_divergence": F.col("l_tax") > 0.06, "strain": F.col("l_discount") > 0.08})
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        G.method_class(F.when(F.col("l_returnflag") == "A", "variable").otherwise("fixed"),
                       F.when(F.col("l_linenumber") % 2 == 0, "fixed").otherwise("variable"),
                       F.when(F.col("l_linestatus") == "O", "powder").otherwise("single crystal")).alias("method"),
        F.array_join(w, ",").alias("warnings"), G.nonideal_status(w).alias("status"))


@query("b26_mineral_class", """
SELECT doc_id, CASE WHEN regexp_matches(b, 'montmorillonite|smectite|esmectite|chlorite|kaolinite|illite|mica|muscovite|nontronite|hectorite|halloysite|sericite|saponite')
   THEN CASE WHEN regexp_matches(n, 'montmorillonite|smectite|esmectite|nontronite|hectorite|saponite') THEN 'Argilomineral expansivo / esmectita'
     WHEN regexp_matches(n, 'chlorite|clinochlore|chamosite') THEN 'Argilomineral 2:1:1' WHEN regexp_matches(n, 'kaolinite|halloysite|dickite|nacrite') THEN 'Argilomineral 1:1'
     WHEN regexp_matches(n, 'illite|mica|muscovite|sericite|brammallite') THEN 'Argilomineral micáceo' ELSE 'Argilomineral' END
   WHEN regexp_matches(b, 'calcite|dolomite|ankerite|siderite|carbonate|carbonato') THEN 'Carbonato'
   WHEN regexp_matches(b, 'albite|feldspar|feldspato|orthoclase|microcline|plagioclase') THEN 'Feldspato / silicato não argiloso'
   WHEN regexp_matches(b, 'quartz|silica|silicato') THEN 'Silicato não argiloso'
   WHEN regexp_matches(b, 'hematite|goethite|magnetite|oxide|hydroxide|óxido|oxido|hidróxido|hidroxido') THEN 'Óxido/hidróxido de ferro'
   ELSE 'Outro mineral candidato' END AS mineral_class,
  CASE WHEN s >= 0.75 AND doc_id % 3 >= 2 THEN 'dominante/maior' WHEN s >= 0.55 THEN 'maior' WHEN s >= 0.3 THEN 'subordinado' WHEN s IS NOT NULL THEN 'traço' ELSE 'indeterminado' END AS abundance
FROM (SELECT doc_id, lower(text) || CASE lang WHEN 'fr' THEN ' illite' WHEN 'de' THEN ' quartz' ELSE '' END AS n,
   lower(text) || CASE lang WHEN 'fr' THEN ' illite' WHEN 'de' THEN ' quartz' ELSE '' END || ' ' || lower(source) AS b,
   CASE WHEN doc_id % 7 > 0 THEN (doc_id % 11) / 10e0 END AS s FROM documents)""")
def b26(spark, d):
    n = F.concat(F.col("text"), F.when(F.col("lang") == "fr", " illite").when(F.col("lang") == "de", " quartz").otherwise(""))
    docs = table(spark, d, "documents").select("doc_id", n.alias("name"), "source",
                                               F.when(F.col("doc_id") % 7 > 0, (F.col("doc_id") % 11) / 10).alias("s"))
    return docs.select("doc_id", M.mineral_class("name", "source").alias("mineral_class"),
                       V.abundance_class("s", F.col("doc_id") % 3).alias("abundance"))


_B27 = """p_name || ': classe ' || p_type || '; fórmula Si' || p_size || '; sistema cristalino ' || CASE p_size % 3 WHEN 0 THEN 'triclinico' WHEN 1 THEN 'cubico' ELSE 'amorphous' END ||
   '; grupo ' || CASE p_size % 2 WHEN 0 THEN 'da ' || p_brand ELSE 'brand' END"""


@query("b27_short_description", f"""
SELECT p_partkey, {_B27} || CASE WHEN p_size % 5 = 0 THEN ' (Lab)' ELSE '' END || '.' AS description FROM part""")
def b27(spark, d):
    z = F.col("p_size")
    p = table(spark, d, "part").select(
        "p_partkey", "p_name", "p_type", F.concat(F.lit("Si"), z.cast("string")).alias("formula"),
        F.when(z % 3 == 0, "Triclinic").when(z % 3 == 1, "isometric").otherwise("Amorphous").alias("system"),
        F.when(z % 2 == 0, F.concat(F.lit("Grupo da "), F.col("p_brand"))).otherwise("Brand").alias("grp"),
        F.when(z % 5 == 0, "Lab").alias("src"))
    return p.select("p_partkey", M.short_description("p_name", "p_type", "formula", "system", "grp", None, "src").alias("description"))


@query("b27_long_description", f"""
SELECT p_partkey, {_B27} || '; propriedades ' || p_size || CASE WHEN p_size % 4 = 0 THEN '' ELSE '; ambiente ' || lower(p_type) END || '; usos ' || lower(p_brand) || '.' AS description FROM part""")
def b27_long(spark, d):
    z = F.col("p_size")
    p = table(spark, d, "part")
    facts = {
        "structural_class": F.col("p_type"), "formula": F.concat(F.lit("Si"), z.cast("string")), "system": F.when(z % 3 == 0, "triclinic").when(z % 3 == 1, "cubic").otherwise("amorphous"),
        "group": F.when(z % 2 == 0, F.concat(F.lit("Grupo da "), "p_brand")).otherwise("Brand"), "properties": z.cast("string"), "origin": F.lit(" "),
        "environment": F.when(z % 4 != 0, F.lower("p_type")), "uses": F.lower("p_brand")}
    return p.select("p_partkey", M.long_description("p_name", facts).alias("description"))



@query("b28_compact_payload", f"""
WITH {PTS}, t AS (SELECT curve_id, y, tt, row_number() OVER (PARTITION BY curve_id ORDER BY y DESC, tt) AS rk FROM pts)
SELECT curve_id, string_agg(CAST(CAST(round(tt, 1) * 10 AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(round(y) AS BIGINT) AS VARCHAR), ' ' ORDER BY rk) AS payload,
  count(*) AS kept FROM t GROUP BY 1""")
def b28(spark, d):
    from xrdlake.operators.curves import compact_points
    from xrdlake.plans.views import curves

    c = compact_points(curves(spark, d))
    txt = F.transform("compact", lambda p: F.concat((F.round(p["two_theta"], 1) * 10).cast("long").cast("string"), F.lit(":"),
                                                    F.round(p["intensity"]).cast("long").cast("string")))
    return c.select("curve_id", F.array_join(txt, " ").alias("payload"), F.size("compact").cast("long").alias("kept"))


@query("b29_labels_and_markup", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain,
  CASE page_id % 3 WHEN 0 THEN 'Trigonal' WHEN 1 THEN 'Cubico' ELSE 'unknown' END AS crystal_system FROM pages""")
def b29(spark, d):
    return table(spark, d, "pages").select(
        "page_id", T.strip_markup("html").alias("plain"),
        M.crystal_system(F.when(F.col("page_id") % 3 == 0, "TRIGONAL").when(F.col("page_id") % 3 == 1, "Isometric").otherwise("unknown")).alias("crystal_system"))
