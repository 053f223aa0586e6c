"""Sources and sinks: data derived from the tables is written, read back and parsed."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from xrdlake.functions.text import three_digits
from xrdlake.operators import ngc as N, rule_tables as R
from xrdlake.plans.match import NAMED_VALUES, found, peaks, r, reference_lines, LINES_SQL
from xrdlake.plans.registry import query
from xrdlake.plans.rules import MIN_SQL, WIDE, trios
from xrdlake.plans.sqlbits import PEAKS, PTS, bragg_d, bragg_tt
from xrdlake.plans.views import curves, table
from xrdlake.session import new_path
from xrdlake.sources import files as A, sinks as Z

c = F.col
LINES = "string_agg(CASE WHEN idx = 0 THEN '# curve ' || curve_id || chr(10) ELSE '' END || printf('%.1f', tt) || CASE WHEN curve_id % 2 = 0 THEN ';' ELSE chr(9) END || printf('%.3f', y), chr(10) ORDER BY idx)"


def rounded_text(value):
    """Three digits, halves of the decimal text up: what a reader sums is then the sum of the rounded numbers."""
    return F.format_string("%.3f", value)


def curve_texts(spark, d, number=rounded_text):
    """Text of every curve: a comment line, then points; every 50th curve is cut short."""
    cu = curves(spark, d)
    sep = F.when(c("curve_id") % 2 == 0, ";").otherwise("\t")
    rows = F.transform(F.arrays_zip("two_theta", "intensity"), lambda p: F.concat(F.format_string("%.1f", p["two_theta"]), c("sep"), number(p["intensity"])))
    cu = cu.withColumn("sep", sep).withColumn("rows", F.when(c("curve_id") % 50 == 7, F.slice(rows, 1, 6)).otherwise(rows))
    return cu.select("curve_id", F.concat(F.concat(F.lit("# curve "), c("curve_id").cast("string"), F.lit("\n")), F.array_join("rows", "\n")).alias("value"))


def write_curves(spark, d, number=rounded_text):
    """The curves as text files in containers, named by their id."""
    path = new_path(spark, "curves")
    texts = curve_texts(spark, d, number)
    Z.pack_files(texts.select(F.concat(F.lit("curve_id="), c("curve_id").cast("string")).alias("path"), F.concat("value", F.lit("\n")).alias("content")), path)
    return path


def _id_of(col="path"):
    return F.regexp_extract(c(col), r"curve_id=(\d+)", 1).cast("long")


_CUT = PTS + ", cu AS (SELECT * FROM pts WHERE curve_id % 50 <> 7 OR idx < 6)"


@query("a1_text_curves", f"""
WITH {_CUT} SELECT curve_id, count(*) AS points, CAST(1 AS INTEGER) AS skipped_rows, round(min(tt), 1) AS two_theta_start, round(max(tt), 1) AS two_theta_end, 0.4e0 AS step, round(sum(round(y, 3)), 3) AS total, CASE WHEN count(*) < 10 THEN 'erro' ELSE 'importado' END AS status FROM cu GROUP BY 1""")
def a1(spark, d):
    p = A.read_packed_curves(spark, write_curves(spark, d))
    return p.select(_id_of().alias("curve_id"), c("points").cast("long").alias("points"), "skipped_rows", "two_theta_start", "two_theta_end", r(c("step"), 4).alias("step"),
                    F.round(F.aggregate("intensity", F.lit(0.0), lambda a, v: a + v), 3).alias("total"), "status")


@query("a2_file_inventory", f"""
WITH {_CUT}, t AS (SELECT curve_id, {LINES} || chr(10) AS txt FROM cu GROUP BY curve_id)
SELECT curve_id, CAST(length(txt) AS BIGINT) AS length, sha256(txt) AS sha256, 'snapshot:' || left(sha256('curve_id=' || curve_id), 20) AS file_id FROM t""")
def a2(spark, d):
    f = A.inventory(A.packed_files(spark, write_curves(spark, d, three_digits)))
    return f.select(_id_of().alias("curve_id"), "length", "sha256", A.snapshot_id(F.regexp_extract("path", r"(curve_id=\d+)", 1)).alias("file_id"))


def order_documents(spark, d):
    """One JSON document per order with its lines as items."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("i"))
    # lists do not shrink before the shuffle: the plain rows move, each task then collects once
    g = li.repartition("l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("i")).alias("items"))
    return g.select(F.to_json(F.struct(c("l_orderkey").alias("record_id"), "items")).alias("value"))


ORDER_DOC = T.StructType([T.StructField("record_id", T.LongType()), T.StructField("items", T.ArrayType(T.StructType([
    T.StructField("l_linenumber", T.IntegerType()), T.StructField("l_partkey", T.LongType()), T.StructField("l_returnflag", T.StringType())])))])


@query("a3_snapshot_rows", "SELECT l_orderkey AS record_id, l_linenumber, l_partkey, l_returnflag FROM lineitem")
def a3(spark, d):
    path = new_path(spark, "snapshot")
    Z.write_documents(order_documents(spark, d), path)
    return A.read_documents(spark, path, ORDER_DOC, "items")


@query("a4_tolerant_jsonl", "SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 <> 3")
def a4(spark, d):
    path = new_path(spark, "jsonl")
    e = table(spark, d, "events")
    good = F.to_json(F.struct("event_id", "user_id", "event_type"))
    e.select(F.when(c("event_id") % 10 == 3, F.substring(good, 1, 12)).otherwise(good).alias("value")).write.text(path)
    return A.read_jsonl(spark, path, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType())]))


@query("a5_package_manifests", "SELECT l_orderkey AS record_id, count(*) AS items, count(*) FILTER (l_returnflag = 'N') AS natural_items FROM lineitem GROUP BY 1")
def a5(spark, d):
    path = new_path(spark, "manifests")
    Z.write_documents(order_documents(spark, d), path)
    m = A.read_documents(spark, path, ORDER_DOC, "items")
    return m.groupBy("record_id").agg(F.count("*").alias("items"), F.count_if(c("l_returnflag") == "N").alias("natural_items"))


@query("a6_record_scan", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def a6(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("a7_reference_line_text", f"""
WITH {LINES_SQL}, v AS (SELECT reference_id, CAST(line_index AS INTEGER) AS line_index, round(CASE WHEN reference_id % 2 = 0 THEN rt + 20 ELSE rt / 2 END, 3) AS v, ri FROM rl)
SELECT reference_id, line_index, round(CASE WHEN v >= 20 THEN v ELSE {bragg_tt('v')} END, 5) AS two_theta, round(CASE WHEN v >= 20 THEN {bragg_d('v')} ELSE v END, 5) AS d, ri AS intensity FROM v""")
def a7(spark, d):
    ln = reference_lines(spark, d).withColumn("v", F.round(F.when(c("reference_id") % 2 == 0, c("ref_two_theta") + 20).otherwise(c("ref_two_theta") / 2), 3))
    t = ln.groupBy("reference_id").agg(F.array_sort(F.collect_list(F.struct("line_index", F.format_string("%.3f  %.1f", "v", "ref_intensity").alias("t")))).alias("l"))
    t = t.select("reference_id", F.concat(F.lit("# d I\n"), F.array_join("l.t", "\n")).alias("txt"))
    o = A.reference_lines(t, "reference_id", "txt")
    return o.select("reference_id", "line_index", r(c("two_theta"), 5).alias("two_theta"), r(c("d"), 5).alias("d"), "intensity")


@query("a8_open_patterns", """
WITH v AS (SELECT p_name, min(p_partkey) AS term_id FROM part WHERE p_size > 10 GROUP BY 1), s AS (SELECT p_partkey, p_name, CASE p_partkey % 3 WHEN 0 THEN 'measured' WHEN 1 THEN 'lines' ELSE 'structure' END AS source FROM part)
SELECT p_partkey AS external_id, source, replace(s.p_name, ' ', '_') AS slug, term_id FROM s LEFT JOIN v ON v.p_name = s.p_name""")
def a8(spark, d):
    p = table(spark, d, "part")
    k = c("p_partkey")
    base = lambda n: p.where(k % 3 == n)
    by_file = base(0).select(k.alias("external_id"), F.concat(F.lit("dir/"), F.initcap(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("__R"), k.cast("string"), F.lit(".txt")).alias("file_name"), F.lit("measured_powder_xrd").alias("data_kind"))
    named = lambda n, kind: base(n).select(k.alias("external_id"), F.upper("p_name").alias("mineral"), F.lit(kind).alias("data_kind"))
    voc = p.where("p_size > 10").groupBy(A.mineral_slug("p_name").alias("slug")).agg(F.min("p_partkey").alias("term_id"))
    o = A.open_patterns({"measured": by_file, "lines": named(1, "dif_reference"), "structure": named(2, "cif_structure")}, voc)
    return o.select("external_id", "source", "slug", "term_id")


@query("a9_structure_metadata", """
SELECT p_partkey, p_name AS mineral, 'Si O' || p_size AS formula, CASE p_size % 2 WHEN 0 THEN 'P 3 2 1' END AS space_group, round(p_retailprice / 200, 3) AS cell_a, CAST(1000000 + p_partkey AS VARCHAR) AS database_code FROM part""")
def a9(spark, d):
    nl = F.lit("\n")
    p = table(spark, d, "part").select("p_partkey", F.concat(
        F.lit("data_x\n_chemical_name_mineral '"), "p_name", F.lit("'\n_chemical_formula_sum 'Si O"), c("p_size").cast("string"), F.lit("'\n_cell_length_a "), F.format_string("%.3f", c("p_retailprice") / 200), F.lit("(2)"), nl,
        F.when(c("p_size") % 2 == 0, "_symmetry_space_group_name_H-M 'P 3 2 1'\n").otherwise(""), F.lit("_cod_database_code "), (c("p_partkey") + 1000000).cast("string"), nl).alias("value"))
    return A.structure_metadata(p).select("p_partkey", "mineral", "formula", "space_group", "cell_a", "database_code")


@query("a10_reference_index", f"""
WITH {LINES_SQL}, k AS (SELECT *, CASE WHEN reference_id % 2 = 0 THEN 'one' ELSE 'two' END AS source, row_number() OVER (PARTITION BY reference_id ORDER BY ri DESC, line_index) AS rank, max(ri) OVER (PARTITION BY reference_id) AS top FROM rl)
SELECT source, reference_id, line_index, rank, round(100 * ri / top, 6) AS relative_intensity, source || ' ' || lower(replace(mineral, '#', ' ')) AS search_key FROM k""")
def a10(spark, d):
    ln = reference_lines(spark, d).select("reference_id", "mineral", "line_index", c("ref_two_theta").alias("two_theta"), c("ref_intensity").alias("intensity"))
    x = A.reference_index({"one": ln.where("reference_id % 2 = 0"), "two": ln.where("reference_id % 2 = 1")})
    return x.select("source", "reference_id", "line_index", "rank", r(c("relative_intensity")).alias("relative_intensity"), "search_key")


@query("a11_page_facts", r"""
SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<html[^>]*\blang="([a-z]+)"', 1)), '') AS lang, nullif(trim(regexp_extract(html, '(?is)<title>([^<]*)</title>', 1)), '') AS title, nullif(trim(regexp_extract(html, '(?is)<h1>([^<]*)</h1>', 1)), '') AS heading,
  CAST(len(regexp_extract_all(html, '(?i)<a\s+href=')) AS INTEGER) AS links FROM pages""")
def a11(spark, d):
    return A.page_facts(table(spark, d, "pages"))


_VALUE_OF = r"\s*(?:[:\-]|</[^>]+>)[\s:\-]*(?:<[^>]+>\s*)*([^<\r\n]+)"


@query("a11_label_facts", rf"""
WITH p AS (SELECT p_partkey, '<div><b>Formula:</b> <i>SiO' || p_size || '</i></div><p>Hardness - ' || p_size % 10 || '</p><span>Colour</span> ' || lower(p_brand) || '<br>Synonyms: ' || replace(p_name, ' ', ', ') || ';' || p_type || ', ' || p_type || '<br>Formula: second' AS html FROM part)
SELECT p_partkey, trim(regexp_extract(html, 'Formula{_VALUE_OF}', 1)) AS formula, trim(regexp_extract(html, 'Hardness{_VALUE_OF}', 1)) AS hardness, trim(regexp_extract(html, 'Colour{_VALUE_OF}', 1)) AS colour,
  nullif(trim(regexp_extract(html, 'Lustre{_VALUE_OF}', 1)), '') AS lustre,
  (SELECT string_agg(s, '|' ORDER BY s) FROM (SELECT DISTINCT trim(u) AS s FROM (SELECT unnest(regexp_split_to_array(regexp_extract(html, 'Synonyms{_VALUE_OF}', 1), '[;,]')) AS u)) WHERE s <> '') AS synonyms FROM p""")
def a11b(spark, d):
    p = table(spark, d, "part")
    size = c("p_size").cast("string")
    page = p.select("p_partkey", F.concat(
        F.lit("<div><b>Formula:</b> <i>SiO"), size, F.lit("</i></div><p>Hardness - "), (c("p_size") % 10).cast("string"), F.lit("</p><span>Colour</span> "), F.lower("p_brand"),
        F.lit("<br>Synonyms: "), F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(";"), c("p_type"), F.lit(", "), c("p_type"), F.lit("<br>Formula: second")).alias("html"))
    names = {"formula": "Formula", "hardness": "Hardness", "colour": "Colour", "lustre": "Lustre", "synonyms": "Synonyms"}
    return A.label_facts(page, names, ("synonyms",), key="p_partkey").withColumn("synonyms", F.array_join(F.array_sort("synonyms"), "|"))


@query("a12_area_features", """
WITH f AS (SELECT l_suppkey % 50 AS process, lower(p_type) AS mineral_key FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT DISTINCT CAST(process AS VARCHAR) AS process, mineral_key, n_name AS area FROM f JOIN nation ON process = n_nationkey""")
def a12(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_type")
    li = table(spark, d, "lineitem").join(p, c("l_partkey") == c("p_partkey"))
    feat = F.struct(F.lit("Feature").alias("type"), F.struct((c("l_suppkey") % 50).cast("string").alias("process"), c("p_type").alias("mineral")).alias("properties"),
                    F.struct(F.lit("Point").alias("type"), F.array("l_quantity", "l_discount").alias("coordinates")).alias("geometry"))
    docs = li.groupBy("l_orderkey").agg(F.collect_list(feat).alias("features")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("doc"))
    areas = table(spark, d, "nation").select(c("n_nationkey").cast("string").alias("process"), c("n_name").alias("area"))
    return A.area_features(docs, "doc", areas).select("process", "mineral_key", "area")


@query("a13_sinks_round_trip", f"WITH {PEAKS} SELECT curve_id, peak_index, round(d, 5) AS d, 'csv' AS sink FROM pk UNION ALL SELECT curve_id, peak_index, round(d, 5), 'jsonl' FROM pk")
def a13(spark, d):
    p = peaks(spark, d).select("curve_id", c("peak_index").cast("long").alias("peak_index"), r(c("d"), 5).alias("d"))
    csv, js = new_path(spark, "csv"), new_path(spark, "jsonl")
    Z.write_csv(p, csv)
    Z.write_jsonl(p, js)
    schema = "curve_id long, peak_index long, d double"
    a = spark.read.schema(schema).option("header", True).csv(csv).withColumn("sink", F.lit("csv"))
    return a.unionByName(spark.read.schema(schema).json(js).withColumn("sink", F.lit("jsonl")))


@query("a14_route_by_mineral", f"""
WITH {WIDE}, m AS (SELECT sample_base, unnest(string_split(CASE WHEN {MIN_SQL} = '' THEN 'Inconclusivos' ELSE {MIN_SQL} END, ',')) AS mineral FROM wd) SELECT mineral, sample_base FROM m""")
def a14(spark, d):
    path = new_path(spark, "routed")
    Z.route_by_mineral(N.interval_diagnosis(trios(spark, d)).select("sample_base", "minerals"), path)
    return spark.read.parquet(path).select("mineral", "sample_base")


@query("a15_versioned_runs", """
SELECT event_id, event_type, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS content_hash FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 100""")
def a15(spark, d):
    path = new_path(spark, "runs")
    e = Z.with_run_hash(table(spark, d, "events"), "event_id", "event_type", "user_id").withColumn("run_date", F.to_date("ts"))
    Z.append_run(e.select("event_id", "event_type", "ts", "content_hash", "run_date"), path)
    return Z.latest_runs(spark.read.parquet(path), [F.desc("ts"), c("event_id")], 100, c("event_type") == "error").select("event_id", "event_type", "content_hash")


@query("a16_rule_catalogue", f"WITH {PEAKS}, w(range_id, lo, hi) AS (VALUES {NAMED_VALUES}) SELECT range_id, lo AS d_min, hi AS d_max, count(d) AS peaks FROM w LEFT JOIN pk ON d BETWEEN lo AND hi GROUP BY ALL")
def a16(spark, d):
    w = R.rule_windows(spark).where("section = 'named'").select("range_id", "d_min", "d_max")
    p = peaks(spark, d).select("d")
    from xrdlake.operators.matching import window_hits
    from xrdlake.plans.match import named_windows

    n = window_hits(p, named_windows()).groupBy(c("w.range_id").alias("range_id")).agg(F.count("*").alias("n"))
    return w.join(n, "range_id", "left").select("range_id", "d_min", "d_max", F.coalesce("n", F.lit(0)).alias("peaks"))


@query("a17_upload_manifest", """
WITH f AS (SELECT o_orderkey AS record_id, o_custkey, 'S' || o_custkey || CASE o_orderkey % 3 WHEN 0 THEN ' (N).raw' WHEN 1 THEN '-G.csv' ELSE '.pdf' END AS file_name, o_orderkey % 3 AS k, o_orderstatus FROM orders)
SELECT record_id, file_name, CASE k WHEN 0 THEN 'natural' ELSE 'glicolado' END AS preparation, CASE WHEN o_orderstatus = 'F' THEN record_id END AS analysis_id, CASE WHEN o_orderstatus = 'F' THEN 'code' || o_custkey ELSE 'S' || o_custkey END AS sample_code FROM f WHERE k < 2""")
def a17(spark, d):
    k = c("o_orderkey") % 3
    o = table(spark, d, "orders").withColumn("file_name", F.concat(F.lit("S"), c("o_custkey").cast("string"), F.when(k == 0, " (N).raw").when(k == 1, "-G.csv").otherwise(".pdf")))
    f = o.select(c("o_orderkey").alias("record_id"), "file_name")
    a = o.select(c("o_orderkey").alias("record_id"), "file_name", c("o_orderkey").alias("analysis_id"), F.concat(F.lit("code"), c("o_custkey").cast("string")).alias("sample_code"), F.when(c("o_orderstatus") == "F", "XRD").otherwise("XRF").alias("method"))
    return A.upload_manifest(f, a).select("record_id", "file_name", "preparation", "analysis_id", "sample_code")


@query("a18_import_log", f"""
WITH {_CUT}, t AS (SELECT curve_id, {LINES} AS txt, count(*) AS n FROM cu GROUP BY curve_id) SELECT curve_id, CASE WHEN n < 10 THEN 'erro' ELSE 'importado' END AS status, CASE WHEN n < 10 THEN 'too_few_points' END AS error, CASE WHEN n >= 10 THEN n END AS points, sha256(txt) AS sha256 FROM t""")
def a18(spark, d):
    t = curve_texts(spark, d, three_digits).withColumn("path", c("curve_id").cast("string"))
    g = A.import_log(A.parse_text_curves(t))
    return g.select(c("path").cast("long").alias("curve_id"), "status", "error", c("points").cast("long").alias("points"), "sha256")


@query("a19_vocabulary_load", """
WITH u AS (SELECT p_partkey AS term_id, p_name AS title, [p_brand, p_name] AS al, false AS disp FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, p_type, [p_brand], true FROM part WHERE p_size > 25),
n AS (SELECT term_id, title AS name FROM u WHERE NOT disp UNION ALL SELECT term_id, unnest(al) FROM u) SELECT DISTINCT term_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS key FROM n""")
def a19(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_size <= 25").select(c("p_partkey").alias("term_id"), c("p_name").alias("title"), F.array("p_brand", "p_name").alias("aliases"), F.lit(False).alias("display_only"))
    b = p.where("p_size > 25").select(c("p_partkey").alias("term_id"), c("p_type").alias("title"), F.array("p_brand").alias("aliases"), F.lit(True).alias("display_only"))
    return A.load_vocabulary(a, b).select("term_id", "key")
