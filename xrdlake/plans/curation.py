"""Curation checks over the order chain: customer -> order -> line."""

from __future__ import annotations

from pyspark.sql import functions as F

from xrdlake.functions.text import lookup_key
from xrdlake.operators import curation as J
from xrdlake.operators.sets import union_all
from xrdlake.plans.registry import query
from xrdlake.plans.views import table

c = F.col
_LK = lambda x: f"trim(regexp_replace(replace(lower(strip_accents({x})), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"


@query("j1_provenance_status", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'Código sintético' WHEN 'N' THEN 'peak list' ELSE NULL END AS txt, CASE l_linestatus WHEN 'O' THEN 'Extração PDF' ELSE 'XRD' END AS mth,
  CASE l_linenumber WHEN 1 THEN 'XRD' WHEN 2 THEN 'local_vocabulary' WHEN 3 THEN 'pdf_text' ELSE NULL END AS st, CASE WHEN l_suppkey % 5 = 0 THEN 'Web' END AS ext FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN txt LIKE 'C%' THEN 'inferred' WHEN mth <> 'XRD' THEN 'extracted' ELSE 'pending_curation' END AS analysis_status, CASE WHEN txt LIKE 'C%' OR mth <> 'XRD' THEN 'pdf_extraction' ELSE 'human_curated_interpretation' END AS assertion,
  CASE WHEN txt LIKE 'C%' THEN 'weak' WHEN mth <> 'XRD' THEN 'indirect' ELSE 'weak' END AS evidence_level, CASE WHEN mth = 'XRD' THEN 'pending_curation' ELSE 'extracted' END AS composition_status,
  CASE WHEN st = 'XRD' THEN 'confirmed' WHEN ext IS NOT NULL THEN 'enriched' WHEN st = 'local_vocabulary' THEN 'pending_curation' WHEN st = 'pdf_text' THEN 'extracted' ELSE 'inferred' END AS mineral_status FROM t""")
def j1(spark, d):
    f, n = c("l_returnflag"), c("l_linenumber")
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(f == "A", "Código sintético").when(f == "N", "peak list").alias("txt"), F.when(c("l_linestatus") == "O", "Extração PDF").otherwise("XRD").alias("mth"),
        F.when(n == 1, "XRD").when(n == 2, "local_vocabulary").when(n == 3, "pdf_text").alias("st"), F.when(c("l_suppkey") % 5 == 0, "Web").alias("ext"))
    a = J.analysis_status("txt", "mth")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", a["status"].alias("analysis_status"), a["assertion"].alias("assertion"), a["evidence_level"].alias("evidence_level"),
                     J.composition_status(F.when(c("mth") == "XRD", "curve").otherwise("tabela de óxidos")).alias("composition_status"), J.mineral_status("st", "ext", F.lit(None).cast("string")).alias("mineral_status"))


@query("j2_evidence_rows", f"""
SELECT page_id, left(w, 79) || '-' || left(sha256(w), 16) AS evidence_id FROM (SELECT page_id, replace({_LK("page_id || '-' || url || '-xrd'")}, ' ', '-') AS w FROM pages)""")
def j2(spark, d):
    return table(spark, d, "pages").select("page_id", J.evidence_id(c("page_id").cast("string"), "url", F.lit("xrd")).alias("evidence_id"))


@query("j3_chain_audit", """
WITH r AS (SELECT o_orderkey AS record_id, CASE o_orderstatus WHEN 'F' THEN 'extracted' WHEN 'O' THEN 'confirmed' END AS cs, o_orderpriority AS uses FROM orders),
a AS (SELECT l_orderkey, bool_or(l_quantity > 48) AS syn FROM lineitem GROUP BY 1),
m AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS nd, count(*) FILTER (l_tax > 0.07) AS ne, count(*) FILTER (l_returnflag <> 'N' AND l_linestatus = 'F') AS nu FROM lineitem GROUP BY 1),
z AS (SELECT record_id, coalesce(syn, false) AS s, coalesce(ne, 0) > 0 AS e, coalesce(nu, 0) > 0 AS u, coalesce(n, 0) > 0 AND coalesce(nd, 0) = 0 AS x, cs = 'extracted' AS w, coalesce(n - nd, 0) AS pm FROM r LEFT JOIN a ON a.l_orderkey = record_id LEFT JOIN m ON m.l_orderkey = record_id),
o AS (SELECT record_id, concat_ws(',', CASE WHEN s THEN 'synthetic_sample' END, CASE WHEN e THEN 'external_enrichment' END, CASE WHEN u THEN 'confirmed_without_evidence' END, CASE WHEN x THEN 'no_direct_evidence' END) AS alerts,
  concat_ws(',', CASE WHEN s THEN 'sample_analysis' END, CASE WHEN w THEN 'analysis_composition' END, CASE WHEN e THEN 'mineral_source' END, CASE WHEN x THEN 'composition_evidence' END) AS weak_links, pm AS pending_minerals, s FROM z)
SELECT record_id, alerts, weak_links, pending_minerals, CASE WHEN s THEN 'weak' WHEN alerts <> '' OR weak_links <> '' THEN 'partial' ELSE 'complete' END AS overall FROM o""")
def j3(spark, d):
    st = c("o_orderstatus")
    r = table(spark, d, "orders").select(c("o_orderkey").alias("record_id"), F.when(st == "F", "extracted").when(st == "O", "confirmed").alias("composition_status"), c("o_orderpriority").alias("uses_text"))
    li = table(spark, d, "lineitem")
    a = li.select(c("l_orderkey").alias("record_id"), F.when(c("l_quantity") > 48, "código sintético").otherwise("ok").alias("text"))
    m = li.select(c("l_orderkey").alias("record_id"), F.when(c("l_linestatus") == "F", "confirmed").otherwise("inferred").alias("status"),
                  F.when(c("l_returnflag") == "N", "confirmed_in_sample").otherwise("candidate").alias("relation"), F.when(c("l_tax") > 0.07, "web").alias("external_source"))
    return J.chain_audit(r, a, m).withColumn("alerts", F.array_join("alerts", ",")).withColumn("weak_links", F.array_join("weak_links", ","))


@query("j4_cross_block_checks", """
WITH camp AS (SELECT o_custkey AS rid, o_orderkey AS k FROM orders WHERE o_orderkey % 4 < 3),
has AS (SELECT rid, count(*) > 0 AS camps FROM camp GROUP BY 1),
smp AS (SELECT o_custkey AS rid, l_orderkey * 10 + l_linenumber AS item, CASE WHEN l_linenumber % 6 > 0 THEN l_orderkey END AS camp_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
mn AS (SELECT l_orderkey AS rid, l_linenumber AS item, CASE l_linenumber % 5 WHEN 0 THEN '' WHEN 1 THEN 'x' || l_partkey ELSE CAST(l_partkey AS VARCHAR) END AS eid,
  CASE l_linenumber % 4 WHEN 0 THEN 'http://example.org/' || l_partkey WHEN 1 THEN 'https://www.mindat.org/min-' || (l_partkey + l_suppkey % 2) || '.html' WHEN 2 THEN NULL ELSE 'https://www.mindat.org/min-' || l_partkey || '.html' END AS uri
  FROM lineitem WHERE l_returnflag = 'A')
SELECT l_orderkey AS record_id, CAST(l_linenumber AS VARCHAR) AS item, 'line_unique' AS rule FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT o_custkey, CAST(o_orderkey AS VARCHAR), 'priority_required' FROM orders WHERE trim(split_part(o_orderpriority, '-', 3)) = '' AND o_orderstatus = 'P'
UNION ALL SELECT l_orderkey, CAST(l_suppkey AS VARCHAR), 'supplier_declared' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders, supplier WHERE o_orderkey = l_orderkey AND s_nationkey = o_custkey % 25 AND s_suppkey = l_suppkey)
UNION ALL SELECT o_custkey, CAST(o_orderkey AS VARCHAR), 'date_format' FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT rid, CAST(camp_id AS VARCHAR), 'campaign_declared' FROM smp WHERE camp_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM camp WHERE camp.rid = smp.rid AND k = camp_id)
UNION ALL SELECT rid, CAST(item AS VARCHAR), 'campaign_required' FROM smp WHERE camp_id IS NULL AND rid IN (SELECT rid FROM has)
UNION ALL SELECT rid, CAST(item AS VARCHAR), 'external_id_required' FROM mn WHERE eid = ''
UNION ALL SELECT rid, CAST(item AS VARCHAR), 'external_id_numeric' FROM mn WHERE eid LIKE 'x%'
UNION ALL SELECT rid, CAST(item AS VARCHAR), 'external_uri_format' FROM mn WHERE uri LIKE 'http://example%'
UNION ALL SELECT rid, CAST(item AS VARCHAR), 'external_uri_matches' FROM mn WHERE uri LIKE '%mindat%' AND eid <> '' AND regexp_extract(uri, 'min-([0-9]+)', 1) <> eid
UNION ALL SELECT page_id, CAST(page_id AS VARCHAR), 'analysis_needed' FROM pages WHERE page_id % 11 = 0 AND page_id % 2 = 0
UNION ALL SELECT page_id, CAST(page_id AS VARCHAR), 'url_format' FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, CAST(page_id AS VARCHAR), 'doi_format' FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, CAST(page_id AS VARCHAR), 'year_format' FROM pages WHERE page_id % 5 = 0""")
def j4(spark, d):
    o, li, s, p = (table(spark, d, t) for t in ("orders", "lineitem", "supplier", "pages"))
    o2 = o.withColumn("third", F.try_element_at(F.split("o_orderpriority", "-"), F.lit(3))).withColumn("dt", F.when(c("o_orderkey") % 7 == 0, "1998-13-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    scopes = o.select(c("o_orderkey").alias("record_id"), (c("o_custkey") % 25).cast("int").alias("scope"))
    suppliers = s.select(c("s_nationkey").alias("scope"), c("s_suppkey").alias("key"))
    k = c("page_id")
    pub = p.select("page_id", F.when(k % 5 == 0, "98").otherwise("1998").alias("year"), F.when(k % 2 == 0, "10.1").otherwise("10.1000/a").alias("doi"), F.when(k % 3 == 0, "ftp://x").otherwise(c("url")).alias("url"))
    # samples name a campaign of their record; catalogue references of minerals; publications that discuss an analysis
    campaigns = o.where("o_orderkey % 4 < 3").select(c("o_custkey").alias("record_id"), c("o_orderkey").alias("key"))
    line = c("l_linenumber")
    samples = li.join(o, c("l_orderkey") == c("o_orderkey")).select("o_custkey", (c("l_orderkey") * 10 + line).alias("item"), F.when(line % 6 > 0, c("l_orderkey")).alias("campaign"))
    entry = F.concat(F.lit("https://www.mindat.org/min-"), F.when(line % 4 == 1, c("l_partkey") + c("l_suppkey") % 2).otherwise(c("l_partkey")).cast("string"), F.lit(".html"))
    minerals = li.where("l_returnflag = 'A'").select(
        "l_orderkey", "l_linenumber", F.lit(" mindat").alias("external_source"),
        F.when(line % 5 == 0, " ").when(line % 5 == 1, F.concat(F.lit("x"), c("l_partkey").cast("string"))).otherwise(c("l_partkey").cast("string")).alias("external_id"),
        F.when(line % 4 == 0, F.concat(F.lit("http://example.org/"), c("l_partkey").cast("string"))).when(line % 4 != 2, entry).alias("external_uri"))
    discussed = p.select("page_id", F.when(k % 11 == 0, "discute_analise").otherwise("cita").alias("relation"), F.when(k % 11 != 0, k).alias("analysis"))
    analysed = p.where(k % 2 == 0).select(k.alias("record_id"), F.lit(True).alias("analysis_needed"))
    return union_all(
        J.unique_within(li, "l_orderkey", "l_linenumber", "line_unique"),
        J.violations(o2, "o_custkey", "o_orderkey", {
            "priority_required": (c("o_orderstatus") == "P") & J.blank_to_null(c("third")).isNull(), "date_format": ~J.is_iso_date("dt")}),
        J.declared(li, "l_orderkey", "l_suppkey", suppliers, "supplier_declared", scopes),
        J.declared(samples, "o_custkey", "campaign", campaigns, "campaign_declared"),
        J.needed_references(samples, "o_custkey", "item", {"campaign_required": c("campaign").isNull()}, campaigns.select("record_id", F.lit(True).alias("campaign_required")).distinct()),
        J.external_id_errors(minerals, "l_orderkey", "l_linenumber"),
        J.needed_references(discussed, "page_id", "page_id", {"analysis_needed": (c("relation") == "discute_analise") & c("analysis").isNull()}, analysed),
        J.publication_errors(pub, "page_id", "page_id"))


@query("j5_default_filling", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS code FROM lineitem), g AS (SELECT l_orderkey, min(code) AS lo, max(code) AS hi FROM l GROUP BY 1)
SELECT l.l_orderkey, l_linenumber, l_partkey, coalesce(code, CASE WHEN lo = hi THEN lo END) AS code FROM l JOIN g ON g.l_orderkey = l.l_orderkey""")
def j5(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(c("l_linenumber") % 2 == 0, c("l_returnflag")).alias("code"))
    return J.fill_single(li, "l_orderkey", "code")


@query("j6_record_normalisation", """
SELECT l_orderkey, l_linenumber, l_partkey, status, CASE status WHEN 'confirmed' THEN 'confirmed_in_sample' WHEN 'enriched' THEN 'external_reference_only' ELSE 'candidate_in_sample' END AS relation
FROM (SELECT *, CASE WHEN l_returnflag = 'N' THEN 'confirmed' WHEN l_suppkey % 5 = 0 THEN 'enriched' ELSE 'inferred' END AS status FROM lineitem)""")
def j6(spark, d):
    li = table(spark, d, "lineitem").withColumn("status", J.mineral_status(F.when(c("l_returnflag") == "N", "xrd"), F.when(c("l_suppkey") % 5 == 0, "Web"), F.lit(None).cast("string")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "status", J.default_relation("status").alias("relation"))


_PROF = """
WITH a AS (SELECT doc_id AS term_id, CASE WHEN quality = 1 THEN 'label' END AS name, CAST(toxic AS VARCHAR) AS formula FROM labels), b AS (SELECT page_id AS term_id, url AS name, CAST(NULL AS VARCHAR) AS formula FROM pages),
d AS (SELECT doc_id AS term_id, lang AS name, source AS formula FROM documents),
j AS (SELECT d.term_id, coalesce(a.name, b.name, d.name) AS name, coalesce(a.formula, d.formula) AS formula, concat_ws(',', CASE WHEN a.term_id IS NOT NULL THEN 'seed' END, CASE WHEN b.term_id IS NOT NULL THEN 'page' END, 'vocabulary') AS sources FROM d LEFT JOIN a USING (term_id) LEFT JOIN b USING (term_id))
"""


def _profile(spark, d):
    a = table(spark, d, "labels").select(c("doc_id").alias("term_id"), F.when(c("quality") == 1, "label").alias("name"), c("toxic").cast("string").alias("formula"))
    b = table(spark, d, "pages").select(c("page_id").alias("term_id"), c("url").alias("name"))
    v = table(spark, d, "documents").select(c("doc_id").alias("term_id"), c("lang").alias("name"), c("source").alias("formula"))
    return J.mineral_profile(v.select("term_id"), [("seed", a), ("page", b), ("vocabulary", v)], ["name", "formula"])


@query("j7_semantic_enrichment", _PROF + "SELECT term_id, name, sources, 'https://example.org/min-' || term_id || '.html' AS uri FROM j")
def j7(spark, d):
    from xrdlake.functions.text import external_uri

    return _profile(spark, d).select("term_id", "name", F.array_join("sources", ",").alias("sources"), external_uri(c("term_id").cast("string"), "https://example.org/min-").alias("uri"))


@query("j8_authorised_catalogue", _PROF + "SELECT term_id, name, formula, sources FROM j")
def j8(spark, d):
    return _profile(spark, d).withColumn("sources", F.array_join("sources", ","))


@query("j9_licence_and_provenance", _PROF + "SELECT sources, count(*) AS terms, CASE WHEN contains(sources, 'page') THEN 'external page; check its licence' WHEN contains(sources, 'seed') THEN 'curated seed' ELSE 'local vocabulary' END AS statement FROM j GROUP BY sources")
def j9(spark, d):
    s = c("sources")
    p = _profile(spark, d).withColumn("sources", F.array_join("sources", ","))
    return p.groupBy("sources").agg(F.count("*").alias("terms")).withColumn(
        "statement", F.when(s.contains("page"), "external page; check its licence").when(s.contains("seed"), "curated seed").otherwise("local vocabulary"))
