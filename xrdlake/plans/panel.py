"""Panels, rankings, filters and set operations over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from xrdlake.functions.geometry import D060_WINDOW, d060_distance
from xrdlake.functions.text import lookup_key
from xrdlake.functions.values import stable_hash
from xrdlake.operators import curves as C, panels as P, sets as X
from xrdlake.operators.hot import dealt
from xrdlake.operators.matching import nearest_window
from xrdlake.plans.match import NAMED_VALUES, peaks, r
from xrdlake.plans.curve import TARGETED_SQL
from xrdlake.plans.registry import query
from xrdlake.plans.sqlbits import CANDS, GEO, PEAKS, bragg_d
from xrdlake.plans.views import candidates, curves, geo_rows, table

c = F.col
half5 = lambda x: F.round(x + 1e-9, 5)  # noqa: E731  exact halves are nudged alike in both engines
_PREP_SQL = "CASE o_orderkey % 7 WHEN 0 THEN 'indeterminado' WHEN 1 THEN 'natural' WHEN 2 THEN 'glicolado' WHEN 3 THEN 'calcinado' WHEN 4 THEN 'natural' WHEN 5 THEN 'glicolado' ELSE 'natural' END"
ITEMS_SQL = f"it AS (SELECT o_orderkey AS item_id, o_custkey AS sample_base, {_PREP_SQL} AS preparation, o_orderpriority AS mineral, o_totalprice AS price, o_orderstatus AS st FROM orders)"


def items(spark, d):
    names = F.array(*[F.lit(x) for x in ("indeterminado", "natural", "glicolado", "calcinado", "natural", "glicolado", "natural")])
    return table(spark, d, "orders").select(
        c("o_orderkey").alias("item_id"), c("o_custkey").alias("sample_base"), F.get(names, (c("o_orderkey") % 7).cast("int")).alias("preparation"),
        c("o_orderpriority").alias("mineral"), c("o_totalprice").alias("price"), c("o_orderstatus").alias("st"))


_TRIO_SQL = """g AS (SELECT sample_base, count(*) AS n_items, min(item_id) FILTER (preparation = 'natural') AS "natural", min(item_id) FILTER (preparation = 'glicolado') AS glicolado,
  min(item_id) FILTER (preparation = 'calcinado') AS calcinado, min(item_id) FILTER (preparation = 'indeterminado') AS indeterminado,
  count(*) - count(DISTINCT preparation) AS duplicates FROM it GROUP BY 1)"""


@query("e1_treatment_groups", f"""
WITH {ITEMS_SQL}, {_TRIO_SQL} SELECT *, "natural" IS NOT NULL AND glicolado IS NOT NULL AND calcinado IS NOT NULL AS complete_trio FROM g""")
def e1(spark, d):
    return P.best_by_preparation(items(spark, d)).select("sample_base", "n_items", *P.ALL_PREPARATIONS, "duplicates", "complete_trio")


@query("e2_comparison_suggestions", f"""
WITH {ITEMS_SQL}, {_TRIO_SQL},
p AS (SELECT CAST(sample_base AS VARCHAR) AS "group", CASE WHEN "natural" IS NOT NULL AND glicolado IS NOT NULL AND calcinado IS NOT NULL THEN 'trio' WHEN "natural" IS NOT NULL AND glicolado IS NOT NULL THEN 'ng'
   WHEN "natural" IS NOT NULL AND calcinado IS NOT NULL THEN 'nc' WHEN glicolado IS NOT NULL AND calcinado IS NOT NULL THEN 'gc' END AS type, ["natural", glicolado, calcinado] AS items FROM g),
u AS (SELECT "group", type, CASE type WHEN 'trio' THEN 1 WHEN 'ng' THEN 2 WHEN 'nc' THEN 3 ELSE 4 END AS priority, unnest(items) AS item FROM p WHERE type IS NOT NULL
  UNION ALL SELECT CAST(sample_base AS VARCHAR), 'indeterminado', 5, unnest([indeterminado, "natural", glicolado, calcinado]) FROM g WHERE indeterminado IS NOT NULL AND coalesce("natural", glicolado, calcinado) IS NOT NULL
  UNION ALL SELECT CAST(sample_base AS VARCHAR), 'replicatas', 8, item_id FROM (SELECT *, count(*) OVER (PARTITION BY sample_base) AS n FROM it) WHERE n >= 3
  UNION ALL SELECT preparation, 'preparo', 7, item_id FROM it
  UNION ALL SELECT mineral, 'mineral', 6, item_id FROM it)
SELECT * FROM u WHERE item IS NOT NULL""")
def e2(spark, d):
    it = items(spark, d)
    return P.comparison_suggestions(it.select("item_id", "sample_base", "preparation"), it.select("item_id", "mineral"))


@query("e3_mineral_panel", f"""
WITH {CANDS} SELECT lower(mineral) AS key, min(mineral) AS mineral, count(*) AS count, max(score) AS best_score, max((score, grp))[2] AS best_group, count(DISTINCT curve_id) AS samples,
  array_to_string(list_sort(list(DISTINCT treatment)), ',') AS treatments,
  CASE max(CASE WHEN score >= 0.72 AND lines >= 10 THEN 3 WHEN score >= 0.45 THEN 2 ELSE 1 END) WHEN 3 THEN 'alta' WHEN 2 THEN 'média' ELSE 'baixa' END AS best_confidence FROM cand GROUP BY 1""")
def e3(spark, d):
    return P.mineral_panel(scored(spark, d)).withColumn("treatments", F.array_join("treatments", ","))


@query("e3_support_peaks", f"""
WITH {PEAKS} SELECT 'mineral ' || label AS key, curve_id, peak_index, round(d, 5) AS d FROM pk JOIN embeddings ON vec_id = curve_id WHERE label % 2 <> 0 OR d BETWEEN 3 AND 4""")
def e3_peaks(spark, d):
    even = c("label") % 2 == 0
    m = curves(spark, d).select("curve_id", F.concat(F.lit("Mineral "), c("label").cast("string")).alias("mineral"), F.when(even, 3.0).alias("d_min"), F.when(even, 4.0).alias("d_max"))
    return P.support_peaks(m, peaks(spark, d)).withColumn("d", r(c("d"), 5))


_CONF_SQL = "CASE WHEN score >= 0.72 AND lines >= 10 THEN 'alta' WHEN score >= 0.45 THEN 'media' ELSE 'baixa' END"


def scored(spark, d):
    return candidates(spark, d).withColumn("confidence", F.when((c("score") >= 0.72) & (c("lines") >= 10), "alta").when(c("score") >= 0.45, "media").otherwise("baixa"))


@query("e4_mineral_assembly", f"""
WITH {CANDS}, a AS (SELECT lower(replace(replace(label, '#', ' '), '  ', ' ')) AS slug, max(score) AS best_score, max(CASE {_CONF_SQL} WHEN 'alta' THEN 3 WHEN 'media' THEN 2 ELSE 1 END) AS best_rank, min(grp) AS grp FROM cand GROUP BY 1)
SELECT slug, best_score, best_rank, grp, 'Outros' AS bucket, round(avg(best_rank) OVER (), 6) AS mean_rank, CASE WHEN avg(best_rank) OVER () >= 2.4 THEN 'alta' WHEN avg(best_rank) OVER () >= 1.4 THEN 'média' ELSE 'baixa' END AS confidence FROM a""")
def e4(spark, d):
    a = P.mineral_assembly(scored(spark, d).withColumn("mineral", c("label")))
    o = P.assembly_confidence(a)
    return a.select("*", o.select("mean_rank").scalar().alias("mean_rank"), o.select("confidence").scalar().alias("confidence")).select("slug", "best_score", "best_rank", c("group").alias("grp"), "bucket", r(c("mean_rank")).alias("mean_rank"), "confidence")


_DIMS = ("mineral", "grp", "rock", "era", "environment")


@query("e5_aggregate_dimensions", "WITH " + GEO + ", l AS (" + " UNION ALL ".join(f"SELECT '{x}' AS dimension, coalesce({x}, 'Não informado') AS label, * FROM geo" for x in _DIMS) + """)
SELECT dimension, label, count(*) AS count_rows, count(DISTINCT record_id) AS count_records, round(avg(SiO2), 5) AS mean_sio2, round(avg(Al2O3), 5) AS mean_al2o3, round(avg(Fe2O3), 5) AS mean_fe2o3, round(avg(MgO), 2) AS mean_mgo FROM l GROUP BY ALL""")
def e5(spark, d):
    g = geo_rows(spark, d).withColumnRenamed("group", "grp")
    a = P.aggregate_dimensions(g, list(_DIMS), ["SiO2", "Al2O3", "Fe2O3", "MgO"])
    return a.select("dimension", "label", "count_rows", "count_records", *[r(c(f"mean_{o}"), 2 if o == "MgO" else 5).alias(f"mean_{o.lower()}") for o in ("SiO2", "Al2O3", "Fe2O3", "MgO")])


@query("e6_oxide_statistics", "WITH " + GEO + ", l AS (" + " UNION ALL ".join(f"SELECT '{o}' AS oxide, {o} AS v FROM geo" for o in ("SiO2", "Al2O3", "Fe2O3", "MgO")) + """)
SELECT oxide, count(*) AS count, round(avg(v), 3) AS mean, min(v) AS min, max(v) AS max FROM l GROUP BY 1""")
def e6(spark, d):
    return P.value_statistics(geo_rows(spark, d), ["SiO2", "Al2O3", "Fe2O3", "MgO"]).withColumn("mean", r(c("mean"), 3))


@query("e7_empirical_windows", """
WITH v AS (SELECT p_brand AS mineral_id, CAST(l_linenumber AS VARCHAR) AS peak_id, l_returnflag AS preparation, round(7 + l_discount * 4 + l_tax, 4) AS d, l_linestatus = 'F' AS ok, l_suppkey AS src FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT mineral_id, peak_id, preparation, count(*) AS n, round(avg(d) + 1e-9, 5) AS mean, round(stddev_pop(d) + 1e-9, 5) AS std, round(min(d) + 1e-9, 5) AS min, round(max(d) + 1e-9, 5) AS max, round(quantile_cont(d, 0.05) + 1e-9, 5) AS p05, round(quantile_cont(d, 0.95) + 1e-9, 5) AS p95,
  'p05_p95' AS strategy, CASE WHEN count(*) >= 5 THEN 'reference_empirical' ELSE 'low' END AS confidence, any_value(ig) AS ignored,
  sha256(mineral_id || '|' || peak_id || '|' || preparation || '|' || count(*) || '|' || sum(('0x' || substr(md5(src || '|' || printf('%.4f', d)), 1, 12))::BIGINT)) AS provenance_hash
FROM (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY mineral_id, peak_id, preparation) AS ig FROM v) WHERE ok GROUP BY mineral_id, peak_id, preparation""")
def e7(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), c("l_partkey") == c("p_partkey"))
    v = li.select(c("p_brand").alias("mineral_id"), c("l_linenumber").cast("string").alias("peak_id"), c("l_returnflag").alias("preparation"),
                  F.round(c("l_discount") * 4 + c("l_tax") + 7, 4).alias("d_spacing"), F.when(c("l_linestatus") == "F", "accepted").otherwise("pending").alias("validation_status"),
                  c("l_suppkey").alias("source_record_id"))
    e = P.empirical_windows(v)
    return e.select("mineral_id", "peak_id", "preparation", "n", *[half5(c(k)).alias(k) for k in ("mean", "std", "min", "max", "p05", "p95")], "strategy", "confidence", "ignored", "provenance_hash")


@query("e8_vocabulary_coverage", """
WITH rec AS (SELECT l_partkey AS term_id, l_returnflag AS kind, CASE WHEN l_tax < 0.02 THEN 'accepted' ELSE 'provisional' END AS cs FROM lineitem),
p AS (SELECT term_id, count(*) AS n, count(*) FILTER (cs <> 'accepted') AS rv, count(*) FILTER (kind = 'A') AS a, count(*) FILTER (kind = 'N') AS b FROM rec GROUP BY 1)
SELECT p_type AS family, count(*) AS total_terms, count(n) AS with_match, count(*) - count(n) AS without_match, count(*) FILTER (rv > 0) AS needs_review, count(*) FILTER (a > 0) AS with_powder, count(*) FILTER (b > 0) AS with_cif FROM part LEFT JOIN p ON term_id = p_partkey GROUP BY 1""")
def e8(spark, d):
    rec = table(spark, d, "lineitem").select(c("l_partkey").alias("term_id"), c("l_returnflag").alias("kind"), F.when(c("l_tax") < 0.02, "accepted").otherwise("provisional").alias("curation_status"))
    terms = table(spark, d, "part").select(c("p_partkey").alias("term_id"), c("p_type").alias("family"))
    return P.vocabulary_coverage(terms, rec, {"powder": c("kind") == "A", "cif": c("kind") == "N"})


@query("e9_panel_metrics", f"""
WITH {CANDS}, i AS (SELECT curve_id, min(treatment) AS treatment, CASE WHEN curve_id % 11 = 0 THEN 'erro' ELSE 'ok' END AS status, count(*) FILTER (score > 0.2) AS nc, count(*) FILTER (lines > 20) AS np, max(score) AS s FROM cand GROUP BY 1)
SELECT treatment, count(*) AS rows, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS errors, count(*) FILTER (nc > 0) AS with_candidates, count(*) FILTER (np > 0) AS with_peaks,
  count(*) FILTER (s < 0.25) AS score_0_25, count(*) FILTER (s >= 0.25 AND s < 0.5) AS score_25_50, count(*) FILTER (s >= 0.5 AND s < 0.75) AS score_50_75, count(*) FILTER (s >= 0.75) AS score_75_100 FROM i GROUP BY 1""")
def e9(spark, d):
    i = candidates(spark, d).groupBy("curve_id").agg(F.min("treatment").alias("treatment"), F.count_if(c("score") > 0.2).alias("n_candidates"), F.count_if(c("lines") > 20).alias("n_peaks"), F.max("score").alias("best_score"))
    return P.panel_metrics(i.withColumn("status", F.when(c("curve_id") % 11 == 0, "erro").otherwise("ok")))


@query("e10_facets", f"""WITH {GEO} SELECT 'mineral' AS facet, mineral AS value, count(*) AS rows FROM geo GROUP BY 2 UNION ALL SELECT 'rock', rock, count(*) FROM geo GROUP BY 2 UNION ALL SELECT 'era', era, count(*) FROM geo GROUP BY 2""")
def e10(spark, d):
    return P.facets(geo_rows(spark, d), ["mineral", "rock", "era"])


@query("e11_mineral_network_map", f"""
WITH {GEO} SELECT mineral, array_to_string(list_sort(list(DISTINCT grp)), ',') AS groups, count(DISTINCT record_id) AS count_records FROM geo GROUP BY 1""")
def e11(spark, d):
    g = dealt(geo_rows(spark, d).select("mineral", "record_id"), "record_id").groupBy("mineral", "record_id").agg(F.count("*").alias("n"))
    groups = geo_rows(spark, d).select("mineral", "group").distinct().groupBy("mineral").agg(F.array_join(F.array_sort(F.collect_list("group")), ",").alias("groups"))
    return g.groupBy("mineral").agg(F.count("*").alias("count_records")).join(groups, "mineral")


@query("e12_collapse_map_points", """
SELECT user_id AS record_id, round(value % 10, 0) AS lat, round(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10, 0) AS lon, count(*) AS points, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view,
  array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY ALL""")
def e12(spark, d):
    p = table(spark, d, "events").select(c("user_id").alias("record_id"), F.round(c("value") % 10, 0).alias("lat"), F.round(F.get_json_object("props", "$.k").cast("double") / 10, 0).alias("lon"), c("event_type").alias("kinds"))
    return P.collapse_points(p, ["kinds"], {"click": c("kinds") == "click", "view": c("kinds") == "view"}).withColumn("kinds", F.array_join("kinds", ","))


@query("e13_point_extraction", """
WITH s AS (SELECT o_orderkey, l_linenumber, l_partkey, l_quantity AS lat, l_discount * 100 AS lon FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)
SELECT o_orderkey AS record_id, 'sample' AS kind, lat, round(lon, 4) AS lon FROM s WHERE l_partkey IS NOT NULL UNION ALL SELECT o_orderkey, 'legacy', NULL, NULL FROM s WHERE l_partkey IS NULL""")
def e13(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(c("l_quantity").alias("lat"), (c("l_discount") * 100).alias("lon"))).alias("samples"))
    o = table(spark, d, "orders").join(li, c("o_orderkey") == c("l_orderkey"), "left")
    p = o.select(c("o_orderkey").alias("record_id"), F.explode_outer("samples").alias("s"))
    return p.select("record_id", F.when(c("s").isNotNull(), "sample").otherwise("legacy").alias("kind"), "s.lat", r(c("s.lon"), 4).alias("lon"))


@query("e14_best_treatment", f"""
WITH {TARGETED_SQL}, t AS (SELECT sample_base, preparation, count(*) FILTER (mineral <> 'Quartzo' AND quality = 'strong') AS strong, count(*) FILTER (mineral <> 'Quartzo' AND quality <> 'not_found') AS hits,
  CASE preparation WHEN 'natural' THEN 0 WHEN 'glicolado' THEN -1 ELSE -2 END AS o FROM tg GROUP BY ALL)
SELECT sample_base, arg_max(preparation, (strong, hits, o)) AS preparation, arg_max(strong, (strong, hits, o)) AS strong, arg_max(hits, (strong, hits, o)) AS hits FROM t GROUP BY 1""")
def e14(spark, d):
    return P.best_treatment(C.targeted_scan(C.process(curves(spark, d)), keep=("sample_base", "preparation")))


@query("e20_curve_summary", f"""
WITH {PEAKS} SELECT curve_id, count(*) AS n_peaks, round(max(relative_intensity), 4) AS strongest, round(min(d), 5) AS d_min, round(max(d), 5) AS d_max,
  concat_ws(',', CASE WHEN count(*) < 13 THEN 'few_peaks' END, CASE WHEN max(d) < 18 THEN 'no_low_angle_peak' END) AS qc_flags FROM pk GROUP BY 1""")
def e20(spark, d):
    g = peaks(spark, d).groupBy("curve_id").agg(F.count("*").alias("n_peaks"), r(F.max("relative_intensity"), 4).alias("strongest"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    flags = F.concat_ws(",", F.when(c("n_peaks") < 13, "few_peaks"), F.when(c("hi") < 18, "no_low_angle_peak"))
    return g.select("curve_id", "n_peaks", "strongest", r(c("lo"), 5).alias("d_min"), r(c("hi"), 5).alias("d_max"), flags.alias("qc_flags"))


@query("e21_review_queue", f"""
WITH {CANDS}, s AS (SELECT curve_id, max(score) AS best, count(DISTINCT mineral) AS n, count(DISTINCT treatment) AS t FROM cand GROUP BY 1)
SELECT CASE WHEN n >= 5 AND best < 0.9 THEN 'sem consenso' WHEN best >= 0.9 AND t >= 2 THEN 'alta' WHEN best >= 0.5 THEN 'media' ELSE 'baixa' END AS queue, count(*) AS curves, min(curve_id) AS first_curve FROM s GROUP BY 1""")
def e21(spark, d):
    s = candidates(spark, d).groupBy("curve_id").agg(F.max("score").alias("best"), F.size(F.collect_set("mineral")).alias("n"), F.size(F.collect_set("treatment")).alias("t"))
    q = (F.when((c("n") >= 5) & (c("best") < 0.9), "sem consenso").when((c("best") >= 0.9) & (c("t") >= 2), "alta").when(c("best") >= 0.5, "media").otherwise("baixa"))
    return s.groupBy(q.alias("queue")).agg(F.count("*").alias("curves"), F.min("curve_id").alias("first_curve"))


@query("e22_vocabulary_reconciliation", r"""
WITH f AS (SELECT page_id, nullif(regexp_extract(html, '(?is)<html[^>]*\blang="([a-z]+)"', 1), '') AS lang, nullif(regexp_extract(html, '(?is)<title>([^<]*)</title>', 1), '') AS title FROM pages),
j AS (SELECT f.*, q.quality FROM f LEFT JOIN labels q ON q.doc_id = page_id)
SELECT CASE WHEN quality = 1 THEN 'seed' WHEN title IS NOT NULL THEN 'parsed' ELSE 'pending' END AS confirmed_by, coalesce(lang, 'none') AS grp, count(*) AS terms, count(title) AS with_title FROM j GROUP BY ALL""")
def e22(spark, d):
    get = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    f = table(spark, d, "pages").select("page_id", get(r'(?is)<html[^>]*\blang="([a-z]+)"').alias("lang"), get("(?is)<title>([^<]*)</title>").alias("title"))
    j = f.join(table(spark, d, "labels").select(c("doc_id").alias("page_id"), "quality"), "page_id", "left")
    by = F.when(c("quality") == 1, "seed").when(c("title").isNotNull(), "parsed").otherwise("pending")
    return j.groupBy(by.alias("confirmed_by"), F.coalesce("lang", F.lit("none")).alias("grp")).agg(F.count("*").alias("terms"), F.count("title").alias("with_title"))


@query("e23_selection_summary", """
SELECT sample_base, n, n_prep, sha256(sample_base || '|' || n || '|' || lo || '|' || hi) AS selection_hash FROM (SELECT vec_id // 3 AS sample_base, count(*) AS n, count(DISTINCT vec_id % 3) AS n_prep, min(vec_id) AS lo, max(vec_id) AS hi FROM embeddings GROUP BY 1)""")
def e23(spark, d):
    g = curves(spark, d).groupBy("sample_base").agg(F.count("*").alias("n"), F.size(F.collect_set("preparation")).alias("n_prep"), F.min("curve_id").alias("lo"), F.max("curve_id").alias("hi"))
    return g.select("sample_base", "n", "n_prep", stable_hash("sample_base", "n", "lo", "hi").alias("selection_hash"))


@query("e24_report_peaks", f"""
WITH {PEAKS}, rk AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY relative_intensity DESC, two_theta) AS k FROM pk), w(range_id, lo, hi) AS (VALUES {NAMED_VALUES}),
n AS (SELECT curve_id, k, arg_min(range_id, (abs(d - (lo + hi) / 2), range_id)) AS candidate, min(abs(d - (lo + hi) / 2)) AS delta FROM rk CROSS JOIN w GROUP BY ALL)
SELECT curve_id, k AS rank, round(d, 5) AS d, CASE WHEN relative_intensity >= 60 THEN 'strong' WHEN relative_intensity >= 25 THEN 'medium' ELSE 'weak' END AS remark, candidate, round(delta, 5) AS delta FROM rk JOIN n USING (curve_id, k)""")
def e24(spark, d):
    p = P.rank_within(peaks(spark, d), ["curve_id"], [F.desc("relative_intensity"), c("two_theta")]).withColumn("n", nearest_window(c("d")))
    return p.select("curve_id", "rank", r(c("d"), 5).alias("d"), F.when(c("relative_intensity") >= 60, "strong").when(c("relative_intensity") >= 25, "medium").otherwise("weak").alias("remark"),
                    c("n.range_id").alias("candidate"), r(c("n.delta"), 5).alias("delta"))


@query("e25_rows_by_record", f"""
WITH {GEO}, p AS (SELECT record_id, mineral, count(*) AS n FROM geo GROUP BY ALL) SELECT record_id, CAST(sum(n) AS BIGINT) AS rowspan, string_agg(mineral || ':' || n, ',' ORDER BY mineral || ':' || n) AS minerals FROM p GROUP BY 1""")
def e25(spark, d):
    return P.group_rows_by_record(geo_rows(spark, d)).withColumn("minerals", F.array_join("minerals", ","))


@query("e26_report_peak_tables", f"""
WITH {PEAKS}, k AS (SELECT *, row_number() OVER (PARTITION BY sample_base, preparation ORDER BY intensity DESC, two_theta) AS rk FROM pk)
SELECT sample_base, preparation, row_number() OVER (PARTITION BY sample_base, preparation ORDER BY two_theta) AS position, round(two_theta, 5) AS two_theta, round(d, 5) AS d FROM k""")
def e26(spark, d):
    t = P.rank_within(peaks(spark, d), ["sample_base", "preparation"], [c("two_theta")], None, "position")
    return t.select("sample_base", "preparation", "position", r(c("two_theta"), 5).alias("two_theta"), r(c("d"), 5).alias("d"))


@query("f1_top_match_per_record", f"""
WITH {CANDS}, b AS (SELECT mineral AS record_id, max(score) AS score, min(curve_id) FILTER (score = m) AS item_id FROM (SELECT *, max(score) OVER (PARTITION BY mineral) AS m FROM cand) GROUP BY 1)
SELECT * FROM b ORDER BY score DESC, record_id LIMIT 5""")
def f1(spark, d):
    m = candidates(spark, d).select(c("mineral").alias("record_id"), c("curve_id").alias("item_id"), "score")
    return P.top_match_per_record(m)


@query("f2_top_peaks_per_curve", f"WITH {PEAKS} SELECT curve_id, peak_index AS rank, round(two_theta, 5) AS two_theta, round(relative_intensity, 4) AS relative_intensity FROM pk")
def f2(spark, d):
    p = P.rank_within(peaks(spark, d), ["curve_id"], [F.desc("relative_intensity"), c("two_theta")])
    return p.select("curve_id", "rank", r(c("two_theta"), 5).alias("two_theta"), r(c("relative_intensity"), 4).alias("relative_intensity"))


@query("f3_mineral_first", f"""
WITH {CANDS}, g AS (SELECT curve_id AS item_id, max((score, mineral))[2] AS best_mineral, max(score) AS best_score, max(score) FILTER (lower(mineral) = 'brand#7') AS target_score FROM cand GROUP BY 1)
SELECT *, lower(best_mineral) = 'brand#7' AS target_first FROM g WHERE target_score IS NOT NULL""")
def f3(spark, d):
    return P.mineral_first(candidates(spark, d).select(c("curve_id").alias("item_id"), "mineral", "score"), "Brand#7")


@query("f4_rank_candidates", f"""
WITH {CANDS}, m AS (SELECT curve_id, mineral, max(score) AS score FROM cand GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY score DESC, mineral) AS rank FROM m) SELECT * FROM k""")
def f4(spark, d):
    m = candidates(spark, d).groupBy("curve_id", "mineral").agg(F.max("score").alias("score"))
    return P.rank_within(m, ["curve_id"], [F.desc("score"), c("mineral")])


@query("f5_page_with_total", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 80 OFFSET 160")
def f5(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return P.page(o, [F.desc("o_totalprice"), c("o_orderkey")], 80, 160)


@query("f6_explain_bins", """
WITH b AS (SELECT event_type, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS bin, sum(value) AS importance FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY round(importance, 6) DESC, bin) AS rank FROM b)
SELECT event_type, user_id, bin, round(importance, 6) AS importance, rank FROM k""")
def f6(spark, d):
    b = table(spark, d, "events").groupBy("event_type", "user_id", F.get_json_object("props", "$.k").cast("int").alias("bin")).agg(r(F.sum("value")).alias("importance"))
    return P.rank_within(b, ["event_type", "user_id"], [F.desc("importance"), c("bin")])


@query("f7_nearest_d060", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1.46e0 + l_discount, 6) AS d, l_quantity AS i, least(abs(1.46e0 + l_discount - 1.50e0), abs(1.46e0 + l_discount - 1.52e0), abs(1.46e0 + l_discount - 1.54e0)) AS dist FROM lineitem WHERE round(1.46e0 + l_discount, 6) BETWEEN 1.485 AND 1.555)
SELECT l_orderkey, arg_min(d, (round(dist, 6), -i, d)) AS d060, arg_min(i, (round(dist, 6), -i, d)) AS intensity FROM p GROUP BY 1""")
def f7(spark, d):
    dv = c("l_discount") + 1.46
    p = table(spark, d, "lineitem").select("l_orderkey", F.round(dv, 6).alias("d"), c("l_quantity").alias("i"), F.round(d060_distance(dv), 6).alias("dist")).where(c("d").between(*D060_WINDOW))
    return p.groupBy("l_orderkey").agg(F.min_by(F.struct("d", "i"), F.struct("dist", -c("i"), "d")).alias("b")).select("l_orderkey", c("b.d").alias("d060"), c("b.i").alias("intensity"))


def snapshot(spark, d):
    return candidates(spark, d).withColumn("haystack", F.concat_ws(" ", "label", "mineral", "group")).withColumn("sample", c("curve_id")).withColumn(
        "status", F.when(c("part_id") % 9 == 0, "erro").otherwise("ok"))


@query("g1_snapshot_filters", f"""
WITH {CANDS} SELECT curve_id, line_no, part_id, mineral, score FROM cand WHERE contains(lower(label || ' ' || mineral || ' ' || grp), 'red') AND treatment = 'natural' AND contains(lower(mineral), 'brand#1') AND contains(CAST(curve_id AS VARCHAR), '7') AND part_id % 9 <> 0""")
def g1(spark, d):
    return snapshot(spark, d).where(P.snapshot_filter(q="RED", preparation="Natural", mineral="brand#1", sample="7")).select("curve_id", "line_no", "part_id", "mineral", "score")


@query("g2_package_filters", f"WITH {CANDS} SELECT curve_id, line_no, part_id, label FROM cand WHERE contains(lower(label || ' ' || mineral || ' ' || grp), 'widget') AND treatment = 'glicolado'")
def g2(spark, d):
    return snapshot(spark, d).where(P.snapshot_filter(q="widget", preparation="glicolado", status="all")).select("curve_id", "line_no", "part_id", "label")


@query("g3_numeric_range_filters", "SELECT vec_id AS record_id FROM embeddings WHERE embedding[1] >= 0 AND embedding[1]::DOUBLE * 100 <= 12 AND embedding[2] >= 0 AND embedding[2]::DOUBLE * 100 >= 2")
def g3(spark, d):
    from xrdlake.plans.views import oxide_vectors

    return oxide_vectors(spark, d).where(P.in_range(c("SiO2"), None, 12) & P.in_range(c("Al2O3"), 2, None) & P.in_range(c("MgO"))).select("record_id")


@query("g4_aggregate_panel_filters", f"WITH {GEO} SELECT record_id, row_no, mineral, rock, SiO2 AS sio2 FROM geo WHERE era = 'F' AND grp = 'LARGE' AND SiO2 BETWEEN 10 AND 30 AND Al2O3 >= 0.03 AND contains(lower(mineral), '#2')")
def g4(spark, d):
    g = geo_rows(spark, d).where((c("era") == "F") & (c("group") == "LARGE") & P.in_range(c("SiO2"), 10, 30) & P.in_range(c("Al2O3"), 0.03) & F.lower("mineral").contains("#2"))
    return g.select("record_id", "row_no", "mineral", "rock", c("SiO2").alias("sio2"))


@query("g5_sanitise_filters", "SELECT DISTINCT 'mineral' AS facet, p_brand AS value FROM part WHERE p_brand IN (SELECT 'Brand#' || s_nationkey FROM supplier)")
def g5(spark, d):
    wanted = table(spark, d, "supplier").select(F.lit("mineral").alias("facet"), F.concat(F.lit("Brand#"), c("s_nationkey").cast("string")).alias("value")).distinct()
    known = P.facets(table(spark, d, "part").select(c("p_brand").alias("mineral")), ["mineral"])
    return P.keep_known(wanted, known)


@query("g7_reference_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'red') AND p_type = 'LARGE' ORDER BY p_partkey LIMIT 25")
def g7(spark, d):
    p = table(spark, d, "part").where(F.lower(F.concat_ws(" ", "p_name", "p_brand")).contains("red") & (c("p_type") == "LARGE"))
    return p.orderBy("p_partkey").limit(25).select("p_partkey", "p_name")


@query("g8_flatten_records", """
SELECT o_orderkey AS record_id, coalesce(p_brand, 'Não informado') AS mineral, l_quantity IS NOT NULL AS has_sample FROM orders LEFT JOIN (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey) ON l_orderkey = o_orderkey""")
def g8(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), c("l_partkey") == c("p_partkey")).select("l_orderkey", c("p_brand").alias("m"))
    nested = li.groupBy("l_orderkey").agg(F.collect_list("m").alias("minerals"))
    o = table(spark, d, "orders").join(nested, c("o_orderkey") == c("l_orderkey"), "left").select(c("o_orderkey").alias("record_id"), F.explode_outer("minerals").alias("m"))
    return o.select("record_id", F.coalesce("m", F.lit("Não informado")).alias("mineral"), c("m").isNotNull().alias("has_sample"))


@query("g10_composition_present", "SELECT vec_id AS record_id, (embedding[1] >= 0)::INT + (embedding[2] >= 0)::INT + (embedding[3] >= 0)::INT AS n FROM embeddings WHERE (embedding[1] >= 0)::INT + (embedding[2] >= 0)::INT + (embedding[3] >= 0)::INT >= 1")
def g10(spark, d):
    from xrdlake.plans.views import oxide_vectors

    o = oxide_vectors(spark, d)
    n = sum((F.when(c(k).isNotNull(), 1).otherwise(0) for k in ("SiO2", "Al2O3", "Fe2O3")), F.lit(0))
    return o.select("record_id", n.alias("n")).where("n >= 1")


@query("g11_reference_curve_choice", r"""
WITH x AS (SELECT doc_id, lang AS mineral, CASE WHEN doc_id % 5 = 0 THEN 'zz' ELSE sha256(text) END AS checksum, quality FROM documents JOIN labels USING (doc_id)),
e AS (SELECT *, row_number() OVER (PARTITION BY mineral ORDER BY quality DESC, doc_id) AS k FROM x WHERE regexp_matches(checksum, '^[0-9a-f]{64}$') AND quality IS NOT NULL) SELECT doc_id, mineral, k AS rank FROM e""")
def g11(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", c("lang").alias("mineral"), F.when(c("doc_id") % 5 == 0, "zz").otherwise(F.sha2("text", 256)).alias("checksum"), "quality")
    ok = x.where(c("checksum").rlike("^[0-9a-f]{64}$") & c("quality").isNotNull())
    return P.rank_within(ok, ["mineral"], [F.desc("quality"), c("doc_id")]).select("doc_id", "mineral", "rank")


def _diag_values():
    from xrdlake.plans.match import NAMED_VALUES
    return NAMED_VALUES


@query("g12_diagnostic_peaks", f"WITH {PEAKS}, w(range_id, lo, hi) AS (VALUES {_diag_values()}) SELECT curve_id, peak_index, round(d, 5) AS d FROM pk WHERE EXISTS (SELECT 1 FROM w WHERE d BETWEEN lo AND hi)")
def g12(spark, d):
    from xrdlake.plans.match import named_windows

    p = peaks(spark, d)
    return p.where(F.exists(named_windows(), lambda w: (c("d") >= w["d_min"]) & (c("d") <= w["d_max"]))).select("curve_id", "peak_index", r(c("d"), 5).alias("d"))


@query("s1_union_of_matches", "SELECT o_custkey AS id, 'exact' AS kind FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, 'similar' FROM customer WHERE c_acctbal > 0")
def s1(spark, d):
    return X.union_all(table(spark, d, "orders").where("o_orderstatus = 'F'").select(c("o_custkey").alias("id"), F.lit("exact").alias("kind")),
                       table(spark, d, "customer").where("c_acctbal > 0").select(c("c_custkey").alias("id"), F.lit("similar").alias("kind")))


@query("s2_intersection", "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def s2(spark, d):
    o = table(spark, d, "orders")
    return X.ids_in_all(o.where("o_orderstatus = 'F'").select(c("o_custkey").alias("id")), o.where("o_orderstatus = 'O'").select(c("o_custkey").alias("id")),
                        table(spark, d, "customer").where("c_acctbal > 0").select(c("c_custkey").alias("id")))


@query("s3_missing_members", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def s3(spark, d):
    return X.missing_members(table(spark, d, "orders").where("o_orderstatus = 'P'").select(c("o_custkey").alias("id")), table(spark, d, "customer").select(c("c_custkey").alias("id")), ["id"])


@query("s4_ordered_dedup", """
WITH k AS (SELECT conv_id, turn, trim(text) AS v, nullif(trim(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g')), '') AS k FROM conversations)
SELECT conv_id, min(turn) AS pos, md5(arg_min(v, turn)) AS v FROM k WHERE k IS NOT NULL GROUP BY conv_id, k""")
def s4(spark, d):
    return X.ordered_dedup(table(spark, d, "conversations"), "conv_id", "text", "turn").select("conv_id", "pos", F.md5("v").alias("v"))
