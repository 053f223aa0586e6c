"""Geochemical graph over embeddings (oxides) and parts (descriptions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from xrdlake.functions.geochem import OXIDES
from xrdlake.operators import geochem as X
from xrdlake.plans.match import r
from xrdlake.plans.registry import query
from xrdlake.plans.views import oxide_vectors, table
from xrdlake.session import written

c = F.col
THRESHOLD = 0.76


def records(spark, d):
    """Records with standardised oxides, minerals, context and uses."""
    o = X.scaled_vectors(oxide_vectors(spark, d))
    p = table(spark, d, "part")
    words = F.split("p_name", " ")
    p = p.select(
        c("p_partkey").alias("record_id"), words.alias("minerals"), F.array("p_type").alias("groups"), F.array("p_brand").alias("subjects"),
        F.array("p_brand").alias("uses"), c("p_name").alias("environment"), c("p_type").alias("rock"), c("p_brand").alias("formation"), c("p_name").alias("result_text"),
        (c("p_size") % 4).cast("string").alias("era"), F.when(c("p_size") % 3 > 0, (c("p_size") % 3).cast("string")).alias("period"), F.lit(None).cast("string").alias("epoch"),
        c("p_type").alias("class"), (c("p_size") / 10).alias("si_al"), c("p_size").cast("double").alias("clay_fraction"))
    return o.join(p, "record_id")


_RAW = "rw AS (SELECT vec_id AS id, label, " + ", ".join(f"CASE WHEN embedding[{i + 1}] >= 0 THEN embedding[{i + 1}]::DOUBLE * 100 END AS x{i}" for i in range(13)) + " FROM embeddings)"
_N = " + ".join(f"(x{i} IS NOT NULL)::INT" for i in range(13))
VEC = _RAW + f""",
ok AS (SELECT *, {_N} AS n FROM rw), ln AS (SELECT id, n, i, v FROM (SELECT id, n, unnest([{', '.join(f'coalesce(x{i}, 0)' for i in range(13))}]) AS v, unnest(range(13)) AS i FROM ok)),
st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM ln WHERE n >= 3 GROUP BY 1),
sc AS (SELECT id, i, (v - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS z FROM ln JOIN st USING (i) WHERE n >= 3),
vc AS (SELECT id, list(z ORDER BY i) AS vector FROM sc GROUP BY 1)
"""


@query("i1_scaled_vectors", f"WITH {VEC} SELECT id AS record_id, i AS oxide, round(z, 6) AS z FROM sc")
def i1(spark, d):
    v = X.scaled_vectors(oxide_vectors(spark, d)).where("vector IS NOT NULL")
    return v.select("record_id", F.posexplode("vector").alias("oxide", "z")).select("record_id", c("oxide").cast("long").alias("oxide"), r(c("z")).alias("z"))


_SIM = "CASE WHEN list_dot_product(a.vector, a.vector) > 0 AND list_dot_product(b.vector, b.vector) > 0 THEN least(greatest((list_dot_product(a.vector, b.vector) / sqrt(list_dot_product(a.vector, a.vector) * list_dot_product(b.vector, b.vector)) + 1) / 2, 0), 1) ELSE 0 END"


@query("i2_pair_similarity", f"""
WITH {VEC}, k AS (SELECT vec_id AS id, vec_id // 3 AS base FROM embeddings), p AS (SELECT a.id AS source, b.id AS target, a.vector AS va, b.vector AS vb, {_SIM} AS cs FROM vc a JOIN k ka ON ka.id = a.id JOIN k kb ON kb.base = ka.base AND ka.id < kb.id JOIN vc b ON b.id = kb.id)
SELECT source, target, round(cs, 4) AS cosine, round(1 / (1 + sqrt(list_dot_product(va, va) - 2 * list_dot_product(va, vb) + list_dot_product(vb, vb))), 4) AS euclidean FROM p""")
def i2(spark, d):
    from xrdlake.operators.keys import blocked_pairs

    v = X.scaled_vectors(oxide_vectors(spark, d)).where("vector IS NOT NULL").select("record_id", "vector", F.floor(c("record_id") / 3).alias("base"))
    p = blocked_pairs(v, "record_id", "base")
    p = X.pair_similarity(p, "euclidean").withColumnRenamed("similarity", "euclidean")
    return X.pair_similarity(p).select(c("record_id_a").alias("source"), c("record_id_b").alias("target"), c("similarity").alias("cosine"), "euclidean")


_TK = lambda x: f"list_filter(list_distinct(string_split(lower(regexp_replace({x}, '[^A-Za-z0-9]+', ' ', 'g')), ' ')), lambda w: len(w) >= 3)"
_KEY = lambda x: f"trim(lower(regexp_replace({x}, '[^A-Za-z0-9]+', ' ', 'g')))"
_J = lambda a, b: f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0e0 ELSE round(len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE), 4) END)"
_NS = lambda a, b, s: f"round(1 - least(abs({a} - {b}) / {s}, 1), 4)"
REC = VEC + f""",
rc AS (SELECT id, vector, list_distinct(list_transform(string_split(p_name, ' '), lambda w: lower(w))) AS mn, [{_KEY('p_type')}] AS gr, [{_KEY('p_brand')}] AS sb, {_TK('p_name')} AS en, {_TK('p_type')} AS rk, {_TK('p_brand')} AS fo,
   CAST(p_size % 4 AS VARCHAR) AS era, CASE WHEN p_size % 3 > 0 THEN CAST(p_size % 3 AS VARCHAR) END AS per, p_type AS class, p_size / 10e0 AS sial, CAST(p_size AS DOUBLE) AS cf
   FROM rw LEFT JOIN vc USING (id) JOIN part ON p_partkey = id),
pr AS (SELECT a.id AS source, b.id AS target, a.vector IS NOT NULL AND b.vector IS NOT NULL AS hg,
   round(0.6e0 * CASE WHEN a.vector IS NOT NULL AND b.vector IS NOT NULL THEN round({_SIM}, 4) ELSE 0 END + 0.2e0 * {_NS('a.sial', 'b.sial', 'greatest(abs(a.sial), abs(b.sial), 1e0)')} + 0.15e0 * {_NS('a.cf', 'b.cf', '100e0')} + 0.05e0 * (a.class = b.class)::INT + 1e-9, 4) AS sg,
   round(0.5e0 * {_J('a.mn', 'b.mn')} + 0.35e0 * {_J('a.gr', 'b.gr')} + 0.15e0 * {_J('a.sb', 'b.sb')} + 1e-9, 4) AS sm,
   round(0.3e0 * {_J('a.en', 'b.en')} + 0.2e0 * {_J('a.rk', 'b.rk')} + 0.25e0 * {_J('a.fo', 'b.fo')} + 0.25e0 * round(0.45e0 * (a.era = b.era)::INT + 0.35e0 * coalesce(a.per = b.per, false)::INT, 4) + 1e-9, 4) AS sx,
   round(0.65e0 * {_J('a.sb', 'b.sb')} + 0.35e0 * {_J('a.en', 'b.en')} + 1e-9, 4) AS su
   FROM rc a JOIN rc b ON a.id < b.id),
an AS (SELECT *, round(0.45e0 * sg + 0.3e0 * sm + 0.15e0 * sx + 0.1e0 * su + 1e-9, 4) AS score_total, CASE WHEN hg THEN 4 ELSE 3 END AS supported,
   1 - least(greatest(CASE WHEN hg THEN sg ELSE sm END, sm, sx, su) - least(CASE WHEN hg THEN sg ELSE sm END, sm, sx, su), 1) AS cv FROM pr),
a2 AS (SELECT *, round(0.5e0 * score_total + 0.25e0 * supported / 4e0 + 0.25e0 * cv + 1e-9, 4) AS confidence FROM an),
eg AS (SELECT * FROM a2 WHERE score_total >= {THRESHOLD})
"""


def scored_pairs(spark, d):
    # read three times below, so it is written once
    p = written(X.prepare(records(spark, d)), "records")
    return X.analogy(X.dimension_scores(X.with_records(X.candidate_pairs(p, THRESHOLD), slim(p))))


def edges(spark, d):
    return X.threshold_edges(scored_pairs(spark, d), THRESHOLD)


@query("i3_dimension_scores", f"WITH {REC} SELECT source, target, sg AS s_geo, sm AS s_mineral, sx AS s_context, su AS s_use, hg AS has_geo FROM eg")
def i3(spark, d):
    return edges(spark, d).select("source", "target", "s_geo", "s_mineral", "s_context", "s_use", "has_geo")


@query("i4_analogy", f"""
WITH {REC} SELECT source, target, score_total, supported, round(cv + 1e-9, 4) AS convergence, confidence, CASE WHEN (sg >= 0.55)::INT + (sm >= 0.55)::INT + (sx >= 0.55)::INT + (su >= 0.55)::INT >= 2 THEN 'analogia_composta'
   WHEN sg = greatest(sg, sm, sx, su) THEN 'geoquimica_analoga' WHEN sm = greatest(sg, sm, sx, su) THEN 'grupo_mineralogico_compativel' WHEN sx = greatest(sg, sm, sx, su) THEN 'contexto_geologico_semelhante' ELSE 'assinatura_funcional_semelhante' END AS relation_type,
  CASE WHEN confidence >= 0.75 THEN 'alta' WHEN confidence >= 0.5 THEN 'media' ELSE 'baixa' END AS confidence_class, CASE WHEN score_total >= 0.72 AND confidence >= 0.72 AND supported >= 3 THEN 'confirmada' WHEN score_total >= 0.5 AND confidence >= 0.5 THEN 'provavel' ELSE 'exploratoria' END AS analogy_class,
  CASE WHEN sg >= 0.65 AND (sm < 0.35 OR sx < 0.35) THEN 'chemistry_without_mineral_or_context' ELSE '' END AS differences FROM eg""")
def i4(spark, d):
    return edges(spark, d).select("source", "target", "score_total", "supported", "convergence", "confidence", "relation_type", "confidence_class", "analogy_class", F.array_join("differences", ",").alias("differences"))


_KNN = f"""
WITH {REC}, bo AS (SELECT source AS node, target AS other, score_total FROM eg UNION ALL SELECT target, source, score_total FROM eg), tk AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score_total DESC, other) AS k FROM bo)
"""


@query("i5_nearest_edges", _KNN + "SELECT DISTINCT least(node, other) AS source, greatest(node, other) AS target, score_total FROM tk WHERE k <= 2")
def i5(spark, d):
    return X.nearest_edges(edges(spark, d), 2)


def slim(prepared):
    """What scores need of prepared records."""
    return prepared.drop(*OXIDES, "minerals", "groups", "subjects", "uses", "environment", "rock", "formation", "result_text", "label", "n_oxides")


@query("i5_nearest_partners", f"""
WITH {REC}, bo AS (SELECT source AS node, target AS other, score_total FROM a2 UNION ALL SELECT target, source, score_total FROM a2), tk AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score_total DESC, other) AS k FROM bo)
SELECT DISTINCT least(node, other) AS source, greatest(node, other) AS target, score_total FROM tk WHERE k <= 3""")
def i5b(spark, d):
    return X.nearest_partners(slim(written(X.prepare(records(spark, d)), "records")), 3)


def links(spark, d):
    """A sparse graph over customers: consecutive orders of a priority group point to their customers."""
    o = table(spark, d, "orders").select((c("o_custkey") * 2).alias("source"), (F.floor(c("o_orderkey") / 40) * 2 + 1).cast("long").alias("target"), "o_orderstatus", "o_totalprice")
    return o.select("source", "target")


_CC = """
WITH RECURSIVE e0 AS (SELECT DISTINCT o_custkey * 2 AS u, (o_orderkey // 40) * 2 + 1 AS v FROM orders), e AS (SELECT u, v FROM e0 UNION SELECT v, u FROM e0),
l(node, component) USING KEY (node) AS (SELECT u, min(v) AS c FROM (SELECT u, v FROM e UNION ALL SELECT u, u FROM e) GROUP BY u
  UNION SELECT e.v, min(l.component) FROM l JOIN e ON e.u = l.node JOIN recurring.l AS r ON r.node = e.v WHERE l.component < r.component GROUP BY e.v),
cc AS (SELECT node, component FROM l)
"""


@query("i6_connected_components", _CC + "SELECT node, component FROM cc")
def i6(spark, d):
    e = links(spark, d)
    nodes = e.select(c("source").alias("node")).union(e.select(c("target").alias("node"))).distinct()
    return X.components(nodes, e)


@query("i6_cluster_summary", _CC + """, m AS (SELECT component, c_mktsegment AS class FROM cc LEFT JOIN customer ON c_custkey * 2 = node), p AS (SELECT component, class, count(*) AS n FROM m GROUP BY ALL)
SELECT component, CAST(sum(n) AS BIGINT) AS size, arg_max(class, (n, class)) FILTER (class IS NOT NULL) AS label_class FROM p GROUP BY 1""")
def i6b(spark, d):
    seg = table(spark, d, "customer").select((c("c_custkey") * 2).alias("node"), c("c_mktsegment").alias("class"))
    return X.cluster_summary(i6(spark, d).join(seg, "node", "left"))


@query("i7_node_degrees", f"""
WITH {REC}, dg AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM eg UNION ALL SELECT target FROM eg) GROUP BY 1)
SELECT id AS node, coalesce(degree, 0) AS degree, round(CASE WHEN id % 2 = 0 THEN greatest(18e0, least(42e0, 18 + sqrt(cf) * 0.8e0)) ELSE greatest(18e0, least(36e0, 18e0 + 4 * coalesce(degree, 0))) END, 2) AS size FROM rc LEFT JOIN dg ON node = id""")
def i7(spark, d):
    n = records(spark, d).select(c("record_id").alias("node"), F.when(c("record_id") % 2 == 0, c("clay_fraction")).alias("clay_fraction"))
    return X.node_degrees(n, edges(spark, d)).select("node", "degree", "size")


@query("i8_network_meta", f"""
WITH {REC} SELECT (SELECT count(*) FROM rc) AS nodes, count(*) AS edges, round(avg(score_total), 6) AS mean_score, count(*) FILTER (confidence >= 0.75) AS high_confidence FROM eg""")
def i8(spark, d):
    n = records(spark, d).agg(F.count("*").alias("n"))
    e = edges(spark, d).agg(F.count("*").alias("edges"), r(F.avg("score_total")).alias("mean_score"), F.count_if(c("confidence_class") == "alta").alias("high_confidence"))
    return e.select(n.scalar().alias("nodes"), "edges", "mean_score", "high_confidence")


@query("g6_edge_filters", f"""
WITH {REC} SELECT source, target, score_total FROM eg WHERE (sg >= 0.55)::INT + (sm >= 0.55)::INT + (sx >= 0.55)::INT + (su >= 0.55)::INT >= 2 AND confidence >= 0.75""")
def g6(spark, d):
    return edges(spark, d).where(X.edge_filter(relation="analogia_composta", confidence="alta")).select("source", "target", "score_total")


@query("e11_relation_counts", f"""
WITH {REC} SELECT CASE WHEN (sg >= 0.55)::INT + (sm >= 0.55)::INT + (sx >= 0.55)::INT + (su >= 0.55)::INT >= 2 THEN 'analogia_composta' ELSE 'single' END AS relation, count(*) AS edges FROM eg GROUP BY 1""")
def e11b(spark, d):
    return edges(spark, d).groupBy(F.when(c("relation_type") == "analogia_composta", c("relation_type")).otherwise("single").alias("relation")).agg(F.count("*").alias("edges"))


@query("g9_record_projection", f"""
WITH {VEC}, p AS (SELECT id, p_name, p_type, p_brand, n FROM ok JOIN part ON p_partkey = id) SELECT id AS record_id, n AS n_oxides, n >= 3 AS has_geo, lower(p_type) AS group_key, len({_TK('p_name')}) AS n_tokens FROM p""")
def g9(spark, d):
    p = X.prepare(records(spark, d))
    return p.select("record_id", "n_oxides", c("vector").isNotNull().alias("has_geo"), F.get("t_groups", 0).alias("group_key"), F.size("t_environment").cast("long").alias("n_tokens"))
