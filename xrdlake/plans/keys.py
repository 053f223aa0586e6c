"""Key joins over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from xrdlake.functions.text import ascii_key, infer_treatment, lookup_key, tokens
from xrdlake.operators import keys as K, rule_tables as R
from xrdlake.plans.registry import query
from xrdlake.plans.views import table

c = F.col


def _s(col):
    return c(col).cast("string")


@query("d8_alias_priority_join", """
WITH ix AS (SELECT 'order:' || event_id * 3 AS key, event_id FROM events UNION ALL SELECT 'cust:' || user_id, event_id FROM events),
b AS (SELECT key, min(event_id) AS entry FROM ix GROUP BY 1)
SELECT o_orderkey, coalesce(x.entry, y.entry) AS entry, CASE WHEN x.entry IS NOT NULL THEN 'id' WHEN y.entry IS NOT NULL THEN 'customer' END AS matched_by
FROM orders LEFT JOIN b x ON x.key = 'order:' || o_orderkey LEFT JOIN b y ON y.key = 'cust:' || o_custkey""")
def d8(spark, d):
    e = table(spark, d, "events")
    ix = e.select(F.concat(F.lit("order:"), (c("event_id") * 3).cast("string")).alias("key"), c("event_id").alias("entry")).unionByName(
        e.select(F.concat(F.lit("cust:"), _s("user_id")).alias("key"), c("event_id").alias("entry")))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    j = K.alias_join(o, "o_orderkey", {"id": F.concat(F.lit("order:"), _s("o_orderkey")), "customer": F.concat(F.lit("cust:"), _s("o_custkey"))},
                     ix, ["entry"], [c("entry")])
    return j.select("o_orderkey", "entry", "matched_by")


@query("d9_unambiguous_links", """
WITH l AS (SELECT 'part_line' AS kind, l_partkey || '-' || l_linenumber AS key, l_suppkey AS record_id FROM lineitem UNION ALL SELECT 'order', CAST(l_orderkey AS VARCHAR), l_suppkey % 3 FROM lineitem)
SELECT kind, key, min(record_id) AS record_id FROM l GROUP BY ALL HAVING count(DISTINCT record_id) = 1""")
def d9(spark, d):
    li = table(spark, d, "lineitem")
    a = li.select(F.lit("part_line").alias("kind"), F.concat(_s("l_partkey"), F.lit("-"), _s("l_linenumber")).alias("key"), c("l_suppkey").alias("record_id"))
    b = li.select(F.lit("order").alias("kind"), _s("l_orderkey").alias("key"), (c("l_suppkey") % 3).alias("record_id"))
    return K.unique_links(a.unionByName(b))


@query("d10_package_enrichment", """
WITH i AS (SELECT doc_id, sha256(text) AS sha, lang || '-' || doc_id % 97 AS key FROM documents),
p AS (SELECT i.*, CASE WHEN quality = 1 THEN 0 ELSE 1 END AS q FROM i JOIN labels USING (doc_id)),
b AS (SELECT sha, key, arg_min(doc_id, (q, doc_id)) AS id FROM p GROUP BY ALL), s AS (SELECT sha, arg_min(doc_id, (q, doc_id)) AS id FROM p GROUP BY ALL), k AS (SELECT key, arg_min(doc_id, (q, doc_id)) AS id FROM p GROUP BY ALL)
SELECT i.doc_id, coalesce(b.id, s.id, k.id) AS package_id, CASE WHEN b.id IS NOT NULL OR s.id IS NOT NULL THEN 'sha' WHEN k.id IS NOT NULL THEN 'key' END AS matched_by
FROM i LEFT JOIN b ON b.sha = i.sha AND b.key = i.key LEFT JOIN s ON s.sha = i.sha LEFT JOIN k ON k.key = i.key""")
def d10(spark, d):
    i = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.concat("lang", F.lit("-"), (c("doc_id") % 97).cast("string")).alias("key"))
    p = i.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id").select("sha", "key", c("doc_id").alias("package_id"), F.when(c("quality") == 1, 0).otherwise(1).alias("q"))
    return K.sha_then_key(i, p, ["package_id"], [c("q"), c("package_id")]).select("doc_id", "package_id", "matched_by")


@query("d11_path_or_unique_name", """
WITH res AS (SELECT p_partkey AS result_id, CASE WHEN p_partkey % 3 = 0 THEN 'S' || p_partkey END AS path, p_name || p_size AS name FROM part),
np AS (SELECT name, min(result_id) AS id FROM res GROUP BY 1 HAVING count(*) = 1), it AS (SELECT p_partkey AS item, 'S' || p_partkey AS path, p_name || p_size AS name FROM part)
SELECT item, coalesce(r.result_id, np.id) AS result_id, CASE WHEN r.result_id IS NOT NULL THEN 'path' WHEN np.id IS NOT NULL THEN 'name' END AS matched_by
FROM it LEFT JOIN res r ON r.path = it.path LEFT JOIN np ON np.name = it.name""")
def d11(spark, d):
    p = table(spark, d, "part")
    path, name = F.concat(F.lit("S"), _s("p_partkey")), F.concat("p_name", _s("p_size"))
    res = p.select(c("p_partkey").alias("result_id"), F.when(c("p_partkey") % 3 == 0, path).alias("path"), name.alias("name"))
    return K.path_or_unique_name(p.select(c("p_partkey").alias("item"), path.alias("path"), name.alias("name")), res, "result_id").select("item", "result_id", "matched_by")


@query("d12_curated_overrides", """
WITH cand AS (SELECT o_custkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderpriority AS mineral FROM orders),
ov AS (SELECT s_suppkey AS rank, 'cust ' || s_suppkey * 7 AS key, right(s_name, 3) AS pat, CASE s_nationkey % 2 WHEN 0 THEN 'Brand ' || s_nationkey ELSE '5-low' END AS mineral FROM supplier),
hit AS (SELECT c_custkey AS item, rank, mineral FROM customer JOIN ov ON contains(lower(c_name), pat) UNION SELECT c_custkey, rank, mineral FROM customer JOIN ov ON ov.key = 'cust ' || c_custkey),
u AS (SELECT item, 0 AS tier, rank, mineral FROM hit UNION ALL SELECT item, 1, rank, mineral FROM cand),
f AS (SELECT item, trim(regexp_replace(lower(mineral), '[^a-z0-9]+', '-', 'g'), '-') AS slug, min((tier, rank, mineral)) AS m FROM u GROUP BY ALL),
r AS (SELECT item, m, row_number() OVER (PARTITION BY item ORDER BY m) AS position FROM f)
SELECT item, CAST(position AS INTEGER) AS position, m[3] AS mineral, m[1] = 0 AS override FROM r""")
def d12(spark, d):
    from pyspark.sql import Window as W

    o = table(spark, d, "orders")
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    cand = o.select(c("o_custkey").alias("item"), F.row_number().over(w).cast("long").alias("rank"), c("o_orderpriority").alias("mineral"))
    cust = table(spark, d, "customer").select(c("c_custkey").alias("item"), F.lower("c_name").alias("hay"))
    ov = table(spark, d, "supplier").select(
        c("s_suppkey").alias("rank"), (c("s_suppkey") * 7).alias("key"), F.right("s_name", F.lit(3)).alias("pat"),
        F.when(c("s_nationkey") % 2 == 0, F.concat(F.lit("Brand "), _s("s_nationkey"))).otherwise("5-low").alias("mineral"))
    by_text = K.contains_join(cust, "hay", K.first_of_each(ov, "pat"), "pat").select("item", "rank", "mineral")
    by_key = cust.join(K.first_of_each(ov, "key"), c("item") == c("key")).select("item", "rank", "mineral")
    return K.apply_overrides(cand, by_text.unionByName(by_key))


@query("d13_treatment_enrichment", """
WITH t AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'natural' WHEN 'MACHINERY' THEN 'indeterminado' WHEN 'AUTOMOBILE' THEN 'calcinado' END AS tr FROM customer),
o AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'A (G)' WHEN 'O' THEN 'A-N' ELSE 'A77' END AS code FROM orders),
i AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'glicolado' WHEN 'O' THEN 'natural' ELSE 'indeterminado' END AS inf FROM (SELECT o.*, o_orderstatus FROM o JOIN orders USING (o_orderkey)))
SELECT o_orderkey, CASE WHEN tr IS NULL OR (tr = 'indeterminado' AND inf <> 'indeterminado') THEN inf ELSE tr END AS treatment, CASE WHEN tr IS NULL OR (tr = 'indeterminado' AND inf <> 'indeterminado') THEN 'name' ELSE 'snapshot' END AS source
FROM i LEFT JOIN t ON o_custkey = c_custkey""")
def d13(spark, d):
    seg = c("c_mktsegment")
    t = table(spark, d, "customer").select(c("c_custkey").alias("o_custkey"), F.when(seg == "BUILDING", "natural").when(
        seg == "MACHINERY", "indeterminado").when(seg == "AUTOMOBILE", "calcinado").alias("tr"))
    st = c("o_orderstatus")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(st == "F", "A (G)").when(st == "O", "A-N").otherwise("A77").alias("code"))
    o = o.join(t, "o_custkey", "left").withColumn("inf", infer_treatment("code")["treatment"])
    use = c("tr").isNull() | ((c("tr") == "indeterminado") & (c("inf") != "indeterminado"))
    return o.select("o_orderkey", F.when(use, c("inf")).otherwise(c("tr")).alias("treatment"), F.when(use, "name").otherwise("snapshot").alias("source"))


_W = r"string_split(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')), ' ')"


@query("d14_vocabulary_linking", f"""
WITH v AS (SELECT item_id AS term_id, unnest(w) AS key, generate_subscripts(w, 1) AS pos FROM (SELECT item_id, {_W} AS w FROM benchmark)),
fa AS (SELECT key, arg_min(term_id, (pos, term_id)) AS term_id FROM v WHERE len(key) >= 3 GROUP BY 1),
m AS (SELECT conv_id, turn, unnest(list_distinct(list_filter({_W}, lambda x: len(x) >= 3))) AS key FROM conversations)
SELECT conv_id, turn, key, term_id, CASE WHEN term_id % 2 = 0 THEN 'even' WHEN term_id IS NOT NULL THEN 'odd' END AS grp FROM m LEFT JOIN fa USING (key)""")
def d14(spark, d):
    b = table(spark, d, "benchmark")
    al = b.select(c("item_id").alias("term_id"), F.posexplode(F.split(ascii_key("text"), " ")).alias("position", "key")).where(F.length("key") >= 3)
    groups = b.select(c("item_id").alias("term_id"), F.when(c("item_id") % 2 == 0, "even").otherwise("odd").alias("grp"))
    m = table(spark, d, "conversations").select("conv_id", "turn", F.explode(tokens("text")).alias("key"))
    return K.link_terms(m, al, groups).select("conv_id", "turn", "key", "term_id", "grp")


TREE_SQL = """
terms AS (SELECT 'r' || r_regionkey AS term_id, r_name AS label, 'eon' AS level, CAST(NULL AS VARCHAR) AS broader FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'era', 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, 'periodo', 'n' || s_nationkey FROM supplier)
"""


@query("d15_hierarchy", f"""
WITH {TREE_SQL} SELECT l_orderkey AS item, any_value(r_name) AS eon, any_value(n_name) AS era, any_value(s_name) AS periodo, CAST(NULL AS VARCHAR) AS epoca
FROM (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1) JOIN supplier ON s = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def d15(spark, d):
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    k = lambda p, col: F.concat(F.lit(p), _s(col))
    terms = r.select(k("r", "r_regionkey").alias("term_id"), c("r_name").alias("label"), F.lit("eon").alias("level"), F.lit(None).cast("string").alias("broader")).unionByName(
        n.select(k("n", "n_nationkey").alias("term_id"), c("n_name").alias("label"), F.lit("era").alias("level"), k("r", "n_regionkey").alias("broader"))).unionByName(
        s.select(k("s", "s_suppkey").alias("term_id"), c("s_name").alias("label"), F.lit("periodo").alias("level"), k("n", "s_nationkey").alias("broader")))
    items = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("item")).agg(F.min("l_suppkey").alias("s")).select("item", F.concat(F.lit("s"), _s("s")).alias("term_id"))
    return K.resolve_hierarchy(items, terms, ("eon", "era", "periodo", "epoca"))


@query("d18_duplicate_curves", """
WITH i AS (SELECT doc_id, sha256(text) AS sha, lang || n_chars AS stem FROM documents), s AS (SELECT i.* FROM i JOIN labels USING (doc_id)),
a AS (SELECT sha, min(doc_id) AS id FROM s GROUP BY 1), b AS (SELECT stem, min(doc_id) AS id FROM s GROUP BY 1)
SELECT i.doc_id, coalesce(a.id, b.id) AS stored_id, CASE WHEN a.id IS NOT NULL THEN 'sha256' WHEN b.id IS NOT NULL THEN 'name' END AS duplicate_by FROM i LEFT JOIN a USING (sha) LEFT JOIN b USING (stem)""")
def d18(spark, d):
    i = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.concat("lang", _s("n_chars")).alias("stem"))
    st = i.join(table(spark, d, "labels").select("doc_id"), "doc_id").select(c("doc_id").alias("stored_id"), "sha", "stem")
    return K.duplicate_of(i, st).select("doc_id", "stored_id", "duplicate_by")


@query("d19_declared_curves", """
WITH c AS (SELECT l_orderkey AS record_id, l_suppkey % 4 AS sample_code, l_linenumber, l_partkey FROM lineitem), dc AS (SELECT o_orderkey AS record_id, o_custkey % 4 AS sample_code FROM orders WHERE o_orderstatus <> 'P')
SELECT c.* FROM c WHERE EXISTS (SELECT 1 FROM dc WHERE dc.record_id = c.record_id AND dc.sample_code = c.sample_code) OR NOT EXISTS (SELECT 1 FROM dc WHERE dc.record_id = c.record_id)""")
def d19(spark, d):
    cu = table(spark, d, "lineitem").select(c("l_orderkey").alias("record_id"), (c("l_suppkey") % 4).alias("sample_code"), "l_linenumber", "l_partkey")
    dc = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(c("o_orderkey").alias("record_id"), (c("o_custkey") % 4).alias("sample_code"))
    return K.declared_curves(cu, dc)


@query("d20_mineral_semi_join", """
SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND lower(p_name) LIKE 'red%')""")
def d20(spark, d):
    p = table(spark, d, "part").where(lookup_key("p_name").startswith("red")).select("p_partkey")
    hits = table(spark, d, "lineitem").join(p, c("l_partkey") == c("p_partkey"), "left_semi").select("l_orderkey")
    return table(spark, d, "orders").join(hits, c("o_orderkey") == c("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("d21_blocked_pairs", """
SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey AS block, round(1 - abs(a.s_acctbal - b.s_acctbal) / 1000, 4) AS similarity FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 1000""")
def d21(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    p = K.near_pairs(s, "s_suppkey", "s_nationkey", "s_acctbal", 1000.0)
    return p.select("a", "b", c("s_nationkey").alias("block"), F.round(1 - F.abs(c("value_a") - c("value_b")) / 1000, 4).alias("similarity"))


@query("d25_record_alias", """
WITH al AS (SELECT c_custkey AS record_id, c_custkey + c_nationkey AS pid FROM customer), mf AS (SELECT DISTINCT o_custkey AS pid FROM orders WHERE o_orderstatus = 'F'),
ok AS (SELECT record_id, min(pid) AS pid FROM al JOIN mf USING (pid) GROUP BY 1)
SELECT o_orderkey, o_custkey AS record_id, coalesce(pid, o_custkey) AS resolved_id FROM orders LEFT JOIN ok ON record_id = o_custkey""")
def d25(spark, d):
    al = table(spark, d, "customer").select(c("c_custkey").alias("record_id"), (c("c_custkey") + c("c_nationkey")).alias("package_id"))
    o = table(spark, d, "orders")
    mf = o.where("o_orderstatus = 'F'").select(c("o_custkey").alias("record_id"))
    return K.resolve_alias(o.select("o_orderkey", c("o_custkey").alias("record_id")), al, mf)


@query("d26_title_by_priority", """
WITH a AS (SELECT doc_id AS record_id, CASE WHEN quality = 1 THEN 'Untitled ' || doc_id WHEN toxic = 1 THEN 'Label ' || doc_id END AS title FROM labels), b AS (SELECT page_id AS record_id, nullif(regexp_extract(html, '(?is)<title>([^<]*)</title>', 1), '') AS title FROM pages),
z AS (SELECT doc_id AS record_id, CASE WHEN doc_id % 2 = 0 THEN 'Registro ' || doc_id ELSE source || ' ' || lang END AS title FROM documents),
j AS (SELECT d.doc_id AS record_id, CASE WHEN regexp_matches(a.title, '(?i)^(untitled|record|registro)\\b') THEN NULL ELSE a.title END AS ta, CASE WHEN regexp_matches(b.title, '(?i)^(untitled|record|registro)\\b') THEN NULL ELSE b.title END AS tb,
  CASE WHEN regexp_matches(z.title, '(?i)^(untitled|record|registro)\\b') THEN NULL ELSE z.title END AS tz FROM documents d LEFT JOIN a ON a.record_id = d.doc_id LEFT JOIN b ON b.record_id = d.doc_id LEFT JOIN z ON z.record_id = d.doc_id)
SELECT record_id, coalesce(ta, tb, tz) AS title, CASE WHEN ta IS NOT NULL THEN 'label' WHEN tb IS NOT NULL THEN 'page' WHEN tz IS NOT NULL THEN 'document' END AS title_source FROM j""".replace("\\\\", "\\"))
def d26(spark, d):
    k = c("doc_id")
    a = table(spark, d, "labels").select(k.alias("record_id"), F.when(c("quality") == 1, F.concat(F.lit("Untitled "), _s("doc_id"))).when(
        c("toxic") == 1, F.concat(F.lit("Label "), _s("doc_id"))).alias("title"))
    b = table(spark, d, "pages").select(c("page_id").alias("record_id"), F.nullif(F.regexp_extract("html", "(?is)<title>([^<]*)</title>", 1), F.lit("")).alias("title"))
    docs = table(spark, d, "documents")
    z = docs.select(k.alias("record_id"), F.when(k % 2 == 0, F.concat(F.lit("Registro "), _s("doc_id"))).otherwise(F.concat_ws(" ", "source", "lang")).alias("title"))
    return K.first_title(docs.select(k.alias("record_id")), [("label", a), ("page", b), ("document", z)])


@query("d27_prediction_row_match", """
WITH p AS (SELECT event_id, lower(event_type) || ' ' || user_id AS term FROM events), b AS (SELECT term, max(event_id) AS prediction FROM p GROUP BY 1),
o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'error ' WHEN 'O' THEN 'click ' ELSE 'none ' END || o_custkey AS t FROM orders),
m AS (SELECT t, max(prediction) AS prediction FROM (SELECT DISTINCT t FROM o) JOIN b ON t = term OR (length(t) >= 8 AND length(term) >= 8 AND (contains(t, term) OR contains(term, t))) GROUP BY 1)
SELECT o_orderkey, prediction FROM o LEFT JOIN m USING (t)""")
def d27(spark, d):
    p = table(spark, d, "events").select(lookup_key(F.concat_ws("_", "event_type", "user_id")).alias("key"), c("event_id").alias("prediction"))
    st = c("o_orderstatus")
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.when(st == "F", "Error/").when(st == "O", "CLICK-").otherwise("none "), _s("o_custkey")).alias("t"))
    o = o.select("o_orderkey", lookup_key("t").alias("term"))
    best = p.groupBy(c("key").alias("term")).agg(F.max("prediction").alias("prediction"))
    hit = K.matching_terms(o, best).join(best.withColumnRenamed("term", "right_term"), "right_term").groupBy(c("left_term").alias("term")).agg(F.max("prediction").alias("prediction"))
    return o.join(hit, "term", "left").select("o_orderkey", "prediction")


@query("d28_fetch_by_priority", """
WITH u AS (SELECT doc_id AS id, 0 AS o, 'labels' AS store, CAST(quality AS VARCHAR) AS v FROM labels UNION ALL SELECT page_id, 1, 'pages', url FROM pages UNION ALL SELECT doc_id, 2, 'documents', lang FROM documents),
b AS (SELECT id, arg_min((store, v), (o, v)) AS x FROM u GROUP BY 1) SELECT vec_id AS id, x[1] AS store, x[2] AS v FROM embeddings LEFT JOIN b ON id = vec_id""")
def d28(spark, d):
    st = [("labels", table(spark, d, "labels").select(c("doc_id").alias("id"), _s("quality").alias("v"))),
          ("pages", table(spark, d, "pages").select(c("page_id").alias("id"), c("url").alias("v"))),
          ("documents", table(spark, d, "documents").select(c("doc_id").alias("id"), c("lang").alias("v")))]
    return K.fetch_by_priority(table(spark, d, "embeddings").select(c("vec_id").alias("id")), st, ["v"])


def _rule_values():
    return ", ".join(f"('{rid}', {lo}e0, {hi}e0)" for rid, (lo, hi) in R.NAMED_RANGES.items())


@query("d29_attach_rules", f"""
WITH rw(rule_id, d_min, d_max) AS (VALUES {_rule_values()}),
cd AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN 'illite_10a' WHEN 2 THEN 'kaolinite_7a' WHEN 3 THEN 'quartz_101' ELSE 'none' END AS rule_id FROM lineitem)
SELECT cd.*, d_min, d_max FROM cd LEFT JOIN rw USING (rule_id)""")
def d29(spark, d):
    n = c("l_linenumber")
    cd = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(n == 1, "illite_10a").when(n == 2, "kaolinite_7a").when(n == 3, "quartz_101").otherwise("none").alias("rule_id"))
    rules = R.literal_table(spark, [(k, lo, hi) for k, (lo, hi) in R.NAMED_RANGES.items()], ("rule_id", "d_min", "d_max"))
    return K.attach_rules(cd, rules)


@query("d30_attach_group_result", """
SELECT vec_id AS curve_id, CASE WHEN g.s IS NOT NULL THEN 'trio:' || g.s END AS group_status, CASE WHEN g.s IS NOT NULL THEN 'secondary' ELSE 'primary' END AS score_role
FROM embeddings LEFT JOIN (SELECT doc_id AS b, quality AS s FROM labels) g ON g.b = vec_id // 3""")
def d30(spark, d):
    g = table(spark, d, "labels").select(c("doc_id").alias("sample_base"), F.concat(F.lit("trio:"), _s("quality")).alias("group_status"))
    e = table(spark, d, "embeddings").select(c("vec_id").alias("curve_id"), F.floor(c("vec_id") / 3).alias("sample_base"))
    return K.attach_group_result(e, g).select("curve_id", "group_status", "score_role")
