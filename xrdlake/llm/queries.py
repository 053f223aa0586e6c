"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from xrdlake.llm import boosted, chat_format, decision_list, decontaminate, mixture, pack, periodic, secrets, simhash, suffix_dedup, url_filter, variants, wrappers
from xrdlake.llm.registry import query, table


def tokenizer_path() -> str:
    """The vocabulary file that op7 names; installed with the interpreter on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_suffix_dedup")
def op1(spark, sf_dir):
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 50)
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_chat_format", rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '{chat_format.PROBE}' FROM range(2) AS r(i)),
e AS (
  SELECT *, regexp_replace(role, '(\\|###|: |</turn>)', '\\\1', 'g') AS r2, regexp_replace(text, '(\\|###|: |</turn>)', '\\\1', 'g') AS t2,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || r2 || ': ' || t2 || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system') THEN role = 'user' WHEN before = 'user' THEN role = 'assistant'
    WHEN before = 'assistant' THEN role IN ('user', 'tool') WHEN before = 'tool' THEN role = 'assistant' ELSE false END) AS in_order
FROM e GROUP BY conv_id
""")
def op2(spark, sf_dir):
    turns = chat_format.with_probe(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_conversations(turns))


@query("op3_quality_rules")
def op3(spark, sf_dir):
    out = decision_list.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query("op4_url_filter", r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u FROM pages),
s AS (
  SELECT page_id, translate(regexp_extract(u, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(u, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (
  SELECT *, CASE WHEN '.' || host LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN '.' || host LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN '.' || host LIKE '%.com' AND path LIKE '/%' THEN 'com/'
    WHEN '.' || host LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN '.' || host LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/' END AS rule FROM s)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
""")
def op4(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query("op5_simhash_near_dedup")
def op5(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op6_html_extraction")
def op6(spark, sf_dir):
    return wrappers.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op7_best_fit_packing")
def op7(spark, sf_dir):
    return pack.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op8_secret_scan")
def op8(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(secrets.spelled(F.filter("spans", lambda s: s["kind"] != "literal")), 256).alias("base_sha256"), secrets.spelled("spans").alias("spans"))


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    return boosted.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op10_benchmark_decontamination")
def op10(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "start_word", "matched", "window")


@query("op11_spelling_variants")
def op11(spark, sf_dir):
    return variants.group_variants(table(spark, sf_dir, "documents"), slip_every=199)


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    return periodic.digests(periodic.find_runs(table(spark, sf_dir, "documents"), trial=True))


def _time_sql(share: str, schedule) -> str:
    """The inverted integral of a schedule, as ``mixture.time_of`` states it."""
    out = ""
    for before, t, width, a, b in reversed(mixture.demand(schedule)):
        need = f"(({share} - {before!r}::DOUBLE) / {width!r}::DOUBLE)"
        root = f"sqrt({a * a!r}::DOUBLE + {2 * (b - a)!r}::DOUBLE * {need})"
        out += f"WHEN {share} >= {before!r}::DOUBLE THEN {t!r}::DOUBLE + {width!r}::DOUBLE * (2.0::DOUBLE * {need} / ({a!r}::DOUBLE + {root})) "
    return f"CASE {out}END"


@query("op13_source_mixture", rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, sum(source_size) OVER () AS total FROM s),
b AS (
  SELECT *, coalesce(sum(2 * source_size) OVER o, 0) AS had, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_weight FROM w
  WINDOW o AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT had, left_weight FROM b WHERE weight * (3 * total - 2 * had) <= 4 * source_size * left_weight ORDER BY source_size / weight, rank LIMIT 1),
t AS (
  SELECT w.source, rank, source_size, CASE WHEN weight * (3 * total - 2 * had) > 4 * source_size * left_weight THEN CAST(2 * source_size AS DOUBLE)
    ELSE CAST(3 * total - 2 * had AS DOUBLE) * weight / CAST(2 * left_weight AS DOUBLE) END AS target FROM w CROSS JOIN l),
u AS (
  SELECT doc_id, h, size, rank, source_size, target, row_number() OVER (PARTITION BY rank, h, doc_id) - 1 AS copy,
    CAST(coalesce(sum(size) OVER (PARTITION BY rank ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT u.*, k, greatest(0, least(size, CAST(floor(target) AS BIGINT) - (start + k * source_size))) AS words FROM u, (SELECT unnest([0, 1]) AS k) AS passes),
m AS (
  SELECT *, (CAST(start + k * source_size AS DOUBLE) + CAST(words AS DOUBLE) / 2.0::DOUBLE) / target AS share FROM p WHERE words > 0),
o AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN {_time_sql("share", mixture.SCHEDULES[0])} WHEN 1 THEN {_time_sql("share", mixture.SCHEDULES[1])}
    ELSE {_time_sql("share", mixture.SCHEDULES[2])} END AS position FROM m),
g AS (
  SELECT rank, h, doc_id, copy, CAST(sum(words) AS BIGINT) AS taken, count(*) AS n_passes, min(place) AS first_place
  FROM (SELECT *, row_number() OVER (ORDER BY position, h, doc_id NULLS FIRST, rank, copy, k) - 1 AS place FROM o) GROUP BY ALL)
SELECT u.doc_id, u.size, u.source_size, u.target, coalesce(taken, 0) AS taken, coalesce(n_passes, 0) AS n_passes, first_place
FROM u LEFT JOIN g ON u.rank = g.rank AND u.h = g.h AND u.doc_id IS NOT DISTINCT FROM g.doc_id AND u.copy = g.copy
""")
def op13(spark, sf_dir):
    return mixture.by_document(mixture.stream(mixture.mix(table(spark, sf_dir, "documents"))))
