"""Curation and traceability checks over samples, analyses, minerals and publications.

Each rule is a filter, a grouped count or an anti join that yields one row per
violation; the checks are united by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xrdlake.functions.text import blank_to_null, is_doi, is_iso_date, is_url, is_year, lookup_key
from xrdlake.operators.sets import union_all

# Wording that marks a sample code made up for a text, and direct methods.
SYNTHETIC_PATTERN = r"codigo sintetico|synthetic (sample )?code|sem amostra explicita"
DIRECT_SOURCES = ("xrd", "xrf", "sem_eds", "petrography", "manual_curation")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def analysis_status(text, method) -> Column:
    """Status and evidence level of an analysis that declares none."""
    synthetic = F.coalesce(lookup_key(text).rlike(SYNTHETIC_PATTERN), F.lit(False))
    pdf = F.coalesce(lookup_key(method).isin("extracao pdf", "pdf extraction"), F.lit(False))
    return F.struct(
        F.when(synthetic, "inferred").when(pdf, "extracted").otherwise("pending_curation").alias("status"),
        F.when(synthetic | pdf, "pdf_extraction").otherwise("human_curated_interpretation").alias("assertion"),
        F.when(synthetic, "weak").when(pdf, "indirect").otherwise("weak").alias("evidence_level"))


def composition_status(*texts) -> Column:
    """Table-derived compositions are extracted, the others wait for curation."""
    t = F.coalesce(lookup_key(F.concat_ws(" ", *[_c(x) for x in texts])), F.lit(""))
    return F.when(t.rlike("oxide rows first value|tabela|table|oxidos|oxides"), "extracted").otherwise("pending_curation")


def mineral_status(source_type, external_source, relation) -> Column:
    """Provenance status of a mineral, strongest evidence first."""
    st, ext, rel = F.lower(F.coalesce(_c(source_type), F.lit(""))), F.coalesce(lookup_key(external_source), F.lit("")), F.coalesce(_c(relation), F.lit(""))
    return (F.when((rel == "confirmed_in_sample") | st.isin(*DIRECT_SOURCES), "confirmed")
            .when((ext != "") | (st == "external"), "enriched")
            .when((st == "local_vocabulary") | (rel == "vocabulary_expansion"), "pending_curation")
            .when((rel == "mentioned_in_document") | (st == "pdf_text"), "extracted").otherwise("inferred"))


def default_relation(status) -> Column:
    s = _c(status)
    return F.when(s == "confirmed", "confirmed_in_sample").when(s == "enriched", "external_reference_only").otherwise("candidate_in_sample")


def evidence_id(*parts) -> Column:
    """Deterministic id: folded parts joined by hyphens, readable to 79 characters, with a hash of the whole."""
    whole = F.replace(lookup_key(F.concat_ws("-", *[_c(p) for p in parts])), F.lit(" "), F.lit("-"))
    return F.concat(F.substring(whole, 1, 79), F.lit("-"), F.substring(F.sha2(whole, 256), 1, 16))


def violation(df: DataFrame, record: str, item, rule: str, cond: Column) -> DataFrame:
    """Rows that break a rule, as (record_id, item, rule)."""
    return df.where(cond).select(F.col(record).alias("record_id"), _c(item).cast("string").alias("item"), F.lit(rule).alias("rule"))


def violations(df: DataFrame, record: str, item, rules: dict[str, Column]) -> DataFrame:
    """Rows that break any of several rules of one table, in one scan: (record_id, item, rule) per broken rule."""
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in rules.items()]))
    return df.select(F.col(record).alias("record_id"), _c(item).cast("string").alias("item"), F.explode(broken).alias("rule"))


def required(df: DataFrame, record: str, item, column: str, rule: str) -> DataFrame:
    return violation(df, record, item, rule, blank_to_null(F.col(column).cast("string")).isNull())


def unique_within(df: DataFrame, record: str, column: str, rule: str) -> DataFrame:
    """Ids that occur more than once in a record (one row per id)."""
    g = df.where(F.col(column).isNotNull()).groupBy(record, column).agg(F.count("*").alias("n"))
    return violation(g, record, column, rule, F.col("n") > 1)


def declared(df: DataFrame, record: str, column: str, parents: DataFrame, rule: str, scopes: DataFrame | None = None) -> DataFrame:
    """References that no parent row of the same record declares (``record_id, key``).

    Parents that are declared once for many records are given by scope (``scope, key``), with ``scopes`` (``record_id, scope``) naming the
    scope of each record: lists are looked up, never multiplied out. A record without a scope declares nothing.
    """
    child = df.where(F.col(column).isNotNull()).select(F.col(record).alias("record_id"), F.col(column).alias("key"))
    if scopes is None:
        miss = child.join(parents.select("record_id", "key"), ["record_id", "key"], "left_anti")
    else:
        miss = child.join(scopes.select("record_id", "scope"), "record_id", "left").join(parents.select("scope", "key"), ["scope", "key"], "left_anti")
    return violation(miss, "record_id", "key", rule, F.lit(True))


def external_id_errors(df: DataFrame, record: str, item, source: str = "Mindat") -> DataFrame:
    """Id and address rules of rows (``external_source``, ``external_id``, ``external_uri``) that cite the numbered catalogue ``source``."""
    id_, uri = (blank_to_null(F.col(k).cast("string")) for k in ("external_id", "external_uri"))
    named = F.lower(F.trim("external_source")) == source.lower()
    # fixed value: the address pattern of a numbered entry
    in_uri = F.nullif(F.regexp_extract(uri, r"^https?://(?:www\.)?mindat\.org/min-([0-9]+)\.html$", 1), F.lit(""))
    return violations(df, record, item, {
        "external_id_required": named & id_.isNull(), "external_id_numeric": named & ~id_.rlike("^[0-9]+$"),
        "external_uri_format": named & uri.isNotNull() & in_uri.isNull(), "external_uri_matches": named & (in_uri != id_)})


def needed_references(df: DataFrame, record: str, item, needs: dict[str, Column], present: DataFrame) -> DataFrame:
    """Rows that lack a reference which their record has something for.

    ``needs``: rule -> condition on a row; ``present``: record_id and a boolean column per rule, true where the record has parents of that kind.
    """
    j = df.join(present.select(F.col("record_id").alias(record), *[F.col(k).alias(f"_{k}") for k in needs]), record)
    return violations(j, record, item, {k: cond & F.col(f"_{k}") for k, cond in needs.items()})


def date_errors(df: DataFrame, record: str, item, column: str, rule: str) -> DataFrame:
    return violation(df, record, item, rule, ~is_iso_date(column))


def publication_errors(p: DataFrame, record: str, item) -> DataFrame:
    """Year, DOI, URL and at-least-one-identifier rules of publications."""
    given = lambda k: blank_to_null(k).isNotNull()
    return violations(p, record, item, {
        "year_format": ~is_year("year"), "doi_format": given("doi") & ~is_doi("doi"), "url_format": given("url") & ~is_url("url"), "no_identifier": ~given("doi") & ~given("url")})


def fill_single(df: DataFrame, record: str, column: str) -> DataFrame:
    """Fill a missing value where the record knows exactly one."""
    g = df.groupBy(record).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    j = df.join(g, record)
    return j.withColumn(column, F.coalesce(column, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")))).drop("_lo", "_hi")


def chain_audit(records: DataFrame, analyses: DataFrame, minerals: DataFrame) -> DataFrame:
    """Alerts, weak links and overall status of every record.

    ``analyses``: record_id, text. ``minerals``: record_id, status, relation,
    external_source. ``records``: record_id, composition_status, uses_text.
    """
    a = analyses.groupBy("record_id").agg(F.max(F.coalesce(lookup_key("text").rlike(SYNTHETIC_PATTERN), F.lit(False))).alias("synthetic"))
    direct = F.col("relation") == "confirmed_in_sample"
    m = minerals.groupBy("record_id").agg(
        F.count("*").alias("n_minerals"), F.count_if(direct).alias("n_direct"), F.count_if(F.col("external_source").isNotNull()).alias("n_external"),
        F.count_if((F.col("status") == "confirmed") & ~direct).alias("n_unproven"), F.count_if(~direct).alias("pending_minerals"))
    r = records.join(a, "record_id", "left").join(m, "record_id", "left")
    n = lambda k: F.coalesce(F.col(k), F.lit(0))
    syn = F.coalesce("synthetic", F.lit(False))
    none_direct = (n("n_minerals") > 0) & (n("n_direct") == 0)
    auto_use = F.coalesce(F.col("uses_text").rlike("(?i)automatic|extraid|inferid|PDF"), F.lit(False))
    weak_comp = F.coalesce(F.col("composition_status").isin("inferred", "extracted", "pending_curation"), F.lit(False))
    alerts = F.array_compact(F.array(F.when(syn, "synthetic_sample"), F.when(n("n_external") > 0, "external_enrichment"),
                                     F.when(n("n_unproven") > 0, "confirmed_without_evidence"), F.when(none_direct, "no_direct_evidence")))
    links = F.array_compact(F.array(F.when(syn, "sample_analysis"), F.when(weak_comp, "analysis_composition"), F.when(n("n_external") > 0, "mineral_source"),
                                    F.when(auto_use, "mineral_uses"), F.when(none_direct, "composition_evidence")))
    out = r.select("record_id", alerts.alias("alerts"), links.alias("weak_links"), n("pending_minerals").alias("pending_minerals"), syn.alias("syn"))
    return out.withColumn("overall", F.when(F.col("syn"), "weak").when((F.size("alerts") > 0) | (F.size("weak_links") > 0), "partial").otherwise("complete")).drop("syn")


def mineral_profile(terms: DataFrame, sources: list[tuple[str, DataFrame]], fields: list[str]) -> DataFrame:
    """Fields of each term from the first source that fills them, with the sources used.

    Every source holds ``term_id`` and some of the fields, one row per term.
    """
    j = terms
    for name, s in sources:
        j = j.join(s.select("term_id", *[F.col(f).alias(f"{name}__{f}") for f in fields if f in s.columns], F.lit(True).alias(f"{name}__here")), "term_id", "left")
    have = lambda f: [F.col(f"{n}__{f}") for n, s in sources if f in s.columns]
    used = F.array_compact(F.array(*[F.when(F.col(f"{n}__here"), F.lit(n)) for n, _ in sources]))
    return j.select(*terms.columns, *[F.coalesce(*have(f)).alias(f) for f in fields], used.alias("sources"))
