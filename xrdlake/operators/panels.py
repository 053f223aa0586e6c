"""Panels: grouped summaries, rankings, filters over candidates, samples and records.

Aggregates are built from mergeable functions, so partial results are formed
before every shuffle. Where a label may hold a large share of the rows, the
rows are first reduced per (label, record) and then per label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from xrdlake.functions.minerals import mineral_class
from xrdlake.functions.text import lookup_key
from xrdlake.functions.values import stable_hash
from xrdlake.operators.hot import TASK_ROWS, dealt
from xrdlake.operators.quantiles import percentiles
from xrdlake.session import written

NOT_INFORMED = "Não informado"
TRIO = ("natural", "glicolado", "calcinado")
ALL_PREPARATIONS = (*TRIO, "indeterminado")


def best_by_preparation(items: DataFrame, base: str = "sample_base", item: str = "item_id", prep: str = "preparation") -> DataFrame:
    """First item per treatment of a sample, duplicates and completeness."""
    aggs = []
    for p in ALL_PREPARATIONS:
        aggs += [F.min(F.when(F.col(prep) == p, F.col(item))).alias(p), F.count_if(F.col(prep) == p).alias(f"n_{p}")]
    g = items.groupBy(base).agg(F.count("*").alias("n_items"), *aggs)
    has = lambda p: F.col(f"n_{p}") > 0
    dup = sum((F.when(F.col(f"n_{p}") > 1, F.col(f"n_{p}") - 1).otherwise(0) for p in ALL_PREPARATIONS), F.lit(0))
    return g.withColumn("complete_trio", has("natural") & has("glicolado") & has("calcinado")).withColumn("duplicates", dup)


def comparison_suggestions(items: DataFrame, minerals: DataFrame) -> DataFrame:
    """Sets of curves worth comparing, one row per member: group, type, priority, item.

    ``items``: item_id, sample_base, preparation. ``minerals``: item_id, mineral.
    Sets of a common treatment or mineral may hold a large share of all curves, so
    they are given as membership rows; nothing is gathered.
    """
    g = best_by_preparation(items)
    has = lambda p: F.col(p).isNotNull()
    n, gl, ca, un = (has(p) for p in ALL_PREPARATIONS)
    pick = lambda *ps: F.array_compact(F.array(*[F.col(p) for p in ps]))
    pair = (F.when(n & gl & ca, F.struct(F.lit("trio").alias("t"), F.lit(1).alias("p"), pick(*TRIO).alias("i")))
            .when(n & gl, F.struct(F.lit("ng").alias("t"), F.lit(2).alias("p"), pick("natural", "glicolado").alias("i")))
            .when(n & ca, F.struct(F.lit("nc").alias("t"), F.lit(3).alias("p"), pick("natural", "calcinado").alias("i")))
            .when(gl & ca, F.struct(F.lit("gc").alias("t"), F.lit(4).alias("p"), pick("glicolado", "calcinado").alias("i"))))
    unknown = F.when(un & (n | gl | ca), F.struct(F.lit("indeterminado").alias("t"), F.lit(5).alias("p"), pick("indeterminado", *TRIO).alias("i")))
    per_sample = g.select(F.col("sample_base").cast("string").alias("group"), F.explode(F.array_compact(F.array(pair, unknown))).alias("s")).select(
        "group", F.col("s.t").alias("type"), F.col("s.p").alias("priority"), F.col("s.i").alias("items"))

    def members(df: DataFrame, key: str, kind: str, priority: int) -> DataFrame:
        return df.select(F.col(key).cast("string").alias("group"), F.lit(kind).alias("type"), F.lit(priority).alias("priority"), F.col("item_id").alias("item"))
    replicas = members(items.join(g.where("n_items >= 3").select("sample_base"), "sample_base", "left_semi"), "sample_base", "replicatas", 8)
    big = items.groupBy("preparation").agg(F.count("*").alias("n")).where("n >= 3").select("preparation")
    same_prep = members(items.join(big, "preparation", "left_semi"), "preparation", "preparo", 7)
    m = minerals.join(items, "item_id").select("mineral", "item_id", "sample_base").distinct()
    wide = m.groupBy("mineral").agg(F.min("sample_base").alias("a"), F.max("sample_base").alias("b")).where("a < b").select("mineral")
    same_mineral = members(m.join(wide, "mineral", "left_semi").select("mineral", "item_id").distinct(), "mineral", "mineral", 6)
    pairs = per_sample.where(F.size("items") >= 2).select("group", "type", "priority", F.explode("items").alias("item"))
    return pairs.unionByName(replicas).unionByName(same_prep).unionByName(same_mineral)


def mineral_panel(candidates: DataFrame) -> DataFrame:
    """Per mineral: rows, best score with its group, best confidence by rank, samples, treatments."""
    key = F.lower("mineral")
    order = F.when(F.col("confidence") == "media", "média").otherwise(F.col("confidence"))
    rank = F.struct(F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in CONFIDENCE_RANK.items() for v in kv]), order), F.lit(0)).alias("r"), order.alias("label"))
    part = dealt(candidates, "curve_id").groupBy(key.alias("key"), "curve_id").agg(
        F.count("*").alias("n"), F.max("score").alias("best"), F.max_by("group", F.struct("score", "group")).alias("grp"),
        *[F.max((F.col("treatment") == t).cast("int")).alias(f"t_{t}") for t in ALL_PREPARATIONS], F.min("mineral").alias("mineral"),
        F.max(rank).alias("sure"))
    seen = F.array_sort(F.array_compact(F.array(*[F.when(F.max(f"t_{t}") == 1, F.lit(t)) for t in ALL_PREPARATIONS])))
    return part.groupBy("key").agg(
        F.min("mineral").alias("mineral"), F.sum("n").alias("count"), F.max("best").alias("best_score"),
        F.max_by("grp", F.struct("best", "grp")).alias("best_group"), F.count("*").alias("samples"),
        seen.alias("treatments"), F.max("sure").alias("sure")).withColumn("best_confidence", F.col("sure.label")).drop("sure")


def support_peaks(members: DataFrame, peaks: DataFrame) -> DataFrame:
    """Membership rows ``key, curve_id, peak_index``: the peaks that support a mineral, each once.

    ``members``: mineral, curve_id and the support window d_min, d_max (nulls: any). Rows, not lists, so a common mineral is no large value.
    """
    hit = F.coalesce(F.col("d") >= F.col("d_min"), F.lit(True)) & F.coalesce(F.col("d") <= F.col("d_max"), F.lit(True))
    rows = members.select(F.lower("mineral").alias("key"), "curve_id", "d_min", "d_max").join(peaks.select("curve_id", "peak_index", "d"), "curve_id")
    return rows.where(hit).groupBy("key", "curve_id", "peak_index").agg(F.min("d").alias("d"))


# Rank of a confidence label.
CONFIDENCE_RANK = {"alta": 3, "media": 2, "média": 2, "baixa": 1}


def mineral_assembly(candidates: DataFrame) -> DataFrame:
    """Per mineral slug: class, best score, best confidence rank, treatments."""
    rank = F.create_map(*[F.lit(v) for kv in CONFIDENCE_RANK.items() for v in kv])
    c = candidates.withColumn("slug", lookup_key("mineral")).withColumn("rank", F.coalesce(F.try_element_at(rank, F.col("confidence")), F.lit(0)))
    a = c.groupBy("slug").agg(F.min("mineral").alias("mineral"), F.min("group").alias("group"), F.max("score").alias("best_score"),
                              F.max("rank").alias("best_rank"), F.count_if(F.col("treatment") == "natural").alias("n_nat"),
                              F.count_if(F.col("treatment") == "glicolado").alias("n_gly"))
    a = a.withColumn("class_label", mineral_class("mineral", "group"))
    bucket = (F.when(F.col("class_label").contains("Argilomineral"), "Argilominerais").when(F.col("class_label").contains("Carbonato"), "Carbonatos")
              .when(F.col("class_label").rlike("Feldspato|Silicato"), "Feldspatos/silicatos não argilosos").otherwise("Outros"))
    return a.withColumn("bucket", bucket)


def assembly_confidence(assembly: DataFrame) -> DataFrame:
    """Overall confidence of an assembly from its mean rank and treatments."""
    g = assembly.agg(F.avg("best_rank").alias("mean_rank"), F.count("*").alias("minerals"), F.sum("n_nat").alias("n_nat"), F.sum("n_gly").alias("n_gly"))
    ngc = (F.col("n_nat") > 0) & (F.col("n_gly") > 0)
    label = F.when((F.col("mean_rank") >= 2.4) & ngc, "alta").when(F.col("mean_rank") >= 1.4, "média").otherwise("baixa")
    return g.select("minerals", "mean_rank", label.alias("confidence"))


def aggregate_dimensions(rows: DataFrame, dimensions: list[str], values: list[str], record: str = "record_id") -> DataFrame:
    """Rows, distinct records and mean values per label of every dimension at once."""
    rows = dealt(rows.select(record, *dimensions, *values), record, task_rows=TASK_ROWS // len(dimensions))
    long = rows.select(record, *values, F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit(NOT_INFORMED)).alias("label")) for d in dimensions])).alias("d"))
    part = long.groupBy("d.dimension", "d.label", record).agg(
        F.count("*").alias("n"), *[F.sum(v).alias(f"s_{v}") for v in values], *[F.count(v).alias(f"c_{v}") for v in values])
    return part.groupBy("dimension", "label").agg(
        F.sum("n").alias("count_rows"), F.count("*").alias("count_records"),
        *[F.try_divide(F.sum(f"s_{v}"), F.sum(f"c_{v}")).alias(f"mean_{v}") for v in values])


def value_statistics(rows: DataFrame, values: list[str], name: str = "oxide") -> DataFrame:
    """Count, mean, minimum and maximum of each column, one row per column."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(v).alias("k"), F.col(v).cast("double").alias("v")) for v in values])).alias("x")).where("x.v IS NOT NULL")
    return long.groupBy(F.col("x.k").alias(name)).agg(F.count("*").alias("count"), F.avg("x.v").alias("mean"), F.min("x.v").alias("min"), F.max("x.v").alias("max"))


# What bounds an empirical window.
WINDOW_STRATEGIES = {"p05_p95": ("p05", "p95"), "min_max": ("min", "max")}


def empirical_windows(validated: DataFrame, min_samples: int = 5, strategy: str = "p05_p95") -> DataFrame:
    """Windows learnt from accepted patterns, with their strategy, confidence and provenance.

    The strategy is the one asked for, whatever the number of samples; few samples show in ``confidence``.
    ``ignored`` counts the rows of a key that were not accepted or have no spacing. Spacings are first counted per value:
    measured spacings repeat, and exact percentiles then work on weighted values. The provenance hash covers every
    accepted (source, spacing) row through a sum of row digests, so that it needs no gathered list. Percentiles of keys with many
    different spacings are found by histograms (``quantiles``).
    """
    keys = ["mineral_id", "peak_id", "preparation"]
    good = F.coalesce((F.col("validation_status") == "accepted") & F.col("d_spacing").isNotNull(), F.lit(False))
    ignored = validated.groupBy(*keys).agg(F.count_if(~good).alias("ignored"))
    ok = validated.where(good)
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("source_record_id").cast("string"), F.format_string("%.4f", "d_spacing")).cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")
    rows = ok.groupBy(*keys).agg(F.sum(digest).cast("string").alias("rows_digest"), F.avg("d_spacing").alias("mean"), F.stddev_pop("d_spacing").alias("std"))
    counted = written(ok.groupBy(*keys, "d_spacing").agg(F.count("*").alias("w")), "spacings")
    g = counted.groupBy(*keys).agg(F.sum("w").alias("n"), F.min("d_spacing").alias("min"), F.max("d_spacing").alias("max"))
    g = g.join(percentiles(counted, keys, "d_spacing", "w", {"p05": 0.05, "p95": 0.95}), keys)
    low, high = WINDOW_STRATEGIES[strategy]
    g = g.join(rows, keys).join(ignored, keys).withColumn("strategy", F.lit(strategy)).withColumn("d_min", F.col(low)).withColumn("d_max", F.col(high))
    g = g.withColumn("confidence", F.when(F.col("n") < min_samples, "low").otherwise("reference_empirical"))
    return g.withColumn("provenance_hash", stable_hash(*keys, "n", "rows_digest"))


def vocabulary_coverage(terms: DataFrame, records: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """Terms per family with each kind of record, with a match, in need of review."""
    per = records.groupBy("term_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("curation_status") != "accepted").alias("n_review"),
        *[F.count_if(cond).alias(f"k_{k}") for k, cond in kinds.items()])
    j = terms.join(per, "term_id", "left")
    return j.groupBy(F.coalesce("family", F.lit("unknown")).alias("family")).agg(
        F.count("*").alias("total_terms"), F.count("n").alias("with_match"), F.count_if(F.col("n").isNull()).alias("without_match"),
        F.count_if(F.col("n_review") > 0).alias("needs_review"), *[F.count_if(F.col(f"k_{k}") > 0).alias(f"with_{k}") for k in kinds])


def panel_metrics(items: DataFrame) -> DataFrame:
    """Counts of a panel per treatment: rows, status, candidates, peaks, score bands."""
    s = F.col("best_score")
    return items.groupBy("treatment").agg(
        F.count("*").alias("rows"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("errors"),
        F.count_if(F.col("n_candidates") > 0).alias("with_candidates"), F.count_if(F.col("n_peaks") > 0).alias("with_peaks"),
        F.count_if(s < 0.25).alias("score_0_25"), F.count_if((s >= 0.25) & (s < 0.5)).alias("score_25_50"),
        F.count_if((s >= 0.5) & (s < 0.75)).alias("score_50_75"), F.count_if(s >= 0.75).alias("score_75_100"))


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct non-blank values per column with their counts."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), F.trim(F.col(k).cast("string")).alias("value")) for k in columns])).alias("x"))
    return long.where("x.value IS NOT NULL AND x.value <> ''").groupBy("x.facet", "x.value").agg(F.count("*").alias("rows"))


def collapse_points(points: DataFrame, lists: list[str], kinds: dict[str, Column]) -> DataFrame:
    """Map points merged by record and coordinate (6 decimals)."""
    return points.groupBy("record_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")).agg(
        F.count("*").alias("points"), *[F.count_if(cond).alias(f"n_{k}") for k, cond in kinds.items()],
        *[F.array_sort(F.collect_set(x)).alias(x) for x in lists])


def best_treatment(targeted: DataFrame) -> DataFrame:
    """Treatment of each sample with the most strong, then any, basal hits."""
    basal = F.col("mineral").isin("Clorita", "Esmectita", "Ilita", "Caulinita")
    t = targeted.groupBy("sample_base", "preparation").agg(
        F.count_if(basal & (F.col("quality") == "strong")).alias("strong"),
        F.count_if(basal & F.col("quality").isin("strong", "weak", "shoulder")).alias("hits"))
    order = F.create_map(*[F.lit(v) for k, p in enumerate(ALL_PREPARATIONS) for v in (p, -k)])
    return t.groupBy("sample_base").agg(F.max_by(F.struct("preparation", "strong", "hits"), F.struct(
        "strong", "hits", F.try_element_at(order, F.col("preparation")))).alias("b")).select("sample_base", "b.*")


def rank_within(df: DataFrame, by: list[str], order: list[Column], limit: int | None = None, name: str = "rank") -> DataFrame:
    """Position inside each group; with a limit only the first ones (limit pushed below the shuffle)."""
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return out if limit is None else out.where(F.col(name) <= limit)


def top_match_per_record(matches: DataFrame, limit: int = 5) -> DataFrame:
    """Best match of each record, then the best records."""
    best = matches.groupBy("record_id").agg(F.max_by(F.struct("item_id", "score"), F.struct("score", -F.col("item_id"))).alias("b"))
    return best.select("record_id", "b.*").orderBy(F.desc("score"), "record_id").limit(limit)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page and the total number of rows (counted by an aggregate, not a window over all rows)."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).select("*", total.scalar().alias("total"))


def mineral_first(items: DataFrame, target: str) -> DataFrame:
    """Items ranked so that those whose best candidate is the target come first."""
    key = F.lower(F.lit(target))
    g = items.groupBy("item_id").agg(
        F.max_by("mineral", F.struct("score", "mineral")).alias("best_mineral"), F.max("score").alias("best_score"),
        F.max(F.when(F.lower("mineral") == key, F.col("score"))).alias("target_score"))
    return g.where("target_score IS NOT NULL").withColumn("target_first", F.lower("best_mineral") == key)


def snapshot_filter(q=None, preparation=None, sample=None, mineral=None, group=None, status=None) -> Column:
    """Conjunction of the filters that are set, over haystack, treatment, sample, mineral, group and status."""
    cond = F.lit(True)
    if q:
        cond = cond & F.lower("haystack").contains(q.lower())
    if preparation:
        cond = cond & (F.lower("treatment") == preparation.lower())
    if sample:
        cond = cond & F.lower(F.col("sample").cast("string")).contains(sample.lower())
    if mineral:
        cond = cond & F.lower("mineral").contains(mineral.lower())
    if group:
        cond = cond & F.lower("group").contains(group.lower())
    if status not in ("all", "todos", "tudo", "*"):
        cond = cond & (F.col("status") == (status or "ok"))
    return cond


def in_range(value: Column, low=None, high=None) -> Column:
    """Inside the bounds that are given; a null passes only when there are none."""
    if low is None and high is None:
        return F.lit(True)
    ok = value.isNotNull()
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return F.coalesce(ok, F.lit(False))


def keep_known(wanted: DataFrame, facet_values: DataFrame) -> DataFrame:
    """Requested filter values that occur among the facets."""
    return wanted.join(facet_values.select("facet", "value").distinct(), ["facet", "value"], "left_semi")


def group_rows_by_record(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Per record: row span and its distinct minerals."""
    part = dealt(rows.select("record_id", "mineral"), "record_id").groupBy("record_id", "mineral").agg(F.count("*").alias("n"))
    return part.groupBy("record_id").agg(F.sum("n").alias("rowspan"), F.array_sort(F.collect_list(F.concat_ws(":", "mineral", F.col("n").cast("string")))).alias("minerals"))
