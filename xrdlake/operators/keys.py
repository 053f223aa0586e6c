"""Key joins: aliases, priorities, unique links, overrides, hierarchies.

The side that is looked up is reduced to one row per key before it is joined
(a partial aggregate runs before its shuffle), so a key that many entries share
cannot multiply rows, and a hot key on the probing side is split by adaptive
execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from xrdlake.functions.text import url_slug
from xrdlake.session import written


def best_per_key(entries: DataFrame, keys: list[str], payload: list[str], order: list[Column]) -> DataFrame:
    """One entry per key: the first in ``order``."""
    e = entries.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    g = e.groupBy(*keys).agg(F.min_by(F.struct(*payload), F.struct(*order)).alias("_p"))
    return g.select(*keys, "_p.*")


def alias_join(items: DataFrame, item_id: str, keys: dict[str, Column], index: DataFrame, payload: list[str], order: list[Column]) -> DataFrame:
    """First hit over several keys of an item, in the order they are listed.

    ``index`` holds ``key`` and the payload columns; each key keeps its first
    entry. The answer names the kind of key that hit.
    """
    lookup = best_per_key(index, ["key"], payload, order)
    asked = items.select(item_id, F.posexplode_outer(F.array(*[
        F.struct(F.lit(kind).alias("kind"), k.alias("key")) for kind, k in keys.items()])).alias("priority", "k"))
    asked = asked.select(item_id, "priority", "k.kind", "k.key").where("key IS NOT NULL")
    hit = asked.join(lookup, "key").groupBy(item_id).agg(
        F.min_by(F.struct(F.col("kind").alias("matched_by"), *payload), "priority").alias("_h"))
    return items.join(hit.select(item_id, "_h.*"), item_id, "left")


def unique_links(links: DataFrame, kind: str = "kind", key: str = "key", record: str = "record_id") -> DataFrame:
    """Keys that point to exactly one record; the others are dropped."""
    g = links.where(F.col(key).isNotNull()).groupBy(kind, key).agg(F.min(record).alias(record), F.max(record).alias("_max"))
    return g.where(F.col(record) == F.col("_max")).drop("_max")


def sha_then_key(items: DataFrame, packages: DataFrame, payload: list[str], order: list[Column]) -> DataFrame:
    """Attach the best package: same hash and key, else same hash, else same key."""
    both = best_per_key(packages, ["sha", "key"], payload, order)
    sha = best_per_key(packages, ["sha"], payload, order)
    key = best_per_key(packages, ["key"], payload, order)
    ren = lambda df, p: df.select(*[c for c in ("sha", "key") if c in df.columns], F.struct(*payload).alias(p))
    j = items.join(ren(both, "_b"), ["sha", "key"], "left").join(ren(sha, "_s"), "sha", "left").join(ren(key, "_k"), "key", "left")
    how = F.when(F.col("_b").isNotNull() | F.col("_s").isNotNull(), "sha").when(F.col("_k").isNotNull(), "key")
    return j.withColumn("matched_by", how).withColumn("_p", F.coalesce("_b", "_s", "_k")).select(
        *items.columns, "matched_by", *[F.col(f"_p.{c}").alias(c) for c in payload])


def path_or_unique_name(items: DataFrame, results: DataFrame, payload: str) -> DataFrame:
    """Result of the same path, else of the same name when only one result bears it."""
    by_path = results.where("path IS NOT NULL").groupBy("path").agg(F.min(payload).alias("_p"))
    by_name = results.where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("_n"), F.min(payload).alias("_q"))
    by_name = by_name.where("_n = 1").drop("_n")
    j = items.join(by_path, "path", "left").join(by_name, "name", "left")
    return j.withColumn("matched_by", F.when(F.col("_p").isNotNull(), "path").when(F.col("_q").isNotNull(), "name")).withColumn(
        payload, F.coalesce("_p", "_q")).drop("_p", "_q")


def contains_join(items: DataFrame, text: str, patterns: DataFrame, pattern: str, gram: int = 3, least: int = 1) -> DataFrame:
    """Items whose text contains a pattern, as an equi join on the rarest piece of the pattern.

    Pieces have ``gram`` characters (a shorter pattern is its own piece). It is counted how many items hold each piece of a
    pattern; the one that fewest hold is the key of the pattern, and a pattern with a piece that none holds is left out at once. So
    beginnings that many patterns or texts share are no hot keys. Survivors are verified: the result is that of the plain ``contains``
    join. Where no pattern has fewer than ``least`` characters, shorter pieces need not be made.
    """
    t = F.col(text)
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(least), F.lit(gram)), lambda n: F.filter(
        F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(t, i, n)), lambda g: F.length(g) == n))))
    exploded = F.explode(F.when(F.length(t) > 0, grams))
    keys = rarest_pieces(items.select(exploded.alias("_g")), patterns, pattern, gram)
    asked = written(patterns.join(keys, pattern), "patterns")  # its size is known then, so few patterns are sent to the items
    return items.withColumn("_g", exploded).join(asked, "_g").where(F.col(text).contains(F.col(pattern))).drop("_g")


def rarest_pieces(pieces: DataFrame, patterns: DataFrame, pattern: str, gram: int) -> DataFrame:
    """``pattern, _g``: of each pattern's pieces the one that ``pieces`` (``_g``) holds least often; patterns with a piece that is not there have none."""
    p = F.col(pattern)
    own = F.when(F.length(p) <= gram, F.array(p)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - gram + 1), lambda i: F.substring(p, i, gram))))
    held = patterns.where(F.length(p) > 0).select(p).distinct().withColumn("_g", F.explode(own))
    counts = pieces.join(held.select("_g").distinct(), "_g", "left_semi").groupBy("_g").agg(F.count("*").alias("_n"))
    rarest = held.join(counts, "_g", "left").groupBy(pattern).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("_k"))
    return rarest.where("_k.n > 0").select(pattern, "_k._g")


# Terms shorter than this must be equal to match.
CONTAINED_LENGTH = 8


def matching_terms(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of terms (``left_term, right_term``) that are equal, or long and one inside the other. Both frames: term."""
    # each is read several times below: terms are worked out once
    a, b = (written(side.select(F.col("term").alias(name)).distinct(), "terms") for side, name in ((left, "left_term"), (right, "right_term")))
    same = a.join(b, F.col("left_term") == F.col("right_term"))
    long_a, long_b = a.where(F.length("left_term") >= CONTAINED_LENGTH), b.where(F.length("right_term") >= CONTAINED_LENGTH)
    inside = contains_join(long_a, "left_term", long_b, "right_term", CONTAINED_LENGTH, CONTAINED_LENGTH)
    around = contains_join(long_b, "right_term", long_a, "left_term", CONTAINED_LENGTH, CONTAINED_LENGTH)
    return same.unionByName(inside).unionByName(around).distinct()


def first_of_each(overrides: DataFrame, key: str) -> DataFrame:
    """The least rank of every key and mineral: another rank of the same two can never come first in ``apply_overrides``."""
    return overrides.groupBy(key, "mineral").agg(F.min("rank").alias("rank"))


def apply_overrides(candidates: DataFrame, overrides: DataFrame, limit: int | None = None) -> DataFrame:
    """Curated candidates first, then the existing ones, one per mineral, with their position; all or the first ``limit``.

    Both frames: item, rank, mineral.
    """
    o = overrides.select("item", F.lit(0).alias("tier"), "rank", "mineral")
    c = candidates.select("item", F.lit(1).alias("tier"), "rank", "mineral")
    u = o.unionByName(c).withColumn("slug", url_slug("mineral"))
    first = u.groupBy("item", "slug").agg(F.min(F.struct("tier", "rank", "mineral")).alias("m"))
    w = W.partitionBy("item").orderBy("m")
    ranked = first.withColumn("position", F.row_number().over(w))
    ranked = ranked if limit is None else ranked.where(F.col("position") <= limit)
    return ranked.select("item", "position", "m.mineral", (F.col("m.tier") == 0).alias("override"))


def link_terms(mentions: DataFrame, aliases: DataFrame, groups: DataFrame) -> DataFrame:
    """Mention key -> first term that bears it -> group of the term."""
    first = best_per_key(aliases, ["key"], ["term_id"], [F.col("position"), F.col("term_id")])
    return mentions.join(first, "key", "left").join(groups, "term_id", "left")


def resolve_hierarchy(items: DataFrame, terms: DataFrame, levels: tuple[str, ...], most_hops: int = 100) -> DataFrame:
    """The label found at each level on the way up the broader links of an item's term; of several, the least.

    The terms are resolved once, by pointer doubling: after round i a term has a link to its 2^i-th ancestors and the labels of all nearer
    ones, so a way of n hops takes about log2(n) rounds. Links that are left after the rounds for ``most_hops`` belong to a cycle (or a longer
    way), which is an error. A term may have several broader ones; links to terms that do not exist end the way. The items then need a single join.
    """
    node = written(terms.select("term_id", "label", "level", "broader"), "terms")
    least = [F.min(lv).alias(lv) for lv in levels]
    found = node.select("term_id", *[F.when(F.col("level") == lv, F.col("label")).alias(lv) for lv in levels]).groupBy("term_id").agg(*least)
    up = node.where("broader IS NOT NULL").select("term_id", F.col("broader").alias("up")).distinct()
    up = written(up.join(node.select(F.col("term_id").alias("up")).distinct(), "up", "left_semi").select("term_id", "up"), "links")
    for _ in range(max(1, most_hops).bit_length() + 1):
        if up.isEmpty():
            break
        above = found.withColumnRenamed("term_id", "up")
        found = written(found.unionByName(up.join(above, "up").select("term_id", *levels)).groupBy("term_id").agg(*least), "levels")
        further = up.select(F.col("term_id").alias("up"), F.col("up").alias("next"))
        up = written(up.join(further, "up").select("term_id", F.col("next").alias("up")).distinct(), "links")
    else:
        raise RuntimeError("broader links do not end")
    return items.select("item", "term_id").join(found, "term_id", "left").select("item", *levels)


def duplicate_of(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming curves that are already stored: same hash, else same stem or sample code."""
    sha = stored.where("sha IS NOT NULL").groupBy("sha").agg(F.min("stored_id").alias("_s"))
    stem = stored.where("stem IS NOT NULL").groupBy("stem").agg(F.min("stored_id").alias("_n"))
    j = incoming.join(sha, "sha", "left").join(stem, "stem", "left")
    return j.withColumn("duplicate_by", F.when(F.col("_s").isNotNull(), "sha256").when(F.col("_n").isNotNull(), "name")).withColumn(
        "stored_id", F.coalesce("_s", "_n")).drop("_s", "_n")


def declared_curves(curves: DataFrame, declared: DataFrame) -> DataFrame:
    """Curves whose (record, sample) is declared; a record that declares none keeps all of its curves."""
    has = declared.select("record_id").distinct().withColumn("_has", F.lit(True))
    pair = declared.select("record_id", "sample_code").distinct().withColumn("_ok", F.lit(True))
    j = curves.join(has, "record_id", "left").join(pair, ["record_id", "sample_code"], "left")
    return j.where("_has IS NULL OR _ok").drop("_has", "_ok")


def blocked_pairs(records: DataFrame, key: str, block: str) -> DataFrame:
    """Pairs ``a < b`` of records of one block, as an equi join.

    For blocks whose size is bounded by their meaning, such as the curves of a
    sample. Larger blocks go through :func:`near_pairs`.
    """
    a = records.select(*[F.col(c).alias(f"{c}_a") for c in records.columns])
    b = records.select(*[F.col(c).alias(f"{c}_b") for c in records.columns])
    return a.join(b, (F.col(f"{block}_a") == F.col(f"{block}_b")) & (F.col(f"{key}_a") < F.col(f"{key}_b")))


def near_pairs(records: DataFrame, key: str, block: str, value: str, tolerance: float) -> DataFrame:
    """Pairs ``a < b`` of one block whose values lie within ``tolerance``.

    A pair further apart has no numeric similarity at that scale. Only
    neighbouring buckets of the value meet, and full ones are split, so a large block is neither squared nor one task.
    """
    from xrdlake.operators.matching import near_join

    a = records.select(F.col(key).alias("a"), block, F.col(value).alias("value_a"))
    b = records.select(F.col(key).alias("b"), block, F.col(value).alias("value_b"))
    return near_join(a, b, "value_a", "value_b", tolerance, salt_by=("a",), on=(block,)).where("a < b")


def resolve_alias(records: DataFrame, aliases: DataFrame, manifests: DataFrame) -> DataFrame:
    """Package id of a record: its alias when a manifest exists under it, else the id itself."""
    a = aliases.join(manifests.select(F.col("record_id").alias("package_id")).distinct(), "package_id", "left_semi")
    a = a.groupBy("record_id").agg(F.min("package_id").alias("package_id"))
    return records.join(a, "record_id", "left").withColumn("resolved_id", F.coalesce("package_id", "record_id")).drop("package_id")


def first_title(records: DataFrame, sources: list[tuple[str, DataFrame]], generic: str = r"(?i)^(untitled|record|registro)\b") -> DataFrame:
    """Title of the first source that has a non-generic one; every source holds record_id and title."""
    out, names = records, []
    for name, src in sources:
        ok = src.where(F.col("title").isNotNull() & ~F.col("title").rlike(generic)).groupBy("record_id").agg(F.min("title").alias(f"_{name}"))
        out = out.join(ok, "record_id", "left")
        names.append(name)
    src = None
    for n in names:
        cond = F.col(f"_{n}").isNotNull()
        src = F.when(cond, n) if src is None else src.when(cond, n)
    return out.select(*records.columns, F.coalesce(*[F.col(f"_{n}") for n in names]).alias("title"), src.alias("title_source"))


def fetch_by_priority(wanted: DataFrame, stores: list[tuple[str, DataFrame]], payload: list[str]) -> DataFrame:
    """Row of each wanted id from the first store that holds it."""
    every = None
    for n, (name, s) in enumerate(stores):
        part = s.select("id", F.lit(n).alias("_o"), F.lit(name).alias("store"), *payload)
        every = part if every is None else every.unionByName(part)
    best = every.groupBy("id").agg(F.min_by(F.struct("store", *payload), F.struct("_o", *payload)).alias("_b"))
    return wanted.join(best, "id", "left").select(*wanted.columns, "_b.*")


def attach_rules(candidates: DataFrame, rules: DataFrame, on: str = "rule_id") -> DataFrame:
    """Source rule of each candidate; Spark picks the join by the size of ``rules``."""
    return candidates.join(rules, on, "left")


def attach_group_result(curves: DataFrame, groups: DataFrame) -> DataFrame:
    """Group classification per curve; where it exists the single-curve score is secondary."""
    return curves.join(groups, "sample_base", "left").withColumn(
        "score_role", F.when(F.col("group_status").isNotNull(), "secondary").otherwise("primary"))
