"""Mixing sources to target weights along a curriculum that changes with training time.

Each source has a share of the training tokens, bounded by what repeats of its documents give, and a schedule: its weight as a
piecewise linear function of training time. The integral of the schedule is the source's cumulative token demand. Documents follow each other
in their source in an order that hashes fix; the word that a document starts with asks for a certain cumulative demand, and the time at which the source
reaches it, by the inverted integral, is the document's training position. A sort by ranges of positions mixes the sources.

All of it is DataFrame expressions. Sums along a source are taken per hash bucket first, so a source of any size is many groups of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xrdlake.llm.common import pick
from xrdlake.session import written

WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of all documents, as a fraction.
SHARE = (3, 2)
REPEATS = 2
#: Weight by training time (0 to 1), for sources in turn: steady, rising, fading out.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.5), (1.0, 0.25)))
#: Documents of one source that are summed in one group.
BUCKET_ROWS = 50_000
#: Equal rows that one task makes out of their count.
COPIES = 10_000


def demand(schedule) -> list[tuple[float, float, float, float, float]]:
    """``share before, time, width, weight at both ends`` of every piece of a schedule; shares are parts of its integral."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False)]
    total, before, out = sum(areas), 0.0, []
    for ((t0, w0), (t1, w1)), area in zip(zip(schedule, schedule[1:], strict=False), areas, strict=True):
        out.append((before / total, t0, t1 - t0, w0 / total, w1 / total))
        before += area
    return out


def time_of(share: Column, schedule) -> Column:
    """The training time at which a source has had ``share`` (0 to 1) of its tokens: its cumulative demand, inverted."""
    out = None
    for before, t, width, a, b in demand(schedule):
        need = (share - F.lit(before)) / F.lit(width)  # area below the line from a to b, up to x of its width
        root = F.sqrt(F.lit(a * a) + F.lit(2 * (b - a)) * need)
        x = F.when(F.lit(a) + root > 0, F.lit(2.0) * need / (F.lit(a) + root)).otherwise(F.lit(0.0))
        at = F.lit(t) + F.lit(width) * x
        out = at if out is None else F.when(share >= before, at).otherwise(out)
    return out


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with a number from 0 on in the given order: sorted by ranges, numbered in each, offset by the sizes of those before."""
    local = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    sizes = local.groupBy(F.shiftright("_at", 33).alias("_part")).count().orderBy("_part").collect()  # one row per range
    before, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    spread = local.sparkSession.createDataFrame(offsets, "_part long, _before long")
    numbered = local.withColumn("_part", F.shiftright("_at", 33)).join(spread, "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def targets(sources: DataFrame, share=SHARE, repeats: int = REPEATS) -> DataFrame:
    """``sources`` (``weight``, ``source_size``) with ``target``: by weight, at most ``repeats`` times the size, the excess reshared until none is above."""
    whole = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    full, had = share[0] * whole[0], (0, 0)
    while True:
        words, weight = full - share[1] * had[0], share[1] * (whole[1] - had[1])  # the level is their quotient
        above = wide("weight") * F.lit(words).cast("decimal(38,0)") > wide("source_size") * F.lit(repeats * weight).cast("decimal(38,0)")
        capped = sources.where(above).agg(F.coalesce(F.sum(repeats * F.col("source_size")), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if tuple(capped) == had:
            break
        had = tuple(capped)
    level = F.lit(words).cast("double") * F.col("weight") / F.lit(max(weight, 1)).cast("double")
    return sources.withColumn("target", F.when(above, (repeats * F.col("source_size")).cast("double")).otherwise(level))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, repeats: int = REPEATS, schedules=SCHEDULES) -> DataFrame:
    """A row per document: ``doc_id, source, size, source_size, target, start, order, copy, passes``.

    ``size`` counts words (runs of other than ASCII white space). Sources, by code point and null last, have ``weights`` in turn and share
    ``share`` of all words, each at most ``repeats`` times its own. The order of a source's documents is that of the MD5 hash of
    ``doc_id:text``, ``start`` the words before a document. ``passes`` has ``number`` (from 0), ``words`` and ``position`` (training time of its
    middle word, from 0 to 1) of every time that the mix reads the document. Passes come one after the other; the document in
    which a source reaches its target is cut there, so a source gives its target to the word.

    Null and empty texts have size 0 and no passes; rows without source are a source; equal rows (id, text and source) are
    documents of their own (``copy``); an empty table gives no rows; other columns are not read. Reruns agree.
    """
    rows = pick(docs, doc_id="long", text="string", source="string").select(
        "doc_id", "source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))).alias("order")).fillna(0, ["size"])
    units = written(rows.groupBy("source", "doc_id", "size", "order").agg(F.count("*").alias("copies")), "documents-sized")
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    named = ranked(sums, "rank", F.col("source").asc_nulls_last())
    turn = F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    sources = written(targets(written(named, "sources"), share, repeats), "targets")

    buckets = max(1, -(-units.count() // BUCKET_ROWS))
    known = units.join(sources.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    known = known.withColumn("bucket", F.shiftright(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * buckets, 32))
    words = F.sum(F.col("size") * F.col("copies"))
    rest = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begun = known.groupBy("rank", "bucket").agg(words.alias("sum")).select("rank", "bucket", F.coalesce(F.sum("sum").over(rest), F.lit(0)).alias("before"))
    inside = Window.partitionBy("rank", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("inside", F.coalesce(words.over(inside), F.lit(0))).join(begun, ["rank", "bucket"]).withColumn("first", F.col("before") + F.col("inside"))

    # equal rows: few at once where they stand, large counts dealt out in portions first
    several = placed.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    portions = several.where(f"copies <= {COPIES}").unionByName(several.where(f"copies > {COPIES}").repartition("order", "portion"))
    copy = F.explode(F.sequence(F.col("portion") * COPIES, F.least((F.col("portion") + 1) * COPIES, F.col("copies")) - 1))
    single = portions.withColumn("copy", copy).withColumn("start", F.col("first") + F.col("copy") * F.col("size"))

    taken = F.floor("target")
    def one(k):
        begin = F.col("start") + k * F.col("source_size")
        n = F.greatest(F.lit(0), F.least(F.col("size"), taken - begin)).cast("long")
        middle = (begin.cast("double") + n.cast("double") / 2.0) / F.nullif(F.col("target"), F.lit(0.0))
        at = None
        for i, s in enumerate(schedules):
            own = time_of(middle, s)
            at = own if at is None else F.when(F.pmod(F.col("rank"), F.lit(len(schedules))) == i, own).otherwise(at)
        return F.struct(F.lit(k).alias("number"), n.alias("words"), at.alias("position"))

    passes = F.filter(F.array(*map(one, range(repeats))), lambda p: p["words"] > 0)
    return single.select("doc_id", "source", "rank", "size", "source_size", "target", "start", "order", "copy", passes.alias("passes"))


def stream(mixed: DataFrame) -> DataFrame:
    """The training stream: a row per pass, with ``place`` (from 0) by position; documents without a pass follow, without words.

    Equal positions follow in the order of the documents' hashes, ids, sources, copies.
    """
    rows = mixed.select("*", F.explode_outer("passes").alias("p")).select(
        *(c for c in mixed.columns if c != "passes"), F.col("p.number").alias("pass"), F.coalesce("p.words", F.lit(0)).alias("words"), F.col("p.position").alias("position"))
    order = [F.col("position").asc_nulls_last(), *map(F.col, ("order", "doc_id", "rank", "copy", "pass"))]
    return ranked(rows, "place", *order)


def by_document(placed: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken, n_passes, first_place`` of every document from the rows of ``stream``."""
    one = placed.groupBy("rank", "order", "doc_id", "copy").agg(
        *(F.first(c).alias(c) for c in ("size", "source_size", "target")), F.sum("words").alias("taken"), F.count("pass").alias("n_passes"),
        F.min(F.when(F.col("words") > 0, F.col("place"))).alias("first_place"))
    return one.select("doc_id", "size", "source_size", "target", "taken", "n_passes", "first_place")
