"""Near-duplicate groups of documents by 64-bit fingerprints, with pivot distance tables.

Fingerprints within ``MOST_BITS`` differing bits are linked. Distances to pivots (reference fingerprints) bound the distance of two
fingerprints from below: a pair whose table rows differ by more than ``MOST_BITS`` in any coordinate is discarded, survivors are
verified. Pivot distances of 64-bit values all lie near 32, too close together to deal fingerprints out by them (with 16
pivots, a key that loses no link would repeat every row thousands of times); so candidates meet by equal blocks: of six blocks, two fingerprints
at most three bits apart share at least three, and each of the 20 choices of three is a key of about 32 bits.
Only distinct fingerprints take part, and each group of equal keys gives a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrdlake.llm.common import by_place, ids_back, ids_of, lean, maybe_among, mix, pick, place_of, renamed, text_key
from xrdlake.session import cut_lineage, written

MOST_BITS = 3
BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
PIVOTS = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BLOCKS = tuple((sum((11, 11, 11, 11, 10, 10)[:i]), (11, 11, 11, 11, 10, 10)[i]) for i in range(6))
KEYS = tuple(itertools.combinations(range(6), 3))


def shingles(text: str | None, words: int = 3) -> np.ndarray:
    """Hashes (XXH64, seed 42) of all runs of ``words`` words, repeats included; a shorter text is one run, an empty one none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(parts), 42)]
    else:
        line, ends, at = b" ".join(parts), [], -1
        for p in parts:
            at += len(p) + 1
            ends.append(at)
        starts, digest = [0, *(e + 1 for e in ends)], xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, ends[words - 1:], strict=False)]
    return np.array(hashes, "<u8")


def fingerprint_of(h: np.ndarray) -> int:
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.bitwise_or.reduce(BITS[2 * ones > len(h)], initial=np.uint64(0)))


def fingerprint(text: str | None, words: int = 3) -> int:
    """A bit is set if it is set in over half of the shingle hashes (XXH64, seed 42; repeats count)."""
    return fingerprint_of(shingles(text, words))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, fp`` of every row; ``row_key`` is ``xxhash64(text)``, ``fp`` the fingerprint as a signed number."""
    rows = pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key"), "text")

    def look(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                fps = np.array([fingerprint(t) for t in part.column(2).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids_back(ids_of(part.column(0))), part.column(1), pa.array(fps)], names=["doc_id", "row_key", "fp"])

    return rows.mapInArrow(lean(look), "doc_id long, row_key long, fp long")


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (first of a component, other) that join distinct fingerprints exactly as all links of at most ``MOST_BITS`` bits do.

    Fingerprints are sorted by their distance to the first pivot. Each one that is reached is compared once with those
    not yet reached: the slice within ``MOST_BITS`` of it in that order, then the other pivots, then the bits themselves.
    """
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    left = np.ones(len(fps), bool)
    out = []
    for i in range(len(fps)):
        if not left[i]:
            continue
        left[i] = False
        todo = [i]
        while todo:
            j = todo.pop()
            a, b = np.searchsorted(table[:, 0], table[j, 0] - MOST_BITS), np.searchsorted(table[:, 0], table[j, 0] + MOST_BITS, "right")
            near = a + np.flatnonzero(left[a:b])
            for p in range(1, len(PIVOTS), 5):
                if len(near):
                    near = near[(np.abs(table[near, p:p + 5] - table[j, p:p + 5]) <= MOST_BITS).all(axis=1)]
            near = near[np.bitwise_count(fps[near] ^ fps[j]) <= MOST_BITS]
            left[near] = False
            todo += near.tolist()
            out += [(int(fps[i]), int(fps[k])) for k in near]
    return out


def links(distinct: DataFrame) -> DataFrame:
    """``u, v``: links among distinct ``fp``, enough to join every component; each is within a component."""
    block = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << size) - 1)) for at, size in BLOCKS]
    keys = [F.shiftleft(block[a], 22).bitwiseOR(F.shiftleft(block[b], 11)).bitwiseOR(block[c]).bitwiseOR(F.lit(i << 33)) for i, (a, b, c) in enumerate(KEYS)]
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))

    def walk(batches):
        key, held = None, []
        ready = []

        def close():
            fps = np.unique(np.concatenate(held).view(np.uint64)) if held else ()
            if len(fps) > 1:
                ready.extend(forest(fps))

        for b in batches:
            keys, fps = b.column(0).to_numpy(), b.column(1).to_numpy()
            edge = np.flatnonzero(np.diff(keys, prepend=~keys[0])) if len(keys) else []
            for a, z in zip(edge, np.append(edge[1:], len(keys)), strict=True):
                if keys[a] != key:
                    if held and (len(held) > 1 or len(held[0]) > 1):
                        close()
                    key, held = keys[a], []
                held.append(fps[a:z])
            if ready:
                yield pairs(ready)
                ready.clear()
        close()
        if ready:
            yield pairs(ready)

    def pairs(rows):
        u, v = np.array(rows, np.uint64).T
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u).view(np.int64)), pa.array(np.ascontiguousarray(v).view(np.int64))], names=["u", "v"])

    met = dealt.repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(lean(walk), "u long, v long")
    return met.distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for the nodes of ``edges (u, v)``: the root is the least node reachable.

    Edges are turned to stars: each round links a node's larger neighbours to its least neighbour, then its smaller ones; minima are
    aggregated before they are shuffled. A reliable checkpoint ends each round; the loop ends when nothing changes.
    """
    near = cut_lineage(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a <> b").distinct())
    for _ in range(most_rounds):
        both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut_lineage(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        small = cut_lineage(small.distinct())
        # a star forest: every node has one smaller neighbour, and that one has none
        done = small.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0 and small.join(small.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() == 0
        near = small
        if done:
            roots = near.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(near.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError("components did not settle")


def rooted(prints: DataFrame) -> DataFrame:
    """``fp, root``: the component of every distinct fingerprint, named by one of its fingerprints."""
    distinct = prints.select("fp").distinct()
    comps = components(links(distinct))
    return distinct.join(comps.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, fp, fingerprint, component_id`` of every row; ``component_id`` is the smallest id reachable over links.

    Null and empty texts have fingerprint zero, linked like any other; texts under three words are one shingle. Rows without
    an id are grouped too but name no component (null, if a group has only such rows). Repeated rows stay in one
    component. An empty table gives no rows; other columns are not read.
    """
    prints = written(fingerprints(docs), "fingerprints")
    named = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = written(named.join(rooted(named), "fp"), "roots")
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = roots.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "row_key", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group: the smallest id (null last), of equal ids the smallest text hash; repeats once."""
    prints = written(fingerprints(docs), "fingerprints")
    return firsts(docs, prints.select("doc_id", "row_key", F.col("fp").alias("node")), rooted(prints.select("fp").distinct()).withColumnRenamed("fp", "node"))


def firsts(docs: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root, given ``doc_id, row_key, node`` of every row and ``node, root``."""
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    first = rows.groupBy("node").agg(F.min(rank).alias("first")).join(roots, "node").groupBy("root").agg(F.min("first").alias("first"))
    keep = first.select(F.col("first.doc_id").alias("doc_id"), F.col("first.row_key").alias("row_key"), F.lit(1).alias("kept"))
    seen = rows.groupBy("doc_id", "row_key").agg(F.count("*").alias("copies"))
    same = seen["doc_id"].eqNullSafe(keep["doc_id"]) & (seen["row_key"] == keep["row_key"])
    odd = seen.join(keep, same, "left").where("kept IS NULL OR copies > 1").select(seen["doc_id"].alias("odd_id"), seen["row_key"].alias("odd_key"), "kept")
    odd = written(odd, "odd")  # only these rows are looked up; written, Spark knows their size
    plain = by_place(docs)
    keyed = plain.withColumns({"row_id": F.col(f"c{place_of(docs, 'doc_id')}").cast("long"), "row_key": text_key(plain, docs)})
    is_odd = keyed["row_id"].eqNullSafe(odd["odd_id"]) & (keyed["row_key"] == odd["odd_key"])
    maybe = maybe_among(odd, "odd_key")("row_key")  # most rows are in no join
    rest = keyed.where(maybe)
    single = keyed.where(~maybe).unionByName(rest.join(odd, is_odd, "left_anti"))
    repeated = rest.join(odd.where("kept IS NOT NULL"), is_odd, "left_semi").dropDuplicates(["row_id", "row_key"])
    return renamed(single.unionByName(repeated), docs)
