"""One document of each group of near copies: five-word shingle sets with a Jaccard similarity of 0.8 or more are linked.

64 bits cannot bound that similarity: at 0.8 two fingerprints differ in about ten bits, and no key of equal blocks is lossless for the
spread around it. So fingerprints only propose links, as do keys of rare shingles; every link is verified on the shingle sets, and a second
round finds what is missing without loss: in any one order of all shingles, two sets that alike share one of their first fifth. The order
puts the shingles that many texts hold last, so that texts with a common passage do not meet in it. Of those that meet, pairs
not yet in one group are discarded by size and by parity sketches (which differ in no more bits than the sets do in shingles).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xrdlake.llm import simhash
from xrdlake.llm.common import ids_back, ids_of, lean, maybe_among, pick
from xrdlake.session import written

WORDS = 5
#: Rounds of one pair per set, before all pairs of groups that are left are looked at.
TURNS = 2
SKETCH = 512


#: Shingles that are known to be common, at most; a shorter list makes candidates more, not results fewer.
MOST_COMMON = 1 << 19
COMMON = 8
SEEN = 1 << 17


class Order:
    """An order of all shingles: those not known to be common by hash, then the common ones by the logarithm of their count."""

    def __init__(self, hashes: np.ndarray, classes: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.classes = hashes[order], classes[order]

    def prefix(self, h: np.ndarray) -> np.ndarray:
        """The first of a set's sorted hashes in this order: any two sets with similarity 0.8 or more share one of them."""
        n = len(h) - (4 * len(h) + 4) // 5 + 1 if len(h) else 0
        if n and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            h = h[np.argsort(np.where(self.hashes[at] == h, self.classes[at], 0), kind="stable")]
        return h[:n]


def common(docs: DataFrame) -> Order:
    """The shingles that many different texts of some batch hold, by how many; of the commonest, ``MOST_COMMON`` at most.

    Counts are exact for shingles that are held twice in every batch that holds them; others are undercounted, which may
    make candidates more.
    """
    rows = pick(docs, text="string").where("text IS NOT NULL")

    def count(batches):
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                texts = set(b.column(0).slice(a, 2000).to_pylist())
                hashes, counts = np.unique(np.concatenate([np.unique(simhash.shingles(t, WORDS)) for t in texts] or [np.empty(0, np.uint64)]), return_counts=True)
                met = counts > 1
                yield pa.RecordBatch.from_arrays([pa.array(hashes[met].view(np.int64)), pa.array(counts[met], pa.int64())], names=["hash", "n"])

    counts = rows.mapInArrow(lean(count), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    counts = written(counts.select("hash", F.floor(F.log2("n")).cast("int").alias("class")), "common")
    least, held = 0, 0
    for kind, n in sorted(counts.groupBy("class").count().collect(), reverse=True):
        held += n
        if held > MOST_COMMON:
            least = kind + 1
            break
    known = counts.where(F.col("class") >= least).toArrow()
    return Order(known.column("hash").to_numpy().view(np.uint64), known.column("class").to_numpy())


def sketch(h: np.ndarray, size: int = SKETCH) -> bytes:
    """Parities of the numbers of hashes in ``size`` classes, a power of two; the halves of a sketch give that of half the size."""
    return np.packbits((np.bincount((h & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, fp, node, n, keys, bits, fine`` of every row; ``node`` is the hash of its shingle set, ``fine`` a sketch as large as the set.

    ``keys`` are given with the first row of a set that a task reads; equal rows after it have none (the last ``SEEN`` sets are remembered).
    """
    order = docs.sparkSession.sparkContext.broadcast(common(docs))
    rows = pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key"), "text")

    def look(batches):
        seen = set()
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                if len(seen) > SEEN:
                    seen.clear()
                fps, nodes, sizes, keys, bits, fine = [], [], [], [], [], []
                for t in part.column(2).to_pylist():
                    all_ = simhash.shingles(t, WORDS)
                    own = np.unique(all_)
                    fps.append(simhash.fingerprint_of(all_))
                    nodes.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                    sizes.append(len(own))
                    keys.append(own[:0].view(np.int64) if nodes[-1] in seen else order.value.prefix(own).view(np.int64))
                    seen.add(nodes[-1])
                    bits.append(sketch(own))
                    fine.append(sketch(own, max(SKETCH, 1 << len(own).bit_length())))
                yield pa.RecordBatch.from_arrays(
                    [ids_back(ids_of(part.column(0))), part.column(1), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, nodes)), pa.array(sizes, pa.int64()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(fine, pa.binary())],
                    names=["doc_id", "row_key", "fp", "node", "n", "keys", "bits", "fine"])

    return rows.mapInArrow(lean(look), "doc_id long, row_key long, fp long, node long, n long, keys array<long>, bits binary, fine binary")


def possible(n: np.ndarray, root: np.ndarray, bits: np.ndarray):
    """Index pairs of different roots that size and sketch allow a similarity of 0.8; yields ``(i, others, differing bits)``.

    Rows of the largest root are no ``i``, so the work grows with the rows outside it times all rows.
    """
    order = np.argsort(n, kind="stable")
    n, root, bits = n[order], root[order], bits[order]
    names, of, counts = np.unique(root, return_inverse=True, return_counts=True)
    largest = of == counts.argmax()
    starts, ends = np.searchsorted(5 * n // 4, n, "left"), np.searchsorted(n, 5 * n // 4, "right")
    for i in np.flatnonzero(~largest):
        j = starts[i] + np.flatnonzero((root[starts[i]:ends[i]] != root[i]) & (largest[starts[i]:ends[i]] | (np.arange(starts[i], ends[i]) > i)))
        differ = np.zeros(len(j), np.int64)
        for a, z in ((0, 2), (2, 8)):
            if len(j):
                differ = differ + np.bitwise_count(bits[j, a:z] ^ bits[i, a:z]).sum(axis=1, dtype=np.int64)
                fits = 9 * differ <= n[i] + n[j]  # the sets differ in a ninth of both sizes at most
                j, differ = j[fits], differ[fits]
        if len(j):
            yield order[i], order[j], differ


def fitting(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``u, v`` of ``pairs`` that sizes and fine sketches allow a similarity of 0.8."""
    v, u = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"fine_{x}")) for x in "vu")
    near = pairs.join(v, "v").join(u, "u").where("5 * least(n_u, n_v) >= 4 * greatest(n_u, n_v)").select("u", "v", F.expr("n_u + n_v").alias("n"), "fine_u", "fine_v")

    def compare(batches):
        for b in batches:
            fits = []
            for n, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                while len(x) > len(y):
                    x = x[:len(x) // 2] ^ x[len(x) // 2:]
                while len(y) > len(x):
                    y = y[:len(y) // 2] ^ y[len(y) // 2:]
                fits.append(9 * int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= n)
            yield b.select(["u", "v"]).filter(pa.array(fits, pa.bool_()))

    return near.mapInArrow(lean(compare), "u long, v long")


def alike(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``u, v`` of ``pairs`` whose shingle sets have a similarity of 0.8 or more."""
    pairs = written(fitting(pairs, nodes), "fitting")
    asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    asked = written(nodes.select("node", "row_key").join(asked, "node"), "asked")
    texts = pick(docs, text="string").select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key"), "text")
    texts = texts.where(maybe_among(asked, "row_key")("row_key"))  # only these are shuffled
    met = texts.join(asked, "row_key").dropDuplicates(["node"]).select("node", "text")

    def read(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                sets = [np.unique(simhash.shingles(t, WORDS)).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    sets = written(met.mapInArrow(lean(read), "node long, hashes array<long>"), "sets")
    a, b = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"set_{x}")) for x in "uv")
    # similar at 0.8: common >= 4/9 of both sizes; compared where the rows are, so that no batch of pairs of sets is sent to a worker
    return pairs.join(b, "v").join(a, "u").where("9 * size(array_intersect(set_u, set_v)) >= 4 * (size(set_u) + size(set_v))").select("u", "v")


def proposed(nodes: DataFrame, met: DataFrame) -> DataFrame:
    """``u, v``: few pairs per set that are likely alike: near fingerprints, and each key's sets with the one that shares most."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("u"))
    same = nodes.join(first, "fp").select("u", F.col("node").alias("v"))
    near = simhash.links(first.select("fp")).join(first.select(F.col("fp").alias("u"), F.col("u").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("u").alias("b")), "v")
    shared = met.groupBy("node").agg(F.struct(F.sum("copies").alias("shared"), F.first("node").alias("hub")).alias("rank"))
    hubs = met.join(shared, "node").groupBy("key").agg(F.max("rank.shared").alias("s"), F.max("rank").alias("rank")).select("key", F.col("rank.hub").alias("u"))
    star = met.where("place < 8").join(hubs, "key").select("u", F.col("node").alias("v"))
    return same.unionByName(near.select(F.col("a").alias("u"), F.col("b").alias("v"))).unionByName(star).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()


def meetings(met: DataFrame) -> DataFrame:
    """``key, node``: one of the keys that are shared by the same sets, for each such group.

    The shingles of a passage that some texts share are keys of the same sets; these are compared once, not once for each shingle.
    Groups are told apart by their size, ends and two parities of 64-bit hashes.
    """
    kinds = met.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most"), F.bit_xor("node").alias("a"), F.bit_xor(F.xxhash64("node")).alias("b"))
    chosen = kinds.groupBy("n", "least", "most", "a", "b").agg(F.min("key").alias("key")).select("key")
    return met.select("key", "node").join(chosen, "key")


def remaining(met: DataFrame, roots: DataFrame, nodes: DataFrame, nearest: bool = False) -> DataFrame:
    """``u, v``: all pairs of sets with a common key that are in different groups and can be alike.

    With ``nearest``, of the pairs of each set only one with fewest differing bits, so pairs are no more than sets.
    """
    named = met.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = named.groupBy("key").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("key")
    rows = named.join(mixed, "key").join(nodes.select("node", "n", "bits"), "node")

    def walk(batches):
        held, key = [], None

        def close():
            node, n, root = (np.concatenate([x[c].to_numpy() for x in held]) for c in (1, 2, 3))
            bits = np.frombuffer(b"".join(v for x in held for v in x[4].to_pylist()), np.uint64).reshape(len(node), -1)
            for i, j, differ in possible(n, root, bits):
                if nearest:
                    first = differ.argmin()
                    j, differ = j[first:first + 1], differ[first:first + 1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), node[i])), pa.array(node[j]), pa.array(differ)], names=["i", "j", "differ"])

        for b in batches:
            keys = b.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(keys)) + 1
            for a, z in zip([0, *edges], [*edges, len(keys)], strict=True):
                if a == z:
                    continue
                if held and keys[a] != key:
                    yield from close()
                    held = []
                key = keys[a]
                held.append(b.slice(int(a), int(z - a)).columns)
        if held:
            yield from close()

    dealt = rows.select("key", "node", "n", "root", "bits").repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(lean(walk), "i long, j long, differ long")
    if nearest:
        found = found.groupBy("i").agg(F.min(F.struct("differ", "j")).alias("first")).select("i", "first.j")
    return found.select(F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group: the smallest id (null last), of equal ids the smallest text hash; repeats once.

    Groups are what links reach. Texts up to five words are one shingle; null and empty texts have none and are one group.
    """
    prints = written(sketches(docs), "sketches")
    nodes = written(prints.groupBy("node").agg(*(F.min(c).alias(c) for c in ("row_key", "fp", "n", "bits", "fine"))), "sets-seen")
    # one shuffle by key serves what follows: equal sets of different tasks meet at their keys, and the copies of a key are counted
    keyed = prints.select("node", F.posexplode("keys").alias("place", "key")).repartition("key").groupBy("key", "node").agg(F.min("place").alias("place"))
    keyed = keyed.withColumn("copies", F.count("*").over(Window.partitionBy("key")))
    met = written(keyed.where("copies > 1"), "keys-met")
    links = written(alike(written(proposed(nodes, met), "proposed"), docs, nodes), "links")
    roots = written(simhash.components(links), "roots")
    met = written(meetings(met), "meetings")
    for _ in range(TURNS):
        found = written(alike(written(remaining(met, roots, nodes, nearest=True), "nearest"), docs, nodes), "links")
        if found.isEmpty():
            break
        links = links.unionByName(found)
        roots = written(simhash.components(links), "roots")
    more = written(alike(written(remaining(met, roots, nodes), "remaining"), docs, nodes), "links")
    comps = simhash.components(links.unionByName(more))
    roots = nodes.select("node").join(comps, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return simhash.firsts(docs, prints.select("doc_id", "row_key", "node"), roots)
