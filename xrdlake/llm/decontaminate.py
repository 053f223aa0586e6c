"""Documents that hold passages of a benchmark, by spaced seeds.

Fixed masks pick some of the words in a stretch and ignore the others, so a substituted word spoils only masks that look at it. The hashes
of benchmark and documents are joined; around each hit, document and item are compared word by word along one diagonal.
The masks find every stretch of 13 words with at most two substitutions, and every allowed set of substitutions in shorter items (see the tests).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrdlake.llm.common import by_place, ids_back, ids_of, lean, mix, pick, ragged, renamed, text_key
from xrdlake.session import written

#: Word positions that a mask looks at.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 5))
#: The same for items shorter than ``WINDOW``: any two substitutions in ten words or more, any one in six or more, leave three words in a
#: row; the second mask is for the middle one of five.
SHORT_MASKS = ((0, 1, 2), (0, 1, 3, 4))
LEAST = 5
WINDOW = 13
SIMILARITY = 0.8
#: Hits and words that are compared at once.
BLOCK = 2_000_000
#: Words of benchmark that one pass over the documents takes to every task; more are dealt to more passes.
PASS_WORDS = 1_000_000
CACHE_WORDS = 400_000
EDGE = b".,;:!?\"'()[]{}<>*#&%$|-_"

_KNOWN: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, lower-cased (A-Z) and without punctuation at their ends."""
    known = _KNOWN
    new = set(words).difference(known)
    if new:
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = xxhash.xxh64_intdigest(w.lower().strip(EDGE) or w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seeds(h: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    n = len(h) - mask[-1]
    out = np.full(max(n, 0), salt + 1, np.uint64)
    for p in mask if n > 0 else ():
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[p:p + n]
    return mix(out)


def blocks(sizes: np.ndarray, limit: int = BLOCK):
    """Neighbours ``a, z`` whose sizes sum up to ``limit`` or so, one at least."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, z
        a = z


class Items:
    """A bounded share of the benchmark: its words end to end and the sorted seeds with their places."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = [(i, (t or "").encode().split()) for i, t in rows]
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.sizes = np.array([len(w) for _, w in rows], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.words = word_hashes([x for _, w in rows for x in w])
        owner = np.repeat(np.arange(len(rows)), self.sizes)
        short = (self.sizes >= LEAST) & (self.sizes < WINDOW)
        self.masks = MASKS + (SHORT_MASKS if short.any() else ())
        hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for salt, mask in enumerate(self.masks):
            h = seeds(self.words, mask, salt)
            fits = np.flatnonzero(owner[:len(h)] == owner[mask[-1]:mask[-1] + len(h)])
            if mask in SHORT_MASKS:
                fits = fits[short[owner[fits]]]
            hashes.append(h[fits])
            places.append(fits)
        self.hashes, self.places = np.concatenate(hashes), np.concatenate(places)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.places, self.owner = self.hashes[order], self.places[order], owner
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def leaks(self, h: np.ndarray, doc: np.ndarray):
        """``(doc, item, start, matched, window)`` of leaked items, given the hashes of many documents' words end to end."""
        out: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for salt, mask in enumerate(self.masks):
            s = seeds(h, mask, salt)
            at = np.flatnonzero(self.maybe[(s >> np.uint64(42)).astype(np.int64)])
            at = at[doc[at] == doc[at + mask[-1]]] if len(at) else at
            a, b = np.searchsorted(self.hashes, s[at]), np.searchsorted(self.hashes, s[at], "right")
            at, a, b = at[b > a], a[b > a], b[b > a]
            for x, z in blocks(b - a):
                place = self.places[ragged(a[x:z], (b - a)[x:z])]
                item, where = self.owner[place], np.repeat(at[x:z], (b - a)[x:z])
                keys = np.unique(np.stack([doc[where], item, where - (place - self.first[item])], axis=1), axis=0)  # one row per diagonal
                for y, e in blocks(self.sizes[keys[:, 1]]):
                    self.compare(keys[y:e], h, doc, out)
        return [(d, i, begin, best, window) for (d, i), (best, _, begin, window) in out.items()]

    def compare(self, keys: np.ndarray, h: np.ndarray, doc: np.ndarray, out: dict) -> None:
        """Diagonals ``(doc, item, begin)`` word by word; ``out`` keeps the best stretch of a document and item, of equals that of the first diagonal."""
        d, i, begin = keys.T
        size = self.sizes[i]
        first = np.cumsum(size) - size
        place = ragged(begin, size)
        inside = (place >= 0) & (place < len(h))
        place = np.where(inside, place, 0)
        same = inside & (h[place] == self.words[ragged(self.first[i], size)]) & (doc[place] == np.repeat(d, size))
        total = np.concatenate(([0], np.cumsum(same)))
        window = np.minimum(size, WINDOW)
        n = size - window + 1  # places of a window
        start = ragged(first, n)
        counts = total[start + np.repeat(window, n)] - total[start]
        ends = np.cumsum(n)
        best = np.maximum.reduceat(counts, ends - n)
        for k in np.flatnonzero(best >= SIMILARITY * window).tolist():
            at = int(counts[ends[k] - n[k]:ends[k]].argmax())
            new = (int(best[k]), -int(begin[k]), int(begin[k]) + at, int(window[k]))
            key = int(d[k]), int(i[k])
            if new[:2] > out.get(key, (0, 0))[:2]:
                out[key] = new


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, row_key, item_id, start_word, matched, window`` for every document row and item it holds.

    An item is held when, along one alignment without insertions, a stretch of ``WINDOW`` of its words (all of them, if it has
    fewer) agrees with the document in at least ``SIMILARITY`` of the words; the best such stretch is reported, the
    first of equals. Words are cut at ASCII white space and compared without case (A-Z) or punctuation at their ends. Items under
    five words, null and empty texts hold nothing; repeated rows and repeated items give repeated results;
    ``row_key`` is ``xxhash64(text)``. Other columns are not read.
    """
    rows = pick(docs, doc_id="long", text="string").fillna("", ["text"]).select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    items = pick(benchmark, item_id="long", text="string").where("text IS NOT NULL AND item_id IS NOT NULL")
    total = items.agg(F.sum(F.size(F.split("text", r"[ \t\n\x0b\f\r]+")))).first()[0] or 0
    passes = max(1, -(-total // (PASS_WORDS // 2)))
    names = ["doc_id", "row_key", "item_id", "start_word", "matched", "window"]
    out = None
    for k in range(passes):
        own = Items([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()])
        shared = docs.sparkSession.sparkContext.broadcast(own)

        def look(batches, shared=shared):
            for b in batches:
                for a in range(0, b.num_rows, 500):
                    part = b.slice(a, 500)
                    ids, keys = ids_of(part.column(0)), ids_of(part.column(1))
                    words = [t.encode().split() for t in part.column(2).to_pylist()]
                    sizes = np.array([len(w) for w in words], np.int64)
                    h = word_hashes([x for w in words for x in w])
                    first = np.cumsum(sizes) - sizes
                    found = shared.value.leaks(h, np.repeat(np.arange(len(words)), sizes))
                    if found:
                        d, i, start, matched, window = (np.array(c, np.int64) for c in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([ids_back(ids[d]), pa.array(keys[d]), pa.array(shared.value.ids[i]), pa.array(start - first[d]), pa.array(matched), pa.array(window)], names=names)

        part = rows.mapInArrow(lean(look), "doc_id long, row_key long, item_id long, start_word long, matched long, window long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item. Only text hashes of leaks are joined, and only equal texts share a verdict.

    Null and empty texts hold nothing and stay; repeated rows stay or go together; columns of any name pass through; an empty table stays empty.
    """
    bad = written(leaks(docs, benchmark).select("row_key").distinct(), "leaks")  # written: Spark then knows its size
    plain = by_place(docs)
    return renamed(plain.join(bad, text_key(plain, docs) == bad["row_key"], "left_anti"), docs)
