"""Scores of all pairs of two blocks of records, without their rounding.

A task holds two blocks. Token sets are numbered per block, the similarity of two sets is looked up by number, and a strip of the first block
meets the whole second one at a time, so memory is that of the blocks. A score differs from the rounded one by less than ``SLACK``: every
rounding at 4 digits adds at most half a digit at three nested levels, and the weights of a level sum to 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SETS = ("minerals", "groups", "subjects", "environment", "rock", "formation", "uses", "result_text")
TIMES = ("era", "period", "epoch")
SLACK = 2.5e-4
#: Records of a strip, and looked-up similarities of a field that a task keeps.
STRIP, KEPT = 64, 4_000_000


def _codes(column: pa.ChunkedArray, missing: int) -> pa.Array:
    return pc.fill_null(column.combine_chunks().dictionary_encode().indices, missing)


class Sets:
    """Token sets of one field: ``a`` and ``b`` number the set of each record, equal sets of a side have one number."""

    def __init__(self, a: pa.ChunkedArray, b: pa.ChunkedArray):
        self.a, left = self._numbered(a)
        self.b, right = self._numbered(b)
        self.left = left
        self.sizes = np.array([len(s) for s in right], np.float32)
        held: dict[str, list[int]] = {}
        for k, s in enumerate(right):
            for token in s:
                held.setdefault(token, []).append(k)
        self.held = {t: np.array(v) for t, v in held.items()}
        self.table = np.stack([self._row(s) for s in left]) if 0 < len(left) * len(right) <= KEPT else None

    @staticmethod
    def _numbered(column: pa.ChunkedArray):
        lists = column.combine_chunks().cast(pa.list_(pa.string()))
        # the size tells an empty set from one with an empty token
        size = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.string())
        keys = pc.binary_join_element_wise(size, pc.fill_null(pc.binary_join(lists, "\x1f"), ""), "\x1e").dictionary_encode()
        sets = []
        for key in keys.dictionary.to_pylist():
            n, _, words = key.partition("\x1e")
            sets.append(frozenset(words.split("\x1f")) if n != "0" else frozenset())
        return keys.indices.to_numpy(zero_copy_only=False), sets

    def _row(self, s: frozenset) -> np.ndarray:
        shared = np.zeros(len(self.sizes), np.float32)
        for token in s:
            if token in self.held:
                shared[self.held[token]] += 1
        return shared / np.maximum(self.sizes + len(s) - shared, 1)

    def similarity(self, strip: slice) -> np.ndarray:
        """Shared over all tokens of every record of the strip and of ``b``."""
        if self.table is not None:
            rows, at = np.unique(self.a[strip], return_inverse=True)
            return self.table[rows][:, self.b][at]
        rows, at = np.unique(self.a[strip], return_inverse=True)
        return np.stack([self._row(self.left[k]) for k in rows])[:, self.b][at]


class Joint:
    """Fields of two blocks that are looked up together: ``a`` and ``b`` number the values that records have in all of them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, table: np.ndarray):
        self.a, self.b, self.table = a, b, table

    @staticmethod
    def _pairs(one: np.ndarray, other: np.ndarray):
        """Which values of both meet, and the number of the pair of each record."""
        wide = int(other.max(initial=0)) + 1
        met, number = np.unique(one.astype(np.int64) * wide + other, return_inverse=True)
        return (met // wide, met % wide), number

    def with_field(self, other: Joint) -> Joint | None:
        """Both together, if their table may be kept."""
        (a, a2), left = self._pairs(self.a, other.a)
        (b, b2), right = self._pairs(self.b, other.b)
        if len(a) * len(b) > KEPT:
            return None
        return Joint(left, right, self.table[a][:, b] + other.table[a2][:, b2])

    def similarity(self, strip: slice) -> np.ndarray:
        return self.table[self.a[strip]].take(self.b, axis=1)


def joined(fields: list[Joint]) -> list[Joint]:
    """The fields in few tables: each goes into the table that it leaves smallest."""
    out: list[Joint] = []
    for field in fields:
        both = [(j.table.size, k, j) for k, g in enumerate(out) if (j := g.with_field(field)) is not None]
        if both:
            _, k, out[k] = min(both, key=lambda v: v[:2])
        else:
            out.append(field)
    return out


class Block:
    """What two blocks need besides token sets."""

    def __init__(self, t: pa.Table, metric: str):
        # a record without vector has zeros, a length of zero gives no similarity
        vectors = t.column("vector").to_pylist()
        width = max((len(v) for v in vectors if v), default=1)
        self.has = np.array([bool(v) for v in vectors])
        self.vector = np.array([v if v else [0.0] * width for v in vectors], np.float64).reshape(len(vectors), width)
        self.numbers = {k: t.column(k).cast(pa.float64()).to_numpy() for k in ("si_al", "clay_fraction")}
        if metric != "euclidean":
            norm = np.sqrt((self.vector ** 2).sum(1))
            self.has &= norm != 0
            with np.errstate(divide="ignore", invalid="ignore"):
                self.vector = np.where(norm[:, None] > 0, self.vector / norm[:, None], self.vector)


class Blocks:
    """All pairs of the records of ``a`` and ``b`` (``geochem.prepare``); ``weights`` as from ``geochem.field_weights``."""

    def __init__(self, a: pa.Table, b: pa.Table, weights: dict[str, float], chemistry: float, metric: str):
        self.weights, self.chemistry, self.metric = weights, chemistry, metric
        self.sets = {k: Sets(a.column(f"t_{k}"), b.column(f"t_{k}")) for k in SETS if weights[k]}
        both = lambda k: pa.chunked_array([*a.column(k).chunks, *b.column(k).chunks], a.column(k).type)
        cut = a.num_rows
        self.same = {}
        for k in (*TIMES, "class"):
            codes = _codes(both(k), -1).to_numpy(zero_copy_only=False)
            self.same[k] = codes[:cut], np.where(codes[cut:] < 0, -2, codes[cut:])
        self.a, self.b = Block(a, metric), Block(b, metric)
        fields = [Joint(v.a, v.b, v.table * np.float32(weights[k])) for k, v in self.sets.items() if v.table is not None]
        self.alone = {k: v for k, v in self.sets.items() if v.table is None}
        self.ages = []
        for k in TIMES:
            (x, left), (y, right) = (np.unique(v, return_inverse=True) for v in self.same[k])
            if 0 < len(x) * len(y) <= KEPT:
                fields.append(Joint(left, right, np.float32(weights[k]) * (x[:, None] == y)))
            else:
                self.ages.append(k)
        self.joint = joined(fields)

    def words(self, strip: slice) -> np.ndarray:
        """What token sets and ages bring to the total score of the pairs of a strip."""
        found = [j.similarity(strip) for j in self.joint]
        total = found[0] if found else np.zeros((len(self.a.has[strip]), len(self.b.has)), np.float32)
        for more in found[1:]:
            total += more
        for k, s in self.alone.items():
            total += np.float32(self.weights[k]) * s.similarity(strip)
        for k in self.ages:
            x, y = self.same[k]
            total += np.float32(self.weights[k]) * (x[strip, None] == y)
        return total

    def chemical(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """What vectors, numbers and classes bring to the total score of the pairs ``i, j``."""
        with np.errstate(all="ignore"):
            u, v = self.a.vector[i], self.b.vector[j]
            if self.metric == "euclidean":
                near = 1 / (np.sqrt(((u - v) ** 2).sum(-1)) + 1)
            else:
                near = np.clip(((u * v).sum(-1) + 1) / 2, 0, 1)
            near = np.where(self.a.has[i] & self.b.has[j], np.nan_to_num(near, nan=1.0), 0.0) * 0.6
            for k, weight, span in (("si_al", 0.2, None), ("clay_fraction", 0.15, 100.0)):
                x, y = self.a.numbers[k][i], self.b.numbers[k][j]
                near = near + weight * np.nan_to_num(1 - np.minimum(np.abs(x - y) / (span or np.maximum(np.maximum(np.abs(x), np.abs(y)), 1.0)), 1.0), nan=0.0)
        x, y = self.same["class"]
        return self.chemistry * (near + 0.05 * (x[i] == y[j]))

    def strips(self):
        return (slice(at, at + STRIP) for at in range(0, len(self.a.has), STRIP))

    def reaching(self, least: float):
        """``(i, j)`` of the pairs that can have a total score of ``least``."""
        found = []
        for strip in self.strips():
            words = self.words(strip)
            i, j = np.divmod(np.flatnonzero(words >= least - self.chemistry - SLACK), words.shape[1])
            keep = words[i, j] + self.chemical(i + strip.start, j) >= least - SLACK
            found.append((i[keep] + strip.start, j[keep]))
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))

    def best(self, k: int, own: np.ndarray):
        """``(i, j, score)`` of the pairs that can be among the ``k`` best of ``i``; ``own[i]`` is the place of ``i`` itself in ``b`` or -1; ``b`` is in order of id."""
        found = []
        n = len(self.b.has)
        for strip in self.strips():
            words = self.words(strip)
            rows = np.arange(strip.start, strip.start + len(words))
            mine = own[strip]
            words[np.flatnonzero(mine >= 0), mine[mine >= 0]] = -1.0
            # the partners with most words in common give a floor, chemistry is looked at where a record can still pass it
            few = min(n, k + 30)
            j = np.argpartition(words, n - few, axis=1)[:, n - few:]
            held = np.take_along_axis(words, j, 1)
            sure = np.sort(np.where(held >= 0, held + self.chemical(rows[:, None], j), -1.0), axis=1)[:, max(few - k, 0)] if few else np.zeros(len(words))
            bound = np.maximum(sure.astype(np.float32) - np.float32(self.chemistry + 2 * SLACK), np.float32(0.0))
            i, j = np.divmod(np.flatnonzero(words >= bound[:, None]), n)
            score = words[i, j] + self.chemical(rows[i], j)
            order = np.lexsort((j, -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.searchsorted(i, np.arange(len(words)))
            count = np.bincount(i, minlength=len(words))
            bar = np.full(len(words), -1.0)
            enough = count >= k
            bar[enough] = score[first[enough] + k - 1]
            # a score of nothing has no rounding: of such partners the first decide
            keep = (score >= bar[i] - 2 * SLACK) & ((score > 0) | (np.arange(len(i)) - first[i] < k))
            found.append((rows[i[keep]], j[keep], score[keep]))
        return tuple(np.concatenate([f[n] for f in found]) if found else np.zeros(0, np.int64 if n < 2 else np.float64) for n in (0, 1, 2))


def firsts(t: pa.Table, k: int) -> np.ndarray:
    """Places of the records, by id, without those that have ``k`` equal ones before them."""
    names = [c for c in t.column_names if c not in ("record_id", "_block")]
    order = pc.sort_indices(t, [("record_id", "ascending")]).to_numpy()
    held: dict[tuple, int] = {}
    keep = []
    columns = [t.column(c).combine_chunks() for c in names]
    codes = []
    for c in columns:
        if pa.types.is_list(c.type) or pa.types.is_large_list(c.type):
            seen: dict = {}
            codes.append([seen.setdefault(None if v is None else tuple(v), len(seen)) for v in c.to_pylist()])
        else:
            codes.append(pc.fill_null(c.dictionary_encode().indices, -1).to_pylist())
    rows = list(zip(*codes))
    for at in order:
        n = held.get(rows[at], 0)
        if n < k:
            held[rows[at]] = n + 1
            keep.append(at)
    return np.array(keep, np.int64)
