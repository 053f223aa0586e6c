"""Token counting and packing of documents into fixed-length sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrdlake.llm.common import NO_ID, ids_back, ids_of, pick
from xrdlake.session import written

CAPACITY = 2048
SHARD_PIECES = 40_000
CACHE_WORDS = 700_000
SEPARATOR = "<|endoftext|>"
MARKS = b".,;:!?#*$%&|<>()[]{}=/\\_@+~`^\"-"

_STATE: dict = {}


class Words:
    """Token ids of single words, kept between tasks of one worker up to ``CACHE_WORDS``.

    The tokenizer lower-cases, drops white space and never merges across it, so a text is its words one by one. Texts
    that hold a special token's opening go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.end = self.tokenizer.token_to_id(SEPARATOR)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # the last ids of pre-tokens
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def lines(self, words: list[bytes], between: str, size: int = 500):
        """Shares of the words with their encoding as one line."""
        for a in range(0, len(words), 40 * size):
            parts = [words[b:b + size] for b in range(a, min(a + 40 * size, len(words)), size)]
            yield from zip(parts, self.tokenizer.encode_batch_fast([between.join(w.decode() for w in p) for p in parts], add_special_tokens=False), strict=True)

    def learn(self, words: set[bytes]) -> None:
        known = self.known
        if len(known) + len(words) > CACHE_WORDS:
            known.clear()
        # punctuation after a letter is a token run of its own
        cores, plain, rest, shared = {}, [], [], set()
        for w in words:
            if w in known:
                continue
            core, text = w.rstrip(MARKS), w.decode()
            if len(core) < len(w) and text[:len(core) - len(w)][-1:].isalpha():
                cores[w] = core
                if core not in shared and core not in known:
                    shared.add(core)
                    (plain if text[:len(core) - len(w)].isalpha() else rest).append(core)
                if w[len(core):] not in known and w[len(core):] not in shared:
                    shared.add(w[len(core):])
                    rest.append(w[len(core):])
            elif w not in shared:
                shared.add(w)
                (plain if text.isalpha() else rest).append(w)
        # letters only are one pre-token, whose last id is marked in the vocabulary
        for part, e in self.lines(plain, " "):
            ids = np.array(e.ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(part):
                rest += part
                continue
            for w, x, y in zip(part, np.append(0, cut[:-1]).tolist(), cut.tolist(), strict=True):
                known[w] = ids[x:y].tobytes()
        for part, e in self.lines(rest, SEPARATOR):
            ids = np.array(e.ids, "<u4")
            cut = np.flatnonzero(ids == self.end)
            for w, x, y in zip(part, np.append(0, cut + 1).tolist(), np.append(cut, len(ids)).tolist(), strict=True):
                known[w] = ids[x:y].tobytes()
        for w, core in cores.items():
            known[w] = known[core] + known[w[len(core):]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list = [None] * len(texts)
        split = []
        for i, t in enumerate(texts):
            if "<|" in t:
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                split.append((i, t.encode().lower().split()))
        known, again = self.known, []
        for i, words in split:
            try:
                out[i] = b"".join(map(known.__getitem__, words))
            except KeyError:  # a word not met before
                again.append((i, words))
        if again:
            self.learn(set().union(*(w for _, w in again)).difference(known))
        for i, words in again:
            if not known.keys() >= set(words):  # the cache was emptied meanwhile
                self.learn(set(words).difference(known))
            out[i] = b"".join(map(known.__getitem__, words))
        return out


def words_for(path: str) -> Words:
    if path not in _STATE:
        _STATE[path] = Words(path)
    return _STATE[path]


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's ids followed by id 0, cut at ``capacity``."""
    rows = pick(docs, doc_id="long", text="string").fillna("", ["text"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def count(batches):
        words, end = words_for(tokenizer_path), b"\0\0\0\0"
        for b in batches:
            ids, texts = ids_of(b.column(0)), b.column(1)
            for a in range(0, len(ids), 500):
                cols: list[list] = [[], [], [], [], []]
                for d, raw in zip(ids[a:a + 500].tolist(), words.encode(texts.slice(a, 500).to_pylist()), strict=True):
                    raw += end
                    for k, s in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[s:s + 4 * capacity]
                        for c, v in zip(cols, (d, k, s // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([ids_back(np.array(cols[0], np.int64)), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=names)

    return rows.mapInArrow(count, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """A bin for each length, in the given order.

    ``count[g]`` is the number of open bins with gap ``g``. A piece goes to the gap (or a new bin) for which the sum of
    the squared counts over gaps 1 to ``capacity - 1`` is least afterwards; of equals, the smallest gap.
    """
    count = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, made = np.empty(len(lengths), np.int64), 0
    worst = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        # from gap g to gap g - size: 2 * (count[g - size] - count[g]) + 2; a closed bin (gap 0) counts nothing
        change = 2 * (count[:capacity - size + 1] - count[size:]) + 2
        change[0] = 1 - 2 * count[size]
        change[count[size:] == 0] = worst
        if size == capacity:
            gap = capacity
        else:
            change[-1] = 2 * count[capacity - size] + 1  # a new bin
            gap = int(change.argmin()) + size
        if gap == capacity:
            own, made = made, made + 1
        else:
            count[gap] -= 1
            own = bins[gap].pop()
        out[i] = own
        if gap > size:
            count[gap - size] += 1
            bins[gap - size].append(own)
    return out


def place(pdf: pd.DataFrame, shard: int, capacity: int, seal: float) -> pd.DataFrame:
    """The pieces of one shard with bin and offset; bins filled below ``seal`` are open (``sequence_id`` -1)."""
    pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable", ignore_index=True)
    own = sum_of_squares(pdf["length"].to_numpy(), capacity)
    fill = np.bincount(own, pdf["length"].to_numpy())
    order = np.argsort(own, kind="stable")
    size = pdf["length"].to_numpy()[order]
    before = np.cumsum(size) - size
    first = np.flatnonzero(np.diff(own[order], prepend=-1))
    offset = np.empty(len(pdf), np.int64)
    offset[order] = before - np.repeat(before[first], np.diff(np.append(first, len(pdf))))
    done = fill[own] >= seal * capacity
    pdf["sequence_id"] = np.where(done, shard * np.int64(1 << 31) + own, -1)  # a shard of any size has fewer bins than that
    pdf["offset"] = np.where(done, offset, -1)
    return pdf


def placer(first: int, capacity: int, seal: float):
    def fill(key, pdf):
        return place(pdf.drop(columns="shard"), first + int(key[0]), capacity, seal)

    return fill


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: every document's pieces in as few sequences as it can.

    Pieces are dealt at random to shards of about ``SHARD_PIECES``; a shard packs its pieces, longest first, by the sum-of-squares rule.
    Bins that a shard leaves less than ``seal`` full are opened again and packed together with those of other shards,
    in shards of the same size, until one shard holds them all; its bins stay as they are. Texts are read once; only
    lengths are shuffled. Null and empty texts are one piece of one token; repeated rows are packed once each; an
    empty table gives no rows; other columns are not read.
    """
    # pandas has no missing integers: a missing id goes through the shards as NO_ID; rows are numbered, so that equal ones are dealt like any others
    rest = written(pieces_of(docs, tokenizer_path, capacity).withColumns({"doc_id": F.coalesce("doc_id", F.lit(int(NO_ID))), "row": F.monotonically_increasing_id()}), "pieces")
    done, base, seal, left = None, 0, 0.995, rest.count()
    while True:
        shards = max(1, round(left / SHARD_PIECES))
        last = shards == 1
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(base)), F.lit(shards)))
        placed = dealt.groupBy("shard").applyInPandas(placer(base, capacity, 0.0 if last else seal), PLACED)
        if last:
            done = placed if done is None else done.unionByName(placed)
            break
        placed = written(placed, "packed")
        closed = placed.where("sequence_id >= 0")
        done = closed if done is None else done.unionByName(closed)
        rest = placed.where("sequence_id < 0").drop("sequence_id", "offset")
        base, before, left = base + shards, left, rest.count()
        if not left:
            break
        if left > 0.5 * before:  # hardly any bin is full enough: settle for less, so that the rounds end
            seal *= 0.9
    return done.drop("row").withColumn("doc_id", F.nullif("doc_id", F.lit(int(NO_ID))))
