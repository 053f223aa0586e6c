"""Removal of passages that repeat from an earlier document, by longest-previous-factor arrays.

A start position is a repeat when the longest match of its suffix that begins in a document with a smaller id
(its longest previous factor) is at least ``min_bytes`` long. A suffix array of the whole corpus fits no task, so it is
built in parts that need no word from each other: every ``min_bytes`` window is led by the least of its 16-byte
strings (by a mixed hash, the leftmost among equals), and equal windows have equal leaders. Consecutive windows with the
same leader travel as one segment to the part of that leader. In a part, suffixes are put in suffix order, neighbours get
their common prefix, and previous and next smaller document positions in that order give each suffix its earlier match.

Segments are packed (compressed, many in a row), so that about two input sizes are shuffled; texts follow once, packed
too, to the place where their spans are applied. Equal segments need one representative each in a part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrdlake.llm.common import NO_ID, ids_back, ids_of, mix, pick, ragged, squeeze, steps, unsqueeze

SEED_BYTES = 16
CHUNK_BYTES = 6_000_000
STEP_BYTES = 1_000_000
PART_BYTES = 8_000_000
MOST_TASKS = 100_000
ODD = np.uint64(0x9E3779B97F4A7C15)
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * ODD)


def window_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of every ``size``-byte window, by doubling."""
    width, h, power, at, out = 1, BYTE_HASH[buf], ODD, 0, None
    n = len(buf) - size + 1
    while True:
        if size & width:  # this width is one of the blocks that make up a window, the small ones first
            block = h[at:at + n]
            out = block.copy() if out is None else out + block * np.uint64(pow(int(ODD), at, 2**64))
            at += width
        if width * 2 > size:
            return mix(out)
        h = h[:-width] + h[width:] * power
        width *= 2
        power = np.uint64(int(power) ** 2 % 2**64)


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """The same hash for every row of a byte matrix."""
    h, power = np.zeros(len(rows), np.uint64), 1
    for i in range(rows.shape[1]):
        h += BYTE_HASH[rows[:, i]] * np.uint64(power)
        power = power * int(ODD) % 2**64
    return mix(h)


def segments(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int):
    """Runs of windows with one leader, of documents laid end to end in ``buf``.

    Returns the leaders' hashes, the documents' numbers and, within ``buf``, first window, end and leader of each run.
    """
    none = np.empty(0, np.int64)
    if len(buf) < size:
        return none.astype(np.uint64), none, none, none, none
    seeds = window_hashes(buf, SEED_BYTES)
    order = ((seeds >> np.uint64(32)) << np.uint64(32)) | np.arange(len(seeds), dtype=np.uint64)
    reach, width = 1, size - SEED_BYTES + 1
    least = order
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[:len(least) - (width - reach)], least[width - reach:])
    leader = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    long = lengths >= size
    doc = np.flatnonzero(long)
    windows = lengths[long] - size + 1
    at = ragged(starts[long], windows)
    owner = np.repeat(doc, windows)
    if not len(at):
        return none.astype(np.uint64), none, none, none, none
    lead = leader[at]
    new = np.flatnonzero(np.concatenate(([True], (lead[1:] != lead[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.concatenate((new[1:], [len(at)])) - 1
    return seeds[lead[new]], owner[new], at[new], at[last] + size, lead[new]


def pack_segments(docs: list[tuple[int, int, bytes]], size: int, parts: int):
    """One compressed row per part from ``(doc_id, key, text)`` rows: segments by document and place."""
    lengths = np.array([len(t) for _, _, t in docs], np.int64)
    starts = np.cumsum(lengths) - lengths
    buf = np.frombuffer(b"".join(t for _, _, t in docs), np.uint8)
    found, a = [], 0
    while a < len(docs):  # a few documents at a time, for the memory of the hashes
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + STEP_BYTES)))
        base, end = starts[a], starts[b - 1] + lengths[b - 1]
        seed, owner, first, last, lead = segments(buf[base:end], starts[a:b] - base, lengths[a:b], size)
        found.append(((mix(seed) % np.uint64(parts)).astype(np.int64), owner + a, first + base, (last - first).astype(np.uint8), (lead - first).astype(np.uint8)))
        a = b
    part, owner, first, length, lead = (np.concatenate(c) for c in zip(*found, strict=True))
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    ids, keys = np.array([d for d, _, _ in docs], np.int64), np.array([k for _, k, _ in docs], np.int64)
    edge = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, b in zip(edge, np.append(edge[1:], len(order)), strict=True):
        own = order[a:b]
        used, number = np.unique(owner[own], return_inverse=True)
        yield int(part[own[0]]), squeeze(
            buf[ragged(first[own], length[own].astype(np.int64))], length[own], lead[own],
            steps(number.astype(np.uint32)), steps(first[own].astype(np.uint32)), steps(ids[used]), keys[used], steps(starts[used]))


def earlier_match(doc: np.ndarray, lcp: np.ndarray, size: int) -> np.ndarray:
    """Whether each suffix, in suffix order, has a previous factor of ``size`` bytes.

    ``lcp[i]`` is the common prefix of suffixes ``i - 1`` and ``i``. The previous and the next position with a smaller
    document are found by jumping along already known links; the common prefix on the way is the match length, and the
    longest previous factor is the longer of the two.
    """
    n = len(doc)
    lpf = np.zeros(n, np.int64)
    for step in (-1, 1):
        to = np.arange(n) + step
        run = lcp.copy() if step < 0 else np.append(lcp[1:], 0)
        while True:
            open_ = np.flatnonzero((to >= 0) & (to < n) & (run >= size))
            open_ = open_[doc[to[open_]] >= doc[open_]]
            if not len(open_):
                break
            via = to[open_]
            run[open_] = np.minimum(run[open_], run[via])
            to[open_] = to[via]
        ok = (to >= 0) & (to < n)
        ok[ok] = doc[to[ok]] < doc[ok]
        lpf = np.maximum(lpf, np.where(ok, run, 0))
    return lpf >= size


def repeats(data: np.ndarray, at: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Whether the windows starting ``at`` also start in a smaller document, among the given ones."""
    out = np.zeros(len(at), bool)
    if not len(at):
        return out
    words = -(-size // 8)
    text = np.zeros((len(at), words * 8), np.uint8)
    for i in range(size):
        text[:, i] = data[at + i]
    keys = text.view(">u8").astype(np.uint64)
    order = np.lexsort((doc, *keys.T[::-1]))
    text = text[order]
    same = np.cumprod(text[1:, :size] == text[:-1, :size], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    out[order] = earlier_match(doc[order], np.concatenate(([0], same)), size)
    return out


def find_in_part(blobs: list[bytes], size: int):
    """``(doc_id, key, start, end)`` arrays of the repeated stretches of one part."""
    kinds = (np.uint8, np.uint8, np.uint8, np.uint32, np.uint32, np.int64, np.int64, np.int64)
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    for blob in blobs:
        data, length, lead, number, first, ids, keys, starts = unsqueeze(blob, *kinds)
        number = np.cumsum(number, dtype=np.uint32)
        place = np.cumsum(first, dtype=np.uint32).astype(np.int64) - np.cumsum(starts)[number]
        for c, v in zip(cols, (data, length, lead, place, np.cumsum(ids)[number], keys[number]), strict=True):
            c.append(v)
    data, length, lead, start, doc, key = (np.concatenate(c) for c in cols)
    length, lead = length.astype(np.int64), lead.astype(np.int64)
    table = np.zeros((len(length), 2 * size - SEED_BYTES), np.uint8)
    table[np.arange(table.shape[1]) < length[:, None]] = data
    del data, cols
    seed = row_hashes(table[np.arange(len(table))[:, None], lead[:, None] + np.arange(SEED_BYTES)])
    # equal segments: all but those of the smallest document repeat as a whole; content decides, the hash only sorts
    whole = row_hashes(table) + length.astype(np.uint64)
    order = np.lexsort((doc, whole, seed))
    same = (length[order][1:] == length[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    near = np.flatnonzero(same)
    for a in range(0, len(near), 100_000):
        left = near[a:a + 100_000]
        same[left] = (table[order[left]] == table[order[left + 1]]).all(axis=1)
    group = np.cumsum(np.concatenate(([0], ~same)))
    lead_of = np.flatnonzero(np.concatenate(([True], ~same)))
    rep = order[lead_of][group]  # of each segment in order, the one of the smallest document
    later = doc[order] > doc[rep]
    out = [(doc[order][later], key[order][later], start[order][later], (start + length)[order][later])]
    reps = order[lead_of]
    alone = np.ones(len(reps), bool)
    s = seed[reps]
    alone[1:] &= s[1:] != s[:-1]
    alone[:-1] &= s[:-1] != s[1:]
    reps = reps[~alone]
    if len(reps):
        data = table[reps][np.arange(table.shape[1]) < length[reps][:, None]]
        first = np.zeros(len(doc), np.int64)
        first[reps] = np.cumsum(length[reps]) - length[reps]
        windows = length[reps] - size + 1
        at, owner = ragged(first[reps], windows), np.repeat(reps, windows)
        h = window_hashes(data, size)[at]
        by = np.argsort(h, kind="stable")
        twin = np.zeros(len(h), bool)
        eq = h[by][1:] == h[by][:-1]
        twin[by[1:][eq]] = True
        twin[by[:-1][eq]] = True
        hit = np.zeros(len(at), bool)
        hit[twin] = repeats(data, at[twin], doc[owner[twin]], size)
        at, owner = at[hit], owner[hit]
        if len(at):
            new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1))))
            end = np.append(new[1:], len(at)) - 1
            who = owner[new]
            lo, hi = at[new] - first[who], at[end] - first[who] + size
            # what holds for a representative holds for the equal segments of the same document
            place = np.empty(len(doc), np.int64)
            place[order] = rep
            mates = np.flatnonzero((place != np.arange(len(doc))) & (doc == doc[place]))
            out.append((doc[who], key[who], start[who] + lo, start[who] + hi))
            if len(mates):
                by_rep = np.argsort(who, kind="stable")
                a, b = np.searchsorted(who[by_rep], place[mates]), np.searchsorted(who[by_rep], place[mates], "right")
                take, mate = by_rep[ragged(a, b - a)], np.repeat(mates, b - a)
                out.append((doc[mate], key[mate], start[mate] + lo[take], start[mate] + hi[take]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def doc_part(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def cut(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text without the given stretches, and the stretches merged."""
    change = np.zeros(len(text) + 1, np.int32)
    np.add.at(change, lo, 1)
    np.add.at(change, hi, -1)
    gone = np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def remove_repeats(docs: DataFrame, min_bytes: int = 50) -> DataFrame:
    """``doc_id, n_bytes, kept (binary), spans`` of every row, without what repeats from documents with smaller ids.

    Matching is on UTF-8 bytes within a document; the bytes left may split a character. Null and short texts stay as they
    are; rows without an id come after all others and keep what only they share. Rows of one id never repeat each other.
    Repeated rows give repeated results. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
    """
    if not SEED_BYTES <= min_bytes <= 128:
        raise ValueError("min_bytes must be from 16 to 128")
    rows = pick(docs, doc_id="long", text="string").fillna("", ["text"])
    total, ids, kinds = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1)), F.count_distinct(F.coalesce("doc_id", F.lit(int(NO_ID))))).first()
    # rows are told apart by their ids; only where ids repeat, by their texts as well
    row_key = F.lit(0).cast("long") if ids == kinds else F.xxhash64("text")
    rows = rows.select("doc_id", row_key.alias("row_key"), F.col("text").cast("binary").alias("raw"))
    parts = max(1, -(-(total or 0) // PART_BYTES))
    out_schema = "part long, kind int, blob binary"
    names = ["part", "kind", "blob"]

    def batch_of(rows_):
        part, kind, blob = zip(*rows_, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=names)

    def chunks(batches):
        held, size = [], 0
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                for row in zip(ids_of(part.column(0)).tolist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    held.append(row)
                    size += len(row[2])
                    if size >= CHUNK_BYTES:
                        yield held
                        held, size = [], 0
        if held:
            yield held

    def to_segments(batches):
        for held in chunks(batches):
            made = [(p, 0, blob) for p, blob in pack_segments(held, min_bytes, parts)]
            if made:
                yield batch_of(made)

    def match(table: pa.Table) -> pa.Table:
        doc, key, lo, hi = find_in_part(table.column("blob").to_pylist(), min_bytes)
        to = doc_part(doc, parts)
        order = np.lexsort((lo, doc, to))
        doc, key, lo, hi, to = doc[order], key[order], lo[order], hi[order], to[order]
        edge = np.flatnonzero(np.diff(to, prepend=-1))
        made = [(int(to[a]), 1, squeeze(steps(doc[a:b]), key[a:b], steps(lo[a:b].astype(np.uint32)), (hi - lo)[a:b].astype(np.uint32)))
                for a, b in zip(edge, np.append(edge[1:], len(to)), strict=True)]
        return pa.Table.from_batches([batch_of(made)] if made else [], schema=pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())]))

    def to_texts(batches):
        for held in chunks(batches):
            ids, keys = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.int64)
            to, made = doc_part(ids, parts), []
            for p in np.unique(to):
                own = np.flatnonzero(to == p)
                texts = [held[i][2] for i in own]
                made.append((int(p), 0, squeeze(ids[own], keys[own], np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8))))
            yield batch_of(made)

    def apply_spans(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        found = [unsqueeze(b, np.int64, np.int64, np.uint32, np.uint32) for k, b in zip(kinds, blobs, strict=True) if k == 1]
        found = [(np.cumsum(d), k, lo := np.cumsum(s, dtype=np.uint32).astype(np.int64), lo + n) for d, k, s, n in found]
        doc, key, lo, hi = (np.concatenate(c) for c in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 4
        order = np.lexsort((key, doc))
        doc, key, lo, hi = doc[order], key[order], lo[order], hi[order]
        edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))) if len(doc) else np.empty(0, np.int64)
        at = {(int(doc[a]), int(key[a])): (a, b) for a, b in zip(edge, np.append(edge[1:], len(doc)), strict=False)}
        ids_out, size_out, kept_out, span_out = [], [], [], []
        for k, blob in zip(kinds, blobs, strict=True):
            if k == 1:
                continue
            ids, keys, sizes, raw = unsqueeze(blob, np.int64, np.int64, np.int64, np.uint8)
            raw, begin = raw.tobytes(), 0
            for d, h, n in zip(ids.tolist(), keys.tolist(), sizes.tolist(), strict=True):
                text, begin = raw[begin:begin + n], begin + n
                if (d, h) in at:
                    a, b = at[d, h]
                    text, spans = cut(text, lo[a:b], hi[a:b])
                else:
                    spans = []
                ids_out.append(d)
                size_out.append(n)
                kept_out.append(text)
                span_out.append([{"start": x, "end": y} for x, y in spans])
        return pa.table({
            "doc_id": ids_back(np.array(ids_out, np.int64)), "n_bytes": pa.array(size_out, pa.int64()), "kept": pa.array(kept_out, pa.binary()),
            "spans": pa.array(span_out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    # as many tasks as parts, whatever the session's default: what a task reads does not grow with the input
    tasks = max(1, min(parts, MOST_TASKS))
    found = rows.mapInArrow(to_segments, out_schema).repartition(tasks, "part").groupBy("part").applyInArrow(match, out_schema)
    texts = rows.mapInArrow(to_texts, out_schema)
    return texts.unionByName(found).repartition(tasks, "part").groupBy("part").applyInArrow(
        apply_spans, "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>")
