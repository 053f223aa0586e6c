"""Periodic runs of words in texts: maximal stretches that repeat themselves with some period.

Each word of a run stands in it twice at least. So a word that occurs once in its segment is in no run there and splits the segment; words of the parts are
counted anew, and so on until nothing splits any more. Prose falls to pieces within a few rounds; lags are scanned on what is left. All documents of
a batch are split and scanned together. Short lags are scanned at every position. A run of a longer period q goes on for q
positions of lag q, so it covers one of the positions that are multiples of q - 7 with its seven followers: hashes of eight words are compared
there, and hits are extended to both sides word by word.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrdlake.llm.common import NO_ID, ids_back, ids_of, mix, pick, ragged

LEAST = 12
#: Words hashed together at the anchors of long lags; lags below twice that are scanned whole.
GRAM = 8
CHUNK_WORDS = 400_000


def segments(words: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the segments in which every word occurs twice or more, or of such that split no further at a useful rate.

    ``words`` are word numbers, ``doc`` the document of each, in order.
    """
    pos, own, starts, sizes = np.arange(len(words)), doc, [], []
    width = int(words.max(initial=0)) + 1
    while len(pos):
        code = pd.factorize(own * width + words[pos])[0]
        often = np.bincount(code)[code] > 1
        whole = np.bincount(own[~often], minlength=int(own[-1]) + 1)[own] == 0
        few = 256 * np.count_nonzero(~often) < len(pos)  # the scan is exact without any split
        done = whole | few
        for keep, settled in ((done, True), (often & ~done, False)):
            p = pos[keep]
            first = np.flatnonzero((np.diff(p, prepend=-2) != 1) | (np.diff(own[keep], prepend=-1) != 0))
            length = np.diff(np.append(first, len(p)))
            long = length >= least
            if settled:
                starts.append(p[first[long]])
                sizes.append(length[long])
            else:
                first, length = first[long], length[long]
                pos, own = p[ragged(first, length)], np.repeat(np.arange(len(first)), length)
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start, size = np.concatenate(starts), np.concatenate(sizes)
    order = np.argsort(start)
    return start[order], size[order]


def agree(x: np.ndarray, a: int, b: int, step: int) -> int:
    """How many elements from ``a`` and ``b`` on, ahead (``step`` 1) or back (-1), are equal; x ends in marks that equal nothing."""
    n, size = 0, 64
    while True:
        lo, hi = (a + n, b + n) if step > 0 else (a - n - size + 1, b - n - size + 1)
        cut = max(0, -lo)
        one, two = x[lo + cut:lo + size], x[hi + cut:hi + size]
        one = one[:len(two)]
        differ = one != two
        if step < 0:
            differ = differ[::-1]
        k = int(differ.argmax()) if len(differ) else 0
        if len(differ) and differ[k]:
            return n + k
        n += len(differ)
        size *= 2


def short_lags(x: np.ndarray, least: int) -> list[np.ndarray]:
    """``start, end, period`` of the stretches of every lag below ``2 * GRAM``."""
    out = []
    for q in range(1, 2 * GRAM):
        same = np.concatenate(([False], x[:-q] == x[q:], [False])) if len(x) > q else np.zeros(2, bool)
        edges = np.flatnonzero(same[1:] != same[:-1])
        a, z = edges[::2], edges[1::2]
        long = z - a >= max(least - q, q)
        out.append(np.stack([a[long], z[long] + q, np.full(int(long.sum()), q)], axis=1))
    return out


def long_lags(x: np.ndarray, start: np.ndarray, size: np.ndarray, known: list[np.ndarray]) -> list[np.ndarray]:
    """The same of the lags from ``2 * GRAM`` on, inside the segments given; ``known`` has the runs of smaller periods."""
    out = []
    gram = np.zeros(max(0, len(x) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        gram = mix(gram + x[k:k + len(gram)].astype(np.uint64))
    cover = np.full(len(x), -1)  # a long run over each position: hits inside it at multiples of its period tell nothing new
    runs = np.concatenate(known)
    low = 2 * GRAM
    top = int(size.max(initial=0)) // 2
    while low <= top:
        for r in np.flatnonzero(runs[:, 1] - runs[:, 0] >= 3 * runs[:, 2]) if len(runs) else ():
            cover[runs[r, 0]:runs[r, 1]] = r
        fits = np.flatnonzero(size // 2 >= low)
        lags = np.minimum(size[fits] // 2, 2 * low - 1) - low + 1
        seg, q = np.repeat(fits, lags), ragged(np.full(len(fits), low), lags)
        anchors = (size[seg] - q - GRAM) // (q - GRAM + 1) + 1
        for a, z in blocks(anchors):
            one, lag = np.repeat(seg[a:z], anchors[a:z]), np.repeat(q[a:z], anchors[a:z])
            t = start[one] + ragged(np.zeros(z - a, np.int64), anchors[a:z]) * (lag - GRAM + 1)
            hit = np.flatnonzero(gram[t] == gram[t + lag])
            t, lag = t[hit], lag[hit]
            if len(runs) and len(t):
                by = runs[cover[t]]
                told = (cover[t] >= 0) & (t + lag + GRAM <= by[:, 1]) & (lag % by[:, 2] == 0)
                t, lag = t[~told], lag[~told]
            found, last, until = [], -1, -1
            for i, d in zip(t.tolist(), lag.tolist(), strict=True):
                if d == last and i < until:
                    continue
                ahead = agree(x, i, i + d, 1)
                begin = i - agree(x, i - 1, i + d - 1, -1)
                last, until = d, i + max(ahead, 1)
                if i + ahead - begin >= d:
                    found.append((begin, i + ahead + d, d))
            if found:
                out.append(np.array(found, np.int64))
        runs = np.concatenate([runs, *out]) if out else runs
        low *= 2
    return out


def blocks(sizes: np.ndarray, limit: int = 4_000_000):
    """Neighbours ``a, z`` whose sizes sum up to ``limit`` or so."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, z
        a = z


def runs_of(words: np.ndarray, doc: np.ndarray, least: int = LEAST) -> np.ndarray:
    """``start, end, period`` of every run, positions in ``words``; runs do not cross documents. By start, then period."""
    start, size = segments(words, doc, least)
    if not len(start):
        return np.empty((0, 3), np.int64)
    # the segments end to end, a mark of its own before each and after the last
    place = np.cumsum(size + 1) - size
    x = -1 - np.arange(int(place[-1] + size[-1]) + 1)
    inner = ragged(place, size)
    x[inner] = words[ragged(start, size)]
    back = np.zeros(len(x), np.int64)
    back[inner] = ragged(start, size)
    found = short_lags(x, least)
    found = np.concatenate([*found, *long_lags(x, place, size, found)])
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.ones(len(found), bool)  # of a stretch with several periods the smallest counts
    fresh[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[fresh]
    length = found[:, 1] - found[:, 0]
    begin = back[found[:, 0]]
    out = np.stack([begin, begin + length, found[:, 2]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where a trial makes a document periodic, and its period: one document of ten, by crc32 of its id; none without an id."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


NAMES = ["doc_id", "runs", "kept"]


def collapsed(ids: list, texts: list[str | None], least: int, trial: bool):
    """``runs`` as ``(start, length, period)`` and the text that is kept, for a bounded number of documents."""
    split = [(t or "").encode().split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    known: dict[bytes, int] = {}
    flat = np.fromiter((known.setdefault(w, len(known)) for ws in split for w in ws), np.int64, int(sizes.sum()))
    first = np.cumsum(sizes) - sizes
    shown: dict[int, np.ndarray] = {}
    for k, d in enumerate(ids if trial else ()):
        plan = planted(d, int(sizes[k]))
        if plan:
            a, p = plan
            i = np.arange(sizes[k])
            i[a:] = a + (i[a:] - a) % p
            shown[k] = i
            own = slice(first[k], first[k] + sizes[k])
            flat[own] = flat[own][i]
    runs = runs_of(flat, np.repeat(np.arange(len(ids)), sizes), least)
    cuts = np.searchsorted(runs[:, 0], np.append(first, len(flat)))
    for k, words in enumerate(split):
        own = runs[cuts[k]:cuts[k + 1]] - np.array([first[k], first[k], 0])
        if k in shown:
            words = [words[j] for j in shown[k].tolist()]
        if len(own):
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, own[:, 0] + own[:, 2], 1)
            np.add.at(gone, own[:, 1], -1)
            words = [words[j] for j in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
        yield [(int(a), int(z - a), int(q)) for a, z, q in own], b" ".join(words)


def chunks(sizes: list[int], limit: int = 6 * CHUNK_WORDS):
    a, held = 0, 0
    for z, s in enumerate(sizes):
        if z > a and held + s > limit:
            yield a, z
            a, held = z, 0
        held += s
    if a < len(sizes):
        yield a, len(sizes)


def find_runs(docs: DataFrame, least: int = LEAST, trial: bool = False) -> DataFrame:
    """``doc_id, runs, kept`` of every row: its periodic runs and the text without repeats, words joined by one space.

    Words are runs of other than ASCII white space, numbered from 0. A run is a stretch of words with a smallest period (words a period
    apart are identical), as long as two periods and ``least`` words, that no neighbouring word extends with this
    period. ``runs`` has ``start``, ``length``, ``period`` by start and period; ``kept`` drops words that any run contains after its
    first period. With ``trial``, one document of ten is made periodic from some word on before (see ``planted``).

    Null and empty texts have no runs and keep nothing; repeated rows give repeated results; an empty table gives no rows; other columns are
    not read.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def look(batches):
        for b in batches:
            ids, col = ids_of(b.column(0)), b.column(1)
            given = [None if d == NO_ID else d for d in ids.tolist()]
            bytes_ = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
            for a, z in chunks(bytes_):
                done = list(collapsed(given[a:z], col.slice(a, z - a).to_pylist(), least, trial))
                runs = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r, _ in done]
                yield pa.RecordBatch.from_arrays([ids_back(ids[a:z]), pa.array(runs, kind), pa.array([k for _, k in done], pa.binary()).cast(pa.string())], names=NAMES)

    return pick(docs, doc_id="long", text="string").mapInArrow(look, "doc_id long, runs array<struct<start: long, length: long, period: long>>, kept string")


def digests(found: DataFrame) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` from the rows of ``find_runs``."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("a"), (-r["period"]).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("top.a")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.q")).alias("period"),
        F.expr("(1000 * top.length) div (-top.q)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
