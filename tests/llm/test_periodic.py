"""Periodic runs against a scan of every lag, on random, planted and awkward texts."""

import binascii
import hashlib
import random
import re

import numpy as np

from xrdlake.llm import periodic, queries

DOCS = "doc_id long, text string, runs string, KEPT int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words, least=12):
    n, seen, out = len(words), set(), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= max(least - q, q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(rows, trial=True):
    out = []
    for d, t in rows:
        words = WORD.findall(t or "")
        n, h = len(words), binascii.crc32(str(d).encode()) if d is not None else 1
        if trial and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def texts(seed):
    r = random.Random(seed)
    word = lambda k: f"w{r.randrange(k)}"
    for _ in range(120):
        ws = [word(r.choice((2, 3, 30, 400))) for _ in range(r.randint(0, 250))]
        for _ in range(r.randint(0, 3)):
            unit = [word(r.choice((2, 5, 1000))) for _ in range(r.choice((1, 2, 3, 5, 6, 7, 15, 16, 17, 31, 40, 90)))]
            m = int(len(unit) * r.uniform(1.5, 5))
            at = r.randint(0, len(ws))
            ws[at:at] = (unit * 6)[:m]
        yield r.choice((" ", "\n", " \t\x0b")).join(ws)
    fib, b = ["a"], ["b"]
    for _ in range(12):
        fib, b = fib + b, fib
    yield " ".join(fib)  # runs in runs, of many periods
    yield "same " * 3000
    yield "a b c d e f g h " * 120
    yield "   " * 20 + "\x1c\x1d " * 30  # no ASCII white space, so words


def test_against_every_lag(spark):
    rows = list(enumerate(texts(1)))
    rows += [(None, "x y " * 30), (None, None), (900, None), (901, ""), (902, " \n"), (3, rows[3][1]), (3, rows[3][1]), (903, "word " * 11), (904, "word " * 12)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], DOCS)
    want = plain(rows)
    assert sum(x[1] for x in want) > 200
    assert result(periodic.digests(periodic.find_runs(df, trial=True))) == want
    assert result(periodic.digests(periodic.find_runs(df))) == plain(rows, trial=False)
    assert periodic.find_runs(df.limit(0)).count() == 0


def test_long_periods_without_splits():
    r = np.random.default_rng(4)
    for p in (15, 16, 23, 24, 100, 750):  # every word occurs often, so only the lag scan decides
        words = r.integers(0, 3, 5000)
        at = int(r.integers(0, 3000))
        words[at:at + 2 * p + 5] = np.resize(words[at:at + p], 2 * p + 5)
        got = [tuple(x) for x in periodic.runs_of(words, np.zeros(len(words), np.int64)).tolist()]
        assert [(a, z - a, q) for a, z, q in got] == plain_runs(words.tolist())


def test_splitting_keeps_runs_and_drops_prose():
    r = random.Random(2)
    prose = [f"p{r.randrange(3000)}" for _ in range(4000)]
    words = prose[:2000] + [f"q{i % 40}" for i in range(130)] + prose[2000:]
    known = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    start, size = periodic.segments(ids, np.zeros(len(ids), np.int64))
    assert any(a <= 2000 and a + n >= 2130 for a, n in zip(start, size, strict=True)) and size.sum() < 200


def test_real_table(spark, sf_dir):
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(d, t) for d, t in rows if len(t or "") < 30_000]
    got = {x[0]: x for x in result(queries.op12(spark, sf_dir))}
    for row in plain(rows):
        assert got[row[0]] == row


def test_one_large_text(spark):
    text = " ".join(f"u{i % 7}" for i in range(200_000)) + " end " + " ".join(f"v{i * i % 977}" for i in range(50_000))
    row = periodic.find_runs(spark.createDataFrame([(1, text, "", 0)], DOCS)).collect()[0]
    assert (0, 200_000, 7) in [tuple(x) for x in row["runs"]]
