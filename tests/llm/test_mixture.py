"""Source mixing against plain water filling, prefix sums and numeric integration."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from xrdlake.llm import mixture

DOCS = "doc_id long, text string, source string, rank string, SIZE int, start string"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, s, "x", 1, "y") for d, t, s in rows], DOCS)


def plain_targets(sizes):
    """``sizes`` by source; excess is handed on until no target is above its bound."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = (full - sum(out.values())) / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in above}
        free -= above
    return out


def corpus(seed=3):
    r = random.Random(seed)
    rows = []
    for k, n in enumerate((200, 40, 3, 25, 1, 60, 9)):
        for _ in range(n):
            rows.append((len(rows), " ".join("w" for _ in range(r.choice((0, 1, 7, 50, 400)))), (None, "b", "B", "a", "é", "hot", "z")[k]))
    return rows + [(None, None, "a"), (None, "x y", "a"), (None, "x y", "a"), (5, "same row", "hot"), (5, "same row", "hot"), (6, " \n", None), (7, None, None)]


def test_targets_and_taken(spark):
    rows = corpus()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(size)
    mixed = mixture.mix(docs_of(spark, rows))
    got = mixture.by_document(mixture.stream(mixed)).collect()
    assert len(got) == len(rows)
    again = mixture.by_document(mixture.stream(mixture.mix(docs_of(spark, rows[::-1]).repartition(5)))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert all(0 <= x["taken"] <= 2 * x["size"] for x in got)
    sums = {(x["source"], x["source_size"], x["target"]): x["t"] for x in mixed.select(
        "source", "source_size", "target", F.expr("aggregate(passes.words, 0L, (a, x) -> a + x)").alias("w")).groupBy("source", "source_size", "target").agg(F.sum("w").alias("t")).collect()}
    assert {s for s, _, _ in sums} == set(size)
    for (s, n, target), taken in sums.items():
        assert n == size[s] and target == pytest.approx(want[s]) and target - 1 < taken <= target
    assert sum(x["taken"] for x in got) == pytest.approx(1.5 * sum(size.values()), abs=len(size))


def test_positions_follow_the_schedules(spark):
    for schedule in mixture.SCHEDULES + (((0.0, 0.0), (0.3, 2.0), (1.0, 0.0)),):
        def weight(t, schedule=schedule):
            for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
                if t0 <= t <= t1:
                    return w0 + (w1 - w0) * (t - t0) / (t1 - t0)
        steps = 20_000
        grid = [weight((i + 0.5) / steps) for i in range(steps)]
        total, cumulative = sum(grid), []
        for g in grid:
            cumulative.append((cumulative[-1] if cumulative else 0.0) + g / total)
        shares = [0.0, 0.01, 0.2, 0.35, 0.5, 0.77, 0.999]
        got = spark.createDataFrame([(u,) for u in shares], "u double").select("u", mixture.time_of(F.col("u"), schedule).alias("t")).collect()
        for u, t in got:
            assert 0 <= t <= 1 and (cumulative[int(t * steps) - 1] if t * steps >= 1 else 0.0) == pytest.approx(u, abs=2e-4)


def test_stream_is_in_order(spark):
    rows = mixture.stream(mixture.mix(docs_of(spark, corpus()))).orderBy("place").collect()
    assert [x["place"] for x in rows] == list(range(len(rows)))
    at = [x["position"] for x in rows if x["position"] is not None]
    assert at == sorted(at) and all(x["position"] is None for x in rows[len(at):])
    for s in {x["rank"] for x in rows}:  # passes of a source: by order, one pass after the other
        own = [(x["pass"], x["order"]) for x in rows if x["rank"] == s and x["position"] is not None]
        assert own == sorted(own)
    hot = [x for x in rows if x["rank"] == 3 and x["position"] is not None]  # rising or steady or fading, not in one lump
    assert hot[0]["position"] < 0.2 and hot[-1]["position"] > 0.8


def test_order_is_by_hash(spark):
    rows = [(i, f"t{i} x", "s") for i in range(50)]
    got = mixture.mix(docs_of(spark, rows)).orderBy("start").collect()
    assert [x["doc_id"] for x in got] == sorted(range(50), key=lambda i: hashlib.md5(f"{i}:t{i} x".encode()).hexdigest())


def test_buckets_copies_and_empty_tables(spark, monkeypatch):
    rows = corpus() + [(77, "copied row of five words", "hot")] * 500
    want = sorted(map(str, mixture.by_document(mixture.stream(mixture.mix(docs_of(spark, rows)))).collect()))
    monkeypatch.setattr(mixture, "BUCKET_ROWS", 20)
    monkeypatch.setattr(mixture, "COPIES", 30)
    assert sorted(map(str, mixture.by_document(mixture.stream(mixture.mix(docs_of(spark, rows)))).collect())) == want
    for rows in ([], [(1, None, None), (2, "", "a")]):
        out = mixture.by_document(mixture.stream(mixture.mix(docs_of(spark, rows)))).collect()
        assert [(x["taken"], x["target"]) for x in out] == [(0, 0.0)] * len(rows)
