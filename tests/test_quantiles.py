"""Quantiles by radix histograms against sorted values."""

import numpy as np
import pytest

from xrdlake.operators import hot as H, quantiles as Q

WANTED = {"low": 0.0, "p05": 0.05, "mid": 0.5, "p95": 0.95, "high": 1.0}


def data():
    rng = np.random.default_rng(5)
    rows = [("wide", float(x), 1) for x in {float(s) * 10.0 ** int(e) for s, e in zip(rng.normal(size=500), rng.integers(-300, 300, 500), strict=True)}]
    rows += [("few", x, w) for x, w in ((-0.5, 3), (0.0, 1), (1.5, 40), (2.0, 2))]
    rows += [("hot", round(7 + i / 700, 4), int(rng.integers(1, 9))) for i in range(2500)]
    rows += [("one", 4.25, 9), ("null", None, 2), (None, 1.0, 1), ("none", 1.0, 0)]
    return rows


def plain(rows):
    held = {}
    for k, v, w in rows:
        if k is not None and v is not None and w:
            held.setdefault(k, []).extend([v] * w)
    return {k: {n: float(np.quantile(np.sort(v), q)) for n, q in WANTED.items()} for k, v in held.items()}


@pytest.mark.parametrize("buffered, hot", [(0, 700), (1000, 100_000), (100_000, 100_000)])
def test_percentiles(spark, monkeypatch, buffered, hot):
    rounds = []
    step = Q.narrowed
    monkeypatch.setattr(Q, "narrowed", lambda *a: rounds.append(1) or step(*a))
    monkeypatch.setattr(Q, "BUFFERED", buffered)  # 0: all keys by histograms
    monkeypatch.setattr(H, "HOT_ROWS", hot)
    got = {r.k: r.asDict() for r in Q.percentiles(spark.createDataFrame(data(), "k string, v double, w long"), ["k"], "v", "w", WANTED).collect()}
    want = plain(data())
    assert got.keys() == want.keys()
    for k, qs in want.items():
        for n, v in qs.items():
            assert got[k][n] == pytest.approx(v, rel=1e-12, abs=1e-300)
    assert len(rounds) <= 7 if buffered < 1000 else len(rounds) <= 3


def test_order_of_bits(spark):
    values = [float("-inf"), -2.5, -5e-324, 0.0, 5e-324, 1.0, float("inf"), float("nan")]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(Q.ordered_bits("v").alias("b")).collect()]
    assert got == sorted(set(got))
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "v double").select(Q.ordered_bits("v").alias("b")).distinct()
    assert zeros.count() == 1


def test_empty(spark):
    assert Q.percentiles(spark.createDataFrame([], "k string, v double, w long"), ["k"], "v", "w", WANTED).count() == 0
