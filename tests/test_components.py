"""Components by contraction against a plain union-find."""

import numpy as np
import pytest

from xrdlake.operators import geochem as X, hot as H


def plain(nodes, edges):
    up = {n: n for n in nodes} | {n: n for e in edges for n in e if None not in e}

    def root(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n
    for u, v in edges:
        if u is not None and v is not None:
            a, b = sorted((root(u), root(v)))
            up[b] = a
    return {n: root(n) for n in nodes}


def graph():
    """A path in order of ids, a hub with a third of all nodes, many small components, nodes alone, repeats and loops."""
    rng = np.random.default_rng(7)
    path = [(i, i + 1) for i in range(300)]
    hub = [(5000, 1000 + i) for i in range(400)]
    small = [(2000 + 3 * i + int(a), 2000 + 3 * i + int(b)) for i in range(100) for a, b in rng.integers(0, 3, (2, 2))]
    edges = path + hub + small + hub[:50] + [(7, 7), (None, 3), (9000, None)]
    order = rng.permutation(len(edges))
    nodes = [*range(301), *range(1000, 1400), *range(2000, 2300), 5000, 9000, 9001]
    return nodes, [edges[i][::int(rng.choice([-1, 1]))] for i in order]


def found(spark, nodes, edges, kind="long"):
    df = X.components(spark.createDataFrame([(n, 1) for n in nodes], f"node {kind}, component int"), spark.createDataFrame(edges, f"source {kind}, target {kind}"))
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(nodes)
    return dict(got)


@pytest.mark.parametrize("last, hot", [(1_000_000, 100_000), (40, 30)])
def test_components(spark, monkeypatch, last, hot):
    rounds = []
    plainly = X.contracted
    monkeypatch.setattr(X, "contracted", lambda e, turn: rounds.append(turn) or plainly(e, turn))
    monkeypatch.setattr(X, "LAST_EDGES", last)  # the small value asks for rounds, and for hot keys in them
    monkeypatch.setattr(H, "HOT_ROWS", hot)
    nodes, edges = graph()
    assert found(spark, nodes, edges) == plain(nodes, edges)
    assert len(rounds) == 0 if last > 40 else 1 <= len(rounds) <= 8


def test_rounds_to_the_end(spark, monkeypatch):
    monkeypatch.setattr(X, "LAST_EDGES", 0)
    monkeypatch.setattr(X, "FOREST_EDGES", 1)
    edges = [("a", "b"), ("b", "c"), ("x", "y")]
    assert found(spark, ["a", "b", "c", "x", "y", "z"], edges, "string") == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(H, "HOT_ROWS", 100)
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(1, 901)], "k long, v long")
    right = spark.createDataFrame([(1, "one"), (3, "three")], "k long, name string")
    got = H.looked_up(left, right, "k")
    assert {(r.k, r.v, r.name) for r in got.collect()} == {(k, v, {1: "one", 3: "three"}.get(k)) for k, v in ((1 if i % 3 else i, i) for i in range(1, 901))}


def test_no_edges(spark):
    assert found(spark, [1, 2], [(None, 1)]) == {1: 1, 2: 2}
