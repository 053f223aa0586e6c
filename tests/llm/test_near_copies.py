"""Near copies of the pipeline's stage against all pairs of plain shingle sets."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from xrdlake.llm import near_copies

SCHEMA = "doc_id long, text string, blob string, node int"


def plain_survivors(rows, words=5):
    """Least id of each group; ``rows`` have different ids."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return sorted(least.values())


def corpus():
    r = random.Random(3)
    word = lambda: f"w{r.randrange(4000)}"
    out, passage = [], [word() for _ in range(60)]
    for _ in range(12):  # copies with scattered changes, some above and some below the similarity
        base = [word() for _ in range(r.randint(80, 900))]
        out.append(base)
        for _ in range(12):
            copy, part = list(base), r.choice((0.002, 0.01, 0.02, 0.022, 0.025, 0.04))
            for i in range(len(copy)):
                if r.random() < part:
                    copy[i] = word()
            out.append(copy)
    base = [word() for _ in range(100)]
    for k in range(40):  # one large group of copies, more alike to their base than to each other
        out.append([w if i not in (5 + k % 9 * 7, 20 + k % 11 * 6) else word() for i, w in enumerate(base)])
    out += [[word() for _ in range(r.randint(5, 90))] + passage for _ in range(40)]
    out += [[word() for _ in range(r.randint(0, 6))] for _ in range(10)] + [["a"] * 3, ["a"] * 5, ["a"] * 50, ["a", "b"] * 9, ["a", "b"] * 30]
    r.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)] + [(9000, None), (9001, ""), (9002, " \n")]


def test_survivors_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == plain_survivors(rows)


def test_ids_that_are_missing_or_taken(spark):
    text = " ".join(f"x{i}" for i in range(300))
    rows = [(None, text), (4, text), (4, text), (4, text + " more"), (2, "another text"), (None, None)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA), "").collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["2", "4", "None"]
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_common_passages_sort_last(spark, monkeypatch):
    r = random.Random(8)
    passage = [f"p{i}" for i in range(200)]
    rows = [(i, " ".join([f"u{r.randrange(10**6)}" for _ in range(100)] + passage)) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(20)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    order = near_copies.common(df)
    assert len(order.hashes) >= 190
    keys = near_copies.sketches(df).select("node", F.explode("keys").alias("key")).groupBy("key").agg(F.countDistinct("node").alias("n"))
    assert keys.agg(F.max("n")).first()[0] <= 2  # a document meets its copy and nobody else
    assert [x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, df, "").orderBy("doc_id").collect()] == list(range(60))
    monkeypatch.setattr(near_copies, "MOST_COMMON", 10)  # a list that is too short loses nothing
    assert corpus_pipeline.drop_near_copies(spark, df, "").count() == 60


def test_pairs_of_one_passage_are_made_once(spark):
    """Sets that share many keys meet once; with ``nearest`` each set gives one pair at most."""
    nodes = spark.createDataFrame([(i, 100, bytes(64)) for i in range(30)], "node long, n long, bits binary")
    met = spark.createDataFrame([(k, i) for k in range(50) for i in range(20)] + [(99, i) for i in range(18, 30)], "key long, node long")
    roots = spark.createDataFrame([(i, 0) for i in range(10)], "node long, root long")
    few = near_copies.meetings(met)
    assert few.groupBy("key").count().count() == 2
    all_pairs = {(u, v) for a, z in ((0, 20), (18, 30)) for u, v in itertools.combinations(range(a, z), 2) if v >= 10}
    assert {tuple(x) for x in near_copies.remaining(few, roots, nodes).collect()} == all_pairs
    assert near_copies.remaining(few, roots, nodes, nearest=True).count() <= 30


def test_rows_of_the_largest_root_are_not_compared_with_each_other():
    root, n, bits = np.array([7] * 50 + [1, 2]), np.full(52, 100), np.zeros((52, 8), np.uint64)
    found = list(near_copies.possible(n, root, bits))
    assert sorted(int(i) for i, _, _ in found) == [50, 51]
    assert sum(len(j) for _, j, _ in found) == 101
