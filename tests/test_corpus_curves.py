"""With-curve scores: bounds, filter and refine, and the tolerance join on crowded positions."""

import random

import pytest
from pyspark.sql import functions as F

from xrdlake.operators import corpus as K, curation as J, curves as C, matching as M

CURVE = "id long, two_theta array<double>, intensity array<double>"


def curves_of(spark, seed, n, start=0):
    rnd = random.Random(seed)
    axis = [5 + 0.25 * i for i in range(96)]
    rows = []
    for k in range(n):
        at, wide = rnd.uniform(6, 28), rnd.uniform(0.3, 6)
        rows.append((start + k, axis if k % 5 else [x + 0.1 for x in axis], [1000 / (1 + ((x - at) / wide) ** 2) + rnd.uniform(0, 20) for x in axis]))
    return spark.createDataFrame(rows, CURVE)


def crossed(spark, a, b):
    of = lambda d, k: d.select(F.col("id").alias(f"i{k}"), F.col("two_theta").alias(f"x{k}"), F.col("intensity").alias(f"y{k}"))
    return of(a, 1).join(of(b, 2), F.lit(True))


def test_numpy_shapes_equal_the_expressions(spark):
    pairs = crossed(spark, curves_of(spark, 1, 12), curves_of(spark, 2, 12, 100))
    one = {(r["i1"], r["i2"]): r["shape"] for r in C.shape_similarity(pairs).collect()}
    two = {(r["i1"], r["i2"]): r["shape"] for r in C.shape_scores(pairs).collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1.5e-4) for k in one)


def test_bound_is_never_below_the_similarity(spark):
    pairs = crossed(spark, curves_of(spark, 3, 25), curves_of(spark, 4, 25, 100))
    bound = K.curve_bound(K.curve_sketch(F.col("x1"), F.col("y1")), K.curve_sketch(F.col("x2"), F.col("y2")))
    rows = C.shape_scores(pairs.withColumn("bound", bound)).collect()
    assert all(r["bound"] >= r["shape"] for r in rows)
    assert sum(r["bound"] < 0.75 for r in rows) > 100  # and tells something


def evidence(spark, incoming, stored, seed=6):
    rnd = random.Random(seed)
    rows = [(a, b, b // 2, rnd.random() < 0.02, rnd.choice((0.5, 1.0)), round(rnd.random(), 4) if rnd.random() < 0.3 else 0.0, rnd.choice((0.0, 0.5, 1.0))) for a in incoming for b in stored]
    return spark.createDataFrame(rows, "in_id long, st_id long, record_id long, exact boolean, metadata_score double, peak_score double, candidate_score double")


def test_filter_and_refine_loses_nothing(spark):
    a, b = curves_of(spark, 7, 12), curves_of(spark, 8, 40, 100)
    pairs = evidence(spark, range(12), range(100, 142))  # two stored items have no curve
    shape = {(r["i1"], r["i2"]): r["shape"] for r in C.shape_scores(crossed(spark, a, b)).collect()}
    want = {}
    for r in pairs.collect():
        s = shape.get((r["in_id"], r["st_id"]))
        m, p, c = r["metadata_score"], r["peak_score"], r["candidate_score"]
        score = 1.0 if r["exact"] else m * 0.25 + p * 0.55 + c * 0.20 if s is None else m * 0.18 + s * 0.32 + p * 0.35 + c * 0.15
        if r["exact"] or score >= 0.35 - 1e-9:
            want[r["in_id"], r["st_id"]] = score
    got = {(r["in_id"], r["st_id"]): r["score"] for r in K.score_with_curves(pairs, a, b).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-4) for k in got)
    whole = K.search(K.score_with_curves(pairs, a, b)).drop("n_matches")
    top = K.search(K.score_with_curves(pairs, a, b, top=5)).drop("n_matches")
    assert sorted(map(str, whole.collect())) == sorted(map(str, top.collect()))


def test_bounds_leave_most_curves_closed(spark):
    axis = [5 + 0.25 * i for i in range(96)]
    like = lambda k, at: (k, axis, [1000 / (1 + ((x - at) / 0.6) ** 2) for x in axis])
    a = spark.createDataFrame([like(0, 10.0)], CURVE)
    b = spark.createDataFrame([like(100 + k, 10.0 if k < 8 else 14.0 + k % 10) for k in range(200)], CURVE)
    pairs = spark.createDataFrame([(0, 100 + k, k, False, 1.0, 0.9 if k < 8 else 0.1, 1.0) for k in range(200)],
                                  "in_id long, st_id long, record_id long, exact boolean, metadata_score double, peak_score double, candidate_score double")
    kept = K.score_with_curves(pairs, a, b, top=5).count()
    assert kept == 8  # the 192 others are left out before their curves are read


def test_crowded_positions_are_split(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 50)
    rnd = random.Random(3)
    a = [(i, round(rnd.gauss(2.0, 0.01) if i % 3 else rnd.uniform(0, 5), 3)) for i in range(900)]
    b = [(i, round(rnd.uniform(0, 5), 3)) for i in range(60)]
    x, y = spark.createDataFrame(a, "curve_id long, v double"), spark.createDataFrame(b, "k long, w double")
    near = M.near_join(x, y, "v", "w", 0.3)
    assert sorted((r["curve_id"], r["k"]) for r in near.collect()) == sorted((i, k) for i, v in a for k, w in b if abs(v - w) <= 0.3)
    assert M.near_join(x.limit(0), y, "v", "w", 0.3).count() == 0


def test_external_ids_and_scopes(spark):
    rows = [(1, 1, "Mindat", "12", "https://www.mindat.org/min-12.html"), (1, 2, "mindat ", None, None), (1, 3, "Mindat", "x1", None), (1, 4, "Mindat", "12", "http://a.org/12"),
            (1, 5, "Mindat", "12", "https://www.mindat.org/min-13.html"), (1, 6, "other", None, "zzz"), (1, 7, None, None, None), (1, 8, "Mindat", "7", "http://mindat.org/min-7.html")]
    df = spark.createDataFrame(rows, "r long, i long, external_source string, external_id string, external_uri string")
    got = {(r["item"], r["rule"]) for r in J.external_id_errors(df, "r", "i").collect()}
    assert got == {("2", "external_id_required"), ("3", "external_id_numeric"), ("4", "external_uri_format"), ("5", "external_uri_matches")}
    child = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 10), (2, None)], "r long, k long")
    scopes = spark.createDataFrame([(1, "a"), (2, "b")], "record_id long, scope string")
    parents = spark.createDataFrame([("a", 10), ("b", 11)], "scope string, key long")
    miss = {(r["record_id"], r["item"]) for r in J.declared(child, "r", "k", parents, "x", scopes).collect()}
    assert miss == {(1, "11"), (2, "10"), (3, "10")}
