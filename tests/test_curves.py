import numpy as np
import pytest
from pyspark.sql import functions as F

from xrdlake.functions import series as S
from xrdlake.operators import curves as C, ngc as N

PEAKS = ((8.9, 0.25, 400.0), (12.4, 0.3, 700.0), (20.8, 0.2, 300.0), (26.6, 0.18, 1000.0), (36.5, 0.22, 250.0))


def synthetic(seed=12345, noise=2.5):
    rng = np.random.default_rng(seed)
    x = np.arange(5.0, 45.0, 0.02)
    y = 40 + 0.02 * (45 - x) ** 2
    for pos, fwhm, h in PEAKS:
        y = y + h * np.exp(-4 * np.log(2) * ((x - pos) / fwhm) ** 2)
    return x, y + rng.normal(0, noise, len(x))


def frame(spark, *rows):
    data = [(int(i), [float(v) for v in x], [float(v) for v in y]) for i, x, y in rows]
    return spark.createDataFrame(data, "curve_id long, two_theta array<double>, intensity array<double>")


def test_detector_gate(spark):
    x, y = synthetic()
    got = C.detector(frame(spark, (1, x, y)), half=40).where("snr >= 12").orderBy("position").collect()
    assert got
    for pos, _, _ in PEAKS:
        near = min(got, key=lambda r: abs(r["position"] - pos))
        assert abs(near["position"] - pos) <= 0.1
        assert near["snr"] >= 5
        assert near["fwhm"] <= 0.6


def test_savgol_matches_polynomial_fit(spark):
    x, y = np.arange(30.0), np.sin(np.arange(30.0)) * 5 + 20
    got = frame(spark, (1, x, y)).select(S.polynomial_smooth(F.col("intensity"), 7, 2).alias("s")).first()["s"]
    for i in range(3, 27):
        fit = np.polyval(np.polyfit(np.arange(-3, 4), y[i - 3:i + 4], 2), 0)
        assert got[i] == pytest.approx(fit, abs=1e-9)


def brute_peaks(x, y, threshold, start, distance, limit):
    idx = [i for i in range(1, len(y) - 1) if x[i] >= start and y[i] >= threshold and y[i] >= y[i - 1] and y[i] >= y[i + 1]]
    kept = []
    for i in sorted(idx, key=lambda i: (-y[i], x[i])):
        if len(kept) < limit and all(abs(x[i] - x[k]) >= distance for k in kept):
            kept.append(i)
    return kept


def test_peak_selection_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(k, np.arange(3.0, 23.0, 0.25), np.round(rng.random(80), 2)) for k in range(8)]
    df = frame(spark, *rows).withColumn("normalized", F.col("intensity"))
    got = {r["curve_id"]: r["peak_idx"] for r in C.find_peaks(df, 0.1, 4.0, 1.5, 6).collect()}
    for k, x, y in rows:
        assert got[k] == brute_peaks(x, y, 0.1, 4.0, 1.5, 6)


def brute_width(x, y, p):
    half, left, right = y[p] / 2, p, p
    while left > 0 and y[left] > half:
        left -= 1
    while right < len(y) - 1 and y[right] > half:
        right += 1
    if left == p or right == p:
        return None

    def cross(a, b):
        span = y[b] - y[a]
        return x[a] if abs(span) < 1e-12 else x[a] + (x[b] - x[a]) * (half - y[a]) / span
    w = max(0.0, cross(right - 1, right) - cross(left, left + 1))
    return w or None


def test_width_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x, y = np.arange(0.0, 12.0, 0.1), np.abs(rng.normal(1, 1, 120))
    peaks = list(range(0, 120, 7))
    df = S.with_shapes(frame(spark, (1, x, y)).withColumn("peak_idx", F.array(*[F.lit(p) for p in peaks])), "intensity")
    got = dict(zip(peaks, df.first()["shape"]["fwhm"], strict=True))
    for p in peaks:
        want = brute_width(x, y, p)
        assert got[p] == (pytest.approx(want) if want is not None else None)


def test_merge_targeted_against_brute_force(spark):
    listed = [(1, 10.0, 8.0, 5.0), (1, 7.1, 12.0, 9.0)]
    targeted = [(1, "smectite_c_10a", 9.98, 8.9, 1.0), (1, "illite_10a", 9.5, 9.2, 2.0), (1, "chlorite_7a", 9.52, 9.3, 2.0), (1, "quartz_101", None, None, None)]
    a = spark.createDataFrame(listed, "curve_id long, d double, two_theta double, intensity double")
    b = spark.createDataFrame(targeted, "curve_id long, range_id string, d double, two_theta double, intensity double")
    got = sorted(r["source"] for r in C.merge_targeted(a, b).collect())
    assert got == ["detected", "detected", "targeted:illite_10a"]


def test_edge_rows(spark):
    df = frame(spark, (1, [], []), (2, [5.0], [1.0]), (3, np.arange(4.0, 8.0, 0.2), np.zeros(20)), (4, np.arange(4.0, 8.0, 0.2), np.r_[np.ones(10), np.full(10, 5.0)]))
    out = C.peaks(df).groupBy("curve_id").count().collect()
    assert {r["curve_id"] for r in out} <= {4}
    v = {r["curve_id"]: r for r in C.validate(df).collect()}
    assert v[1]["status"] == "invalid" and "too_few_points" in v[2]["warnings"] and v[3]["status"] == "valid"


def test_clean(spark):
    df = frame(spark, (1, [3.0, 1.0, 2.0, float("nan")], [1.0, -4.0, float("nan"), 2.0]))
    r = C.clean(df).first()
    assert r["two_theta"] == [1.0, 3.0] and r["intensity"] == [0.0, 1.0]


def test_shape_similarity_of_itself(spark):
    x, y = synthetic(noise=0)
    x, y = x[::20], y[::20]
    p = spark.createDataFrame([(x.tolist(), y.tolist(), x.tolist(), y.tolist())], "x1 array<double>, y1 array<double>, x2 array<double>, y2 array<double>")
    assert C.shape_similarity(p).first()["shape"] == pytest.approx(1.0, abs=1e-4)


def ngc(spark, n, g, c):
    """One sample from (spacing, intensity) lists, as a wide row."""
    rows = []
    for prep, peaks, cid in (("natural", n, 0), ("glicolado", g, 1), ("calcinado", c, 2)):
        if peaks is not None:
            win = {k: (i, d) for k, (lo, hi) in N.WINDOWS.items() for d, i in sorted(peaks, key=lambda p: p[1]) if lo <= d <= hi}
            rows.append((cid, 1, prep, {k: {"i": float(i), "d": float(d)} for k, (i, d) in win.items()}, len(peaks), False, False))
    return N.trios(spark.createDataFrame(rows, "curve_id long, sample_base long, preparation string, win map<string,struct<i:double,d:double>>, n_peaks int, broad boolean, broad_basal boolean"))


def test_smectite_rule(spark):
    t = ngc(spark, [(15.0, 100)], [(17.0, 120)], [(10.0, 80)])
    d = N.interval_diagnosis(t).first()
    assert "Esmectita" in d["minerals"] and d["status"] == "diagnosed"
    assert {r["relation"] for r in N.relation_edges(t).collect()} >= {"expands_to", "collapses_to"}


def test_kaolinite_needs_heat_loss(spark):
    lost = ngc(spark, [(7.15, 100)], [(7.15, 90)], [(3.34, 10)])
    kept = ngc(spark, [(7.15, 100)], [(7.15, 90)], [(7.15, 95)])
    assert "Caulinita" in N.interval_diagnosis(lost).first()["minerals"]
    assert "Caulinita" not in N.interval_diagnosis(kept).first()["minerals"]


def test_incomplete_data_blocks_high_confidence(spark):
    t = ngc(spark, [(7.15, 100), (3.57, 40)], [(7.15, 90)], None)
    ctx = spark.createDataFrame([(1, 1.495, False, False)], "sample_base long, d060 double, mg_context boolean, evaporitic_context boolean")
    rows = N.interpret(t, ctx).collect()
    assert rows and all(r["level"] != "confirmed_by_rules" for r in rows if r["treatments"] < 2)
    one = ngc(spark, None, [(17.0, 10)], None)
    assert all(r["score"] <= 40 for r in N.interpret(one, ctx).collect())


def test_feet_against_a_full_scan():
    rng = np.random.default_rng(8)
    y = rng.random(5000)
    y[1000:1600] = 2
    for peak in [0, 4999, 1300, *rng.integers(0, 5000, 200).tolist()]:
        for level in (y[peak] / 2, y[peak] * 0.005, -1.0):
            left = [i for i in range(peak) if y[i] <= level]
            right = [i for i in range(peak + 1, 5000) if y[i] <= level]
            assert S.nearest_low(y, peak, level, -1) == (left[-1] if left else 0)
            assert S.nearest_low(y, peak, level, 1) == (right[0] if right else 4999)


def test_shapes_of_long_curves_and_none(spark):
    x = np.arange(5000) * 0.02
    df = S.with_shapes(frame(spark, (1, x, 100 * np.exp(-((x - 40) / 2) ** 2)), (2, [], [])).withColumn("peak_idx", F.when(F.col("curve_id") == 1, F.array(F.lit(2000))).otherwise(F.array().cast("array<int>"))), "intensity")
    got = {r["curve_id"]: r["shape"] for r in df.collect()}
    assert got[1]["fwhm"][0] == pytest.approx(4 * np.sqrt(np.log(2)), abs=1e-3)
    assert got[1]["area"][0] == pytest.approx(200 * np.sqrt(np.pi), rel=2e-3)
    assert got[2]["fwhm"] == []


def test_batch_alignment_of_a_trio(spark):
    x = np.arange(5.0, 45.0, 0.02)
    quartz = 2 * np.degrees(np.arcsin(1.5406 / (2 * 3.34)))
    line = lambda shift: 10 + 1000 * np.exp(-((x - (quartz - shift)) / 0.1) ** 2)
    rows = [(0, "natural", x, line(0.1)), (1, "glicolado", x + 0.3, line(0)), (2, "calcinado", x - 0.01, line(0)), (3, "glicolado", x + 0.2, line(0)), (4, "calcinado", x, line(0))]
    df = spark.createDataFrame([(i, i // 3, p, [float(v) for v in a], [float(v) for v in b]) for i, p, a, b in rows], "curve_id long, sample_base long, preparation string, two_theta array<double>, intensity array<double>")
    got = {r["curve_id"]: r for r in C.align_batch(df).collect()}
    moved = got[0]["offset"]
    assert moved == pytest.approx(0.1, abs=0.011)
    assert [got[i]["two_theta"][0] for i in (0, 1, 2)] == [pytest.approx(5.0 + moved, abs=1e-6)] * 3
    assert got[4]["offset"] == 0 and got[3]["two_theta"][0] == pytest.approx(5.0)
    by_hand = C.align_batch(df, spark.createDataFrame([(1, 0.5)], "curve_id long, offset double"))
    assert by_hand.where("curve_id = 1").first()["offset"] == 0.5
