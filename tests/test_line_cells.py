"""Reference lines matched in cells: equal to the greedy walk on odd tables, and no pair of a peak and a line is shuffled."""

import random

import pytest

from xrdlake.operators import matching as M


def shuffled_rows(spark, action):
    """Rows that all stages of an action wrote to shuffles."""
    store, jvm = spark._jsc.sc().statusStore(), spark._jvm
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in [v.apply(i) for v in [store.stageList(None, False, False, spark._sc._gateway.new_array(jvm.double, 0), None)] for i in range(v.size())]}
    before = stages()
    out = action()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(n for k, n in stages().items() if k not in before)


def walk(peaks, lines, tol=0.25):
    """``(matched, weight)`` by the sorted pairs, as the SQL states it; none without a pair."""
    pairs = sorted((k, abs(t - x), o, 1.0 if w is None else w) for k, x, w in lines if x is not None for o, t in peaks if t is not None and abs(t - x) <= tol)
    used_k, used_o, weight = set(), set(), 0.0
    for k, _, o, w in pairs:
        if k not in used_k and o not in used_o:
            used_k.add(k), used_o.add(o)
            weight += w
    return (len(used_k), weight) if pairs else None


@pytest.mark.parametrize("cell", [(1_000, 2_000), (3, 4)])
def test_cells_equal_the_walk(spark, monkeypatch, cell):
    monkeypatch.setattr(M, "CELL_CURVES", cell[0])
    monkeypatch.setattr(M, "CELL_REFERENCES", cell[1])
    rnd = random.Random(5)
    peaks = {c: [(i + 1, round(rnd.choice((4.0, 4.25, 4.5, rnd.uniform(4, 7))), 2)) for i in range(rnd.randint(1, 14))] for c in range(30)}
    peaks[3].append((99, None))
    # numbers given twice, no position, no weight, a reference of one line
    lines = {f"r{r}": [(rnd.randint(0, 5), round(rnd.uniform(4, 7), 2), float(rnd.randint(1, 9))) for _ in range(rnd.randint(1, 9))] for r in range(25)}
    lines["r0"] += [(7, None, 4.0), (8, 4.25, None)]
    p = spark.createDataFrame([(c, i, t) for c, v in peaks.items() for i, t in v], "curve_id long, peak_index int, two_theta double")
    y = spark.createDataFrame([(r, *v) for r, vs in lines.items() for v in vs], "reference_id string, line_index int, ref_two_theta double, ref_intensity double")
    got = {(r.curve_id, r.reference_id): r for r in M.match_reference_lines(p, y).collect()}
    want = {(c, r): m for c, ps in peaks.items() for r, ls in lines.items() if (m := walk(ps, ls))}
    assert got.keys() == want.keys()
    for k, (n, weight) in want.items():
        ls = lines[k[1]]
        assert got[k].matched_lines == n and got[k].reference_lines == len(ls)
        assert got[k].weighted_coverage == pytest.approx(weight / sum(1.0 if w is None else w for _, _, w in ls))
    assert M.match_reference_lines(p.limit(0), y).count() == M.match_reference_lines(p, y.limit(0)).count() == 0


def test_pairs_are_not_shuffled(spark):
    p = spark.range(2000).selectExpr("id % 100 curve_id", "cast(floor(id / 100) as int) peak_index", "4 + floor(id / 100) * 0.4D two_theta")
    y = spark.range(2000).selectExpr("id % 200 reference_id", "cast(floor(id / 200) as int) line_index", "4 + floor(id / 200) * 0.8D ref_two_theta", "1.0D ref_intensity")
    found, moved = shuffled_rows(spark, lambda: M.match_reference_lines(p, y).count())
    assert found == 100 * 200
    assert moved < found / 2
