"""Lines that compete for no peak are looked up for all curves of a cell at once."""

import random

import numpy as np
import pytest

from tests.test_line_cells import walk
from xrdlake.functions.values import rounded
from xrdlake.operators import assignment as A


def sides(rnd, apart):
    """Curves of 0 to 9 peaks and references of 0 to 6 lines, in steps of an eighth so that distances meet the tolerance."""
    curves = [[(i + 1, rnd.randrange(32, 200) / 8) for i in range(rnd.randint(0, 9))] for _ in range(25)]
    places = lambda: rnd.sample(range(4, 25, apart), rnd.randint(0, 6)) if apart else [rnd.randrange(32, 100) / 8 for _ in range(rnd.randint(0, 6))]
    # lines of one number weigh the same: which of two equally near ones is taken is open
    references = [[(n, float(x), float(n * 3 % 7 + 1)) for k, x in enumerate(places()) for n in [k if apart else rnd.randint(0, 3)]] for _ in range(60)]
    return curves, references


def matched(curves, references, tolerance=0.25):
    flat = [line for r in references for line in r]
    refs = A.References(np.array([len(r) for r in references]), *(np.array([f[k] for f in flat], float) for k in range(3)), tolerance)
    peaks = [p for c in curves for p in c]
    strips = list(refs.match(np.array([len(c) for c in curves]), np.array([t for _, t in peaks], float), np.array([o for o, _ in peaks], float)))
    assert [s[0].start for s in strips] == [0, *[s[0].stop for s in strips]][:len(strips)] and strips[-1][0].stop == len(references)
    return np.concatenate([s[1] for s in strips]), np.concatenate([s[2] for s in strips])


@pytest.mark.parametrize("strip", [1, 7, 4_000])
@pytest.mark.parametrize("apart", [0, 2])
def test_equals_the_walk(monkeypatch, strip, apart):
    monkeypatch.setattr(A, "STRIP_LINES", strip)
    curves, references = sides(random.Random(strip + apart), apart)
    if apart:  # none of these may be assigned curve by curve
        monkeypatch.setattr(A.Lines, "match", None)
    else:
        references[3] += [(8, float("nan"), 1.0), (9, 200.0, float("inf")), (10, 5.0, float("inf"))]
    n, weight = matched(curves, references)
    for r, lines in enumerate(references):
        for c, peaks in enumerate(curves):
            assert (n[r, c], weight[r, c]) == pytest.approx(walk(peaks, lines) or (0, 0.0))


def test_rounded_is_round(spark):
    from pyspark.sql import functions as F

    values = [0.0, 1e-9, 0.123456785, 0.5, 1 / 3, 0.999999999, 12345.678, 3e9, 1e300, -0.25, -1e-12, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (4, 6, 8):
        got = df.select(rounded(F.col("v"), digits).alias("a"), F.round("v", digits).alias("b")).collect()
        assert [str(x.a) for x in got] == [str(x.b) for x in got]


def test_rounded_as_the_sql_rounds(spark):
    """Halves of the eighth digit that no double holds exactly: scores of ``d6_library_classifier`` on sf0.1."""
    import duckdb

    values = [0.129721875, 0.11429062499999999, 0.252534375, 0.09677812499999999, 0.17412187499999998]
    want = [duckdb.sql(f"SELECT round({v!r}::DOUBLE, 8)").fetchall()[0][0] for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [x.a for x in df.select(rounded("v", 8).alias("a")).collect()] == want
