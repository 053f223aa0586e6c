"""Sides of joins that repeat: what grows is counted, not paired."""

from pyspark.sql import functions as F

from xrdlake.operators import keys, matching as M


def test_equal_cells_are_joined_once(spark, monkeypatch):
    cells = spark.range(400).select(F.col("id").alias("cell_id"), F.lit("cubic").alias("crystal_system"), F.lit(4.0).alias("a"), F.lit(4.0).alias("c"))
    peaks = spark.range(300).select(F.col("id").alias("curve_id"), F.lit(0).alias("peak_index"), (F.lit(22.1) + F.col("id") % 3 * 0.05).alias("two_theta"))
    seen = []
    plainly = M.near_join
    monkeypatch.setattr(M, "near_join", lambda *a, **b: seen.append(plainly(*a, **b)) or seen[-1])
    got = M.index_peaks(peaks, cells).collect()
    lines = [r["line_two_theta"] for r in M.hkl_lines(cells.limit(1)).collect()]
    assert len(got) == 300 and seen[0].count() < 100
    for r in got:
        t = 22.1 + r["curve_id"] % 3 * 0.05
        near = [abs(t - x) for x in lines if abs(t - x) <= 0.2]
        assert r["matches"] == 400 * len(near) and r["cell_id"] == 0 and abs(r["delta"] - min(near)) < 1e-8


def test_overrides_of_one_mineral_are_one(spark):
    o = spark.range(500).select((F.col("id") + 1).alias("rank"), F.lit("ab").alias("pat"), F.when(F.col("id") % 2 == 0, "X").otherwise("Y").alias("mineral"))
    first = keys.first_of_each(o, "pat")
    assert sorted((r["pat"], r["mineral"], r["rank"]) for r in first.collect()) == [("ab", "X", 1), ("ab", "Y", 2)]
    items = spark.createDataFrame([(7, "cabd")], "item long, hay string")
    cand = spark.createDataFrame([(7, 1, "Z")], "item long, rank long, mineral string")
    both = [keys.apply_overrides(cand, keys.contains_join(items, "hay", x, "pat").select("item", "rank", "mineral")).collect() for x in (o, first)]
    assert sorted(both[0]) == sorted(both[1]) and len(both[0]) == 3
