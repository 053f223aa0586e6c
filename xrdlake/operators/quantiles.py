"""Exact quantiles per key, also of keys with more values than a task should hold.

Values are counted first. Keys with few distinct values use Spark's percentile. For the others the wanted ranks are found by
radix histograms over the ordered bits of the values: a round counts the values of each rank's range in about a thousand buckets, and
the bucket that holds the rank is the next range. Seven rounds settle 64 bits; where a bucket holds one value the rank is settled at
once, so values of few digits need two or three. Only buckets are shuffled, however many values a key has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from xrdlake.operators.hot import looked_up
from xrdlake.session import written

#: Distinct values of a key that one task may hold.
BUFFERED = 100_000
#: Bits that a round settles.
BITS = 10


@F.pandas_udf(LongType())
def ordered_bits(v: pd.Series) -> pd.Series:
    """64-bit integers in the order of the doubles; both zeros are equal, NaN comes last."""
    bits = (v.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


def narrowed(values: DataFrame, keys: list[str], state: DataFrame) -> DataFrame:
    """``state`` (keys, rank, place, lo, hi: the rank is the ``place``-th of the values from lo to hi) with smaller ranges, and ``value``, the least in them."""
    ranges = state.groupBy(*keys).agg(F.collect_set(F.struct("lo", "hi")).alias("_ranges"))
    j = looked_up(values, ranges, keys).select(*keys, "_v", "_w", "_b", F.explode("_ranges").alias("r")).where("_b BETWEEN r.lo AND r.hi").select("*", "r.lo", "r.hi")
    shift = "greatest(0, length(bin((hi >> 1) - (lo >> 1) + 1)) + 1 - {0})".format(BITS)
    j = j.withColumn("_bucket", F.expr(f"(_b >> {shift}) - (lo >> {shift})"))
    h = j.groupBy(*keys, "lo", "hi", "_bucket").agg(F.sum("_w").alias("_c"), F.min("_b").alias("_lo"), F.max("_b").alias("_hi"), F.min("_v").alias("value"))
    h = h.withColumn("_before", F.sum("_c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("_bucket")) - F.col("_c"))
    at = state.drop("value").join(h, [*keys, "lo", "hi"]).where("place >= _before AND place < _before + _c")
    return at.select(*keys, "rank", (F.col("place") - F.col("_before")).alias("place"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "value")


def by_rank(values: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """``keys, rank, value``: the values at the wanted ``ranks`` (keys, rank from 0) among ``values`` (keys, ``_v``, ``_w``)."""
    values = written(values.withColumn("_b", ordered_bits("_v")), "ordered")
    ends = values.groupBy(*keys).agg(F.min("_b").alias("lo"), F.max("_b").alias("hi"), F.min("_v").alias("value"))
    state = written(ranks.join(ends, keys).withColumn("place", F.col("rank")), "ranks")
    found = []
    while True:
        found.append(state.where("lo = hi").select(*keys, "rank", "value"))
        state = state.where("lo < hi")
        if state.isEmpty():
            break
        state = written(narrowed(values, keys, state), "ranks")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def percentiles(values: DataFrame, keys: list[str], value: str, weight: str, wanted: dict[str, float]) -> DataFrame:
    """Interpolated percentiles per key, under the names of ``wanted`` (name: share from 0 to 1).

    ``values``: keys, ``value`` (double, one row per key and value), ``weight`` (how often). Rows without a value, and keys with a null
    part, are left out; NaN is greater than any number.
    """
    v = values.select(*keys, F.col(value).cast("double").alias("_v"), F.col(weight).cast("long").alias("_w")).dropna(subset=[*keys, "_v"]).where("_w > 0")
    v = written(v, "counted")
    large = written(v.groupBy(*keys).agg(F.count("*").alias("_m"), F.sum("_w").alias("_n")).where(F.col("_m") > BUFFERED).drop("_m"), "large")
    plain = lambda df: df.groupBy(*keys).agg(*[F.expr(f"percentile(_v, {q!r}D, _w)").alias(n) for n, q in wanted.items()])
    if large.isEmpty():
        return plain(v)
    marked = looked_up(v, large, keys)
    position = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    ranks = large.select(*keys, F.explode(F.array_distinct(F.array(*[f(position(q)).cast("long") for q in wanted.values() for f in (F.floor, F.ceil)]))).alias("rank"))
    at = by_rank(marked.where("_n IS NOT NULL").drop("_n"), keys, ranks)
    table = at.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at")).join(large, keys)

    def between(q):
        p = position(q)
        a, b = (F.col("_at")[f(p).cast("long")] for f in (F.floor, F.ceil))
        return F.when(a == b, a).otherwise(a * (F.ceil(p) - p) + b * (p - F.floor(p)))
    return plain(marked.where("_n IS NULL").drop("_n")).unionByName(table.select(*keys, *[between(q).alias(n) for n, q in wanted.items()]))
