"""Keyed state of the import stream: repeats inside and outside the quiet time, restarts, late rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from xrdlake.streaming import jobs as L

START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


@pytest.fixture
def drain(spark, tmp_path):
    """Adds a delivery and runs the job over what is new, each time from its checkpoint."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(rows):
        spark.createDataFrame([(k, at(h) if h is not None else None) for k, h in rows], "k string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        s = spark.readStream.schema("k string, ts timestamp").parquet(source)
        L.run_to_table(L.first_after_quiet(s, "ts", ["k"], "24 hours", "2 hours"), out, str(tmp_path / "chk")).awaitTermination()
        seen = spark.read.parquet(out).select("k", ((F.unix_micros("ts") - F.lit(int((START - datetime(1970, 1, 1)).total_seconds() * 1e6))) / 3.6e9).alias("h"))
        return sorted(((r.k, r.h) for r in seen.collect()), key=str)
    return run


def test_repeats_and_restarts(drain):
    assert drain([("a", 0), ("a", 5), ("a", 0), ("b", 1), (None, 2), ("c", None)]) == [("a", 0.0), ("b", 1.0), (None, 2.0)]
    # a: 24 hours after its last sight is a repeat still and counts as one; b is back after more
    assert drain([("a", 29), ("b", 26), (None, 3)]) == [("a", 0.0), ("b", 1.0), ("b", 26.0), (None, 2.0)]
    # all state is past its time; a row older than the watermark is left out
    assert drain([("z", 200)])[-2] == ("z", 200.0)
    assert drain([("a", 201), ("b", 20), ("z", 201)]) == [("a", 0.0), ("a", 201.0), ("b", 1.0), ("b", 26.0), ("z", 200.0), (None, 2.0)]
