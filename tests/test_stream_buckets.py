"""The keyed state of a stream is held by bucket: a call per bucket, whatever the number of keys."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from xrdlake.streaming import jobs as L


def test_many_keys_few_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "KEY_BUCKETS", 8)
    rnd = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=rnd.randrange(6000)), rnd.choice([None, *range(60), 2 ** 60 + 1]), rnd.choice([None, "", 'a"b', "c,d"])) for _ in range(1500)]
    rows.sort(key=lambda r: r[0])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    kind = "ts timestamp, k long, w string"
    for part in (rows[:700], rows[700:1100], rows[1100:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        q = L.run_to_table(L.first_after_quiet(spark.readStream.schema(kind).parquet(source), "ts", ["k", "w"], "20 hours", "1 hour"), out, str(tmp_path / "chk"))
        q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8
    last, want = {}, []
    for ts, k, w in rows:
        if (k, w) not in last or ts - last[k, w] > timedelta(hours=20):
            want.append((k, w, ts))
        last[k, w] = ts
    got = [(r["k"], r["w"], r["m"]) for r in spark.read.parquet(out).select("k", "w", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("m")).collect()]
    assert sorted(got, key=str) == sorted([(k, w, ts.strftime("%Y-%m-%d %H:%M")) for k, w, ts in want], key=str)
