"""Streaming jobs drained over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from xrdlake.operators import curves as C, matching as M, rule_tables as R
from xrdlake.plans.match import r, values_sql
from xrdlake.plans.registry import query
from xrdlake.plans.source import write_curves
from xrdlake.plans.sqlbits import PEAKS
from xrdlake.plans.views import table
from xrdlake.session import new_path
from xrdlake.streaming import jobs as L

c = F.col


def event_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", c("ts").cast("timestamp"))


_READ_BACK = PEAKS.replace("3.0e0 + 0.4e0 * CAST(pos - 1 AS DOUBLE) AS tt", "round(3.0e0 + 0.4e0 * CAST(pos - 1 AS DOUBLE), 1) AS tt").replace(
    "greatest(0e0, (CAST(v AS DOUBLE) + 0.6e0) * 1000e0) AS y", "round(greatest(0e0, (CAST(v AS DOUBLE) + 0.6e0) * 1000e0), 3) AS y")


@query("l1_incoming_curve_triage", f"""
WITH {_READ_BACK}, rw(rule_id, mineral, need, lo, hi) AS (VALUES {values_sql(R.diagnostic_rows())})
SELECT curve_id, peak_index, rule_id, round(d, 5) AS d FROM pk JOIN rw ON d BETWEEN lo AND hi WHERE curve_id % 50 <> 7""")
def l1(spark, d):
    """Each new file is parsed, its peaks found and set against the diagnostic windows."""
    def interpret(df):
        ok = df.where("status = 'importado'").select(F.regexp_extract("path", r"curve_id=(\d+)", 1).cast("long").alias("curve_id"), "two_theta", "intensity")
        p = C.light_peaks(C.find_peaks(C.process(ok))).withColumn("preparation", F.lit(None).cast("string"))
        return M.diagnostic_matches(p).select("curve_id", "peak_index", "rule_id", r(c("d"), 5).alias("d"))
    out = new_path(spark, "triage")
    L.triage(L.packed_curve_stream(spark, write_curves(spark, d)), out, new_path(spark, "chk"), interpret).awaitTermination()
    return spark.read.parquet(out).select("curve_id", "peak_index", "rule_id", "d")


@query("l2_import_dedup", "SELECT DISTINCT user_id, event_type, props FROM events")
def l2(spark, d):
    out = new_path(spark, "dedup")
    s = L.import_dedup(event_stream(spark, d), "ts", ["user_id", "event_type", "props"], "60 days").select("user_id", "event_type", "props")
    L.run_to_table(s, out, new_path(spark, "chk")).awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_type", "props")


@query("l2_keyed_dedup", """
WITH s AS (SELECT user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS before FROM events)
SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS first_seen FROM s WHERE before IS NULL OR ts - before > INTERVAL 36 HOURS""")
def l2b(spark, d):
    """Events arrive in five deliveries, in order of time; a user's event counts again after a day and a half without one of its type."""
    path, out = new_path(spark, "deliveries"), new_path(spark, "fresh")
    e = table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp")).select("user_id", "event_type", "ts")
    lo, hi = e.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    chk = new_path(spark, "chk")
    for i in range(5 if lo is not None else 1):
        part = e if lo is None else e.where(F.least(F.floor((F.unix_seconds("ts") - lo) * 5 / max(hi - lo, 1)), F.lit(4)) == i)
        part.write.mode("append").parquet(path)
        s = spark.readStream.schema(e.schema).parquet(path)
        L.run_to_table(L.first_after_quiet(s, "ts", ["user_id", "event_type"], "36 hours", "1 hour"), out, chk).awaitTermination()
    fresh = spark.read.parquet(out)
    return fresh.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_seen"))


@query("l3_rolling_metrics", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS rows, count(*) FILTER (value >= 50) AS strong, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def l3(spark, d):
    out = new_path(spark, "metrics")
    m = L.rolling_metrics(event_stream(spark, d), "ts", "event_type", "1 day", "1 hour")
    L.run_to_table(m, out, new_path(spark, "chk"), "update").awaitTermination()
    return L.newest(spark.read.parquet(out), ["w", "event_type"]).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "rows", "strong", r(c("total"), 4).alias("total"))
