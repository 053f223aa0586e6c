"""Structured Streaming jobs: incoming curves, import dedup, rolling metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from xrdlake.sources.files import CONTAINER, parse_text_curves


def curve_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New text curve files below ``path``, one row per file, parsed."""
    r = spark.readStream
    r = r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r
    return parse_text_curves(r.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.col("_metadata.file_path")))


def packed_curve_stream(spark: SparkSession, path: str, containers_per_batch: int | None = None) -> DataFrame:
    """As ``curve_stream``, from new containers (``sinks.pack_files`` with mode ``append``): a batch lists containers, not curves."""
    r = spark.readStream.schema(CONTAINER)
    r = r.option("maxFilesPerTrigger", containers_per_batch) if containers_per_batch else r
    files = r.parquet(path).repartition(4 * spark.sparkContext.defaultParallelism)  # parsing uses all cores, however few containers there are
    return parse_text_curves(files.select("path", F.col("content").cast("string").alias("value")))


def triage(stream: DataFrame, out: str, checkpoint: str, interpret: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Interpret each batch of curves and write it under its batch number.

    A repeated batch overwrites its own folder, so a restart gives no duplicates.
    """
    def batch(df: DataFrame, number: int) -> None:
        interpret(df).write.mode("overwrite").parquet(f"{out}/batch={number}")
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def import_dedup(stream: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """First arrival per key within the watermark; the state ends with it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


#: States that the keys of a stream are dealt to, and the time of a key that was not seen.
KEY_BUCKETS, NEVER = 1024, np.iinfo(np.int64).min


def first_after_quiet(stream: DataFrame, time: str, keys: list[str], quiet: str, delay: str) -> DataFrame:
    """Rows (keys and ``time``) whose key was not seen for more than ``quiet`` before; others are repeats and go.

    The state of a key is the last time it was seen. It ends when the watermark has passed that time by ``quiet``: whatever may
    still come is new then, so dropping it changes nothing. Of rows that come out of order, one that is older than the last sight of its key is a
    repeat; rows that are later than ``delay`` are left out. A null time is left out, null keys are equal; keys are numbers, texts, dates, times or truth values.
    Keys are dealt to ``KEY_BUCKETS`` buckets, and a bucket is one state and one call: work per key is that of arrays. A batch holds the keys and times of a
    bucket; limit its size by the source's options. For many keys set RocksDB as the state store of the session.
    """
    gap = int(pd.Timedelta(quiet) // pd.Timedelta("1us"))
    kinds = {k: stream.schema[k].dataType for k in keys}
    if odd := [k for k, t in kinds.items() if isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]:
        raise ValueError(f"keys of a type that has no exact text: {odd}")
    moment = lambda k: isinstance(kinds[k], T.TimestampType)
    text = [(F.unix_micros(k) if moment(k) else F.col(k)).cast("string") for k in keys]
    rows = stream.where(F.col(time).isNotNull()).withWatermark(time, delay).select(
        F.to_json(F.array(*text)).alias("_key"), time, F.unix_micros(F.col(time).cast("timestamp")).alias("_seen"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(KEY_BUCKETS)).cast("int"))

    def look(bucket, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        frames = list(frames)
        old, sights = state.get if state.exists else ([], [])
        code, names = pd.factorize(np.concatenate([np.array(old, object), *[f["_key"].to_numpy(object) for f in frames]]))
        last = np.full(len(names), NEVER)
        last[:len(old)] = sights
        code, seen = code[len(old):], np.concatenate([f["_seen"].to_numpy(np.int64) for f in frames])
        order = np.lexsort((seen, code))
        code, seen = code[order], seen[order]
        before = last[code]
        again = code[1:] == code[:-1]
        before[1:] = np.where(again, np.maximum(seen[:-1], before[1:]), before[1:])
        fresh = (before == NEVER) | (seen - np.maximum(before, seen.min() - gap - 1) > gap)
        np.maximum.at(last, code, seen)
        mark = state.getCurrentWatermarkMs()
        keep = last + gap >= mark * 1000
        if keep.any():
            state.update(([str(k) for k in names[keep]], [int(v) for v in last[keep]]))
            state.setTimeoutTimestamp(max(int(last.max() + gap) // 1000 + 1, mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"_key": names[code[fresh]], "_seen": seen[fresh]})

    held = T.StructType([T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("last", T.ArrayType(T.LongType()))])
    kept = rows.groupBy("_bucket").applyInPandasWithState(look, "_key string, _seen long", held, "append", GroupStateTimeout.EventTimeTimeout)
    own = F.from_json("_key", T.ArrayType(T.StringType()))
    back = lambda n, k: F.timestamp_micros(F.get(own, F.lit(n)).cast("long")) if moment(k) else F.get(own, F.lit(n)).cast(kinds[k])
    return kept.select(*[back(n, k).alias(k) for n, k in enumerate(keys)], F.timestamp_micros("_seen").alias(time))


def rolling_metrics(stream: DataFrame, time: str, by: str, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts per time window and treatment."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, delay).groupBy(w.alias("w"), F.col(by)).agg(
        F.count("*").alias("rows"), F.count_if(F.col("value") >= 50).alias("strong"), F.sum("value").alias("total"))


def run_to_table(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Drain a stream into Parquet, one folder per batch; with mode ``update`` a row may come in several, see ``newest``."""
    def batch(b: DataFrame, number: int) -> None:
        b.write.mode("overwrite").parquet(f"{out}/batch={number}")
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def newest(written: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of every key among the batches of an updating stream."""
    values = [c for c in written.columns if c not in (*keys, "batch")]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*keys, "v.*")
