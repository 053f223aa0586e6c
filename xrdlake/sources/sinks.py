"""Writers: JSON lines, CSV, folders per mineral, versioned runs, containers of small files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xrdlake.functions.values import payload_hash
from xrdlake.session import written

INCONCLUSIVE = "Inconclusivos"
#: Bytes of small files that a container holds, on average.
CONTAINER_BYTES = 128 << 20
#: Documents of a file; compressed text is read by one task.
FILE_DOCUMENTS = 200_000


def pack_files(files: DataFrame, path: str, container_bytes: int = CONTAINER_BYTES, mode: str = "errorifexists") -> None:
    """Many small files (``path, content``, binary or text) as few Parquet files: rows ``path, length, content``, as many containers as the bytes ask for.

    Rows are sorted by path inside a container, so that its footer leads a reader that asks for some paths to their rows. Repeated paths are kept; a
    null content is an empty file. Other columns go.
    """
    f = files.select(F.col("path").cast("string").alias("path"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    f = f.select("path", F.octet_length("content").cast("long").alias("length"), "content")
    f = written(f, "files")  # contents are worked out once, not again after they are counted
    total = f.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    f.repartition(max(1, -(-total // container_bytes)), F.xxhash64("path", "length")).sortWithinPartitions("path").write.mode(mode).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """One text per line, compressed: the field names of JSON documents repeat in every item."""
    documents.write.option("compression", "snappy").option("maxRecordsPerFile", FILE_DOCUMENTS).text(path)


def write_csv(df: DataFrame, path: str, separator: str = ";") -> None:
    """CSV with a header; arrays become one text."""
    flat = [F.array_join(F.col(f.name), separator).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.option("header", True).csv(path)


def route_by_mineral(samples: DataFrame, path: str, minerals: str = "minerals") -> None:
    """One folder per detected mineral; samples without one go to the inconclusive folder."""
    r = samples.withColumn("mineral", F.explode_outer(minerals)).drop(minerals)
    name = F.regexp_replace(F.coalesce("mineral", F.lit(INCONCLUSIVE)), r"[^\w\-. ]+", "_")
    r.withColumn("mineral", name).write.partitionBy("mineral").parquet(path)


def with_run_hash(df: DataFrame, *payload: str) -> DataFrame:
    return df.withColumn("content_hash", payload_hash(*payload))


def append_run(df: DataFrame, path: str, partition: str = "run_date") -> None:
    """Append run rows to a table partitioned by date."""
    df.write.mode("append").partitionBy(partition).parquet(path)


def latest_runs(runs: DataFrame, order: list[Column], limit: int, condition: Column | None = None) -> DataFrame:
    r = runs if condition is None else runs.where(condition)
    return r.orderBy(*order).limit(limit)
