"""Joins whose left keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrdlake.session import written

#: Left rows of one key that one task joins.
HOT_ROWS = 100_000


#: Rows of one task that groups them by a nearly unique key.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``rows`` dealt by hash of ``keys``, ``task_rows`` to a task on average, to be grouped by these keys (and others).

    Where keys are nearly unique, partial groups before the shuffle save nothing and hold a table of all rows of a split; here a task's table
    stays the same size however large the input is. The rows are counted first, so their plan should be cheap to run twice.
    """
    return rows.repartition(max(1, -(-rows.count() // task_rows)), *keys)


def looked_up(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    """``left`` with the row of ``right`` for its key (one column or several; at most one row each), null where there is none.

    Keys with more than ``HOT_ROWS`` left rows are split, and their row of ``right`` is repeated. The list of such keys has
    at most a row per ``HOT_ROWS`` left rows, so it may be broadcast.
    """
    key = [key] if isinstance(key, str) else key
    hot = left.groupBy(*key).agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("_k")).where("_k > 1")
    hot = written(hot, "hot-keys")
    if hot.isEmpty():
        return left.join(right, key, "left")
    shares = F.coalesce("_k", F.lit(1))
    a = left.join(F.broadcast(hot), key, "left").withColumn("_s", F.pmod(F.hash(*left.columns), shares)).drop("_k")
    b = right.join(F.broadcast(hot), key, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_k")
    return a.join(b, [*key, "_s"], "left").drop("_s")
