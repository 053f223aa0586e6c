"""Set operations: ordered dedup, term tables, unions, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from xrdlake.functions.text import ascii_key, lookup_key


def union_all(*frames: DataFrame) -> DataFrame:
    """Union of outputs by column name; columns one side lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def split_terms_table(df: DataFrame, key: str, text: str, separators=r"[;,/|\n]+") -> DataFrame:
    """One row per (key, term) with the first spelling of each term.

    Long texts hold many terms, so first spellings are found by a hash
    aggregate (partial on the map side), not by comparing terms in a row.
    """
    parts = df.select(key, F.posexplode(F.split(text, separators)).alias("pos", "v"))
    parts = parts.select(key, "pos", F.trim("v").alias("v"), ascii_key("v").alias("k")).where("k IS NOT NULL")
    return parts.groupBy(key, "k").agg(F.min_by("v", "pos").alias("v"))


def ordered_dedup(df: DataFrame, key: str, text: str, position: str) -> DataFrame:
    """First text per folded key and group, with its position."""
    k = df.select(key, F.col(position).alias("pos"), F.trim(text).alias("v"), lookup_key(text).alias("k")).where("k IS NOT NULL")
    return k.groupBy(key, "k").agg(F.min("pos").alias("pos"), F.min_by("v", "pos").alias("v"))


def missing_members(have: DataFrame, full: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``full`` without a partner in ``have``."""
    return full.join(have.select(*keys).distinct(), keys, "left_anti")


def ids_in_all(*frames: DataFrame) -> DataFrame:
    """Ids found in every frame."""
    return reduce(lambda a, b: a.intersect(b), frames)
