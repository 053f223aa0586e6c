"""The corpus pipeline: five stages, each on all that the one before has kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``docs``. Empty tables pass through; null and empty texts have too few
words for the classifier to be sure of and are judged like any other text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from xrdlake.llm import boosted, decontaminate, near_copies, pack, queries, registry, secrets
from xrdlake.session import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier predicts to be good; rows that it rejects go.

    Verdicts belong to rows: where ids repeat with different texts, each text has its own.
    """
    return boosted.filtered(docs, registry.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8 or more): the one with the smallest id."""
    return near_copies.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    return decontaminate.clean(docs, registry.table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced by a mark."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed."""
    return pack.pack(docs, queries.tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scan", hide_secrets),
    ("best-fit packing", pack_sequences),
]

#: Trained scores, groups of fingerprints and packing are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


@registry.query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
