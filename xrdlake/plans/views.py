"""Projections of the given tables onto the shapes the operators expect.

The tables hold no diffraction data, so each view maps columns of one of them
to a curve, a candidate, a sample row and so on. Every view is a plain
projection (or a foreign-key join) over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREPARATIONS = ("natural", "glicolado", "calcinado")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def preparation_of(number):
    return F.element_at(F.array(*[F.lit(p) for p in PREPARATIONS]), (number % 3 + 1).cast("int"))


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per curve; axis 3.0-28.2 degrees in steps of 0.4."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("curve_id"),
        F.floor(F.col("vec_id") / 3).cast("long").alias("sample_base"),
        preparation_of(F.col("vec_id")).alias("preparation"),
        F.col("label"),
        F.transform(F.col("embedding"), lambda v, i: F.lit(3.0) + F.lit(0.4) * i.cast("double")).alias("two_theta"),
        F.transform(
            F.col("embedding"),
            lambda v: F.greatest(F.lit(0.0), (v.cast("double") + F.lit(0.6)) * F.lit(1000.0)),
        ).alias("intensity"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same curves, one row per point."""
    c = curves(spark, sf_dir)
    return c.select(
        "curve_id", "sample_base", "preparation",
        F.posexplode(F.arrays_zip("two_theta", "intensity")).alias("idx", "p"),
    ).select("curve_id", "sample_base", "preparation", "idx", "p.two_theta", "p.intensity")


TREATMENT_OF_FLAG = {"N": "natural", "R": "glicolado", "A": "calcinado"}


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mineral candidates per curve: order lines joined to parts."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_quantity", "l_returnflag")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("curve_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        F.col("p_brand").alias("mineral"),
        F.col("p_type").alias("group"),
        F.col("p_name").alias("label"),
        F.round(F.col("l_discount") * 10, 4).alias("score"),
        F.col("l_quantity").alias("lines"),
        F.when(F.col("l_returnflag") == "N", "natural")
        .when(F.col("l_returnflag") == "R", "glicolado")
        .otherwise("calcinado").alias("treatment"),
    )


OXIDE_COLUMNS = (("SiO2", "l_quantity"), ("Al2O3", "l_discount"), ("Fe2O3", "l_tax"), ("MgO", "l_extendedprice"))


def geo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample rows with four oxide columns and five dimensions."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(p, li.l_partkey == p.p_partkey)
        .select(
            F.col("l_orderkey").alias("record_id"),
            F.col("l_linenumber").alias("row_no"),
            F.col("p_brand").alias("mineral"),
            F.col("p_type").alias("group"),
            F.col("o_orderpriority").alias("rock"),
            F.col("o_orderstatus").alias("era"),
            F.col("l_linestatus").alias("environment"),
            *[F.col(src).alias(ox) for ox, src in OXIDE_COLUMNS],
        )
    )


def oxide_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with up to 13 oxides (first 13 dimensions of a vector, negatives missing)."""
    from xrdlake.functions.geochem import OXIDES

    e = table(spark, sf_dir, "embeddings")
    cols = [
        F.when(F.get("embedding", i) >= 0, F.get("embedding", i).cast("double") * 100).alias(ox)
        for i, ox in enumerate(OXIDES)
    ]
    return e.select(F.col("vec_id").alias("record_id"), F.col("label"), *cols)
