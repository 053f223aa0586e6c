"""Rows dealt to tasks by their record, files by their bytes; texts that are parsed once."""

from pyspark.sql import functions as F

from xrdlake.functions import geochem
from xrdlake.operators import hot, keys, panels as P
from xrdlake.sources import files as A, sinks as Z


def test_tasks_hold_no_more_rows_when_the_input_grows(spark):
    for n in (1_000, 8_000):
        d = hot.dealt(spark.range(n).select((F.col("id") % (n // 2)).alias("record_id")), "record_id", task_rows=500)
        sizes = [len(p) for p in d.rdd.glom().collect()]
        assert len(sizes) == n // 500 and max(sizes) < 1_000
    assert hot.dealt(spark.range(0).withColumnRenamed("id", "record_id"), "record_id").count() == 0


def test_groups_by_record_have_no_partial_table_before_the_shuffle(spark):
    """Counts of records per label are those of plain distinct counts, and rows are dealt by record once."""
    rows = spark.range(600).select((F.col("id") % 200).alias("record_id"), F.concat(F.lit("m"), F.col("id") % 7).alias("mineral"), (F.col("id") % 5).cast("double").alias("v"))
    got = P.aggregate_dimensions(rows, ["mineral"], ["v"])
    want = rows.groupBy("mineral").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("r"))
    assert {(r["label"], r["count_rows"], r["count_records"]) for r in got.collect()} == {tuple(r) for r in want.collect()}
    by_record = P.group_rows_by_record(rows)
    plan = by_record._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert by_record.agg(F.sum("rowspan")).first()[0] == 600


def test_a_later_text_is_parsed_once(spark):
    m = geochem.oxides(F.lit(None).cast("map<string,double>"), F.col("a"), F.col("b"))
    df = spark.createDataFrame([("SiO2 5 %", "SiO2 77,5; MgO: 3")], "a string, b string").select(m.alias("m"))
    assert df.first()["m"] == {"SiO2": 77.5, "MgO": 3.0}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(b") <= 2


def test_terms_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def term(x):
        seen.add(1)
        return f"a long term {x}"
    side = spark.range(20).select(term("id").alias("term"))
    assert keys.matching_terms(side, spark.createDataFrame([("a long term 1",)], "term string")).count() == 11  # 1, and 10 to 19 around it
    assert seen.value <= 20


def test_files_of_one_container_are_parsed_in_many_tasks(spark, tmp_path):
    text = "\n".join(f"{3 + i / 10:.1f} {i}.5" for i in range(20))
    files = spark.range(400).select(F.concat(F.lit("f"), "id").alias("path"), F.lit(text).alias("content"))
    Z.pack_files(files, str(tmp_path / "c"))
    read = A.read_packed_curves(spark, str(tmp_path / "c"))
    assert read.where("points = 20").count() == 400
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
