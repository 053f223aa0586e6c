"""Numbers written with three digits, as the SQL of the file queries writes them."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tools.check_oracle import rows_of
from xrdlake.functions.text import three_digits


def test_as_c_has_it(spark):
    rnd = random.Random(4)
    values = [607.8125, 592.1875, 0.0005, 0.0004999999, 0.0, 5e-324, 1e-9, 0.9995, 0.99949999, 2.0005, 1.0625, 1.1875, 999.9995, 1e6 + 0.0625, 123456789012.3455]
    values += [rnd.uniform(0, 10 ** rnd.randint(-4, 9)) for _ in range(2000)] + [k / 16 for k in range(200)] + [k / 2000 for k in range(1, 400)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", three_digits("v").alias("t"))
    assert [(r["v"], r["t"]) for r in df.collect() if r["t"] != "%.3f" % r["v"]] == []


@pytest.mark.parametrize("name", ["a1_text_curves", "a2_file_inventory", "a18_import_log"])
def test_halves_in_files(spark, tmp_path, name):
    """Intensities half way between two texts: 600 + 125 j / 16."""
    vectors = [[(j * 64 + i) % 127 / 128 - 0.4921875 for i in range(64)] for j in range(3)]
    pq.write_table(pa.table({"vec_id": [0, 1, 57], "label": [0, 1, 2], "embedding": pa.array(vectors, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    res = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in res.description]
    df = entry.queries()[name](spark, str(tmp_path))
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())
