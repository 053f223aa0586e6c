"""Documents of orders: lines are collected once, after the shuffle, and files are compressed and bounded."""

import pathlib

from xrdlake.plans import source as P
from xrdlake.session import new_path
from xrdlake.sources import files as A, sinks as Z


def test_lists_are_collected_after_the_shuffle(spark, sf_dir):
    plan = P.order_documents(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert 0 < plan.index("partial_collect_list") < plan.index("Exchange")  # children are printed below


def test_files_are_small_and_read_back(spark, sf_dir, monkeypatch):
    docs = P.order_documents(spark, sf_dir)
    plain, path = new_path(spark, "plain"), new_path(spark, "documents")
    docs.write.text(plain)
    monkeypatch.setattr(Z, "FILE_DOCUMENTS", 40)
    Z.write_documents(docs, path)
    size = lambda p: sum(f.stat().st_size for f in pathlib.Path(p).glob("part-*"))
    assert size(path) < size(plain) / 2
    per = spark.read.text(path).groupBy("_metadata.file_path").count().collect()
    assert max(r["count"] for r in per) <= 40
    rows = lambda p: sorted(map(tuple, A.read_documents(spark, p, P.ORDER_DOC, "items").collect()))
    assert rows(path) == rows(plain)
    assert len(rows(path)) == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
