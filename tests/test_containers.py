"""Containers of small files: their number, their content, and what readers make of them."""

import pathlib

from xrdlake.sources import files as A, sinks as Z
from xrdlake.streaming import jobs as L


def containers(path):
    return sorted(p for p in pathlib.Path(path).rglob("*.parquet") if not p.name.startswith("."))


def test_packed_files_read_like_single_ones(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for k in range(60):
        (src / f"S{k} (N).xy").write_text("# c\n" + "\n".join(f"{5 + i * 0.02:.2f}\t{100 + i * k}" for i in range(10 + k)))
    (src / "empty.xy").write_text("")
    (src / "bytes.xy").write_bytes(b"\xff\xfe 1 2\n")
    (src / "left.md").write_text("no curve")
    raw = A.raw_files(spark, str(src), A.CURVE_GLOB)
    Z.pack_files(raw, out, container_bytes=10_000)
    total = sum(p.stat().st_size for p in src.glob("*.xy"))
    assert 2 <= len(containers(out)) <= -(-total // 10_000)  # by bytes, not by files
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert rows(A.inventory(A.packed_files(spark, out))) == rows(A.file_inventory(spark, str(src), A.CURVE_GLOB))
    curve = ("two_theta", "intensity", "points", "skipped_rows", "status", "error", "step")
    assert rows(A.read_packed_curves(spark, out).select(*curve)) == rows(A.read_text_curves(spark, str(src), A.CURVE_GLOB).select(*curve))


def test_filter_on_path_is_pushed(spark, tmp_path):
    out = str(tmp_path / "out")
    Z.pack_files(spark.createDataFrame([("b", "two", 1), ("a", "one", 2), ("a", None, 3)], "path string, content string, length int"), out)
    one = A.packed_files(spark, out).where("path = 'a'")
    assert sorted((r.path, r.length, bytes(r.content)) for r in one.collect()) == [("a", 0, b""), ("a", 3, b"one")]
    assert "EqualTo(path,a)" in one._jdf.queryExecution().executedPlan().toString()


def test_no_files(spark, tmp_path):
    out = str(tmp_path / "out")
    Z.pack_files(spark.createDataFrame([], "path string, content string"), out)
    assert A.read_packed_curves(spark, out).count() == 0


def test_stream_reads_only_new_containers(spark, tmp_path):
    src, out, chk = (str(tmp_path / k) for k in ("in", "out", "chk"))
    text = "\n".join(f"{5 + i * 0.5:.2f} {100 + i}" for i in range(20))
    for batch in (["a", "b"], ["c"]):
        Z.pack_files(spark.createDataFrame([(k, text) for k in batch], "path string, content string"), src, mode="append")
        L.triage(L.packed_curve_stream(spark, src), out, chk, lambda df: df.select("path", "points")).awaitTermination()
    got = [(r.path, r.points, r.batch) for r in spark.read.parquet(out).orderBy("path").collect()]
    assert got == [("a", 20, 0), ("b", 20, 0), ("c", 20, 1)]
