"""The pipeline's stages, one after the other, each on what the one before has kept."""

import corpus_pipeline
from xrdlake.llm import secrets, simhash


SF_DIR = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    sf_dir = SF_DIR
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if i == 1:
            groups = simhash.near_duplicates(docs).select("component_id").distinct().count()
            assert groups == counts[-1]
        if i == 3:
            assert docs.where("text LIKE '%[secret]%'").count() > 0
            assert not any(secrets.scan(r["text"]) for r in docs.collect())
            ids = {r["doc_id"] for r in docs.collect()}
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    assert {r["doc_id"] for r in docs.collect()} == ids
    whole = corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset")
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.drop("sequence_id", "offset").collect()))


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
