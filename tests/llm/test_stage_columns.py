"""The pipeline's stages on tables with names of their own columns, missing values, repeated rows, nothing at all."""

import random

import pytest

import corpus_pipeline
from xrdlake.llm import boosted, decontaminate, pack, secrets

NAMES = ["doc_ID", "TEXT", "doc_id", "text", "text_key_of_row", "leaked_key", "row_key", "n_chars", "kept", "c0", "key", "row_id", "source"]
SCHEMA = "a string, b string, doc_id long, d string, e string, f string, g string, h long, i string, j string, k string, l string, m string"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n)) + "."
    long = prose(120)
    rows = [(i, prose(80)) for i in range(20)] + [(30, long), (31, long), (32, long + " more"), (33, None), (34, ""), (None, prose(60)), (35, "password = Zk82hQ7xPw1m here")]
    rows += [rows[3]] * 3
    return spark.createDataFrame([("X", "Y", d, t, "k1", "k2", "k3", 7, "k4", "k5", "k6", "k7", "s") for d, t in rows], SCHEMA).toDF(*NAMES)


def own(df):
    return sorted(map(str, df.toDF(*[f"v{i}" for i in range(len(df.columns))]).collect()))


def stages(spark, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:4]:
        yield name, lambda df, stage=stage: stage(spark, df, sf_dir)


def test_other_columns_pass_through(spark, sf_dir, docs):
    before = own(docs)
    for name, stage in stages(spark, sf_dir):
        out = stage(docs)
        assert out.columns == NAMES, name
        after = own(out)
        if name != "secret scan":
            assert set(after) <= set(before), name
            assert "simhash" in name or "classifier" in name or len(after) == len(before)
        else:
            assert len(after) == len(before) and sum("[secret]" in x for x in after) == 1 and "v0='X', v1='Y'" in after[0] and "v4='k1', v5='k2'" in after[0]
    assert len(own(corpus_pipeline.drop_near_copies(spark, docs, sf_dir))) == 24  # three copies and three repeats go; null and empty texts are one group


def test_empty_tables(spark, sf_dir, docs):
    none = docs.limit(0)
    for name, stage in stages(spark, sf_dir):
        assert stage(none).count() == 0 and stage(none).columns == NAMES, name
    assert corpus_pipeline.pack_sequences(spark, none, sf_dir).count() == 0
    assert decontaminate.clean(docs, spark.createDataFrame([], "item_id long, text string")).count() == docs.count()


def test_packing_of_repeated_rows(spark, monkeypatch):
    from xrdlake.llm import queries

    monkeypatch.setattr(pack, "SHARD_PIECES", 40)
    rows = [(1, "word " * 3000)] * 200 + [(2, "other words here " * k) for k in range(100)]
    out = pack.pack(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_path()).collect()
    held = {}
    for x in out:
        held.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(x["length"] for x in out) / 2048 > 0.97 * len(held)


def test_constants_are_followed_in_linear_time():
    text = 'x = "Zq8rT5vLw2NbXk9"\npassword = x\n' * 8000
    assert len(secrets.scan(text)) == 8000
    chain = "".join(f"k{i} = k{i + 1}\n" for i in range(3000)) + 'k3000 = "Zq8rT5vLw2NbXk9"\npin = k0\npassword = k5\n'
    assert [k for _, k, _ in secrets.scan(chain)] == [3]


def test_sample_of_one_id(spark):
    labels = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    rows = boosted.counted(spark.createDataFrame([(3, f"text number {i} " * (i % 50)) for i in range(3000)], "doc_id long, text string"))
    got = boosted.sample(rows, labels, 500)
    assert 250 <= len(got) <= 500
