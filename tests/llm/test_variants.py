"""Spelling variants against all pairs, numbering against a plain trie, slips against the stated rule."""

import binascii
import random
import re

from pyspark.sql import functions as F

from xrdlake.llm import queries, variants

DOCS = "doc_id long, text string, WORD string, id int, n string"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, least_chars=6, least_count=5, ratio=5, slip_every=None):
    count = {}
    for d, t in rows:
        for w in RUN.findall(t or ""):
            w = w.translate(FOLD)
            h = binascii.crc32(f"{'' if d is None else d}:{w}".encode())
            if slip_every and h % slip_every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] = count.get(w, 0) + 1
    words = {w: n for w, n in count.items() if len(w) >= least_chars and n >= least_count}
    gaps = {}  # candidates by one left-out letter, judged by ``near``
    for w in words:
        for k in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            gaps.setdefault(k, set()).add(w)
    out = {}
    for w, n in words.items():
        others = {v for k in {w} | {w[:i] + w[i + 1:] for i in range(len(w))} for v in gaps[k] if near(v, w)}
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = (form, n, len(others), words[form] if form else None)
    rows = []
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, k, m))
    return sorted(rows)


def result(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], DOCS)


def test_against_all_pairs(spark):
    r = random.Random(5)
    letters = "abÀÉß×ÿ"
    base = ["".join(r.choice(letters) for _ in range(r.randint(4, 9))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "colour", "color"]
    text = []
    for w in base:
        text += [w] * r.choice((1, 5, 30, 200))
        for _ in range(8):
            i = r.randrange(len(w))
            text += [r.choice((w[:i] + w[i + 1:], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1:]))] * r.choice((1, 5, 6, 25))
    r.shuffle(text)
    rows = [(i, " ".join(text[i::50]) + (" WORD.Δwords​ZEBRAS" if i % 3 else "\nzebraS")) for i in range(50)]
    rows += [(None, None), (None, "zebras zebrs"), (7, ""), (8, " \t"), (9, "longword" * 3000), (1, rows[1][1]), (1, rows[1][1])]
    for every in (None, 3, 199):
        want = plain(rows, least_chars=5, least_count=4, ratio=3, slip_every=every)
        assert len(want) > 60 and any(x[2] != x[1] and x[1] for x in want)
        assert result(variants.group_variants(docs_of(spark, rows), 5, 4, 3, every)) == want


def test_real_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = result(queries.op11(spark, sf_dir))
    assert got == plain(docs, slip_every=199) and any(x[1] for x in got)


def test_empty(spark):
    for rows in ([], [(1, None), (2, "of too few words")]):
        df = variants.group_variants(docs_of(spark, rows))
        assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"] and df.count() == 0


def test_numbers_of_many_parts(spark):
    r = random.Random(9)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(400)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for backwards in (False, True):
        turn = (lambda w: w[::-1]) if backwards else (lambda w: w)
        got = {turn(x["word"]): x["path"] for x in variants.trie_paths(df, backwards, part_words=23).collect()}
        node = {}
        for w, path in got.items():
            assert len(path) == len(w) + 1 and path[0] == 0
            for i, m in enumerate(path):
                assert node.setdefault(w[:i], m) == m
        assert sorted(node.values()) == list(range(len(node)))  # dense, one number per prefix
        assert sorted(got, key=lambda w: got[w][-1]) == sorted(got)


def test_groups_are_bounded_by_the_alphabet(spark):
    words = spark.createDataFrame([(f"prefix{c}suffix", 9) for c in "abcdefghij"] + [("prefixsuffix", 100)], "word string, n long")
    words = words.join(variants.trie_paths(words, False).withColumnRenamed("path", "ahead"), "word").join(variants.trie_paths(words, True).withColumnRenamed("path", "behind"), "word")
    words = words.withColumn("id", F.element_at("ahead", -1))
    assert variants.node_pairs(words).groupBy("prefix", "suffix").count().agg(F.max("count")).first()[0] == 11
    assert {x["n_near"] for x in variants.neighbours(words).collect()} == {10}
