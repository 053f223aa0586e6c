"""Containment joins on the rarest piece."""

import random

import pytest

from xrdlake.operators import keys as K


@pytest.fixture
def data(spark):
    rnd = random.Random(2)
    # every text and every pattern begins alike; patterns differ in the middle
    texts = [(i, "common prefix " + "".join(rnd.choices("abc", k=12)), "other") for i in range(300)] + [(900, "", "x"), (901, None, "x"), (902, "co", "x")]
    pats = [(f"p{i}", "common prefix " + "".join(rnd.choices("abc", k=5))) for i in range(40)] + [("q0", "prefix"), ("q1", "co"), ("q2", ""), ("q3", None), ("q4", "common zzz"), ("q5", "prefix")]
    return texts, pats, spark.createDataFrame(texts, "id long, txt string, note string"), spark.createDataFrame(pats, "pid string, pat string")


def test_equals_plain_containment(data):
    texts, pats, t, p = data
    for gram in (2, 3, 8):
        got = sorted((r["id"], r["pid"]) for r in K.contains_join(t, "txt", p, "pat", gram).select("id", "pid").collect())
        assert got == sorted((i, k) for i, x, _ in texts for k, q in pats if x and q and q in x)


def test_common_beginnings_are_no_key(data):
    texts, pats, t, p = data
    pieces = t.selectExpr("explode(array_distinct(transform(sequence(1, length(txt) - 2), i -> substring(txt, i, 3)))) AS _g").where("length(_g) = 3")
    keys = {r["pat"]: r["_g"] for r in K.rarest_pieces(pieces, p, "pat", 3).collect()}
    held = {g: sum(g in (x or "") for _, x, _ in texts) for g in keys.values()}
    assert "common zzz" not in keys  # no text holds all its pieces
    long = [q for k, q in pats if k.startswith("p") and q in keys]
    assert len(long) > 30 and max(held[keys[q]] for q in long) < 200 < held["com" if "com" in held else keys["prefix"]]
