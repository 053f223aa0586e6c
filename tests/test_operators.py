import itertools
import random

import pytest
from pyspark.sql import functions as F

from xrdlake.operators import corpus as K, curation as J, geochem as X, keys, matching as M, panels as P
from xrdlake.sources import files as A
from xrdlake.streaming import jobs as L


def greedy(refs, obs, tol):
    used, out = set(), []
    for ri, rt in refs:
        best = None
        for oi, ot in obs:
            d = abs(ot - rt)
            if oi not in used and d <= tol and (best is None or d < best[0]):
                best = (d, oi)
        if best:
            used.add(best[1])
            out.append((ri, best[1]))
    return out


def test_reference_match_against_brute_force(spark):
    rnd = random.Random(1)
    obs = {c: [(i + 1, round(rnd.uniform(4, 9), 2)) for i in range(12)] for c in range(4)}
    refs = {r: [(i, round(rnd.uniform(4, 9), 2)) for i in range(6)] for r in range(3)}
    p = spark.createDataFrame([(c, i, t) for c, v in obs.items() for i, t in v], "curve_id long, peak_index int, two_theta double")
    ln = spark.createDataFrame([(r, i, t, 1.0 + i) for r, v in refs.items() for i, t in v], "reference_id long, line_index int, ref_two_theta double, ref_intensity double")
    got = {(r["curve_id"], r["reference_id"]): r for r in M.match_reference_lines(p, ln).collect()}
    for c, r in itertools.product(obs, refs):
        want = greedy(refs[r], sorted(obs[c]), 0.25)
        if not want:
            assert (c, r) not in got
            continue
        row = got[(c, r)]
        w = sum(1.0 + i for i, _ in want) / sum(1.0 + i for i, _ in refs[r])
        assert row["matched_lines"] == len(want)
        assert row["score"] == pytest.approx(0.45 * len(want) / 6 + 0.55 * w)


def brute_peak_score(ext, pkg):
    used, scores = set(), []
    for _, t, d, i, w in ext:
        best = None
        for j, (_, t2, d2, i2, w2) in enumerate(pkg):
            if j in used:
                continue
            pos = [1 - abs(t - t2) / 0.15] if abs(t - t2) <= 0.15 else []
            pos += [1 - abs(d - d2) / 0.10] if abs(d - d2) <= 0.10 else []
            if pos:
                si = max(0.0, 1 - abs(i - i2) / max(i, i2, 1.0) / 0.5)
                top, weight = max(pos) * 0.60 + si * 0.25, 0.85
                if w is not None and w2 is not None:
                    top, weight = top + 0.10 * max(0.0, 1 - abs(w - w2) / max(w, w2, 1.0) / 0.75), 0.95
                s = top / weight
                if best is None or s > best[0]:
                    best = (s, j)
        if best:
            used.add(best[1])
            scores.append(best[0])
    return round(len(scores) / max(len(ext), 1) * (sum(scores) / len(scores)) + 1e-9, 4) if scores else 0.0


def test_corpus_score_against_brute_force(spark):
    rnd = random.Random(7)

    def peaks():
        return [(k + 1, round(rnd.uniform(5, 9), 3), round(rnd.uniform(9, 11), 3), round(rnd.uniform(5, 100), 1), rnd.choice([None, round(rnd.uniform(0.1, 3), 2)])) for k in range(14)]
    new, old = {i: peaks() for i in range(3)}, {i: peaks() for i in range(10, 15)}
    schema = "id long, peak_index int, two_theta double, d double, intensity double, fwhm double"
    df = lambda m: spark.createDataFrame([(i, *p) for i, v in m.items() for p in v], schema)
    facts = F.struct(F.lit(5.0).alias("start"), F.lit(60.0).alias("end"), F.lit(0.02).alias("step"), F.lit(100).alias("points"))
    meta = lambda m: spark.createDataFrame([(i, f"s{i}", f"Stem{i}", "STEM2" if i == 12 else None) for i in m], "id long, sha string, stem string, sample_code string").withColumn("facts", facts).withColumn("record_id", F.col("id"))
    names = lambda m: spark.createDataFrame([(i, f"m{i % 2}") for i in m], "id long, mineral string")
    got = {(r["in_id"], r["st_id"]): r for r in K.score_pairs(meta(new), meta(old), df(new), df(old), names(new), names(old)).collect()}
    for a, b in itertools.product(new, old):
        peak = brute_peak_score(new[a], old[b])
        cand = 1.0 if a % 2 == b % 2 else 0.0
        want = 1.0 if (a, b) == (2, 12) else 0.25 + 0.55 * peak + 0.20 * cand
        if (a, b) not in got:
            assert want < K.MIN_SCORE + 2e-4
            continue
        assert got[(a, b)]["peak_score"] == pytest.approx(peak, abs=1e-4)
        assert got[(a, b)]["score"] == pytest.approx(want, abs=2e-4)
    assert got[(2, 12)]["exact"] and not got[(0, 10)]["exact"]
    ranked = K.search(K.score_pairs(meta(new), meta(old), df(new), df(old), names(new), names(old)), None).where("in_id = 2").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1)) and ranked[0]["st_id"] == 12 and ranked[0]["status"] == "igual"


def test_peak_set_similarity_of_itself(spark):
    rows = [(1, [(10.0, 8.8, 50.0, 0.2), (20.0, 4.4, 100.0, 0.3)])]
    df = spark.createDataFrame(rows, "id long, p array<struct<t:double,d:double,i:double,w:double>>")
    s = df.select(M.peak_set_similarity(F.col("p"), F.col("p")).alias("s")).first()["s"]
    assert s["score"] == 1.0 and s["matched"] == 2


def test_detector_like_near_join_is_exact(spark):
    rnd = random.Random(2)
    a = [(i, round(rnd.uniform(0, 5), 3)) for i in range(60)]
    b = [(i, round(rnd.uniform(0, 5), 3)) for i in range(60)]
    x = spark.createDataFrame(a, "curve_id long, v double")
    y = spark.createDataFrame(b, "k long, w double")
    got = {(r["curve_id"], r["k"]) for r in M.near_join(x, y, "v", "w", 0.3).collect()}
    assert got == {(i, k) for i, v in a for k, w in b if abs(v - w) <= 0.3}


def test_contains_join_is_exact(spark):
    texts = [(1, "alpha beta"), (2, "xy"), (3, ""), (4, "betabeta"), (5, "z")]
    pats = [("a", "beta"), ("b", "z"), ("c", "xy"), ("d", "pha b")]
    t = spark.createDataFrame(texts, "id long, txt string")
    p = spark.createDataFrame(pats, "pid string, pat string")
    got = {(r["id"], r["pid"]) for r in keys.contains_join(t, "txt", p, "pat").select("id", "pid").collect()}
    assert got == {(i, k) for i, x in texts for k, q in pats if q in x}


def test_unique_links_drop_ambiguous(spark):
    df = spark.createDataFrame([("f", "a", 1), ("f", "a", 1), ("f", "b", 1), ("f", "b", 2)], "kind string, key string, record_id long")
    assert [(r["key"], r["record_id"]) for r in keys.unique_links(df).collect()] == [("a", 1)]


def test_components_are_a_partition(spark):
    rnd = random.Random(4)
    nodes = list(range(60))
    edges = [tuple(sorted(rnd.sample(nodes, 2))) for _ in range(40)] + [(i, i + 1) for i in range(20, 35)]
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in X.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "source long, target long")).collect()}
    assert got == {n: find(n) for n in nodes}


def test_candidate_pairs_lose_no_edge(spark):
    rnd = random.Random(9)
    words = ["red", "blue", "ring", "cog", "bolt"]
    rows = [(i, [rnd.choice(words), rnd.choice(words)], [rnd.choice("ABC") * 3], [rnd.choice("XY") * 3], [rnd.choice("PQ") * 3], rnd.choice(words), rnd.choice(words), rnd.choice(words),
             rnd.choice(words), rnd.choice(["1", "2"]), None, None, rnd.choice("AB"), rnd.uniform(1, 3), rnd.uniform(0, 50), [rnd.gauss(0, 1) for _ in range(5)]) for i in range(40)]
    df = X.prepare(spark.createDataFrame(rows, (
        "record_id long, minerals array<string>, groups array<string>, subjects array<string>, uses array<string>, environment string, rock string, formation string, result_text string,"
        "era string, period string, epoch string, class string, si_al double, clay_fraction double, vector array<double>")))
    ids = df.select(F.col("record_id").alias("source")).join(df.select(F.col("record_id").alias("target")), F.col("source") < F.col("target"))
    full = X.analogy(X.dimension_scores(X.with_records(ids, df))).select("source", "target", "score_total").collect()
    for t in (0.55, 0.70, 0.76):
        pruned = X.analogy(X.dimension_scores(X.with_records(X.candidate_pairs(df, t), df))).where(F.col("score_total") >= t)
        want = {(r["source"], r["target"], r["score_total"]) for r in full if r["score_total"] >= t}
        assert want and {(r["source"], r["target"], r["score_total"]) for r in pruned.collect()} == want
    with pytest.raises(ValueError):
        X.candidate_pairs(df, 0.4)


def test_range_null_rule(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0)], "id long, v double")
    ids = lambda *b: [r["id"] for r in df.where(P.in_range(F.col("v"), *b)).collect()]
    assert ids() == [1, 2] and ids(1.0, None) == [2] and ids(None, 4.0) == []


def test_broken_keys_are_reported(spark):
    child = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, None)], "rid long, k string")
    parents = spark.createDataFrame([(1, "a")], "record_id long, key string")
    got = {(r["record_id"], r["item"]) for r in J.declared(child, "rid", "k", parents, "fk").collect()}
    assert got == {(1, "b"), (2, "a")}
    assert J.required(child, "rid", "k", "k", "need").count() == 1


def test_text_curve_reader(spark, tmp_path):
    good = "# comment\n" + "\n".join(f"{5 + i * 0.02:.2f}\t{100 + i}" for i in range(20)) + "\nbad line\n"
    (tmp_path / "S1 (N).xy").write_text(good)
    (tmp_path / "short.csv").write_text("1;2\n2;3\n")
    (tmp_path / "back.dat").write_text("\n".join(f"{30 - i};{i}" for i in range(12)))
    rows = {r["path"].split("/")[-1]: r for r in A.read_text_curves(spark, str(tmp_path)).collect()}
    s1 = next(v for k, v in rows.items() if k.startswith("S1"))
    assert s1["points"] == 20 and s1["skipped_rows"] == 2 and s1["step"] == pytest.approx(0.02)
    assert rows["short.csv"]["error"] == "too_few_points" and rows["back.dat"]["error"] == "axis_not_increasing"
    inv = A.file_inventory(spark, str(tmp_path), A.CURVE_GLOB)
    assert inv.count() == 3 and inv.where("file_id RLIKE '^snapshot:[0-9a-f]{20}$'").count() == 3


def test_stream_restart_gives_no_duplicates(spark, tmp_path):
    src, out, chk = (str(tmp_path / n) for n in ("src", "out", "chk"))
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "id long, k long")
    df.write.parquet(src)
    for _ in range(2):
        L.run_to_table(spark.readStream.schema(df.schema).parquet(src), out, chk).awaitTermination()
    assert spark.read.parquet(out).count() == 10


def test_hierarchy_by_doubling(spark, monkeypatch):
    chain = [(f"t{i}", f"label{i:02d}", "eon" if i == 64 else "era" if i in (3, 50) else "none", f"t{i + 1}" if i < 64 else None) for i in range(65)]
    more = [("x", "leaf", "none", "t60"), ("x", "leaf", "none", "gone"), ("y", "own", "era", "nowhere"), ("z", None, "eon", None)]
    terms = spark.createDataFrame(chain + more, "term_id string, label string, level string, broader string")
    items = spark.createDataFrame([(1, "t0"), (2, "t4"), (3, "x"), (4, "y"), (5, "z"), (6, "none"), (7, None)], "item long, term_id string")
    rounds = []
    write = keys.written
    monkeypatch.setattr(keys, "written", lambda df, label: rounds.append(label) or write(df, label))
    got = {r["item"]: (r["eon"], r["era"]) for r in keys.resolve_hierarchy(items, terms, ("eon", "era")).collect()}
    assert got == {1: ("label64", "label03"), 2: ("label64", "label50"), 3: ("label64", None), 4: (None, "own"), 5: (None, None), 6: (None, None), 7: (None, None)}
    assert rounds.count("levels") <= 7
    circle = spark.createDataFrame([("a", "l", "eon", "b"), ("b", "m", "eon", "a")], "term_id string, label string, level string, broader string")
    with pytest.raises(RuntimeError):
        keys.resolve_hierarchy(items, circle, ("eon",), most_hops=10)
