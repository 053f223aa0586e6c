"""Spelling variants: words at edit distance one, found through a dictionary of trie-node pairs.

The distinct words are sorted once forwards and once backwards, and the nodes of both tries get dense numbers in that order. A word
is then a row of prefix nodes and a row of suffix nodes. Leaving a position out gives the pair (prefix node, suffix node) around it; an insertion
fits between the two nodes of a cut. Words with a common pair are neighbours, and no others are: two skipped positions in common are a
replacement, a skipped position and a cut an insertion. A pair names the text around one position, so at most one word per code point
of the alphabet holds it, and one word more: groups are bounded by the alphabet, whatever the corpus.
"""

from __future__ import annotations

import os.path
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrdlake.llm.common import NO_ID, ids_of, pick
from xrdlake.session import written

#: Words of the dictionary that one task sorts and numbers.
PART_WORDS = 100_000
#: Different words that a task counts before it hands them on.
HELD_WORDS = 300_000
#: Bytes of Latin-1 text: letters (A-Z lower-cased), all else a space. Code points beyond Latin-1 are no letters either.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))

CUT, SKIP, REPEATED_SKIP = 0, 1, 2


def with_slips(runs: list[bytes], doc_id: int | None, every: int) -> Counter:
    """How often each word of a document occurs, after the slips: a run whose hash ``every`` divides loses one letter."""
    found = Counter(runs)
    begin = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    kinds = list(found)
    hashes = np.fromiter((zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), begin) for w in kinds), np.int64, len(kinds))
    slips = np.flatnonzero(hashes % every == 0)
    moved = [(kinds[k], found.pop(kinds[k]), int(hashes[k])) for k in slips]
    for w, n, h in moved:
        at = h % len(w)
        found[w[:at] + w[at + 1:]] += n
    return found


def vocabulary(docs: DataFrame, least_chars: int, least_count: int, slip_every: int | None = None) -> DataFrame:
    """``word, n``: the runs of letters of at least ``least_chars`` code points that occur ``least_count`` times or more."""
    def count(batches):
        held: Counter = Counter()

        def out():
            rows = [(w.decode("latin-1"), n) for w, n in held.items() if len(w) >= least_chars]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

        for b in batches:
            ids = ids_of(b.column(0)).tolist()
            for a in range(0, b.num_rows, 500):
                for d, text in zip(ids[a:a + 500], b.column(1).slice(a, 500).to_pylist(), strict=True):
                    runs = text.encode("latin-1", "replace").translate(LETTERS).split()
                    held.update(with_slips(runs, None if d == NO_ID else d, slip_every) if slip_every else runs)
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    rows = pick(docs, doc_id="long", text="string").where("text IS NOT NULL")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def common_start(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def numbered(table: pa.Table) -> pa.Table:
    """The words of one part in order, each with its path of nodes, numbered from 1 in the order they are met (0: the root)."""
    rows = sorted(zip(table.column("key").to_pylist(), table.column("word").to_pylist(), strict=True))
    paths, path, last, made = [], [0], "", 0
    for key, _ in rows:
        shared = common_start(last, key)
        path = path[:shared + 1] + list(range(made + 1, made + 1 + len(key) - shared))
        made += len(key) - shared
        last = key
        paths.append(path)
    part = table.column("part")[0].as_py()
    return pa.table({"part": pa.array([part] * len(rows), pa.int32()), "key": pa.array([k for k, _ in rows], pa.string()),
                     "word": pa.array([w for _, w in rows], pa.string()), "path": pa.array(paths, pa.list_(pa.int64()))})


def seams(parts: list) -> list[tuple]:
    """``part, shared, base, carry`` from the first key, last key and last path of every part, in order.

    Nodes 1 to ``shared`` of a part are nodes of the parts before it, ``carry`` holds their numbers; the others follow on ``base``.
    """
    out, base, carry, last = [], 0, [0], ""
    for part, first, end, path in parts:
        shared = common_start(last, first)
        out.append((part, shared, base, carry[:shared + 1]))
        carry = [carry[m] if m <= shared else base + m - shared for m in path]
        base += path[-1] - shared
        last = end
    return out


def trie_paths(words: DataFrame, backwards: bool, part_words: int = PART_WORDS) -> DataFrame:
    """``word, path``: the numbers of the trie nodes of all prefixes (or suffixes), from the root to the word.

    Numbers follow the order of the words, so the last node of a forward path orders words by code point. Parts are ranges of
    ``part_words`` words or so; only one row per part reaches the driver.
    """
    parts = max(1, -(-words.count() // part_words))
    key = F.reverse("word") if backwards else F.col("word")
    dealt = written(words.select("word", key.alias("key")).repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "trie-order")
    local = written(dealt.groupBy("part").applyInArrow(numbered, "part int, key string, word string, path array<long>"), "trie-parts")
    ends = local.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max_by("path", "key").alias("path"))
    fixes = local.sparkSession.createDataFrame(seams([tuple(r) for r in ends.orderBy("first").collect()]), "part int, shared int, base long, carry array<long>")
    number = F.transform("path", lambda m: F.when(m <= F.col("shared"), F.element_at("carry", (m + 1).cast("int"))).otherwise(F.col("base") + m - F.col("shared")))
    return local.join(fixes, "part").select("word", number.alias("path"))


def node_pairs(words: DataFrame) -> DataFrame:
    """``prefix, suffix, kind, id, n``: the node pairs of every word's cuts and skipped positions.

    A position that repeats the letter before it counts for replacements only, so that a pair of words meets once.
    """
    size = F.length("word")
    around = lambda i, skipped: [F.element_at("ahead", i + 1).alias("prefix"), F.element_at("behind", size - i - skipped + 1).alias("suffix")]
    letter = lambda i: F.substring(F.col("word"), i, F.lit(1))
    cuts = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(*around(i, 0), F.lit(CUT).alias("kind")))
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        *around(i, 1), F.when((i > 0) & (letter(i) == letter(i + 1)), REPEATED_SKIP).otherwise(SKIP).alias("kind")))
    return words.select("id", "n", F.inline(F.concat(cuts, skips)))


def neighbours(words: DataFrame) -> DataFrame:
    """``id, n_near, best``: how many words are near, and of them the one with the largest ``n`` (``best.back`` is minus its id)."""
    groups = node_pairs(words).groupBy("prefix", "suffix").agg(F.collect_list(F.struct("n", (-F.col("id")).alias("back"), "kind")).alias("own")).where("size(own) > 1")
    rank = lambda xs: F.array_max(F.transform(xs, lambda y: F.struct(y["n"].alias("n"), y["back"].alias("back"))))
    meets = lambda x, y: ((x["kind"] == CUT) & (y["kind"] == SKIP) | (x["kind"] != CUT) & (
        (y["kind"] != CUT) & (y["back"] != x["back"]) | (y["kind"] == CUT) & (x["kind"] == SKIP)))
    met = groups.select("own", F.explode("own").alias("x")).select((-F.col("x.back")).alias("id"), F.filter("own", lambda y: meets(F.col("x"), y)).alias("near"))
    return met.select("id", F.size("near").cast("long").alias("links"), rank(F.col("near")).alias("best")).groupBy("id").agg(F.sum("links").alias("n_near"), F.max("best").alias("best"))


def followed(up: DataFrame) -> DataFrame:
    """``id, up`` with every pointer led to its end, twice as far each round; pointers lead to ever larger counts, so there are no circles."""
    while True:
        over = up.select(F.col("id").alias("up"), F.col("up").alias("next"))
        stepped = written(up.join(over, "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "roots")
        up = stepped.select("id", "up")
        if stepped.where("moved").isEmpty():
            return up


def group_variants(docs: DataFrame, least_chars: int = 6, least_count: int = 5, ratio: int = 5, slip_every: int | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the corpus.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased, that have ``least_chars`` code points and occur
    ``least_count`` times in all documents. ``n_near`` counts the words at edit distance one. ``form`` is the near word that occurs most (of
    equals, the first by code point) if it does so ``ratio`` times as often as the word, else null; ``root`` is the last form of forms,
    the word itself where it has none. ``slip_every`` puts slips into the texts first, for trials: where crc32 of
    ``<doc_id>:<run>`` is a multiple, that run loses the letter at crc32 modulo its length (a missing id is spelled as nothing).

    Null and empty texts have no words; repeated rows count each; an empty table gives no rows; other columns are not read.
    """
    counted = written(vocabulary(docs, least_chars, least_count, slip_every), "vocabulary")
    ahead = trie_paths(counted, False).withColumnRenamed("path", "ahead")
    behind = trie_paths(counted, True).withColumnRenamed("path", "behind")
    words = written(counted.join(ahead, "word").join(behind, "word").withColumn("id", F.element_at("ahead", -1)), "trie-words")
    near = written(neighbours(words), "near")
    judged = near.join(words.select("id", "n"), "id").where(F.col("best.n") >= ratio * F.col("n"))
    forms = written(judged.select("id", (-F.col("best.back")).alias("up"), F.col("best.n").alias("form_n")), "forms")
    roots = followed(forms.select("id", "up")).select("id", F.col("up").alias("root_id"))
    name = lambda x: words.select(F.col("id").alias(f"{x}_id"), F.col("word").alias(x))
    named = forms.withColumnRenamed("up", "form_id").join(roots, "id").join(name("form"), "form_id").join(name("root"), "root_id").select("id", "form", "root", "form_n")
    return words.select("id", "word", "n").join(near.select("id", "n_near"), "id", "left").join(named, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
