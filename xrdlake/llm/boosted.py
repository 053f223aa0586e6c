"""Quality scores from histogram gradient-boosted trees over text statistics.

Trees are grown on the driver from a bounded sample of labelled rows, of statistics only; scoring reads a model
flattened into arrays (feature, threshold, children, value) that numpy walks for a batch of rows at a time.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xrdlake.llm import text_stats
from xrdlake.llm.common import by_place, ids_back, ids_of, pick, place_of, renamed
from xrdlake.session import written

#: Labelled rows that training takes at most, by hashes of their ids.
MAX_LABELLED = 20_000


@dataclasses.dataclass(frozen=True)
class Settings:
    trees: int = 120
    depth: int = 4
    bins: int = 64
    rate: float = 0.1
    smoothing: float = 1.0
    least_rows: int = 8


@dataclasses.dataclass(frozen=True)
class Model:
    """All trees end to end: node ``i`` sends ``x[feature] > threshold`` to ``right``, others to ``left``; leaves point to themselves."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] > self.threshold[node], self.right[node], self.left[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Per feature, increasing cut points at quantiles, midway between neighbouring values."""
    out = []
    for col in x.T:
        kinds = np.unique(col)
        mid = (kinds[1:] + kinds[:-1]) / 2
        out.append(mid if len(mid) < bins else np.unique(np.quantile(mid, np.linspace(0, 1, bins - 1))))
    return out


def train(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Model:
    """Logistic boosting; splits are searched in histograms of gradients and curvatures over binned features."""
    n, wide = x.shape if len(x) else (0, len(text_stats.FEATURES))
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    cols: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def add(value: float) -> int:
        i = len(cols["value"])
        for k, v in (("feature", 0), ("threshold", np.inf), ("left", i), ("right", i), ("value", value)):
            cols[k].append(v)
        return i

    if n and 0 < y.sum() < n:
        edges = edges_of(x, settings.bins)
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        size = settings.bins
        slots = binned + np.arange(wide) * size
        total = np.full(n, base)
        for _ in range(settings.trees):
            p = 1 / (1 + np.exp(-total))
            grad, curve = p - y, p * (1 - p)
            roots.append(add(0.0))
            level = [(roots[-1], np.arange(n))]
            for depth in range(settings.depth + 1):
                following = []
                for node, own in level:
                    g, h = grad[own].sum(), curve[own].sum()
                    best = None
                    if depth < settings.depth and len(own) >= 2 * settings.least_rows:
                        flat = slots[own].ravel()
                        hist = [np.bincount(flat, np.repeat(w, wide), wide * size).reshape(wide, size).cumsum(axis=1) for w in (grad[own], curve[own], np.ones(len(own)))]
                        gl, hl, nl = hist
                        ok = (nl >= settings.least_rows) & (len(own) - nl >= settings.least_rows)
                        gain = np.where(ok, gl ** 2 / (hl + settings.smoothing) + (g - gl) ** 2 / (h - hl + settings.smoothing), -np.inf)
                        f, b = divmod(int(gain.argmax()), size)
                        if gain[f, b] > g ** 2 / (h + settings.smoothing) + 1e-6:
                            best = f, b
                    if best is None:
                        cols["value"][node] = -settings.rate * g / (h + settings.smoothing)
                        total[own] += cols["value"][node]
                        continue
                    f, b = best
                    low = binned[own, f] <= b
                    kids = add(0.0), add(0.0)
                    cols["feature"][node], cols["threshold"][node] = f, float(edges[f][b])
                    cols["left"][node], cols["right"][node] = kids
                    following += [(kids[0], own[low]), (kids[1], own[~low])]
                level = following
    return Model(base, np.array(roots, np.int64), np.array(cols["feature"], np.int64), np.array(cols["threshold"], float),
                 np.array(cols["left"], np.int64), np.array(cols["right"], np.int64), np.array(cols["value"], float), settings.depth)


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row_key`` (a hash of the text) and the statistics of every whole text; the text goes no further."""
    names = ["doc_id", "row_key", *text_stats.COUNTS]

    def count(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                rows = [text_stats.statistics(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([ids_back(ids_of(part.column(0))), part.column(1), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=names)

    rows = pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key"), "text")
    return rows.mapInArrow(count, "doc_id long, row_key long, " + ", ".join(f"{c} long" for c in text_stats.COUNTS))


def held_out(doc_id):
    """Rows that no model learns from: crc32 of the id as text leaves 2 on division by 4 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def matrix(counts) -> np.ndarray:
    """Features, a row per text, from counts by name."""
    return np.stack(text_stats.features({c: np.asarray(counts[c], float) for c in text_stats.COUNTS}), axis=1)


def marks_of(labels: DataFrame) -> DataFrame:
    """One quality per labelled document, the largest where several are given."""
    return pick(labels, doc_id="long", quality="int").where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))


def bounded(rows: DataFrame, limit: int, slices: int = 64, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """At most ``limit`` of the rows: all of them, or those of whole hash slices of their ``keys`` that fit.

    The slices are fine enough that about ``slices`` of them make up the limit, and twice as many are counted; nothing is
    sorted and no task or driver sees more than the limit. The keys are distinct, so the slices are of a size.
    """
    total = rows.count()
    if total <= limit:
        return rows
    slice_ = F.pmod(F.xxhash64(*keys), F.lit(-(-total * slices // max(limit, 1))))
    counts = dict(rows.select(slice_.alias("s")).where(F.col("s") < 2 * slices).groupBy("s").count().collect())
    taken, left = [], limit
    for s in sorted(counts):
        if counts[s] <= left:
            taken.append(s)
            left -= counts[s]
    return rows.where(slice_.isin(taken)) if taken else rows.where(F.lit(False))


def sample(stats: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> pd.DataFrame:
    """At most ``limit`` labelled rows of statistics, chosen by hashes of id and text; equal rows are one, rows without a label are not taken."""
    labelled = stats.join(marks_of(labels), "doc_id").dropDuplicates(["doc_id", "row_key"])
    rows = bounded(labelled, limit, keys=("doc_id", "row_key")).toPandas()
    return rows.sort_values(["doc_id", *text_stats.COUNTS], ignore_index=True)


def trained(stats: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, settings: Settings = Settings()) -> Model:
    rows = sample(stats.where(~held_out(F.col("doc_id"))), labels, limit)
    return train(matrix(rows), rows["quality"].to_numpy(float), settings)


def scored(stats: DataFrame, model: Model, cut: float) -> DataFrame:
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        for b in batches:
            x = matrix({c: b.column(c).to_numpy() for c in text_stats.COUNTS})
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "row_key", "held_out")), pa.array(shared.value.score(x))], names=["doc_id", "row_key", "held_out", "score"])

    return stats.withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(apply, "doc_id long, row_key long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= cut).cast("int"))


def score(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, cut: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, row_key, held_out, score, predicted`` of every row: the likelihood of label 1 from the text's statistics alone.

    Null and empty texts have the statistics of an empty text and are scored like any other; repeated rows get equal
    scores. Without labelled rows, or with one label only, every score is the (smoothed) share of label 1. Labels whose quality or id
    is null are not used; of several labels of a document the largest counts. An empty table gives no rows; other columns are not read.
    """
    stats = written(counted(docs), "text-stats")
    return scored(stats, trained(stats, labels, limit, settings), cut)


def filtered(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, cut: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, that a classifier like that of ``score`` predicts to be good.

    Null and empty texts are judged by the statistics of an empty text; repeated rows stay or go together; columns of any name pass
    through; an empty table stays empty.

    The sample is drawn from the labels (at most ``limit`` of them, so their ids may be broadcast), of which those that
    ``docs`` holds are learned from. Texts are scored where they stand: neither rows nor texts are shuffled.
    """
    marks = bounded(marks_of(labels).where(~held_out(F.col("doc_id"))), limit)
    plain = pick(docs, doc_id="long", text="string")
    model = trained(counted(plain.join(F.broadcast(marks), "doc_id", "left_semi")), labels, limit, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        rows = [text_stats.statistics(t) for t in texts]
        return pd.Series(shared.value.score(matrix(dict(zip(text_stats.COUNTS, np.array(rows).reshape(-1, len(text_stats.COUNTS)).T, strict=True)))))

    plain = by_place(docs)
    return renamed(plain.where(of(f"c{place_of(docs, 'text')}") >= cut), docs)
