"""Quality rules learned as an ordered list of threshold conjunctions, emitted as Spark conditional expressions.

Sequential covering: a rule grows by the condition of best information gain on two thirds of the labelled rows, is pruned from its end on
the other third, and the rows it covers are taken away before the next. The list says which texts to drop; others are kept.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xrdlake.llm import boosted, text_stats
from xrdlake.session import written

MAX_LABELLED = 20_000


@dataclasses.dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, text_stats.FEATURES.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] > F.lit(self.threshold) if self.above else values[self.feature] <= F.lit(self.threshold)

    def __str__(self):
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def best_condition(x: np.ndarray, bad: np.ndarray, cuts: list[np.ndarray]) -> Condition | None:
    """The condition with the highest gain: bad rows kept, times the rise of the log share of bad rows."""
    p, n = bad.sum(), (~bad).sum()
    before, best, found = np.log2(p / (p + n)), 1e-9, None
    for f, name in enumerate(text_stats.FEATURES):
        if not len(cuts[f]):
            continue
        place = np.searchsorted(cuts[f], x[:, f], "left")  # x <= cut i exactly where place <= i
        low_p = np.bincount(place[bad], minlength=len(cuts[f]) + 1).cumsum()[:-1]
        low_n = np.bincount(place[~bad], minlength=len(cuts[f]) + 1).cumsum()[:-1]
        for above, cp, cn in ((True, p - low_p, n - low_n), (False, low_p, low_n)):
            with np.errstate(all="ignore"):
                gain = np.where(cp > 0, cp * (np.log2(cp / (cp + cn)) - before), 0)
            i = int(gain.argmax())
            if gain[i] > best:
                best, found = gain[i], Condition(name, above, float(cuts[f][i]))
    return found


def learn(x: np.ndarray, quality: np.ndarray, max_conditions: int = 4, least_bad: int = 3) -> list[Rule]:
    """Rules, in order, for rows of quality 0. No rule where one of the labels is missing.

    Rows are dealt to growing and pruning by their place (every third prunes), so equal input gives an equal list. A rule
    is accepted while at least three quarters of what it covers in either part are bad; the first refused rule ends the list.
    """
    bad = quality == 0
    cuts = boosted.edges_of(x, 128) if len(x) else []
    prune = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), bool), []
    while (bad & left & ~prune).sum() >= least_bad:
        own, rule = left & ~prune, ()
        while len(rule) < max_conditions and (own & ~bad).any():
            more = best_condition(x[own], bad[own], cuts)
            if more is None:
                break
            rule += (more,)
            own &= more.holds(x)
        if not rule:
            break

        def worth(r):
            c = covers(r, x) & left & prune
            p, n = (c & bad).sum(), (c & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1

        rule = max((rule[:i] for i in range(len(rule), 0, -1)), key=worth)
        got = covers(rule, x) & left
        if (got & bad).sum() < least_bad or any((got & part & ~bad).sum() > (got & part).sum() / 4 for part in (prune, ~prune)):
            break
        rules.append(rule)
        left &= ~got
    return rules


def verdict(rules: list[Rule], values: dict[str, Column]) -> Column:
    """Ordered conditional expression: the number (from 1) of the first rule that fits, else 0."""
    out = None
    for i, rule in enumerate(rules, 1):
        cond = rule[0].column(values)
        for c in rule[1:]:
            cond = cond & c.column(values)
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """``doc_id``, counts, ``base_failed, rule, kept`` of every row; ``rule`` is the number of the learned rule that drops it, or 0.

    ``base_failed``: under ``least_words`` words, or over ``most_repeated`` percent of them in repeated three-word windows. Null and
    empty texts have no words and so fail. Labels with nulls are not used; without labels only the base rule drops. Repeated
    rows give repeated results, an empty table none; other columns are not read.
    """
    stats = written(boosted.counted(docs), "text-stats")
    rows = boosted.sample(stats, labels, limit)
    rules = learn(boosted.matrix(rows), rows["quality"].to_numpy())
    values = dict(zip(text_stats.FEATURES, text_stats.features({c: F.col(c).cast("double") for c in text_stats.COUNTS}), strict=True))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules, values)).withColumn("kept", ~failed & (F.col("rule") == 0))
