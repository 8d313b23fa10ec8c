"""Quality rules: a decision list learned by sequential covering.

Rules that reject a document are conjunctions of thresholds on its statistics. Each is grown one
condition at a time by information gain on two thirds of the labelled rows, then pruned from its end as long as that
does not make it worse on the other third; the rows it covers are taken out and the next rule is
grown, until a rule is not precise enough on the rows held back. The list is one ordered Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm import textstats
from loomspan.llm.common import put_aside, take_back

#: Labelled rows that are learned from at most.
SAMPLE = 8_000
MIN_WORDS = 50
REPEAT_PERCENT = 50
PRECISION = 0.9
RULES = 12
CONDITIONS = 4
CUTS = 48
#: A rule has to cover so many rejected rows of those it is grown on.
SUPPORT = 3


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.cut if self.at_least else F.col(self.feature) < self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        v = x[:, names.index(c.feature)]
        out &= v >= c.cut if c.at_least else v < c.cut
    return out


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """Information gained about the p0 covered positives by keeping p positives and n negatives."""
    return np.where(p > 0, p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> Rule:
    rule: list[Condition] = []
    rows = np.ones(len(x), bool)
    while len(rule) < CONDITIONS and y[rows].any() and not y[rows].all():
        own, target = x[rows], y[rows]
        p0, n0 = int(target.sum()), int((~target).sum())
        best: tuple[float, Condition] | None = None
        for j, name in enumerate(names):
            values = np.unique(own[:, j])
            if len(values) < 2:
                continue
            cuts = np.unique(((values[1:] + values[:-1]) / 2)[np.linspace(0, len(values) - 2, min(CUTS, len(values) - 1)).astype(int)])
            order = np.argsort(own[:, j], kind="stable")
            at = np.searchsorted(own[order, j], cuts)
            below = np.concatenate(([0], np.cumsum(target[order])))[at]
            for at_least, p, n in ((False, below, at - below), (True, p0 - below, n0 - (at - below))):
                gains = np.where(p >= min(SUPPORT, p0), _gain(p, n, p0, n0), -np.inf)
                k = int(gains.argmax())
                if gains[k] > 1e-6 and (best is None or gains[k] > best[0]):
                    best = (float(gains[k]), Condition(name, at_least, float(cuts[k])))
        if best is None:
            break
        rule.append(best[1])
        rows &= _covers((best[1],), x, names)
    return tuple(rule)


def _worth(rule: Rule, x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> float:
    on = _covers(rule, x, names)
    p, n = int(y[on].sum()), int((~y[on]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(sample: list[tuple[list[float], int]], names: tuple[str, ...] = textstats.FEATURES, precision: float = PRECISION) -> list[Rule]:
    """Rules for label 0, in order. An empty sample or one without label 0 gives no rule."""
    if not sample:
        return []
    x, y = np.array([r[0] for r in sample], float), np.array([r[1] == 0 for r in sample])
    held = np.arange(len(x)) % 3 == 2
    out: list[Rule] = []
    while len(out) < RULES and y[~held].any():
        rule = _grow(x[~held], y[~held], names)
        if not rule:
            break
        best = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (_worth(r, x[held], y[held], names), len(r)))
        on = _covers(best, x, names)
        if not on.any() or y[on].mean() < precision or _worth(best, x[held], y[held], names) < 2 * precision - 1:
            break
        out.append(best)
        x, y, held = x[~on], y[~on], held[~on]
    return out


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 for none."""
    out = F
    for k, rule in enumerate(rules, 1):
        every = rule[0].column()
        for c in rule[1:]:
            every = every & c.column()
        out = out.when(every, k)
    return out.otherwise(0) if rules else F.lit(0)


def judged(df: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """df with base statistics, base_failed, rule (number of the rule that rejects, 0 for none) and kept.

    Null and empty texts have no words, so they fail. Columns of df with the added names are replaced, others stay. Everything is
    computed in the row by Spark's own functions, from whole texts; rows are never dropped, repeated ones are judged alike. An empty table gives an empty table.
    """
    made = textstats.features(textstats.base_stats(put_aside(df), f"own_{text_col}"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    made = made.withColumn("base_failed", failed).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    added = [c for c in made.columns if not c.startswith(("_c_", "own_"))]
    return made.select(*take_back(made, [c for c in df.columns if c not in added]), *added)


def learned(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    return learn(textstats.labelled_sample(df, labels, "quality", sample))


def keep(df: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of df that pass, with df's columns as they are."""
    prefixed = df.select(*[F.col(f"`{c}`").alias(f"my_{c}") for c in df.columns])
    return judged(prefixed, rules, f"my_{text_col}").where("kept").select(*[F.col(f"`my_{c}`").alias(c) for c in df.columns])
