"""Quality classifier: a sparse ensemble of rules.

Small regression trees are boosted on a bounded labelled sample; every path from a root to a node
is a conjunctive rule over text statistics. A logistic model with an L1 penalty weighs the rules, most of which get weight zero; the
others are compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm import textstats
from loomspan.llm.common import put_aside, take_back
from loomspan.llm.rules import Condition, Rule, _covers

SAMPLE = 12_000
TREES = 40
DEPTH = 3
LEAF = 10
CUTS = 32
RATE = 0.2
PENALTY = 0.002
STEPS = 600
THRESHOLD = 0.3


def _split(x: np.ndarray, g: np.ndarray, names: tuple[str, ...], columns: np.ndarray) -> Condition | None:
    best, found = 1e-9, None
    total, n = g.sum(), len(g)
    for j in columns:
        order = np.argsort(x[:, j], kind="stable")
        v = x[order, j]
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= LEAF) & (at <= n - LEAF)]
        if not len(at):
            continue
        at = at[np.unique(np.linspace(0, len(at) - 1, min(CUTS, len(at))).astype(int))]
        left = np.cumsum(g[order])[at - 1]
        gain = left**2 / at + (total - left) ** 2 / (n - at) - total**2 / n
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = float(gain[k]), Condition(names[j], True, float((v[at[k]] + v[at[k] - 1]) / 2))
    return found


def _tree(x: np.ndarray, g: np.ndarray, rows: np.ndarray, every: np.ndarray, names: tuple[str, ...], rng: np.random.Generator, path: Rule, out: list[Rule], value: np.ndarray) -> None:
    """Adds the paths of a tree grown on rows to out, and its leaves' means to value for every row that comes to them, drawn or not."""
    value[every] = g[rows].mean() if len(rows) else 0.0
    if len(path) == DEPTH or len(rows) < 2 * LEAF:
        return
    columns = rng.choice(len(names), size=max(1, 2 * len(names) // 3), replace=False)
    c = _split(x[rows], g[rows], names, columns)
    if c is None:
        return
    above = x[:, names.index(c.feature)] >= c.cut
    for at_least in (True, False):
        rule = (*path, Condition(c.feature, at_least, c.cut))
        out.append(rule)
        _tree(x, g, rows[above[rows] == at_least], every[above[every] == at_least], names, rng, rule, out, value)


def _rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], seed: int) -> list[Rule]:
    rng = np.random.default_rng(seed)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    f = np.full(len(y), np.log(p / (1 - p)))
    out: list[Rule] = []
    for _ in range(TREES):
        g = y - 1 / (1 + np.exp(-f))
        rows = np.sort(rng.choice(len(y), size=max(1, len(y) // 2), replace=False))
        value = np.zeros(len(y))
        _tree(x, g, rows, np.arange(len(y)), names, rng, (), paths := [], value)
        f += RATE * 4 * value
        out += paths
    return list(dict.fromkeys(out))


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty by accelerated proximal gradient steps; the intercept is not penalised."""
    n, m = r.shape
    spread = r.std(0)
    use = np.flatnonzero(spread > 1e-9)
    z = (r[:, use] - r[:, use].mean(0)) / spread[use]
    step = 4 * n / (np.linalg.norm(z, 2) ** 2 + n) if len(use) else 1.0
    w, b = np.zeros(len(use)), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, c, t = w, b, 1.0
    for _ in range(STEPS):
        e = 1 / (1 + np.exp(-(z @ v + c))) - y
        new = v - step * (z.T @ e) / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b_new, t_new = c - step * e.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = new, b_new, t_new
    full = np.zeros(m)
    full[use] = w / spread[use]
    return b - float(full @ r.mean(0)), full


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """Probability of label 1."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            every = rule[0].column()
            for c in rule[1:]:
                every = every & c.column()
            total = total + F.when(every, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def train(sample: list[tuple[list[float], int]], names: tuple[str, ...] = textstats.FEATURES, penalty: float = PENALTY, seed: int = 1) -> Ensemble:
    """An empty sample scores everything 0.5; one of a single label its smoothed share."""
    if not sample:
        return Ensemble(0.0, ())
    x, y = np.array([r[0] for r in sample], float), np.array([float(r[1] == 1) for r in sample])
    if y.min() == y.max():
        return Ensemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), ())
    rules = _rules(x, y, names, seed)
    r = np.stack([_covers(rule, x, names) for rule in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    b, w = _lasso(r, y, penalty)
    kept = sorted(((rule, float(v)) for rule, v in zip(rules, w, strict=True) if abs(v) > 1e-4), key=lambda rw: -abs(rw[1]))
    return Ensemble(b, tuple(kept))


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo folds, is 0. A null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> Ensemble:
    """Learns from at most sample labelled rows that are not held out."""
    return train(textstats.labelled_sample(df, labels, target, sample, where=~held_out(F.col("_id"))))


def scored(df: DataFrame, model: Ensemble, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score (0 to 1) and predicted, which replace columns of df with these names; others stay as they are, whatever their names.

    Null and empty texts are scored as texts without words, however long texts are read whole; repeated rows get one score each; no row is dropped. A score of
    just the threshold is predicted 1. An empty table gives an empty table.
    """
    made = textstats.features(textstats.base_stats(put_aside(df), f"own_{text_col}")).withColumn("score", model.column())
    kept = take_back(made, [c for c in df.columns if c not in ("score", "predicted")])
    return made.select(*kept, "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
