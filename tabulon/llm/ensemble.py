"""Quality classifier: rules from tree paths, weighted by lasso logistic regression, compiled to one Spark expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.rules import FEATURES, Condition, Rule, _covers
from tabulon.llm.statistics import labelled_statistics, with_statistics
from tabulon.llm.text import held_out, table


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    weighted: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1 as a column of sums and conditionals over the statistics."""
        margin = F.lit(self.bias)
        for rule, weight in self.weighted:
            test = rule[0].column()
            for c in rule[1:]:
                test &= c.column()
            margin = margin + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def _tree(x: np.ndarray, gradient: np.ndarray, rows: np.ndarray, names: tuple[str, ...], depth: int, least: int, path: Rule = ()) -> list[tuple[Rule, np.ndarray, float]]:
    """``(path, rows, mean)`` of every node but the root of a regression tree on ``gradient``."""
    here = [(path, rows, float(gradient[rows].mean()))] if path else []
    if not depth or len(rows) < 2 * least:
        return here
    g, best, found = gradient[rows], 1e-9, None
    for k, name in enumerate(names):
        order = np.argsort(x[rows, k], kind="stable")
        v, s = x[rows[order], k], np.cumsum(g[order])
        n = np.arange(1, len(rows))
        able = (v[1:] > v[:-1]) & (n >= least) & (len(rows) - n >= least)
        gain = np.where(able, s[:-1] ** 2 / n + (s[-1] - s[:-1]) ** 2 / (len(rows) - n) - s[-1] ** 2 / len(rows), 0)
        top = int(np.argmax(gain))
        if gain[top] > best:
            best, found = float(gain[top]), (name, k, float((v[top] + v[top + 1]) / 2))
    if not found:
        return here
    name, k, threshold = found
    for above in (False, True):
        inside = x[rows, k] >= threshold if above else x[rows, k] < threshold
        here += _tree(x, gradient, rows[inside], names, depth - 1, least, (*path, Condition(name, above, threshold)))
    return here


def extract_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 5, seed: int = 0) -> list[Rule]:
    """The distinct node paths of gradient-boosted trees, each grown on half of the rows."""
    draw = np.random.default_rng(seed)
    margin, rules = np.zeros(len(x)), {}
    for _ in range(trees):
        gradient = y - 1 / (1 + np.exp(-margin))
        rows = np.sort(draw.permutation(len(x))[: max(2 * least, len(x) // 2)])
        nodes = _tree(x, gradient, rows, names, depth, least)
        inner = {n[0][:-1] for n in nodes}
        for path, _, mean in nodes:
            rules[path] = True
            if path not in inner:  # a leaf
                margin += 4 * rate * mean * _covers(path, x, names)
    return list(rules)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of logistic regression with an absolute-value penalty on the weights (accelerated proximal gradient)."""
    n, step = len(y), 4.0 / (np.linalg.norm(r, 2) ** 2 / len(y) + 1)
    w = z = np.zeros(r.shape[1])
    b = c = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    t = 1.0
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-np.clip(r @ z + c, -500, 500))) - y) / n
        moved = z - step * (r.T @ error)
        w_new, b_new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0), c - step * error.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return float(b), w


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = FEATURES, penalty: float = 2e-4) -> RuleEnsemble:
    """One class, or no rows, gives a constant score."""
    x, y = np.asarray(x, float).reshape(-1, len(names)), np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    rules = extract_rules(x, y, names)
    if not rules:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))), ())
    r = np.stack([_covers(rule, x, names) for rule in rules], axis=1).astype(float)
    bias, weights = lasso(r, y, penalty)
    return RuleEnsemble(bias, tuple((rule, float(w)) for rule, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = 20_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; whole texts.

    Rules and weights come from at most ``max_labelled`` labelled rows, none held out; ids, languages and sources are no
    features. Null and empty texts have all statistics 0 and are scored by them. Rows that repeat a ``doc_id`` are scored
    each; a null ``doc_id`` counts as held out; an empty table gives no rows.
    """
    x, y = labelled_statistics(docs, labels, label, FEATURES, max_labelled)
    model = fit(np.array(x), np.array(y))
    out = with_statistics(docs.select("doc_id", "text"))
    out = out.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its quality score."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
