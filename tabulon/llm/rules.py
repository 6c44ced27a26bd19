"""Quality rules: a decision list learned by sequential covering, applied as one ordered Spark conditional."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.statistics import SHARES, labelled_statistics, with_statistics
from tabulon.llm.text import table

FEATURES = ("n_words", "n_lines", *SHARES)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values >= self.threshold if self.above else values < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x[:, names.index(c.feature)])
    return out


def _best_condition(x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> tuple[float, Condition | None]:
    """The threshold with the greatest information gain of FOIL: bad rows kept times bits saved on each."""
    p0, n0 = int(y.sum()), int((~y).sum())
    best, found = 1e-9, None
    if not p0 or not n0:
        return best, None
    base = math.log2(p0 / (p0 + n0))
    for k, name in enumerate(names):
        order = np.argsort(x[:, k], kind="stable")
        v, bad = x[order, k], np.cumsum(y[order])
        ends = np.flatnonzero(v[1:] > v[:-1])  # below: rows up to and with ends; above: the rest
        if not len(ends):
            continue
        below_p, below = bad[ends], ends + 1
        for above, p, n in ((False, below_p, below), (True, p0 - below_p, len(v) - below)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - base), 0)
            top = int(np.argmax(gain))
            if gain[top] > best:
                best, found = float(gain[top]), Condition(name, above, float((v[ends[top]] + v[ends[top] + 1]) / 2))
    return best, found


def learn(x: np.ndarray, good: np.ndarray, names: tuple[str, ...] = FEATURES, max_rules: int = 32, max_conditions: int = 4, least_precision: float = 0.8, least_covered: int = 3) -> list[Rule]:
    """Ordered rules that reject, found by sequential covering.

    Two thirds of the rows grow a rule, condition by condition, until it covers no good row; the last third prunes it from
    the end while its worth (bad - good) / (bad + good) there does not fall. A rule that reaches ``least_precision`` on both parts together, and covers
    ``least_covered`` bad rows, is kept and what it covers is set aside; the first that doesn't ends the list. Rows of one class, or none, give no rules.
    """
    x, bad = np.asarray(x, float).reshape(-1, len(names)), ~np.asarray(good, bool)
    part = np.arange(len(x)) % 3
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < max_rules and (bad & left).any():
        grow, prune = left & (part != 2), left & (part == 2)
        rule: Rule = ()
        inside = grow.copy()
        while len(rule) < max_conditions and (inside & ~bad).any():
            _, condition = _best_condition(x[inside], bad[inside], names)
            if condition is None:
                break
            rule += (condition,)
            inside &= _covers((condition,), x, names)

        def worth(r: Rule, on: np.ndarray) -> float:
            hit = _covers(r, x, names) & on
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1], prune) >= worth(rule, prune):
            rule = rule[:-1]
        hit = _covers(rule, x, names) & left
        if not rule or (hit & bad).sum() < max(least_covered, least_precision * hit.sum()):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional expression: the first rule that holds rejects; a row without one is kept."""
    out = F
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test &= c.column()
        out = out.when(test, F.lit(False))
    return F.lit(True) if out is F else out.otherwise(F.lit(True))


def apply_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = 20_000) -> DataFrame:
    """``docs`` with the statistics, ``base_failed`` and ``kept``.

    The list is learned from at most ``max_labelled`` labelled rows, none held out; ids, sources and languages are no
    features. Texts without words, null ones too, fail the base rule. An empty table gives no rows; without labels
    the base rule alone decides. Columns of ``docs`` stay, but for any with the names of the new ones.
    """
    x, y = labelled_statistics(docs, labels, label, FEATURES, max_labelled)
    rules = learn(np.array(x), np.array(y) == 1)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return with_statistics(docs.drop("base_failed", "kept")).withColumn("base_failed", base).withColumn("kept", ~base & verdict(rules))


def keep_by_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    names = docs.columns
    boxed = docs.select("doc_id", "text", F.struct(*names).alias("__row"))
    return apply_rules(boxed, labels, **options).filter("kept").select(*(F.col("__row")[c].alias(c) for c in names))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its statistics and the verdict of base rule and list."""
    out = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
