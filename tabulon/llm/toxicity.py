"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.statistics import labelled_rows
from tabulon.llm.text import held_out, table
from tabulon.session import ship_code

#: Characters hashed at once; bounds the memory of scoring whatever the length of a text.
_BLOCK = 1 << 20


@dataclass(frozen=True)
class NGramModel:
    """A character n-gram counts once a document, however often it occurs. ``weights[h]`` is what its hash adds."""

    weights: np.ndarray
    bias: float
    orders: tuple[int, ...]
    bits: int

    def margins(self, texts: list[str]) -> np.ndarray:
        """Sums over the distinct n-grams of each text; only those that carry weight are sorted to make them distinct."""
        total, found = np.full(len(texts), self.bias), []
        for codes, rows in _blocks(texts, max(self.orders) - 1):
            for size, feature in _hashes(codes, self.orders, self.bits):
                inside = rows[: len(feature)] == rows[size - 1 :]
                at = np.flatnonzero(inside & (self.weights[feature] != 0))
                found.append(rows[at].astype(np.int64) << self.bits | feature[at])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        np.add.at(total, pairs >> self.bits, self.weights[pairs & ((1 << self.bits) - 1)])
        return total

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -500, 500)))


def _blocks(texts: list[str], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points and row numbers of all texts, a block at a time; a long text's blocks overlap by ``overlap``."""
    codes, rows, held = [], [], 0
    for row, text in enumerate(texts):
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        for start in range(0, max(1, len(points) - overlap), _BLOCK):
            part = points[start : start + _BLOCK + overlap]
            codes.append(part)
            rows.append(np.full(len(part), row, np.int32))
            held += len(part)
            if held >= _BLOCK:
                yield np.concatenate(codes), np.concatenate(rows)
                codes, rows, held = [], [], 0
    if codes:
        yield np.concatenate(codes), np.concatenate(rows)


def _hashes(codes: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each n in ``orders`` the hashes, below 2**bits, of all runs of n code points."""
    value = codes.astype(np.uint64)
    h = np.zeros(len(value), np.uint64)
    for n in range(1, min(max(orders), len(value)) + 1):
        h = h[: len(value) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + value[n - 1 :] + np.uint64(1)
        if n in orders:
            yield n, ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def _present(text: str, orders: tuple[int, ...], bits: int, seen: np.ndarray) -> np.ndarray:
    """The distinct features of one text. ``seen`` is a scratch array of 2**bits False."""
    for codes, _ in _blocks([text], max(orders) - 1):
        for _, feature in _hashes(codes, orders, bits):
            seen[feature] = True
    found = np.flatnonzero(seen).astype(np.int32)
    seen[found] = False
    return found


def fit(texts: list[str], labels: np.ndarray, orders: tuple[int, ...] = (4, 5, 6), bits: int = 20, keep: int = 2000, least: float = 2.5, penalty: float = 1e-4, rounds: int = 150) -> NGramModel:
    """Logistic regression on the n-grams with the greatest log-count ratios, each feature scaled by its ratio.

    The ratio of a feature is the log of its smoothed share of positive documents over that of negative ones. Features
    are ranked by the ratio in standard errors, at least ``least`` of them, so that rare accidents do not crowd out
    common signs; ``keep`` stay. One class only, or no rows, gives a constant score.
    """
    labels = np.asarray(labels, float)
    positive, negative = labels.sum(), (1 - labels).sum()
    if not positive or not negative:
        share = float(np.clip(positive / len(labels), 0.01, 0.99)) if len(labels) else 0.01
        return NGramModel(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))), orders, bits)
    p, q, seen, each = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(1 << bits, bool), []
    for text, label in zip(texts, labels, strict=True):
        each.append(_present(text, orders, bits, seen))
        (p if label else q)[each[-1]] += 1
    ratio = np.log((p + 1) / (positive + 2)) - np.log((q + 1) / (negative + 2))
    strength = np.abs(ratio) / np.sqrt(1 / (p + 1) + 1 / (q + 1))
    chosen = np.argsort(-strength, kind="stable")[:keep]
    chosen = chosen[strength[chosen] >= least]
    number = np.full(1 << bits, -1, np.int64)
    number[chosen] = np.arange(len(chosen))
    columns = [c[c >= 0] for c in (number[x] for x in each)]
    row, column = np.repeat(np.arange(len(columns)), [len(c) for c in columns]), np.concatenate(columns)
    scale = ratio[chosen]
    weight, bias = np.zeros(len(chosen)), float(np.log(positive / negative))
    balance = np.where(labels > 0, 0.5 / positive, 0.5 / negative)
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, rounds + 1):  # Adam on the whole sample; the last entry is the bias
        margin = np.bincount(row, (weight * scale)[column], len(labels)) + bias
        error = balance * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels)
        gradient = np.append(np.bincount(column, error[row], len(chosen)) * scale + penalty * weight, error.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        step = 0.05 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * first / (np.sqrt(second) + 1e-8)
        weight, bias = weight - step[:-1], bias - float(step[-1])
    weights = np.zeros(1 << bits, np.float32)
    weights[chosen] = weight * scale
    return NGramModel(weights, bias, orders, bits)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int, max_bytes: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of a drawn sample of the labelled rows, fewer of them if they hold more than ``max_bytes``."""
    rows = labelled_rows(docs, labels, label, max_labelled)
    joined = rows.select(F.coalesce("text", F.lit("")).alias("text"), "__label", F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(1 << 20)).alias("__draw"))
    size = joined.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, max_bytes / max(1, size))
    drawn = sorted(joined.filter(F.col("__draw") < int(share * (1 << 20))).select("text", "__label").collect())
    return [r["text"] for r in drawn], np.array([r["__label"] for r in drawn], float)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = 10_000, max_bytes: int = 32 << 20, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, whole texts.

    The model is fitted on a bounded sample of the labelled rows (``max_labelled``, ``max_bytes``), none of which is held
    out; only the text is a feature. Null and empty texts get the score of a text without n-grams of note. Rows that
    repeat a ``doc_id`` are scored each; a null ``doc_id`` counts as held out; an empty table gives no rows.
    """
    ship_code(docs.sparkSession)
    model = fit(*labelled_texts(docs, labels, label, max_labelled, max_bytes))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                scores = shared.value.scores(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), part.column(2), pa.array(scores)], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    scored = rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its toxicity score."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
