"""Pre-training of two encoders together: what their last projections must be for the two vectors of a row to meet."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.dense import Linear, block, lists, softmax, unit
from tabulon.operators.training import Fitted, Measured, Weights, descend, flatten, shaped, starting, sum_over
from tabulon.session import cut, ship_code

#: The columns of the losses of a batch.
LOSSES = ("contrastive", "isotropy", "cross", "total")


@dataclass(frozen=True)
class Terms:
    """The loss: contrastive, plus ``isotropy`` times the spread of the first vectors' eigenvalues, plus ``cross`` over the contrastive loss times the mean
    squared cross-covariance. A term of weight 0 is an ablation."""

    isotropy: float = 1.0
    cross: float = 0.5
    eps: float = 1e-6


def batch_loss(weights: Weights, x: np.ndarray, y: np.ndarray, terms: Terms, share: float | None = None) -> tuple[np.ndarray, Weights]:
    """The losses of one batch and the gradient of their total. ``first`` and ``second`` project, ``scale`` is the logarithm of the similarities' factor,
    which counts as 100 at most. The weight of the cross term, ``share`` if given, is held as it is, so no gradient goes through it.
    """
    n, scale = len(x), float(weights["scale"][0])
    g, t = x @ weights["first"].T, y @ weights["second"].T
    u, v, factor = unit(g), unit(t), min(np.exp(scale), 100.0)
    alike = u @ v.T
    there, back = softmax(factor * alike), softmax(factor * alike.T).T
    at = np.arange(n)
    contrastive = -(np.log(np.maximum(there[at, at], 1e-300)) + np.log(np.maximum(back[at, at], 1e-300))).mean() / 2
    away = there + back
    away[at, at] -= 2
    away /= 2 * n
    du, dv = factor * away @ v, factor * away.T @ u
    width = u.shape[1]
    spread = u.T @ u / n
    trace = np.trace(spread)
    isotropy = max(0.0, (spread * spread).sum() / width - (trace / width) ** 2)
    du = du + terms.isotropy * 4 / n * (u @ spread / width - trace / width**2 * u)
    gc, tc, below = g - g.mean(axis=0), t - t.mean(axis=0), n - 1 + terms.eps
    both = gc.T @ tc / below
    cross = (both * both).mean()
    share = terms.cross / (contrastive + terms.eps) if share is None else share
    pull = 2 * share / both.size / below
    dg = _through_unit(g, u, du) + pull * tc @ both.T
    dt = _through_unit(t, v, dv) + pull * gc @ both
    slope = factor * (away * alike).sum() if np.exp(scale) <= 100 else 0.0
    total = contrastive + terms.isotropy * isotropy + share * cross
    return np.array([contrastive, isotropy, cross, total]), {"first": dg.T @ x, "second": dt.T @ y, "scale": np.array([slope])}


def _through_unit(g: np.ndarray, u: np.ndarray, du: np.ndarray) -> np.ndarray:
    """The gradient before the vectors were brought to length one."""
    return (du - u * (u * du).sum(axis=1, keepdims=True)) / np.maximum(np.sqrt((g * g).sum(axis=1, keepdims=True)), 1e-12)


def _prepared(df: DataFrame, batch: str, a: str, b: str, held: str | None, widths: tuple[int, int]) -> DataFrame:
    """The rows with two whole vectors, those of a batch in one task and one after the other."""
    whole = lambda c, w: (F.size(c) == w) & ~F.exists(c, lambda x: x.isNull())
    flag = F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)
    rows = df.select(F.col(batch).alias("g"), flag.alias("held"), F.col(a).cast("array<double>").alias("x"), F.col(b).cast("array<double>").alias("y"))
    return rows.filter(whole("x", widths[0]) & whole("y", widths[1])).repartition("g", "held").sortWithinPartitions("g", "held")


def _groups(batches: Iterator[pa.RecordBatch], widths: tuple[int, int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batches of a task, two rows or more each: the first row, and the vectors. One batch is held at a time."""
    kept: list[pa.RecordBatch] = []

    def whole() -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        if sum(k.num_rows for k in kept) > 1:
            yield kept[0].slice(0, 1), *(np.concatenate([block(k.column(c), w)[0] for k in kept]) for c, w in zip("xy", widths, strict=True))

    for rows in batches:
        if not rows.num_rows:
            continue
        code = [(c := rows.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False))[1:] != c[:-1] for k in ("g", "held")]
        edges = [0, *(np.flatnonzero(code[0] | code[1]) + 1), rows.num_rows]
        for start, end in zip(edges, edges[1:]):
            piece = rows.slice(start, end - start)
            if kept and any(kept[0].column(k)[0] != piece.column(k)[0] and (kept[0].column(k)[0].is_valid or piece.column(k)[0].is_valid) for k in ("g", "held")):
                yield from whole()
                kept = []
            kept.append(piece)
    yield from whole()


def _widths(weights: Weights) -> tuple[int, int]:
    return weights["first"].shape[1], weights["second"].shape[1]


def batch_losses(df: DataFrame, batch: str, a: str, b: str, weights: Weights, terms: Terms = Terms()) -> DataFrame:
    """``batch, n`` and the losses of each batch at ``weights``.

    A batch is made by the caller and its size is the caller's constant: its similarities are held in one task. A null batch is a batch. Rows of which a vector
    is null, has a null or is of another length than the weights' are left out, and so are batches of fewer than two rows. An empty table gives no rows.
    """
    widths, kind = _widths(weights), df.schema[batch].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, x, y in _groups(batches, widths):
            losses, _ = batch_loss(weights, x, y, terms)
            yield pa.record_batch([first.column("g"), pa.array([len(x)], pa.int64()), *(pa.array([float(v)]) for v in losses)], names=[batch, "n", *LOSSES])

    ship_code(df.sparkSession)
    return _prepared(df, batch, a, b, None, widths).mapInArrow(run, f"`{batch}` {kind}, n long, " + ", ".join(f"{name} double" for name in LOSSES))


def align(df: DataFrame, batch: str, a: str, b: str, held: str, out: int, terms: Terms = Terms(), patience: int = 5, epochs: int = 200, rate: float = 1e-2, seed: int = 0, path: str | None = None) -> Fitted:
    """Projections of ``a`` and ``b`` to ``out`` numbers, trained on the batches' mean total loss until that of the held-out ones stops improving.

    The rows are brought together by batch once and written; an epoch is then one pass, in which a task adds the gradients of all its batches to one
    array of the model's size. ``held`` is a boolean column, null counting as false: held-out rows of a batch are a batch of their own. The widths are those of
    the longest vectors; what is left out is as in ``batch_losses``. Without batches on both sides it is an error.
    """
    spark = df.sparkSession
    widths = df.agg(F.max(F.size(a)), F.max(F.size(b))).first()
    widths = tuple(max(w or 0, 0) for w in widths)
    if not all(widths):
        raise ValueError("there must be vectors on both sides")
    begin = starting(seed, first=(out, widths[0]), second=(out, widths[1])) | {"scale": np.array([np.log(1 / 0.07)])}
    ship_code(spark)
    rows, size = cut(_prepared(df, batch, a, b, held, widths)), len(flatten(begin))

    def measure(weights: Weights) -> Measured:
        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(size + 4)
            for first, x, y in _groups(batches, widths):
                losses, gradient = batch_loss(weights, x, y, terms)
                if first.column("held")[0].as_py():
                    total[size + 2 :] += 1, losses[-1]
                else:
                    total[:size] += flatten(gradient)
                    total[size : size + 2] += 1, losses[-1]
            return total

        found = sum_over(rows, size + 4, run)
        n, train, m, other = found[size:]
        if not n or not m:
            raise ValueError("there must be batches to learn from and batches held out")
        return Measured(shaped(found[:size] / n, begin), float(train / n), float(other / m))

    return descend(spark, begin, measure, patience, epochs, rate, path=path)


def project(df: DataFrame, vector: str, weight: np.ndarray, out: str) -> DataFrame:
    """``df`` with the projected vector; null where the vector does not fit the weights."""
    names, head = df.columns, Linear(weight, np.zeros(len(weight)))
    if out in names:
        raise ValueError(f"rename the column {out} first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            x, whole = block(rows.column(len(names)), weight.shape[1])
            yield pa.record_batch([*rows.columns[: len(names)], lists(head(x), whole)], names=[*names, out])

    ship_code(df.sparkSession)
    kind = df.withColumn(out, F.lit(None).cast("array<double>")).schema
    return df.select(*names, F.col(vector).cast("array<double>").alias("__vector")).mapInArrow(run, kind)
