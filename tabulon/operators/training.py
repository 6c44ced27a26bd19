"""Gradient training of small models over tables: an aggregation an epoch, early stopping, the best weights stored."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.session import remove, ship_code
from tabulon.streaming.early_stop import Stopper

#: A model's arrays by name. They are held by the driver and travel with each epoch's plan, so their size is the model's.
Weights = dict[str, np.ndarray]

#: Numbers of a sum that are added up as one row, and the parts that the tasks' sums are first added up in.
CHUNK, PARTS = 4096, 64


@dataclass(frozen=True)
class Measured:
    """The gradient at some weights, and the mean losses of the rows learnt from and of those held out."""

    gradient: Weights
    train: float
    held: float


@dataclass(frozen=True)
class Fitted:
    """The best weights, the epochs gone through as (epoch, train loss, held-out loss, whether it was the best yet), and where they ended early."""

    weights: Weights
    epochs: list[tuple[int, float, float, bool]]
    stopped_at: int | None


def flatten(weights: Weights) -> np.ndarray:
    return np.concatenate([np.asarray(weights[k], float).ravel() for k in sorted(weights)])


def shaped(flat: np.ndarray, like: Weights) -> Weights:
    """The numbers of ``flatten`` in the shapes of ``like``."""
    out, at = {}, 0
    for k in sorted(like):
        size = np.size(like[k])
        out[k] = flat[at : at + size].reshape(np.shape(like[k]))
        at += size
    return out


def sum_over(rows: DataFrame, size: int, run: Callable[[Iterator[pa.RecordBatch]], np.ndarray], chunk: int = CHUNK, parts: int = PARTS) -> np.ndarray:
    """The sum over all tasks of the ``size`` numbers that ``run`` makes of a task's rows.

    What is shuffled is a vector a task, in chunks; a chunk is added up in ``parts`` parts and then whole, so no row grows with the
    table, and a group is as many chunks as a ``parts``-th of the tasks. Only the sum reaches the driver.
    """
    starts = range(0, size, chunk)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = run(batches)
        part = TaskContext.get().partitionId() % parts
        yield pa.record_batch([pa.array(range(len(starts)), pa.int32()), pa.array([part] * len(starts), pa.int32()), pa.array([total[s : s + chunk] for s in starts], pa.list_(pa.float64()))], names=["chunk", "part", "v"])

    def added(table: pa.Table) -> pa.Table:
        column = table.column("v").combine_chunks()
        total = column.flatten().to_numpy().reshape(len(column), -1).sum(axis=0)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "part": table.column("part").slice(0, 1), "v": pa.array([total], pa.list_(pa.float64()))})

    ship_code(rows.sparkSession)
    kind = "chunk int, part int, v array<double>"
    partial = rows.mapInArrow(task, kind).groupBy("chunk", "part").applyInArrow(added, kind)
    total = np.zeros(size)
    for r in partial.groupBy("chunk").applyInArrow(added, kind).collect():  # as much as the model
        total[r["chunk"] * chunk : r["chunk"] * chunk + len(r["v"])] = r["v"]
    return total


def descend(spark: SparkSession, weights: Weights, measure: Callable[[Weights], Measured], patience: int, epochs: int, rate: float, decay: float = 0.0, path: str | None = None) -> Fitted:
    """Adam's steps along what ``measure`` gives, until the held-out loss stops improving; the best weights are kept.

    With ``path`` they are stored there at each improvement, before the older ones go, so that a lost driver leaves the best so far (``load``).
    ``decay`` is taken from the weights themselves, apart from the gradient. A loss that is not a number counts as an improvement, as in ``early_stop``.
    """
    if epochs < 1:
        raise ValueError("there must be an epoch")
    flat, first, second = flatten(weights), 0.0, 0.0
    stopper, done, best, at = Stopper(patience), [], weights, None
    for epoch in range(epochs):
        now = shaped(flat, weights)
        found = measure(now)
        improved = stopper.step(found.held)
        done.append((epoch, found.train, found.held, improved))
        if improved:
            best = now
            if path:
                store(spark, best, path, epoch)
        if stopper.stopped:
            at = epoch
            break
        slope = flatten(found.gradient)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        step = first / (1 - 0.9 ** (epoch + 1)) / (np.sqrt(second / (1 - 0.999 ** (epoch + 1))) + 1e-8)
        flat = flat - rate * (step + decay * flat)
    return Fitted(best, done, at)


def store(spark: SparkSession, weights: Weights, path: str, epoch: int) -> None:
    """The arrays below ``path`` as the weights of ``epoch``; those of other epochs go once these are written."""
    rows = [(k, [*map(int, np.shape(v))], [*map(float, np.ravel(v))]) for k, v in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    for r in spark.read.parquet(path).select("epoch").distinct().collect():
        if r["epoch"] != epoch:
            remove(spark, f"{path}/epoch={r['epoch']}")


def load(spark: SparkSession, path: str) -> Weights:
    """The newest weights that ``descend`` has stored whole."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("epoch")).first()[0]
    return {r["name"]: np.array(r["numbers"], float).reshape(r["shape"]) for r in rows.filter(F.col("epoch") == newest).collect()}


def starting(seed: int, **shapes: tuple[int, ...]) -> Weights:
    """Seeded uniform weights within one over the root of an array's last length; arrays of one length, and names that end in ``bias``, begin at zero."""
    draw = np.random.default_rng(seed)
    return {k: np.zeros(s) if len(s) < 2 or k.endswith("bias") else draw.uniform(-1, 1, s) / np.sqrt(s[-1]) for k, s in shapes.items()}
