"""Linear classifier heads on embeddings, with their stored form."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.dense import Linear, block, softmax
from tabulon.operators.clean import encode_labels
from tabulon.session import cut, remove, ship_code
from tabulon.streaming.early_stop import Stopper


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.filter(F.col(vector).isNotNull()).withColumn("__x", array_to_vector(F.col(vector).cast("array<double>")))


def fit_head(df: DataFrame, vector: str, label: str, iterations: int = 100, penalty: float = 0.0) -> LogisticRegressionModel:
    """A softmax head of one linear layer, fitted on all rows with a vector and a label. Labels are numbered as ``encode_labels`` does."""
    rows = _vectors(encode_labels(df.filter(F.col(label).isNotNull()), label, "__y"), vector).withColumn("__y", F.col("__y").cast("double"))
    head = LogisticRegression(featuresCol="__x", labelCol="__y", predictionCol="__p", rawPredictionCol="__raw", probabilityCol="__prob", maxIter=iterations, regParam=penalty, family="multinomial")
    return head.fit(rows)


def apply_head(model: LogisticRegressionModel, df: DataFrame, vector: str, out: str = "predicted") -> DataFrame:
    """``df`` with the number of the likeliest class; rows without a vector are left out."""
    return model.transform(_vectors(df, vector)).withColumn(out, F.col("__p").cast("int")).select(*df.columns, out)


def save_head(model: LogisticRegressionModel, path: str) -> None:
    """The weights at ``path``, in place of any that are there."""
    model.write().overwrite().save(path)


def load_head(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


@dataclass(frozen=True)
class Trained:
    """The best weights, the epochs gone through as (epoch, train loss, loss on held-out rows, whether it was the best yet), and where they ended early."""

    head: Linear
    epochs: list[tuple[int, float, float, bool]]
    stopped_at: int | None


def _sums(rows: DataFrame, head: Linear, width: int) -> np.ndarray:
    """One pass over all rows: the gradient's sums, and for training and held-out rows their number and the sum of their losses.

    Every task adds up its own rows block by block and leaves one vector as large as the model; these are added by place. So an epoch
    shuffles a few model sizes, however many rows there are.
    """
    classes = len(head.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * (width + 1) + 4)
        for batch in batches:
            x, whole = block(batch.column("x"), width)
            y = batch.column("y").to_numpy()[whole]
            held = batch.column("held").to_numpy(zero_copy_only=False)[whole].astype(bool)
            shares = softmax(head(x))
            losses = -np.log(np.maximum(shares[np.arange(len(y)), y], 1e-300))
            shares[np.arange(len(y)), y] -= 1
            away = shares[~held]
            total += np.r_[(away.T @ x[~held]).ravel(), away.sum(axis=0), (~held).sum(), losses[~held].sum(), held.sum(), losses[held].sum()]
        yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    out = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(classes * (width + 1) + 4)
    total[out.column("i").to_numpy()] = out.column("v").to_numpy()
    return total


def train_head(df: DataFrame, vector: str, label: str, held: str, patience: int = 7, epochs: int = 100, rate: float = 1.0, penalty: float = 0.0, path: str | None = None) -> Trained:
    """A softmax head of one linear layer, by full-batch gradient steps until the loss on held-out rows stops improving; the best weights are kept.

    ``held`` is a boolean column, null counting as false. An epoch is one aggregation that gives the gradient over the other rows and both losses at the epoch's
    weights; the fold of ``early_stop`` says whether that was an improvement and when to stop. With ``path`` the weights are stored there at each improvement, before
    the older ones go, so that a lost driver leaves the best so far (``load_trained``). Labels are numbered as ``encode_labels`` does over all rows; rows
    without a label, or whose vector is null, has a null or another length than the longest, are left out. Without held-out rows, or without any, it is an error.
    """
    spark = df.sparkSession
    ship_code(spark)
    coded = encode_labels(df.filter(F.col(label).isNotNull()), label, "__y")
    rows = cut(coded.select(F.col(vector).cast("array<double>").alias("x"), F.col("__y").cast("int").alias("y"), F.coalesce(F.col(held), F.lit(False)).alias("held")).filter("x IS NOT NULL"))
    width, classes, n_held, n = rows.agg(F.max(F.size("x")), F.max("y") + 1, F.sum(F.col("held").cast("int")), F.count(F.lit(1))).first()
    if not n or not n_held or n_held == n:
        raise ValueError("there must be rows to learn from and rows held out")
    head, best, stopper, done, at = Linear(np.zeros((classes, width)), np.zeros(classes)), None, Stopper(patience), [], None
    for epoch in range(epochs):
        total = _sums(rows, head, width)
        size = classes * width
        gradient, bias, (n_train, train, n_valid, valid) = total[:size].reshape(classes, width), total[size : size + classes], total[size + classes :]
        improved = stopper.step(float(valid / n_valid))
        done.append((epoch, float(train / n_train), float(valid / n_valid), improved))
        if improved:
            best = head
            if path:
                _store(spark, best, path, epoch)
        if stopper.stopped:
            at = epoch
            break
        head = Linear(head.weight - rate * (gradient / n_train + penalty * head.weight), head.bias - rate * bias / n_train)
    return Trained(best, done, at)


def _store(spark: SparkSession, head: Linear, path: str, epoch: int) -> None:
    rows = [(i, [*map(float, w)], float(b)) for i, (w, b) in enumerate(zip(head.weight, head.bias, strict=True))]
    spark.createDataFrame(rows, "class int, weight array<double>, bias double").coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    older = [r["epoch"] for r in spark.read.parquet(path).select("epoch").distinct().collect() if r["epoch"] < epoch]
    for e in older:
        remove(spark, f"{path}/epoch={e}")


def load_trained(spark: SparkSession, path: str) -> Linear:
    """The newest weights that ``train_head`` has stored whole."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("epoch")).first()[0]
    found = sorted(rows.filter(F.col("epoch") == newest).collect(), key=lambda r: r["class"])
    return Linear(np.array([r["weight"] for r in found]), np.array([r["bias"] for r in found]))


def apply_linear(head: Linear, df: DataFrame, vector: str, out: str = "predicted") -> DataFrame:
    """``df`` with the number of the likeliest class; null where the vector does not fit."""
    width, names = head.weight.shape[1], df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, whole = block(batch.column("__x"), width)
            best = np.zeros(len(whole), np.int32)
            best[whole] = head(x).argmax(axis=1) if len(x) else 0
            yield pa.record_batch([*batch.columns[: len(names)], pa.array(best, mask=~whole)], names=[*names, out])

    ship_code(df.sparkSession)
    given = df.withColumn("__x", F.col(vector).cast("array<double>"))
    return given.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())]))
