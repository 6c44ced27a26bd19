"""Gated fusion of two vectors of a row: a router weighs two experts, a classifier tells the class from what they make together."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.dense import Linear, block, erf, gelu, lists, softmax, unit
from tabulon.operators.clean import encode_labels
from tabulon.operators.training import Fitted, Measured, Weights, descend, flatten, shaped, starting, sum_over
from tabulon.session import cut, ship_code

#: Rows that are multiplied at once.
ROWS = 2048


@dataclass(frozen=True)
class GatedFusion:
    """The router maps both normalised vectors side by side to a hidden layer and to two scores; each expert maps its own vector.

    ``least`` is the smallest weight of an expert. Without a ``router`` both weigh a half, the fixed fusion. Its size is that of the model, which travels
    with the plan.
    """

    first: Linear
    second: Linear
    classifier: Linear
    router: tuple[Linear, Linear] | None = None
    least: float = 0.01

    def __call__(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights, fused vectors and scores of the classes."""
        if self.router is None:
            weights = np.full((len(a), 2), 0.5)
        else:
            hidden, out = self.router
            weights = self.least + (1 - 2 * self.least) * softmax(out(gelu(hidden(np.concatenate([unit(a), unit(b)], axis=1)))))
        fused = weights[:, :1] * gelu(self.first(a)) + weights[:, 1:] * gelu(self.second(b))
        return weights, fused, self.classifier(fused)


def gated_fusion(rows: DataFrame, a: str, b: str, model: GatedFusion) -> DataFrame:
    """``rows`` with ``routing`` (the weights of the two experts), ``fused``, ``scores`` and ``predicted``, the number of the best class.

    Vectors are multiplied ``ROWS`` rows at a time, straight from Arrow's own memory. A row of which a vector is null, has a null or is of
    another length than the model's has nulls. Equal scores give the smaller class. An empty table stays empty. Columns named like the new ones must be
    renamed first.
    """
    made = ["routing", "fused", "scores", "predicted"]
    if taken := set(made) & set(rows.columns):
        raise ValueError(f"rename the columns {sorted(taken)} first")
    names = rows.columns
    widths = model.first.weight.shape[1], model.second.weight.shape[1]
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, doubles) for n in made[:3]], T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                (x, has_x), (y, has_y) = (block(batch.column(len(names) + k).cast(pa.list_(pa.float64())), w) for k, w in enumerate(widths))
                both = has_x & has_y
                weights, fused, scores = model(x[has_y[has_x]], y[has_x[has_y]])
                best = np.zeros(len(both), np.int32)
                best[both] = scores.argmax(axis=1) if len(scores) else 0
                yield pa.record_batch([*batch.columns[: len(names)], *(lists(v, both) for v in (weights, fused, scores)), pa.array(best, mask=~both)], names=[*names, *made])

    ship_code(rows.sparkSession)
    given = rows.select(*rows.columns, F.col(a).cast("array<double>").alias("__a"), F.col(b).cast("array<double>").alias("__b"))
    return given.mapInArrow(run, schema)


#: The layers by the names of their weights; a layer's bias is named after it.
_LAYERS = ("first", "second", "classifier", "router", "router_out")


def model_of(weights: Weights, least: float = 0.01) -> GatedFusion:
    """The model that named arrays make; without those of a router it is the fixed fusion."""
    layer = {k: Linear(weights[k], weights[f"{k}_bias"]) for k in _LAYERS if k in weights}
    return GatedFusion(layer["first"], layer["second"], layer["classifier"], (layer["router"], layer["router_out"]) if "router" in layer else None, least)


def starting_weights(widths: tuple[int, int], hidden: int, classes: int, router: bool = True, seed: int = 0) -> Weights:
    """Seeded weights to train from; the router's last ones are small, so that both experts weigh about a half at first."""
    shapes = {"first": (hidden, widths[0]), "second": (hidden, widths[1]), "classifier": (classes, hidden)}
    if router:
        shapes |= {"router": (hidden, sum(widths)), "router_out": (2, hidden)}
    found = starting(seed, **shapes, **{f"{k}_bias": s[:1] for k, s in shapes.items()})
    if router:
        found["router_out"] = np.random.default_rng(seed + 1).normal(0, 0.01, (2, hidden))
    return found


def _gelu_slope(x: np.ndarray) -> np.ndarray:
    return (1 + erf(x / math.sqrt(2))) / 2 + x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def fusion_loss(weights: Weights, a: np.ndarray, b: np.ndarray, y: np.ndarray, least: float = 0.01) -> tuple[np.ndarray, Weights]:
    """The cross-entropy of each row at its class ``y``, and the gradient of their sum."""
    model, out, at = model_of(weights, least), {}, np.arange(len(y))

    def back(name: str, slope: np.ndarray, below: np.ndarray) -> np.ndarray:
        out[name], out[f"{name}_bias"] = slope.T @ below, slope.sum(axis=0)
        return slope @ weights[name]

    pre = model.first(a), model.second(b)
    made = [gelu(z) for z in pre]
    shares = np.full((len(a), 2), 0.5)
    if model.router:
        joined = np.concatenate([unit(a), unit(b)], axis=1)
        hidden = model.router[0](joined)
        raw = softmax(model.router[1](gelu(hidden)))
        shares = least + (1 - 2 * least) * raw
    fused = shares[:, :1] * made[0] + shares[:, 1:] * made[1]
    likely = softmax(model.classifier(fused))
    losses = -np.log(np.maximum(likely[at, y], 1e-300))
    likely[at, y] -= 1
    slope = back("classifier", likely, fused)
    for k, (name, given) in enumerate((("first", a), ("second", b))):
        back(name, slope * shares[:, k : k + 1] * _gelu_slope(pre[k]), given)
    if model.router:
        to_shares = (1 - 2 * least) * np.stack([(slope * m).sum(axis=1) for m in made], axis=1)
        to_scores = raw * (to_shares - (raw * to_shares).sum(axis=1, keepdims=True))
        back("router", back("router_out", to_scores, gelu(hidden)) * _gelu_slope(hidden), joined)
    return losses, out


def train_fusion(df: DataFrame, a: str, b: str, label: str, held: str, hidden: int, router: bool = True, patience: int = 3, epochs: int = 100, rate: float = 1e-2, seed: int = 0, least: float = 0.01, path: str | None = None) -> Fitted:
    """Experts, router and classifier trained on frozen vectors until the loss on held-out rows stops improving; ``model_of`` makes the model of the weights.

    An epoch is one pass over all rows, whose tasks add their rows' gradients up, ``ROWS`` rows at a time. ``held`` is a boolean column, null counting as false.
    Labels are numbered as ``encode_labels`` does over all rows. Rows without a label, or of which a vector is null, has a null or another length than the
    longest, are left out. Without rows to learn from or held-out ones it is an error.
    """
    ship_code(df.sparkSession)
    coded = encode_labels(df.filter(F.col(label).isNotNull()), label, "__y")
    vectors = [F.col(c).cast("array<double>").alias(n) for c, n in ((a, "a"), (b, "b"))]
    rows = cut(coded.select(*vectors, F.col("__y").cast("int").alias("y"), F.coalesce(F.col(held), F.lit(False)).alias("held")).filter("a IS NOT NULL AND b IS NOT NULL"))
    *widths, classes = rows.agg(F.max(F.size("a")), F.max(F.size("b")), F.max("y") + 1).first()
    if not all(widths):
        raise ValueError("there must be rows to learn from and rows held out")
    begin = starting_weights(tuple(widths), hidden, classes, router, seed)
    size = len(flatten(begin))

    def measure(weights: Weights) -> Measured:
        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros(size + 4)
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    (x, has_x), (z, has_z) = (block(batch.column(c), w) for c, w in zip("ab", widths, strict=True))
                    both = has_x & has_z
                    x, z, y = x[has_z[has_x]], z[has_x[has_z]], batch.column("y").to_numpy()[both]
                    away = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)[both]
                    if not away.all():
                        losses, gradient = fusion_loss(weights, x[~away], z[~away], y[~away], least)
                        total += np.r_[flatten(gradient), len(losses), losses.sum(), 0, 0]
                    if away.any():
                        losses, _ = fusion_loss(weights, x[away], z[away], y[away], least)
                        total[size + 2 :] += len(losses), losses.sum()
            return total

        found = sum_over(rows, size + 4, run)
        n, train, m, other = found[size:]
        if not n or not m:
            raise ValueError("there must be rows to learn from and rows held out")
        return Measured(shaped(found[:size] / n, begin), float(train / n), float(other / m))

    return descend(df.sparkSession, begin, measure, patience, epochs, rate, path=path)
