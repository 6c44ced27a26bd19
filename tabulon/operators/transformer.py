"""A Transformer encoder's forward pass over token ids as rows: pooled vectors or one vector a token, texts of any length side by side."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.dense import Linear, Norm, gelu, lists, softmax
from tabulon.session import ship_code

#: Padded tokens that go through the layers at once, and scores of attention that are held at once. One longer text goes by itself.
TOKENS, SCORES = 16_384, 1 << 22


@dataclass(frozen=True)
class Layer:
    """Attention and a feed-forward part, each added to its input and then normalised."""

    query: Linear
    key: Linear
    value: Linear
    out: Linear
    first_norm: Norm
    up: Linear
    down: Linear
    second_norm: Norm
    heads: int = 1
    smooth: bool = False  # GELU in place of ReLU

    def __call__(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        x = self.first_norm(x + self.out(self._attend(x, mask)))
        hidden = self.up(x)
        return self.second_norm(x + self.down(gelu(hidden) if self.smooth else np.maximum(hidden, 0)))

    def _attend(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Each token's values weighed by likeness of query and key, within its own text; queries come in blocks, so the scores held are bounded."""
        texts, length, width = x.shape
        apart = lambda y: y.reshape(texts, length, self.heads, width // self.heads).transpose(0, 2, 1, 3)
        q, k, v = (apart(f(x)) for f in (self.query, self.key, self.value))
        away = np.where(mask[:, None, None, :], 0.0, -np.inf)
        out, step = np.empty_like(q), max(1, SCORES // (texts * self.heads * length))
        for at in range(0, length, step):
            scores = q[:, :, at : at + step] @ k.transpose(0, 1, 3, 2) / np.sqrt(width // self.heads) + away
            out[:, :, at : at + step] = softmax(scores) @ v
        return out.transpose(0, 2, 1, 3).reshape(texts, length, width)


@dataclass(frozen=True)
class Transformer:
    """``embedding`` has a row a token id, ``positions`` a row a place; longer texts are cut at its end, as a model's learned places bound it."""

    embedding: np.ndarray
    positions: np.ndarray
    layers: list[Layer]
    first_norm: Norm | None = None  # over the sum of embedding and position
    projection: Linear | None = None

    def states(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The last layer's vectors of every token, padded, and where there are tokens."""
        lengths = np.array([len(i) for i in ids])
        mask = np.arange(lengths.max())[None, :] < lengths[:, None]
        padded = np.zeros(mask.shape, np.int64)
        padded[mask] = np.concatenate(ids)
        x = self.embedding[padded] + self.positions[: mask.shape[1]][None]
        x = x if self.first_norm is None else self.first_norm(x)
        for layer in self.layers:
            x = layer(x, mask)
        return x, mask


def _blocks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of texts that go together, of like length, so that little is padded and no block has more than ``TOKENS`` places but for one text's own."""
    order = np.argsort(lengths, kind="stable")[::-1]
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        size = max(1, TOKENS // int(lengths[order[at]]))
        yield order[at : at + size]
        at += size


def _ids(column: pa.Array, longest: int) -> list[np.ndarray]:
    """The ids of each text without nulls, cut; a null list has none."""
    offsets, values = column.offsets.to_numpy(), column.values.fill_null(-1).to_numpy(zero_copy_only=False)
    valid = np.asarray(column.is_valid())
    found = [values[a:b] if ok else values[:0] for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]
    return [x[x >= 0][:longest].astype(np.int64) for x in found]


def token_states(df: DataFrame, ids: str, key: str, model: Transformer) -> DataFrame:
    """``key, position, vector``: a row for each token of each text, ``mask`` being needed nowhere since no row is padding.

    A null or empty list has no rows; null ids within a list and ids below 0 are passed over. Rows that repeat a key have rows each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _ids(batch.column(1), len(model.positions))
            for rows in _blocks(np.array([len(t) for t in texts], np.int64)):
                x, mask = model.states([texts[r] for r in rows])
                keys = batch.column(0).take(pa.array(np.repeat(rows, mask.sum(axis=1))))
                yield pa.record_batch([keys, pa.array(np.nonzero(mask)[1].astype(np.int32)), lists(x[mask])], names=[key, "position", "vector"])

    ship_code(df.sparkSession)
    schema = T.StructType([df.schema[key], T.StructField("position", T.IntegerType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    return df.select(key, F.col(ids).cast("array<int>")).mapInArrow(run, schema)


def encode_texts(df: DataFrame, ids: str, model: Transformer, out: str = "vector", pool: str = "mean") -> DataFrame:
    """``df`` with ``out``: the mean of a text's token vectors, or with ``pool="first"`` that of its first token, projected if the model does.

    Texts keep their own lengths: those of like length go through the layers together, padding being masked. A null or empty list gives null.
    """
    place, names = df.columns.index(ids), df.columns
    width = model.embedding.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _ids(batch.column(place).cast(pa.list_(pa.int32())), len(model.positions))
            pooled, there = np.zeros((len(texts), width)), np.array([len(t) > 0 for t in texts], bool)
            for rows in _blocks(np.array([len(t) for t in texts], np.int64)):
                x, mask = model.states([texts[r] for r in rows])
                pooled[rows] = x[:, 0] if pool == "first" else (x * mask[:, :, None]).sum(axis=1) / mask.sum(axis=1)[:, None]
            done = pooled[there] if model.projection is None else model.projection(pooled[there])
            yield pa.record_batch([*batch.columns, lists(done, there)], names=[*names, out])

    ship_code(df.sparkSession)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))
