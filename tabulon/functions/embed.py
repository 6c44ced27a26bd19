"""Text embedding behind an interface; the default needs no model file."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.operators.transformer import Transformer, token_states
from tabulon.session import ship_code

#: From texts to one vector each, as a two-dimensional array.
Embedder = Callable[[list[str]], np.ndarray]


def _hashes(text: str) -> list[int]:
    """The first 32 bits of the MD5 of every word, as any engine can make them."""
    return [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]


def hashing_embedder(width: int = 64) -> Embedder:
    """Counts of words hashed to ``width`` signed places, for use where no encoder is at hand."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), np.float32)
        for row, text in enumerate(texts):
            for h in _hashes(text):
                out[row, h % width] += 1.0 if h >> 31 else -1.0
        return out

    return embed


def embed_texts(df: DataFrame, text: str, embedder: Embedder, batch: int = 256, out: str = "embedding") -> DataFrame:
    """``df`` with a vector per row. Each distinct text is embedded once and joined back."""

    ship_code(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = embedder(list(part["__text"]))
                yield pd.DataFrame({"__text": part["__text"].to_numpy(), out: list(np.asarray(vectors, np.float32))})

    distinct = df.filter(F.col(text).isNotNull()).select(F.col(text).alias("__text")).distinct()
    vectors = distinct.mapInPandas(run, f"__text string, {out} array<float>")
    return df.join(vectors, F.col(text) == F.col("__text"), "left").drop("__text")


#: From texts to the token ids of each, which may come one by one as they are asked for.
TokenEncoder = Callable[[list[str]], list[Iterable[int]]]


def token_ids(df: DataFrame, text: str, encoder: TokenEncoder, max_length: int = 512, pad: int | None = 0, batch: int = 128, out: str = "input_ids") -> DataFrame:
    """``df`` with the token ids of ``text``, cut at ``max_length`` and padded to the longest of their batch; a null text counts as empty.

    With ``pad=None`` lists keep their own lengths.
    """
    ship_code(df.sparkSession)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                ids = [list(islice(x, max_length)) for x in encoder([t or "" for t in part.column(place).to_pylist()])]
                lengths = np.array([len(x) for x in ids], np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, lengths.sum())
                if pad is not None:
                    width = lengths.max(initial=0)
                    padded = np.full((len(ids), width), pad, np.int32)
                    padded[np.arange(width) < lengths[:, None]] = flat
                    flat, lengths = padded.ravel(), np.full(len(ids), width, np.int32)
                yield pa.record_batch([*part.columns, pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat))], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def token_vectors(df: DataFrame, key: str, text: str, encoder: TokenEncoder, model: Transformer) -> DataFrame:
    """``key, position, vector``: the model's vector of every token of every text, no row being padding.

    Each distinct text is encoded once, under its SHA-256, and joined back. Null and empty texts have no rows; rows that repeat a key have rows each.
    The mean over a key's rows (``vectors.mean_pool`` with a mask of ones) is what the model gives when it pools by itself.
    """
    coded = df.filter(F.col(text).isNotNull()).select(key, text, F.sha2(F.col(text).cast("binary"), 256).alias("__digest"))
    ids = token_ids(coded.select("__digest", text).dropDuplicates(["__digest"]), text, encoder, len(model.positions), None)
    states = token_states(ids, "input_ids", "__digest", model)
    return coded.select(key, "__digest").join(states, "__digest").drop("__digest")


class _Ids(dict):
    """Ids of words by their bytes; of words met before they are remembered, up to a bound."""

    MOST = 1 << 18

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, word: bytes) -> int:
        found = 1 + int(hashlib.md5(word).hexdigest()[:8], 16) % self.size
        if len(self) < self.MOST:
            self[word] = found
        return found


def hashing_tokens(size: int = 50_000) -> TokenEncoder:
    """Words hashed to ids from 1 on, for use where no tokenizer is at hand. A word is hashed when its id is asked for, so what a cut leaves out costs nothing."""
    ids = _Ids(size)
    return lambda texts: [map(ids.__getitem__, t.encode().split()) for t in texts]  # bytes are split at the six blanks of ASCII only
