"""Dense layers on blocks of rows, as NumPy, and the way between Arrow lists and such blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


@dataclass(frozen=True)
class Linear:
    """x to weight · x + bias."""

    weight: np.ndarray
    bias: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight.T + self.bias


@dataclass(frozen=True)
class Norm:
    """Each row less its mean, over its population deviation, scaled and moved."""

    scale: np.ndarray
    shift: np.ndarray
    eps: float = 1e-5

    def __call__(self, x: np.ndarray) -> np.ndarray:
        centred = x - x.mean(axis=-1, keepdims=True)
        return centred / np.sqrt((centred * centred).mean(axis=-1, keepdims=True) + self.eps) * self.scale + self.shift


def erf(x: np.ndarray) -> np.ndarray:
    """The error function to about 1e-15: a power series up to 3, a continued fraction beyond."""
    size = np.abs(x)
    near, far = np.minimum(size, 3.0), np.maximum(size, 3.0)
    term, total = near.copy(), near.copy()
    for n in range(1, 75):
        term = term * 2 * near * near / (2 * n + 1)
        total += term
    fraction = far.copy()
    for n in range(60, 0, -1):
        fraction = far + n / 2 / fraction
    inside = 2 / math.sqrt(math.pi) * np.exp(-near * near) * total
    outside = 1 - np.exp(-far * far) / math.sqrt(math.pi) / fraction
    return np.sign(x) * np.where(size < 3, inside, outside)


def gelu(x: np.ndarray) -> np.ndarray:
    """x times the normal distribution function of x."""
    return x * (1 + erf(x / math.sqrt(2))) / 2


def softmax(x: np.ndarray) -> np.ndarray:
    """Over the last axis."""
    raised = np.exp(x - x.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def unit(x: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """Rows over their length, which counts as ``least`` at least."""
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), least)


def block(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists of ``width`` numbers without a null, as rows of one array, and which of all lists these are. No number becomes a Python object."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values
    gaps = np.concatenate([[0], np.cumsum(np.asarray(values.is_null()))]) if values.null_count else np.zeros(len(values) + 1, np.int64)
    whole = np.asarray(lists.is_valid()) & (np.diff(offsets) == width) & (gaps[offsets[1:]] == gaps[offsets[:-1]])
    flat = values.to_numpy(zero_copy_only=False).astype(float)
    if not whole.any():
        return np.zeros((0, width)), whole
    starts = offsets[:-1][whole]
    if whole.all():
        return flat[starts[0] : starts[0] + width * len(starts)].reshape(-1, width), whole
    return flat[starts[:, None] + np.arange(width)], whole


def lists(rows: np.ndarray, whole: np.ndarray | None = None) -> pa.Array:
    """The rows as Arrow lists; with ``whole`` the other lists are null."""
    width = rows.shape[1]
    flat = pa.array(np.ascontiguousarray(rows, dtype=float).ravel())
    if whole is None or whole.all():
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), flat)
    ends = np.concatenate([[0], np.cumsum(np.where(whole, width, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(~whole))
