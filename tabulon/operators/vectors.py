"""Vectors as array columns: norms, covariances, contrastive loss and gated fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.dense import block
from tabulon.operators import tiles
from tabulon.session import ship_code


def l2_normalise(v: Column) -> Column:
    """The vector over its length, which counts as 1e-12 at least."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(length, F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean_pool(rows: DataFrame, group: str, vector: str, mask: str) -> DataFrame:
    """``group, dim, value``: the masked mean over a group's vectors, the mask's sum counting as 1e-6 at least."""
    long = rows.select(group, F.col(mask).cast("double").alias("__m"), F.posexplode(vector).alias("dim", "__x"))
    return long.groupBy(group, "dim").agg((F.sum(F.col("__x").cast("double") * F.col("__m")) / F.greatest(F.sum("__m"), F.lit(1e-6))).alias("value"))


def _rectangle(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of ``width`` numbers, and which of these are there; nulls and what a shorter vector lacks are 0."""
    values, there = np.zeros((len(vectors), width)), np.zeros((len(vectors), width))
    for row, v in enumerate(vectors):
        if v.is_valid:
            x = v.values.to_numpy(zero_copy_only=False).astype(float)
            values[row, : len(x)], there[row, : len(x)] = np.where(np.isnan(x), 0, x), ~np.isnan(x)
    return values, there


def _products(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``i, j, n, xy, sx, sy`` for each pair of places: count, sum of products and sums over the rows that have both.

    A task multiplies a block of rows at a time and leaves one matrix, so the shuffle is that of a few matrices, whatever the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, 0, 0))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sides = [batch.column(k).slice(at, 1000) for k in (0, 1)]
                widths = [max([old, *(len(v) for v in side if v.is_valid)]) for side, old in zip(sides, total.shape[1:], strict=True)]
                if [*total.shape[1:]] != widths:
                    total = np.pad(total, [(0, 0), *((0, w - old) for w, old in zip(widths, total.shape[1:], strict=True))])
                (x, mx), (y, my) = (_rectangle(side, w) for side, w in zip(sides, widths, strict=True))
                total += np.stack([mx.T @ my, x.T @ y, x.T @ my, mx.T @ y])
        i, j = np.nonzero(total[0])
        for at in range(0, len(i), 10_000):
            cells = i[at : at + 10_000], j[at : at + 10_000]
            yield pa.record_batch([pa.array(c.astype(np.int32)) for c in cells] + [pa.array(t[cells]) for t in total], names=["i", "j", "n", "xy", "sx", "sy"])

    ship_code(rows.sparkSession)
    parts = rows.select(F.col(a).cast("array<double>").alias("a"), F.col(b).cast("array<double>").alias("b")).mapInArrow(run, "i int, j int, n double, xy double, sx double, sy double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "xy", "sx", "sy")])


def gram(rows: DataFrame, vector: str) -> DataFrame:
    """``i, j, value``: the uncentred covariance of a vector column over the number of its vectors. Null entries count as 0."""
    n = rows.filter(F.col(vector).isNotNull()).agg(F.count(F.lit(1)).alias("__n"))  # one row
    return _products(rows, vector, vector).crossJoin(F.broadcast(n)).select("i", "j", (F.col("xy") / F.col("__n")).alias("value"))


def cross_covariance(rows: DataFrame, a: str, b: str, eps: float = 1e-8) -> DataFrame:
    """``i, j, value``: centred cross-covariance over n - 1 + eps, from sums of one pass; a pair without rows has no cell."""
    return _products(rows, a, b).select("i", "j", ((F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1 + F.lit(eps))).alias("value"))


def cross_penalty(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``penalty``: the mean squared entry of the cross-covariance."""
    return cross_covariance(rows, a, b).agg(F.avg(F.col("value") * F.col("value")).alias("penalty"))


def isotropy_penalty(rows: DataFrame, vector: str) -> DataFrame:
    """``penalty``: the variance of the eigenvalues of the normalised vectors' covariance, 0 without vectors.

    The mean of the eigenvalues of a symmetric d x d matrix is its trace over d, the mean of their squares the sum of all squared
    entries over d; so no matrix has to be gathered. Adding a constant to the diagonal would not change the variance.
    """
    cells = gram(rows.select(l2_normalise(F.col(vector)).alias("v")), "v")
    sums = cells.agg(F.count_distinct("i").alias("d"), F.sum(F.col("value") * F.col("value")).alias("squares"), F.sum(F.when(F.col("i") == F.col("j"), F.col("value")).otherwise(0.0)).alias("trace"))
    mean = F.col("trace") / F.col("d")
    return sums.select(F.when(F.col("d") > 0, F.greatest(F.lit(0.0), F.col("squares") / F.col("d") - mean * mean)).otherwise(0.0).alias("penalty"))


def contrastive(rows: DataFrame, batch: str, key: str, a: str, b: str, scale: float = 1 / 0.07) -> DataFrame:
    """``batch, loss``: symmetric cross-entropy of in-batch similarities with the diagonal as target.

    A batch's own rows are paired in one task, 1,000 of them with all others at a time; a batch, whose size is the caller's constant, must
    fit its memory. Rows with a null vector, and batches without others, have no loss. ``scale`` counts as 100 at most.
    """
    capped, kind = min(scale, 100.0), rows.schema[batch].dataType.simpleString()

    def loss(table: pa.Table) -> pa.Table:
        x, y = (_rectangle(c, max(len(v) for v in c))[0] for c in (table.column(k).combine_chunks() for k in ("x", "y")))
        total = 0.0
        for p, q in ((x, y), (y, x)):
            for at in range(0, len(p), 1000):
                s = capped * (p[at : at + 1000] @ q.T)
                top = s.max(axis=1)
                total += float((top + np.log(np.exp(s - top[:, None]).sum(axis=1)) - s[np.arange(len(s)), at + np.arange(len(s))]).sum())
        return pa.table({batch: table.column("g").slice(0, 1), "loss": pa.array([total / 2 / len(x)])})

    ship_code(rows.sparkSession)
    unit = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.size(a) > 0) & (F.size(b) > 0)).select(F.col(batch).alias("g"), l2_normalise(F.col(a)).alias("x"), l2_normalise(F.col(b)).alias("y"))
    return unit.groupBy("g").applyInArrow(loss, f"{batch} {kind}, loss double")


def total_loss(contrastive_loss: float, isotropy: float, cross: float, penalty_weight: float, cross_scale: float = 0.5, eps: float = 1e-8, use_isotropy: bool = True, use_cross: bool = True) -> float:
    """The pre-training loss; without its terms it is the ablations' loss."""
    out = contrastive_loss
    if use_isotropy:
        out += penalty_weight * isotropy
    if use_cross:
        out += cross_scale / (contrastive_loss + eps) * cross
    return out


def routing(scores: Column, least: float = 0.01) -> Column:
    """Softmax of an array of scores, moved into [least, 1 - least] for two of them."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: F.lit(least) + F.lit(1 - 2 * least) * x / total)


def mean_routing(rows: DataFrame, batch: str, weights: str) -> DataFrame:
    """``batch, expert, weight``: the mean weight of each expert over a batch."""
    long = rows.select(batch, F.posexplode(weights).alias("expert", "w"))
    return long.groupBy(batch, "expert").agg(F.avg("w").alias("weight"))


def side_by_side(*vectors: Column) -> Column:
    """Several vectors of a row as one; null if any of them is."""
    return F.concat(*vectors)


def fuse(a: Column, b: Column, weights: Column) -> Column:
    """The two expert vectors, weighted. Equal halves make the fixed fusion."""
    return F.zip_with(a, b, lambda x, y: F.get(weights, F.lit(0)) * x.cast("double") + F.get(weights, F.lit(1)) * y.cast("double"))


#: Pairs of rows whose difference is taken at once; a squared distance below ``CLOSE`` of a row's own square has lost digits and is taken from the difference.
PAIRS, CLOSE = 1 << 14, 1e-7


class _Points:
    """The rows of a block that have a class and a vector of one length, copies of a class once: ``x``, ``weight``, ``starts`` of the classes; ``rows`` of each from ``first`` on."""

    def __init__(self, table: pa.Table, width: int):
        x, whole = block(table.column("v"), width)
        known = np.flatnonzero(whole & np.asarray(table.column("c").is_valid()))
        x, classes = x[np.cumsum(whole)[known] - 1], table.column("c").combine_chunks().take(pa.array(known)).dictionary_encode()
        code = classes.indices.to_numpy()
        bytes_of = np.ascontiguousarray(np.hstack([code[:, None].astype(float), x + 0.0])).view(np.dtype((np.void, 8 * (width + 1)))).ravel()
        _, first, place, self.weight = np.unique(bytes_of, return_index=True, return_inverse=True, return_counts=True)
        by_class = np.argsort(code[first], kind="stable")
        rank = np.empty_like(by_class)
        rank[by_class] = np.arange(len(by_class))
        self.x, self.weight, code = x[first[by_class]], self.weight[by_class], code[first[by_class]]
        self.of = np.full(table.num_rows, -1)
        self.of[known] = rank[place.ravel()]
        order = np.argsort(rank[place.ravel()], kind="stable")
        self.rows, self.first = known[order], np.r_[0, np.cumsum(self.weight)]
        self.starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, int)
        self.names = [classes.dictionary[int(c)].as_py() for c in code[self.starts]]
        self.sizes = np.add.reduceat(self.weight, self.starts) if len(code) else np.zeros(0)
        self.keys, self.classes = table.column("k").combine_chunks(), table.column("c").combine_chunks()

    def records(self, points: slice, names: list[str | None], d: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """The sums ``d`` of the points, a row each and a column a name, over ``n`` rows, for all their rows."""
        ends = self.first[points.start], self.first[points.stop]
        rows, at = self.rows[ends[0] : ends[1]], np.repeat(np.arange(len(d)), self.weight[points])
        return _sums(self, np.repeat(rows, len(names)), np.tile(np.array(names, object), len(rows)), d[at].ravel(), np.tile(n, len(rows)))


def _sums(points: _Points, rows: np.ndarray, names: np.ndarray, d: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    at = pa.array(rows)
    return pa.record_batch([points.keys.take(at), points.classes.take(at), pa.array(names, pa.string()), pa.array(d, pa.float64()), pa.array(n, pa.float64())], names=["k", "c", "c2", "d", "n"])


def _apart(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of pairs of rows by their differences."""
    return np.concatenate([np.sqrt(((x[i[s : s + PAIRS]] - y[j[s : s + PAIRS]]) ** 2).sum(axis=1)) for s in range(0, len(i), PAIRS)] or [np.zeros(0)])


def _distance_sums(left: pa.Table, right: pa.Table | None) -> Iterator[pa.RecordBatch]:
    """``k, c, c2, d, n``: sums and numbers of the distances of each row to the rows of each class in the other block, either way. Rows of the same key count back."""
    own = right is None
    right = left if own else right
    lengths = [set(pc.unique(pc.list_value_length(t.column("v"))).to_pylist()) for t in (left, right)]
    for width in sorted(w for w in lengths[0] & lengths[1] if w is not None):
        a = _Points(left, width)
        b = a if own else _Points(right, width)
        if not len(a.x) or not len(b.x):
            continue
        finite = b.x[np.isfinite(b.x).all(axis=1)]
        middle = finite.mean(axis=0) if len(finite) else 0.0
        x, y = a.x - middle, b.x - middle
        own_square, even = (x * x).sum(axis=1), [bool((p.weight == 1).all()) for p in (a, b)]
        ends = np.r_[a.starts[1:], len(x)]
        at_class, total = 0, np.zeros(len(y))
        for rows, pieces in tiles.by_rows(x, y, 128, [2048, 2048]):
            sums = np.zeros((rows.stop - rows.start, len(b.names)))
            cuts = [rows.start, *(int(s) for s in a.starts if rows.start < s < rows.stop), rows.stop]
            parts = np.zeros((len(cuts) - 1, len(y)))
            for columns, d in pieces:
                d += own_square[rows, None]
                r, c = np.nonzero(d < CLOSE * own_square[rows, None] + 1e-300)
                np.sqrt(np.maximum(d, 0, out=d), out=d)
                d[r, c] = _apart(x, y, rows.start + r, columns.start + c)
                if not own:
                    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        part = d[s - rows.start : e - rows.start]
                        parts[k, columns] = part.sum(axis=0) if even[0] else a.weight[s:e] @ part
                if not even[1]:
                    d *= b.weight[columns]
                first, last = np.searchsorted(b.starts, [columns.start, columns.stop - 1], side="right") - 1
                sums[:, first : last + 1] += np.add.reduceat(d, np.maximum(b.starts[first : last + 1] - columns.start, 0), axis=1)
            yield a.records(rows, b.names, sums, b.sizes)
            for k, e in enumerate(cuts[1:]):
                total += parts[k]
                if not own and e == ends[at_class]:
                    for s in range(0, len(y), PAIRS):
                        piece = slice(s, min(s + PAIRS, len(y)))
                        yield b.records(piece, [a.names[at_class]], total[piece, None], a.sizes[[at_class]])
                    at_class, total = at_class + 1, np.zeros(len(y))
        yield from _of_same_key(a, b, x, y, own)
    if own:  # so that every key has a row
        n = left.num_rows
        yield pa.record_batch([left.column("k").combine_chunks(), left.column("c").combine_chunks(), left.column("c").combine_chunks(), pa.array(np.zeros(n)), pa.array(np.zeros(n))], names=["k", "c", "c2", "d", "n"])


def _of_same_key(a: _Points, b: _Points, x: np.ndarray, y: np.ndarray, own: bool) -> Iterator[pa.RecordBatch]:
    """What the rows of the same key have been given of each other, to be taken off again."""
    codes = pa.chunked_array([a.keys, b.keys]).combine_chunks().dictionary_encode().indices.to_numpy()
    i, j = np.flatnonzero(a.of >= 0), np.flatnonzero(b.of >= 0)
    ka, kb = codes[: len(a.keys)][i], codes[len(a.keys) :][j]
    j, kb = j[np.argsort(kb, kind="stable")], np.sort(kb)
    low = np.searchsorted(kb, ka)
    ends = np.cumsum(np.searchsorted(kb, ka, side="right") - low)
    for s in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        pair = np.arange(s, min(s + PAIRS, int(ends[-1])))
        row = np.searchsorted(ends, pair, side="right")
        p, q = i[row], j[low[row] + pair - np.r_[0, ends][row]]
        d = _apart(x, y, a.of[p], b.of[q])
        for one, other, u, v in ((a, b, p, q),) if own else ((a, b, p, q), (b, a, q, p)):
            yield _sums(one, u, np.array(other.names, object)[np.searchsorted(other.starts, other.of[v], side="right") - 1], -d, -np.ones(len(d)))


def silhouette(rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """``silhouette``: the mean Euclidean silhouette over all rows.

    Every two blocks of rows meet in a task (``tiles.meet``), which leaves a sum and a count of distances per row and class. Distances come from products of the
    centred vectors, and from differences where rows are so close that products lose digits; copies of a class in a block are measured once. A vector that is null, has
    a null or another length has no distance.
    """
    base = rows.select(F.col(key).cast("string").alias("k"), F.col(label).cast("string").alias("c"), F.col(vector).alias("v")).filter("k IS NOT NULL")
    if not base.agg(F.min("k") < F.max("k")).first()[0]:
        base = base.limit(0)  # no row has another to be compared with
    sums = tiles.meet(base, "v", _distance_sums, "k string, c string, c2 string, d double, n double", once=True)
    means = sums.groupBy("k", "c", "c2").agg(F.try_divide(F.sum("d"), F.sum("n")).alias("d"))
    ab = means.groupBy("k").agg(F.max(F.when(F.col("c") == F.col("c2"), F.col("d"))).alias("a"), F.min(F.when(F.col("c") != F.col("c2"), F.col("d"))).alias("b"))
    return ab.agg(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))).alias("silhouette"))
