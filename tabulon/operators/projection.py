"""Layouts of vectors in the plane, t-SNE and UMAP, for the bounded samples that charts show; the neighbour search before them takes any number of rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.dense import block, lists
from tabulon.operators import order, sampling, tiles
from tabulon.session import cut, ship_code

#: Points of a layout at most: the plot sample. The layout, and what tasks hold of it, is bounded by this.
MOST_POINTS = 6000

#: Rows whose distances to all points are held at once.
ROWS = 256

#: Neighbours that products choose beyond those asked for, before differences decide.
SPARE = 8

# Shape of UMAP's similarity curve for a least distance of 0.1 and a spread of 1.
CURVE_A, CURVE_B = 1.5769434603113077, 0.8950608779109733


def plot_points(rows: DataFrame, key: str, label: str, vector: str, seed: int = 42) -> DataFrame:
    """``pos, key, v``: at most about ``MOST_POINTS`` rows by ``sampling.floor_sample``, numbered from 0 in the order of ``key``. Rows without a vector are left out.

    Every class keeps a row at least, so classes must be fewer than points for the bound to hold; otherwise it is an error.
    """
    known = rows.filter(F.col(vector).isNotNull() & F.col(key).isNotNull())
    chosen = sampling.floor_sample(known.select(key, label, vector), label, MOST_POINTS, key, seed)
    numbered = cut(order.running(chosen, [], [key], "pos").select("pos", key, F.col(vector).cast("array<double>").alias("v")))
    if numbered.count() > 2 * MOST_POINTS:
        raise ValueError("there are more classes than points")
    return numbered


def _matrix(points: DataFrame) -> np.ndarray:
    """The vectors of a bounded sample by place; all must have one length and no nulls."""
    table = points.select("pos", "v").toArrow()
    if not table.num_rows:
        return np.zeros((0, 0))
    column = table.column("v").combine_chunks()
    x, whole = block(column, len(column[0]))
    if not whole.all():
        raise ValueError("vectors must be of one length and without nulls")
    return x[np.argsort(table.column("pos").to_numpy())]


def conditional(squares: np.ndarray, perplexity: float) -> np.ndarray:
    """Each row's neighbour probabilities from its squared distances, the width being found by bisection so that their entropy is the perplexity's."""
    beta, low, high = np.ones(len(squares)), np.zeros(len(squares)), np.full(len(squares), np.inf)
    squares = squares - squares.min(axis=1, keepdims=True)
    for _ in range(100):
        p = np.exp(-squares * beta[:, None])
        total = p.sum(axis=1)
        entropy = np.log(total) + beta * (squares * p).sum(axis=1) / total
        wide = entropy > math.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return p / total[:, None]


def affinities(points: DataFrame, x: np.ndarray, perplexity: float) -> DataFrame:
    """``i, j, p`` for the near pairs of points, both ways, summing to 1: exact neighbour lists of three times the perplexity, calibrated row by row in the tasks."""
    spark, n = points.sparkSession, len(x)
    k, held = min(n - 1, int(3 * perplexity)), spark.sparkContext.broadcast(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.column("pos").slice(at, ROWS).to_numpy()
                squares = ((every[own] ** 2).sum(axis=1)[:, None] - 2 * every[own] @ every.T + (every**2).sum(axis=1)[None]).clip(0)
                squares[np.arange(len(own)), own] = np.inf
                near = np.argpartition(squares, k - 1, axis=1)[:, :k]
                p = conditional(np.take_along_axis(squares, near, axis=1), min(perplexity, k))
                yield pa.record_batch([pa.array(np.repeat(own, k)), pa.array(near.ravel()), pa.array(p.ravel())], names=["i", "j", "p"])

    ship_code(spark)
    one_way = points.select("pos").mapInArrow(run, "i long, j long, p double")
    both = one_way.unionByName(one_way.select(F.col("j").alias("i"), F.col("i").alias("j"), "p"))
    return both.groupBy("i", "j").agg((F.sum("p") / (2 * n)).alias("p"))


def tsne_forces(edges: DataFrame, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """What pulls and what pushes each point, and the sum of all similarities in the plane, for a layout ``y``. ``edges`` are dealt by ``i``, all of an ``i`` in one task."""
    held = edges.sparkSession.sparkContext.broadcast(y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = held.value
        pull, mine = np.zeros_like(every), np.zeros(len(every), bool)
        for batch in batches:
            i, j, p = (batch.column(c).to_numpy() for c in "ijp")
            away = every[i] - every[j]
            np.add.at(pull, i, (p / (1 + (away**2).sum(axis=1)))[:, None] * away)
            mine[i] = True
        own = np.flatnonzero(mine)
        for at in range(0, len(own), ROWS):
            part = own[at : at + ROWS]
            away = every[part, None] - every[None]
            q = 1 / (1 + (away**2).sum(axis=2))
            q[np.arange(len(part)), part] = 0
            push = ((q**2)[:, :, None] * away).sum(axis=1)
            yield pa.record_batch([pa.array(part), *(pa.array(v) for v in (pull[part, 0], pull[part, 1], push[:, 0], push[:, 1], q.sum(axis=1)))], names=["i", "ax", "ay", "bx", "by", "z"])

    out = edges.mapInArrow(run, "i long, ax double, ay double, bx double, by double, z double").toArrow()  # a row a point
    at, found = out.column("i").to_numpy(), np.zeros((len(y), 5))
    found[at] = np.stack([out.column(c).to_numpy() for c in ("ax", "ay", "bx", "by", "z")], axis=1)
    held.destroy()
    return found[:, :2], found[:, 2:4], float(found[:, 4].sum())


def tsne(rows: DataFrame, key: str, label: str, vector: str, perplexity: float = 30.0, rounds: int = 500, seed: int = 42) -> DataFrame:
    """``key, x, y``: a t-SNE layout of the plot sample.

    Tasks find each point's neighbours and their calibrated probabilities, which stay with them; a round broadcasts the layout, bounded by the sample, and
    gathers one force a point. The first third of the rounds exaggerates the pull twelve times; steps have momentum and gains of their own by
    coordinate. The same rows give the same layout but for the last digits. Fewer than three points lie at the origin. Of rows that repeat a key each is a point.
    """
    points = plot_points(rows, key, label, vector, seed)
    x = _matrix(points)
    n = len(x)
    y = np.random.default_rng(seed).normal(scale=1e-4, size=(n, 2))
    if n >= 3:
        near = affinities(points, x, min(perplexity, (n - 1) / 3))
        edges = cut(near.repartitionByRange("i"))
        rate, velocity, gains = max(n / 48, 50.0), np.zeros_like(y), np.ones_like(y)
        for at in range(rounds):
            early = at < rounds // 3
            pull, push, total = tsne_forces(edges, y)
            gradient = 4 * ((12.0 if early else 1.0) * pull - push / total)
            gains = np.where(np.sign(gradient) != np.sign(velocity), gains + 0.2, gains * 0.8).clip(0.01)
            velocity = (0.5 if early else 0.8) * velocity - rate * gains * gradient
            y = y + velocity - (y + velocity).mean(axis=0)
    else:
        y = np.zeros((n, 2))
    return _placed(points, key, y)


def _placed(points: DataFrame, key: str, y: np.ndarray) -> DataFrame:
    layout = points.sparkSession.createDataFrame(pa.table({"pos": np.arange(len(y)), "x": y[:, 0].copy(), "y": y[:, 1].copy()}))
    return points.join(F.broadcast(layout), "pos").select(key, "x", "y")  # a row a point


def _finite(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places and vectors of the rows with ``width`` finite numbers, in the order of their places."""
    x, whole = block(table.column("v"), width)
    at = table.column("pos").to_numpy()[whole]
    known = np.flatnonzero(np.isfinite(x).all(axis=1))
    known = known[np.argsort(at[known], kind="stable")]
    return at[known], x[known]


def _nearest(left: pa.Table, right: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """``a, near``: for each row of ``left`` the ``k`` nearest others of its length in ``right``.

    Products of the centred vectors choose ``SPARE`` more than are asked for, and those are measured by differences. After the first piece only what is
    nearer than the farthest row held so far is looked at.
    """
    lengths = [set(pc.unique(pc.list_value_length(t.column("v"))).to_pylist()) for t in (left, right)]
    for width in sorted(w for w in lengths[0] & lengths[1] if w):
        (apos, x), (bpos, y) = _finite(left, width), _finite(right, width)
        if not len(x) or not len(y):
            continue
        x, y = x - y.mean(axis=0), y - y.mean(axis=0)
        held = min(len(y), k + 1 + SPARE)  # one may be the row itself
        for rows, pieces in tiles.by_rows(x, y, 128, [max(2048, held), 8192]):
            n = rows.stop - rows.start
            for columns, s in pieces:
                if not columns.start:
                    at = np.argpartition(s, held - 1, axis=1)[:, :held]
                    best = np.take_along_axis(s, at, axis=1)
                    far = best.max(axis=1)
                    continue
                r, c = np.nonzero(s < far[:, None])
                if not len(r):
                    continue
                rows_of = np.concatenate([np.repeat(np.arange(n), held), r])
                values, places = np.concatenate([best.ravel(), s[r, c]]), np.concatenate([at.ravel(), columns.start + c])
                order_of = np.lexsort((values, rows_of))
                starts = np.searchsorted(rows_of[order_of], np.arange(n))
                chosen = order_of[starts[:, None] + np.arange(held)]
                best, at = values[chosen], places[chosen]
                far = best[:, -1]
            d = np.sqrt(((x[rows, None] - y[at]) ** 2).sum(axis=2))
            own = bpos[at] == apos[rows, None]
            d, b = np.where(own, np.inf, d), bpos[at]
            ranked = np.lexsort((b, d), axis=1)[:, :k]
            d, b = np.take_along_axis(d, ranked, axis=1), np.take_along_axis(b, ranked, axis=1)
            there = np.isfinite(d)
            ends = pa.array(np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32))
            near = pa.StructArray.from_arrays([pa.array(d[there]), pa.array(b[there])], names=["d", "b"])
            yield pa.record_batch([pa.array(apos[rows]), pa.ListArray.from_arrays(ends, near)], names=["a", "near"])


def neighbours(points: DataFrame, k: int = 15) -> DataFrame:
    """``a, b, d``: the ``k`` nearest points of each, all found; ``points`` has ``pos``, all different, and ``v``. Of equally near ones the smaller places come first.

    Every block of points meets every other in a task (``tiles.meet``), which leaves each point's ``k`` nearest of the block, so no pairs are rows: what is
    shuffled is the vectors, and ``k`` numbers a point, once a block. Neighbour descent, which introduces neighbours to each other in rounds, shuffled hundreds
    of vectors a point and round and still found too few in 64 dimensions. Vectors that are null, or have an entry that is null or not finite, have no
    neighbours and are none; those of another length are not compared.
    """
    found = tiles.meet(points.select("pos", "v"), "v", lambda left, right: _nearest(left, right, k), "a long, near array<struct<d: double, b: long>>")
    best = found.groupBy("a").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return best.select("a", F.explode("near").alias("n")).select("a", "n.b", "n.d")


def fuzzy_union(near: DataFrame, k: int) -> DataFrame:
    """``i, j, w``, both ways: UMAP's edge weights. A row's nearest neighbour weighs 1 and its weights add up to log2 k; two directions u, v make u + v - u v."""
    grouped = near.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("d", "b"))).alias("s")).select("a", F.transform("s", lambda x: x["b"]).alias("b"), F.transform("s", lambda x: x["d"]).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size in sorted({len(d) for d in batch.column("d")}):
                d, whole = block(batch.column("d"), size)
                gaps = d - d[:, :1]
                low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
                for _ in range(64):
                    big = np.exp(-gaps / sigma[:, None]).sum(axis=1) > math.log2(max(k, 2))
                    low, high = np.where(big, low, sigma), np.where(big, sigma, high)
                    sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2).clip(1e-12, 1e300)
                part = batch.filter(pa.array(whole))
                yield pa.record_batch([part.column("a"), part.column("b"), lists(np.exp(-gaps / sigma[:, None]))], names=["a", "b", "w"])

    ship_code(near.sparkSession)
    weighed = grouped.mapInArrow(run, "a long, b array<long>, w array<double>").select("a", F.explode(F.arrays_zip("b", "w")).alias("z")).select("a", "z.b", "z.w")
    both = weighed.select(F.col("a").alias("i"), F.col("b").alias("j"), "w").unionByName(weighed.select(F.col("b").alias("i"), F.col("a").alias("j"), "w"))
    twice = F.when(F.count(F.lit(1)) > 1, F.max("w") * F.min("w")).otherwise(F.lit(0.0))
    return both.groupBy("i", "j").agg((F.sum("w") - twice).alias("w"))


def umap_moves(edges: DataFrame, y: np.ndarray, turn: int, seed: int, negatives: int = 5) -> np.ndarray:
    """The move of each point in a round: along its edges by weight, and away from ``negatives`` points drawn for each edge by its own seed."""
    held = edges.sparkSession.sparkContext.broadcast(y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = held.value
        move, mine = np.zeros_like(every), np.zeros(len(every), bool)
        for batch in batches:
            i, j, w = (batch.column(c).to_numpy() for c in "ijw")
            away = every[i] - every[j]
            square = (away**2).sum(axis=1)
            pull = np.where(square > 0, -2 * CURVE_A * CURVE_B * np.maximum(square, 1e-12) ** (CURVE_B - 1) / (1 + CURVE_A * square**CURVE_B), 0)
            np.add.at(move, i, w[:, None] * np.clip(pull[:, None] * away, -4, 4))
            mine[i] = True
            for t in range(negatives):
                mixed = (i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (j.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64((seed * 1_000_003 + turn * 31 + t) & 0xFFFFFFFF)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                other = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(len(every))).astype(np.int64)
                away = every[i] - every[other]
                square = (away**2).sum(axis=1)
                push = 2 * CURVE_B / ((0.001 + square) * (1 + CURVE_A * square**CURVE_B))
                np.add.at(move, i, np.where(other == i, 0, w)[:, None] * np.clip(push[:, None] * away, -4, 4))
        own = np.flatnonzero(mine)
        yield pa.record_batch([pa.array(own), pa.array(move[own, 0]), pa.array(move[own, 1])], names=["i", "x", "y"])

    out = edges.mapInArrow(run, "i long, x double, y double").toArrow()  # a row a point
    moves = np.zeros_like(y)
    moves[out.column("i").to_numpy()] = np.stack([out.column("x").to_numpy(), out.column("y").to_numpy()], axis=1)
    held.destroy()
    return moves


def umap(rows: DataFrame, key: str, label: str, vector: str, k: int = 15, rounds: int = 200, seed: int = 42) -> DataFrame:
    """``key, x, y``: a UMAP layout of the plot sample, from the nearest neighbours, the fuzzy union of its edges, and rounds whose steps shrink to nothing.

    A round moves all points at once. Points without neighbours, and tables of one row, stay where the seed has put them. As for ``tsne`` in all else.
    """
    points = plot_points(rows, key, label, vector, seed)
    n = points.count()
    y = np.random.default_rng(seed).uniform(-10, 10, size=(n, 2))
    if n > 1:
        _matrix(points)  # checks the vectors
        edges = cut(fuzzy_union(neighbours(points, k), min(k, n - 1)).repartitionByRange("i"))
        for turn in range(rounds):
            y = y + (1 - turn / rounds) * np.clip(umap_moves(edges, y, turn, seed), -4, 4)
    return _placed(points, key, y)
