"""Connected components of a graph given as an edge table, without collecting any of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import cut, ship_code

#: Edges (16 bytes each) that one task contracts.
LOCAL_EDGES = 1 << 19


def smallest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` with the groups of i and j merged for every pair, each group carrying its smallest row."""
    while True:
        new = label.copy()
        least = np.minimum(label[i], label[j])
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def connected_components(edges: DataFrame, max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a``, ``b``, long); component is its smallest node.

    First the edges are dealt at random into parts of ``local_edges``, and each part leaves the stars of its own components: what many
    edges say over and over shrinks to one edge a node and part. One part alone is the whole answer. Otherwise the
    large-star and the small-star step alternate until the edge set is a set of stars around their smallest node.
    The number of rounds grows with the logarithm of the longest path. The edges are cut after each step, so a lost
    executor costs one step at most, and both sides of each join are plain exchanges that adaptive execution may split
    where a node has very many neighbours. Self-loops and repeated edges are allowed; nulls are dropped.
    """
    edges = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b"))
    parts = max(1, -(-edges.count() // local_edges))
    edges = cut(_oriented(_contracted(edges.repartition(parts))))
    for _ in range(max_rounds):
        if parts == 1 or _all_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = cut(_star(both, both.filter("b > a"), own=False))
        edges = cut(_star(large, large, own=True))
    else:
        raise RuntimeError(f"no convergence in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _contracted(edges: DataFrame) -> DataFrame:
    """An edge from every node to the smallest one that the edges of the same partition connect it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.concatenate(x) for x in zip(*([c.to_numpy() for c in b.columns] for b in batches), strict=True)]
        if held:
            node, ends = np.unique(np.concatenate(held), return_inverse=True)
            label = smallest(np.arange(len(node)), *np.split(ends, 2))
            moved = np.flatnonzero(label != np.arange(len(node)))
            yield pa.record_batch([pa.array(node[moved]), pa.array(node[label[moved]])], names=["a", "b"])

    ship_code(edges.sparkSession)
    return edges.mapInArrow(run, "a bigint, b bigint")


def _all_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is no smaller end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 OR out > 0 AND into > 0").isEmpty()


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()


def _star(around: DataFrame, moved: DataFrame, own: bool) -> DataFrame:
    """Links the ``moved`` neighbours of each node, and with ``own`` the node, to the smallest of it and its neighbours."""
    least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    star = moved.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if own:
        star = star.unionByName(least.select("a", F.col("m").alias("b")))
    return _oriented(star)
