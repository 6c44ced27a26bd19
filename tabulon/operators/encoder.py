"""Heterogeneous message passing over whole graph tables: projection per node type, layers, readout.

Nodes are rows ``graph, type, pos, x`` with ``x`` an array, edges ``graph, src_type, src_pos, rel, dst_type, dst_pos``. Weights
are NumPy arrays; their size is that of the model, and they travel with the plan. Means of neighbours are partial
aggregates of vectors, so a node with very many neighbours is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.dense import Linear, block, lists
from tabulon.session import cut, ship_code

#: Type of the source, relation, type of the target.
EdgeType = tuple[str, str, str]


@dataclass(frozen=True)
class Convolution:
    """What a relation makes of the mean of a node's neighbours, plus ``own`` times the node itself."""

    neighbours: Linear
    own: np.ndarray


@dataclass(frozen=True)
class GraphEncoder:
    """``layers`` give each layer's convolutions by edge type."""

    projections: dict[str, Linear]
    layers: list[dict[EdgeType, Convolution]] = field(default_factory=list)
    output: Linear | None = None


def _by_type(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of each type of node."""
    codes = batch.column("type").dictionary_encode()
    for k, kind in enumerate(codes.dictionary.to_pylist()):
        yield kind, batch.filter(pc.equal(codes.indices, k))


def _whole(column: pa.Array, width: int, kind: str) -> np.ndarray:
    rows, whole = block(column, width)
    if not whole.all():
        raise ValueError(f"vectors of {kind} must have {width} numbers")
    return rows


def project(nodes: DataFrame, projections: dict[str, Linear]) -> DataFrame:
    """``graph, type, pos, x`` with the type's own linear map applied; a type without one is an error, a null vector stays away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, part in _by_type(batch):
                x = projections[kind](_whole(part.column("x"), projections[kind].weight.shape[1], kind))
                yield pa.record_batch([*part.columns[:3], lists(x)], names=["graph", "type", "pos", "x"])

    ship_code(nodes.sparkSession)
    rows = nodes.filter("x IS NOT NULL").select("graph", "type", F.col("pos").cast("long").alias("pos"), F.col("x").cast("array<double>").alias("x"))
    return rows.mapInArrow(run, rows.schema)


#: Vectors of up to so many numbers are averaged as columns of their own, which the aggregation compiles; longer ones as vectors.
MAX_COLUMNS = 32


def _mean(x: str | Column, width: int) -> Column:
    if width <= MAX_COLUMNS:
        return F.array(*[F.avg(F.get(x, F.lit(i))) for i in range(width)])
    return vector_to_array(Summarizer.mean(array_to_vector(x)))


def _width(nodes: DataFrame) -> int:
    return nodes.agg(F.max(F.size("x"))).first()[0] or 0


def convolve(nodes: DataFrame, edges: DataFrame, convolutions: dict[EdgeType, Convolution]) -> DataFrame:
    """One layer: the convolutions of a node's edge types added up, ReLU, plus the node's old state.

    Edge types whose source type has no nodes left are passed over; nodes of a type that no edge type reaches drop out. A node without neighbours
    takes 0 as their mean. Edges of other types are ignored.
    """
    present = {r["type"] for r in nodes.select("type").distinct().collect()}  # at most one a type
    used = {e: c for e, c in convolutions.items() if e[0] in present}
    reached = sorted({e[2] for e in used})
    source = nodes.select("graph", F.col("type").alias("src_type"), F.col("pos").alias("src_pos"), "x")
    kinds = edges.select("graph", "src_type", F.col("src_pos").cast("long").alias("src_pos"), "rel", F.col("dst_type").alias("type"), F.col("dst_pos").cast("long").alias("pos"))
    from_edge = lambda e: (F.col("src_type") == e[0]) & (F.col("rel") == e[1]) & (F.col("type") == e[2])
    met = kinds.filter(reduce(Column.__or__, map(from_edge, used), F.lit(False))).join(source, ["src_pos", "src_type", "graph"])  # the key with most values first, for the sorts
    names, width = {e: f"mean{i}" for i, e in enumerate(used)}, _width(nodes)
    if used and width * len(used) <= MAX_COLUMNS:
        given = met.groupBy("pos", "type", "graph").agg(*[_mean(F.when(from_edge(e), F.col("x")), width).alias(name) for e, name in names.items()])
    elif used:
        means = met.groupBy("pos", "type", "graph", "src_type", "rel").agg(_mean("x", width).alias("mean"))
        given = means.groupBy("pos", "type", "graph").agg(*[F.any_value(F.when(from_edge(e), F.col("mean")), ignoreNulls=True).alias(name) for e, name in names.items()])
    else:
        given = nodes.select("pos", "type", "graph").limit(0)
    both = nodes.filter(F.col("type").isin(reached)).join(given, ["pos", "type", "graph"], "left").select("graph", "type", "pos", "x", *names.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, part in _by_type(batch):
                own = [(names[e], c) for e, c in used.items() if e[2] == kind]
                x = _whole(part.column("x"), own[0][1].own.shape[1], kind)
                total = np.zeros_like(x)
                for name, c in own:
                    mean = np.zeros((len(x), c.neighbours.weight.shape[1]))
                    found, there = block(part.column(name), mean.shape[1])
                    mean[there] = found
                    total += c.neighbours(mean) + x @ c.own.T
                yield pa.record_batch([*part.columns[:3], lists(np.maximum(total, 0) + x)], names=["graph", "type", "pos", "x"])

    ship_code(nodes.sparkSession)
    return both.mapInArrow(run, nodes.schema)


def readout(nodes: DataFrame, graphs: DataFrame | None = None, output: Linear | None = None) -> DataFrame:
    """``graph, x``: the mean of the node vectors per graph and type, then over all types left, absent ones counting as zero; projected.

    With ``graphs`` (``graph``) every one of them has a row; one without nodes has the projection of zeros.
    """
    types, wide = nodes.agg(F.count_distinct("type"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    means = nodes.groupBy("graph", "type").agg(_mean("x", wide).alias("m"))
    pooled = means.groupBy("graph").agg(vector_to_array(Summarizer.sum(array_to_vector("m"))).alias("x"))
    if graphs is not None:
        pooled = graphs.select("graph").distinct().join(pooled, "graph", "left")
    width = wide if output is None else output.weight.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros((batch.num_rows, width))
            found, there = block(batch.column("x"), width)
            x[there] = found / types
            made = lists(x, there) if output is None else lists(output(x))
            yield pa.record_batch([batch.column("graph"), made], names=["graph", "x"])

    ship_code(nodes.sparkSession)
    return pooled.select("graph", "x").mapInArrow(run, f"graph {dict(nodes.dtypes)['graph']}, x array<double>")


def encode(nodes: DataFrame, edges: DataFrame, model: GraphEncoder, graphs: DataFrame | None = None) -> DataFrame:
    """``graph, x``: the vector of every graph. The edges are cut once, the states after each layer."""
    edges = cut(edges.select("graph", "src_type", "src_pos", "rel", "dst_type", "dst_pos"))
    states = cut(project(nodes, model.projections))
    for layer in model.layers:
        states = cut(convolve(states, edges, layer))
    return readout(states, graphs, model.output)
