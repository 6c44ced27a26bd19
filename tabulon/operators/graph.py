"""Relational algebra of typed graphs: indexes, edges, catalogs, and one layer of message passing.

Nodes are rows ``graph, node, type, pos``; edges are rows ``graph, source, target, rel, epos``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators import order


def index_nodes(nodes: DataFrame) -> DataFrame:
    """``type_pos``, the number of earlier nodes of the type in the graph, and ``pos0``, that of all earlier nodes.

    Nodes of the same ``pos`` are taken in the order of their ids. No graph has to pass through one task: nodes are dealt once into ranges of the order, one small
    table tells where each type, and each graph, begins in a range, and both counters go on from there in one pass.
    """
    placed = order.in_ranges(nodes, ["graph", "pos", "node"])
    totals = placed.groupBy("graph", "type", "__part").agg(F.count(F.lit(1)).alias("__n"))
    of_type = Window.partitionBy("graph", "type").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    of_graph = Window.partitionBy("graph").orderBy("__part").rangeBetween(Window.unboundedPreceding, -1)
    starts = totals.select("graph", "type", "__part", *[F.coalesce(F.sum("__n").over(w), F.lit(0)).alias(name) for w, name in ((of_type, "__t"), (of_graph, "__g"))])
    within = lambda *by: F.row_number().over(Window.partitionBy("graph", "__part", *by).orderBy("pos", "node")) - 1
    counted = placed.withColumn("pos0", within()).withColumn("type_pos", within("type"))  # dealt once, for the wider window
    joined = order.join_null_safe(counted, starts, ["graph", "type", "__part"])
    return joined.select(*nodes.columns, (F.col("__t") + F.col("type_pos")).alias("type_pos"), (F.col("__g") + F.col("pos0")).alias("pos0"))


def typed_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with types and type-local positions of both ends. Edges with an unknown end are dropped.

    Where a graph repeats a node id, all nodes stay but edges bind to the last. Nodes that ``index_nodes`` has numbered already are not numbered again.
    """
    indexed = nodes if "type_pos" in nodes.columns else index_nodes(nodes)
    last = indexed.groupBy("node", "graph").agg(F.max_by(F.struct("type", "type_pos", "pos0"), "pos0").alias("at"))
    for end, name in (("source", "src"), ("target", "dst")):
        found = last.select("graph", F.col("node").alias(end), F.col("at.type").alias(f"{name}_type"), F.col("at.type_pos").alias(f"{name}_pos"), F.col("at.pos0").alias(f"{name}_pos0"))
        edges = edges.join(found, [end, "graph"])  # sorts compare the first key's first bytes, of which a graph's id would be the same for many
    return edges


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an end is no node of their graph; each is judged by its own ends, whatever its place, and a null end is no node."""
    ids, names = nodes.select("graph", "node").distinct(), edges.columns
    for end in ("source", "target"):
        edges = edges.join(ids.select("graph", F.col("node").alias(end), F.lit(True).alias(f"__{end}")), ["graph", end], "left")
    return edges.filter("__source IS NULL OR __target IS NULL").select(*names)


def type_catalog(nodes: DataFrame) -> DataFrame:
    return nodes.select("type").distinct()


def padded_counts(nodes: DataFrame) -> DataFrame:
    """``graph, type, n`` for every graph and every known type, 0 where a graph has none.

    The cross product is that of graphs and types of node, whose number the schema of the data bounds.
    """
    grid = nodes.select("graph").distinct().crossJoin(F.broadcast(type_catalog(nodes)))
    counts = nodes.groupBy("graph", "type").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["graph", "type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def type_pool(vectors: DataFrame) -> DataFrame:
    """Mean of the node vectors per graph and type, then over all types of the catalog, absent ones counting as zero.

    ``vectors`` has ``graph, type, dim, value``; the result ``graph, dim, value``.
    """
    types = vectors.agg(F.count_distinct("type").alias("__types"))  # one row
    means = vectors.groupBy("graph", "type", "dim").agg(F.avg("value").alias("m"))
    return means.groupBy("graph", "dim").agg(F.sum("m").alias("s")).crossJoin(F.broadcast(types)).select("graph", "dim", (F.col("s") / F.col("__types")).alias("value"))


def sage_layer(states: DataFrame, edges: DataFrame, weights: DataFrame) -> DataFrame:
    """One layer: per relation ``w_l * mean(neighbours) + w_r * self``, summed over relations, ReLU, plus the old state.

    ``states`` has ``type, node, dim, value``, ``edges`` ``src_type, source, rel, dst_type, target``, ``weights``
    ``rel, out_dim, in_dim, w_l, w_r`` (its size is that of the model). Nodes of a type that no edge reaches drop out; a node
    without neighbours in a relation takes 0 as their mean.
    """
    source = states.select(F.col("type").alias("src_type"), F.col("node").alias("source"), "dim", "value")
    means = edges.join(source, ["src_type", "source"]).groupBy("dst_type", "target", "rel", "dim").agg(F.avg("value").alias("mean"))
    reached = edges.select(F.col("dst_type").alias("type"), "rel").distinct()
    own = states.join(F.broadcast(reached), "type").select(F.col("type").alias("dst_type"), F.col("node").alias("target"), "rel", "dim", "value")
    both = own.join(means, ["dst_type", "target", "rel", "dim"], "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    w = F.broadcast(weights.withColumnRenamed("in_dim", "dim"))
    moved = both.join(w, ["rel", "dim"]).groupBy(F.col("dst_type").alias("type"), F.col("target").alias("node"), F.col("out_dim").alias("dim")).agg(F.sum(F.col("w_l") * F.col("mean") + F.col("w_r") * F.col("value")).alias("next"))
    return moved.join(states, ["type", "node", "dim"]).select("type", "node", "dim", (F.greatest(F.col("next"), F.lit(0.0)) + F.col("value")).alias("value"))
