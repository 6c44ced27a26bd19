"""From JSON lines with GraphML to stored graph datasets that can be subset by their metadata."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Self

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.embed import Embedder, embed_texts
from tabulon.operators import clean, graph
from tabulon.session import cut
from tabulon.sources import graphml, records

Hook = Callable[["GraphTables"], "GraphTables"]


def feature_width(nodes: DataFrame, vector: str = "x", fallback: int = 768) -> int:
    """The length that all vectors have; ``fallback`` if there are none, an error if they differ."""
    least, most = nodes.filter(F.size(vector) > 0).agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} numbers")
    return fallback if most is None else most


@dataclass(frozen=True)
class GraphTables:
    """Metadata, nodes and edges of all graphs, keyed by ``idx``; the long tables are the collated form."""

    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    skipped: DataFrame

    #: Folders that each table is stored in, by column.
    FOLDERS = {"nodes": (), "edges": ()}

    @classmethod
    def shape(cls, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        raise NotImplementedError

    @classmethod
    def build(cls, spark: SparkSession, root: str, name: str = "cpg_dataset.jsonl", first: int | None = None, exact: bool = False, pre_transform: Hook | None = None) -> Self:
        """Reads the lines, keeps the last record of each ``idx``, parses its graph and counts what was skipped by status.

        ``pre_transform`` changes the tables once, before they are stored.
        """
        decoded = records.decode_records(records.read_lines(spark, records.resolve(spark, root, name), first))
        # Nodes, edges and metadata all read the parsed graphs, and each is read twice when it is dealt into ranges: they are parsed once and cut.
        parsed = cut(graphml.parse(decoded.filter("status = 'success'").drop("status"), "graphml", exact).drop("graphml"))
        good = cut(clean.keep_last(parsed.filter("status = 'success'"), "idx", "line_no"))
        bad = decoded.filter("status <> 'success'").select("status").unionByName(parsed.filter("status <> 'success'").select("status"))
        built = cls(records.metadata(good), *cls.shape(graphml.node_rows(good, "idx"), graphml.edge_rows(good, "idx")), records.status_counts(bad))
        return pre_transform(built) if pre_transform else built

    def embed(self, embedder: Embedder) -> Self:
        """Nodes with ``x``, the vector of their text; each distinct text is embedded once."""
        return replace(self, nodes=embed_texts(self.nodes, "text", embedder, out="x"))

    def write(self, path: str) -> None:
        """Stored in the order of the graphs, which the readers may rely on within a file."""
        for name in ("graphs", "nodes", "edges", "skipped"):
            table, folders = getattr(self, name), self.FOLDERS.get(name, ())
            key = {"graphs": ["dataset_idx"], "nodes": ["graph", "pos"], "edges": ["graph", "epos"]}.get(name)
            out = table.repartitionByRange(*key).sortWithinPartitions(*folders, *key) if key else table
            out.withColumns({f"by_{c}": F.col(c) for c in folders}).write.mode("overwrite").partitionBy(*(f"by_{c}" for c in folders)).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, transform: Hook | None = None) -> Self:
        """The stored tables; ``transform`` changes them each time they are loaded."""
        read = cls(*(spark.read.parquet(f"{path}/{t}").drop(*(f"by_{c}" for c in cls.FOLDERS.get(t, ()))) for t in ("graphs", "nodes", "edges", "skipped")))
        return transform(read) if transform else read

    def subset(self, **equal) -> Self:
        """The graphs whose metadata match, with their nodes and edges; an unknown key is an error."""
        chosen = clean.subset(self.graphs, **equal)
        ids = chosen.select(F.col("dataset_idx").alias("graph"))
        return replace(self, graphs=chosen, nodes=self.nodes.join(ids, "graph", "left_semi"), edges=self.edges.join(ids, "graph", "left_semi"))


@dataclass(frozen=True)
class GraphDataset(GraphTables):
    """Heterogeneous graphs: nodes have a type and a position in it, edges the types of both ends."""

    FOLDERS = {"nodes": ("type",), "edges": ("rel",)}

    @classmethod
    def shape(cls, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        indexed = graph.index_nodes(nodes)
        return indexed, graph.typed_edges(indexed, edges)

    def padded(self) -> DataFrame:
        """``graph, type, n``: all known types for every graph, 0 nodes where it has none."""
        return graph.padded_counts(self.nodes)


@dataclass(frozen=True)
class HomoDataset(GraphTables):
    """Homogeneous graphs: nodes have a position and a labelled text, edges the positions of both ends and a labelled text."""

    @classmethod
    def shape(cls, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        indexed = graph.index_nodes(nodes)
        numbered = indexed.select("graph", F.col("pos0").alias("pos"), F.col("labelled_text").alias("text"))
        bound = graph.typed_edges(indexed, edges)
        return numbered, bound.select("graph", "epos", F.col("src_pos0").alias("src"), F.col("dst_pos0").alias("dst"), F.col("labelled_text").alias("text"))

    def embed(self, embedder: Embedder) -> Self:
        """Nodes with ``x`` and edges with ``attr``, the vectors of their texts."""
        return replace(super().embed(embedder), edges=embed_texts(self.edges, "text", embedder, out="attr"))


__all__ = ["GraphDataset", "GraphTables", "HomoDataset", "feature_width"]
