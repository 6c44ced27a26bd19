"""GraphML documents in a string column, as node and edge rows."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.code import attributes, labelled
from tabulon.session import ship_code

# Namespace, and the keys of node and edge labels.
NAMESPACE = "http://graphml.graphdrawing.org/xmlns"
NODE_LABEL, EDGE_LABEL = "labelV", "labelE"

_DATA = "array<struct<_key:string,_VALUE:string>>"
SCHEMA = f"graph array<struct<node:array<struct<_id:string,data:{_DATA}>>,edge:array<struct<_source:string,_target:string,data:{_DATA}>>>>"
_PARSED = "struct<nodes:array<struct<id:string,data:array<struct<key:string,value:string>>>>,edges:array<struct<source:string,target:string,data:array<struct<key:string,value:string>>>>>"


def parse(docs: DataFrame, xml: str, exact: bool = False) -> DataFrame:
    """``docs`` with ``g`` (nodes, edges) and ``status``: success, empty or parse_failed. The first graph element counts.

    The native way loses values of white space alone; ``exact`` parses in Python and keeps them.
    """
    text = F.col(xml)
    if exact:
        ship_code(docs.sparkSession)
        parsed = F.pandas_udf(_exact, _PARSED)(text)
    else:
        pairs = lambda data: F.transform(F.coalesce(data, F.array().cast(_DATA)), lambda d: F.struct(d["_key"].alias("key"), d["_VALUE"].alias("value")))
        graph = F.get(F.from_xml(text, SCHEMA).getField("graph"), F.lit(0))
        nodes = F.transform(graph["node"], lambda n: F.struct(n["_id"].alias("id"), pairs(n["data"]).alias("data")))
        edges = F.transform(graph["edge"], lambda e: F.struct(e["_source"].alias("source"), e["_target"].alias("target"), pairs(e["data"]).alias("data")))
        parsed = F.when(text.contains(NAMESPACE), F.struct(nodes.alias("nodes"), F.coalesce(edges, F.array().cast("array<struct<source:string,target:string,data:array<struct<key:string,value:string>>>>")).alias("edges")))
    blank = text.isNull() | (F.trim(text) == "")
    out = docs.withColumn("g", F.when(~blank, parsed))
    return out.withColumn("status", F.when(blank, "empty").when(F.coalesce(F.size("g.nodes"), F.lit(0)) <= 0, "parse_failed").otherwise("success"))


def _exact(texts: pd.Series) -> pd.DataFrame:
    tag = lambda name: f"{{{NAMESPACE}}}{name}"
    data = lambda e: [{"key": d.get("key"), "value": d.text} for d in e.findall(tag("data"))]
    rows: list[dict] = []
    for text in texts:
        try:
            graph = ElementTree.fromstring(text or "").find(tag("graph"))
        except ElementTree.ParseError:
            graph = None
        if graph is None:
            rows.append({"nodes": None, "edges": None})
            continue
        rows.append({"nodes": [{"id": n.get("id"), "data": data(n)} for n in graph.findall(tag("node"))], "edges": [{"source": e.get("source"), "target": e.get("target"), "data": data(e)} for e in graph.findall(tag("edge"))]})
    return pd.DataFrame(rows, columns=["nodes", "edges"])


def _label(data: Column, key: str, default: str) -> Column:
    """The value under ``key``, null where it is there but empty, and ``default`` where it is not."""
    hits = F.filter(data, lambda d: d["key"] == key)
    value = F.get(hits, F.lit(0)).getField("value")
    return F.when(F.size(hits) == 0, default).otherwise(F.when(value != "", value))


def node_rows(parsed: DataFrame, graph: str) -> DataFrame:
    """``graph, pos, node, type, text, labelled_text`` of every node, in document order; an unlabelled one is ``UNKNOWN``."""
    rows = parsed.filter("status = 'success'").select(F.col(graph).alias("graph"), F.posexplode("g.nodes").alias("pos", "n"))
    text, label = attributes(F.col("n.data"), NODE_LABEL), _label(F.col("n.data"), NODE_LABEL, "UNKNOWN")
    return rows.select("graph", "pos", F.col("n.id").alias("node"), label.alias("type"), text.alias("text"), labelled(label, text).alias("labelled_text"))


def edge_rows(parsed: DataFrame, graph: str) -> DataFrame:
    """``graph, epos, source, target, rel, labelled_text`` of every edge; an unlabelled one is an ``edge``."""
    rows = parsed.filter("status = 'success'").select(F.col(graph).alias("graph"), F.posexplode("g.edges").alias("epos", "e"))
    label = _label(F.col("e.data"), EDGE_LABEL, "edge")
    return rows.select("graph", "epos", F.col("e.source").alias("source"), F.col("e.target").alias("target"), label.alias("rel"), labelled(label, attributes(F.col("e.data"), EDGE_LABEL)).alias("labelled_text"))


def element_counts(docs: DataFrame, xml: str) -> DataFrame:
    """``docs`` with the numbers of node and edge tags, by substring."""
    return docs.withColumn("n_nodes", F.regexp_count(xml, F.lit("<node "))).withColumn("n_edges", F.regexp_count(xml, F.lit("<edge ")))
