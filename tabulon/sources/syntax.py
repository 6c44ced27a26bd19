"""Syntax trees of Python code as node and edge rows."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import ship_code, spread

#: Which attribute of a node is its content, and under which name it is shown.
_SHOWN = {
    **dict.fromkeys((ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.alias), "name"),
    ast.Name: "id",
    **dict.fromkeys((ast.arg, ast.keyword), "arg"),
    ast.Attribute: "attr",
}


#: Texts of a task at most, about, and rows of trees that are handed on at once.
TEXTS, ROWS = 20_000, 20_000

_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string())


def label(node: ast.AST) -> str:
    """``[Type] name='...'``; constants are cut at 20 characters; other nodes show their type alone."""
    kind = type(node)
    if kind is ast.Constant:
        value = str(node.value).replace("\n", "\\n")
        return f"[Constant] value='{value[:20] + '...' if len(value) > 20 else value}'"
    shown = _SHOWN.get(kind)
    return f"[{kind.__name__}] {shown}='{getattr(node, shown)}'" if shown else f"[{kind.__name__}]"


def tree_rows(code: str | None) -> list[tuple[int, str, int | None, str | None]] | None:
    """``(pos, label, parent, field)`` of every node in pre-order, without recursion; None if the code does not parse."""
    try:
        root = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    rows, stack = [], [(root, None, None)]
    while stack:
        node, parent, field = stack.pop()
        pos = len(rows)
        rows.append((pos, label(node), parent, field))
        below = [(child, pos, name) for name, value in ast.iter_fields(node) for child in (value if isinstance(value, list) else [value]) if isinstance(child, ast.AST)]
        stack.extend(reversed(below))
    return rows


def tree(docs: DataFrame, key: str, code: str) -> DataFrame:
    """``key, pos, label, parent, field`` of the syntax tree of each code text; texts that do not parse have no rows.

    A row with a parent is the edge from it as well, so nodes and edges are projections of one table.
    """
    ship_code(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, rows = batch.column("k"), [], []

            def made() -> pa.RecordBatch:
                columns = zip(*rows, strict=True)
                return pa.record_batch([keys.take(pa.array(places, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=[key, "pos", "label", "parent", "field"])

            for place, text in enumerate(batch.column("c").to_pylist()):
                found = tree_rows(text) or []
                rows += found
                places += [place] * len(found)
                if len(rows) >= ROWS:
                    yield made()
                    places, rows = [], []
            if rows:
                yield made()

    texts = spread(docs.select(F.col(key).alias("k"), F.col(code).alias("c")), TEXTS)
    return texts.mapInArrow(run, f"{key} {kind}, pos long, label string, parent long, field string")
