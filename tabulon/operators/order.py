"""Positions and running totals within groups of any size.

A window over a group takes all of it through one task. Here the rows are first dealt into ranges of the order, so that a
large group falls into many, and what stands before a range is added up apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.session import cut


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` dealt into ranges of ``order``, cut, with ``__part`` for the range; equal keys share a range."""
    return cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` that takes nulls for equal; the keys come once."""
    renamed = right.withColumnsRenamed({k: f"__join_{k}" for k in keys})
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__join_{k}")) for k in keys))
    return left.join(renamed, same).drop(*(f"__join_{k}" for k in keys))


def before(placed: DataFrame, part: str, by: list[str], order: list[str], out: str, amount: Column | None = None) -> DataFrame:
    """``out``: the total of ``amount`` (1 a row if None) over the earlier rows of the ``by`` group.

    ``part`` numbers ranges of the order, or of its first key: rows of a smaller part come first.
    """
    each = F.lit(1) if amount is None else amount
    totals = placed.groupBy(*by, part).agg(F.sum(each).alias("__n"))
    outer = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, part, F.coalesce(F.sum("__n").over(outer), F.lit(0)).alias("__start"))
    inner = Window.partitionBy(*by, part).orderBy(*order)
    within = F.row_number().over(inner) - 1 if amount is None else F.coalesce(F.sum(amount).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return join_null_safe(placed, starts, [*by, part]).withColumn(out, F.col("__start") + within).drop("__start")


def totals_before(placed: DataFrame, part: str, by: list[str], order: list[str], amounts: dict[str, Column]) -> DataFrame:
    """``placed`` with several totals as ``before`` makes one, in the same pass: each name's amount over the earlier rows of the ``by`` group."""
    totals = placed.groupBy(*by, part).agg(*[F.sum(a).alias(f"__{name}") for name, a in amounts.items()])
    outer = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, part, *[F.coalesce(F.sum(f"__{name}").over(outer), F.lit(0)).alias(f"__{name}") for name in amounts])
    inner = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = join_null_safe(placed, starts, [*by, part])
    return joined.withColumns({name: F.col(f"__{name}") + F.coalesce(F.sum(a).over(inner), F.lit(0)) for name, a in amounts.items()}).drop(*[f"__{name}" for name in amounts])


def running(df: DataFrame, by: list[str], order: list[str], out: str, amount: Column | None = None) -> DataFrame:
    """``df`` with ``out``, the total before each row as in ``before``; equal rows of the order come in any order."""
    return before(in_ranges(df, [*by, *order]), "__part", by, order, out, amount).drop("__part")
