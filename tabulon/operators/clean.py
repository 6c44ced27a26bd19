"""Null-safe filters, counts and deduplication of record tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.order import running


def known_and_not(df: DataFrame, known: str, other: str, value) -> DataFrame:
    """Rows whose ``known`` is not null and whose ``other`` is not ``value``; null counts as different."""
    return df.filter(F.col(known).isNotNull() & ~F.col(other).eqNullSafe(F.lit(value)))


def subset(df: DataFrame, **equal) -> DataFrame:
    """Rows that match every keyword. An unknown column is an error; without keywords all rows match."""
    unknown = set(equal) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    return df.filter(reduce(Column.__and__, (F.col(k).eqNullSafe(F.lit(v)) for k, v in equal.items()), F.lit(True)))


def columns_present(df: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """The wanted columns that are there, and those that are missing, in the order wanted."""
    return [c for c in wanted if c in df.columns], [c for c in wanted if c not in df.columns]


def missing(df: DataFrame, name: str) -> Column:
    """Whether a value is null, or NaN in a floating column."""
    return F.col(name).isNull() | F.isnan(name) if dict(df.dtypes)[name] in ("double", "float") else F.col(name).isNull()


def null_profile(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """``column_name, n_null`` for every column, in one pass."""
    counts = df.agg(*[F.sum(missing(df, c).cast("long")).alias(c) for c in df.columns])
    long = counts.unpivot([], df.columns, "column_name", "n_null").withColumn("n_null", F.coalesce("n_null", F.lit(0)))
    return long.filter("n_null > 0") if only_missing else long


def class_counts(df: DataFrame, label: str, classes: list | None = None) -> DataFrame:
    """Rows per class, nulls left out. With ``classes`` just these, those without rows too."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if classes is None:
        return counts
    wanted = df.sparkSession.createDataFrame([(c,) for c in classes], f"{label} {df.schema[label].dataType.simpleString()}")
    return wanted.join(counts, label, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, rows without a key together; null orders come before all others. Only the winning struct of each key is shuffled."""
    rest = [c for c in df.columns if c not in (key, order)]
    # In a struct, since a null order by itself would be passed over.
    last = df.groupBy(key).agg(F.max_by(F.struct(order, *rest), F.struct(F.col(order).isNotNull(), order)).alias("r"))
    return last.select(key, "r.*").select(*df.columns)


def valid_classes(df: DataFrame, label: str, at_least: int) -> DataFrame:
    """Rows of the classes that have ``at_least`` rows."""
    enough = df.groupBy(label).count().filter(F.col("count") >= at_least)
    return df.join(enough, label, "left_semi")


def encode_labels(df: DataFrame, label: str, out: str = "label_id") -> DataFrame:
    """``out``: the place of the label among all distinct ones, sorted as strings by code point, null as ``None``.

    Only the distinct labels are put in order, in ranges.
    """
    text = F.coalesce(F.col(label).cast("string"), F.lit("None"))
    ids = running(df.select(text.alias("__label")).distinct(), [], ["__label"], out).withColumn(out, F.col(out).cast("int"))
    return df.withColumn("__label", text).join(ids, "__label").drop("__label")
