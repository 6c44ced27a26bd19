"""Rank statistics: Kruskal-Wallis, Mann-Whitney and Cliff's delta, from counts of distinct values.

Equal values are counted before anything is ranked, and the running counts that ranks need are taken within ranges of
values, the ranges' own totals being added up apart. So no feature has to pass through one task.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.effects import clip_above, cliff_effect, eta_effect, eta_squared
from tabulon.functions.tails import chi_square_tail, normal_two_sided
from tabulon.operators.order import in_ranges, running, totals_before
from tabulon.operators.sampling import first_of_each
from tabulon.session import cut, ship_code


def _ranked(counts: DataFrame, by: list[str]) -> DataFrame:
    """``counts`` (``by``, ``value``, ``n`` and more) with ``rank``, the average rank of the value among all of its ``by`` group."""
    return running(counts, by, ["value"], "__before", F.col("n")).withColumn("rank", F.col("__before") + (F.col("n") + 1) / 2).drop("__before")


def _long(df: DataFrame, label: str, features: list[str], classes: list[str]) -> DataFrame:
    """``feature, value, n`` and a count per class, for values that are neither null nor NaN."""
    rows = df.filter(F.col(label).isin(classes)).select(F.col(label).alias("__label"), *[F.col(f).cast("double").alias(f) for f in features])
    long = rows.unpivot(["__label"], features, "feature", "value").filter("value IS NOT NULL AND NOT isnan(value)")
    per_class = [F.sum((F.col("__label") == c).cast("long")).alias(f"n{i}") for i, c in enumerate(classes)]
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), *per_class)


def kruskal(df: DataFrame, label: str, features: list[str], classes: list[str]) -> DataFrame:
    """``feature, n, h, p, eta2, effect`` per feature, corrected for ties. Missing values are left out feature by feature.

    Classes without a value of a feature do not count as groups of it, neither in the degrees of freedom nor in eta squared. All values equal,
    or fewer than two groups, give a null ``h``, ``p`` and ``eta2``; so does ``eta2`` if no group has two values.
    """
    counts = _ranked(_long(df, label, features, classes), ["feature"])
    sums = [F.sum(F.col(f"n{i}") * F.col("rank")).alias(f"r{i}") for i in range(len(classes))]
    sizes = [F.sum(f"n{i}").alias(f"c{i}") for i in range(len(classes))]
    n = F.col("n").cast("double")
    out = counts.groupBy("feature").agg(F.sum("n").alias("n"), F.sum(n * n * n - n).alias("ties"), *sums, *sizes)
    n = F.col("n").cast("double")
    squares = reduce(Column.__add__, (F.coalesce(F.try_divide(F.col(f"r{i}") * F.col(f"r{i}"), F.col(f"c{i}")), F.lit(0.0)) for i in range(len(classes))))
    raw = F.lit(12.0) / (n * (n + 1)) * squares - 3 * (n + 1)
    correction = F.lit(1.0) - F.try_divide(F.col("ties"), n * n * n - n)
    groups = reduce(Column.__add__, ((F.col(f"c{i}") > 0).cast("int") for i in range(len(classes))))
    out = out.withColumn("groups", groups).withColumn("h", F.when((correction > 0) & (F.col("groups") > 1), raw / correction))
    out = out.withColumn("p", chi_square_tail(F.col("h"), F.col("groups") - 1)).withColumn("eta2", eta_squared(F.col("h"), F.col("groups"), n))
    return out.select("feature", "n", "h", "p", "eta2", eta_effect(F.col("eta2")).alias("effect"))


#: Pairs of classes that one aggregate takes; more of them are taken in turn from the same table of running counts.
PAIRS = 45


def _pairs(df: DataFrame, label: str, features: list[str], classes: list[str]) -> DataFrame:
    """``feature, first, second, n1, n2, u, ties`` for every unordered pair of classes, in the order given.

    One pass over the distinct values with the running count of each class: U of a pair is the sum, over the first class's values, of how many of the
    second's are smaller, equal ones counting half. So no value is repeated for the pairs, whose number only widens the last, small aggregate.
    """
    counts = _long(df, label, features, classes)
    numbers = range(len(classes))
    placed = totals_before(in_ranges(counts, ["feature", "value"]), "__part", ["feature"], ["value"], {f"b{i}": F.col(f"n{i}") for i in numbers})
    names = list(combinations(numbers, 2))
    if len(names) > PAIRS:
        placed = cut(placed)
    return reduce(DataFrame.unionByName, [_some_pairs(placed, classes, names[at : at + PAIRS]) for at in range(0, len(names), PAIRS)])


def _some_pairs(placed: DataFrame, classes: list[str], names: list[tuple[int, int]]) -> DataFrame:
    # As SQL texts, one call each: building so many expressions a column at a time takes longer than running them.
    sums = [F.expr(f"sum(n{i}) AS c{i}") for i in sorted({i for pair in names for i in pair})]
    for i, j in names:
        n = f"double(n{i} + n{j})"
        sums += [F.expr(f"sum(n{i} * (b{j} + n{j} / 2D)) AS u{i}_{j}"), F.expr(f"sum({n} * {n} * {n} - {n}) AS t{i}_{j}")]
    out = placed.groupBy("feature").agg(*sums)
    pairs = ", ".join(f"named_struct('i', {i}, 'j', {j}, 'n1', c{i}, 'n2', c{j}, 'u', u{i}_{j}, 'ties', t{i}_{j})" for i, j in names)
    names_of = F.array(*map(F.lit, classes))
    told = [F.get(names_of, F.col(f"p.{c}")).alias(name) for c, name in (("i", "first"), ("j", "second"))]
    return out.select("feature", F.explode(F.expr(f"array({pairs})")).alias("p")).select("feature", *told, "p.n1", "p.n2", "p.u", "p.ties").filter("n1 + n2 > 0")


def _with_z(pairs: DataFrame) -> DataFrame:
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    total = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * ((total + 1) - F.try_divide(F.col("ties"), total * (total - 1))))
    out = pairs.withColumn("z", F.when((n1 > 0) & (n2 > 0) & (spread > 0), (F.abs(F.col("u") - n1 * n2 / 2) - 0.5) / spread))
    return out.withColumn("delta", F.when((n1 > 0) & (n2 > 0), 2 * F.col("u") / (n1 * n2) - 1))


def mann_whitney(df: DataFrame, label: str, features: list[str], classes: list[str]) -> DataFrame:
    """``feature, first, second, n1, n2, u, z, delta, effect`` for every unordered pair of classes, in the order given.

    U is the first class's; z is the normal approximation with ties and continuity corrected; delta is Cliff's, from the
    identity 2 U / (n1 n2) - 1 instead of comparing all pairs of values.
    """
    out = _with_z(_pairs(df, label, features, classes))
    return out.select("feature", "first", "second", "n1", "n2", "u", "z", "delta", cliff_effect(F.col("delta")).alias("effect"))


#: The exact distribution is taken if no values are equal, a group has so many values at most, and the two sizes' product is within the second bound.
EXACT_GROUP, EXACT_CELLS = 8, 1 << 22


def u_tail(n1: int, n2: int, u: float) -> float:
    """The exact two-sided p of U for groups without ties.

    How many orders of the values have each U follows by recurrence over the smaller group: U's generating function gains the factor
    (1 - q^(n + i)) / (1 - q^i) with its i-th value. Only what is up to the smaller U is worked out; the distribution is symmetric.
    """
    m, n = sorted((n1, n2))
    ways = np.zeros(int(min(u, n1 * n2 - u)) + 1)
    ways[0] = 1
    for i in range(1, m + 1):
        if n + i < len(ways):
            ways[n + i :] -= ways[: -(n + i)].copy()
        for start in range(min(i, len(ways))):
            ways[start::i] = np.cumsum(ways[start::i])
    return min(1.0, 2 * ways.sum() / math.comb(m + n, m))


def mann_whitney_p(df: DataFrame, label: str, features: list[str], classes: list[str]) -> DataFrame:
    """``feature, first, second, n1, n2, u, p, method, delta`` for every pair: ``p`` is exact where ``EXACT_GROUP`` and ``EXACT_CELLS`` allow, else the approximation's.

    ``method`` says which. A pair with an empty class has a null p.
    """

    @F.arrow_udf("double")
    def exact(n1: pa.Array, n2: pa.Array, u: pa.Array) -> pa.Array:
        return pa.array([None if a is None else u_tail(a, b, c) for a, b, c in zip(n1.to_pylist(), n2.to_pylist(), u.to_pylist(), strict=True)], pa.float64())

    ship_code(df.sparkSession)
    fits = (F.col("ties") == 0) & (F.least("n1", "n2") > 0) & (F.least("n1", "n2") <= EXACT_GROUP) & (F.col("n1").cast("double") * F.col("n2") <= EXACT_CELLS)
    out = _with_z(_pairs(df, label, features, classes)).withColumn("method", F.when(fits, "exact").otherwise("normal"))
    given = [F.when(F.col("method") == "exact", F.col(c)) for c in ("n1", "n2", "u")]
    out = out.withColumn("exact", exact(*given)).withColumn("p", F.coalesce("exact", normal_two_sided(F.col("z"))))
    return out.select("feature", "first", "second", "n1", "n2", "u", "p", "method", "delta")


def pairwise_table(df: DataFrame, label: str, features: list[str], classes: list[str], alpha: float = 0.05) -> DataFrame:
    """The pairs with Bonferroni-corrected p (not clipped at 1), significance, delta and effect; strongest first."""
    count = len(classes) * (len(classes) - 1) // 2
    out = mann_whitney_p(df, label, features, classes).withColumn("effect", cliff_effect(F.col("delta")))
    out = out.select("feature", F.concat_ws(" vs ", "first", "second").alias("pair"), F.bround("u", 0).alias("u"), F.bround(F.col("p") * count, 6).alias("p_adjusted"), F.when(F.col("p") < alpha / count, "Yes").otherwise("No").alias("significant"), F.bround("delta", 3).alias("delta"), "effect")
    return out.orderBy(F.abs("delta").desc(), "feature", "pair")


def notable_features(table: DataFrame, fallback: int = 10) -> DataFrame:
    """Features of large or medium effect; the first ``fallback`` by eta squared if there are none."""
    chosen = table.filter(F.col("effect").isin("Large", "Medium"))
    return table.orderBy(F.desc("eta2"), "feature").limit(fallback) if chosen.isEmpty() else chosen


def standardise(df: DataFrame, features: list[str]) -> DataFrame:
    """The features with missing values as 0, mean 0 and population deviation 1; a constant feature becomes 0."""
    filled = df.na.fill(0, features)
    stats = filled.agg(*[f(c).alias(f"__{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    joined = filled.crossJoin(F.broadcast(stats))  # one row
    scaled = {c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0) for c in features}
    return joined.withColumns(scaled).select(*df.columns)


def quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """``value``: the exact quantile, interpolated between neighbours, as one row; null if there is no value.

    Distinct values are counted and ranked in ranges, so neither the rows nor the distinct values meet in one task.
    """
    counts = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counts, [], ["v"], "before", F.col("n"))
    total = ranked.agg(F.sum("n").alias("total"))  # one row
    at = F.lit(q) * (F.col("total") - 1)
    holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
    found = ranked.crossJoin(F.broadcast(total)).agg(F.max(F.when(holds(F.floor(at)), F.col("v"))).alias("low"), F.max(F.when(holds(F.ceil(at)), F.col("v"))).alias("high"), F.max(at - F.floor(at)).alias("share"))
    return found.select((F.col("low") + F.col("share") * (F.col("high") - F.col("low"))).alias("value"))


def clip_at_quantile(df: DataFrame, column: str, q: float = 0.99) -> DataFrame:
    """The column capped at its exact quantile; nulls stay."""
    cap = quantile(df, column, q).withColumnRenamed("value", "__cap")  # one row
    return df.crossJoin(F.broadcast(cap)).withColumn(column, clip_above(F.col(column).cast("double"), F.col("__cap"))).drop("__cap")


def significant(table: DataFrame) -> DataFrame:
    """The pairs of ``pairwise_table`` that are significant; none of an empty table."""
    return table.filter(F.col("significant") == "Yes")


def capped(df: DataFrame, label: str, key: str, most: int = 3000, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each class, in seeded order: the optional sample before pairwise tests, which do not need it here."""
    return first_of_each(df, [label], F.lit(most), key, seed)
