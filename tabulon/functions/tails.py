"""Tails of the normal and the chi-square distribution as column expressions, to about 1e-13 of their value."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this argument the error function is a power series, above it its complement is a continued fraction of so many levels.
EDGE, TERMS, LEVELS = 2.0, 60, 120


def erfc(z: Column) -> Column:
    """The complement of the error function for an argument of 0 or more; null stays null."""
    # Both branches work on arguments within their own range, so neither overflows for the other's.
    small, large = F.least(z, F.lit(EDGE)), F.greatest(z, F.lit(EDGE))
    step = lambda a, n: F.struct((a["term"] * 2 * small * small / (2 * n + 1)).alias("term"), (a["sum"] + a["term"] * 2 * small * small / (2 * n + 1)).alias("sum"))
    # All terms are positive: z, z (2 z^2) / 3, z (2 z^2)^2 / (3 5), ...
    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.struct(small.alias("term"), small.alias("sum")), step, lambda a: a["sum"])
    inside = 1 - 2 / math.sqrt(math.pi) * F.exp(-small * small) * series
    fraction = F.aggregate(F.sequence(F.lit(LEVELS), F.lit(1), F.lit(-1)), large, lambda a, n: large + n / 2 / a)
    outside = F.exp(-large * large) / math.sqrt(math.pi) / fraction
    return F.when(z < EDGE, inside).when(z >= EDGE, outside)


def normal_two_sided(z: Column) -> Column:
    """P(|N| > z); 1 for a deviate below 0, as for 0; null stays null."""
    return F.when(z.isNotNull(), erfc(F.greatest(z.cast("double"), F.lit(0.0)) / math.sqrt(2)))


def chi_square_tail(x: Column, freedom: int | Column) -> Column:
    """P(X > x) for a whole number of degrees of freedom, 1 or more: the incomplete gamma function of halves.

    Even: exp(-x/2) times the sum of (x/2)^i / i!; odd: erfc of the root of x/2 plus such a sum in odd halves. A negative x counts as 0; null in either
    stays null.
    """
    k = F.lit(freedom) if isinstance(freedom, int) else freedom
    half = F.greatest(x.cast("double"), F.lit(0.0)) / 2
    odd = k % 2 == 1
    first = F.when(odd, 2 * F.sqrt(half / math.pi) * F.exp(-half)).otherwise(F.exp(-half))
    bottom = lambda i: F.when(odd, i + 0.5).otherwise(i.cast("double"))
    more = lambda a, i: F.struct((a["term"] * half / bottom(i)).alias("term"), (a["sum"] + a["term"]).alias("sum"))
    count = F.when(odd, (k - 1) / 2).otherwise(k / 2).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    terms = F.aggregate(places, F.struct(first.alias("term"), F.lit(0.0).alias("sum")), more, lambda a: a["sum"])
    total = terms + F.when(odd, erfc(F.sqrt(half))).otherwise(F.lit(0.0))
    return F.when(x.isNotNull() & k.isNotNull(), F.least(F.lit(1.0), total))
