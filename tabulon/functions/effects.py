"""Buckets and formats for test statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of Cliff's delta (absolute) and of eta squared.
CLIFF = (0.474, 0.330, 0.147)
ETA = (0.06, 0.01, 0.0)


def cliff_effect(delta: Column) -> Column:
    size = F.abs(delta)
    return F.when(size >= CLIFF[0], "Large").when(size >= CLIFF[1], "Medium").when(size >= CLIFF[2], "Small").otherwise("Negligible")


def eta_effect(eta2: Column) -> Column:
    return F.when(eta2 > ETA[0], "Large").when(eta2 >= ETA[1], "Medium").when(eta2 > ETA[2], "Small").otherwise("Negligible")


def eta_squared(h: Column, groups: Column, rows: Column) -> Column:
    return F.try_divide(h - groups + 1, rows - groups)


def format_p(p: Column) -> Column:
    """A p-value below one of three bounds as that bound, else to three places."""
    return F.when(p < 0.001, "p < 0.001").when(p < 0.01, "p < 0.01").when(p < 0.05, "p < 0.05").otherwise(F.concat(F.lit("p = "), F.format_number(p, 3)))


def evidence(accuracy: Column, features: Column) -> Column:
    """Strength of evidence from accuracy and the number of features with an effect of note."""
    return F.when((accuracy >= 0.40) & (features >= 3), "strong").when(accuracy >= 0.25, "moderate").otherwise("weak")


def clip_above(value: Column, cap: Column) -> Column:
    """``cap`` where the value is above it; null stays null."""
    return F.when(value > cap, cap).otherwise(value)
