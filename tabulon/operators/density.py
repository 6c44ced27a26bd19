"""Kernel densities of features by class, from binned counts: what a violin chart draws."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators.order import running


def quantiles(long: DataFrame, q: float) -> DataFrame:
    """``feature, cap``: the exact quantile of each feature's values, interpolated between neighbours, from counts of distinct values.

    ``long`` has ``feature, value``, neither null nor NaN. As ``ranks.quantile``, for all features in one pass.
    """
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counts, ["feature"], ["value"], "before", F.col("n"))
    at = F.lit(q) * (F.col("total") - 1)
    holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
    joined = ranked.join(long.groupBy("feature").agg(F.count(F.lit(1)).alias("total")), "feature")
    found = joined.groupBy("feature").agg(F.max(F.when(holds(F.floor(at)), F.col("value"))).alias("low"), F.max(F.when(holds(F.ceil(at)), F.col("value"))).alias("high"), F.max(at - F.floor(at)).alias("share"))
    return found.select("feature", (F.col("low") + F.col("share") * (F.col("high") - F.col("low"))).alias("cap"))


def densities(df: DataFrame, label: str, features: list[str], classes: list[str], bins: int = 64, q: float = 0.99) -> DataFrame:
    """``feature, class, bin, x, density``: a Gaussian kernel density of each class's values at the middle of each of ``bins`` bins.

    Values are capped at the feature's ``q`` quantile; bins divide what lies between its smallest and its largest value of all classes. Each class has a bandwidth of
    its own, n^(-1/5) of its sample deviation. Values count as if they lay in the middle of their bin, so after one aggregation by bin the work depends on
    features, classes and bins alone. Nulls, NaN and other classes are left out; a class with one value, or equal ones only, has a null density; a class
    without values has no rows.
    """
    rows = df.filter(F.col(label).isin(classes)).select(F.col(label).alias("class"), *[F.col(f).cast("double").alias(f) for f in features])
    long = rows.unpivot(["class"], features, "feature", "value").filter("value IS NOT NULL AND NOT isnan(value)")
    capped = long.join(F.broadcast(quantiles(long, q)), "feature").withColumn("value", F.least("value", "cap"))  # a row a feature
    sizes = capped.groupBy("feature", "class").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("deviation"), F.min("value").alias("least"), F.max("value").alias("most"))
    every = Window.partitionBy("feature")
    width = (F.max("most").over(every) - F.min("least").over(every)) / bins
    shape = sizes.select("feature", "class", "n", F.min("least").over(every).alias("low"), width.alias("width"), (F.pow("n", F.lit(-0.2)) * F.col("deviation")).alias("band"))
    place = F.when(F.col("width") > 0, F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("low")) / F.col("width")))).otherwise(F.lit(0)).cast("int")
    counted = capped.join(F.broadcast(shape), ["feature", "class"]).groupBy("feature", "class", place.alias("at")).agg(F.count(F.lit(1)).alias("count"))  # a row a feature and class
    middle = lambda i: F.col("low") + (i + 0.5) * F.col("width")
    pairs = counted.join(shape, ["feature", "class"]).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    away = F.try_divide(middle(F.col("bin")) - middle(F.col("at")), F.col("band"))
    kernel = F.exp(-away * away / 2) / math.sqrt(2 * math.pi)
    total = F.sum(F.col("count") * kernel)
    out = pairs.groupBy("feature", "class", "bin").agg(F.max(middle(F.col("bin"))).alias("x"), F.try_divide(total, F.max(F.col("n") * F.col("band"))).alias("density"))
    return out.select("feature", "class", "bin", "x", "density")
