"""Evaluation of predicted classes, all from the counts of (truth, prediction)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    """``truth, predicted, n, rate`` for the whole grid of ``classes``; the rate is of the row, 0 where it is empty."""
    counts = df.filter(F.col(truth).isin(classes) & F.col(predicted).isin(classes)).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(t, p) for t in classes for p in classes], "truth string, predicted string")
    grid = names.join(counts, ["truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("truth"))
    return grid.withColumn("rate", F.when(total > 0, F.col("n") / total).otherwise(0.0))


def recall(grid: DataFrame) -> DataFrame:
    """``class, recall``, best first."""
    return grid.filter("truth = predicted").select(F.col("truth").alias("class"), F.col("rate").alias("recall")).orderBy(F.desc("recall"), "class")


def top_confusions(grid: DataFrame, classes: list[str], k: int = 5) -> DataFrame:
    """The ``k`` wrong pairs with the greatest rates; ties in the order of classes."""
    place = F.array(*map(F.lit, classes))
    wrong = grid.filter("truth <> predicted")
    return wrong.orderBy(F.desc("rate"), F.array_position(place, F.col("truth")), F.array_position(place, F.col("predicted"))).limit(k).select("truth", "predicted", "rate")


def scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``n, accuracy, macro_f1, n_classes, baseline``. Macro-F1 is the plain mean over all classes true or predicted."""
    pairs = df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.col("n").alias("true"), F.lit(0).cast("long").alias("said"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("true"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    per_class = sides.groupBy("class").agg(F.sum("true").alias("true"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    return per_class.agg(F.sum("true").alias("n"), (F.sum("hit") / F.sum("true")).alias("accuracy"), F.avg(2 * F.col("hit") / (F.col("true") + F.col("said"))).alias("macro_f1"), F.count_if(F.col("true") > 0).alias("n_classes"), (F.lit(1.0) / F.count_if(F.col("true") > 0)).alias("baseline"))
