"""Cross-validated random forests on feature tables, with out-of-fold predictions and importances."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.clean import encode_labels
from tabulon.operators.sampling import folds
from tabulon.session import cut


def _forest(trees: int, depth: int, seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed)


def _assembled(df: DataFrame, features: list[str], label: str) -> DataFrame:
    known = encode_labels(df.filter(F.col(label).isNotNull()).na.fill(0, features), label, "__y").withColumn("__y", F.col("__y").cast("double"))
    return VectorAssembler(inputCols=features, outputCol="__x").transform(known)


def cross_validated(df: DataFrame, key: str, label: str, features: list[str], k: int = 5, trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    """``key, truth, predicted, fold``: each row predicted by the forest that did not see its fold. Classes are numbers."""
    rows = cut(folds(_assembled(df, features, label), label, key, k, seed))
    parts = []
    for fold in range(k):
        model = _forest(trees, depth, seed).fit(rows.filter(F.col("fold") != fold))
        parts.append(model.transform(rows.filter(F.col("fold") == fold)).select(key, F.col("__y").cast("int").alias("truth"), F.col("prediction").cast("int").alias("predicted"), "fold"))
    return reduce(DataFrame.unionByName, parts)


def importances(df: DataFrame, label: str, features: list[str], trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    """``feature, importance``, most important first."""
    model: RandomForestClassificationModel = _forest(trees, depth, seed).fit(_assembled(df, features, label))
    rows = sorted(zip(features, map(float, model.featureImportances.toArray()), strict=True), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def by_fold(predictions: DataFrame) -> DataFrame:
    """``accuracy_mean, accuracy_std``: mean and population deviation over folds."""
    each = predictions.groupBy("fold").agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("a"))
    return each.agg(F.avg("a").alias("accuracy_mean"), F.stddev_pop("a").alias("accuracy_std"))
