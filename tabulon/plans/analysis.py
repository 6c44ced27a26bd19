"""The whole analysis of a labelled feature table, and few-shot splits, with their result files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.effects import evidence
from tabulon.operators import clean, evaluation, forest, ranks, sampling
from tabulon.sources import records


def analyse(df: DataFrame, key: str, label: str, classes: list[str], features: list[str], folds: int = 5, trees: int = 100) -> dict[str, DataFrame]:
    """Class counts, missing values, Kruskal and pairwise tables, forest accuracy, confusions and importances.

    Features that the table lacks are left out; see ``clean.columns_present``.
    """
    present, _ = clean.columns_present(df, features)
    own = df.filter(F.col(label).isin(classes))
    kruskal = ranks.kruskal(own, label, present, classes).orderBy(F.desc("eta2"), "feature")
    notable = [r["feature"] for r in ranks.notable_features(kruskal).select("feature").collect()]  # at most one a feature
    predictions = forest.cross_validated(own, key, label, present, folds, trees)
    names = sorted(classes)
    coded = predictions.select(*[F.element_at(F.array(*map(F.lit, names)), F.col(c) + 1).alias(c) for c in ("truth", "predicted")])
    grid = evaluation.confusion(coded, "truth", "predicted", classes)
    return {
        "classes": clean.class_counts(df, label, classes),
        "missing": clean.null_profile(df.select(label, *present), only_missing=True),
        "kruskal": kruskal,
        "pairwise": ranks.pairwise_table(own, label, notable, classes),
        "folds": forest.by_fold(predictions),
        "scores": evaluation.scores(coded, "truth", "predicted"),
        "recall": evaluation.recall(grid),
        "confusions": evaluation.top_confusions(grid, classes),
        "importances": forest.importances(own, label, present, trees),
    }


def report(tables: dict[str, DataFrame], top: int = 5) -> str:
    """A short text with what the tables say; nothing in it is assumed."""
    kruskal = {r["feature"]: r for r in tables["kruskal"].collect()}
    scores = tables["scores"].first()
    strong = sum(r["effect"] in ("Large", "Medium") for r in kruskal.values())
    folds = tables["folds"].withColumn("grade", evidence(F.col("accuracy_mean"), F.lit(strong))).first()
    accuracy, grade = folds["accuracy_mean"], folds["grade"]
    missing = ", ".join(f"{r['column_name']} {r['n_null']}" for r in tables["missing"].collect()) or "none"
    lines = ["# Structural differences between classes", "", f"Rows: {scores['n']}; missing values: {missing}.", f"Features with a large or medium effect: {strong} of {len(kruskal)}; p < 0.001 for {sum(r['p'] is not None and r['p'] < 0.001 for r in kruskal.values())}."]
    lines.append(f"Accuracy {accuracy:.3f} (deviation {folds['accuracy_std']:.3f}), macro-F1 {scores['macro_f1']:.3f}, chance {scores['baseline']:.3f}: {grade} evidence.")
    lines += ["", "| feature | importance | eta2 | effect |", "|-|-|-|-|"]
    for r in tables["importances"].orderBy(F.desc("importance"), "feature").limit(top).collect():
        k = kruskal[r["feature"]]
        lines.append(f"| {r['feature']} | {r['importance']:.4f} | {k['eta2'] or 0:.4f} | {k['effect']} |")
    return "\n".join(lines) + "\n"


def write_results(tables: dict[str, DataFrame], path: str) -> None:
    """The test tables as one CSV folder each."""
    for name in ("kruskal", "pairwise"):
        records.write_csv(tables[name], f"{path}/{name}")


def few_shot(df: DataFrame, key: str, label: str, tasks: int = 50, max_shot: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Label ids, the 20:80 split, and nested episodes from the classes whose training part has ``max_shot`` rows."""
    coded = clean.encode_labels(df.select(key, label), label)
    parts = sampling.split(coded, "label_id", key, 0.2, seed)
    return coded.select(label, "label_id").distinct(), parts, sampling.episodes(parts.filter("part = 'train'"), "label_id", key, tasks, max_shot, seed)


def _json(value: Column) -> Column:
    """A value as JSON by itself."""
    listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _section(rows: DataFrame, section: int, key: str, text: Column, opening: str) -> DataFrame:
    """``section, label, key, text``: an opening, then the texts with a comma before all but the first in the order of ``key``."""
    first = rows.agg(F.min(key).alias("__first"))  # one row
    label = F.col(key).cast("long") if key == "label_id" else F.lit(None).cast("long")
    comma = F.when(F.col(key) > F.col("__first"), ",").otherwise("")
    listed = rows.crossJoin(F.broadcast(first)).select(F.lit(section).alias("section"), F.lit(1).alias("inner"), label.alias("label"), (F.lit(None) if key == "label_id" else F.col(key)).alias("key"), F.concat(comma, text).alias("text"))
    start = rows.sparkSession.createDataFrame([(section, 0, opening)], "section int, inner int, text string")
    return start.unionByName(listed, allowMissingColumns=True)


def base_split_pieces(labels: DataFrame, parts: DataFrame) -> DataFrame:
    """``section, inner, label, key, text``, in that order one JSON text: the label map, its inverse, and the keys of either part."""
    key, name = parts.columns[0], labels.columns[0]
    label = F.col("label_id").cast("string")
    text = F.coalesce(F.col(name).cast("string"), F.lit("None"))
    sections = [
        _section(labels, 0, "label_id", F.concat(_json(text), F.lit(": "), label), '{"label_map": {'),
        _section(labels, 1, "label_id", F.concat(F.lit('"'), label, F.lit('": '), _json(text)), '}, "id_map": {'),
        *[_section(parts.filter(F.col("part") == part), 2 + i, key, _json(F.col(key)), f'{"]" if i else "}"}, "{part}_indices": [') for i, part in enumerate(("train", "test"))],
        labels.sparkSession.createDataFrame([(4, 0, "]}")], "section int, inner int, text string"),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sections)


def episode_pieces(episodes: DataFrame) -> DataFrame:
    """``task, k, inner, class, text``, in that order one JSON list of tasks, each with its classes' members for every k. No task is ever one row."""
    drawn = episodes.groupBy(F.col("task_id").alias("task"), "k", F.col("class_id").alias("class")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "member"))), lambda x: x["member"]).alias("m"))  # k members
    sets = drawn.groupBy("task", "k").agg(F.min("class").alias("first"))
    tasks = drawn.groupBy("task").agg(F.min("k").alias("first"))
    least = tasks.agg(F.min("task").alias("first"))  # one row
    comma = lambda own, first: F.when(F.col(own) > F.col(first), ",").otherwise("")
    no_class = F.lit(None).cast(drawn.schema["class"].dataType).alias("class")
    place = lambda k, inner: [F.col("task"), k.cast("long").alias("k"), F.lit(inner).alias("inner")]
    edge = lambda task, text: episodes.sparkSession.createDataFrame([(task, text)], "task long, text string").select("task", F.lit(0).cast("long").alias("k"), F.lit(0).alias("inner"), no_class, "text")
    pieces = [
        drawn.join(sets, ["task", "k"]).select(*place(F.col("k"), 1), "class", F.concat(comma("class", "first"), F.lit('"'), F.col("class").cast("string"), F.lit('": '), F.to_json("m")).alias("text")),
        sets.join(tasks.withColumnRenamed("first", "least"), "task").select(*place(F.col("k"), 0), no_class, F.concat(comma("k", "least"), F.lit('"'), F.col("k").cast("string"), F.lit('_shot": {')).alias("text")),
        sets.select(*place(F.col("k"), 2), no_class, F.lit("}").alias("text")),
        tasks.drop("first").crossJoin(F.broadcast(least)).select(*place(F.lit(-1), 0), no_class, F.concat(comma("task", "first"), F.lit('{"task_id": '), F.col("task").cast("string"), F.lit(', "data": {')).alias("text")),
        tasks.select(*place(F.lit(2**40), 2), no_class, F.lit("}}").alias("text")),
        edge(-1, "["),
        edge(2**40, "]"),
    ]
    return reduce(DataFrame.unionByName, [p.withColumn("task", F.col("task").cast("long")) for p in pieces])


def write_few_shot(labels: DataFrame, parts: DataFrame, episodes: DataFrame, folder: str, task: str) -> list[str]:
    """Two JSON documents below ``folder``, named by classes and tasks, in part files with a manifest (``records.write_document``). No row passes the driver."""
    tasks = episodes.agg(F.count_distinct("task_id")).first()[0]
    ways = labels.count()
    files = {f"{ways}way_base_split_{task}.json": (base_split_pieces(labels, parts), ["section", "inner", "label", "key"]), f"{ways}way_{tasks}tasks_{task}.json": (episode_pieces(episodes), ["task", "k", "inner", "class"])}
    for name, (pieces, order) in files.items():
        records.write_document(pieces, order, "text", f"{folder}/{name}")
    return sorted(files)


def few_shot_tasks(df: DataFrame, key: str, columns: tuple[str, ...], folder: str, tasks: int = 50, max_shot: int = 10, seed: int = 42) -> list[str]:
    """The few-shot files of every label column in turn."""
    return [name for c in columns for name in write_few_shot(*few_shot(df, key, c, tasks, max_shot, seed), folder, c)]
