"""Command lines: ``python -m tabulon.cli COMMAND``."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import code
from tabulon.operators import align, evaluation, fusion, heads, sampling, training
from tabulon.plans import analysis, graph_dataset, ingest
from tabulon.session import session

#: Datasets by the name that ``build`` takes.
DATASETS = {"hetero": graph_dataset.GraphDataset, "homo": graph_dataset.HomoDataset}

#: The losses of pre-training by the name that ``run`` takes.
TERMS = {"all": align.Terms(), "no_cross": align.Terms(cross=0.0), "contrastive": align.Terms(isotropy=0.0, cross=0.0)}

#: Epochs without improvement after which two vectors' training stops unless the command says otherwise.
PATIENCE = 5


def _named(name: str) -> Callable:
    """The function that ``module:function`` names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def obfuscate_file(spark: SparkSession, path: str, language: str | None = None) -> tuple[str, dict[str, str]]:
    """The obfuscated text of one file and its symbols; the suffix tells the language unless it is given."""
    language = language or {".py": "python", ".java": "java"}.get(Path(path).suffix)
    if language is None:
        raise ValueError("name the language: the suffix is neither .py nor .java")
    text = spark.createDataFrame([(Path(path).read_text(encoding="utf-8"),)], "t string")
    row = text.select(code.obfuscate(F.col("t"), language).alias("t"), code.symbol_map(F.col("t"), language).alias("m")).first()
    return row["t"], dict(row["m"])


def _pretrain(spark: SparkSession, table: DataFrame, a: argparse.Namespace) -> str:
    """Both vectors aligned in seeded batches, of which every fifth is held out; the projections are stored. Says how it went."""
    batches = sampling.mini_batches(table.withColumn("__id", F.xxhash64(a.vector, a.second)), "__id", a.batch_size).withColumn("__held", F.col("batch_id") % 5 == 0)
    fitted = align.align(batches, "batch_id", a.vector, a.second, "__held", a.hidden_dim, TERMS[a.terms], a.patience or PATIENCE, a.epochs, a.learning_rate, a.seed, f"{a.checkpoints}/aligned")
    return f"{len(fitted.epochs)} epochs, held-out loss {min(e[2] for e in fitted.epochs):.6f}"


def _fused(spark: SparkSession, table: DataFrame, a: argparse.Namespace) -> DataFrame:
    """The table with what the fused model, trained first unless it is only applied, predicts."""
    first, second, path = a.vector, a.second, f"{a.checkpoints}/{a.model}_{a.pattern}"
    if a.pattern == "pretrain":
        weights = training.load(spark, f"{a.checkpoints}/aligned")
        table = align.project(align.project(table, first, weights["first"], "__first"), second, weights["second"], "__second")
        first, second = "__first", "__second"
    if a.task_name == "downstream":
        parts = sampling.folds(table.withColumn("__id", F.xxhash64(a.vector, a.label)), a.label, "__id").withColumn("__held", F.col("fold") == 0)
        fusion.train_fusion(parts, first, second, a.label, "__held", a.output_dim, a.model == "fused", a.patience or PATIENCE, a.epochs, a.learning_rate, a.seed, path=path)
    return fusion.gated_fusion(heads.encode_labels(table, a.label, "__truth"), first, second, fusion.model_of(training.load(spark, path)))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tabulon", description="Plans over labelled source code.")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *arguments: tuple) -> None:
        sub = commands.add_parser(name, help=text)
        for flags, options in arguments:
            sub.add_argument(*flags, **options)

    path = (("--path",), {"default": "CPG", "help": "the dataset's folder"})
    command("ingest", "samples to JSON lines with graphs", path, (("samples",), {}), (("--analyser",), {"required": True, "help": "module:function of (code, suffix)"}), (("--key",), {"default": "id"}), (("--small_sample",), {"action": "store_true"}), (("--limit",), {"type": int}), (("--obfuscate",), {"action": "store_true"}))
    command("build", "JSON lines to a stored graph dataset", path, (("--kind",), {"choices": sorted(DATASETS), "default": "hetero"}), (("--first",), {"type": int}))
    command("datasplit", "few-shot splits of a stored dataset", path, (("--tasks",), {"type": int, "default": 50}), (("--max_shot",), {"type": int, "default": 10}), (("--seed",), {"type": int, "default": 42}))
    command("obfuscate", "one source file, or - to print it", (("file",), {}), (("-l", "--lang"), {"choices": ["python", "java"]}), (("-o", "--output"), {}), (("--map",), {"action": "store_true"}))
    command("analyse", "the report on a feature table", (("table",), {}), (("--key",), {"required": True}), (("--label",), {"default": "model"}), (("--features",), {"required": True, "help": "names with commas between"}), (("--out",), {"default": "results"}))
    pairs = (("--second",), {"help": "the other vector, for pretrain, fused and halves"}), (("--model",), {"choices": ["head", "fused", "halves"], "default": "head"}), (("--pattern",), {"choices": ["pretrain", "none"], "default": "none", "help": "whether fused and halves take the vectors that pretrain has aligned"})
    sizes = (("--terms",), {"choices": sorted(TERMS), "default": "all"}), (("--batch_size",), {"type": int, "default": 64}), (("--hidden_dim",), {"type": int, "default": 256}), (("--output_dim",), {"type": int, "default": 256}), (("--learning_rate",), {"type": float, "default": 0.01}), (("--seed",), {"type": int, "default": 0})
    command("run", "align two vectors, or train or apply a classifier on embeddings", (("table",), {}), (("--task_name",), {"choices": ["pretrain", "downstream", "infer"], "default": "downstream"}), (("--vector",), {"default": "embedding"}), (("--label",), {"default": "label"}), (("--epochs",), {"type": int, "default": 100}), (("--patience",), {"type": int, "help": "hold a fifth of the rows out and stop after so many epochs without improvement"}), (("--checkpoints",), {"default": "checkpoints"}), *pairs, *sizes)
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or session("tabulon")
    if a.command == "ingest":
        ingest.ingest(spark.read.parquet(a.samples), _named(a.analyser), a.path, a.key, small=ingest.SMALL_SAMPLE if a.small_sample else None, limit=a.limit, obfuscate=a.obfuscate)
    elif a.command == "build":
        DATASETS[a.kind].build(spark, a.path, first=a.first).write(f"{a.path}/processed_{a.kind}")
    elif a.command == "datasplit":
        graphs = graph_dataset.GraphDataset.load(spark, f"{a.path}/processed_hetero").graphs
        print("\n".join(analysis.few_shot_tasks(graphs, "dataset_idx", ("target", "model"), f"{a.path}/data_split", a.tasks, a.max_shot, a.seed)))
    elif a.command == "obfuscate":
        text, symbols = obfuscate_file(spark, a.file, a.lang)
        Path(a.output).write_text(text, encoding="utf-8") if a.output else print(text)
        if a.map:
            print("\n".join(f"{name} -> {hidden}" for name, hidden in sorted(symbols.items())))
    elif a.command == "analyse":
        table = spark.read.parquet(a.table)
        classes = [r[0] for r in table.filter(F.col(a.label).isNotNull()).select(a.label).distinct().orderBy(a.label).collect()]  # one a class
        tables = analysis.analyse(table, a.key, a.label, classes, a.features.split(","))
        analysis.write_results(tables, a.out)
        print(analysis.report(tables))
    else:
        table = spark.read.parquet(a.table)
        if (a.task_name == "pretrain" or a.model != "head") and not a.second:
            raise ValueError("name the second vector")
        if a.task_name == "pretrain":
            print(_pretrain(spark, table, a))
            return 0
        if a.model != "head":
            print(evaluation.scores(_fused(spark, table, a), "__truth", "predicted").first().asDict())
            return 0
        if a.patience:
            head = f"{a.checkpoints}/stopped_head"
            parts = sampling.folds(table.withColumn("__id", F.xxhash64(a.vector, a.label)), a.label, "__id")
            if a.task_name == "downstream":
                heads.train_head(parts.withColumn("__held", F.col("fold") == 0), a.vector, a.label, "__held", a.patience, a.epochs, path=head)
            shown = heads.apply_linear(heads.load_trained(spark, head), heads.encode_labels(table, a.label, "__truth"), a.vector)
            print(evaluation.scores(shown, "__truth", "predicted").first().asDict())
            return 0
        if a.task_name == "downstream":
            heads.save_head(heads.fit_head(table, a.vector, a.label, a.epochs), f"{a.checkpoints}/head")
        shown = heads.apply_head(heads.load_head(f"{a.checkpoints}/head"), heads.encode_labels(table, a.label, "__truth"), a.vector)
        print(evaluation.scores(shown, "__truth", "predicted").first().asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main())
