"""From labelled code samples to JSON lines of records with their graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions import code as codes
from tabulon.operators import clean, sampling
from tabulon.operators.order import running
from tabulon.sources import records

#: Rows per language of the small sample; the test split is taken whole.
SMALL_SAMPLE = {"train": 20_000, "val": 2_000}

#: The split whose code is obfuscated.
INFERRED = "test"


def chosen_samples(samples: DataFrame, key: str, small: dict[str, int] | None = None, limit: int | None = None, obfuscate: bool = False, seed: int = 42) -> DataFrame:
    """Samples with a known model in a language other than C++, numbered ``idx`` from 0 in the order of ``key``, with the ``code`` to analyse.

    ``small`` draws a stratified sample of so many rows per language and split first; ``limit`` then keeps the first rows. Obfuscation
    is for the test split alone and works on ``cleaned_code``, which must be there.
    """
    rows = clean.known_and_not(samples, "model", "language", "cpp")
    if small:
        rows = sampling.quota_sample(rows, small, key, seed=seed)
    if limit is not None:
        rows = rows.orderBy(key).limit(limit)
    if obfuscate:
        rows = rows.filter(F.col("split") == INFERRED).withColumn("code", codes.obfuscate_by_language(F.col("code"), F.col("cleaned_code"), F.col("language")))
    return running(rows, [], [key], "idx")


def ingest(samples: DataFrame, analyse: Callable[[str, str], str | None], path: str, key: str, **options) -> DataFrame:
    """Writes ``cpg_dataset.jsonl`` below ``path``/raw, a folder of JSON lines, and returns the records with their status.

    Every chosen sample has a record, one whose analysis failed with a null graph. ``hash`` is the MD5 of the code analysed.
    """
    rows = chosen_samples(samples, key, **options)
    analysed = records.with_analysis(rows, analyse).withColumn("hash", F.md5(F.col("code").cast("binary")))
    out = analysed.select("idx", "hash", *[F.col(c).cast("string").alias(c) for c in ("target", "model", "language", "split", "source", "code", "graphml")], "status")
    where = f"{path}/raw/cpg_dataset.jsonl"
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(where)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields)
    return samples.sparkSession.read.schema(schema).json(where)
