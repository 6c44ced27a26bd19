"""A corpus from raw documents to packed sequences. Each stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm.exact import drop_exact_copies
from tabulon.llm.packing import pack, sequences
from tabulon.llm.rules import keep_by_rules
from tabulon.llm.simhash import drop_near_copies
from tabulon.llm.substring import drop_repeats
from tabulon.llm.text import table
from tabulon.session import remove, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither the base rule nor the decision list rejects.

    Null and empty texts have no words and go; rows that repeat an id are judged each by its own text; rows with a null
    id are judged like others. All columns stay as they are, whatever their names; an empty table stays empty.
    """
    return keep_by_rules(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the row with the largest id.

    Rows equal in id and text collapse into one; a null id loses to any other. All columns stay as they are but names that
    start with two underscores are reserved; an empty table stays empty.
    """
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 (Jaccard, five-word shingles) the document with the smallest id.

    Texts without words, null ones too, are one group. Texts of fewer than five words link if their words are equal. Of
    rows that repeat an id each goes for its own text; rows with a null id stay. All columns stay; an empty table stays empty.
    """
    return drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines and passages that an earlier one has; the smaller id is earlier.

    Every row stays; one that is a repeat from end to end keeps an empty text, and ``n_chars`` follows. Null texts and rows with a
    null id stay as they are; rows that repeat an id with other texts are documents of their own. An empty table stays empty.
    """
    return drop_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens.

    A null or empty text is its end mark alone. Repeated rows and null ids are packed like any others; only id and text are
    read; an empty table gives no rows. ``text_key`` tells the texts of rows that repeat an id apart, so that ``training_sequences`` can build the sequences.
    """
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Learned rules, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, location: str | None = None) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written below ``location`` and read again by the next.

    Without a location it is a new folder in the shared one. The texts that were packed stay there, in ``substring_dedup``, beside the packing, in
    ``best_fit_packing``; an earlier stage's folder goes as soon as the next one is written.
    """
    docs, written = table(spark, sf_dir, "documents"), []
    at = location or f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if len(written) > 0 and name != STAGES[-1][0]:
            remove(spark, written[-1])
        written.append(f"{at}/{name}")
    return docs


def training_sequences(spark: SparkSession, location: str) -> DataFrame:
    """``sequence_id, input_ids, documents``: the sequences of a finished run at ``location``, from its own folders."""
    return sequences(spark.read.parquet(f"{location}/best_fit_packing"), spark.read.parquet(f"{location}/substring_dedup"))
