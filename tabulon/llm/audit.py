"""What each filter of a chain removes in every order of the chain, from one aggregate over the edges of the lattice of filter sets."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.text import table
from tabulon.session import cut

#: Counts of an edge: documents that the next filter lets through, removes, or would have removed had an earlier one not; those that no
#: other filter fails; and of the removed ones those marked good and toxic.
EDGE_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def profiles(flagged: DataFrame, part: str, filters: list[str]) -> DataFrame:
    """``part, failed, n, good, toxic``: documents by the set of filters that they fail, as a number with a bit per filter.

    ``flagged`` has a boolean per filter, and ``good`` and ``toxic``; null counts as false in all of them. One partial
    aggregation, so that no more than 2^filters rows a part and task are shuffled, however large a part is.
    """
    failed = sum((F.when(F.col(name), F.lit(1 << i)).otherwise(F.lit(0)) for i, name in enumerate(filters)), F.lit(0))
    some = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return flagged.groupBy(F.col(part).alias("part"), failed.alias("failed")).agg(F.count(F.lit(1)).alias("n"), some("good").alias("good"), some("toxic").alias("toxic"))


def edges(profile: DataFrame, filters: list[str]) -> DataFrame:
    """``part, applied, next`` and the counts of ``EDGE_COUNTS`` for each edge: a set of filters already applied and one to come next.

    Each profile contributes, weighted by its documents, to every one of the n 2^(n-1) edges, 80 for five filters, so a part has all of them.
    ``weight`` is the number of orders that pass an edge: those of the filters before it times those of the filters after it.
    """
    n = len(filters)
    known = [(s, i, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in range(1 << n) for i in range(n) if not s >> i & 1]
    lattice = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(i).alias("next"), F.lit(1 << i).alias("own"), F.lit(w).cast("long").alias("weight")) for s, i, w in known])
    each = profile.withColumn("e", F.explode(lattice)).select("part", "failed", "n", "good", "toxic", "e.*")
    fails, before = F.col("failed").bitwiseAND(F.col("own")) != 0, F.col("failed").bitwiseAND(F.col("applied")) != 0
    total = lambda column, when: F.sum(F.when(when, F.col(column)).otherwise(F.lit(0)))
    counts = [
        total("n", ~fails & ~before),
        total("n", fails & ~before),
        total("n", fails & before),
        total("n", F.col("failed") == F.col("own")),
        total("good", fails & ~before),
        total("toxic", fails & ~before),
    ]
    return each.groupBy("part", "applied", "next", "weight").agg(*[c.alias(name) for c, name in zip(counts, EDGE_COUNTS, strict=True)])


def audit(flagged: DataFrame, part: str, filters: list[str]) -> DataFrame:
    """One row per part, order of the filters and step: the counts of ``EDGE_COUNTS`` there, and the step's filter's ``shapley``.

    ``shapley`` is what the filter removes summed over all orders. Every part of ``flagged`` has all orders, zeros included; a null part
    is a part of its own; an empty table has no rows. The number of rows grows with the factorial of the number of filters, not with the documents: each
    step is an edge of the lattice, and the edges are joined to the steps, whose table is that of the filters' orders and is broadcast.
    """
    lattice = cut(edges(profiles(flagged, part, filters), filters))
    value = lattice.groupBy("part", "next").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    steps = []
    for order in permutations(range(len(filters))):
        applied = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(filters[k] for k in order), step, applied, i))
            applied |= 1 << i
    paths = flagged.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, next int")
    # Null-safe, so that a null part keeps its rows.
    valued = lattice.alias("l").join(value.alias("v"), F.col("l.part").eqNullSafe(F.col("v.part")) & (F.col("l.next") == F.col("v.next"))).select("l.*", "v.shapley")
    return valued.join(F.broadcast(paths), ["applied", "next"]).select("part", "filter_order", "step", *EDGE_COUNTS, "shapley")


def _seen_before(texts: DataFrame) -> DataFrame:
    """``doc_id, digest, first``: the smallest id of each text, a row for each text that has an id."""
    return texts.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.lit(True).alias("first"))


def text_filters(docs: DataFrame) -> DataFrame:
    """``doc_id, part, A, B, C, D, digest``: the failures that a text shows by itself, and its SHA-256. Null texts count as empty, null languages too."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    plain = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("t"), words.alias("w"))
    shouted: Column = F.regexp_count("t", F.lit("[A-Z]"))
    return plain.select(
        "doc_id",
        "part",
        (F.size("w") < 200).alias("A"),
        (100 * F.size(F.array_distinct("w")).cast("long") < 50 * F.size("w").cast("long")).alias("B"),
        (100 * shouted.cast("long") > 3 * F.length("t").cast("long")).alias("C"),
        F.col("t").rlike(r"[#$%&*|]").alias("D"),
        F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"),
    )


def flagged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, A, B, C, D, E, good, toxic`` of every row of ``docs``.

    E: a smaller id has the same text, anywhere in the table. Texts are told apart by SHA-256, and the smallest id of each text is found by a
    partial aggregate; whether a row has that id is a join by id, so that a large group of copies is no hot key. A null id neither
    has a smaller one nor is one. Rows that repeat the smallest id with its text all pass. A document is good or toxic if any row of
    ``labels`` with its id says so. Other columns of ``docs`` are ignored.
    """
    texts = cut(text_filters(docs))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("x"))
    found = texts.join(marks, "doc_id", "left").join(_seen_before(texts), ["doc_id", "digest"], "left")
    again = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return found.select("part", "A", "B", "C", "D", again.alias("E"), (F.col("q") == 1).alias("good"), (F.col("x") == 1).alias("toxic"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of five filters over ``documents``, by language."""
    return audit(flagged_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "part", list("ABCDE"))


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
      coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND toxic = 1) AS toxic
  FROM t
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails
), i AS (SELECT unnest(range(1, 6)) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
  SELECT list_aggregate(list_transform(o, lambda k: 'ABCDE'[k]), 'string_agg', '') AS filter_order, i::INT AS step, o[i] AS own, o[1:i - 1] AS earlier FROM o, i
), c AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS mine, list_bool_or(list_transform(earlier, lambda k: fails[k])) AS before, len(list_filter(fails, lambda x: x)) = 1 AS alone FROM g, s
), r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT mine AND before IS NOT TRUE), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mine AND before IS NOT TRUE), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mine AND before), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mine AND alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mine AND before IS NOT TRUE), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mine AND before IS NOT TRUE), 0)::BIGINT AS toxic_lost
  FROM c GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
