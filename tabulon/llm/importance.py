"""Importance resampling towards a target: hashed word runs, log-ratio weights per distinct text, and seeded Gumbel noise per document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.text import lower_ascii, table
from tabulon.operators import order
from tabulon.session import cut, ship_code

#: Groups of copies with more than this share of all rows get their weight by broadcast: at most so many groups can be as large.
HOT_GROUPS = 1000

#: 2^32, the number of values of the hash that the noise comes from.
HASHES = 4294967296


def feature_buckets(text: Column, buckets: int, longest: int = 1) -> Column:
    """The bucket of every run of 1 to ``longest`` consecutive words, repeats included: the CRC-32 of its UTF-8 bytes modulo ``buckets``.

    Words are runs of ASCII letters and digits and characters beyond ASCII, A-Z lower-cased; a null text has none.
    """
    words = F.array_remove(F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    if longest > 1:
        # Within a lambda of one element, so that the words are worked out once and not for every run.
        words = F.get(F.transform(F.array(words), lambda w: F.concat(w, *[_runs(w, n) for n in range(2, longest + 1)])), F.lit(0))
    return F.transform(words, lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int"))


def _runs(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(words, i - 1 + k) for k in range(n)]))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def distinct_texts(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """``digest, copies, buckets``: each distinct text once, null as empty, with the number of its rows and its features.

    Rows are grouped by their full text; copies collapse before the shuffle, so a large group of them is no hot key. Only the features go on.
    """
    groups = texts.groupBy(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    return cut(groups.select(_digest(F.col("text")).alias("digest"), "copies", feature_buckets(F.col("text"), buckets, longest).alias("buckets")))


def bucket_counts(groups: DataFrame, out: str) -> DataFrame:
    """``bucket, out``: the features of all rows by bucket, those of a text multiplied by its copies."""
    return groups.select(F.explode("buckets").alias("bucket"), "copies").groupBy("bucket").agg(F.sum("copies").alias(out))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """What a feature of each bucket adds to a document: 1000 times the log ratio of its smoothed shares in target and source, rounded down.

    The driver gets one number a bucket, whatever the texts.
    """
    both = source.join(target, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).toArrow()
    counts = np.zeros((2, buckets))
    counts[:, both.column("bucket").to_numpy()] = both.column("s").to_numpy(), both.column("t").to_numpy()
    s, t = counts
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def text_weights(groups: DataFrame, gains: np.ndarray) -> DataFrame:
    """``digest, copies, n_features, weight`` of each distinct text: the mean of its features' gains, rounded down; 0 without features."""
    spark = groups.sparkSession
    ship_code(spark)
    held = spark.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            ends = np.concatenate([[0], np.cumsum(held.value[lists.flatten().to_numpy()])])
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            sums = ends[at[1:]] - ends[at[:-1]]
            yield pa.record_batch([batch.column("digest"), batch.column("copies"), pa.array(sizes), pa.array(np.where(sizes > 0, sums // np.maximum(sizes, 1), 0))], names=["digest", "copies", "n_features", "weight"])

    return groups.mapInArrow(run, "digest binary, copies long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand times a standard Gumbel number, rounded down, from the SHA-256 of seed and id; a null id counts as an empty string."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / HASHES)))


def with_weights(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """``doc_id, n_features, weight`` of every row, from its text's.

    Rows of the few texts that many rows share meet their weight by broadcast, at most ``HOT_GROUPS`` of them being possible; the others are
    joined by digest, of which no task can then get many equal ones.
    """
    rows = cut(docs.select("doc_id", _digest(F.col("text")).alias("digest")))
    most = max(1, rows.count() // HOT_GROUPS)
    hot = F.broadcast(weights.filter(F.col("copies") > most))
    often = rows.join(hot, "digest")
    seldom = rows.join(hot.select("digest"), "digest", "left_anti").join(weights.filter(F.col("copies") <= most), "digest")
    return often.unionByName(seldom).select("doc_id", "n_features", "weight")


def drawn(scored: DataFrame, percent: int, least_features: int) -> DataFrame:
    """``scored`` with ``rank``, from 1, of the ``percent`` of its rows with enough features that score highest; null for all other rows.

    Ties go to the smaller id, then null ids. Rows are counted by score first; scores are integers of some ten thousands at most, so the
    counts may be broadcast, and only rows of scores that are drawn from are shuffled, to be ordered within their score.
    """
    enough = F.col("n_features") >= least_features
    counts = scored.filter(enough).groupBy("score").agg(F.count(F.lit(1)).alias("__n")).withColumn("__down", -F.col("score"))
    above = order.running(counts, [], ["__down"], "__above", F.col("__n"))
    take = scored.filter(enough).count() * percent // 100
    from_scores = F.broadcast(above.filter(F.col("__above") < take).select("score", "__above"))
    marked = scored.join(from_scores, "score", "left")
    inside = marked.filter(enough & F.col("__above").isNotNull())
    place = F.col("__above") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    ranked = inside.withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    rest = marked.filter(~(enough & F.col("__above").isNotNull())).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, longest: int = 1, least_features: int = 20, seed: int = 2024) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; rows with a rank are the sample, drawn without replacement.

    ``target`` has ``text``. Copies of a text are grouped by the full text and weighted once, the counts being multiplied by their number; noise is
    each document's own. Null and empty texts have no features and weight 0. Rows that repeat an id with a text are alike in all but rank. Other columns are
    ignored. Empty documents give no rows; an empty target leaves the weights to the smoothing.
    """
    groups = distinct_texts(docs, buckets, longest)
    gains = bucket_gains(bucket_counts(groups, "s"), bucket_counts(distinct_texts(target, buckets, longest), "t"), buckets)
    weighted = with_weights(docs, cut(text_weights(groups, gains)))
    return drawn(cut(weighted.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))), percent, least_features)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its weight towards ``benchmark`` and its rank in the sample."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# CRC-32 bit by bit, of each distinct word.
OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), dw AS (SELECT doc_id, unnest(words) AS w FROM d
), bw AS (SELECT unnest(words) AS w FROM b
), v AS (
  SELECT w, list_transform(range(1, length(hex(encode(w))), 2), lambda i: ('0x' || substr(hex(encode(w)), i, 2))::BIGINT) AS octets FROM (SELECT w FROM dw UNION SELECT w FROM bw)
), k AS (
  SELECT w, xor(4294967295, list_reduce(octets, lambda c, o: list_reduce(range(0, 8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, o)), 4294967295::BIGINT)) % 10000 AS bucket FROM v
), s AS (SELECT bucket, count(*) AS s FROM dw JOIN k USING (w) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS t FROM bw JOIN k USING (w) GROUP BY bucket
), g AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (SELECT count(*) + 10000 FROM dw)) / ((s + 1)::DOUBLE * (SELECT count(*) + 10000 FROM bw))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)
), m AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id
), n AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN m USING (doc_id)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM n
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM n WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM r
"""
