"""Exact deduplication against a persistent digest index, in DataFrame operations only."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.text import lower_ascii, table
from tabulon.session import cut, shared_dir
from tabulon.session import remove as remove_folder


#: Lets a scan of a bucketed table tell its order where each bucket is one file; it holds while a batch is planned.
_STORED_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"

#: Digests that one bucket is meant for, about 200 MB of an index.
BUCKET_ROWS = 4_000_000


@contextmanager
def _stored_order(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_STORED_ORDER)
    spark.conf.set(_STORED_ORDER, "true")
    try:
        yield
    finally:
        spark.conf.set(_STORED_ORDER, before)


class DigestIndex:
    """What is known of every distinct text ever added, as a Parquet table bucketed and sorted by digest.

    The table only grows, by a segment a batch, in which a bucket is one file. A digest's first row is its entry, ``entry`` being true; each later batch that has
    copies of the text adds one more row with their largest id and their number, so ``current`` always tells the largest id and the size of a group.
    ``location`` is a folder that driver and executors share. Opening an index that exists there continues it, in any
    later session. ``buckets`` is fixed when the folder is first written: choose it so that one bucket of digests
    (about 50 bytes a row) sorts in one task. A batch is joined with each segment, so an index of many is worth compacting (``compact``).
    """

    SCHEMA = "digest binary, keep_id bigint, group_size bigint, entry boolean, segment int"

    def __init__(self, spark: SparkSession, location: str, buckets: int):
        self.spark, self.location, self.buckets = spark, location, buckets
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, location).hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(location)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.SCHEMA}) USING parquet PARTITIONED BY (segment) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'")
        spark.catalog.recoverPartitions(self.name)

    def rows(self) -> DataFrame:
        """The table with its bucketing known to the planner: joins and groups by digest need no exchange of it."""
        return self.spark.table(self.name).drop("segment")

    def segments(self) -> list[int]:
        """The segments' numbers, from the names of their folders."""
        return sorted(int(r[0].removeprefix("segment=")) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())

    def current(self) -> DataFrame:
        """``digest, keep_id, group_size`` of every distinct text."""
        return self.rows().groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def unknown(self, batch: DataFrame) -> DataFrame:
        """The rows of ``batch`` whose digest the index lacks, by one sort-merge anti-join a segment.

        A segment is read in its buckets and in its stored order, so its side has neither exchange nor sort; the batch is dealt and sorted once for
        all of them. Plan it within ``_stored_order``.
        """
        for number in self.segments():
            known = self.spark.table(self.name).filter((F.col("segment") == number) & F.col("entry")).select("digest")
            batch = batch.join(known.hint("merge"), "digest", "left_anti")
        return batch

    def add(self, digests: DataFrame) -> DataFrame:
        """Appends a batch of ``doc_id, digest`` and returns the entries made: the digests that the index lacked.

        Copies within the batch collapse before the shuffle (partial aggregation), the largest ``doc_id`` standing for
        them. The collapsed batch is cut off, since the optimizer would otherwise move the anti-joins, whose key is the grouping key, below the
        aggregation and shuffle every copy. A batch is appended by one commit, so a lost executor leaves no part of it.
        """
        batch = cut(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
        with _stored_order(self.spark):
            new = cut(self.unknown(batch).withColumn("entry", F.lit(True)))
        more = batch.join(new.select("digest"), "digest", "left_anti").withColumn("entry", F.lit(False))
        self._append(new.unionByName(more), max(self.segments(), default=-1) + 1)
        return new.drop("entry")

    def _append(self, rows: DataFrame, number: int) -> None:
        """One segment. Rows are dealt as buckets are, so that each bucket is written by one task into one file."""
        out = rows.repartition(self.buckets, "digest").withColumn("segment", F.lit(number))
        out.write.mode("append").format("parquet").option("path", self.location).partitionBy("segment").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compact(self, location: str, buckets: int | None = None) -> DigestIndex:
        """A new index at ``location`` with one row a digest, in one segment. This one stays as it is, so that nothing is lost if the job is; close it after."""
        out = DigestIndex(self.spark, location, buckets or self.buckets)
        if out.segments():
            raise ValueError("there is an index at that place")
        out._append(self.current().withColumn("entry", F.lit(True)), 0)
        return out

    def close(self, remove: bool = False) -> None:
        """Forgets the table's name; the folder stays for the next time unless ``remove`` asks for its end."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if remove:
            remove_folder(self.spark, self.location)


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(lower_ascii(text).cast("binary"), 256))


def _text_key(text: Column) -> Column:
    """Tells texts apart that are equal but for case."""
    return F.xxhash64(text.cast("string"))


def exact_groups(docs: DataFrame, location: str | None = None, buckets: int | None = None, batches: int = 4) -> DataFrame:
    """``doc_id, text_key, digest, keep_id, group_size`` for every row of ``docs``, through a digest index at ``location``.

    The rows enter the index in ``batches`` batches dealt by a hash of the id, each deduplicated against what the batches
    before it, and earlier calls with the same location, have left there. Without a location a new index is begun in the
    shared checkpoint folder and removed at the end. Texts never travel: only id and digest are shuffled. Null text equals
    empty text. Rows that repeat a ``doc_id`` with the same text count each and are kept alike. A null ``doc_id`` loses to
    any other; a group of nothing else has a null ``keep_id``. Other columns of ``docs`` are ignored. An empty table gives an empty
    result. A new index has as many buckets as shuffles have partitions, more beyond ``BUCKET_ROWS`` rows each. ``keep_id`` and ``group_size`` cover all that the index has seen, so with a continued index the row that stays
    may be one of an earlier call.
    """
    spark = docs.sparkSession
    digests = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_key(F.col("text")).alias("text_key"), digest(F.col("text")).alias("digest")))
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-digests.count() // BUCKET_ROWS))
    index = DigestIndex(spark, location or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}", buckets)
    for number in range(batches):
        index.add(digests.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == number))
    current = cut(index.current())
    index.close(remove=location is None)
    return digests.join(current, "digest")


def drop_exact_copies(docs: DataFrame, **index) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows that repeat the winning ``doc_id`` as well as its text collapse into one; if their texts differ in case, the one
    with the smallest text key stays. Nulls, empty texts and empty tables as in ``exact_groups``. Column names that start with
    two underscores are reserved.
    """
    groups = cut(exact_groups(docs, **index))
    winner = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    stays = groups.filter(winner).groupBy("digest").agg(F.min("text_key").alias("stays"), F.count(F.lit(1)).alias("n"))
    twins = cut(stays.filter("n > 1"))
    lost, several = groups.filter(~winner), not twins.isEmpty()
    if several:
        lost = lost.unionByName(groups.filter(winner).join(twins, "digest").filter("text_key <> stays").select(*groups.columns))
    keyed = docs.withColumn("__k", _text_key(F.col("text")))

    def same(rows: DataFrame) -> tuple[DataFrame, Column]:
        named = rows.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
        return named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__k") == F.col("__key"))

    left = keyed.join(*same(lost), "left_anti")
    if several:
        again = groups.filter(winner).join(twins, "digest")
        left = left.join(*same(again), "left_anti").unionByName(left.join(*same(again), "left_semi").dropDuplicates(["doc_id", "__k"]))
    return left.select(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stands for its text."""
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""
