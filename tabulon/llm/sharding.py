"""Two-pass external shuffle into shards of equal row counts."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.text import table
from tabulon.session import cut, shared_dir, ship_code

#: A bucket costs the driver and every task 8 bytes of offsets. More buckets, 256 TB of them by default, are refused.
MAX_BUCKETS = 1 << 23

#: Tasks of the second pass at most; beyond that a task takes several buckets, one after the other.
MAX_TASKS = 1 << 16


def _size(text: str) -> F.Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("bigint")


def external_shuffle(df: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 32 << 20, location: str | None = None) -> DataFrame:
    """All rows and columns of ``df`` in random order, written to ``location`` as ``shards`` folders, and read back.

    Adds ``shard`` (0 to shards - 1; row counts differ by one at most) and ``slot`` (gapless from 0 within a shard).
    Columns of ``df`` with these names must be renamed first; names that start with two underscores are reserved.

    First pass: a seeded hash of the id and the text's checksum scatters the rows uniformly into buckets of about
    ``bucket_bytes`` of text, however large the corpus. Second pass: each bucket, sorted by id so that its order does not
    depend on how blocks arrive, is put through a Fisher-Yates shuffle seeded by its number, and its rows go to their places.
    A bucket begins where the counts of those before it end; only these counts leave the executors (``MAX_BUCKETS``).
    A rerun gives the same places. Copies of a text differ in their ids and so scatter; only rows equal in id and text
    fall into one bucket. Null texts count one byte, null ids scatter by their text. An empty table gives no rows.
    """
    taken = {"shard", "slot"} & set(df.columns)
    if taken:
        raise ValueError(f"rename the columns {sorted(taken)} first")
    spark = df.sparkSession
    ship_code(spark)
    check = F.crc32(F.col(text_col).cast("binary"))
    draw = F.xxhash64(F.lit(seed), F.col(id_col), check)
    drawn = cut(df.select(draw.alias("draw"), _size(text_col).alias("size")))  # so that texts are read twice, not three times
    total = drawn.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    if buckets > MAX_BUCKETS:
        raise ValueError(f"{buckets} buckets are too many; raise bucket_bytes")
    counted = drawn.groupBy(F.pmod("draw", F.lit(buckets)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(buckets, np.int64)
    counts[counted.column("b").to_numpy()] = counted.column("n").to_numpy()
    rows = int(counts.sum())
    offsets = spark.sparkContext.broadcast(np.concatenate([[0], np.cumsum(counts)[:-1]]))
    shard_start = np.array([rows * i // shards for i in range(shards + 1)])

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _buckets(batches):
            held = held.take(pa.array(np.random.default_rng([seed, number]).permutation(len(held))))
            place = offsets.value[number] + np.arange(len(held))
            shard = np.searchsorted(shard_start, place, side="right") - 1
            slot = place - shard_start[shard]
            held = held.drop_columns(["__bucket"]).append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot))
            yield from held.to_batches(max_chunksize=1000)

    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    tasks = min(buckets, MAX_TASKS)
    placed = df.withColumn("__bucket", F.pmod(draw, F.lit(buckets)).cast("int"))
    scattered = placed.repartitionById(tasks, F.floor(F.col("__bucket").cast("long") * tasks / buckets).cast("int")).sortWithinPartitions("__bucket", id_col, check)
    location = location or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    scattered.mapInArrow(permute, schema).write.partitionBy("shard").mode("overwrite").parquet(location)
    return spark.read.schema(schema).parquet(location)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows of equal bucket as one table; one bucket is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("__bucket").to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if held and held[0].column("__bucket")[0].as_py() != keys[a]:
                yield held[0].column("__bucket")[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column("__bucket")[0].as_py(), pa.Table.from_batches(held)


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its shard and its place there, read from the written shards."""
    placed = external_shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    return placed.select(
        "doc_id",
        _size("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
