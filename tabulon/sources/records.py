"""Record files: JSON lines with a status for every line, text and Parquet scans, and the sinks."""

from __future__ import annotations

import contextlib
import json
import os
import select
import signal
import subprocess
import tempfile
import time
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.code import suffix
from tabulon.session import ship_code, spread

RECORD = T.StructType([T.StructField(name, T.LongType() if name == "idx" else T.StringType()) for name in ("idx", "hash", "target", "model", "language", "split", "source", "code", "graphml")])
REQUIRED = ("target", "model", "language", "source", "hash", "split", "code")


def resolve(spark: SparkSession, root: str, name: str) -> str:
    """``root/raw/name`` if Spark's file system has it, else ``root/name``, else an error."""
    for path in (f"{root}/raw/{name}", f"{root}/{name}"):
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            return path
    raise FileNotFoundError(f"{name} is in neither {root}/raw nor {root}")


def read_lines(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """``line_no, line``: the place of a line (file, start of the split in it, number in the split), which orders all lines, and its text."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(place.alias("line_no"), F.col("value").alias("line"))
    return lines.orderBy("line_no").limit(first) if first is not None else lines


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def peek(df: DataFrame, n: int, order: str) -> DataFrame:
    """The n-th row (from 0) in the given order."""
    return df.orderBy(order).limit(n + 1).orderBy(F.desc(order)).limit(1)


def decode_records(lines: DataFrame) -> DataFrame:
    """The fields of each JSON line with ``status``: success, empty, parse_failed or error with the missing fields.

    An absent ``idx`` is -1 and an absent ``graphml`` empty, while a JSON null stays null; a null or blank graph makes a
    record empty. Required fields may be empty strings but not null.
    """
    parsed = lines.withColumn("r", F.from_json("line", RECORD)).withColumn("keys", F.json_object_keys("line"))
    fields = {f.name: F.col(f"r.{f.name}") for f in RECORD}
    fields["idx"] = F.when(F.array_contains("keys", "idx"), fields["idx"]).otherwise(F.lit(-1).cast("bigint"))
    fields["graphml"] = F.when(F.array_contains("keys", "graphml"), fields["graphml"]).otherwise(F.lit(""))
    out = parsed.select("line_no", "keys", *[c.alias(n) for n, c in fields.items()])
    absent = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull())
    status = (
        F.when(F.col("keys").isNull(), F.lit("error: invalid JSON"))
        .when(F.coalesce(F.col("graphml"), F.lit("")) == "", F.lit("empty"))
        .when(F.size(absent) > 0, F.concat(F.lit("error: missing "), F.array_join(absent, ", ")))
        .otherwise(F.lit("success"))
    )
    return out.withColumn("status", status).drop("keys")


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def metadata(records: DataFrame) -> DataFrame:
    return records.select(F.col("idx").alias("dataset_idx"), "target", "model", "language", "source", "hash", "split", "code")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, code, language`` of whole files; Java by suffix, Python otherwise."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("code"))
    return files.withColumn("language", F.when(F.col("path").endswith(".java"), "java").otherwise("python"))


def with_analysis(samples: DataFrame, analyse: Callable[[str, str], str | None], out: str = "graphml") -> DataFrame:
    """``samples`` with the result of an outside analyser of (code, suffix) and a status; a failure is a row, not an end.

    The analyser runs on executors, a partition at a time, and must clean up after itself.
    """
    ship_code(samples.sparkSession)
    rows = samples.withColumn("__suffix", suffix(F.col("language")))
    schema = T.StructType([*samples.schema.fields, T.StructField(out, T.StringType()), T.StructField("status", T.StringType())])

    def run(frames):
        for frame in frames:
            results, states = [], []
            for code, end in zip(frame["code"], frame["__suffix"], strict=True):
                try:
                    results.append(analyse(code, end))
                    states.append("success" if results[-1] else "empty")
                except Exception as problem:  # the analyser is not ours; its failure belongs to this row
                    results.append(None)
                    states.append(f"error: {problem}")
            yield frame.drop(columns="__suffix").assign(**{out: results, "status": states})

    return rows.mapInPandas(run, schema)


def in_temp_folder(analyse: Callable[[str, str, str], str | None]) -> Callable[[str, str], str | None]:
    """An analyser of (code, suffix) from one of (code, suffix, folder): each call has an empty folder, which goes whatever happens."""

    def run(code: str, end: str) -> str | None:
        with tempfile.TemporaryDirectory() as folder:
            return analyse(code, end, folder)

    return run


#: A process that has not ended by then is ended, with all that it has started.
LIMIT_SECONDS = 120.0


#: Rows that a task runs processes for, at most about, and the seconds after which what is done is handed on.
PROCESSES, HAND_ON = 2_000, 1.0


def _end(process: subprocess.Popen, limit: float) -> int | None:
    """The exit status of a process, None if it has not ended after ``limit`` seconds. Where the system can tell of its end, nothing polls for it."""
    try:
        handle = os.pidfd_open(process.pid)
    except (AttributeError, OSError):
        with contextlib.suppress(subprocess.TimeoutExpired):
            return process.wait(limit)
        return None
    try:
        waiter = select.poll()
        waiter.register(handle, select.POLLIN)
        return process.wait() if waiter.poll(limit * 1000) else None
    finally:
        os.close(handle)


def _emptied(folder: str, names: Sequence[str]) -> None:
    """Deletes these files of a folder and, if it held no more, the folder, without listing it. What is left is for those who list it."""
    with contextlib.suppress(OSError):
        for name in names:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(f"{folder}/{name}")
        os.rmdir(folder)


def analyse_by_process(command: Sequence[str], code: str, end: str, limit: float) -> tuple[str | None, str, int | None, int]:
    """What one process of ``command`` makes of a code text: output, status, exit status and bytes of output.

    ``{code}`` in the command stands for the path of a file with the text, ``{out}`` for where the output is to go: a file, or a folder of which the first file by
    name counts. Both are in a folder of their own, which goes whatever happens. The process and its children have a group of their own, so that a hanging one ends whole.
    Of what it says only the end is read, and only if it fails.
    """
    with tempfile.TemporaryDirectory() as folder:
        source, target = f"{folder}/code{end}", f"{folder}/out"
        try:
            with open(source, "wb") as text:
                text.write((code or "").encode())
            words = [w.replace("{code}", source).replace("{out}", target) for w in command]
            with open(f"{folder}/said", "w+b", buffering=0) as said:
                try:
                    process = subprocess.Popen(words, cwd=folder, stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=said, start_new_session=True)
                except OSError as problem:
                    return None, f"error: {problem.strerror}", None, 0
                try:
                    exit_status = _end(process, limit)
                finally:
                    with contextlib.suppress(ProcessLookupError):
                        os.killpg(process.pid, signal.SIGKILL)
                    process.wait()
                last = ""
                if exit_status:
                    said.seek(max(0, said.seek(0, os.SEEK_END) - 200))
                    last = said.read(200).decode(errors="replace").strip()
            found = target
            if os.path.isdir(target):
                found = next((p for p in sorted(Path(target).rglob("*")) if p.is_file()), None)
            size = os.path.getsize(found) if found and os.path.isfile(found) else 0
            if exit_status is None:
                return None, f"error: no end after {limit:g} s", None, size
            if exit_status:
                return None, f"error: exit status {exit_status}{': ' + last if last else ''}", exit_status, size
            if not size:
                return None, "empty", 0, 0
            with open(found, encoding="utf-8", errors="replace") as made:
                return made.read(), "success", 0, size
        finally:
            _emptied(folder, (f"code{end}", "out", "said"))


def with_processes(samples: DataFrame, command: Sequence[str], limit: float = LIMIT_SECONDS, out: str = "graphml") -> DataFrame:
    """``samples`` with ``out``, ``status``, ``exit_status`` and ``out_bytes`` of a process per row, on the executors; see ``analyse_by_process``.

    A process that fails, hangs or writes nothing makes a row that says so and stops no other. A null code counts as empty. Rows that Spark computes again run again.
    """
    ship_code(samples.sparkSession)
    names = [*samples.columns, out, "status", "exit_status", "out_bytes"]
    rows = spread(samples, PROCESSES).withColumn("__suffix", suffix(F.col("language")))
    schema = T.StructType([*samples.schema.fields, T.StructField(out, T.StringType()), T.StructField("status", T.StringType()), T.StructField("exit_status", T.IntegerType()), T.StructField("out_bytes", T.LongType())])
    words, kinds = list(command), [pa.string(), pa.string(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ends, at, made, began = batch.column("code"), batch.column("__suffix"), 0, [], time.monotonic()
            for place in range(batch.num_rows):
                made.append(analyse_by_process(words, texts[place].as_py(), ends[place].as_py(), limit))
                if place + 1 == batch.num_rows or time.monotonic() - began > HAND_ON:  # what is done waits for few that come after it
                    columns = zip(*made, strict=True)
                    yield pa.record_batch([*batch.slice(at, len(made)).columns[:-1], *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], names=names)
                    at, made, began = place + 1, [], time.monotonic()

    return rows.mapInArrow(run, schema)


def write_document(pieces: DataFrame, order: list[str], text: str, path: str) -> None:
    """The ``text`` of all rows, a line each, in the order of ``order``, nulls first: part files at ``path`` that make one document when read one after the other by name.

    Ranges of the order are written by the tasks that sort them. ``_manifest.json`` there lists the parts in order with their bytes; Spark's readers pass it over.
    """
    spark = pieces.sparkSession
    pieces.repartitionByRange(*order).sortWithinPartitions(*order).select(text).write.mode("overwrite").text(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((s.getPath().getName(), s.getLen()) for s in system.listStatus(folder) if s.getPath().getName().startswith("part-"))  # one a task
    out = system.create(hadoop.Path(f"{path}/_manifest.json"), True)
    out.write(bytearray(json.dumps({"parts": [{"name": n, "bytes": b} for n, b in parts]}).encode()))
    out.close()


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header, for result tables of a few rows."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def materialise(df: DataFrame, path: str, by: tuple[str, ...] = ("node_type",), force: bool = False) -> DataFrame:
    """The table at ``path``, written first if it is not there or ``force`` asks for it."""
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return spark.read.parquet(path)


def cached_by_key(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """``cache`` if it has just the keys of ``df``; otherwise an error."""
    if df.count() != cache.count() or not df.select(key).join(cache.select(key), key, "left_anti").isEmpty():
        raise ValueError("the cache does not belong to this table")
    return cache


def attach(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of a cache that has just its keys: what belongs to a row is told by the key, not by the place."""
    return df.join(cached_by_key(df, cache, key), key)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of every file below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
