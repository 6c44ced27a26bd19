"""Substring deduplication by hashing lines, and passages within lines, over the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.text import table
from tabulon.session import cut, ship_code

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _slide(values: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over every ``width`` consecutive values, by doubling. ``join(left, right, size of right)``."""
    out, size = values, 1
    done, have = None, 0
    while True:
        if width & size:
            if done is None:
                done, have = out, size
            else:  # the longer block first, then what is done
                n = len(values) - have - size + 1
                done, have = join(out[:n], done[size : size + n], have), have + size
        if have == width:
            return done
        n = len(out) - size
        if n <= 0:
            return values[:0]
        out, size = join(out[:n], out[size:], size), 2 * size


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_ODD), n, 1 << 64))


def anchors(words: np.ndarray, last: np.ndarray, passage: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of the winnowed runs of ``span`` words.

    ``words`` are word hashes of many texts in a row, ``last`` the number of the last word of each word's own text. Of
    every ``passage`` consecutive words, the run of ``span`` words with the smallest hash is chosen, so two texts that
    share so many words share a chosen run. Windows over either end of a text hold what of it there is; runs over its end are never chosen.
    """
    if len(words) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    run = _slide(words, span, lambda a, b, n: a * _power(n) + b)
    run = (run ^ (run >> np.uint64(32))) * _ODD
    run ^= run >> np.uint64(29)
    inside = np.arange(len(run)) + span - 1 <= last[: len(run)]
    run = np.where(inside, run, np.uint64(2**64 - 1))
    width = passage - span + 1
    beyond = np.full(width - 1, np.uint64(2**64 - 1))
    least = _slide(np.r_[beyond, run, beyond], width, lambda a, b, n: np.minimum(a, b))  # over the window that ends at each place
    greatest = _slide(least, width, lambda a, b, n: np.maximum(a, b))  # of the windows that a place lies in
    at = np.flatnonzero(inside & (greatest == run))
    return run[at], at


#: Bytes of text taken apart at once; one longer text is taken by itself.
_PART = 2 << 20


def text_key(text: F.Column) -> F.Column:
    """Tells the texts of rows with the same ``doc_id`` apart."""
    return F.xxhash64(text.cast("string"))


def units(docs: DataFrame, passage: int, span: int, line_words: int) -> DataFrame:
    """``digest, doc_id, text_key, start, end, line``: hashed units of every text with their places, counted in characters.

    A line of at least ``line_words`` words is a unit, its words lower-cased (A-Z) and joined by single spaces; its place
    takes in the line break. The anchors of passages are the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            size = np.cumsum(pc.binary_length(texts).to_numpy()) // _PART
            for a, n in zip(*(x.tolist() for x in _runs(size)), strict=True):
                ids, keys = (batch.column(k).slice(a, n).to_numpy(zero_copy_only=False) for k in (0, 1))
                yield _units(ids, keys, texts.slice(a, n).to_pylist(), passage, span, line_words)

    ship_code(docs.sparkSession)
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "digest bigint, doc_id bigint, text_key bigint, start int, end int, line boolean")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(keys)])


def _units(ids: np.ndarray, keys: np.ndarray, texts: list[bytes], passage: int, span: int, line_words: int) -> pa.RecordBatch:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1  # where the separator after each text is
    begins = np.r_[0, ends[:-1] + 1]
    blank = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, blank, True]))
    first, stop = edge[::2], edge[1::2]  # bytes of each word
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that each byte belongs to
    words = (b"\n".join(texts)).translate(_LOWER).split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    text_of = np.searchsorted(ends, first)
    last = np.searchsorted(first, ends)[text_of] - 1 if len(first) else np.zeros(0, np.int64)
    digest, at = anchors(hashes, last, passage, span)
    base = char[begins]
    owner = text_of[at]
    columns = [(digest.view(np.int64), owner, char[first[at]] - base[owner], char[stop[at + span - 1] - 1] + 1 - base[owner], np.zeros(len(at), bool))]
    breaks = np.flatnonzero(raw == 10)  # the end of every line, ends of texts among them
    lo, hi = np.searchsorted(first, np.r_[0, breaks[:-1] + 1]), np.searchsorted(first, breaks)
    long = np.flatnonzero(hi - lo >= line_words)
    owner = np.searchsorted(ends, breaks[long])
    line = np.array([xxhash.xxh3_64_intdigest(b" ".join(words[a:b]), 1) for a, b in zip(lo[long], hi[long], strict=True)], np.uint64)
    line_start = np.r_[0, breaks[:-1] + 1][long]
    line_end = np.minimum(breaks[long] + 1, ends[owner])  # the separator after a text is not the text's own
    columns.append((line.view(np.int64), owner, char[line_start] - base[owner], np.where(line_end == ends[owner], char[ends[owner]], char[np.minimum(line_end, len(char) - 1)]) - base[owner], np.ones(len(long), bool)))
    digest, owner, start, end, is_line = (np.concatenate(c) for c in zip(*columns, strict=True))
    return pa.record_batch([pa.array(digest, pa.int64()), pa.array(ids[owner].astype(np.int64)), pa.array(keys[owner].astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(is_line)], names=["digest", "doc_id", "text_key", "start", "end", "line"])


def repeated_spans(docs: DataFrame, passage: int = 50, span: int = 36, line_words: int = 5) -> DataFrame:
    """``doc_id, text_key, start, end, first_doc_id``: disjoint stretches of text that an earlier document, or an earlier line, holds.

    Offsets count characters of the original text, ``end`` exclusive. Occurrences rank by ``doc_id``, then text key, then place.
    A line of ``line_words`` words or more goes wherever it is not the earliest. Passages need not begin or end with a line:
    every run of ``passage`` words that an earlier document has too loses at least one stretch of ``span`` words, and at
    most passage - span words stay at either end; no shared run under ``span`` words is touched but for whole lines.
    Within one document passages are left alone. ``first_doc_id`` is the smallest document that holds a part.

    Digests are 64-bit, counted per digest before the shuffle; a digest that very many documents share is joined back by
    a plain sort-merge join that adaptive execution may split. Null texts and null ids have no units. Rows that repeat a
    ``doc_id`` with another text are documents of their own, told apart by ``text_key``; rows that repeat both are one
    document, so what each of them has stays in all. Other columns are ignored; an empty table has no spans.
    """
    found = cut(units(docs, passage, span, line_words))
    place = F.struct("doc_id", "text_key", "start")
    ranked = found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    shared = cut(ranked.filter("first <> last").select("digest", "first"))
    here = F.struct("doc_id", "text_key")
    there = F.struct(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"))
    later = found.join(shared, "digest").filter((here > there) | (F.col("line") & (here == there) & (F.col("start") > F.col("first.start"))))
    order = Window.partitionBy("doc_id", "text_key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = later.select("doc_id", "text_key", "start", "end", F.col("first.doc_id").alias("first_doc_id")).withColumn("reach", reach).withColumn("island", island)
    return spans.groupBy("doc_id", "text_key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id")).drop("island")


@F.arrow_udf(T.StringType())
def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Each text without the characters of its spans, an ascending list of starts and ends in turn; null where there are none."""
    out = []
    for text, at in zip(texts, spans, strict=True):
        text, at = text.as_py(), at.as_py()
        out.append(None if text is None or at is None else "".join([text[a:b] for a, b in zip([0, *at[1::2]], [*at[::2], len(text)], strict=True)]))
    return pa.array(out, pa.string())


def drop_repeats(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` with repeated stretches cut out of ``text``; all rows and columns stay, ``n_chars`` following where it exists.

    A text that is one repeat from end to end becomes empty. Rows without repeats keep their text as it was, and a row loses
    only what was found in its own text, whatever other texts have its ``doc_id``. Columns may have any names but
    ``__id``, ``__key`` and ``__spans``. An empty table stays empty.
    """
    ship_code(docs.sparkSession)
    ordered = F.array_sort(F.collect_list(F.struct("start", "end")))
    spans = repeated_spans(docs, **options).groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.flatten(F.transform(ordered, lambda s: F.array(s["start"], s["end"]))).alias("__spans"))
    joined = docs.join(spans, (F.col("doc_id") == F.col("__id")) & (text_key(F.col("text")) == F.col("__key")), "left")
    some = F.col("__spans").isNotNull()
    changed = joined.withColumn("text", F.when(some, without(F.when(some, F.col("text")), F.col("__spans"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of ``documents`` that repeats an earlier one, with its text's key, its place and the first document that has it."""
    return repeated_spans(table(spark, sf_dir, "documents"))
