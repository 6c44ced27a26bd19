"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.components import connected_components, smallest
from tabulon.llm.text import table
from tabulon.session import cut, ship_code

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Groups of up to this many comparisons are compared in one vectorised pass; larger ones by search from row to row.
_PAIRWISE = 1 << 18

#: Comparisons made at once.
_BLOCK = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text: a bit is one if it is one in over half of the shingles' XXH64 values.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space; shingles count as often as they occur. A
    text of fewer words has one shingle, its whole word sequence; a null text or one without words has fingerprint 0.
    """
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(x, seed) for x in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, dtype=">u8")
    for i in range(0, len(values), 65536):  # bounds the unpacked bits of a very long text at 4 MB
        part = values[i : i + 65536]
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    ship_code(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def segment_plan(distance: int, segments: int) -> list[tuple[int, int, int]]:
    """``(shift, width, radius)`` of each segment of the 64 bits.

    With distance = segments * r + a, two values that differ in at most ``distance`` bits differ in at most r bits of one
    of the first a + 1 segments, or in at most r - 1 bits of one of the others. A segment of radius -1 is not searched.
    """
    r, a = divmod(distance, segments)
    edges = [64 * i // segments for i in range(segments + 1)]
    plan = [(edges[i], edges[i + 1] - edges[i], r if i <= a else r - 1) for i in range(segments)]
    return [x for x in plan if x[2] >= 0]


def _balls(fp: np.ndarray, shift: int, width: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and segment values of each fingerprint's own entry and of its probes within ``radius`` flips.

    Of two values at a given difference each is a flip of the other, so a probe goes out from one of them only: the one
    whose lowest differing bit is zero.
    """
    value = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    yield np.arange(len(fp)), value
    for flips in range(1, radius + 1):
        for bits in combinations(range(width), flips):
            rows = np.flatnonzero((value >> np.uint64(bits[0])) & np.uint64(1) == 0)
            yield rows, value[rows] ^ np.uint64(sum(1 << b for b in bits))


def _links(fp: np.ndarray, own: np.ndarray, starts: np.ndarray, sizes: np.ndarray, distance: int, place: np.ndarray | None = None, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of linked rows of the same group, at least one of the two the bucket's ``own``; a row and the one it hangs on.

    Rows link if their fingerprints are within ``distance`` and, where given, their ``place`` within ``slack``.

    Own rows come first in a group. Probes are not compared with each other: two of them meet elsewhere. Of all links
    within a group only a spanning forest leaves: at most one edge a row.
    """

    def alike(i: np.ndarray | int, j: np.ndarray | int) -> np.ndarray:
        near = np.bitwise_count(fp[i] ^ fp[j]) <= distance
        return near if place is None else near & (np.abs(place[i] - place[j]) <= slack)

    before = np.r_[0, np.cumsum(own)]
    owned = before[starts + sizes] - before[starts]
    work = owned * sizes
    small = (work > 0) & (work <= _PAIRWISE)
    label = np.arange(len(fp))
    if small.any():
        first, size, mine = starts[small], sizes[small], owned[small]
        for d in range(int(mine.max())):
            keep = mine > d
            first, size, mine = first[keep], size[keep], mine[keep]
            rest = size - d - 1
            bounds = np.flatnonzero(np.diff(np.cumsum(rest) // _BLOCK, prepend=-1))
            for lo, hi in zip(bounds, np.r_[bounds[1:], len(rest)], strict=True):
                n = rest[lo:hi]
                i = np.repeat(first[lo:hi] + d, n)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                hit = alike(i, j)
                if hit.any():
                    label = smallest(label, i[hit], j[hit])
    for s, n, o in zip(starts[work > _PAIRWISE], sizes[work > _PAIRWISE], owned[work > _PAIRWISE], strict=True):
        mine, probes = np.arange(s, s + o), np.arange(s + o, s + n)
        while len(mine):
            root, mine, queue = mine[0], mine[1:], [mine[0]]
            while queue:
                at = queue.pop()
                near = alike(mine, at)
                reached, mine = mine[near], mine[~near]
                if at < s + o:
                    near = alike(probes, at)
                    reached, probes = np.r_[reached, probes[near]], probes[~near]
                label[reached] = root
                queue.extend(reached)
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return moved, label[moved]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(keys)])


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        yield [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_groups(prints: DataFrame, distance: int = 4, segments: int = 3, dense_rows: int = 131072) -> DataFrame:
    """``fp, label`` for every linked one of the distinct ``fp`` of ``prints``; fingerprints without a link are left out.

    The label, one fingerprint of the group, is the same for all that links of at most ``distance`` bits connect.

    Every fingerprint is stored once per segment and probes the small Hamming ball of its segment value; rows that meet
    in a bucket are verified on all 64 bits and leave a spanning forest, never all pairs. A bucket of more than
    ``dense_rows`` rows does not enter one task: its rows are dealt into blocks, and each pair of blocks is a group of
    its own, so every two rows still meet. Which buckets are that large is told from a part of the fingerprints; a bucket
    that is misjudged is compared all the same, in a task somewhat larger or smaller.
    """
    plan = segment_plan(distance, segments)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (fp,) in _columns(batches):
            for i in range(0, len(fp), 8192):
                part = fp[i : i + 8192].view(np.uint64)
                rows, keys = [], []
                for k, (shift, width, radius) in enumerate(plan):
                    for n, (row, value) in enumerate(_balls(part, shift, width, radius)):
                        rows.append(row)
                        keys.append((value | np.uint64(k << 57)) << np.uint64(1) | np.uint64(n > 0))
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(part[np.concatenate(rows)].view(np.int64))], names=["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 2
        for columns in _then_none(_columns(batches)):
            if columns is not None:
                held = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            starts, sizes = _runs(held[0] >> 1)
            if not len(starts) or columns is not None and len(starts) < 2:
                continue
            end = len(held[0]) if columns is None else starts[-1]
            done, held = [x[:end] for x in held], [x[end:] for x in held]
            ready = (starts < end) & (sizes > 1)
            i, j = _links(done[1].view(np.uint64), done[0] & 1 == 0, starts[ready], sizes[ready], distance)
            if len(i):
                yield _edges(done[1][i], done[1][j])

    ship_code(prints.sparkSession)
    prints = prints.select("fp")
    rows = prints.mapInArrow(scatter, "key bigint, fp bigint")
    bucket = F.shiftright("key", 1)
    part = 64 if dense_rows >= 1024 else 1
    sample = prints.filter(F.pmod(F.xxhash64("fp"), F.lit(part)) == 0).mapInArrow(scatter, "key bigint, fp bigint")
    dense = cut(sample.groupBy(bucket.alias("bucket")).count().filter(F.col("count") * part > dense_rows))
    if not dense.isEmpty():
        rows = rows.withColumn("bucket", bucket)
        blocks = F.ceil(F.col("count") * part * 2 / dense_rows).cast("int")
        crowd = rows.join(dense.withColumn("blocks", blocks), "bucket").withColumn("x", F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int"))
        crowd = crowd.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = F.shiftleft(F.xxhash64("bucket", F.least("x", "y"), F.greatest("x", "y")), 1)
        crowd = crowd.select(pair.bitwiseOR(F.col("key").bitwiseAND(F.lit(1))).alias("key"), "fp")
        rows = rows.join(dense, "bucket", "left_anti").select("key", "fp").unionByName(crowd)
    edges = rows.repartition(bucket).sortWithinPartitions("key").mapInArrow(meet, "a bigint, b bigint")
    return connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("label"))


def _then_none(items: Iterator) -> Iterator:
    yield from items
    yield None


#: Up to so many fingerprints three segments (21 bits each) cost less than the two of 32 bits that more of them need.
THREE_SEGMENTS = 1 << 28


def simhash_components(docs: DataFrame, shingle: int = 4, distance: int = 4, segments: int | None = None, seed: int = 42) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``; the component is the smallest ``doc_id`` reachable.

    Exact copies share a fingerprint and collapse before anything is compared. Null and empty texts have fingerprint 0 and
    link like any other. Rows that repeat a ``doc_id`` keep a row each. A null ``doc_id`` links like any other and is the
    component of a group only if the group has no other. Other columns of ``docs`` are ignored. ``segments`` follows from the
    number of distinct fingerprints unless it is given; the groups do not depend on it.
    """
    prints = cut(fingerprints(docs, shingle, seed))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    segments = segments or (3 if distinct.count() <= THREE_SEGMENTS else 2)
    labelled = cut(distinct.join(near_groups(distinct, distance, segments), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    smallest = cut(labelled.groupBy("label").agg(F.min("rep").alias("component_id")))
    named = cut(labelled.join(smallest, "label").select("fp", "component_id"))
    return prints.join(named, "fp")


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit of the result depends on all bits given."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """The distinct hashes of the runs of ``shingle`` words, ascending; of fewer words the whole sequence is the only one."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(words))
    run = hashes[: len(hashes) - width + 1].copy()
    for k in range(1, width):
        run = run * _ODD + hashes[k : len(hashes) - width + 1 + k]
    return np.unique(_mix(run + np.uint64(width)))


def wide_fingerprint(shingles: np.ndarray, words: int) -> np.ndarray:
    """``words`` times 64 bits, each bit one if it is one in over half of as many hashes derived from each shingle."""
    ones = np.zeros(64 * words, np.int64)
    salts = np.arange(1, words + 1, dtype=np.uint64) * _ODD
    for i in range(0, len(shingles), 4080):
        bits = np.unpackbits(_mix(shingles[i : i + 4080, None] + salts).view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # so many ones fit a byte
            ones += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)


def table_plan(rows: int, similarity: float, recall: float) -> tuple[int, int]:
    """Bits of a segment and number of segments for searching among ``rows`` texts.

    Segments are wide enough that unrelated texts seldom meet, 20 bits at least. Two texts of the given Jaccard similarity
    differ in any one bit with the probability that belongs to the angle between their sets; so many segments are taken that
    one of them differs in at most one bit with the probability ``recall``.
    """
    width = max(20, max(1, rows).bit_length())
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    near = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    return width, math.ceil(math.log(1 - recall) / math.log(1 - near)) if near < 1 else 1


#: Ratio of set sizes between neighbouring size classes, and the greatest class.
_SIZE_STEP, _SIZE_TOP = 1.03, 511


def _size_class(sizes: np.ndarray) -> np.ndarray:
    return np.minimum(_SIZE_TOP, np.log(np.maximum(sizes, 1)) / math.log(_SIZE_STEP)).astype(np.int64)


def word_prints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """``doc_id, text_digest, node, size, print`` for every row of ``docs``.

    ``node`` is a digest of the lower-cased words, 0 if there are none, ``size`` the number of distinct shingles and ``print``
    the bytes of the fingerprint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64), []
            for k, text in enumerate(batch.column(2).cast(pa.binary())):
                own = _words(text.as_py())
                shingles = shingle_set(own, shingle) if own else np.zeros(0, np.uint64)
                sizes[k] = len(shingles)
                if own:
                    nodes[k] = xxhash.xxh3_64_intdigest(b" ".join(own), 2)
                prints.append(wide_fingerprint(shingles, words).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(nodes.view(np.int64)), pa.array(sizes), pa.array(prints, pa.binary())], names=["doc_id", "text_digest", "node", "size", "print"])

    ship_code(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _digest().alias("text_digest"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_digest bigint, node bigint, size bigint, print binary")


def _digest() -> F.Column:
    return F.xxhash64(F.col("text").cast("string"))


def proposed_links(nodes: DataFrame, width: int, tables: int, distance: int, slack: int, dense_rows: int = 131072) -> DataFrame:
    """``a, b``: links that connect all ``node`` which meet in a segment's table and are alike as far as their prints tell.

    The first 64 bits of ``print`` are held back for verification; behind them come ``tables`` segments of ``width`` bits,
    a table each. Every node is stored once in each table and probes the Hamming ball of radius one around its value.
    Nodes that meet are linked if the complete distance of the bits held back is at most ``distance`` and their size classes are
    at most ``slack`` apart; a spanning forest of these links leaves each bucket, never all pairs. In a bucket of over
    ``dense_rows`` rows, told from a part of the nodes, all are linked to the smallest by a partial aggregation
    instead, so no task holds it; links are verified on the texts afterwards, so more of them do no harm.
    """
    powers, mask = np.int64(1) << np.arange(width, dtype=np.int64), np.int64((1 << 10) - 1)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                node, sizes = (part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "size"))
                raw = np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint8).reshape(len(node), -1)
                check = np.ascontiguousarray(raw[:, :8]).view(np.int64).ravel()
                bits = np.unpackbits(raw[:, 8:], axis=1, bitorder="little")[:, : width * tables].reshape(len(node), tables, width)
                values, group = bits.astype(np.int64) @ powers, _size_class(sizes)
                for t in range(tables):
                    found = list(_balls(values[:, t].view(np.uint64), 0, width, 1))
                    rows = np.concatenate([r for r, _ in found])
                    probe = np.repeat([0, 1], [len(node), len(rows) - len(node)])
                    value = np.concatenate([v for _, v in found]).view(np.int64)
                    keys = (value | t << width) << 10 | probe << 9 | group[rows]
                    yield pa.record_batch([pa.array(keys), pa.array(check[rows]), pa.array(node[rows])], names=["key", "fp", "node"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for columns in _then_none(_columns(batches)):
            if columns is not None:
                held = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            starts, sizes = _runs(held[0] >> 10)
            if not len(starts) or columns is not None and len(starts) < 2:
                continue
            end = len(held[0]) if columns is None else starts[-1]
            (key, fp, node), held = [x[:end] for x in held], [x[end:] for x in held]
            ready = (starts < end) & (sizes > 1)
            i, j = _links(fp.view(np.uint64), key & mask < 512, starts[ready], sizes[ready], distance, key & 511, slack)
            if len(i):
                yield _edges(*np.unique(np.stack([node[i], node[j]]), axis=1))

    ship_code(nodes.sparkSession)
    kind, nodes = "key bigint, fp bigint, node bigint", nodes.select("node", "size", "print")
    rows, bucket = nodes.mapInArrow(scatter, kind), F.shiftright("key", 10)
    part = 64 if dense_rows >= 1024 else 1
    sample = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(part)) == 0).mapInArrow(scatter, kind)
    dense = cut(sample.groupBy(bucket.alias("bucket")).count().filter(F.col("count") * part > dense_rows).select("bucket"))
    crowd = None
    if not dense.isEmpty():
        rows = rows.withColumn("bucket", bucket)
        crowd = cut(rows.join(dense, "bucket", "left_semi").select("bucket", "node"))
        crowd = crowd.join(crowd.groupBy("bucket").agg(F.min("node").alias("b")), "bucket").select(F.col("node").alias("a"), "b")
        rows = rows.join(dense, "bucket", "left_anti").drop("bucket")
    found = rows.repartition(bucket).sortWithinPartitions("key").mapInArrow(meet, "a bigint, b bigint")
    return found if crowd is None else found.unionByName(crowd)


def _alike(sets: list[np.ndarray], label: np.ndarray, asks: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i, j that link the labels of all rows whose sets have a Jaccard similarity of ``similarity`` or more.

    Only rows that ``asks`` marks are compared with the others. Rows whose shingles are the commonest go first: in a group
    around one text that is the text itself, and as soon as all rows are linked the search ends.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    starts = np.cumsum(sizes) - sizes
    label, left, i, j = label.copy(), len(np.unique(label)), [], []
    order = np.argsort(-np.add.reduceat(count[code], starts) / sizes, kind="stable")
    mark = np.zeros(len(count), bool)
    for at in order[asks[order]]:
        if left == 1:
            break
        own = code[starts[at] : starts[at] + sizes[at]]
        mark[own] = True
        common = np.add.reduceat(mark[code], starts, dtype=np.int64)
        mark[own] = False
        near = np.flatnonzero((common >= similarity * (sizes + sizes[at] - common) - 1e-9) & (label != label[at]))
        for other in near:
            if label[other] != label[at]:
                label[label == label[other]] = label[at]
                left -= 1
                i.append(at)
                j.append(other)
    return np.array(i, np.int64), np.array(j, np.int64)


def _compared(rows: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: verified links among the rows ``key, node, label, asks, shingles`` of equal ``key``; one key is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches):
            node, label = (part.column(c).to_numpy() for c in ("node", "label"))
            asks = part.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            i, j = _alike([np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("shingles")], label, asks, similarity)
            if len(i):
                yield _edges(node[i], node[j])

    dealt = rows.select("key", "node", "label", "asks", "shingles").repartition("key").sortWithinPartitions("key", F.desc("asks"))
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each key that has two or more; of rows that repeat a node the first is left."""
    held: list[pa.RecordBatch] = []
    seen: set[int] = set()
    for batch in _then_none(batches):
        key = None if batch is None else batch.column("key").to_numpy()
        starts, sizes = ([0], [0]) if batch is None else (x.tolist() for x in _runs(key))
        for a, n in zip(starts, sizes, strict=True):
            if held and (batch is None or held[0].column("key")[0].as_py() != key[a]):
                if len(seen) > 1:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, seen = [], set()
            if n:
                part = batch.slice(a, n)
                nodes = part.column("node").to_pylist()
                new = [k for k, x in enumerate(nodes) if not (x in seen or seen.add(x))]
                if new:
                    held.append(part if len(new) == n else part.take(pa.array(new)))


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``texts`` with ``shingles``, the bytes of the set of shingle hashes, in place of ``text``."""
    kept = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sets = [shingle_set(_words(t.as_py()), shingle).tobytes() for t in part.column("text").cast(pa.binary())]
                yield pa.record_batch([*(part.column(c) for c in kept), pa.array(sets, pa.binary())], names=[*kept, "shingles"])

    return texts.mapInArrow(run, T.StructType([*texts.select(*kept).schema.fields, T.StructField("shingles", T.BinaryType())]))


def verified_links(docs: DataFrame, members: DataFrame, shingle: int, similarity: float, block: int) -> DataFrame:
    """``a, b``: links of Jaccard similarity ``similarity`` or more that connect all nodes of a cluster which such links connect.

    ``members`` has ``node, doc_id, text_digest, size, cluster``; the text of a node is that of its ``doc_id`` and
    ``text_digest`` in ``docs``. A cluster is dealt into blocks of about ``block`` shingles, or smaller ones if these are
    fewer than 16 so that tasks can share the work, each compared by itself; a small cluster is settled there. In a larger one all nodes but those of its largest group so far are then
    compared with every block; two nodes of the largest group need no comparison, being connected already. So all pairs that could
    matter are compared, and a large group around common texts is not copied once per block.
    """
    blocks = lambda each: F.ceil(F.sum("size") / F.lit(each)).cast("int")
    totals = members.groupBy("cluster").agg(F.greatest(blocks(block), F.least(F.lit(16), blocks(max(1, block >> 3)))).alias("blocks"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _digest().alias("text_digest"), F.col("text").cast("string").alias("text"))
    wanted = members.join(totals, "cluster").withColumnsRenamed({"doc_id": "__id", "text_digest": "__digest"})
    chosen = texts.join(wanted, (F.col("text_digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("node", "cluster", "blocks", "text")
    sets = cut(shingle_sets(chosen, shingle).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    first = sets.select(F.xxhash64("cluster", "block").alias("key"), "node", F.col("node").alias("label"), F.lit(True).alias("asks"), "shingles")
    links = cut(_compared(first, similarity))
    large = sets.filter("blocks > 1").select("node", "cluster", "blocks", "block").distinct()
    if large.isEmpty():
        return links
    labels = connected_components(links).withColumnRenamed("component", "label")
    placed = cut(large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    largest = placed.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max_by("label", "count").alias("largest"))
    placed = cut(placed.join(largest, "cluster").withColumn("asks", F.col("label") != F.col("largest")).drop("largest"))
    sizes = placed.groupBy("cluster").agg(F.ceil(F.count_if("asks") * F.first("blocks") / F.count(F.lit(1))).cast("int").alias("groups"))
    each = placed.join(sizes.filter("groups > 0"), "cluster")
    at = lambda column, count: F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(column)
    met = each.select("node", "label", "cluster", F.lit(False).alias("asks"), at("group", "groups"), "block")
    asking = each.filter("asks").select("node", "label", "cluster", "asks", F.pmod(F.xxhash64("node", F.lit(7)), F.col("groups")).cast("int").alias("group"), at("block", "blocks"))
    rows = met.unionByName(asking).join(sets.select("node", "shingles"), "node").select(F.xxhash64("cluster", "group", "block").alias("key"), "node", "label", "asks", "shingles")
    return links.unionByName(_compared(rows, similarity))


def near_components(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 15, recall: float = 0.95, block: int = 1 << 17, dense_rows: int = 131072) -> DataFrame:
    """``doc_id, text_digest, component_id`` for every row of ``docs``; the component is the smallest ``doc_id`` reachable.

    Texts of the same lower-cased words are one node. Two nodes link if the Jaccard similarity of their sets of shingles is at least
    ``similarity``. Fingerprints only propose: nodes that ``proposed_links`` connects are a cluster, and within clusters the
    sets themselves decide. A pair of just that similarity is proposed with a probability of about ``recall``, a closer
    one almost surely. Texts without words are one component; nulls count as such. A null ``doc_id`` links like any other.
    Other columns of ``docs`` are ignored, an empty table gives no rows.
    """
    width, tables = table_plan(docs.count(), similarity, recall)
    slack = math.ceil(-math.log(similarity) / math.log(_SIZE_STEP)) + 1
    prints = cut(word_prints(docs, shingle, 1 + -(-width * tables // 64)))
    least = F.min(F.struct("doc_id", "text_digest")).alias("at")
    nodes = cut(prints.filter("node <> 0").groupBy("node").agg(F.first("size").alias("size"), F.first("print").alias("print"), least).select("node", "size", "print", "at.*"))
    clusters = connected_components(proposed_links(nodes, width, tables, distance, slack, dense_rows)).withColumnRenamed("component", "cluster")
    members = cut(nodes.drop("print").join(clusters, "node"))
    labels = connected_components(verified_links(docs, members, shingle, similarity, block)).select("node", F.col("component").alias("label"))
    named = cut(prints.join(labels, "node", "left").select("doc_id", "text_digest", F.coalesce("label", "node").alias("label")))
    reached = cut(named.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    return named.join(reached, "label").select("doc_id", "text_digest", "component_id")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the smallest ``doc_id`` of each near-duplicate group; columns as they were.

    Rows that repeat that ``doc_id`` within the group stay; rows whose ``doc_id`` is null stay. A row goes for its own text
    alone: other texts of the same ``doc_id`` do not matter.
    """
    groups = near_components(docs, **options)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__id"), F.col("text_digest").alias("__digest")).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col("__id")) & (_digest() == F.col("__digest")), "left_anti")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its fingerprint and its group."""
    groups = simhash_components(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
