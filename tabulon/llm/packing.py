"""Best-fit packing of token sequences with swap-based local search, on a histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.text import table, text_key
from tabulon.llm.tokens import ByteBPE, default_vocabulary
from tabulon.operators.order import join_null_safe
from tabulon.session import cut, ship_code

#: A pattern is the descending lengths in one bin; a plan says how many bins have each pattern.
Plan = Counter


def fill_by_moves(counts: dict[int, int], capacity: int) -> Plan:
    """The search's first sweep: every item begins in a bin of its own and, longest first, moves into the fullest bin that has room.

    Each move adds to the sum of squared fills and empties a bin. Bins with equal contents move together, so the work depends
    on the number of distinct lengths alone; the result is that of moving the items one by one.
    """
    bins: dict[int, Counter] = {}  # by room left
    rooms: list[int] = []

    def move(room: int, pattern: tuple, number: int, items: int, length: int) -> None:
        if room in bins:
            bins[room][pattern] -= number
            if not bins[room][pattern]:
                del bins[room][pattern]
            if not bins[room]:
                del bins[room]
                rooms.remove(room)
        new = room - items * length
        if new not in bins:
            bins[new] = Counter()
            insort(rooms, new)
        bins[new][pattern + (length,) * items] += number

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            pattern, have = next(iter(bins[room].items())) if at < len(rooms) else ((), left)
            fit = room // length
            number, items = (min(have, left // fit), fit) if left >= fit else (1, left)
            move(room, pattern, number, items, length)
            left -= number * items
    return sum((bins[room] for room in rooms), Counter())


def improve(plan: Plan, capacity: int, steps: Counter | None = None) -> Plan:
    """Swap-based local search between underfull bins; ``steps`` gets the number of each kind of step.

    The emptiest bin gives: an item moves to another bin, is exchanged for a smaller one there, or two items are exchanged
    for one smaller than both together, whichever of all these raises the sum of squared fills most. A bin that has given
    all is gone; a bin that no step leads on from is set aside until the others have been tried. Bins of equal pattern step
    together where they can. The search ends when no step gains, or when the room left in all underfull bins is less than one bin, since
    then none can be emptied. Every step adds to a bounded sum, so it does end.
    """
    steps = Counter() if steps is None else steps
    full = Counter({p: n for p, n in plan.items() if n and sum(p) == capacity})
    open_ = {p: n for p, n in plan.items() if n and sum(p) < capacity}
    stuck: set[tuple] = set()
    takers = _Takers(capacity)
    for p in sorted(open_):
        takers.add(p)
    room = sum((capacity - sum(p)) * n for p, n in open_.items())
    queue, moved = [], True
    while room >= capacity:
        if not queue:  # all are set aside: try them again if anything has changed since
            if not moved:
                break
            queue, moved = [(sum(p), p) for p in open_], False
            heapify(queue)
            stuck.clear()
        giver = queue[0][1]
        if giver not in open_ or giver in stuck:
            heappop(queue)
            continue
        step = takers.best(giver, alone=open_[giver] == 1)
        if step is None:
            stuck.add(giver)
            continue
        taker, given, taken = step
        moved = True
        times = open_[giver] // 2 if taker == giver else min(open_[giver], open_[taker])
        steps[f"{len(given)} for {len(taken)}"] += times
        for pattern in (giver, taker):
            open_[pattern] -= times
        for pattern in {giver, taker}:
            if not open_[pattern]:
                del open_[pattern]
                takers.drop(pattern)
        for old, out, into in ((giver, given, taken), (taker, taken, given)):
            new = tuple(sorted((Counter(old) - Counter(out) + Counter(into)).elements(), reverse=True))
            if not new:
                room -= capacity * times
            elif sum(new) == capacity:
                full[new] += times
            else:
                if new not in open_:
                    takers.add(new)
                    heappush(queue, (sum(new), new))
                open_[new] = open_.get(new, 0) + times
                stuck.discard(new)
    return full + Counter(open_)


class _Takers:
    """What each underfull pattern can give back: its fill, its room and, a row each, nothing or one of its items."""

    def __init__(self, capacity: int):
        self.capacity, self.used, self.live = capacity, 0, 0
        self.patterns: list[tuple] = []
        self.rows_of: dict[tuple, slice] = {}
        self.fill, self.item, self.room = (np.full(4096, -1, np.int64) for _ in range(3))

    def add(self, pattern: tuple) -> None:
        items = [0, *sorted(set(pattern))]
        while self.used + len(items) > len(self.fill):
            if 2 * self.live < self.used:  # most rows are those of dropped patterns
                kept, self.patterns, self.rows_of, self.used, self.live = list(self.rows_of), [], {}, 0, 0
                self.room[:] = -1
                for p in kept:
                    self.add(p)
            else:
                self.fill, self.item, self.room = (np.r_[x, np.full_like(x, -1)] for x in (self.fill, self.item, self.room))
        rows = slice(self.used, self.used + len(items))
        self.fill[rows], self.item[rows], self.room[rows] = sum(pattern), items, self.capacity - sum(pattern)
        self.patterns += [pattern] * len(items)
        self.rows_of[pattern] = rows
        self.used, self.live = rows.stop, self.live + len(items)

    def drop(self, pattern: tuple) -> None:
        rows = self.rows_of.pop(pattern)
        self.room[rows] = -1
        self.live -= rows.stop - rows.start

    def best(self, giver: tuple, alone: bool) -> tuple[tuple, tuple, tuple] | None:
        """``(taker, given, taken)`` with the greatest gain in squared fill, or None. ``alone``: there is but one giver."""
        fill, item, room = self.fill[: self.used], self.item[: self.used], self.room[: self.used].copy()
        if alone:
            room[self.rows_of[giver]] = -1
        own_fill, singles = sum(giver), sorted(set(giver))
        options = [(x,) for x in singles] + [(a, b) for i, a in enumerate(singles) for b in singles[i:] if a != b or giver.count(a) > 1]
        best, found = 0, None
        for given in options:
            shift = sum(given) - item
            able = (shift > 0) & (shift <= room)
            at = np.flatnonzero(able if len(given) == 1 else able & (item > 0))
            if len(at):
                gain = shift[at] * (fill[at] - own_fill + shift[at])
                top = int(gain.argmax())
                if gain[top] > best:
                    row = int(at[top])
                    best, found = int(gain[top]), (self.patterns[row], given, (int(item[row]),) if item[row] else ())
        return found


def solve(counts: dict[int, int], capacity: int, steps: Counter | None = None) -> Plan:
    """Moves, longest items first, and then whatever move or swap still gains."""
    return improve(fill_by_moves(counts, capacity), capacity, steps)


def cut_pieces(total: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: one, or full ones behind a first that may be shorter."""
    head = total % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, total, capacity))] if total > capacity else [(0, total)]


def pieces(docs: DataFrame, capacity: int, vocabulary: str, end_id: int = 0) -> DataFrame:
    """``doc_id, text_key, piece, start, length, ids_crc32`` and the piece's task and rank among that task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, seen = ByteBPE.at(vocabulary), TaskContext.get().partitionId(), Counter()
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = bpe.encode(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                    rows.append((doc_id, key, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 8, names=names)

    ship_code(docs.sparkSession)
    names = ["doc_id", "text_key", "piece", "start", "length", "ids_crc32", "task", "rank"]
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def places(plan: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, sorted by first rank: first rank, items a bin, first bin, and offset of the first of them in a bin."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    base = 0
    for pattern in sorted(plan):
        offset = 0
        for length, items in sorted(Counter(pattern).items(), reverse=True):
            found.setdefault(length, []).append((used[length], items, base, offset))
            used[length] += items * plan[pattern]
            offset += items * length
        base += plan[pattern]
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in found.items()}


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """``doc_id, text_key, piece, start, length, ids_crc32, sequence_id, offset``: every document's tokens packed into sequences.

    A document is its ids and ``end_id``; null and empty texts are that id alone. Documents over ``capacity`` are cut. Rows
    that repeat a ``doc_id`` are packed like any others, null ids too; ``text_key`` tells whose text a piece is, so ``sequences`` can build
    them. An empty table gives no rows; other columns are ignored.

    Which sequence a piece joins depends on its length alone, so the driver solves the packing on the histogram of
    lengths (``capacity`` numbers at most, whatever the corpus) and the pieces of a length are dealt to that length's
    places by rank. Ranks are exact: each task counts its own pieces, and a window over (length, task) counts adds
    what other tasks hold. Texts are read once and not shuffled.
    """
    vocabulary = vocabulary or default_vocabulary()
    cut_docs = cut(pieces(docs, capacity, vocabulary, end_id))
    by_task = cut_docs.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = by_task.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("length", "task", "before")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(solve(counts, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, starts = np.unique(length[order], return_index=True)
            for value, rows in zip(values, np.split(order, starts[1:]), strict=True):
                first, items, base, at = where[int(value)]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                nth = rank[rows] - first[k]
                sequence[rows], offset[rows] = base[k] + nth // items[k], at[k] + nth % items[k] * value
            yield pa.record_batch([*batch.columns[:6], pa.array(sequence), pa.array(offset)], names=out)

    kept = ["doc_id", "text_key", "piece", "start", "length", "ids_crc32"]
    out = [*kept, "sequence_id", "offset"]
    joined = cut_docs.join(before, ["length", "task"]).select(*kept, "rank", "before")
    return joined.mapInArrow(place, ", ".join(f"{n} bigint" for n in out))


def sequences(packed: DataFrame, docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """``sequence_id, input_ids, documents``: the packed sequences themselves, from the places of ``pack`` and the table that was packed.

    ``documents`` lists ``doc_id, text_key, piece, offset, length`` in order, so that attention can be kept within a document. Pieces find their text by
    id and ``text_key``, rows alike in both being one text; each text is encoded once. A sequence's pieces, ``capacity`` ids at most, meet in one group.
    """
    vocabulary = vocabulary or default_vocabulary()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text")).dropDuplicates(["doc_id", "text_key"])
    kind = "doc_id bigint, text_key bigint, piece bigint, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = ByteBPE.at(vocabulary), end_id.to_bytes(4, "little")
        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = np.frombuffer(bpe.encode(text.as_py() or "") + end, np.int32)
                spans = cut_pieces(len(ids), capacity)
                lists = pa.ListArray.from_arrays(pa.array([0, *(s + n for s, n in spans)], pa.int32()), pa.array(ids))
                yield pa.record_batch([pa.array([doc_id] * len(spans), pa.int64()), pa.array([key] * len(spans), pa.int64()), pa.array(range(len(spans)), pa.int64()), lists], names=["doc_id", "text_key", "piece", "ids"])

    ship_code(docs.sparkSession)
    encoded = texts.mapInArrow(run, kind)
    placed = join_null_safe(packed.withColumn("piece", F.col("piece").cast("bigint")), encoded, ["doc_id", "text_key", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "text_key", "piece", "length", "ids")))
    whole = placed.groupBy("sequence_id").agg(parts.alias("p"))
    named = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["text_key"].alias("text_key"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length")))
    return whole.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("input_ids"), named.alias("documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every row of ``documents``."""
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset", "text_key")
