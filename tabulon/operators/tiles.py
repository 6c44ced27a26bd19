"""All pairs of rows by blocks: each pair of blocks meets in one task, which leaves a few numbers a row and no pairs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import ship_code

#: Numbers of a block of vectors; a task holds two blocks.
NUMBERS = 1 << 22

#: A table is not cut into blocks of fewer rows than this to occupy all cores.
FEW = 512

#: What is made of the rows of two blocks; of one block with itself if the second is None.
Meeting = Callable[[pa.Table, pa.Table | None], Iterator[pa.RecordBatch]]


def blocks(rows: DataFrame, vector: str, once: bool = False) -> int:
    """The number of blocks: as many as keep one within ``NUMBERS``, but three tasks a core at least if there are rows enough."""
    n, wide = rows.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    tasks = 3 * rows.sparkSession.sparkContext.defaultParallelism * (2 if once else 1)
    return max(1, -(-n * max(1, wide or 0) // NUMBERS), min(math.ceil(math.sqrt(tasks)), -(-n // FEW)))


def meet(rows: DataFrame, vector: str, run: Meeting, schema: str, once: bool = False) -> DataFrame:
    """``run`` of every ordered pair of blocks of ``rows``, or with ``once`` of every unordered pair, a task each.

    A row is sent twice as often as there are blocks, with ``once`` as often. Every two rows, also the same twice, meet once in an order; with ``once`` rows of one
    block meet in both. Blocks are dealt by a hash of the whole row. Memory is that of two blocks, whatever the table; the work grows with the square of the
    rows, what is sent with rows times blocks, which is in proportion to the rows up to ``NUMBERS`` times the root of three times the cores.
    """
    n, names = blocks(rows, vector, once), rows.columns
    every, at = F.sequence(F.lit(0), F.lit(n - 1)), F.col("__at")
    side = lambda tile, role: lambda k: F.struct(tile(k).cast("int").alias("tile"), role(k).alias("role"))
    if once:
        low, high = (lambda k: F.least(k, at)), (lambda k: F.greatest(k, at))
        ways = F.transform(every, side(lambda k: F.shiftright(high(k) * (high(k) + 1), 1) + low(k), lambda k: F.when(k == at, 2).otherwise((at > k).cast("int"))))
    else:
        left, right = side(lambda k: at * n + k, lambda k: F.lit(0)), side(lambda k: k * n + at, lambda k: F.lit(1))
        ways = F.concat(F.transform(every, left), F.transform(every, right))
    placed = rows.withColumn("__at", F.pmod(F.xxhash64(*names), F.lit(n)).cast("int"))
    sent = placed.select(*names, F.explode(ways).alias("__way")).select(*names, F.col("__way.role").alias("__role"), F.col("__way.tile").alias("__tile"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            both = pa.Table.from_batches(held)
            left, right, own = (both.filter(pc.equal(both.column("__role"), k)).select(names).combine_chunks() for k in range(3))
            if own.num_rows:
                yield from run(own, None)
            elif left.num_rows and right.num_rows:
                yield from run(left, right)

    ship_code(rows.sparkSession)
    return sent.repartitionById(n * (n + 1) // 2 if once else n * n, "__tile").select(*names, "__role").mapInArrow(task, schema)


Pieces = Iterator[tuple[slice, np.ndarray]]


def by_rows(x: np.ndarray, y: np.ndarray, rows: int, widths: list[int]) -> Iterator[tuple[slice, Pieces]]:
    """For every ``rows`` rows of ``x`` the pieces of the table of |y|² - 2 x·y, the first of ``widths[0]`` columns and the others of ``widths[-1]``; with |x|² added it has the squared distances."""
    left = np.hstack([x, np.ones((len(x), 1))])
    right = np.ascontiguousarray(np.hstack([-2 * y, (y * y).sum(axis=1)[:, None]]).T)
    starts = [0, *range(widths[0], len(y), widths[-1]), len(y)] if len(y) > widths[0] else [0, len(y)]
    for i in range(0, len(x), rows):
        part = left[i : i + rows]
        yield slice(i, i + len(part)), ((slice(a, b), part @ right[:, a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True))
