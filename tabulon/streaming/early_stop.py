"""Early stopping: an ordered fold over the losses of each run, for finished runs and for streams of epochs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabulon.session import ship_code

#: The least improvement that counts.
DELTA = 1e-7


def _step(best, bad, loss, patience: int):
    """What one more loss makes of the best score and the number of epochs without improvement. A NaN loss improves."""
    score = -loss
    if best is None or not score < best + DELTA:
        return score, 0, False
    return best, bad + 1, bad + 1 >= patience


class Stopper:
    """The fold for one run as it goes: ``step`` takes an epoch's loss and says whether it is the best yet; ``stopped`` whether to stop."""

    def __init__(self, patience: int):
        self.patience, self.best, self.bad, self.stopped = patience, None, 0, False

    def step(self, loss: float) -> bool:
        self.best, self.bad, self.stopped = _step(self.best, self.bad, loss, self.patience)
        return self.bad == 0


def stop_epochs(losses: DataFrame, run: str, epoch: str, loss: str, patience: int) -> DataFrame:
    """``run, best_loss, stopped_at``: the epoch at which each run stops, null if it does not. Null losses are passed over.

    The epochs of a run stream through one task in order; only the state of the fold is held.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None  # run, best score, epochs without improvement, where it stopped
        for batch in batches:
            ended = []
            for name, at, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or name != state[0]:
                    ended += [state] if state else []
                    state = [name, None, 0, None]
                if state[3] is None:
                    state[1], state[2], stop = _step(state[1], state[2], x, patience)
                    state[3] = at if stop else None
            yield rows(ended)
        if state:
            yield rows([state])

    def rows(ended: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{run: r[0], "best_loss": -r[1], "stopped_at": r[3]} for r in ended], schema)

    ship_code(losses.sparkSession)
    kind = T.StructType([T.StructField(run, losses.schema[run].dataType), T.StructField("best_loss", T.DoubleType()), T.StructField("stopped_at", T.LongType())])
    schema = to_arrow_schema(kind)
    ordered = losses.filter(F.col(loss).isNotNull()).select(run, F.col(epoch).cast("long").alias("__epoch"), F.col(loss).cast("double").alias("__loss"))
    return ordered.repartition(run).sortWithinPartitions(run, "__epoch", "__loss").mapInArrow(fold, kind)


def stop_stream(losses: DataFrame, run: str, epoch: str, loss: str, patience: int) -> DataFrame:
    """The same on a stream: state per run across micro-batches, one row out when a run stops."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, bad, stopped = state.get if state.exists else (None, 0, False)
        rows = pd.concat(list(frames)).sort_values(epoch)
        for e, x in zip(rows[epoch], rows[loss], strict=True):
            if stopped:
                break
            best, bad, stopped = _step(best, bad, float(x), patience)
            if stopped:
                yield pd.DataFrame({run: [key[0]], "best_loss": [-best], "stopped_at": [int(e)]})
        state.update((best, bad, stopped))

    ship_code(losses.sparkSession)
    kind = losses.schema[run].dataType.simpleString()
    return losses.groupBy(run).applyInPandasWithState(step, f"{run} {kind}, best_loss double, stopped_at long", "best double, bad int, stopped boolean", "append", "NoTimeout")
