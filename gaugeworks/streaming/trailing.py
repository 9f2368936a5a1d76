"""Trailing windows of batches on a stream, by the batches' own arrival times or by the engine's."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gaugeworks.operators.trailing import DAY_MS, add_bounds, newest_per_tag
from gaugeworks.session import forget, settle
from gaugeworks.streaming.steps import StepState, each_step


def trailing_bounds_stream(
    batches: DataFrame,
    path: str,
    state: str,
    checkpoint: str,
    horizon_ms: int = DAY_MS,
    **trigger,
) -> StreamingQuery:
    """Write ``trailing_bounds`` of a stream of batches to ``path``, one folder per micro-batch.

    Batches carry ``arrival_ts``. A micro-batch is handled as a table. Between micro-batches only the
    tags still in the horizon are kept in ``state``, with the newest older batch as floor; they are
    small, belong to no key and go when they are a horizon old. Every step overwrites its own
    folders, so one that runs again after a failure leaves the same files. Batches arrive in id
    order from micro-batch to micro-batch, in any order within one.
    """
    store = StepState(state)

    def step(rows: DataFrame, number: int) -> None:
        seen = newest_per_tag(rows)
        earlier = store.before(rows.sparkSession, number)
        if earlier is not None:
            seen = (
                seen.unionByName(earlier)
                .groupBy("t")
                .agg(F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))
            )
        seen = settle(seen, "seen")
        add_bounds(rows, seen, horizon_ms).write.mode("overwrite").parquet(f"{path}/step={number}")
        last = seen.agg(F.max("t")).first()[0]
        edge = None if last is None else last - int(horizon_ms)
        # What no later window can reach counts only by its newest batch: one row, at its tag.
        kept = seen.groupBy(
            F.when(F.col("t") <= F.lit(edge), F.lit(edge)).otherwise(F.col("t")).alias("t")
        ).agg(F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))
        store.keep(kept, number)
        forget(seen)

    return each_step(batches, step, checkpoint, **trigger)


def trailing_processor(keys: Sequence[str], horizon_ms: int) -> StatefulProcessor:
    """The state of trailing windows, in a class that travels by value.

    A class of a module travels by name, and the worker that checks the state's schema on the driver
    does not know the package, whatever is added to the executors.
    """

    class TrailingWindows(StatefulProcessor):
        """Per key the tags still in the horizon, each with the newest batch that carries it.

        The tag is the watermark that the engine holds when a batch arrives. All batches of one
        micro-batch share it, so a key has at most one entry per micro-batch of the horizon, however
        many batches it sends. A timer removes an entry when the watermark is a horizon past it; of
        what was removed only the newest batch id is kept, one number per key.
        """

        def __init__(self, keys: Sequence[str], horizon_ms: int):
            self.keys = tuple(keys)
            self.horizon_ms = int(horizon_ms)

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.tags = handle.getMapState("tags", "tag bigint", "newest bigint")
            self.floor = handle.getValueState("floor", "newest bigint")

        def _floor(self) -> int:
            return self.floor.get()[0] if self.floor.exists() else -1

        def _raise_floor(self, newest: int) -> None:
            if newest > self._floor():
                self.floor.update((newest,))

        def _expire(self, watermark: int) -> None:
            old = [(key[0], value[0]) for key, value in self.tags.iterator() if key[0] <= watermark - self.horizon_ms]
            for tag, newest in old:
                self._raise_floor(newest)
                self.tags.removeKey((tag,))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            watermark = timerValues.getCurrentWatermarkInMs()
            tagged = watermark > 0
            if tagged:
                # Timers run after the rows of their micro-batch.
                self._expire(watermark)
            after, newest = self._floor(), -1
            for frame in rows:
                ids = frame["batch_id"]
                newest = max(newest, int(ids.max()))
                out = {name: [value] * len(ids) for name, value in zip(self.keys, key)}
                out["batch_id"] = ids
                out["arrival_ms"] = pd.array([watermark if tagged else None] * len(ids), "Int64")
                out["after_batch_id"] = after if tagged else ids - 1
                yield pd.DataFrame(out)
            if not tagged:
                # Before any watermark a batch sees only itself, and no later one sees it.
                self._raise_floor(newest)
                return
            known = self.tags.getValue((watermark,)) if self.tags.containsKey((watermark,)) else None
            if known is None:
                self.handle.registerTimer(watermark + self.horizon_ms)
            self.tags.updateValue((watermark,), (max(newest, known[0] if known else -1),))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self._expire(timerValues.getCurrentWatermarkInMs())
            yield from ()

        def close(self) -> None:
            pass

    return TrailingWindows(keys, horizon_ms)


def trailing_windows_stream(
    batches: DataFrame,
    keys: Sequence[str] = ("sensor_id",),
    horizon_ms: int = DAY_MS,
    event_col: str = "event_ts",
    delay: str = "0 seconds",
) -> DataFrame:
    """A stream of batches tagged by the engine's watermark, with the bound of each one's window.

    Returns the keys, ``batch_id``, ``arrival_ms`` (the watermark that the batch met, null before any)
    and ``after_batch_id``: the window is the batches of its key above that id, up to its own. No
    column of arrival times is needed. The watermark moves between micro-batches, so batches of one
    micro-batch share it; batches of a key come in id order from one micro-batch to the next.
    ``delay`` is how far the watermark stays behind the newest event time.

    Needs the RocksDB state store (see ``build_session``, or start the stream inside
    ``rocksdb_state``) and one column of state type per key.
    """
    # The watermark follows the event time, but an old event time is no reason to drop a batch:
    # without the column the engine does not hold rows against the watermark.
    clocked = batches.select(*keys, "batch_id", event_col).withWatermark(event_col, delay)
    clocked = clocked.drop(event_col)
    types = dict(clocked.dtypes)
    named = ", ".join(f"`{key}` {types[key]}" for key in keys)
    return clocked.groupBy(*keys).transformWithStateInPandas(
        trailing_processor(keys, horizon_ms),
        f"{named}, batch_id bigint, arrival_ms bigint, after_batch_id bigint",
        "append",
        "eventTime",
    )
