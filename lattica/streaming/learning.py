"""Learning from file activity as a stateful stream: paths that fall quiet at one tick are one batch of activations.

A path's events are its state, until the watermark tells that no earlier one can come any more. Each event sets a timer for
the first tick after its pause. When the timer fires, the path is ready if no later event lies before the tick; then the
events up to it go. So the result doesn't depend on how events are cut into micro-batches or in which order they arrive
within the allowed lateness, repeated events change nothing, and the state of a path ends with its last timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.store import SynapseStore

#: Pause after which a path is quiet, and distance of ticks, in milliseconds.
PAUSE_MS, TICK_MS = 750, 250
#: What a session needs for the stateful stream.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _tick(ms: Column, pause: int, tick: int) -> Column:
    return (F.ceil((ms + pause) / tick) * tick).cast("bigint")


def ready(events: DataFrame, pause: int = PAUSE_MS, tick: int = TICK_MS) -> DataFrame:
    """(tick, path, namespace, ts) of a table of events (path, namespace, ts timestamp): the batch form. Null paths and times are no events."""
    ms = events.where("path is not null and ts is not null").select("path", "namespace", F.unix_millis("ts").alias("ms")).distinct()
    after = F.lead("ms").over(Window.partitionBy("path", "namespace").orderBy("ms"))
    rows = ms.withColumn("due", _tick(F.col("ms"), pause, tick)).withColumn("next", after).where("next is null or next >= due")
    return rows.select(F.timestamp_millis("due").alias("tick"), "path", "namespace", F.timestamp_millis("ms").alias("ts"))


class _Quiet(StatefulProcessor):
    def __init__(self, pause: int, tick: int):
        self.pause, self.tick = pause, tick

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "ms bigint")

    def _due(self, ms: int) -> int:
        return -(-(ms + self.pause) // self.tick) * self.tick

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {x[0] for x in self.times.get()}
        new = {int(ms) for pdf in rows for ms in pdf["ms"]} - held
        for ms in new:
            self.times.appendValue((ms,))
        for due in {self._due(ms) for ms in new}:
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted(x[0] for x in self.times.get())
        mine = [ms for ms in held if self._due(ms) == due]
        rest = [ms for ms in held if self._due(ms) > due]
        quiet = bool(mine) and not any(mine[-1] < ms < due for ms in rest)
        if rest:
            self.times.put([(ms,) for ms in rest])
        else:
            self.times.clear()
        if quiet:
            text = lambda v: pd.Series([v], dtype=object)
            yield pd.DataFrame({"tick": [due], "path": text(key[0]), "namespace": text(key[1]), "ts": [mine[-1]]})

    def close(self) -> None:
        pass


def ready_stream(events: DataFrame, pause: int = PAUSE_MS, tick: int = TICK_MS, late: str = "10 seconds") -> DataFrame:
    """``ready`` of a stream of events (path, namespace, ts timestamp); a session needs STATE_STORE. Rows come once the watermark passes their tick."""
    rows = events.where("path is not null and ts is not null").withWatermark("ts", late).select("path", "namespace", "ts", F.unix_millis("ts").alias("ms"))
    out = rows.groupBy("path", "namespace").transformWithStateInPandas(_Quiet(pause, tick), "tick bigint, path string, namespace string, ts bigint", "Append", "EventTime")
    return out.select(F.timestamp_millis("tick").alias("tick"), "path", "namespace", F.timestamp_millis("ts").alias("ts"))


def activations(rows: DataFrame) -> DataFrame:
    """(batch, node, ts, namespace) of ready paths: those of one tick and namespace fire together."""
    return rows.select(F.concat_ws("/", F.unix_millis("tick").cast("string"), "namespace").alias("batch"), F.col("path").alias("node"), (F.unix_millis("ts") / 1000).alias("ts"), "namespace")


def learn(events: DataFrame, store: SynapseStore, checkpoint: str, name: str = "files", **options) -> StreamingQuery:
    """Starts a stream that strengthens the pairs of every tick's ready paths in ``store``.

    All paths of a tick leave the state in the micro-batch whose watermark passes it, so they meet. The store remembers the
    last micro-batch that it took under ``name``: one that comes again after a restart isn't counted twice.
    """

    def fold(rows: DataFrame, epoch: int) -> None:
        store.reinforce(activations(rows), epoch=(name, epoch))

    return ready_stream(events, **options).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
