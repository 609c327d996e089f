"""Structured Streaming forms: windows, debounce, rate limits and the co-activation fold over live events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config as C
from ..operators import feedback, memory


def read_events(spark: SparkSession, folder: str, schema: str, files: int | None = None) -> DataFrame:
    """Events of JSON files as they arrive in a folder; a grown file isn't read again, so producers roll files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).json(folder)


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "5 minutes", key: str = "event_type") -> DataFrame:
    """Counts by event-time window and key; windows close once the watermark passes them."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"))


def debounced(events: DataFrame, key: str, ts: str = "ts", gap: str = "750 milliseconds", late: str = "10 seconds") -> DataFrame:
    """Runs of a key without a pause of the gap, emitted when they can't grow any more."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))


def rate_limited(calls: DataFrame, limit: int = 60, seconds: float = 60.0) -> DataFrame:
    """calls (actor, seq, ts seconds) with allowed; an actor's admitted times within the window are its state."""

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["ts", "seq"])
        out = []
        for t in pdf["ts"]:
            held = [x for x in held if x > t - seconds]
            out.append(len(held) < limit)
            if out[-1]:
                held.append(float(t))
        state.update((held,))
        yield pd.DataFrame({"actor": key[0], "seq": pdf["seq"], "ts": pdf["ts"], "allowed": out})

    kind = dict(calls.dtypes)["actor"]
    return calls.groupBy("actor").applyInPandasWithState(admit, f"actor {kind}, seq long, ts double, allowed boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def breaker(results: DataFrame, failures: int = 3, timeout: float = 30.0) -> DataFrame:
    """results (key, seq, ts seconds, ok) with the circuit breaker's state after each; a key's state is three values."""

    def walk(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, bad, since = held.get if held.exists else ("closed", 0, 0.0)
        pdf, out = pd.concat(list(batches)).sort_values(["ts", "seq"]), []
        for t, ok in zip(pdf["ts"], pdf["ok"]):
            state = "half_open" if state == "open" and t - since >= timeout else state
            if ok and state != "open":
                state, bad = "closed", 0
            elif not ok:
                bad += 1
                if state != "open" and (state == "half_open" or bad >= failures):
                    state, since = "open", float(t)
            out.append(state)
        held.update((state, bad, since))
        yield pd.DataFrame({"key": key[0], "seq": pdf["seq"], "ts": pdf["ts"], "ok": pdf["ok"], "state": out})

    kind = dict(results.dtypes)["key"]
    return results.groupBy("key").applyInPandasWithState(walk, f"key {kind}, seq long, ts double, ok boolean, state string", "state string, bad int, since double", "append", GroupStateTimeout.NoTimeout)


def fanned_out(sinks: list[tuple[list[str] | None, Callable[[DataFrame], None]]], failed: Callable[[Exception], None] | None = None):
    """A foreachBatch function that gives each batch of events (type, …) to all sinks, each with the types that it wants (None: all).

    A sink that fails doesn't keep the others from their events; ``failed`` is told.
    """

    def publish(rows: DataFrame, _: int) -> None:
        for types, sink in sinks:
            try:
                sink(rows if types is None else rows.where(F.col("type").isin(types)))
            except Exception as e:  # one sink's trouble is its own
                if failed:
                    failed(e)

    return publish


def kept_back(events: DataFrame, subscribers: DataFrame, most: int = 256) -> DataFrame:
    """(subscriber, kept array of seq, dropped): for each subscriber (subscriber, after) the newest ``most`` events (seq) since it last read.

    Older ones are dropped and counted, as of a full queue. ``most`` numbers a subscriber are held.
    """
    last = events.select("seq").orderBy(F.desc("seq")).limit(most)
    n = events.join(F.broadcast(subscribers), F.col("seq") > F.col("after")).groupBy("subscriber").agg(F.count("*").alias("n"))
    kept = last.join(F.broadcast(subscribers), F.col("seq") > F.col("after")).groupBy("subscriber").agg(F.array_sort(F.collect_list("seq")).alias("kept"))
    return subscribers.select("subscriber").join(n, "subscriber", "left").join(kept, "subscriber", "left").select("subscriber", F.coalesce("kept", F.array().cast("array<bigint>")).alias("kept"), (F.coalesce("n", F.lit(0)) - F.coalesce(F.size("kept"), F.lit(0))).alias("dropped"))


def file_activity(polls: DataFrame) -> DataFrame:
    """(poll, path, change) of polls (poll 1, 2, …, path, mtime): added, modified or deleted since the poll before; the first says nothing."""
    before = polls.select((F.col("poll") + 1).alias("poll"), "path", F.col("mtime").alias("was"))
    last = polls.agg(F.max("poll").alias("last"))
    j = polls.join(before, ["poll", "path"], "full_outer").crossJoin(F.broadcast(last)).where("poll > 1 and poll <= last")
    change = F.when(F.col("was").isNull(), "added").when(F.col("mtime").isNull(), "deleted").when(F.col("mtime") != F.col("was"), "modified")
    return j.select("poll", "path", change.alias("change")).where("change is not null")


def stepping(load: Callable[[], tuple[DataFrame | None, str | None]], store: Callable[[DataFrame, str], None]):
    """A foreachBatch function that folds touches (seq, path, ts, namespace) into the stored transitions; it goes on from the last file touched."""

    def fold(rows: DataFrame, _: int) -> None:
        old, last = load()
        end = rows.agg(F.max_by("path", "seq"), F.min("seq")).first()
        if end[0] is None:
            return
        if last is not None:
            first = rows.orderBy("seq").limit(1).select((F.col("seq") - 1).alias("seq"), F.lit(last).alias("path"), "ts", "namespace")
            rows = first.unionByName(rows.select("seq", "path", "ts", "namespace"))
        new = feedback.tool_steps(rows)
        if old is not None:
            both = old.select(*new.columns).unionByName(new)
            new = both.groupBy(*memory.STEP).agg(F.least(F.lit(C.TRANSITION_CAP), F.sum("weight")).alias("weight"), F.sum("count").alias("count"), F.max("last_activated").alias("last_activated"), F.min("created_at").alias("created_at"))
        store(new, end[0])

    return fold


def reinforcing(load: Callable[[], DataFrame | None], store: Callable[[DataFrame], None], strength: float = 1.0):
    """A foreachBatch function that folds (batch, node, ts, namespace) rows into the stored synapses."""

    def fold(rows: DataFrame, _: int) -> None:
        store(memory.reinforce(load(), rows, strength))

    return fold
