"""Streams that carry state from run to run: what was seen within some days, and the last known value of each quarter of an hour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(df: DataFrame) -> None:
    """The state store that keyed state with timers needs."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _micros(c) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


#: Keys share the state of a part, so that a batch costs a call for each part, not for each key.
PARTS = 1024


def _seen(ttl: int, renew: bool, columns: list[str]):
    """A step for one part of the keys: the state is each key (JSON on a line) and the time (in microseconds) that its memory counts from; an event-time timeout forgets those that are over."""

    def run(part, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, times = state.get if state.exists else ("", b"")
        held = dict(zip(names.split("\n"), np.frombuffer(times, np.int64).tolist()))
        own = None if state.hasTimedOut else pd.concat(list(frames)).sort_values(["own_at", "own_id"], kind="stable")
        if own is not None:
            passed = []
            for key, at in zip(own["own_key"].tolist(), own["own_at"].tolist()):
                last = held.get(key)
                new = last is None or at - last > ttl
                passed.append(new)
                if new or renew:
                    held[key] = at if last is None else max(last, at)
        watermark = state.getCurrentWatermarkMs()
        held = {k: last for k, last in held.items() if (last + ttl) // 1000 + 1 >= watermark}  # what still comes is newer than any other
        if held:
            state.update(("\n".join(held), np.fromiter(held.values(), np.int64, len(held)).tobytes()))
            state.setTimeoutTimestamp(max((min(held.values()) + ttl) // 1000, watermark) + 1)
        elif state.exists:
            state.remove()
        if own is not None:
            yield own.loc[passed, columns]

    return run


def unseen(events: DataFrame, keys: list[str], ts: str = "ts", id: str = "event_id", days: int = 7, renew: bool = True, delay: str = "0 seconds") -> DataFrame:
    """Events whose key was not there within the days before, over all batches and runs of the stream.

    renew: every event of a key keeps it in memory (an event passes if the one before it is more than days older); else only one
    that passed does, as links are remembered that were published. Events older than the watermark are dropped; ties on time
    go by id. Keys with a null are keys like any other.
    """
    key = F.to_json(F.struct(*[F.col(k).alias(f"k{n}") for n, k in enumerate(keys)]))
    own = events.withColumns({"own_at": _micros(ts), "own_time": F.col(ts).cast("timestamp"), "own_id": F.col(id), "own_key": key}).withWatermark("own_time", delay)
    one = own.withColumn("own_part", F.pmod(F.xxhash64("own_key"), F.lit(PARTS))).groupBy("own_part")
    return one.applyInPandasWithState(_seen(days * 86_400_000_000, renew, events.columns), events.schema, "names string, times binary", "append", GroupStateTimeout.EventTimeTimeout)


class _Held(StatefulProcessor):
    """Windows that have values but are not over yet, and the last window that was told with its value."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "told bigint, value double, starts array<bigint>, ats array<bigint>, ids array<bigint>, vals array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows))
        own["own_start"] = own["own_at"] // self.width * self.width
        held = self.state.get()
        told, value = (held[0], held[1]) if held else (None, None)
        waiting = {s: (a, i, v) for s, a, i, v in zip(*held[2:])} if held else {}
        best = own.sort_values(["own_at", "own_id"], kind="stable").groupby("own_start").tail(1)
        for s, a, i, v in zip(best["own_start"].tolist(), best["own_at"].tolist(), best["own_id"].tolist(), best["own_value"].tolist()):
            if (told is None or s > told) and (s not in waiting or (a, i) > waiting[s][:2]):
                waiting[s] = (a, i, v)
        self._keep(told, value, waiting)
        if held is None:
            self.handle.registerTimer((min(waiting) + self.width) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Every window that is over by now, with its own value or the last known one; then the next window's end is waited for."""
        told, value, *lists = self.state.get()
        waiting = {s: (a, i, v) for s, a, i, v in zip(*lists)}
        start = min(waiting) if told is None else told + self.width
        out = []
        while (start + self.width) // 1000 <= timerValues.getCurrentWatermarkInMs():
            value = waiting.pop(start)[2] if start in waiting else value
            told = start
            out.append((*key, start, value))
            start += self.width
        self._keep(told, value, waiting)
        self.handle.registerTimer((start + self.width) // 1000)
        yield pd.DataFrame(out, columns=["own_key", "own_start", "value"])

    def _keep(self, told, value, waiting) -> None:
        starts = sorted(waiting)
        self.state.update((told, value, starts, *[[waiting[s][k] for s in starts] for k in range(3)]))

    def close(self) -> None:
        pass


def last_known(events: DataFrame, key: str, ts: str = "ts", id: str = "event_id", value: str = "value", minutes: int = 15, delay: str = "1 hour") -> DataFrame:
    """key, start, value of every window from a key's first one on: the last value of the window, or of the last one that had any.

    A window is told once the watermark has passed its end, whether it had events or not. Events without a value are left out; ties on time go by id.
    """
    with_store(events)
    own = events.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("own_key"), _micros(ts).alias("own_at"), F.col(id).cast("long").alias("own_id"), F.col(value).cast("double").alias("own_value"), F.col(ts).cast("timestamp").alias("own_time")
    )
    kind = f"own_key {events.schema[key].dataType.simpleString()}, own_start bigint, value double"
    out = own.withWatermark("own_time", delay).groupBy("own_key").transformWithStateInPandas(_Held(minutes * 60_000_000), kind, "append", "eventTime")
    return out.select(F.col("own_key").alias(key), F.timestamp_micros("own_start").alias("start"), "value")


def run_to_end(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """All that is there now goes through the stream into folder; the next run goes on where this one ended."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
