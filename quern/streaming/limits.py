"""A sliding-window limiter, in batch and as a stream, and leases."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def admit(times: Iterator[int], recent: deque, limit: int, window: int) -> Iterator[bool]:
    """For times in order, whether each is let in: fewer than ``limit`` were in the window before it.

    Only those let in count, and one exactly a window old no longer does.
    """
    for now in times:
        while recent and recent[0] <= now - window:
            recent.popleft()
        allowed = len(recent) < limit
        if allowed:
            recent.append(now)
        yield allowed


def limited(df: DataFrame, key: str, time: str, event: str, limit: int, seconds: int) -> DataFrame:
    """``key, event, allowed``: every event with whether its key's limiter lets it in.

    Whether an event counts depends on all before it, so each key's events pass
    through one task in order; they stream through it, and only the last ``limit``
    are held, so a hot key costs time but no memory. Null keys are one key, and
    events without a time are let in before all others.
    """
    schema = T.StructType([df.schema[key], df.schema[event], T.StructField("allowed", T.BooleanType())])
    window = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, recent, first = None, deque(), True
        for batch in batches:
            allowed = []
            for k, t in zip(batch.column(key).to_pylist(), batch.column("_t").to_pylist()):
                if first or k != current:
                    current, recent, first = k, deque(), False
                allowed.append(True if t is None else next(admit(iter((t,)), recent, limit, window)))
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(event), pa.array(allowed, pa.bool_())], names=schema.names)

    ordered = df.select(key, event, F.unix_micros(F.col(time).cast("timestamp")).alias("_t")).repartition(key).sortWithinPartitions(key, "_t", event)
    return ordered.mapInArrow(run, schema)


def limit_stream(stream: DataFrame, key: str, time: str, event: str, limit: int, seconds: int) -> DataFrame:
    """The same for a stream: the state of each key is the times it was let in within the window.

    Events are taken in order within a micro-batch; a key's state ends when the window has passed.
    """
    window = seconds * 1_000_000
    out = f"{key} {stream.schema[key].dataType.simpleString()}, {event} {stream.schema[event].dataType.simpleString()}, allowed boolean"

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(frames)).sort_values(["_t", event], kind="stable")
        rows["allowed"] = list(admit(iter(rows["_t"].tolist()), recent, limit, window))
        state.update((list(recent),))
        state.setTimeoutDuration(seconds * 1000)
        yield rows[[key, event, "allowed"]]

    keyed = stream.select(key, event, F.unix_micros(F.col(time).cast("timestamp")).alias("_t")).groupBy(key)
    return keyed.applyInPandasWithState(step, out, "recent array<long>", "append", "ProcessingTimeTimeout")


def expired(leases: DataFrame, seen: str, now: Column, seconds: int, held: Column) -> DataFrame:
    """Leases that nobody renewed for the given time, except those that are held on purpose; exactly that old is expired."""
    return leases.where(~held & (F.col(seen) <= now - F.expr(f"INTERVAL {seconds} SECONDS")))


def open_twice(leases: DataFrame, keys: list[str], open_: Column) -> DataFrame:
    """``keys, n`` of leases that are open more than once at a time."""
    return leases.where(open_).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
