"""Keyed state on a stream: changes of tracked columns and disappearance, emitted once they are settled.

Each key keeps one value: its merged columns, when it was last seen, and the events that the watermark hasn't passed yet. An event waits there until nothing older can come, so late and repeated events fall into place and the
output is that of the batch log; what comes after the watermark is dropped by the engine. Nothing reads the log again, and the state holds one row a key and the events of the allowed lateness.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StringType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settle(state: dict, watermark: int, tracked: list[str], timeout: int, terminal: dict[str, list]) -> list[tuple]:
    """Takes from ``state`` the pending events before ``watermark`` (milliseconds) in order and returns the log rows ``(at, event, kind, values)``.

    A value that is null doesn't overwrite. ``first``: the key's first event; ``changed``: a tracked value that is given and differs from the merged one; ``disappeared``: not seen for longer than ``timeout``, unless a terminal value
    stands; ``returned``: seen again after that. Times are microseconds.
    """
    out: list[tuple] = []

    def vanish(until: int) -> None:
        seen = state.get("seen")
        if seen is None or state.get("gone") or any(state["values"].get(c) in own for c, own in terminal.items()):
            return
        if until - seen > timeout:
            state["gone"] = True
            out.append((seen + timeout, None, "disappeared", dict(state["values"])))

    ready = sorted((int(k.split("|")[0]), int(k.split("|")[1]), k) for k in state["pending"])
    for at, event, k in ready:
        if at // 1000 >= watermark:
            break
        values = state["pending"].pop(k)
        vanish(at)
        given = {c: v for c, v in zip(tracked, values, strict=True) if v is not None}
        kind = "first" if state.get("seen") is None else "returned" if state.get("gone") else "changed" if any(state["values"].get(c) != v for c, v in given.items()) else None
        state["values"].update(given)
        state["seen"], state["gone"] = at, False
        if kind:
            out.append((at, event, kind, dict(state["values"])))
    vanish(watermark * 1000)
    return out


class Changes(StatefulProcessor):
    def __init__(self, key: str, event: str, tracked: list[str], timeout: int, terminal: dict[str, list]) -> None:
        self.key, self.event, self.tracked, self.timeout, self.terminal = key, event, tracked, timeout, terminal

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField("json", StringType())]))

    def _advance(self, key, state: dict, watermark: int) -> pd.DataFrame:
        rows = settle(state, watermark, self.tracked, self.timeout, self.terminal)
        due = [int(k.split("|")[0]) // 1000 + 1 for k in state["pending"]]
        if state.get("seen") is not None and not state.get("gone"):
            due.append((state["seen"] + self.timeout) // 1000 + 1)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due := [t for t in due if t > watermark]:
            self.handle.registerTimer(min(due))
        self.state.update((json.dumps(state),))
        cols = {self.key: [key] * len(rows), self.event: [r[1] for r in rows], "at_micros": [r[0] for r in rows], "kind": [r[2] for r in rows]} | {c: [r[3].get(c) for r in rows] for c in self.tracked}
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in cols.items()})

    def _load(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {"values": {}, "pending": {}}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._load()
        for part in rows:
            for t, e, *values in zip(part["at_micros"], part[self.event], *[part[c] for c in self.tracked], strict=True):
                if state.get("seen") is None or t > state["seen"] or t // 1000 >= timerValues.getCurrentWatermarkInMs():
                    state["pending"][f"{t}|{e}"] = [None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in values]
        yield self._advance(key[0], state, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key[0], self._load(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession):
    """State of this kind needs a store with column families."""
    was = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, was) if was else spark.conf.unset(PROVIDER)


def settled_changes(stream: DataFrame, key: str, event: str, time: str, tracked: list[str], lateness: str, timeout_days: float, terminal: dict[str, list] | None = None) -> DataFrame:
    """``key, event, time, kind, *tracked`` of the log, the tracked columns merged. ``event`` tells events of one time apart and repeats of one event together; rows without a key or time are left out."""
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = ", ".join([f"`{key}` {types[key]}", f"`{event}` long", "at_micros long", "kind string", *(f"`{c}` {types[c]}" for c in tracked)])
    rows = stream.select(key, event, time, *tracked).where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(event).isNotNull()).withWatermark(time, lateness).withColumn("at_micros", F.unix_micros(time))
    processor = Changes(key, event, tracked, int(timeout_days * 86_400_000_000), terminal or {})
    log = rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")
    return log.select(key, event, F.timestamp_micros("at_micros").alias(time), "kind", *tracked)


def run_to_table(df: DataFrame, path: str, checkpoint: str, partition: str | None = None) -> DataFrame:
    """Runs a stream over what there is and appends its rows to a table, exactly once for a checkpoint; a later call goes on where the last one ended, and rows of earlier calls stay."""
    spark = df.sparkSession
    with _rocks(spark):
        w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
        (w.partitionBy(partition) if partition else w).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)
