"""Streams in event-time order: a reorder buffer with event-time timers, state that expires, and rows that come too late.

Rows wait per key until the watermark has passed them, are then taken in time order by a step function, and what the step
remembers is dropped once the watermark is `keep` beyond the key's last row. A row older than the watermark when it
arrives is not lost: it comes out with `late` set, and `write_apart` puts it in a table of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Rows from here on only move the clock: they end a replay of recorded events.
END_OF_TIME = "2200-01-01"

# (what is remembered or None, rows of one moment as tuples without the key) -> (what to remember, output tuples)
Step = Callable[[tuple | None, list[tuple]], tuple[tuple, list[tuple]]]


class InOrder(StatefulProcessor):
    """Hands a key's rows to `step` in time order, rows of one moment together."""

    def __init__(self, fields: list[str], waiting: str, memory: str, output: list[str], step: Step, keep_us: int):
        self.fields, self.waiting_schema, self.memory_schema, self.output, self.step, self.keep_us = fields, waiting, memory, output, step, keep_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.memory = handle.getValueState("memory", f"{self.memory_schema}, last_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        clock = max(0, timerValues.getCurrentWatermarkInMs()) * 1000
        late, first = [], None
        for chunk in rows:
            fresh = []
            for row in chunk[self.fields].itertuples(index=False, name=None):
                row = tuple(plain(v) for v in row)
                if row[0] < clock:
                    late.append(row)
                else:
                    fresh.append(row)
                    first = row[0] if first is None else min(first, row[0])
            if fresh:
                self.waiting.appendList(fresh)
        if first is not None:
            self._wake(first)
        yield self._frame(key, [], late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock = max(0, timerValues.getCurrentWatermarkInMs()) * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due, rest = sorted((r for r in held if r[0] < clock), key=in_time), [r for r in held if r[0] >= clock]
        memory = self.memory.get() if self.memory.exists() else None
        state, last, out = (tuple(memory)[:-1], memory[-1], []) if memory is not None else (None, None, [])
        at = 0
        while at < len(due):
            end = at
            while end < len(due) and due[end][0] == due[at][0]:
                end += 1
            state, made = self.step(state, due[at:end])
            out += made
            last, at = due[end - 1][0], end
        last = memory[-1] if memory is not None and last is None else last
        if due:
            self.memory.update((*state, last))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if rest:
            self._wake(min(r[0] for r in rest), fired)
        elif last is not None and last + self.keep_us < clock:
            self.memory.clear()
        elif last is not None:
            self._wake(last + self.keep_us, fired)
        yield self._frame(key, out, [])

    def close(self) -> None:
        pass

    def _wake(self, us: int, fired: int | None = None) -> None:
        """Timer for when the watermark is past this time; a later one that is set already goes. The one that has just fired is still listed."""
        wanted = us // 1000 + 1
        for other in list(self.handle.listTimers()):
            if other == fired:
                continue
            if other <= wanted:
                return
            self.handle.deleteTimer(other)
        self.handle.registerTimer(wanted)

    def _frame(self, key, out: list[tuple], late: list[tuple]) -> pd.DataFrame:
        """Step outputs, and late rows with their time alone."""
        empty = (None,) * (len(self.output) - 1)
        rows = [(key[0], *o, False) for o in out] + [(key[0], row[0], *empty, True) for row in late]
        return pd.DataFrame(rows, columns=["key", *self.output, "late"]).astype(object)


def plain(value):
    """A Python value of what a pandas column holds; missing ones are None."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value


def in_time(row: tuple) -> tuple:
    """Order of rows: time, then the remaining values, missing ones first."""
    return (row[0], *((v is not None, v) for v in row[1:]))


def in_order(stream: DataFrame, key: str, fields: list[str], memory: str, output: str, step: Step, keep_us: int, delay: str) -> DataFrame:
    """(key, output columns, late) of `step` over each key's rows in time order; `fields` begins with the time in microseconds.

    Equal times are ordered by the further fields. A key's rows wait for `delay` at most, so its buffer holds what comes in that time.
    Rows without time are dropped by the watermark's rule and not late. The first output column is the time.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    us = fields[0]
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    clocked = stream.where(F.col(us).isNotNull()).withColumn("_ts", F.timestamp_micros(us)).withWatermark("_ts", delay).where(F.col("_ts") < F.lit(END_OF_TIME).cast("timestamp"))
    # The operator asks for an event time among its columns and drops rows whose event time is past. An empty one keeps late rows:
    # the watermark is the one above.
    milliseconds = spark.range(1).select(F.expr(f"cast(interval '{delay}' as interval day to second)").alias("i")).select((F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.col("i"))).alias("ms")).first()["ms"]
    slim = clocked.select(F.col(key).alias("key"), *fields, F.nullif("_ts", "_ts").alias("_clock", metadata={"spark.watermarkDelayMs": milliseconds}))
    names = StructType.fromDDL(output).fieldNames()
    processor = InOrder(fields, ", ".join(f"`{f}` {kinds[f]}" for f in fields), memory, names, step, keep_us)
    return slim.groupBy("key").transformWithStateInPandas(processor, f"key {kinds[key]}, {output}, late boolean", "append", "eventTime").withColumnRenamed("key", key)


def write_apart(rows: str, late: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """Batch function of a tagged stream: rows in time, shaped, to one folder, late ones to another, each under its batch number.

    A batch that is tried again overwrites its own folders, so every row lands once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        shape(batch.where("NOT late").drop("late")).write.mode("overwrite").parquet(f"{rows}/batch={number}")
        batch.where("late").drop("late").write.mode("overwrite").parquet(f"{late}/batch={number}")
        batch.unpersist()

    return write
