"""Streaming over the events table: windows, sessions, deduplication, joins, custom state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, path: str, schema: str, *, files: int = 1, delay: str | None = None, time: str = "ts", format: str = "parquet") -> DataFrame:
    """A stream of files with `time` as a zoned timestamp, and a watermark if a delay is given."""
    rows = spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files).load(path)
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, delay) if delay else rows


def tumbling(df: DataFrame, length: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by time window and keys; sliding, if slide is given."""
    span = F.window("ts", length, slide or length)
    return df.groupBy(span.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, gap: str, key: str) -> DataFrame:
    """Sessions of a key, which end after a gap without events."""
    return df.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def deduplicated(df: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key within the watermark's delay; state for older keys is dropped."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def followed(left: DataFrame, right: DataFrame, key: str, within: str, how: str = "inner") -> DataFrame:
    """Rows of left and the rows of right with the same key up to `within` later; both sides need a watermark, which is
    what lets old state go. With left_outer, right_outer or full_outer the rows without another come too, with a null
    time, once the watermark says that none can follow."""
    a, b = left.alias("a"), right.alias("b")
    near = F.expr(f"a.{key} = b.{key} AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL {within}")
    return a.join(b, near, how).select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.col("a.ts").alias("first_ts"), F.col("b.ts").alias("then_ts"))


def running_totals(df: DataFrame, key: str) -> DataFrame:
    """After each batch the count and sum so far of every key in it, held as custom state."""

    def add(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for rows in batches:
            n, total = n + len(rows), total + float(rows["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [group[0]], "n": [n], "total": [total]})

    out = f"{key} {df.schema[key].dataType.simpleString()}, n long, total double"
    return df.groupBy(key).applyInPandasWithState(add, out, "n long, total double", "update", GroupStateTimeout.NoTimeout)


def closing_sessions(df: DataFrame, gap: int, key: str) -> DataFrame:
    """Sessions as sessions() gives them, held as custom state: a key's open session goes out, and its state goes, once the
    watermark has passed the gap, in microseconds, after its last event. Needs a watermark on ts and no late events."""

    def add(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            begin, last, n = state.get
            state.remove()
            yield pd.DataFrame({key: [group[0]], "begin": [begin], "last": [last], "n": [n]})
            return
        times = [rows["us"].to_numpy() for rows in batches]
        if state.exists:
            begin, last, n = state.get
            times.append(np.array([last]))
        times = np.sort(np.concatenate(times))
        # where sessions start; the state's last event counts as one that it holds already
        start = np.concatenate([[0], np.flatnonzero(np.diff(times) >= gap) + 1])
        end = np.concatenate([start[1:], [len(times)]])
        first, final, size = times[start], times[end - 1], end - start
        if state.exists:
            first[0], size[0] = begin, n + size[0] - 1
        state.update((int(first[-1]), int(final[-1]), int(size[-1])))
        # no timeout lies before the watermark
        state.setTimeoutTimestamp(max((int(final[-1]) + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if len(start) > 1:
            yield pd.DataFrame({key: np.repeat(np.array([group[0]], object), len(start) - 1), "begin": first[:-1], "last": final[:-1], "n": size[:-1]})

    out = f"{key} {df.schema[key].dataType.simpleString()}, begin long, last long, n long"
    found = df.select(key, "ts", F.unix_micros("ts").alias("us")).groupBy(key).applyInPandasWithState(add, out, "begin long, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.timestamp_micros("begin").alias("start"), F.timestamp_micros(F.col("last") + gap).alias("end"), key, "n")


class _Totals(StatefulProcessor):
    """The count and sum so far of a key, in a value state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", T.StructType().add("n", T.LongType()).add("total", T.DoubleType()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, total = self.totals.get() if self.totals.exists() else (0, 0.0)
        for batch in rows:
            n, total = n + len(batch), total + float(batch["value"].sum())
        self.totals.update((n, total))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def running_totals_v2(df: DataFrame, key: str) -> DataFrame:
    """As running_totals(), with the newer interface, which needs the RocksDB state store."""
    out = T.StructType().add("key", df.schema[key].dataType).add("n", T.LongType()).add("total", T.DoubleType())
    return df.groupBy(key).transformWithStateInPandas(_Totals(), out, "Update", "None").withColumnRenamed("key", key)


class _Baskets(StatefulProcessor):
    """A key's open session: when it began and last went on in a value state, how often each kind of event came in a map
    state, its last values in a list state, and a timer for when it ends."""

    def __init__(self, gap: int, last: int):
        self.gap, self.most = gap, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.span = handle.getValueState("span", T.StructType().add("begin", T.LongType()).add("last", T.LongType()))
        self.kinds = handle.getMapState("kinds", T.StructType().add("kind", T.StringType()), T.StructType().add("n", T.LongType()))
        self.values = handle.getListState("values", T.StructType().add("value", T.DoubleType()))

    def _open(self) -> tuple[list | None, dict, list]:
        """What the states hold: begin and last of the open session or None, its kinds and its last values."""
        span = self.span.get()
        if span is None:
            return None, {}, []
        return list(span), {k[0]: v[0] for k, v in self.kinds.iterator()}, [v[0] for v in self.values.get()]

    def _out(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["key", "begin", "last", "kinds", "values"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Each access to state is a message to the JVM and back, so states are read once and written once, not by event."""
        span, kinds, values = self._open()
        stored, closed = dict(kinds), []
        was_open, cleared = span is not None, False
        for us, kind, value in sorted((r for batch in rows for r in zip(batch["us"].tolist(), batch["event_type"], batch["value"].tolist())), key=lambda r: r[0]):
            if span and us - span[1] >= self.gap:
                closed.append((key[0], *span, kinds, values))
                span, kinds, values, cleared = None, {}, [], True
            span = [span[0] if span else us, us]
            kinds[kind] = kinds.get(kind, 0) + 1
            values = [*values, value][-self.most :]
        if was_open and cleared:
            self.kinds.clear()
            stored = {}
        self.span.update(tuple(span))
        for kind, n in kinds.items():
            if stored.get(kind) != n:
                self.kinds.updateValue((kind,), (n,))
        self.values.put([(v,) for v in values])
        if was_open:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(max((span[1] + self.gap) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return self._out(closed)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        span, kinds, values = self._open()
        if span is None:
            return self._out([])
        for state in (self.span, self.kinds, self.values):
            state.clear()
        return self._out([(key[0], *span, kinds, values)])

    def close(self) -> None:
        pass


def baskets(df: DataFrame, gap: int, key: str, *, last: int = 3) -> DataFrame:
    """Sessions of a key with a gap in microseconds: start, end, how many events of each kind, and the last values. A
    session's states are cleared when its timer goes off, as the watermark passes its end. Needs a watermark on ts, the
    RocksDB state store, and no late events."""
    out = T.StructType().add("key", df.schema[key].dataType).add("begin", T.LongType()).add("last", T.LongType()).add("kinds", T.MapType(T.StringType(), T.LongType())).add("values", T.ArrayType(T.DoubleType()))
    found = df.select(key, "ts", F.unix_micros("ts").alias("us"), "event_type", "value").groupBy(key).transformWithStateInPandas(_Baskets(gap, last), out, "Append", "EventTime")
    return found.select(F.timestamp_micros("begin").alias("start"), F.timestamp_micros(F.col("last") + gap).alias("end"), F.col("key").alias(key), "kinds", F.col("values").alias("last_values"))


def run_once(df: DataFrame, checkpoint: str, mode: str, sink: Callable[[DataFrame, int], Any]) -> list[dict]:
    """Runs a stream over what there is, each batch to a sink; returns the progress reports."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return [dict(p) if isinstance(p, dict) else p.jsonValue if hasattr(p, "jsonValue") else p for p in query.recentProgress]
