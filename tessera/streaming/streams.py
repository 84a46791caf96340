"""Structured Streaming operators: windows, sessions, dedup, additive and stateful operators.

Watermarks need TIMESTAMP columns; event tables hold timestamps without a zone, so every operator casts.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stamped(df: DataFrame, col: str = "ts", late: str = "1 hour") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp")).withWatermark(col, late)


def sliding(df: DataFrame, keys: list[str], width: str = "7 days", slide: str = "1 day", col: str = "ts") -> DataFrame:
    """Counts and sums over sliding windows."""
    return _counts(df.groupBy(F.window(col, width, slide).alias("w"), *keys), keys)


def tumbling(df: DataFrame, keys: list[str], width: str = "1 day", col: str = "ts") -> DataFrame:
    return _counts(df.groupBy(F.window(col, width).alias("w"), *keys), keys)


def sessions(df: DataFrame, keys: list[str], gap: str = "24 hours", col: str = "ts") -> DataFrame:
    """Sessions that end after a gap since the last event."""
    return _counts(df.groupBy(F.session_window(col, gap).alias("w"), *keys), keys)


def _counts(grouped, keys: list[str]) -> DataFrame:
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def first_seen(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once across runs, remembered for as long as the watermark allows."""
    return df.dropDuplicatesWithinWatermark(keys)


def running_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, sums and means that grow with the stream (update mode)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))


def last_price(df: DataFrame, key: str, value: str, col: str = "ts") -> DataFrame:
    """The latest value of each key."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(col, "event_id")).alias("last"), F.max(col).alias("at"))


def high_water(df: DataFrame, key: str = "user_id", value: str = "value") -> DataFrame:
    """The extreme of each key and a stop that only ratchets up (90 % of it), kept as state."""

    def step(keys: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top = state.get[0] if state.exists else float("-inf")
        for pdf in pdfs:
            top = max(top, float(pdf[value].max()))
        state.update((top,))
        yield pd.DataFrame({key: [keys[0]], "high": [top], "stop": [round(top * 0.9, 6)]})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} bigint, high double, stop double", "top double", "update", GroupStateTimeout.NoTimeout)


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State kept in RocksDB while queries start in the block: operators with timers need it."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def ticks(df: DataFrame, key: str, value: str, every: str = "1 hour", col: str = "ts") -> DataFrame:
    """(key, tick, value): each key's last value of every tick that the watermark has closed. Rows later than that are dropped."""
    last = df.groupBy(F.window(col, every).alias("w"), key).agg(F.max_by(value, F.struct(col, "event_id")).alias("value"))
    return last.select(key, F.col("w.end").alias("tick"), "value")


class _Membership(StatefulProcessor):
    """Whether a key is in the set, and since which reading; a timer ends what no reading renews."""

    def __init__(self, key: str, good: float, valid_ms: int):
        self.key, self.good, self.valid = key, good, valid_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "active boolean, at bigint")

    def _out(self, key, events: list[tuple[int, str]]) -> Iterator[pd.DataFrame]:
        if events:
            at = pd.Series([t for t, _ in events]).astype("datetime64[ms]").astype("datetime64[ns]")
            yield pd.DataFrame({self.key: [key[0]] * len(events), "at": at, "kind": pd.Series([k for _, k in events], dtype=object)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        active, at = self.last.get() if self.last.exists() else (False, None)
        timer, events = at, []
        new = pd.concat(list(rows))  # one row a tick
        for tick, value in sorted(zip(new["tick"].astype("datetime64[ms]").astype("int64").tolist(), new["value"].tolist(), strict=True)):
            if at is not None and tick <= at:
                continue  # an older reading than the last one
            if active and tick > at + self.valid:
                events.append((at + self.valid, "expired"))
                active = False
            if (value > self.good) != active:
                events.append((tick, "fell" if active else "entered"))
            active, at = value > self.good, tick
        if timer is not None:
            self.handle.deleteTimer(timer + self.valid)
        self.last.update((active, at))
        self.handle.registerTimer(at + self.valid)
        yield from self._out(key, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        active, at = self.last.get()
        self.last.clear()
        yield from self._out(key, [(at + self.valid, "expired")] if active else [])

    def close(self) -> None:
        pass


def entered(readings: DataFrame, key: str, good: float, valid_hours: int) -> DataFrame:
    """(key, at, kind) of a stream of ``ticks``: "entered" when a reading is above ``good`` and the key is not in the set, "fell" when one
    is not and it is, "expired" when none has come for ``valid_hours``.

    The state of a key is two numbers and a timer, and goes when the timer fires. Needs ``rocksdb``.
    """
    kind = readings.schema[key].dataType.simpleString()
    return readings.groupBy(key).transformWithStateInPandas(_Membership(key, good, valid_hours * 3_600_000), f"{key} {kind}, at timestamp, kind string", "Append", "EventTime")


def polled(df: DataFrame, key: str, value: str, slots: int, every: int, late: str = "1 hour", col: str = "ts") -> DataFrame:
    """(key, polled_at, n, latest): what each poll of a key finds since the one before.

    Every ``every`` seconds one of ``slots`` shares of the (integer) keys is polled in turn. Shifting a key's times back by its slot makes the polls
    of all shares ends of the same windows, so one aggregation serves all.
    """
    wait = F.make_dt_interval(secs=F.pmod(F.col(key), F.lit(slots)) * every)
    shifted = df.withColumn("shifted", F.col(col).cast("timestamp") - wait).withWatermark("shifted", late)
    found = shifted.groupBy(F.window("shifted", f"{slots * every} seconds").alias("w"), key).agg(F.count("*").alias("n"), F.max_by(value, F.struct(col, "event_id")).alias("latest"))
    return found.select(key, (F.col("w.end") + wait).alias("polled_at"), "n", "latest")


def newly_entered(df: DataFrame, key: str = "user_id", active: str = "active") -> DataFrame:
    """Keys that become active in this batch and were not before."""

    def step(keys: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = bool(state.get[0]) if state.exists else False
        now = was
        for pdf in pdfs:
            now = bool(pdf.sort_values("event_id")[active].iloc[-1])
        state.update((now,))
        yield pd.DataFrame({key: [keys[0]] if now and not was else []})

    return df.groupBy(key).applyInPandasWithState(step, f"{key} bigint", "was boolean", "append", GroupStateTimeout.NoTimeout)


def shard(df: DataFrame, key: str, slots: int, slot: int) -> DataFrame:
    """The part of the keys that a polling slot is responsible for."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(slots)) == slot)


def run_to_end(stream: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return what it wrote."""
    spark = stream.sparkSession
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint or f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, mode: str, sink, checkpoint: str) -> None:
    """Run a stream over what is there now, each batch into a foreachBatch function."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
