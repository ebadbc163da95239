"""Rolling features of the last ``n`` readings of a machine, on a stream.

Arbitrary keyed state (``transformWithState``): per machine a ring of its last n - 1 readings and the
readings that wait for the watermark. Readings may arrive in any order within the watermark delay; each is
emitted once the watermark has passed its time, in (ts, event_id) order, with the frame that a batch window of
the machine's rows would give it. One event-time timer per machine stands at its earliest waiting reading.

State per machine is n - 1 readings plus what arrives within one watermark delay. With ``idle`` set, a machine
that sends nothing for that long (in event time) loses its ring, so retired machines do not pile up; it starts
afresh when it comes back. State and timers live in RocksDB under the query's checkpoint: a restarted query goes
on where it stopped. Readings behind the watermark are dropped by Spark.

Defined results: readings without a time or machine are left out. Null values are skipped by mean, deviation and
maximum, as in SQL; the deviation of fewer than two values is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

VALUES = ("temperature", "vibration", "pressure")
STATE = "ts_us bigint, event_id bigint, " + ", ".join(f"{c} double" for c in VALUES)
OUTPUT = ("event_id bigint, machine_id string, ts timestamp, n_rows int, temp_mean double, temp_std double, "
          "vib_mean double, vib_max double, press_mean double")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _known(frame, at: int) -> list[float]:
    return [r[at] for r in frame if r[at] is not None and r[at] == r[at]]


def _mean(values: list[float]) -> float | None:
    return sum(values) / len(values) if values else None


def _deviation(values: list[float]) -> float:
    if len(values) < 2:
        return 0.0
    mean = sum(values) / len(values)
    return (sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5


class LastReadings(StatefulProcessor):
    """Emits every reading with the aggregates of the machine's last ``n`` readings."""

    def __init__(self, n: int, idle_us: int | None):
        self.n, self.idle_us = n, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", STATE)
        self.waiting = handle.getListState("waiting", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Readings only wait here; the timer set at the earliest of them emits them."""
        new = [tuple(r) for some in rows for r in some[["ts_us", "event_id", *VALUES]].itertuples(index=False, name=None)]
        new = [(int(t), int(e), *[None if v is None or v != v else float(v) for v in values]) for t, e, *values in new]
        if new:
            self.waiting.appendList(new)
            self._set_timer(min(r[0] for r in new))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in waiting if r[0] <= upto]
        later = waiting[len(due):]
        ring = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        if not due:
            if not later and ring and self.idle_us is not None and ring[-1][0] + self.idle_us <= upto:
                self.ring.clear()
            yield pd.DataFrame()
            return
        out = []
        for r in due:
            if ring and self.idle_us is not None and r[0] - ring[-1][0] >= self.idle_us:
                ring = []  # the same cut, whether the timer or the next reading comes first
            frame = [*ring, r]
            temperature, vibration = _known(frame, 2), _known(frame, 3)
            out.append((r[1], key[0], pd.Timestamp(r[0], unit="us"), len(frame), _mean(temperature), _deviation(temperature),
                        _mean(vibration), max(vibration, default=None), _mean(_known(frame, 4))))
            ring = frame[-(self.n - 1):] if self.n > 1 else []
        if ring:
            self.ring.put(ring)
        if later:
            self.waiting.put(later)
            self._set_timer(later[0][0])
        else:
            self.waiting.clear()
            if ring and self.idle_us is not None:
                self._set_timer(ring[-1][0] + self.idle_us)
        yield pd.DataFrame(out, columns=["event_id", "machine_id", "ts", "n_rows", "temp_mean", "temp_std", "vib_mean",
                                         "vib_max", "press_mean"])

    def _set_timer(self, at_us: int) -> None:
        """Timers count in milliseconds; rounded up, so that the reading is due when it fires."""
        self.handle.registerTimer(-(-at_us // 1000))

    def close(self) -> None:
        pass


def rolling_stream(readings: DataFrame, n: int = 6, delay: str = "24 hours", idle_seconds: int | None = None) -> DataFrame:
    """readings (streaming): event_id, machine_id, ts, temperature, vibration, pressure."""
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = readings.where(F.col("ts").isNotNull() & F.col("machine_id").isNotNull()).withWatermark("ts", delay).select(
        "ts", F.unix_micros("ts").alias("ts_us"), F.col("event_id").cast("long").alias("event_id"), "machine_id",
        *[F.col(c).cast("double").alias(c) for c in VALUES])
    return rows.groupBy("machine_id").transformWithStateInPandas(
        LastReadings(n, idle_seconds * 1_000_000 if idle_seconds is not None else None), OUTPUT, "Append", "EventTime")
