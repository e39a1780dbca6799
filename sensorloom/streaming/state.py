"""Features of every slice kept up to date from keyed state, readings coming in any order.

The state of an entity holds the mergeable statistics of its open slices, the two slices
before them and the running totals up to there. A micro-batch adds its readings to their
slices and gives the features of the first slice it touches and of those after it, which
are the only ones that change. A slice closes once the watermark has passed its end: it is
folded into the totals and leaves the state, so the state is bounded by the lateness
allowed, whatever the length of the history. Timers close the slices of silent entities.

Readings later than the watermark are dropped by Spark and counted in the progress of the
query (``numRowsDroppedByWatermark``); readings without a time have no slice here.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sensorloom.schemas import SENSORS, TEMPORAL_FEATURES
from sensorloom.session import ship_package
from sensorloom.streaming.live import with_event_time

_MICROS = 60_000_000
_VOLTAGE = SENSORS.index("battery_voltage")
_HEAT, _PRESSURE = SENSORS.index("engine_temp"), SENSORS.index("trans_oil_pressure")
_NEVER = np.iinfo("int64").min
# Readings of an entity that are added up at a time.
_READINGS = 10_000
# What a slice adds up to: whole numbers, then doubles.
_LONGS = ["count", "newest", *[f"n_{s}" for s in SENSORS]]
_DOUBLES = [f"{p}_{s}" for p in ("mean", "m2") for s in SENSORS]
_FEW = len(SENSORS)
# The numbers of the open slices and what those before them have left travel as bytes: state
# is read and written for every entity of a batch, number by number otherwise.
_OPEN = "start array<bigint>, parts binary, base binary"
FEATURES = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("window_start", T.TimestampNTZType()),
        T.StructField("feature_timestamp", T.TimestampNTZType()),
        T.StructField("record_count", T.LongType()),
        *[
            T.StructField(f, T.LongType() if f == "elevated_window_count" else T.DoubleType())
            for f in TEMPORAL_FEATURES
        ],
    ]
)
# The processor gives one row per entity with the numbers of all its changed slices, column by
# column: as few fields as do, since every entity's rows cross to Spark as a batch of their own.
_WHOLE = [f.name for f in FEATURES.fields if isinstance(f.dataType, (T.LongType, T.TimestampNTZType))]
_BROKEN = [f.name for f in FEATURES.fields if isinstance(f.dataType, T.DoubleType)]
_CHANGED = "entity_id string, whole array<bigint>, broken array<double>"


@dataclass
class Slices:
    """Mergeable statistics by slice, as ``plans.partials`` has them, in order of time."""

    starts: np.ndarray
    longs: np.ndarray
    doubles: np.ndarray

    @staticmethod
    def none() -> Slices:
        return Slices(np.empty(0, np.int64), np.empty((len(_LONGS), 0), np.int64), np.empty((len(_DOUBLES), 0)))

    @staticmethod
    def of(micros: np.ndarray, values: np.ndarray, width: int) -> Slices:
        """Of some readings: their times, and a row of values for each sensor."""
        starts, place = np.unique(micros // width * width, return_inverse=True)
        size = len(starts)
        longs = np.empty((len(_LONGS), size), np.int64)
        doubles = np.empty((len(_DOUBLES), size))
        longs[0] = np.bincount(place, minlength=size)
        longs[1] = _NEVER
        np.maximum.at(longs[1], place, micros)
        for i, value in enumerate(values):
            known = ~np.isnan(value)
            longs[2 + i] = np.bincount(place[known], minlength=size)
            n = np.where(longs[2 + i] > 0, longs[2 + i], np.nan)
            doubles[i] = np.bincount(place[known], value[known], size) / n
            away = value[known] - doubles[i][place[known]]
            doubles[_FEW + i] = np.bincount(place[known], away * away, size)
        return Slices(starts, longs, doubles)

    def _at(self, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Newest time, count, and by sensor count, mean and deviations at some slices, most of its own."""
        longs = np.zeros((len(_LONGS), len(starts)), np.int64)
        doubles = np.zeros((len(_DOUBLES), len(starts)))
        longs[1] = _NEVER
        place = np.searchsorted(starts, self.starts)
        longs[:, place], doubles[:, place] = self.longs, self.doubles
        return longs[1], longs[0], longs[2:], np.nan_to_num(doubles[:_FEW]), doubles[_FEW:]

    def merged(self, other: Slices) -> Slices:
        """Statistics of both sets of readings."""
        starts = np.union1d(self.starts, other.starts)
        newest_a, count_a, na, mean_a, m2_a = self._at(starts)
        newest_b, count_b, nb, mean_b, m2_b = other._at(starts)
        n = na + nb
        gap = np.where((na > 0) & (nb > 0), mean_b - mean_a, 0.0)
        weight = nb / np.maximum(n, 1)
        mean = np.where(n > 0, np.where(na > 0, mean_a, mean_b) + gap * weight, np.nan)
        m2 = m2_a + m2_b + gap * gap * na * weight
        longs = np.concatenate([[count_a + count_b], [np.maximum(newest_a, newest_b)], n])
        return Slices(starts, longs, np.concatenate([mean, m2]))

    def where(self, these: np.ndarray) -> Slices:
        return Slices(self.starts[these], self.longs[:, these], self.doubles[:, these])

    def packed(self) -> bytes:
        return self.longs.tobytes() + self.doubles.tobytes()

    @staticmethod
    def unpacked(starts: list[int], parts: bytes) -> Slices:
        size, cut = len(starts), 8 * len(starts) * len(_LONGS)
        longs = np.frombuffer(parts[:cut], np.int64).reshape(len(_LONGS), size)
        doubles = np.frombuffer(parts[cut:], np.float64).reshape(len(_DOUBLES), size)
        return Slices(np.array(starts, np.int64), longs, doubles)

    def frame(self) -> pd.DataFrame:
        columns = dict(zip(_LONGS, self.longs)) | dict(zip(_DOUBLES, self.doubles))
        return pd.DataFrame(columns, index=pd.Index(self.starts, name="start"))

    @staticmethod
    def of_frame(rows: pd.DataFrame) -> Slices:
        return Slices(rows.index.to_numpy(), rows[_LONGS].to_numpy().T, rows[_DOUBLES].to_numpy().T)


def _partials(rows: pd.DataFrame, micros: int) -> pd.DataFrame:
    """``Slices.of`` on a frame of readings."""
    values = rows[list(SENSORS)].to_numpy("float64").T
    return Slices.of(rows["micros"].to_numpy("int64"), values, micros).frame()


def _merged(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """``Slices.merged`` on frames."""
    return Slices.of_frame(left).merged(Slices.of_frame(right)).frame()


@dataclass
class Base:
    """The last two slices before some others (means by sensor, then the deviation of the voltage), and totals."""

    last: np.ndarray
    volatility: float
    elevated: int

    @staticmethod
    def none() -> Base:
        return Base(np.empty((_FEW + 1, 0)), 0.0, 0)

    def packed(self) -> bytes:
        return np.concatenate([[self.volatility, self.elevated], self.last.ravel()]).tobytes()

    @staticmethod
    def unpacked(numbers: bytes) -> Base:
        held = np.frombuffer(numbers, np.float64)
        return Base(held[2:].reshape(_FEW + 1, -1), float(held[0]), int(held[1]))


def _before(rows: np.ndarray, back: int) -> np.ndarray:
    """What stands so many places before, nothing at the beginning."""
    out = np.full_like(rows, np.nan)
    out[..., back:] = rows[..., : rows.shape[-1] - back]
    return out


def _running(held: Slices, base: Base, minutes: float, limit: float) -> dict[str, np.ndarray]:
    """The features of the open slices, which follow the two slices and the totals of ``base``."""
    n = held.longs[2:]
    mean = held.doubles[:_FEW]
    spread = np.where(n > 1, np.sqrt(held.doubles[_FEW:] / np.maximum(n - 1, 1)), np.nan)
    volts = spread[_VOLTAGE]
    led = np.concatenate([base.last, np.concatenate([mean, volts[None]])], axis=1)
    first = base.last.shape[1]
    change = led - _before(led, 1)
    slower = change - _before(change, 1)
    # A mean of what there is of the last three slices, nulls left out.
    three = np.stack([led[:_FEW], _before(led[:_FEW], 1), _before(led[:_FEW], 2)])
    known = ~np.isnan(three)
    some = known.sum(axis=0)
    rolling = np.where(some > 0, np.where(known, three, 0).sum(axis=0) / np.maximum(some, 1), np.nan)[:, first:]
    change, slower = np.nan_to_num(change[:, first:]), np.nan_to_num(slower[:, first:])
    rows = {}
    for i, s in enumerate(SENSORS):
        rows[f"avg_{s}"], rows[f"stddev_{s}"] = mean[i], spread[i]
        rows[f"slope_{s}"] = change[i] / minutes
    for i, s, short in ((_HEAT, "engine_temp", "temp"), (_PRESSURE, "trans_oil_pressure", "pressure")):
        rows[f"rolling_avg_{s}"] = rolling[i]
        rows[f"{short}_acceleration"] = slower[i]
    rows["cumulative_volatility"] = base.volatility + np.cumsum(np.nan_to_num(volts))
    rows["elevated_window_count"] = base.elevated + np.cumsum(volts > limit)
    rows["volatility_delta"] = change[_FEW]
    return rows


class RunningFeatures(StatefulProcessor):
    """One entity's open slices, and what those before them have left."""

    def __init__(self, minutes: int, min_records: int, volatility: float):
        self.minutes, self.min_records, self.volatility = minutes, min_records, volatility
        self.micros = minutes * _MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)

    def _read(self) -> tuple[Slices, Base]:
        found = self.open.get()
        if found is None:
            return Slices.none(), Base.none()
        starts, parts, base = found
        return Slices.unpacked(list(starts), bytes(parts)), Base.unpacked(bytes(base))

    def _ends(self, held: Slices) -> int | None:
        """When the first open slice closes, in milliseconds; an entity has its timer there."""
        return (int(held.starts[0]) + self.micros) // 1000 + 1 if len(held.starts) else None

    def _write(self, before: int | None, held: Slices, base: Base, rows: dict, closed_before: int) -> None:
        """Folds slices that have closed into the base and keeps the others; ``rows`` are their features."""
        done = held.starts + self.micros <= closed_before
        if done.any():
            names = [*[f"avg_{s}" for s in SENSORS], f"stddev_{SENSORS[_VOLTAGE]}"]
            last = np.concatenate([base.last, np.stack([rows[c][done] for c in names])], axis=1)[:, -2:]
            base = Base(last, rows["cumulative_volatility"][done][-1], rows["elevated_window_count"][done][-1])
            held = held.where(~done)
        ends = self._ends(held)
        if ends != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if ends is not None:
                self.handle.registerTimer(ends)
        self.open.update((held.starts.tolist(), held.packed(), base.packed()))

    def _closed_before(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, base = self._read()
        before = self._ends(held)
        touched = None
        while batch := list(islice(rows, _READINGS)):
            micros = np.array([row.micros for row in batch], np.int64)
            # A missing value is no number.
            values = np.array([[row[s] for row in batch] for s in SENSORS], np.float64)
            parts = Slices.of(micros, values, self.micros)
            held = held.merged(parts)
            touched = parts.starts[0] if touched is None else min(touched, parts.starts[0])
        found = _running(held, base, self.minutes, self.volatility)
        changed = (held.starts >= touched) & (held.longs[0] >= self.min_records)
        if changed.any():
            times = {"window_start": held.starts, "feature_timestamp": held.longs[1], "record_count": held.longs[0]}
            out = times | found
            whole, broken = (np.stack([out[c][changed] for c in names]).ravel() for names in (_WHOLE, _BROKEN))
            yield Row(entity_id=key[0], whole=whole.tolist(), broken=broken.tolist())
        self._write(before, held, base, found, self._closed_before(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, base = self._read()
        rows = _running(held, base, self.minutes, self.volatility)
        self._write(self._ends(held), held, base, rows, self._closed_before(timerValues))
        return iter(())

    def close(self) -> None:
        pass


def _restated(changed: DataFrame) -> DataFrame:
    """A row of ``FEATURES`` per changed slice."""
    size = F.size("whole") / len(_WHOLE)

    def slice_(i):
        numbers = lambda name, names: [F.get(name, i + (size * k).cast("int")).alias(c) for k, c in enumerate(names)]
        return F.struct(*numbers("whole", _WHOLE), *numbers("broken", _BROKEN))

    rows = changed.select("entity_id", F.inline(F.transform(F.sequence(F.lit(0), size.cast("int") - 1), slice_)))
    out = []
    for f in FEATURES.fields:
        value = F.col(f.name)
        if isinstance(f.dataType, T.TimestampNTZType):
            value = F.timestamp_micros(value).cast(f.dataType)
        elif isinstance(f.dataType, T.DoubleType):
            value = F.when(~F.isnan(value), value)
        out.append(value.alias(f.name))
    return rows.select(*out)


# Keyed state in Python needs this store.
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries that start inside keep their state in the store that keyed state needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def running_features(
    stream: DataFrame, *, lateness: str, minutes: int = 5, min_records: int = 12, volatility: float = 0.7
) -> DataFrame:
    """Features of every slice that a micro-batch changes, the newest version last; update mode."""
    ship_package(stream.sparkSession)
    timed = with_event_time(stream.filter(F.col("timestamp").isNotNull()), lateness)
    readings = timed.select("entity_id", F.unix_micros("_event_time").alias("micros"), *SENSORS, "_event_time")
    changed = readings.groupBy("entity_id").transformWithState(
        RunningFeatures(minutes, min_records, volatility), _CHANGED, "Update", "EventTime"
    )
    return _restated(changed)


def start(rows: DataFrame, each, *, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Runs ``each`` (rows, batch number) on every micro-batch of a stream with keyed state."""
    with keyed_state(rows.sparkSession):
        writer = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(each).start()
