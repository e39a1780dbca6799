"""Live status of every entity: on line while it reports, off line once it falls silent.

Keyed state holds the newest reading of an entity; an event-time timer stands where the fleet
will have moved on too far without another one. A reading puts the entity on line, the
timer takes it off line, and only such changes leave the stream, so the last row of each
entity is its status as ``serving.fleet_status`` has it at the watermark. With a delay of zero
the watermark is the fleet's newest reading; readings out of order within ``delay`` count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sensorloom.operators.windows import latest_per
from sensorloom.schemas import SENSORS
from sensorloom.session import ship_package
from sensorloom.streaming import state
from sensorloom.streaming.live import with_event_time

ONLINE, OFFLINE = "ONLINE", "OFFLINE"
# A change of status; ``order`` rises with the time at which it is known.
CHANGES = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        *[T.StructField(s, T.DoubleType()) for s in SENSORS],
        T.StructField("order", T.LongType()),
    ]
)
_SECOND = 1_000_000


class LiveStatus(StatefulProcessor):
    """One entity's newest reading and status."""

    def __init__(self, fresh_s: int):
        self.fresh_s = fresh_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = ", ".join(f"{s} double" for s in SENSORS)
        self.last = handle.getValueState("last", f"micros bigint, {fields}, status string")

    def _ends(self, micros: int) -> int:
        """The watermark in milliseconds from which a reading is too old: seconds are compared whole."""
        return (micros // _SECOND + self.fresh_s + 1) * 1000

    def _change(self, key, row: tuple, order: int) -> pd.DataFrame:
        micros, *values, status = row
        time = pd.to_datetime([micros], unit="us")
        made = {"entity_id": [key[0]], "status": [status], "timestamp": time}
        made |= {s: [v] for s, v in zip(SENSORS, values)}
        return pd.DataFrame(made | {"order": [order]})[CHANGES.names].astype({s: "float64" for s in SENSORS})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get()
        newest = None if known is None else tuple(known)
        for batch in rows:
            at = batch["micros"].idxmax()
            if newest is None or batch["micros"][at] >= newest[0]:
                values = [None if pd.isna(batch[s][at]) else float(batch[s][at]) for s in SENSORS]
                newest = (int(batch["micros"][at]), *values, None)
        if known is not None and newest[0] == known[0]:
            return
        ends = self._ends(newest[0])
        late = timerValues.getCurrentWatermarkInMs() >= ends
        newest = (*newest[:-1], OFFLINE if late else ONLINE)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not late:
            self.handle.registerTimer(ends - 1)
        self.last.update(newest)
        yield self._change(key, newest, 2 * newest[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest = tuple(self.last.get())
        if newest[-1] == OFFLINE:
            return
        if timerValues.getCurrentWatermarkInMs() < self._ends(newest[0]):
            self.handle.registerTimer(self._ends(newest[0]))
            return
        newest = (*newest[:-1], OFFLINE)
        self.last.update(newest)
        yield self._change(key, newest, 2 * newest[0] + 1)

    def close(self) -> None:
        pass


def status_changes(stream: DataFrame, *, fresh_s: int = 10, delay: str = "0 seconds") -> DataFrame:
    """Rows of ``CHANGES`` as they happen; update mode."""
    ship_package(stream.sparkSession)
    timed = with_event_time(stream.filter(F.col("timestamp").isNotNull()), delay)
    readings = timed.select("entity_id", F.unix_micros("_event_time").alias("micros"), *SENSORS, "_event_time")
    return readings.groupBy("entity_id").transformWithStateInPandas(
        LiveStatus(fresh_s), CHANGES, "Update", "EventTime"
    )


def stream_status(
    stream: DataFrame, path: str, *, checkpoint: str, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Keeps the changes of each batch in a folder of its number, so a repeated batch adds nothing."""

    def each(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return state.start(status_changes(stream, **options), each, checkpoint=checkpoint, trigger=trigger)


def status_now(changes: DataFrame) -> DataFrame:
    """The status of every entity from all changes."""
    last = latest_per(changes.select(*CHANGES.names), "entity_id", "order")
    return last.select("entity_id", "status", "timestamp", *SENSORS)
