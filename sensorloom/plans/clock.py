"""The timeline a stream state describes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.timeops import epoch_to_ts, ntz

STREAM = "NORMAL_TO_TELEMETRY"


@dataclass(frozen=True)
class Clock:
    """Start, step and last written epoch of a timeline.

    The state table has one row per stream name. Its values are read once, so
    that filters derived from them are literals, which scans and partition
    pruning can use; scalar subqueries over one table would be merged into a
    struct and no longer reach the scan.
    """

    epoch: int
    start: datetime
    step: int

    @staticmethod
    def of(state: DataFrame, *, stream: str = STREAM, default_step: int = 5) -> Clock:
        """The state of the stream so named, of which there must be just one."""
        named = state.filter(F.col("stream_name") == stream)
        found = named.select("next_epoch", "start_ts", "step_seconds").take(2)
        if not found or found[0].start_ts is None:
            raise ValueError(f"no state of stream {stream!r}")
        if len(found) > 1:
            raise ValueError(f"more than one state of stream {stream!r}")
        row = found[0]
        return Clock(row.next_epoch or 0, row.start_ts, row.step_seconds or default_step)

    def time_of(self, epoch: int | Column) -> Column:
        if isinstance(epoch, Column):
            return epoch_to_ts(ntz(self.start), epoch, self.step)
        return ntz(self.start + timedelta(seconds=self.step * epoch))
