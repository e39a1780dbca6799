"""Time expressions over zone-free timestamps."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ORIGIN = datetime(1970, 1, 1)

# Name of the partition column of tables laid out by day.
DAY = "date"
_UNIT_MICROS = {
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}


def ntz(value: datetime | str) -> Column:
    """A zone-free timestamp literal."""
    return F.lit(str(value)).cast("timestamp_ntz")


def _as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def time_slice(column, *, minutes: int = 5, edge: str = "start") -> Column:
    """Start or exclusive end of the epoch-aligned slice holding ``column``.

    A NULL timestamp gives a NULL slice: Spark's ``window`` alone would drop
    the row, so it is fed a stand-in and the result blanked again. Slices of
    two different columns belong in two separate projections, as ``window``
    allows one time column per operator.
    """
    if edge not in ("start", "end"):
        raise ValueError(f"edge must be 'start' or 'end', not {edge!r}")
    column = _as_column(column)
    slices = F.window(F.coalesce(column, ntz(_ORIGIN)), f"{minutes} minutes")
    return F.when(column.isNotNull(), slices[edge])


def datediff_boundary(unit: str, a, b) -> Column:
    """How many ``unit`` boundaries lie between ``a`` and ``b``, signed."""
    width = F.lit(_UNIT_MICROS[unit])

    def boundary(column) -> Column:
        micros = F.timestamp_diff("MICROSECOND", ntz(_ORIGIN), _as_column(column))
        return micros - F.pmod(micros, width)

    return ((boundary(b) - boundary(a)) / width).cast("long")


def epoch_to_ts(start: Column, epoch: Column, step_seconds) -> Column:
    """Timestamp of an epoch on a timeline that starts at ``start``."""
    step = step_seconds if isinstance(step_seconds, Column) else F.lit(step_seconds)
    return start + F.lit(timedelta(seconds=1)) * (epoch * step)


def on_newest_day(df: DataFrame, day: str | None) -> DataFrame:
    """The newest day of a table laid out by the column ``day``; any other table as it is."""
    if day is None:
        return df
    return df.filter(F.col(day) == df.select(F.max(day)).scalar())


def newest(
    df: DataFrame, ts: str, *, back: timedelta | None = None, day: str | None = None
) -> Column:
    """The greatest ``ts`` as a scalar, less ``back``.

    A table laid out by ``day``, which must be the day of ``ts``, is asked for
    its newest day first, and only that day is read.
    """
    value = F.max(ts) if back is None else F.max(ts) - F.lit(back)
    return on_newest_day(df, day).select(value.alias("newest")).scalar()


def between_times(
    df: DataFrame, ts: str, first: Column, last: Column | None = None, *, day: str | None = None
) -> DataFrame:
    """Rows from ``first`` to ``last``, both included.

    Parquet files keep no usable statistics for zone-free timestamps, so the
    range is also put on ``day``, the column a table is laid out by, where it
    prunes whole folders. A column is never taken for one by its name.
    """
    inside = F.col(ts) >= first
    if last is not None:
        inside = inside & (F.col(ts) <= last)
    if day is not None:
        inside = inside & (F.col(day) >= F.to_date(first))
        if last is not None:
            inside = inside & (F.col(day) <= F.to_date(last))
    return df.filter(inside)


def trailing(
    df: DataFrame, ts: str, *, hours: float, as_of=None, day: str | None = None
) -> DataFrame:
    """Rows of the last ``hours`` before ``as_of``, or before the newest ``ts``."""
    back = timedelta(hours=hours)
    if as_of is None:
        bound = newest(df, ts, back=back, day=day)
    else:
        bound = as_of_column(as_of) - F.lit(back)
    return between_times(df, ts, bound, day=day)


def as_of_column(as_of) -> Column:
    """``as_of`` as a zone-free timestamp; the clock only when it is omitted."""
    if as_of is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return as_of if isinstance(as_of, Column) else ntz(as_of)


def time_text(column, *, millis: bool = False) -> Column:
    """Timestamp as text, to the second or the millisecond (truncated)."""
    pattern = "yyyy-MM-dd HH:mm:ss.SSS" if millis else "yyyy-MM-dd HH:mm:ss"
    return F.date_format(_as_column(column), pattern)
