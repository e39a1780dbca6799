"""Slice statistics and the temporal features of every entity.

The window functions run on slice statistics, never on readings: whatever
share of the readings one entity holds, it brings one row per slice of
history to its window task (a year of 5-minute slices is 105,000 rows).
``carry`` shortens that to the slices that are new since the last run, and
``segment_days`` cuts longer histories into parts that run as separate tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.functions.timeops import time_slice
from sensorloom.operators.windows import (
    acceleration,
    by_entity_time,
    cumulative_sum,
    delta,
    latest_per,
    rolling_mean,
    slope,
)
from sensorloom.schemas import SENSORS, TEMPORAL_FEATURES

# Derived values that read zero where there is no earlier slice. Means and
# standard deviations are not among them: a NULL there marks a missing feature.
_ZERO_WHEN_NULL = (
    "slope_engine_temp",
    "slope_trans_oil_pressure",
    "slope_battery_voltage",
    "cumulative_volatility",
    "elevated_window_count",
    "volatility_delta",
    "temp_acceleration",
    "pressure_acceleration",
)


def window_stats(tel: DataFrame, *, minutes: int = 5) -> DataFrame:
    """Newest time, means, sample deviations and row count per entity and slice."""
    sliced = tel.select(
        "entity_id",
        time_slice("timestamp", minutes=minutes).alias("window_start"),
        "timestamp",
        *SENSORS,
    )
    return sliced.groupBy("entity_id", "window_start").agg(
        F.max("timestamp").alias("feature_timestamp"),
        *[F.avg(s).alias(f"avg_{s}") for s in SENSORS],
        *[F.stddev_samp(s).alias(f"stddev_{s}") for s in SENSORS],
        F.count(F.lit(1)).alias("record_count"),
    )


def _with_carry(stats: DataFrame, carry: DataFrame | None) -> DataFrame:
    """Statistics led by the carried rows, whose running totals are a base."""
    no_base = {
        "base_volatility": F.lit(None).cast("double"),
        "base_elevated": F.lit(None).cast("long"),
        "carried": F.lit(False),
    }
    if carry is None:
        return stats.withColumns(no_base)
    return stats.withColumns(no_base).unionByName(carry.withColumn("carried", F.lit(True)))


def _totalled(rows: DataFrame, volatility: float) -> DataFrame:
    """What each row adds to the running totals: a carried row, its base."""
    own = F.col("stddev_battery_voltage")
    elevated = F.when(own > volatility, 1).otherwise(0).cast("long")
    return rows.withColumns(
        {
            "_volatility": F.when(F.col("carried"), F.col("base_volatility")).otherwise(own),
            "_elevated": F.when(F.col("carried"), F.col("base_elevated")).otherwise(elevated),
        }
    )


_KEY = ("entity_id",)


def _running(rows: DataFrame, key, columns, minutes: float) -> DataFrame:
    """Derived columns over the rows of each key in time order, carried rows removed."""
    w = by_entity_time(key)
    derived = rows.select(
        *columns,
        "carried",
        slope("avg_engine_temp", w, minutes).alias("slope_engine_temp"),
        slope("avg_trans_oil_pressure", w, minutes).alias("slope_trans_oil_pressure"),
        slope("avg_battery_voltage", w, minutes).alias("slope_battery_voltage"),
        rolling_mean("avg_engine_temp", w).alias("rolling_avg_engine_temp"),
        rolling_mean("avg_trans_oil_pressure", w).alias("rolling_avg_trans_oil_pressure"),
        cumulative_sum("_volatility", w).alias("cumulative_volatility"),
        cumulative_sum("_elevated", w).alias("elevated_window_count"),
        delta("stddev_battery_voltage", w).alias("volatility_delta"),
        acceleration("avg_engine_temp", w).alias("temp_acceleration"),
        acceleration("avg_trans_oil_pressure", w).alias("pressure_acceleration"),
    )
    return derived.filter(~F.col("carried")).drop("carried")


def _segments(stats: DataFrame, volatility: float, days: int) -> DataFrame:
    """Statistics with a segment number, each segment led by what came before it.

    A segment needs the two rows before it and the running totals up to them.
    Per segment there is one summary row: its last two rows and its totals.
    Only summaries are ordered across the whole history of an entity.
    """
    day = F.datediff(F.to_date("feature_timestamp"), F.lit("1970-01-01").cast("date"))
    # Rows without a time come after all others: a last segment of their own.
    segment = F.coalesce(F.floor(day / days), F.lit(2**62)).cast("long")
    cut = stats.withColumn("segment", segment)
    row = F.struct(*stats.columns)
    backwards = Window.partitionBy("entity_id", "segment").orderBy(
        F.col("feature_timestamp").desc_nulls_first()
    )
    own = F.col("stddev_battery_voltage")
    summary = (
        cut.select("entity_id", "segment", row.alias("row"), own, F.row_number().over(backwards).alias("back"))
        .groupBy("entity_id", "segment")
        .agg(
            F.max_by("row", F.when(F.col("back") == 1, 1)).alias("last"),
            F.max_by("row", F.when(F.col("back") == 2, 1)).alias("before"),
            F.sum(own).alias("volatility"),
            F.sum(F.when(own > volatility, 1).otherwise(0)).alias("elevated"),
        )
    )
    history = Window.partitionBy("entity_id").orderBy("segment")
    past = history.rowsBetween(Window.unboundedPreceding, -1)
    newer = F.lag("last").over(history)
    older = F.coalesce(F.lag("before").over(history), F.lag("last", 2).over(history))
    led = summary.select(
        "entity_id",
        "segment",
        newer.alias("newer"),
        older.alias("older"),
        F.sum("volatility").over(past).alias("base_volatility"),
        F.sum("elevated").over(past).alias("base_elevated"),
    ).filter(F.col("newer").isNotNull())

    # The older row bears the totals; the newer one does where it is alone.
    def carried(which: str, bears: Column) -> DataFrame:
        return led.filter(F.col(which).isNotNull()).select(
            *[F.col(which)[c].alias(c) for c in stats.columns],
            "segment",
            F.when(bears, F.col("base_volatility")).alias("base_volatility"),
            F.when(bears, F.col("base_elevated")).alias("base_elevated"),
        )

    carry = carried("older", F.lit(True)).unionByName(carried("newer", F.col("older").isNull()))
    return _with_carry(cut, carry)


def running_features(
    stats: DataFrame,
    *,
    minutes: float = 5.0,
    volatility: float = 0.7,
    carry: DataFrame | None = None,
    segment_days: int | None = None,
) -> DataFrame:
    """All feature columns of every slice, thin slices included.

    ``carry`` holds, per entity, the last two slices already processed and the
    running totals up to them (see ``feature_carry``). ``segment_days`` splits
    the history of an entity over several tasks; it reads ``stats`` twice,
    which Spark serves from one shuffle or one written table.
    """
    if segment_days is None:
        rows, key = _with_carry(stats, carry), _KEY
    elif carry is None:
        rows, key = _segments(stats, volatility, segment_days), (*_KEY, "segment")
    else:
        raise ValueError("carry and segment_days exclude each other")
    return _running(_totalled(rows, volatility), key, stats.columns, minutes)


def temporal_features(
    stats: DataFrame,
    *,
    minutes: float = 5.0,
    volatility: float = 0.7,
    min_records: int = 12,
    carry: DataFrame | None = None,
    segment_days: int | None = None,
) -> DataFrame:
    """The sixteen features per entity and slice.

    Thin slices still feed the lags and running values of later slices; they
    are dropped only at the end.
    """
    rows = running_features(
        stats, minutes=minutes, volatility=volatility, carry=carry, segment_days=segment_days
    )
    full = rows.filter(F.col("record_count") >= min_records)
    return full.select(
        "entity_id",
        "feature_timestamp",
        *[
            F.coalesce(c, F.lit(0)).alias(c) if c in _ZERO_WHEN_NULL else F.col(c)
            for c in TEMPORAL_FEATURES
        ],
    )


def latest_features(features: DataFrame) -> DataFrame:
    """Newest feature row of every entity."""
    return latest_per(features, "entity_id", "feature_timestamp")


def feature_carry(
    stats: DataFrame, *, volatility: float = 0.7, carry: DataFrame | None = None
) -> DataFrame:
    """What later slices need to know of ``stats``: two rows per entity.

    The older of the two rows bears the running totals up to and including
    the newer one, so that a running sum over carried and new rows is right
    for every new row.
    """
    backwards = Window.partitionBy("entity_id").orderBy(F.col("feature_timestamp").desc_nulls_first())
    whole = Window.partitionBy("entity_id")
    rows = _totalled(_with_carry(stats, carry), volatility)
    ranked = rows.select(
        *stats.columns,
        F.sum("_volatility").over(whole).alias("_total_volatility"),
        F.sum("_elevated").over(whole).alias("_total_elevated"),
        F.row_number().over(backwards).alias("_back"),
        F.count(F.lit(1)).over(whole).alias("_rows"),
    )
    kept = ranked.filter(F.col("_back") <= 2)
    bearer = F.col("_back") == F.least(F.col("_rows"), F.lit(2))
    return kept.select(
        *stats.columns,
        F.when(bearer, F.col("_total_volatility")).alias("base_volatility"),
        F.when(bearer, F.col("_total_elevated")).cast("long").alias("base_elevated"),
    )
