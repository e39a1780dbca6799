"""Readings as served: newest rows, fleet status, slice means, charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.timeops import (
    as_of_column,
    datediff_boundary,
    newest,
    on_newest_day,
    time_slice,
    time_text,
    trailing,
)
from sensorloom.operators.windows import latest_per
from sensorloom.schemas import SENSORS
from sensorloom.session import cut_lineage


def latest_telemetry(tel: DataFrame) -> DataFrame:
    """Newest reading of every entity."""
    columns = ["entity_id", "timestamp", *SENSORS, "status"]
    last = latest_per(tel.select(*columns), "entity_id", "timestamp", few=["status"])
    return last.orderBy(F.col("entity_id").asc_nulls_last())


def fleet_status(
    tel: DataFrame, entities: DataFrame, *, fresh_s: int = 10, day: str | None = None
) -> DataFrame:
    """Every known entity with its newest reading and whether it is on line.

    On line means within ``fresh_s`` seconds of the newest reading of the
    whole fleet. Readings are reduced to one row per entity in one pass, which
    also gives each entity's newest known time; the fleet's is the greatest of
    these. A table laid out by ``day`` is asked for its newest day instead.
    """
    readings = tel.select("entity_id", "timestamp", *SENSORS)
    if day is not None:
        last = latest_per(readings, "entity_id", "timestamp")
        fleet = newest(tel, "timestamp", day=day)
    else:
        last = latest_per(readings, "entity_id", "timestamp", extra={"_seen": F.max("timestamp")})
        last = cut_lineage(last, "fleet")
        fleet = newest(last, "_seen")
    lag = datediff_boundary("second", F.col("timestamp"), fleet)
    return (
        entities.select("entity_id")
        .distinct()
        .join(last, "entity_id", "left")
        .select(
            "entity_id",
            F.when(F.col("timestamp").isNull(), "OFFLINE")
            .when(lag <= fresh_s, "ONLINE")
            .otherwise("OFFLINE")
            .alias("status"),
            "timestamp",
            *SENSORS,
        )
        .orderBy(F.col("entity_id").asc_nulls_last())
    )


def snapshot_at_max(tel: DataFrame, *, day: str | None = None) -> DataFrame:
    """All readings taken at the newest timestamp, without the column of the layout."""
    columns = [c for c in tel.columns if c != day]
    last = newest(tel, "timestamp", day=day)
    snapshot = on_newest_day(tel, day).filter(F.col("timestamp") == last)
    return snapshot.select(*columns).orderBy(F.col("entity_id").asc_nulls_last())


def _slice_means(tel: DataFrame, name: str, edge: str, minutes: int, *extra):
    sliced = tel.select(
        time_slice("timestamp", minutes=minutes, edge=edge).alias(name),
        "entity_id",
        "timestamp",
        *SENSORS,
    )
    means = [F.avg(s).alias(f"avg_{s}") for s in SENSORS]
    return sliced.groupBy(name, "entity_id").agg(*means, *extra)


def agg_5min(tel: DataFrame, *, minutes: int = 5) -> DataFrame:
    """Means, row count and newest time per entity and slice (named by its end)."""
    return _slice_means(
        tel,
        "bucket_time",
        "end",
        minutes,
        F.count(F.lit(1)).alias("point_count"),
        F.max("timestamp").alias("latest_timestamp"),
    )


def _chart(buckets: DataFrame, time, limit: int) -> DataFrame:
    """Oldest rows first, ties broken by entity; the limit is part of the report."""
    ordered = buckets.orderBy(
        F.col("bucket_time").asc_nulls_last(), F.col("entity_id").asc_nulls_last()
    )
    return ordered.limit(limit).select(
        time.alias("timestamp"), "entity_id", *[F.col(f"avg_{s}").alias(s) for s in SENSORS]
    )


def chart_from_agg(
    agg: DataFrame, *, hours: float, limit: int = 2000, day: str | None = None
) -> DataFrame:
    """Whole slices of the last ``hours`` from the slice table."""
    return _chart(trailing(agg, "bucket_time", hours=hours, day=day), time_text("bucket_time"), limit)


def chart_inline(
    tel: DataFrame,
    *,
    hours: float,
    limit: int = 2000,
    minutes: int = 5,
    day: str | None = None,
) -> DataFrame:
    """Slice means over readings of the last ``hours``; the first slice may be partial."""
    recent = trailing(tel, "timestamp", hours=hours, day=day)
    return _chart(
        _slice_means(recent, "bucket_time", "end", minutes), time_text("bucket_time"), limit
    )


def chart_dashboard(
    tel: DataFrame,
    *,
    hours: float = 1,
    as_of=None,
    limit: int = 300,
    minutes: int = 5,
    day: str | None = None,
) -> DataFrame:
    """Slice means since ``as_of - hours``, slices named by their start."""
    recent = trailing(tel, "timestamp", hours=hours, as_of=as_of_column(as_of), day=day)
    return _chart(
        _slice_means(recent, "bucket_time", "start", minutes), F.col("bucket_time"), limit
    )
