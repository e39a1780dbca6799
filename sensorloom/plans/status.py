"""Freshness of predictions, markers, and the state of failing entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.timeops import datediff_boundary, newest, time_text
from sensorloom.plans.clock import Clock
from sensorloom.schemas import FAILURE_TYPES

_PREDICTION = (
    "entity_id",
    "prediction_timestamp",
    "predicted_failure_type",
    "predicted_hours_to_failure",
    "ttf_model_used",
    "last_updated",
)


def prediction_age_by_entity(cache: DataFrame, tel: DataFrame) -> DataFrame:
    """Minutes from each prediction to the newest reading of its own entity."""
    last = tel.groupBy("entity_id").agg(F.max("timestamp").alias("latest_telemetry_time"))
    age = datediff_boundary("minute", "prediction_timestamp", "latest_telemetry_time")
    return (
        cache.select(*_PREDICTION)
        .join(last, "entity_id", "left")
        .withColumn("age_minutes", age)
        .orderBy("entity_id")
    )


def prediction_age_fleet(
    cache: DataFrame,
    tel: DataFrame,
    *,
    fresh_min: int = 5,
    stale_min: int = 60,
    day: str | None = None,
) -> DataFrame:
    """Age against the newest reading of the fleet, its colour, and a display key.

    A prediction newer than every reading counts as fresh with age zero.
    """
    last = newest(tel, "timestamp", day=day)
    dated = cache.select(*_PREDICTION).withColumn("latest_telemetry_time", last)
    behind = F.col("latest_telemetry_time") >= F.col("prediction_timestamp")
    ahead = F.col("latest_telemetry_time") < F.col("prediction_timestamp")
    age = datediff_boundary("minute", "prediction_timestamp", "latest_telemetry_time")
    return dated.select(
        "*",
        F.when(behind, age).otherwise(F.lit(0).cast("long")).alias("age_minutes"),
        F.when(behind & (age <= fresh_min), "green")
        .when(behind & (age < stale_min), "orange")
        .when(ahead, "green")
        .otherwise("red")
        .alias("age_color"),
        F.concat("entity_id", F.lit("_"), time_text("last_updated", millis=True)).alias(
            "prediction_key"
        ),
    ).orderBy("entity_id")


def stale_check(ages: DataFrame, *, limit_min: int = 60) -> DataFrame:
    """One row: the greatest age and whether it calls for a refresh."""
    greatest = F.max("age_minutes")
    return ages.agg(
        greatest.alias("max_age_minutes"),
        F.coalesce(greatest >= limit_min, F.lit(False)).alias("is_stale"),
    )


def markers_list(markers: DataFrame, *, text_time: bool = False) -> DataFrame:
    """First-failure markers in time order, or as text in entity order."""
    if text_time:
        return markers.select(
            "entity_id", time_text("first_failure_time").alias("first_failure_time"), "failure_type"
        ).orderBy("entity_id", "failure_type")
    return markers.select("entity_id", "first_failure_time", "failure_type", "last_updated").orderBy(
        F.col("first_failure_time").asc_nulls_last(), "entity_id", "failure_type"
    )


def active_failures(config: DataFrame, state: DataFrame) -> DataFrame:
    """Enabled failures already in effect on the timeline, with their start time."""
    clock = Clock.of(state)
    eff = F.col("effective_from_epoch")
    return config.filter(F.col("enabled") & (eff <= clock.epoch)).select(
        "entity_id",
        "failure_type",
        clock.time_of(eff).alias("started_at"),
        eff.alias("epoch_started"),
        F.col("updated_at").alias("last_updated"),
    )


def active_failures_list(active: DataFrame) -> DataFrame:
    """Active failures, newest first."""
    return active.select("entity_id", "failure_type", "started_at", "last_updated").orderBy(
        F.col("started_at").desc_nulls_first(), "entity_id"
    )


def trace_lengths(failure_traces: DataFrame) -> DataFrame:
    """Number of rows of every failure trace; a type without rows counts zero."""
    spark = failure_traces.sparkSession
    named = F.array(*[F.lit(t) for t in FAILURE_TYPES])
    types = spark.range(1).select(F.explode(named).alias("failure_type"))
    counted = failure_traces.groupBy("failure_type").agg(F.count(F.lit(1)).alias("max_epochs"))
    return types.join(counted, "failure_type", "left").select(
        "failure_type", F.coalesce("max_epochs", F.lit(0)).cast("long").alias("max_epochs")
    )


def failure_status(config: DataFrame, lengths: DataFrame) -> DataFrame:
    """Enabled failures with their cursor, off line once it is past the trace.

    Single ticks stop the cursor at the end of the trace and bulk backfill
    runs past it, so an entity goes off line only after a bulk backfill.
    """
    past_end = F.col("failure_next_epoch") > F.col("max_epochs")
    return (
        config.filter("enabled")
        .join(lengths, "failure_type")
        .select(
            "entity_id",
            "failure_type",
            "effective_from_epoch",
            F.col("failure_next_epoch").alias("current_failure_epoch"),
            "max_epochs",
            F.when(past_end, "OFFLINE").otherwise("ACTIVE").alias("status"),
        )
        .orderBy("entity_id")
    )
