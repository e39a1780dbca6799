"""Keeping predictions and first-failure markers up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.timeops import as_of_column, time_slice
from sensorloom.operators.keyed import KEPT, delete_not_in, upsert, upsert_changes
from sensorloom.schemas import NORMAL


def upsert_predictions(cache: DataFrame, predictions: DataFrame, *, as_of=None) -> DataFrame:
    """The cache with the newest prediction of every entity written into it."""
    stamped = predictions.withColumn("last_updated", as_of_column(as_of))
    return upsert(cache, stamped, "entity_id", order="prediction_timestamp")


def prediction_changes(cache: DataFrame, predictions: DataFrame, *, as_of=None) -> DataFrame:
    """The same content with ``change``: what the write does to each entity."""
    stamped = predictions.withColumn("last_updated", as_of_column(as_of))
    return upsert_changes(
        cache, stamped, "entity_id", order="prediction_timestamp", stamps=("last_updated",)
    )


def new_failure_markers(cache: DataFrame, markers: DataFrame, *, as_of=None) -> DataFrame:
    """Markers for failures that have none of their type yet.

    Uniqueness is per entity and type: a changed type adds a second marker.
    """
    failing = cache.filter(F.col("predicted_failure_type") != NORMAL).select(
        "entity_id",
        time_slice("prediction_timestamp").alias("first_failure_time"),
        F.col("predicted_failure_type").alias("failure_type"),
    )
    fresh = failing.join(
        markers.select("entity_id", "failure_type"), ["entity_id", "failure_type"], "left_anti"
    )
    return fresh.select(
        "entity_id", "first_failure_time", "failure_type", as_of_column(as_of).alias("last_updated")
    )


def clear_markers(markers: DataFrame, cache: DataFrame) -> DataFrame:
    """Markers of the entities whose cached prediction is still a failure."""
    failing = cache.filter(F.col("predicted_failure_type") != NORMAL)
    return delete_not_in(markers, failing, "entity_id")


def refresh_markers(markers: DataFrame, cache: DataFrame, *, as_of=None) -> DataFrame:
    """New markers added, then cleared ones removed."""
    grown = markers.unionByName(new_failure_markers(cache, markers, as_of=as_of))
    return clear_markers(grown, cache)


def markers_from_changes(markers: DataFrame, changes: DataFrame, *, as_of=None) -> DataFrame:
    """``refresh_markers`` for the entities that a write has named; the others' stay.

    Reads the rows that the write has made, not the cache.
    """
    named = changes.filter(F.col("change") != KEPT).drop("change")
    entities = named.select("entity_id")
    theirs = markers.join(entities, "entity_id", "left_semi")
    others = markers.join(entities, "entity_id", "left_anti")
    return others.unionByName(refresh_markers(theirs, named, as_of=as_of))


def event_markers(classified: DataFrame, *, as_of=None) -> DataFrame:
    """Markers as a refresh after every slice would leave them, from slices in any order.

    An entity has one for each type among its slices after the last normal one, at
    the first slice of that type. ``classified`` has entity_id, feature_timestamp and
    predicted_failure_type of every slice. Aggregates only: no history is ordered.
    """
    kind, time = F.col("predicted_failure_type"), F.col("feature_timestamp")
    normal = classified.groupBy("entity_id").agg(F.max(F.when(kind == NORMAL, time)).alias("_normal"))
    c, n = classified.alias("c"), normal.alias("n")
    later = F.col("_normal").isNull() | (time > F.col("_normal"))
    failing = c.join(n, F.col("c.entity_id").eqNullSafe(F.col("n.entity_id"))).filter((kind != NORMAL) & later)
    first = failing.groupBy(F.col("c.entity_id").alias("entity_id"), kind.alias("failure_type"))
    return first.agg(F.min(time).alias("_first")).select(
        "entity_id",
        time_slice("_first").alias("first_failure_time"),
        "failure_type",
        as_of_column(as_of).alias("last_updated"),
    )
