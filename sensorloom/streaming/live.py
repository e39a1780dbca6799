"""Readings as a stream: slice means, newest rows and idempotent appends.

Watermarks need a zoned timestamp, so the zone-free reading time is cast at
the edge of the stream; the session zone has to be UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorloom.functions.timeops import DAY
from sensorloom.operators.windows import latest_per
from sensorloom.plans.replay import KEYS
from sensorloom.schemas import SENSORS
from sensorloom.sources.versioned import VersionedTable, append_by_day

_EVENT_TIME = "_event_time"


def with_event_time(stream: DataFrame, watermark: str) -> DataFrame:
    """The stream with its reading time as event time."""
    timed = stream.withColumn(_EVENT_TIME, F.col("timestamp").cast("timestamp"))
    return timed.withWatermark(_EVENT_TIME, watermark)


def stream_agg_5min(
    stream: DataFrame, *, watermark: str = "10 minutes", minutes: int = 5
) -> DataFrame:
    """Slice means as slices close; append mode emits each slice once."""
    window = F.window(_EVENT_TIME, f"{minutes} minutes")
    grouped = with_event_time(stream, watermark).groupBy(window.alias("slice"), "entity_id")
    return grouped.agg(
        *[F.avg(s).alias(f"avg_{s}") for s in SENSORS],
        F.count(F.lit(1)).alias("point_count"),
        F.max("timestamp").alias("latest_timestamp"),
    ).select(
        F.col("slice.end").cast("timestamp_ntz").alias("bucket_time"),
        "entity_id",
        *[f"avg_{s}" for s in SENSORS],
        "point_count",
        "latest_timestamp",
    )


def stream_latest(stream: DataFrame) -> DataFrame:
    """Newest reading of every entity, for update or complete mode."""
    return latest_per(stream, "entity_id", "timestamp")


def stream_deduplicated(stream: DataFrame, *, watermark: str) -> DataFrame:
    """Readings once per entity and time; repeats are known up to the watermark."""
    first = with_event_time(stream, watermark).dropDuplicatesWithinWatermark(
        [_EVENT_TIME, "entity_id"]
    )
    return first.drop(_EVENT_TIME)


def _writer(df: DataFrame, checkpoint: str, trigger: dict | None):
    writer = df.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True}))


def write_stream(
    df: DataFrame, path: str, *, checkpoint: str, trigger: dict | None = None, partition_by=()
) -> StreamingQuery:
    """Append the rows of a stream to a Parquet table, each exactly once."""
    writer = _writer(df, checkpoint, trigger).format("parquet").outputMode("append")
    return writer.partitionBy(*partition_by).start(path) if partition_by else writer.start(path)


def stream_append(
    stream: DataFrame, path: str, *, watermark: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append new readings, without the repeats the watermark still knows.

    Readings later than the watermark are left out: for sources in time order
    only. ``stream_append_history`` takes files in any order.
    """
    rows = stream_deduplicated(stream, watermark=watermark)
    dated = rows.withColumn(DAY, F.to_date("timestamp"))
    return write_stream(
        dated, path, checkpoint=checkpoint, trigger=trigger, partition_by=(DAY,)
    )


def append_batch(batch: DataFrame, path: str) -> None:
    """Append the readings of a batch that the table does not hold yet.

    Only the dates that the batch touches are read, so a replayed batch adds
    nothing and an old table costs nothing. A reading without a time or an
    entity is one reading too. The batch is read twice, not held.
    """
    spark = batch.sparkSession
    rows = batch.dropDuplicates(KEYS)
    table = spark.read.schema(rows.withColumn(DAY, F.to_date("timestamp")).schema).parquet(path)
    day = F.to_date("timestamp")
    first, last = batch.agg(F.min(day), F.max(day)).first()
    touched = table.filter(F.col(DAY).between(first, last) | F.col(DAY).isNull())
    there = touched.select(*[F.col(k).alias(f"_t_{k}") for k in KEYS])
    same = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in KEYS]
    append_by_day(rows.join(there, same, "left_anti"), path)


def stream_append_history(
    stream: DataFrame, path: str, *, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append new readings, checked against everything written before."""
    empty = stream.sparkSession.createDataFrame([], stream.schema)
    append_by_day(empty, path)
    writer = _writer(stream, checkpoint, trigger)
    return writer.foreachBatch(lambda batch, _: append_batch(batch, path)).start()


def stream_to_table(
    df: DataFrame, table: VersionedTable, *, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the whole result of a stream (complete mode) as a versioned table."""

    def each(batch: DataFrame, batch_id: int) -> None:
        table.write(batch, batch_id + 1)

    return _writer(df, checkpoint, trigger).outputMode("complete").foreachBatch(each).start()
