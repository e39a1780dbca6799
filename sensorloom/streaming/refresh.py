"""Predictions kept up to date while readings arrive.

Each micro-batch adds its readings to the statistics of the recent slices,
computes the features of those slices from what earlier slices carried over,
scores the newest row per entity and writes cache and markers. What a batch
reads is bounded by the lateness allowed, not by the length of the history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sensorloom.functions.timeops import time_slice
from sensorloom.plans import features, partials, refresh, scoring
from sensorloom.schemas import FIRST_FAILURE_MARKERS, PREDICTION_CACHE
from sensorloom.sources.versioned import VersionedTable

_STATS = [
    f
    for f in partials.PARTIALS.fields
    if f.name in ("entity_id", "window_start", "feature_timestamp")
]
_DOUBLE, _LONG = T.DoubleType(), T.LongType()
CARRY = T.StructType(
    _STATS
    + [
        T.StructField(f"{part}_{s}", _DOUBLE)
        for part in ("avg", "stddev")
        for s in partials.SENSORS
    ]
    + [
        T.StructField("record_count", _LONG),
        T.StructField("base_volatility", _DOUBLE),
        T.StructField("base_elevated", _LONG),
    ]
)
CLOCK = T.StructType([T.StructField("closed_before", T.TimestampNTZType())])


@dataclass(frozen=True)
class RefreshStore:
    """The tables of one refresh stream; one store belongs to one checkpoint."""

    spark: SparkSession
    path: str

    def _table(self, name: str, schema: T.StructType) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/{name}", schema)

    @property
    def recent(self) -> VersionedTable:
        return self._table("recent", partials.PARTIALS)

    @property
    def carry(self) -> VersionedTable:
        return self._table("carry", CARRY)

    @property
    def clock(self) -> VersionedTable:
        return self._table("clock", CLOCK)

    @property
    def cache(self) -> VersionedTable:
        return self._table("cache", PREDICTION_CACHE)

    @property
    def markers(self) -> VersionedTable:
        return self._table("markers", FIRST_FAILURE_MARKERS)

    @property
    def features_path(self) -> str:
        return f"{self.path}/features"


def refresh_batch(
    batch: DataFrame,
    batch_id: int,
    store: RefreshStore,
    scorer: scoring.Scorer,
    *,
    lateness: str = "10 minutes",
    minutes: int = 5,
    min_records: int = 12,
    as_of=None,
) -> None:
    """Bring the store from version ``batch_id`` to ``batch_id + 1``.

    A repeated batch reads the same versions and writes the same ones again.
    Slices older than the lateness are closed: their features are final and
    written out, their running values carried, and later readings of theirs
    are dropped.
    """
    this, following = batch_id, batch_id + 1
    carry = store.carry.read(this)

    def is_open(clock: DataFrame):
        closed = clock.select(F.max("closed_before")).scalar()
        start = F.col("window_start")
        return start.isNull() | F.coalesce(start >= closed, F.lit(True))

    still_open = is_open(store.clock.read(this))
    arrived = partials.window_partials(batch, minutes=minutes).filter(still_open)
    store.recent.write(
        partials.merge_partials(store.recent.read(this).filter(still_open), arrived), following
    )
    recent = store.recent.read(following)
    stats = partials.stats_of(recent)

    newest = F.max("feature_timestamp") - F.expr(f"interval {lateness}")
    horizon = recent.agg(newest.alias("at")).select(
        time_slice("at", minutes=minutes).alias("closed_before")
    )
    clock = store.clock.read(this).unionByName(horizon)
    store.clock.write(clock.agg(F.max("closed_before").alias("closed_before")).coalesce(1), following)
    open_after = is_open(store.clock.read(following))

    rows = features.temporal_features(
        stats, minutes=float(minutes), min_records=min_records, carry=carry
    )
    closed_before = store.clock.read(following).select(F.max("closed_before")).scalar()
    final = rows.filter(F.col("feature_timestamp") < closed_before)
    final.write.mode("overwrite").parquet(f"{store.features_path}/batch={batch_id:012d}")

    predictions = scoring.hybrid_prediction(rows, scorer)
    store.cache.write(
        refresh.upsert_predictions(store.cache.read(this), predictions, as_of=as_of), following
    )
    cache = store.cache.read(following)
    store.markers.write(
        refresh.refresh_markers(store.markers.read(this), cache, as_of=as_of), following
    )
    closing = stats.filter(~open_after)
    store.carry.write(features.feature_carry(closing, carry=carry), following)


def stream_refresh(
    stream: DataFrame,
    store: RefreshStore,
    scorer: scoring.Scorer,
    *,
    checkpoint: str,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Run ``refresh_batch`` on every micro-batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        refresh_batch(batch, batch_id, store, scorer, **options)

    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(each).start()
