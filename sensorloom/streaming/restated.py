"""Predictions and markers kept from the features that a stream restates.

Each micro-batch of ``state.running_features`` names the slices that have changed. Their
rows replace the old ones, the entities they belong to are scored anew, and cache and
markers take what follows. All three tables lie in buckets by entity: a batch reads and
writes the buckets of the entities it names, and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorloom.plans import refresh, scoring
from sensorloom.schemas import FIRST_FAILURE_MARKERS, PREDICTION_CACHE
from sensorloom.sources.buckets import BucketedTable
from sensorloom.streaming import state


@dataclass(frozen=True)
class RestatedRefresh:
    """The tables of one stream; they belong to one checkpoint.

    A repeated batch reads the versions before its own and writes the same ones again.
    """

    spark: SparkSession
    path: str
    scorer: scoring.Scorer
    buckets: int = 64
    as_of: object = None

    def _table(self, name: str, schema) -> BucketedTable:
        return BucketedTable(self.spark, f"{self.path}/{name}", schema, ("entity_id",), self.buckets)

    @property
    def features(self) -> BucketedTable:
        return self._table("features", state.FEATURES)

    @property
    def cache(self) -> BucketedTable:
        return self._table("cache", PREDICTION_CACHE)

    @property
    def markers(self) -> BucketedTable:
        return self._table("markers", FIRST_FAILURE_MARKERS)

    def changes(self, batch_id: int) -> DataFrame:
        """What a batch has done to each prediction of its entities."""
        return self.spark.read.parquet(f"{self.path}/changes/batch={batch_id:012d}")

    def each(self, rows: DataFrame, batch_id: int) -> None:
        """From version ``batch_id`` of the tables to the next."""
        this, following = batch_id, batch_id + 1
        # Written once: a second look at the batch would run its keyed state again.
        named = f"{self.path}/named/batch={batch_id:012d}"
        rows.write.mode("overwrite").parquet(named)
        rows = self.spark.read.schema(state.FEATURES).parquet(named)
        touched = self.features.touched(rows)
        if not touched:
            return
        old = self.features.read(this, touched).drop("bucket")
        self.features.write(rows.unionByName(_without(old, rows, ["entity_id", "window_start"])), following, touched)

        slices = self.features.read(following, touched).drop("bucket")
        mine = _only(slices, rows, ["entity_id"])
        predictions = scoring.hybrid_prediction(mine, self.scorer)
        known = self.cache.read(this, touched).drop("bucket")
        changes = f"{self.path}/changes/batch={batch_id:012d}"
        refresh.prediction_changes(known, predictions, as_of=self.as_of).write.mode("overwrite").parquet(changes)
        self.cache.write(self.changes(batch_id), following, touched)

        found = refresh.event_markers(self.scorer.classify(mine), as_of=self.as_of)
        kept = _without(self.markers.read(this, touched).drop("bucket"), rows, ["entity_id"])
        self.markers.write(kept.unionByName(found), following, touched)


def _same(keys: list[str]):
    return [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]


def _without(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return rows.alias("a").join(other.select(*keys).alias("b"), _same(keys), "left_anti")


def _only(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return rows.alias("a").join(other.select(*keys).alias("b"), _same(keys), "left_semi")


def stream_restated(
    stream: DataFrame,
    job: RestatedRefresh,
    *,
    lateness: str,
    checkpoint: str,
    minutes: int = 5,
    min_records: int = 12,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep features, predictions and markers up to date, late readings included."""
    rows = state.running_features(stream, lateness=lateness, minutes=minutes, min_records=min_records)
    return state.start(rows, job.each, checkpoint=checkpoint, trigger=trigger)
