"""Slice statistics of a stream whose files come in any order.

Every micro-batch adds its own slice statistics as one part of a log, written
under the batch's number, so a repeated batch replaces its part. Reading adds the
parts up. No slice is ever closed: a late reading changes its slice, and what is
computed from it. A part has one row per entity and slice of its batch.

Parts are merged in tiers: ``FAN`` parts that follow each other become one of the next
tier, so a read meets fewer than ``FAN`` parts of each tier, whatever the number of batches,
and a reading is rewritten once per tier. A merged part counts once its marker is there;
until then, and for readers of an earlier state, the parts it is made of do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorloom.plans import features, partials, refresh, scoring
from sensorloom.schemas import PREDICTION_CACHE, SENSORS
from sensorloom.sources.versioned import VersionedTable, complete, complete_folders, file_system

# Parts of a tier that become one of the next.
FAN = 8
_SLICE = ["entity_id", "window_start"]


@dataclass(frozen=True)
class SliceLog:
    """The slice statistics of one stream; a log belongs to one checkpoint."""

    spark: SparkSession
    path: str
    minutes: int = 5

    def _folder(self, first: int, last: int) -> str:
        return f"{self.path}/part={first:012d}-{last:012d}"

    def _parts(self) -> list[tuple[int, int]]:
        """First and last batch of every complete part."""
        names = complete_folders(self.spark, self.path, "part=")
        return sorted(tuple(int(n) for n in name[5:].split("-")) for name in names)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Logs a micro-batch and merges the tiers that are full with it; repeatable."""
        self._write(partials.window_partials(batch, minutes=self.minutes), batch_id, batch_id)
        size = FAN
        while (batch_id + 1) % size == 0:
            self._merge(batch_id + 1 - size, batch_id, size)
            size *= FAN

    def _write(self, parts: DataFrame, first: int, last: int) -> None:
        folder = self._folder(first, last)
        parts.select(*partials.PARTIALS.names).write.mode("overwrite").parquet(folder)
        complete(self.spark, folder)

    def _merge(self, first: int, last: int, size: int) -> None:
        """One part of the batches first to last, from those of the tier below."""
        step, there = size // FAN, self._parts()
        inner = [(f, l) for f, l in there if first <= f and l <= last and l - f + 1 == step]
        if (first, last) in there or sum(l - f + 1 for f, l in inner) < size:
            return
        self._write(_added_up(self._of(inner)), first, last)
        # What the parts just merged were made of is not read any more, but for recent batches.
        _, fs, jvm = file_system(self.spark, self.path)
        for f, l in self._parts():
            if first <= f and l <= last - 2 * FAN and l - f + 1 < step:
                fs.delete(jvm.org.apache.hadoop.fs.Path(self._folder(f, l)), True)

    def _of(self, parts: list[tuple[int, int]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], partials.PARTIALS)
        folders = [self._folder(f, l) for f, l in parts]
        return self.spark.read.schema(partials.PARTIALS).parquet(*folders)

    def cover(self, up_to: int | None = None) -> list[tuple[int, int]]:
        """The fewest parts that hold every batch, or every one up to a number, once.

        States more than ``2 * FAN`` batches old may have been merged into later ones.
        """
        chosen, done = [], -1
        usable = [(f, l) for f, l in self._parts() if up_to is None or l <= up_to]
        for f, l in sorted(usable, key=lambda p: (p[0], -p[1])):
            if f > done:
                if f != done + 1:
                    raise ValueError(f"{self.path} has no part from batch {done + 1} on")
                chosen.append((f, l))
                done = l
        if up_to is not None and done < up_to and any(l > up_to for _, l in self._parts()):
            raise ValueError(f"{self.path} has merged batch {up_to} into later ones")
        return chosen

    def read(self, up_to: int | None = None, entities: DataFrame | None = None) -> DataFrame:
        """Statistics of all batches, or of those up to a number, of some entities."""
        parts = self._of(self.cover(up_to))
        if entities is not None:
            wanted = entities.select(F.col("entity_id").alias("_wanted")).distinct()
            parts = parts.join(wanted, F.col("entity_id").eqNullSafe(F.col("_wanted")), "left_semi")
        return _added_up(parts)

    def batch(self, batch_id: int) -> DataFrame:
        """The slice statistics of the batch just added, as they are in the log."""
        return self._of([(batch_id, batch_id)])

    def means(self) -> DataFrame:
        """Slice means as ``serving.agg_5min`` gives them."""
        return self.read().select(
            (F.col("window_start") + F.expr(f"interval {self.minutes} minutes")).alias("bucket_time"),
            "entity_id",
            *[F.col(f"mean_{s}").alias(f"avg_{s}") for s in SENSORS],
            F.col("record_count").alias("point_count"),
            F.col("feature_timestamp").alias("latest_timestamp"),
        )


def _added_up(parts: DataFrame) -> DataFrame:
    """One row per entity and slice; deviations are taken around the common mean."""
    slice_ = Window.partitionBy(*_SLICE)
    means, sums = {}, []
    for s in SENSORS:
        n, mean = F.col(f"n_{s}"), F.col(f"mean_{s}")
        means[f"_all_{s}"] = F.sum(n * mean).over(slice_) / F.nullif(F.sum(n).over(slice_), F.lit(0))
        away = mean - F.col(f"_all_{s}")
        sums += [
            F.sum(n).alias(f"n_{s}"),
            F.max(f"_all_{s}").alias(f"mean_{s}"),
            F.sum(F.col(f"m2_{s}") + n * away * away).alias(f"m2_{s}"),
        ]
    return parts.withColumns(means).groupBy(*_SLICE).agg(
        F.max("feature_timestamp").alias("feature_timestamp"),
        F.sum("record_count").alias("record_count"),
        *sums,
    )


def stream_slices(
    stream: DataFrame, log: SliceLog, *, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Add every micro-batch to the log."""
    return _each(stream, log.add, checkpoint, trigger)


@dataclass(frozen=True)
class HistoryRefresh:
    """Predictions recomputed from all slices of the entities that a batch touches."""

    log: SliceLog
    scorer: scoring.Scorer
    min_records: int = 12
    as_of: object = None

    @property
    def cache(self) -> VersionedTable:
        return VersionedTable(self.log.spark, f"{self.log.path}-cache", PREDICTION_CACHE)

    def features(self, up_to: int | None = None, entities: DataFrame | None = None) -> DataFrame:
        stats = partials.stats_of(self.log.read(up_to, entities))
        return features.temporal_features(
            stats, minutes=float(self.log.minutes), min_records=self.min_records
        )

    def each(self, batch: DataFrame, batch_id: int) -> None:
        """From version ``batch_id`` of the cache to the next; repeatable."""
        self.log.add(batch, batch_id)
        rows = self.features(batch_id, self.log.batch(batch_id))
        predictions = scoring.hybrid_prediction(rows, self.scorer)
        known = self.cache.read(batch_id)
        self.cache.write(
            refresh.upsert_predictions(known, predictions, as_of=self.as_of), batch_id + 1
        )


def stream_refresh_history(
    stream: DataFrame, job: HistoryRefresh, *, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Keep the predictions up to date, late readings included."""
    return _each(stream, job.each, checkpoint, trigger)


def _each(stream: DataFrame, job, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(job).start()
