from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sensorloom.plans import features, refresh, registry, scoring, serving
from sensorloom.schemas import FIRST_FAILURE_MARKERS, PREDICTION_CACHE, TELEMETRY
from sensorloom.sources import derived
from sensorloom.sources.versioned import VersionedTable
from sensorloom.streaming import live
from sensorloom.streaming.refresh import RefreshStore, refresh_batch, stream_refresh
from sensorloom.streaming.slices import HistoryRefresh, SliceLog

START = datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def readings(spark, *entries):
    rows = [(START + timedelta(seconds=t), e, 1.0, 2.0, 3.0, "NORMAL") for e, t in entries]
    return spark.createDataFrame(rows, TELEMETRY)


def stream_of(spark, path):
    return spark.readStream.schema(TELEMETRY).option("maxFilesPerTrigger", 1).parquet(path)


def rounded(df):
    return df.select(
        *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)]
    )


def same(a, b):
    a, b = rounded(a), rounded(b)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def fleet(spark, tmp_path_factory):
    """The derived telemetry as a folder of three files, twenty minutes each."""
    path = str(tmp_path_factory.mktemp("fleet") / "in")
    tel = derived.telemetry(spark, SF).cache()
    for part in range(3):
        lo, hi = (START + timedelta(minutes=20 * (part + k)) for k in (0, 1))
        slab = tel.filter(
            (F.col("timestamp") >= F.lit(str(lo)).cast("timestamp_ntz"))
            & (F.col("timestamp") < F.lit(str(hi)).cast("timestamp_ntz"))
        )
        slab.coalesce(1).write.mode("append").parquet(path)
    return tel, path


def test_closed_slices_equal_the_batch(spark, fleet, tmp_path):
    tel, path = fleet
    rows = live.stream_agg_5min(stream_of(spark, path), watermark="10 minutes")
    live.write_stream(rows, str(tmp_path / "out"), checkpoint=str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    closed = tel.select(F.max("timestamp") - F.expr("interval 10 minutes")).scalar()
    assert same(got, serving.agg_5min(tel).filter(F.col("bucket_time") <= closed))
    assert got.count() == 80


def test_late_readings_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    for batch in ([("a", 10)], [("a", 3000)], [("a", 3005)], [("a", 20), ("a", 3010)]):
        readings(spark, *batch).coalesce(1).write.mode("append").parquet(path)
    rows = live.stream_agg_5min(stream_of(spark, path), watermark="5 minutes")
    live.write_stream(rows, str(tmp_path / "out"), checkpoint=str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.bucket_time, r.point_count) for r in got] == [(START + timedelta(minutes=5), 1)]


def test_latest_follows_the_stream(spark, fleet, tmp_path):
    tel, path = fleet
    rows = live.stream_latest(stream_of(spark, path))
    table = VersionedTable(spark, str(tmp_path / "t"), rows.schema)
    live.stream_to_table(rows, table, checkpoint=str(tmp_path / "c")).awaitTermination()
    assert same(table.read(), serving.latest_telemetry(tel))


def test_repeats_are_appended_once(spark, fleet, tmp_path):
    tel, path = fleet
    stream = stream_of(spark, path).unionByName(stream_of(spark, path))
    live.stream_append(
        stream, str(tmp_path / "out"), watermark="1 hour", checkpoint=str(tmp_path / "c")
    ).awaitTermination()
    assert same(spark.read.parquet(str(tmp_path / "out")).drop("date"), tel)


def test_append_against_history(spark, fleet, tmp_path):
    tel, path = fleet
    for run in ("c1", "c2"):
        live.stream_append_history(
            stream_of(spark, path), str(tmp_path / "out"), checkpoint=str(tmp_path / run)
        ).awaitTermination()
    live.append_batch(tel.limit(100).unionByName(readings(spark, ("new", 86400))), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).drop("date")
    assert same(got, tel.unionByName(readings(spark, ("new", 86400))))


def test_a_reading_without_time_is_appended_once(spark, tmp_path):
    batch = readings(spark, ("a", 10), ("b", 20)).withColumn(
        "timestamp", F.when(F.col("entity_id") == "a", F.col("timestamp"))
    )
    live.append_by_day(batch.limit(0), str(tmp_path / "out"))
    for _ in range(2):
        live.append_batch(batch, str(tmp_path / "out"))
    assert same(spark.read.parquet(str(tmp_path / "out")).drop("date"), batch)


@pytest.mark.parametrize("batches", [1, 8])
def test_slices_do_not_depend_on_files(spark, fleet, tmp_path, batches):
    tel, _ = fleet
    job = HistoryRefresh(
        SliceLog(spark, str(tmp_path / "log")), scoring.RuleScorer(), as_of=START
    )
    for i in range(batches):
        part = tel.filter(F.pmod(F.xxhash64("timestamp", "entity_id"), F.lit(batches)) == i)
        job.each(part, i)
    job.each(part, batches - 1)
    assert same(job.log.means(), serving.agg_5min(tel))
    full = features.temporal_features(features.window_stats(tel))
    assert same(job.features(), full)
    expected = scoring.hybrid_prediction(full, scoring.RuleScorer())
    assert same(job.cache.read().drop("last_updated"), expected)


def test_versions_count_without_success_markers(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        table = VersionedTable(spark, str(tmp_path / "t"), TELEMETRY)
        table.write(readings(spark, ("a", 1)))
        assert table.read().count() == 1
    finally:
        conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def test_refresh_equals_the_batch_jobs(spark, fleet, tmp_path):
    tel, path = fleet
    store = RefreshStore(spark, str(tmp_path / "store"))
    stream_refresh(
        stream_of(spark, path),
        store,
        scoring.RuleScorer(),
        checkpoint=str(tmp_path / "c"),
        as_of=START,
    ).awaitTermination()
    full = features.temporal_features(features.window_stats(tel))
    empty = spark.createDataFrame([], PREDICTION_CACHE)
    cache = refresh.upsert_predictions(
        empty, scoring.hybrid_prediction(full, scoring.RuleScorer()), as_of=START
    )
    assert same(store.cache.read(), cache)
    # Failures seen on the way keep their marker while the entity is failing.
    markers = store.markers.read()
    failing = cache.filter("predicted_failure_type <> 'NORMAL'")
    assert markers.join(failing, "entity_id", "left_anti").count() == 0
    assert failing.join(
        markers, [failing.entity_id == markers.entity_id, failing.predicted_failure_type == markers.failure_type],
        "left_anti",
    ).count() == 0
    final = spark.read.parquet(store.features_path).drop("batch")
    closed = store.clock.read().first().closed_before
    assert closed == START + timedelta(minutes=40)
    assert same(final, full.filter(F.col("feature_timestamp") < F.lit(str(closed)).cast("timestamp_ntz")))


def test_a_repeated_batch_changes_nothing(spark, fleet, tmp_path):
    tel, _ = fleet
    middle = F.lit(str(START + timedelta(minutes=25))).cast("timestamp_ntz")
    store = RefreshStore(spark, str(tmp_path / "store"))
    run = lambda df, i: refresh_batch(df, i, store, scoring.RuleScorer(), as_of=START)
    run(tel.filter(F.col("timestamp") < middle), 0)
    run(tel.filter(F.col("timestamp") >= middle), 1)
    tables = (store.recent, store.carry, store.cache, store.markers, store.clock)
    before = [spark.createDataFrame(t.read().collect(), t.schema) for t in tables]
    run(tel.filter(F.col("timestamp") >= middle), 1)
    for table, old in zip(tables, before):
        assert same(table.read(), old)


def test_refresh_takes_late_readings_within_the_lateness(spark, fleet, tmp_path):
    tel, _ = fleet
    late = (F.col("timestamp") > F.lit(str(START + timedelta(minutes=43))).cast("timestamp_ntz")) & (
        F.col("trans_oil_pressure") > 45
    )
    store = RefreshStore(spark, str(tmp_path / "store"))
    for i, part in enumerate((tel.filter(~late), tel.filter(late))):
        refresh_batch(part, i, store, scoring.RuleScorer(), as_of=START, lateness="15 minutes")
    full = features.temporal_features(features.window_stats(tel))
    expected = scoring.hybrid_prediction(full, scoring.RuleScorer())
    assert same(store.cache.read().drop("last_updated"), expected)
    assert store.markers.read().schema == spark.createDataFrame([], FIRST_FAILURE_MARKERS).schema


def test_a_day_gets_one_file_an_append(spark, tmp_path):
    days = readings(spark, *[(f"e{i}", 86400 * (i % 3) + i) for i in range(60)])
    for _ in range(2):
        live.append_by_day(days.repartition(4), str(tmp_path / "out"))
    files = [f for f in (tmp_path / "out").rglob("*.parquet") if f.stat().st_size]
    assert len(files) == 2 * 3
    assert spark.read.parquet(str(tmp_path / "out")).count() == 120


def test_event_batches_are_read_by_all_tasks(spark, tmp_path, monkeypatch):
    made = iter(str(tmp_path / f"{i}") for i in range(9))
    monkeypatch.setattr(registry.session, "scratch_path", lambda _, label: next(made))
    stream = registry._shuffled_events(spark, "/root/testdata/sf0.01")
    tasks = spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "0").glob("*.parquet"))) == 8 * tasks
    sizes = []
    each = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    each.foreachBatch(lambda batch, _: sizes.append(batch.rdd.getNumPartitions())).start().awaitTermination()
    assert len(sizes) == 8 and min(sizes) >= 1
