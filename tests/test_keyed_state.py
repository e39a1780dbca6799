"""Keyed state, touched buckets, merged log parts and change sets."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_streaming import SF, START, fleet, readings, same, stream_of  # noqa: F401

from sensorloom.operators.keyed import KEPT, upsert, upsert_changes
from sensorloom.plans import features, partials, refresh, scoring, serving
from sensorloom.schemas import FIRST_FAILURE_MARKERS, PREDICTION_CACHE, SENSORS, TELEMETRY
from sensorloom.sources.buckets import BucketedTable
from sensorloom.streaming import slices, state
from sensorloom.streaming import status as live_status
from sensorloom.streaming.restated import RestatedRefresh, stream_restated
from sensorloom.streaming.slices import HistoryRefresh, SliceLog

MINUTE = 60


def uneven(spark, seconds, entity="a"):
    """Readings whose values vary, at the given seconds."""
    rows = [
        (START + timedelta(seconds=t), entity, float(180 + t % 37), float(40 + t % 11), 12 + (t % 5) * 0.4, "NORMAL")
        for t in seconds
    ]
    return spark.createDataFrame(rows, TELEMETRY)


def files(spark, path, *batches):
    """One file per batch, taken in this order."""
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            if name.startswith("part-"):
                at = 1_000_000 + i
                if os.stat(f"{path}/{name}").st_mtime > 2_000_000:
                    os.utime(f"{path}/{name}", (at, at))


def run_restated(spark, path, base, lateness, scorer=scoring.RuleScorer(), **options):
    job = RestatedRefresh(spark, base, scorer, buckets=4, as_of=START)
    query = stream_restated(
        stream_of(spark, path), job, lateness=lateness, checkpoint=f"{base}/checkpoint", **options
    )
    query.awaitTermination()
    return job, query


def test_restated_features_equal_the_batch_in_any_order(spark, fleet, tmp_path):  # noqa: F811
    tel, _ = fleet
    path = str(tmp_path / "in")
    pieces = [tel.filter(F.pmod(F.xxhash64("timestamp", "entity_id"), F.lit(3)) == i) for i in range(3)]
    files(spark, path, *pieces)
    job, _ = run_restated(spark, path, str(tmp_path / "job"), "2 hours")
    full = features.temporal_features(features.window_stats(tel))
    assert same(job.features.read().drop("bucket", "window_start", "record_count"), full)
    expected = scoring.hybrid_prediction(full, scoring.RuleScorer())
    assert same(job.cache.read().drop("last_updated", "bucket"), expected)
    classified = scoring.RuleScorer().classify(full)
    assert same(job.markers.read().drop("bucket"), refresh.event_markers(classified, as_of=START))


def test_a_late_slice_changes_itself_and_its_successors(spark, tmp_path):
    every = uneven(spark, range(0, 60 * MINUTE, 5))
    late = (F.col("timestamp") >= START + timedelta(minutes=30)) & (F.col("timestamp") < START + timedelta(minutes=32))
    files(spark, str(tmp_path / "in"), every.filter(~late), every.filter(late))
    job, _ = run_restated(spark, str(tmp_path / "in"), str(tmp_path / "job"), "2 hours")
    full = features.temporal_features(features.window_stats(every))
    assert same(job.features.read().drop("bucket", "window_start", "record_count"), full)
    second = spark.read.schema(state.FEATURES).parquet(f"{job.path}/named/batch={1:012d}")
    assert second.select(F.min("window_start")).first()[0] == START + timedelta(minutes=30) and second.count() == 6


def test_closed_slices_leave_the_state(spark, tmp_path):
    """Files in time order with little lateness: totals go on from what closed slices left."""
    batches = [uneven(spark, range(i * 20 * MINUTE, (i + 1) * 20 * MINUTE, 5)) for i in range(5)]
    silent = uneven(spark, range(0, 7 * MINUTE, 5), "silent")
    files(spark, str(tmp_path / "in"), batches[0].unionByName(silent), *batches[1:])
    job, _ = run_restated(spark, str(tmp_path / "in"), str(tmp_path / "job"), "10 minutes")
    whole = batches[0].unionByName(silent)
    for b in batches[1:]:
        whole = whole.unionByName(b)
    full = features.temporal_features(features.window_stats(whole))
    assert same(job.features.read().drop("bucket", "window_start", "record_count"), full)
    held = (
        spark.read.format("statestore").option("path", f"{job.path}/checkpoint").option("stateVarName", "open").load()
    )
    open_slices = {r.entity: r.n for r in held.selectExpr("key.entity_id AS entity", "size(value.start) AS n").collect()}
    # Twenty minutes of a batch and ten of lateness; the silent entity's timers have closed its two.
    assert open_slices["a"] <= 7 and open_slices["silent"] == 0


def test_later_readings_are_dropped_and_counted(spark, tmp_path):
    files(
        spark,
        str(tmp_path / "in"),
        uneven(spark, range(0, 20 * MINUTE, 5)),
        uneven(spark, range(100 * MINUTE, 120 * MINUTE, 5)),
        uneven(spark, [3, 7, 121 * MINUTE]),
        uneven(spark, [11, 122 * MINUTE]),
    )
    job, query = run_restated(spark, str(tmp_path / "in"), str(tmp_path / "job"), "10 minutes")
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == 3
    kept = uneven(spark, [*range(0, 20 * MINUTE, 5), *range(100 * MINUTE, 120 * MINUTE, 5), 121 * MINUTE, 122 * MINUTE])
    full = features.temporal_features(features.window_stats(kept))
    assert same(job.features.read().drop("bucket", "window_start", "record_count"), full)


def test_nulls_and_odd_values_in_keyed_state(spark, tmp_path):
    rows = uneven(spark, range(0, 12 * MINUTE, 5)).unionByName(uneven(spark, range(0, 6 * MINUTE, 5), None))
    rows = rows.withColumn("engine_temp", F.when(F.second("timestamp") < 30, F.col("engine_temp")))
    rows = rows.withColumn("battery_voltage", F.when(F.minute("timestamp") != 6, F.col("battery_voltage")))
    files(spark, str(tmp_path / "in"), rows.unionByName(rows.limit(1).withColumn("timestamp", F.lit(None).cast("timestamp_ntz"))))
    job, _ = run_restated(spark, str(tmp_path / "in"), str(tmp_path / "job"), "1 hour", min_records=1)
    full = features.temporal_features(features.window_stats(rows), min_records=1)
    assert same(job.features.read().drop("bucket", "window_start", "record_count"), full)


def test_partials_merge_like_columns(spark):
    import pandas as pd

    random.seed(3)
    made = [(random.randrange(4), *[random.choice([None, random.random() * 100]) for _ in SENSORS]) for _ in range(60)]
    frame = pd.DataFrame(made, columns=["micros", *SENSORS]).astype({s: "float64" for s in SENSORS})
    a, b = frame.iloc[:25], frame.iloc[25:]
    both = state._merged(state._partials(a, 2), state._partials(b, 2))
    whole = state._partials(frame, 2)
    assert (both.index == whole.index).all()
    for c in whole.columns:
        assert both[c].fillna(-1).to_numpy() == pytest.approx(whole[c].fillna(-1).to_numpy())


def table(spark, path, buckets=8):
    return BucketedTable(spark, path, PREDICTION_CACHE, ("entity_id",), buckets)


def predictions(spark, ids, hours):
    rows = [(f"T{i}", START, "ENGINE_FAILURE", hours, "m", 1.0, 2.0, 3.0, START) for i in ids]
    return spark.createDataFrame(rows, PREDICTION_CACHE)


def test_a_write_touches_the_buckets_of_its_keys(spark, tmp_path):
    cache = table(spark, str(tmp_path / "t"))
    first = predictions(spark, range(200), 1.0)
    cache.write(first, 1, cache.touched(first))
    change = predictions(spark, [3], 9.0)
    touched = cache.touched(change)
    assert len(touched) == 1 and len(cache.touched(first)) == 8

    def bring(version):
        known = cache.read(version - 1, touched).drop("bucket")
        cache.write(upsert(known, change, "entity_id"), version, touched)

    bring(2)
    layout = cache.layout()
    assert {v for b, (v, _) in layout.items() if b in touched} == {2} and [v for v, _ in layout.values()].count(1) == 7
    size = lambda v: sum(f.stat().st_size for f in (tmp_path / "t" / f"v={v:012d}").rglob("*.parquet"))
    assert size(2) < size(1) / 4
    expected = upsert(first, change, "entity_id")
    assert same(cache.read().drop("bucket"), expected)
    bring(2)
    assert same(cache.read().drop("bucket"), expected) and same(cache.read(1).drop("bucket"), first)
    # A version that was not finished does not count.
    os.remove(tmp_path / "t" / f"v={2:012d}" / "_COMPLETE")
    assert same(cache.read().drop("bucket"), first)
    bring(2)
    cache.write(cache.read(2, touched).limit(0), 3, touched)
    assert cache.read().count() == 200 - cache.read(2, touched).count()


def test_old_buckets_are_removed_once_replaced(spark, tmp_path):
    cache = table(spark, str(tmp_path / "t"), buckets=2)
    first = predictions(spark, range(20), 0.0)
    cache.write(first, 1, cache.touched(first))
    one = [cache.touched(first)[0]]
    for version in range(2, 10):
        cache.write(cache.read(version - 1, one).drop("bucket"), version, one)
    held = sorted(os.path.relpath(p, tmp_path / "t") for p, _, names in os.walk(tmp_path / "t") if any(n.endswith(".parquet") for n in names))
    assert sum(f"bucket={one[0]}" in h for h in held) <= 6 and sum(f"bucket={1 - one[0]}" in h for h in held) == 1
    assert same(cache.read().drop("bucket"), first)


def test_log_parts_merge_in_tiers(spark, fleet, tmp_path, monkeypatch):  # noqa: F811
    tel, _ = fleet
    monkeypatch.setattr(slices, "FAN", 2)
    log = SliceLog(spark, str(tmp_path / "log"))
    batches = [tel.filter(F.pmod(F.xxhash64("timestamp", "entity_id"), F.lit(9)) == i) for i in range(9)]
    some = None
    for i, batch in enumerate(batches):
        log.add(batch, i)
        some = batch if some is None else some.unionByName(batch)
        assert sum(l - f + 1 for f, l in log.cover()) == i + 1 and len(log.cover()) <= 4
        if i in (2, 3, 7):
            log.add(batch, i)
            assert same(log.means(), serving.agg_5min(some))
    assert log.cover() == [(0, 7), (8, 8)] and log.cover(6) == [(0, 3), (4, 5), (6, 6)]
    assert not os.path.exists(f"{log.path}/part={0:012d}-{0:012d}")
    with pytest.raises(ValueError):
        log.cover(0)
    assert same(log.means(), serving.agg_5min(tel))
    # A merge that was broken off: the parts below it still hold all.
    os.remove(f"{log.path}/part={0:012d}-{7:012d}/_COMPLETE")
    assert log.cover() == [(0, 3), (4, 7), (8, 8)] and same(log.means(), serving.agg_5min(tel))


def test_history_refresh_over_merged_parts(spark, fleet, tmp_path, monkeypatch):  # noqa: F811
    tel, _ = fleet
    monkeypatch.setattr(slices, "FAN", 2)
    job = HistoryRefresh(SliceLog(spark, str(tmp_path / "log")), scoring.RuleScorer(), as_of=START)
    for i in range(4):
        job.each(tel.filter(F.pmod(F.xxhash64("timestamp", "entity_id"), F.lit(4)) == i), i)
    full = features.temporal_features(features.window_stats(tel))
    assert job.log.cover() == [(0, 3)] and same(job.features(), full)
    assert partials.PARTIALS.names == job.log.read().columns


def test_changes_name_what_an_upsert_does(spark):
    known = predictions(spark, [1, 2, 3], 1.0)
    later = F.lit("2024-02-02").cast("timestamp_ntz")
    source = predictions(spark, [1], 1.0).unionByName(predictions(spark, [2, 4], 5.0)).withColumn("last_updated", later)
    got = upsert_changes(known, source, "entity_id", stamps=("last_updated",))
    assert {r.entity_id: r.change for r in got.collect()} == {"T1": "unchanged", "T2": "updated", "T3": KEPT, "T4": "inserted"}
    assert same(got.drop("change"), upsert(known, source, "entity_id"))


def test_markers_in_event_time(spark):
    random.seed(5)
    kinds = ["NORMAL", "NORMAL", "ENGINE_FAILURE", "TRANSMISSION_FAILURE"]
    rows = [(e, START + timedelta(minutes=5 * i), random.choice(kinds)) for e in "abcdefgh" for i in range(12)]
    rows += [(None, START, "ENGINE_FAILURE"), ("n", START, "NORMAL")]
    expected = set()
    for e in {r[0] for r in rows}:
        seen = {}
        for _, time, kind in sorted((r for r in rows if r[0] == e), key=lambda r: r[1]):
            # A refresh after every slice: normal clears, a new type is marked.
            seen = {} if kind == "NORMAL" else {kind: time} | seen
        expected |= {(e, time, kind) for kind, time in seen.items()}
    random.shuffle(rows)
    frame = spark.createDataFrame(
        rows, "entity_id string, feature_timestamp timestamp_ntz, predicted_failure_type string"
    )
    got = refresh.event_markers(frame, as_of=START)
    assert {(r.entity_id, r.first_failure_time, r.failure_type) for r in got.collect()} == expected
    assert got.columns == FIRST_FAILURE_MARKERS.names and isinstance(START, datetime) and SF


def test_status_follows_the_watermark(spark, tmp_path):
    """An entity falls silent and comes back; after each file the status is that of all files so far."""
    spans = [{"a": (0, 60), "b": (0, 40)}, {"a": (60, 90)}, {"a": (90, 95), "b": (91, 93), "c": (94, 95)}, {"a": (95, 120)}]
    batches = []
    for span in spans:
        batch = None
        for entity, (lo, hi) in span.items():
            one = uneven(spark, range(lo, hi, 2), entity)
            batch = one if batch is None else batch.unionByName(one)
        batches.append(batch)
    files(spark, str(tmp_path / "in"), *batches[:1])
    options = {"checkpoint": str(tmp_path / "c"), "fresh_s": 10}
    whole = None
    for i, batch in enumerate(batches):
        if i:
            files(spark, str(tmp_path / "in"), batch)
        live_status.stream_status(stream_of(spark, str(tmp_path / "in")), str(tmp_path / "out"), **options).awaitTermination()
        whole = batch if whole is None else whole.unionByName(batch)
        changes = spark.read.schema(live_status.CHANGES).parquet(str(tmp_path / "out"))
        expected = serving.fleet_status(whole, whole, fresh_s=10)
        assert same(live_status.status_now(changes), expected)
    told = [(r.entity_id, r.status) for r in changes.orderBy("order").collect() if r.entity_id == "b"]
    assert told == [("b", "ONLINE"), ("b", "OFFLINE"), ("b", "ONLINE"), ("b", "OFFLINE")]


def test_a_batch_of_an_entity_costs_little():
    """Keyed state is worked off entity by entity: frames would take tens of milliseconds for each."""
    import time

    from pyspark.sql import Row

    class Held:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Handle:
        timers = []

        def getValueState(self, *_):
            return Held()

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Never:
        def getCurrentWatermarkInMs(self):
            return 0

    processor = state.RunningFeatures(5, 1, 0.7)
    processor.init(Handle())
    random.seed(7)
    reading = Row("micros", *SENSORS)
    spent, n = 0.0, 100
    for _ in range(n):
        rows = [reading(random.randrange(60 * MINUTE * 10**6), 1.0, 2.0, None) for _ in range(10)]
        at = time.process_time()
        out = list(processor.handleInputRows(("a",), iter(rows), Never()))
        spent += time.process_time() - at
        assert len(out) == 1 and len(Handle.timers) == 1
    assert spent / n < 0.01


def test_all_features_need_no_predictions(spark, tmp_path, monkeypatch):
    """The slice log is all that features are read from; a batch takes its entities from its own part."""
    from sensorloom.plans import registry
    from sensorloom.streaming import slices

    def no_batch(*_):
        raise AssertionError("a batch was scored")

    monkeypatch.setattr(slices.HistoryRefresh, "each", no_batch)
    assert registry.all_queries()["stream_features_all"](spark, "/root/testdata/sf0.001").count()
