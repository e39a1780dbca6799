from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from sensorloom.operators.keyed import append_if_absent
from sensorloom.plans import features, models, refresh, replay, scoring, serving, status
from sensorloom.plans.clock import STREAM, Clock
from sensorloom.schemas import (
    FAILURE_CONFIG,
    FAILURE_TRACES,
    FIRST_FAILURE_MARKERS,
    NORMAL_SEED,
    PREDICTION_CACHE,
    STREAM_STATE,
    TELEMETRY,
)
from sensorloom.sources import derived
from sensorloom.sources.versioned import append_by_day

START = datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def at(seconds):
    return START + timedelta(seconds=seconds)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- serving ------------------------------------------------------------


def tel(spark, *times):
    return spark.createDataFrame(
        [(None if t is None else at(t), e, 1.0, 2.0, 3.0, "NORMAL") for e, t in times], TELEMETRY
    )


def test_fleet_status_edges(spark):
    readings = tel(spark, ("a", 100), ("b", 90), ("c", 89.5), ("d", 89), ("n", None), ("n", 100))
    known = spark.createDataFrame([(e,) for e in "abcdnz"], "entity_id string")
    got = {r.entity_id: (r.status, r.timestamp) for r in serving.fleet_status(readings, known).collect()}
    assert got["a"] == ("ONLINE", at(100)) and got["b"][0] == "ONLINE"
    assert got["c"][0] == "OFFLINE" and got["d"][0] == "OFFLINE"
    assert got["z"] == ("OFFLINE", None)
    # A NULL time counts as the newest reading, and leaves the entity off line.
    assert got["n"] == ("OFFLINE", None)


def test_charts_cut_whole_and_partial_slices(spark):
    readings = tel(spark, *[("a", t) for t in range(0, 7300, 100)])
    agg = serving.agg_5min(readings)
    whole = {r.timestamp: r for r in serving.chart_from_agg(agg, hours=1).collect()}
    inline = {r.timestamp: r for r in serving.chart_inline(readings, hours=1).collect()}
    assert min(whole) == "2024-01-01 01:05:00" and max(whole) == "2024-01-01 02:05:00"
    assert set(inline) == set(whole) and len(whole) == 13
    for key in sorted(whole)[1:]:
        assert whole[key] == inline[key]


def test_chart_keeps_the_oldest_rows(spark):
    readings = tel(spark, *[(e, t) for e in "ab" for t in (0, 300, 600)])
    got = serving.chart_dashboard(readings, hours=1, as_of=at(700), limit=3).collect()
    assert [(r.timestamp, r.entity_id) for r in got] == [(at(0), "a"), (at(0), "b"), (at(300), "a")]


# --- refresh and status -------------------------------------------------


def cached(spark, *entries):
    data = [
        (e, at(t), kind, hours, "m", 1.0, 2.0, 3.0, at(t + 1.2349)) for e, t, kind, hours in entries
    ]
    return spark.createDataFrame(data, PREDICTION_CACHE)


def marked(spark, *entries):
    return spark.createDataFrame([(e, START, k, START) for e, k in entries], FIRST_FAILURE_MARKERS)


def test_a_changed_type_adds_a_second_marker(spark):
    cache = cached(spark, ("a", 400, "ELECTRICAL_FAILURE", 1.0))
    markers = marked(spark, ("a", "ENGINE_FAILURE"))
    got = refresh.refresh_markers(markers, cache, as_of=at(999))
    assert rows(got.select("entity_id", "first_failure_time", "failure_type")) == [
        ("a", at(0), "ENGINE_FAILURE"),
        ("a", at(300), "ELECTRICAL_FAILURE"),
    ]
    assert rows(refresh.refresh_markers(got, cache, as_of=at(1999))) == rows(got)


def test_markers_of_normal_and_unknown_entities_are_cleared(spark):
    cache = cached(spark, ("a", 1, "ENGINE_FAILURE", 1.0), ("b", 1, "NORMAL", None))
    markers = marked(spark, ("a", "ENGINE_FAILURE"), ("b", "ENGINE_FAILURE"), ("c", "ENGINE_FAILURE"))
    assert [r.entity_id for r in refresh.clear_markers(markers, cache).collect()] == ["a"]


def test_upsert_predictions_overwrites_hours_with_null(spark):
    cache = cached(spark, ("a", 1, "ENGINE_FAILURE", 1.0), ("b", 1, "ENGINE_FAILURE", 2.0))
    fresh = cached(spark, ("a", 9, "NORMAL", None), ("a", 8, "ENGINE_FAILURE", 5.0)).drop("last_updated")
    got = {r.entity_id: r for r in refresh.upsert_predictions(cache, fresh, as_of=at(50)).collect()}
    assert got["a"].predicted_hours_to_failure is None and got["a"].last_updated == at(50)
    assert got["b"].predicted_hours_to_failure == 2.0


@pytest.mark.parametrize(
    "predicted,age,color",
    [(0, 60, "red"), (1, 60, "red"), (60, 59, "orange"), (3240, 6, "orange"), (3300, 5, "green"), (3700, 0, "green")],
)
def test_fleet_age_colors(spark, predicted, age, color):
    got = status.prediction_age_fleet(
        cached(spark, ("a", predicted, "NORMAL", None)), tel(spark, ("z", 3600))
    ).first()
    assert (got.age_minutes, got.age_color) == (age, color)


def test_prediction_key_has_milliseconds(spark):
    got = status.prediction_age_fleet(cached(spark, ("a", 0, "NORMAL", None)), tel(spark, ("z", 0)))
    assert got.first().prediction_key == "a_2024-01-01 00:00:01.234"


def test_age_by_entity_may_be_negative_or_unknown(spark):
    cache = cached(spark, ("a", 120, "NORMAL", None), ("b", 0, "NORMAL", None))
    got = status.prediction_age_by_entity(cache, tel(spark, ("a", 0)))
    assert [r.age_minutes for r in got.collect()] == [-2, None]


def test_stale_check(spark):
    ages = lambda *xs: spark.createDataFrame([(x,) for x in xs], "age_minutes bigint")
    assert status.stale_check(ages(5, 60)).first().is_stale is True
    assert status.stale_check(ages(5, 59, None)).first().is_stale is False
    assert status.stale_check(ages()).first().is_stale is False


def test_trace_lengths_name_empty_types(spark):
    traces = spark.createDataFrame([("ENGINE", 1, 1.0, 1.0, 1.0)], FAILURE_TRACES)
    assert rows(status.trace_lengths(traces)) == [("ELECTRICAL", 0), ("ENGINE", 1), ("TRANSMISSION", 0)]


# --- replay -------------------------------------------------------------


def state_of(spark, epoch, step=5):
    return spark.createDataFrame([(STREAM, START, epoch, step, START)], STREAM_STATE)


def config_of(spark, *entries):
    """Entries are (entity, type, enabled, effective epoch, cursor)."""
    return spark.createDataFrame([(*e, None, None) for e in entries], FAILURE_CONFIG)


def traces_of(spark, n, *kinds):
    return spark.createDataFrame(
        [(k, e, 1000.0 + e, 0.0, 0.0) for k in kinds for e in range(1, n + 1)], FAILURE_TRACES
    )


def normals_of(spark, n, *entities):
    return spark.createDataFrame(
        [(x, e, float(e), 0.0, 0.0) for x in entities for e in range(1, n + 1)], NORMAL_SEED
    )


def nothing(spark):
    return spark.createDataFrame([], TELEMETRY)


def values(df):
    return sorted(((r.timestamp - START).seconds // 5, r.entity_id, r.engine_temp) for r in df.collect())


def test_failure_takes_over_inside_a_backfill(spark):
    state, config = state_of(spark, 10), config_of(spark, ("a", "ENGINE", True, 13, 4))
    normal, traces = normals_of(spark, 20, "a", "b"), traces_of(spark, 500, "ENGINE")
    got = replay.backfill_normal(state, config, normal, nothing(spark), epochs=5)
    own = [(11, "a", 11.0), (12, "a", 12.0)]
    assert values(got) == sorted(own + [(e, "b", float(e)) for e in range(11, 16)])
    got = replay.backfill_failure(state, config, traces, nothing(spark), epochs=5)
    assert values(got) == [(13, "a", 1005.0), (14, "a", 1006.0), (15, "a", 1007.0)]
    moved = replay.batch_cursor_update(config, clock=10, epochs=5).first()
    assert moved.failure_next_epoch == 7


@pytest.mark.parametrize("cursor,rows_written,after", [(498, 2, 508), (499, 1, 509), (500, 0, 510), (501, 0, 511)])
def test_trace_end(spark, cursor, rows_written, after):
    config = config_of(spark, ("a", "ENGINE", True, 1, cursor))
    traces = traces_of(spark, 500, "ENGINE")
    got = replay.backfill_failure(state_of(spark, 10), config, traces, nothing(spark), epochs=10)
    assert got.count() == rows_written
    assert replay.batch_cursor_update(config, clock=10, epochs=10).first().failure_next_epoch == after
    tick = replay.replay_tick(
        state_of(spark, 10), config, normals_of(spark, 20, "a"), traces, nothing(spark)
    )
    goes_on = cursor < 500
    assert tick.count() == (1 if goes_on else 0)
    moved = replay.advance_cursor(config, traces, epoch=11).first().failure_next_epoch
    assert moved == cursor + goes_on
    lengths = status.trace_lengths(traces)
    shown = status.failure_status(config, lengths).first().status
    assert shown == ("OFFLINE" if cursor > 500 else "ACTIVE")


def test_null_cursor_and_start(spark):
    config = config_of(spark, ("a", "ENGINE", True, None, None))
    traces, normal = traces_of(spark, 9, "ENGINE"), normals_of(spark, 20, "a")
    got = replay.backfill_failure(state_of(spark, 2), config, traces, nothing(spark), epochs=3)
    assert values(got) == [(3, "a", 1001.0), (4, "a", 1002.0), (5, "a", 1003.0)]
    assert replay.batch_cursor_update(config, clock=2, epochs=3).first().failure_next_epoch == 3
    tick = replay.replay_tick(state_of(spark, 2), config, normal, traces, nothing(spark))
    assert values(tick) == [(3, "a", 3.0)]


def test_disabled_failures_do_nothing(spark):
    config = config_of(spark, ("a", "ENGINE", False, 1, 0))
    traces, normal = traces_of(spark, 9, "ENGINE"), normals_of(spark, 20, "a")
    assert replay.backfill_failure(state_of(spark, 2), config, traces, nothing(spark), epochs=3).count() == 0
    assert replay.backfill_normal(state_of(spark, 2), config, normal, nothing(spark), epochs=3).count() == 3
    assert replay.batch_cursor_update(config, clock=2, epochs=3).first().failure_next_epoch == 0
    assert replay.advance_cursor(config, traces, epoch=3).first().failure_next_epoch == 0


def test_backfill_twice_adds_nothing(spark):
    state, normal = state_of(spark, 0, step=0), normals_of(spark, 20, "a")
    none = config_of(spark)
    first = replay.backfill_normal(state, none, normal, nothing(spark), epochs=10)
    table = append_if_absent(nothing(spark), first, replay.KEYS)
    assert table.count() == 10
    assert replay.backfill_normal(state, none, normal, table, epochs=10).count() == 0
    assert replay.backfill_normal(state, none, normal, table, epochs=12).count() == 2


def test_long_ranges_cross_trace_blocks(spark):
    config = config_of(spark, ("a", "ENGINE", True, 5, 700))
    traces = traces_of(spark, 3000, "ENGINE")
    got = replay.backfill_failure(state_of(spark, 0), config, traces, nothing(spark), epochs=2000)
    assert got.count() == 2000 - 4
    assert got.agg(F.min("engine_temp"), F.max("engine_temp")).first() == (1701.0, 1000.0 + 700 + 1996)


def test_ticks_and_backfill_write_the_same_rows(spark):
    n = 6
    normal = derived.normal_seed(spark, SF).filter("epoch <= 120").cache()
    traces = derived.failure_traces(spark, SF).cache()
    config = derived.failure_config(spark, SF).withColumn(
        "effective_from_epoch", F.col("effective_from_epoch") + 7
    )
    config = spark.createDataFrame(config.collect(), FAILURE_CONFIG)
    state = state_of(spark, 100)
    bulk = replay.backfill_normal(state, config, normal, nothing(spark), epochs=n).unionByName(
        replay.backfill_failure(state, config, traces, nothing(spark), epochs=n)
    )
    written, cursors = [], config
    for i in range(n):
        now = state_of(spark, 100 + i)
        written += replay.replay_tick(now, cursors, normal, traces, nothing(spark)).collect()
        moved = replay.advance_cursor(cursors, traces, epoch=101 + i)
        cursors = spark.createDataFrame(moved.collect(), FAILURE_CONFIG)
    assert sorted(map(str, written)) == sorted(map(str, bulk.collect()))
    after = replay.batch_cursor_update(config, clock=100, epochs=n)
    past_end = traces.groupBy("failure_type").agg(F.max("epoch").alias("top"))
    inside = after.join(past_end, "failure_type").filter(F.col("failure_next_epoch") <= F.col("top"))
    ticked = {r.entity_id: r.failure_next_epoch or 0 for r in cursors.collect()}
    assert inside.count() > 0
    for r in inside.collect():
        assert ticked[r.entity_id] == (r.failure_next_epoch or 0)


def test_activate_keeps_a_cursor(spark):
    config = config_of(spark, ("a", "ELECTRICAL", False, 3, 7), ("b", "ENGINE", True, 3, None))
    entities = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")
    got = replay.activate_failure(config, entities, "engine", clock=10)
    shown = got.select("entity_id", "failure_type", "enabled", "effective_from_epoch", "failure_next_epoch")
    assert rows(shown) == [
        ("a", "ENGINE", True, 11, 7),
        ("b", "ENGINE", True, 11, 0),
        ("c", "ENGINE", True, 11, 0),
    ]
    with pytest.raises(ValueError):
        replay.activate_failure(config, entities, "brakes", clock=10)


def test_clock_defaults(spark):
    assert Clock.of(state_of(spark, 7, step=0)).step == 5
    assert Clock.of(state_of(spark, 7, step=None)).step == 5
    assert Clock.of(state_of(spark, None)).epoch == 0
    with pytest.raises(ValueError):
        Clock.of(state_of(spark, 7).limit(0))


def test_ranges_reach_the_scans(spark, tmp_path):
    normals_of(spark, 20, "a").write.parquet(str(tmp_path / "normal"))
    append_by_day(tel(spark, ("a", 25), ("a", 86400)), str(tmp_path / "existing"))
    normal, existing = (spark.read.parquet(str(tmp_path / n)) for n in ("normal", "existing"))
    df = replay.backfill_normal(state_of(spark, 3), config_of(spark), normal, existing, epochs=4, day="date")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(epoch,4)" in plan
    assert "PartitionFilters: [isnotnull(date" in plan
    assert values(df) == [(4, "a", 4.0), (6, "a", 6.0), (7, "a", 7.0)]


def test_serving_reads_tables_laid_out_by_day(spark, tmp_path):
    readings = tel(spark, ("a", 0), ("b", 86400), ("a", 86400), ("a", 86390), ("n", None))
    append_by_day(readings, str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert rows(serving.snapshot_at_max(table, day="date")) == rows(serving.snapshot_at_max(readings))
    assert serving.snapshot_at_max(table, day="date").columns == readings.columns
    known = readings.select("entity_id")
    assert rows(serving.fleet_status(table, known, day="date")) == rows(serving.fleet_status(readings, known))
    assert rows(serving.chart_inline(table, hours=1, day="date")) == rows(serving.chart_inline(readings, hours=1))


def test_state_changes(spark):
    empty = spark.createDataFrame([("s", None, None, None, None)], STREAM_STATE)
    filled = replay.fill_state_defaults(empty, as_of=START).first()
    assert (filled.start_ts, filled.next_epoch, filled.step_seconds) == (START, 0, 5)
    assert replay.advance_clock(state_of(spark, 7), epochs=3).first().next_epoch == 10


def test_a_clock_is_found_by_name(spark):
    rows = [("OTHER", START, 7, 5, START), (STREAM, START, 100, 5, START)]
    state = spark.createDataFrame(rows, STREAM_STATE)
    assert Clock.of(state).epoch == 100 and Clock.of(state, stream="OTHER").epoch == 7
    with pytest.raises(ValueError):
        Clock.of(state.unionByName(state))


def test_a_foreign_date_column_changes_nothing(spark):
    readings = tel(spark, ("a", 1080), ("b", 1140))
    odd = readings.withColumn("date", F.when(F.col("entity_id") == "a", F.lit("2030-01-01")).otherwise("1970-01-01"))
    assert [r.entity_id for r in serving.snapshot_at_max(odd).collect()] == ["b"]
    assert "date" in serving.snapshot_at_max(odd).columns


@pytest.mark.parametrize("task_rows", [100_000, 700, 40])
def test_rows_are_numbered_in_pieces(spark, task_rows):
    lines = derived.table(spark, SF, "lineitem").withColumn(
        "l_suppkey", F.when(F.col("l_orderkey") % 3 == 0, 7).otherwise(F.col("l_suppkey"))
    )
    odd = F.when(F.col("l_linenumber") == 2, None).when(F.col("l_orderkey") % 5 == 0, 1 << 60)
    lines = lines.withColumn(
        "l_orderkey", F.when(F.col("l_orderkey") % 7 == 0, odd).otherwise(F.col("l_orderkey") - 300)
    ).withColumn("l_suppkey", F.when(F.col("l_suppkey") != 3, F.col("l_suppkey")))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    got = derived.numbered(lines, "l_suppkey", order, task_rows=task_rows)
    w = Window.partitionBy("l_suppkey").orderBy(*order)
    plain = lines.withColumn("epoch", F.row_number().over(w).cast("long"))
    assert got.select("l_suppkey", *order, "epoch").exceptAll(
        plain.select("l_suppkey", *order, "epoch")
    ).count() == 0
    assert got.count() == 6000


def test_agreement_tells_a_scorer_that_says_normal(spark):
    rows = features.temporal_features(features.window_stats(derived.telemetry(spark, SF)))
    rules = scoring.RuleScorer()
    latest = features.latest_features(rows)
    truth = latest.select(
        "entity_id",
        rules.class_expr().alias("class"),
        rules.basic_expr().alias("basic_hours"),
        rules.temporal_expr().alias("temporal_hours"),
    )
    scored = scoring.hybrid_prediction(rows, rules)
    same = models.agreement(scored, truth).first()
    assert (same.class_share, same.class_kinds, same.true_kinds, same.hours_error) == (1.0, 4, 4, 0.0)
    none = scored.withColumn(scoring.CLASS, F.lit("NORMAL")).withColumn(scoring.HOURS, F.lit(None).cast("double"))
    told = models.agreement(none, truth).first()
    assert told.class_share < 0.75 and told.class_kinds == 1 and told.hours_error is None
