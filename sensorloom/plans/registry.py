"""Named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom import session
from sensorloom.functions.checks import any_missing
from sensorloom.functions.timeops import DAY, datediff_boundary, time_slice, time_text, trailing
from sensorloom.operators.keyed import (
    append_if_absent,
    emptied,
    insert_if_absent,
    update_from_map,
    update_if_exists,
    update_where,
    upsert,
    with_defaults,
)
from sensorloom.operators.windows import latest_per
from sensorloom.plans import array_rules, features, models, refresh, replay, scoring, serving, status
from sensorloom.schemas import BASIC_FEATURES, DEFAULT_STATUS, FAILURE_TYPES, NORMAL, NORMAL_SEED
from sensorloom.sources import derived, export, traces
from sensorloom.sources.versioned import VersionedTable, append_by_day
from sensorloom.streaming import live
from sensorloom.streaming.refresh import RefreshStore, stream_refresh
from sensorloom.streaming.restated import RestatedRefresh, stream_restated
from sensorloom.streaming.status import CHANGES, status_now
from sensorloom.streaming.status import stream_status as run_status
from sensorloom.streaming.slices import HistoryRefresh, SliceLog, stream_refresh_history, stream_slices

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2024-01-01 02:00:00"
CHART_AS_OF = "2024-01-01 01:20:00"
EPOCHS = 720

_QUERIES: dict[str, Query] = {}


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits: their last ones depend on the order of sums."""
    return df.select(
        *[
            F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
            for f in df.schema.fields
        ]
    )


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(build(session.configure(spark), sf_dir))

    _QUERIES[build.__name__] = run
    return build


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.temporal_features(features.window_stats(derived.telemetry(spark, sf_dir)))


# --- readings -----------------------------------------------------------


@query
def latest_telemetry(spark, sf_dir):
    return serving.latest_telemetry(derived.telemetry(spark, sf_dir))


@query
def latest_telemetry_json(spark, sf_dir):
    return export.json_records(serving.latest_telemetry(derived.telemetry(spark, sf_dir)))


@query
def fleet_status(spark, sf_dir):
    normal = derived.normal_seed(spark, sf_dir, derived.written_ranks(spark, sf_dir))
    return serving.fleet_status(derived.telemetry_of(normal), normal)


@query
def snapshot_at_max(spark, sf_dir):
    return serving.snapshot_at_max(derived.telemetry(spark, sf_dir))


@query
def agg_5min(spark, sf_dir):
    return serving.agg_5min(derived.telemetry(spark, sf_dir))


@query
def chart_from_agg(spark, sf_dir):
    return serving.chart_from_agg(serving.agg_5min(derived.telemetry(spark, sf_dir)), hours=0.5)


@query
def chart_inline(spark, sf_dir):
    normal = derived.normal_seed(spark, sf_dir, derived.written_ranks(spark, sf_dir))
    return serving.chart_inline(derived.telemetry_of(normal), hours=0.5)


@query
def chart_dashboard(spark, sf_dir):
    return serving.chart_dashboard(derived.telemetry(spark, sf_dir), hours=1, as_of=CHART_AS_OF)


@query
def event_slices(spark, sf_dir):
    """Slices of another width, over another table."""
    events = derived.table(spark, sf_dir, "events")
    hourly = events.select(time_slice("ts", minutes=60, edge="end").alias("slice_end"), "ts", "value")
    return hourly.groupBy("slice_end").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean_value"),
        F.max(datediff_boundary("minute", "ts", "slice_end")).alias("most_minutes_left"),
        F.min(datediff_boundary("hour", "slice_end", "ts")).alias("least_hours_after"),
        F.max(datediff_boundary("day", "ts", "slice_end")).alias("most_days_left"),
        F.max(datediff_boundary("second", "ts", "slice_end")).alias("most_seconds_left"),
    )


@query
def event_trailing(spark, sf_dir):
    """Events of the last twelve hours of the data."""
    events = derived.table(spark, sf_dir, "events")
    recent = trailing(events, "ts", hours=12)
    return recent.select("event_id", time_text("ts", millis=True).alias("ts_text"), "user_id", "value")


@query
def event_latest_per_user(spark, sf_dir):
    return latest_per(derived.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])


# --- features and scores ------------------------------------------------


@query
def window_stats(spark, sf_dir):
    return features.window_stats(derived.telemetry(spark, sf_dir))


@query
def temporal_features(spark, sf_dir):
    return _features(spark, sf_dir)


@query
def temporal_features_carried(spark, sf_dir):
    """The same features in two runs, the second from what the first carried over."""
    stats = features.window_stats(derived.telemetry(spark, sf_dir))
    cut = F.lit("2024-01-01 00:20:00").cast("timestamp_ntz")
    early, late = stats.filter(F.col("window_start") < cut), stats.filter(F.col("window_start") >= cut)
    carry = features.feature_carry(early)
    return features.temporal_features(early).unionByName(
        features.temporal_features(late, carry=carry)
    )


@query
def temporal_features_segmented(spark, sf_dir):
    """Six-hour slices of the events, each history cut into weeks."""
    readings = derived.event_readings(derived.table(spark, sf_dir, "events"))
    stats = features.window_stats(readings, minutes=360)
    return features.temporal_features(stats, minutes=360.0, min_records=2, segment_days=7)


@query
def latest_features(spark, sf_dir):
    return features.latest_features(_features(spark, sf_dir))


def _scored(spark, sf_dir) -> tuple[DataFrame, scoring.RuleScorer]:
    rows = features.latest_features(_features(spark, sf_dir))
    return rows, scoring.RuleScorer()


@query
def classify_failure(spark, sf_dir):
    rows, scorer = _scored(spark, sf_dir)
    return scorer.classify(rows).select("entity_id", "feature_timestamp", scoring.CLASS)


@query
def ttf_basic(spark, sf_dir):
    rows, scorer = _scored(spark, sf_dir)
    return scorer.ttf_basic(rows).select("entity_id", "feature_timestamp", scoring.HOURS)


@query
def ttf_temporal(spark, sf_dir):
    rows, scorer = _scored(spark, sf_dir)
    return scorer.ttf_temporal(rows).select("entity_id", "feature_timestamp", scoring.HOURS)


@query
def hybrid_prediction(spark, sf_dir):
    return scoring.hybrid_prediction(_features(spark, sf_dir), scoring.RuleScorer())


# --- refresh ------------------------------------------------------------


def _refreshed(spark, sf_dir) -> DataFrame:
    predictions = scoring.hybrid_prediction(_features(spark, sf_dir), scoring.RuleScorer())
    return refresh.upsert_predictions(
        derived.prediction_cache(spark, sf_dir), predictions, as_of=AS_OF
    )


@query
def upsert_predictions(spark, sf_dir):
    return _refreshed(spark, sf_dir)


@query
def new_failure_markers(spark, sf_dir):
    return refresh.new_failure_markers(
        derived.prediction_cache(spark, sf_dir),
        derived.first_failure_markers(spark, sf_dir),
        as_of=AS_OF,
    )


@query
def clear_markers(spark, sf_dir):
    return refresh.clear_markers(
        derived.first_failure_markers(spark, sf_dir), derived.prediction_cache(spark, sf_dir)
    )


@query
def refresh_markers(spark, sf_dir):
    """The whole refresh: predictions into the cache, then markers from it."""
    cache = session.cut_lineage(_refreshed(spark, sf_dir), "cache")
    return refresh.refresh_markers(derived.first_failure_markers(spark, sf_dir), cache, as_of=AS_OF)


# --- status -------------------------------------------------------------


@query
def markers_list(spark, sf_dir):
    return status.markers_list(derived.first_failure_markers(spark, sf_dir))


@query
def markers_list_text(spark, sf_dir):
    return status.markers_list(derived.first_failure_markers(spark, sf_dir), text_time=True)


def _ages(spark, sf_dir) -> DataFrame:
    return status.prediction_age_fleet(
        derived.prediction_cache(spark, sf_dir), derived.telemetry(spark, sf_dir)
    )


@query
def prediction_age_by_entity(spark, sf_dir):
    return status.prediction_age_by_entity(
        derived.prediction_cache(spark, sf_dir), derived.telemetry(spark, sf_dir)
    )


@query
def prediction_age_fleet(spark, sf_dir):
    return _ages(spark, sf_dir)


@query
def stale_check(spark, sf_dir):
    return status.stale_check(_ages(spark, sf_dir))


@query
def active_failures_list(spark, sf_dir):
    active = status.active_failures(
        derived.failure_config(spark, sf_dir), derived.stream_state(spark, sf_dir)
    )
    return status.active_failures_list(active)


@query
def trace_lengths(spark, sf_dir):
    return status.trace_lengths(derived.failure_traces(spark, sf_dir))


@query
def failure_status(spark, sf_dir):
    lengths = status.trace_lengths(derived.failure_traces(spark, sf_dir))
    return status.failure_status(derived.failure_config(spark, sf_dir), lengths)


# --- replay and table changes -------------------------------------------


def _replay_inputs(spark, sf_dir):
    ranked = derived.written_ranks(spark, sf_dir)
    normal = derived.normal_seed(spark, sf_dir, ranked)
    return (
        derived.stream_state(spark, sf_dir),
        derived.failure_config(spark, sf_dir),
        normal,
        derived.failure_traces(spark, sf_dir, ranked),
        derived.written_so_far(normal),
    )


@query
def replay_tick(spark, sf_dir):
    return replay.replay_tick(*_replay_inputs(spark, sf_dir))


@query
def advance_cursor(spark, sf_dir):
    return replay.advance_cursor(
        derived.failure_config(spark, sf_dir),
        derived.failure_traces(spark, sf_dir),
        epoch=derived.CLOCK + 1,
    )


@query
def backfill_normal(spark, sf_dir):
    state, config, normal, _, existing = _replay_inputs(spark, sf_dir)
    return replay.backfill_normal(state, config, normal, existing, epochs=EPOCHS)


@query
def backfill_failure(spark, sf_dir):
    state, config, _, failing, existing = _replay_inputs(spark, sf_dir)
    return replay.backfill_failure(state, config, failing, existing, epochs=EPOCHS)


@query
def batch_cursor_update(spark, sf_dir):
    return replay.batch_cursor_update(
        derived.failure_config(spark, sf_dir), clock=derived.CLOCK, epochs=EPOCHS
    )


@query
def activate_failure(spark, sf_dir):
    """Every truck of the fleet set to fail."""
    trucks = derived.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("TRUCK_"), F.col("s_suppkey").cast("string")).alias("entity_id")
    )
    clock = derived.stream_state(spark, sf_dir).select("next_epoch").scalar()
    return replay.activate_failure(
        derived.failure_config(spark, sf_dir), trucks, "engine", clock=clock
    )


@query
def register_entities(spark, sf_dir):
    """Insert-only merge: trucks without a configuration get a disabled one."""
    trucks = derived.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("TRUCK_"), F.col("s_suppkey").cast("string")).alias("entity_id"),
        F.lit(FAILURE_TYPES[0]).alias("failure_type"),
        F.lit(False).alias("enabled"),
    )
    return insert_if_absent(derived.failure_config(spark, sf_dir), trucks, "entity_id")


@query
def fill_cursor_defaults(spark, sf_dir):
    """Conditional update: missing cursors of enabled failures start at zero."""
    config = derived.failure_config(spark, sf_dir)
    return update_where(
        config,
        F.col("enabled") & F.col("failure_next_epoch").isNull(),
        {"failure_next_epoch": F.lit(0)},
    )


def _trace_files(spark, sf_dir) -> str:
    path = session.scratch_path(spark, "trace-files")
    lines = derived.faulty_trace(spark, sf_dir)
    lines.write.option("header", True).option("compression", "gzip").csv(path)
    return path


@query
def load_trace_csv(spark, sf_dir):
    """The good lines of compressed trace files."""
    return traces.load_trace_csv(spark, _trace_files(spark, sf_dir), NORMAL_SEED)


@query
def load_rejects(spark, sf_dir):
    """The bad lines of the same files."""
    return traces.load_rejects(spark, _trace_files(spark, sf_dir), NORMAL_SEED)


@query
def load_audit(spark, sf_dir):
    seeds = derived.failure_seeds(spark, sf_dir)
    return traces.load_audit(
        {
            "NORMAL_SEED": derived.normal_seed(spark, sf_dir),
            **{f"{kind}_FAILURE_SEED": df for kind, df in seeds.items()},
        }
    )


@query
def load_pipeline(spark, sf_dir):
    """The whole load: files into tables, each replaced in full, and a count of what is there.

    A second load over the first leaves the same tables.
    """
    files = _trace_files(spark, sf_dir)
    tables = session.scratch_path(spark, "loaded")
    for _ in range(2):
        # Rows and rejects are the two sides of one parse.
        traces.load_parsed(spark, files, NORMAL_SEED, tables, "NORMAL_SEED")
    return traces.load_audit(
        {
            "NORMAL_SEED": traces.parsed_rows(spark, tables, NORMAL_SEED),
            "NORMAL_SEED_REJECTS": traces.parsed_rejects(spark, tables, NORMAL_SEED),
        }
    )


@query
def load_observed(spark, sf_dir):
    """The same load by one parse, counted by the write itself."""
    folder = session.scratch_path(spark, "parsed")
    return traces.load_parsed(spark, _trace_files(spark, sf_dir), NORMAL_SEED, folder, "NORMAL_SEED")


def _streamed_files(spark, sf_dir) -> str:
    """The trace files loaded as they come, as many to a batch as tasks run at a time.

    A compressed file is one task, so smaller batches would leave cores idle.
    """
    base = session.scratch_path(spark, "streamed-files")
    traces.stream_trace_files(
        spark,
        _trace_files(spark, sf_dir),
        NORMAL_SEED,
        f"{base}/loaded",
        "NORMAL_SEED",
        checkpoint=f"{base}/checkpoint",
        files_per_batch=max(2, spark.sparkContext.defaultParallelism),
    ).awaitTermination()
    return f"{base}/loaded"


@query
def stream_load_rows(spark, sf_dir):
    return traces.parsed_rows(spark, _streamed_files(spark, sf_dir), NORMAL_SEED)


@query
def stream_load_rejects(spark, sf_dir):
    return traces.parsed_rejects(spark, _streamed_files(spark, sf_dir), NORMAL_SEED)


@query
def stream_load_audit(spark, sf_dir):
    return traces.stream_audit(spark, _streamed_files(spark, sf_dir))


@query
def customer_upsert(spark, sf_dir):
    """Every customer's newest order merged into the customers that are not in debt.

    A balance that is there stays; a new customer starts in a segment of its own.
    """
    customers = derived.table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(
        "c_custkey",
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
        F.lit(None).cast("timestamp_ntz").alias("last_order"),
        F.lit(None).cast("string").alias("priority"),
    )
    orders = derived.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.col("o_totalprice").alias("balance"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("last_order"),
        F.col("o_orderpriority").alias("priority"),
        "o_orderkey",
    )
    return upsert(
        customers,
        orders,
        "c_custkey",
        order=["last_order", "o_orderkey"],
        insert_defaults={"segment": "NEW"},
        update_keep=("balance",),
    )


@query
def customer_update_if_exists(spark, sf_dir):
    """Customers that owe nothing and have an open order change segment."""
    customers = derived.table(spark, sf_dir, "customer")
    waiting = derived.table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return update_if_exists(
        customers,
        waiting,
        {"o_custkey": F.col("c_custkey")},
        {"c_mktsegment": F.lit("WAITING")},
        condition=F.col("c_acctbal") >= 0,
    )


@query
def supplier_update_from_map(spark, sf_dir):
    """Balances overwritten by the dearest returned item; several updates come per supplier."""
    updates = derived.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 49")
    updates = updates.select(
        F.col("l_suppkey").alias("s_suppkey"), F.col("l_extendedprice").alias("s_acctbal")
    )
    return update_from_map(derived.table(spark, sf_dir, "supplier"), updates, "s_suppkey")


@query
def delete_all(spark, sf_dir):
    """The failure configuration written, emptied as a new version, and registered anew."""
    config = derived.failure_config(spark, sf_dir)
    table = VersionedTable(spark, session.scratch_path(spark, "config"), config.schema)
    table.write(config)
    table.write(emptied(table.read()))
    trucks = derived.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("TRUCK_"), F.col("s_suppkey").cast("string")).alias("entity_id")
    )
    trucks = with_defaults(trucks, {"failure_type": FAILURE_TYPES[0], "enabled": False})
    return insert_if_absent(table.read(), trucks, "entity_id")


@query
def state_defaults(spark, sf_dir):
    """A stream per customer, with fields missing here and there."""
    key = F.col("c_custkey")
    states = derived.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("stream_name"),
        F.when(key % 3 > 0, derived.ntz(derived.START)).alias("start_ts"),
        F.when(key % 5 > 0, key).alias("next_epoch"),
        F.when(key % 7 > 0, key % 7).alias("step_seconds"),
    )
    return replay.fill_state_defaults(states, as_of=AS_OF)


@query
def latest_telemetry_json_file(spark, sf_dir):
    """The same records written as files and read back."""
    path = session.scratch_path(spark, "json")
    export.write_json(serving.latest_telemetry(derived.telemetry(spark, sf_dir)), path)
    return spark.read.text(path).withColumnRenamed("value", "record")


# --- tables laid out by day ----------------------------------------------


def _by_day(spark, rows: DataFrame, ts: str) -> DataFrame:
    path = session.scratch_path(spark, "by-day")
    append_by_day(rows, path, ts=ts)
    return spark.read.parquet(path)


def _event_days(spark, sf_dir) -> DataFrame:
    events = derived.event_readings(derived.table(spark, sf_dir, "events"))
    return _by_day(spark, events, "timestamp")


@query
def snapshot_at_max_by_day(spark, sf_dir):
    return serving.snapshot_at_max(_event_days(spark, sf_dir), day=DAY)


@query
def chart_from_agg_by_day(spark, sf_dir):
    """Whole slices of the last two days from a slice table."""
    slices = serving.agg_5min(derived.event_readings(derived.table(spark, sf_dir, "events")))
    return serving.chart_from_agg(_by_day(spark, slices, "bucket_time"), hours=48, day=DAY)


@query
def chart_inline_by_day(spark, sf_dir):
    return serving.chart_inline(_event_days(spark, sf_dir), hours=48, day=DAY)


@query
def idempotent_append(spark, sf_dir):
    """A full replay appended to what is there already."""
    normal = derived.normal_seed(spark, sf_dir, derived.written_ranks(spark, sf_dir))
    existing = derived.written_so_far(normal)
    again = derived.telemetry_of(normal).drop("status")
    stamped = again.withColumn("status", F.lit(DEFAULT_STATUS))
    return append_if_absent(existing, stamped, replay.KEYS)


# --- trained models -----------------------------------------------------


_RULE_LABELS = ("rule_class", "rule_basic", "rule_temporal")


def _trained(spark, sf_dir):
    """Models trained on what the rules say of every slice, kept with its features."""
    rules = scoring.RuleScorer()
    labels = (rules.class_expr(), rules.basic_expr(), rules.temporal_expr())
    labelled = _features(spark, sf_dir).withColumns(dict(zip(_RULE_LABELS, labels)))
    labelled = session.cut_lineage(labelled, "labelled")
    kind, basic, temporal = _RULE_LABELS
    return labelled, models.fit_scorer(
        labelled, label=kind, basic_hours=basic, temporal_hours=temporal, trees=5, depth=4
    )


# What trained models have to reach on the newest slices; a scorer that says NORMAL for all does not.
_CLASS_SHARE, _HOURS_ERROR = 0.75, 0.35


@query
def hybrid_prediction_ml(spark, sf_dir):
    """Trained, saved and loaded models against the rules they were trained on.

    Each row has the rules' class and hours, which the SQL twin works out too, and whether the
    loaded models reach the stated agreement over all entities.
    """
    labelled, scorer = _trained(spark, sf_dir)
    path = session.scratch_path(spark, "models")
    scorer.save(path)
    scored = scoring.hybrid_prediction(labelled.drop(*_RULE_LABELS), models.MLScorer.load(path))
    scored = session.cut_lineage(scored, "scored")
    kind, basic, temporal = _RULE_LABELS
    truth = features.latest_features(labelled).select(
        "entity_id",
        F.col(kind).alias("class"),
        F.col(basic).alias("basic_hours"),
        F.col(temporal).alias("temporal_hours"),
        any_missing(BASIC_FEATURES).alias("missing"),
    )
    reached = models.agreement(scored, truth).select(
        (F.col("class_share") >= _CLASS_SHARE).alias("classes_agree"),
        (F.col("class_kinds") == F.col("true_kinds")).alias("all_classes_told"),
        (F.col("hours_error") <= _HOURS_ERROR).alias("hours_agree"),
    )
    found, hours, tag = F.col(scoring.CLASS), F.col(scoring.HOURS), F.col("ttf_model_used")
    normal = found == NORMAL
    rule_hours = (
        F.when(scoring.is_temporal("class"), F.col("temporal_hours"))
        .when(scoring.is_basic("class"), F.col("basic_hours"))
    )
    # One row on the right.
    return scored.join(truth, "entity_id").join(F.broadcast(reached)).select(
        "entity_id",
        "prediction_timestamp",
        "current_engine_temp",
        "current_trans_pressure",
        "current_battery_voltage",
        F.col("class").alias("rule_class"),
        rule_hours.alias("rule_hours"),
        "classes_agree",
        "all_classes_told",
        "hours_agree",
        (~F.col("missing") | normal).alias("missing_is_normal"),
        (normal == hours.isNull()).alias("hours_fit_class"),
        F.when(normal, tag == scoring.MODEL_NONE)
        .when(scoring.is_temporal(), tag == scoring.MODEL_TEMPORAL)
        .otherwise(tag == scoring.MODEL_BASIC)
        .alias("tag_fits_class"),
    )


@query
def hybrid_prediction_function(spark, sf_dir):
    """Rules as array functions, run the way an outside model would be."""
    session.ship_package(spark)
    scorer = models.FunctionScorer(array_rules.classifier, array_rules.basic, array_rules.temporal)
    return scoring.hybrid_prediction(_features(spark, sf_dir), scorer)


# --- streams, run to the end of the given events -------------------------


def _event_stream(spark, sf_dir) -> DataFrame:
    events = derived.table(spark, sf_dir, "events")
    # A pattern, as a stream may not name a single file; a folder matches as well.
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    return derived.event_readings(stream)


def _shuffled_events(spark, sf_dir) -> DataFrame:
    """The events in eight micro-batches in no order of time, each of as many files as tasks run at a time."""
    path = session.scratch_path(spark, "event-files")
    events = derived.table(spark, sf_dir, "events")
    tasks = spark.sparkContext.defaultParallelism
    events.repartition(8 * tasks, "event_id").write.parquet(path)
    files = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", tasks)
    return derived.event_readings(files.parquet(path))


@query
def stream_agg_5min(spark, sf_dir):
    """Means of all slices, from files in any order."""
    base = session.scratch_path(spark, "stream-slices")
    log = SliceLog(spark, f"{base}/log")
    stream_slices(
        _shuffled_events(spark, sf_dir), log, checkpoint=f"{base}/checkpoint"
    ).awaitTermination()
    return log.means()


@query
def stream_agg_5min_closed(spark, sf_dir):
    """Means of the slices that the watermark has closed, from one file."""
    base = session.scratch_path(spark, "stream-agg")
    rows = live.stream_agg_5min(_event_stream(spark, sf_dir), watermark="10 minutes")
    live.write_stream(rows, f"{base}/out", checkpoint=f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


@query
def stream_latest(spark, sf_dir):
    base = session.scratch_path(spark, "stream-latest")
    rows = live.stream_latest(_event_stream(spark, sf_dir))
    table = VersionedTable(spark, f"{base}/out", rows.schema)
    live.stream_to_table(rows, table, checkpoint=f"{base}/checkpoint").awaitTermination()
    return table.read()


@query
def stream_append(spark, sf_dir):
    """Every event delivered twice, in files in any order, appended once."""
    base = session.scratch_path(spark, "stream-append")
    stream = _shuffled_events(spark, sf_dir)
    twice = stream.unionByName(_shuffled_events(spark, sf_dir))
    live.stream_append_history(
        twice, f"{base}/out", checkpoint=f"{base}/checkpoint"
    ).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


@query
def stream_append_history(spark, sf_dir):
    """Two streams deliver the same events; the second finds them written."""
    base = session.scratch_path(spark, "stream-history")
    stream = _event_stream(spark, sf_dir)
    for run in ("first", "second"):
        live.stream_append_history(
            stream, f"{base}/out", checkpoint=f"{base}/{run}"
        ).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


_EVENT_RULES = scoring.RuleScorer(hot_engine=6000.0, temp_limit=50000.0, minutes=360.0)


def _refresh_store(spark, sf_dir) -> RefreshStore:
    store = RefreshStore(spark, session.scratch_path(spark, "stream-refresh"))
    stream_refresh(
        _event_stream(spark, sf_dir),
        store,
        _EVENT_RULES,
        checkpoint=f"{store.path}/checkpoint",
        lateness="2 days",
        minutes=360,
        min_records=2,
        as_of=AS_OF,
    ).awaitTermination()
    return store


def _history_refresh(spark, sf_dir) -> HistoryRefresh:
    base = session.scratch_path(spark, "history-refresh")
    job = HistoryRefresh(
        SliceLog(spark, f"{base}/log", minutes=360), _EVENT_RULES, min_records=2, as_of=AS_OF
    )
    stream_refresh_history(
        _shuffled_events(spark, sf_dir), job, checkpoint=f"{base}/checkpoint"
    ).awaitTermination()
    return job


@query
def stream_refresh_cache(spark, sf_dir):
    """Predictions from six-hour slices of the events, in files in any order."""
    return _history_refresh(spark, sf_dir).cache.read()


@query
def stream_features_all(spark, sf_dir):
    """Features of all slices of the same stream, which need its slice log and no predictions."""
    base = session.scratch_path(spark, "stream-features")
    job = HistoryRefresh(SliceLog(spark, f"{base}/log", minutes=360), _EVENT_RULES, min_records=2)
    stream_slices(_shuffled_events(spark, sf_dir), job.log, checkpoint=f"{base}/checkpoint").awaitTermination()
    return job.features()


@query
def stream_refresh_markers(spark, sf_dir):
    return _refresh_store(spark, sf_dir).markers.read()


@query
def stream_features(spark, sf_dir):
    """Features of the closed slices, as the refresh stream writes them out."""
    store = _refresh_store(spark, sf_dir)
    return spark.read.parquet(store.features_path).drop("batch")


def _restated(spark, sf_dir) -> RestatedRefresh:
    """Keyed state over the events as eight files in no order; their whole span counts as lateness."""
    job = RestatedRefresh(spark, session.scratch_path(spark, "restated"), _EVENT_RULES, buckets=16, as_of=AS_OF)
    stream_restated(
        _shuffled_events(spark, sf_dir),
        job,
        lateness="60 days",
        checkpoint=f"{job.path}/checkpoint",
        minutes=360,
        min_records=2,
    ).awaitTermination()
    return job


@query
def stream_features_keyed(spark, sf_dir):
    """Features of all slices from keyed state, a late slice changing its successors only."""
    return _restated(spark, sf_dir).features.read().drop("window_start", "record_count", "bucket")


@query
def stream_refresh_touched(spark, sf_dir):
    """Predictions of the same stream, of which each batch writes the touched buckets."""
    return _restated(spark, sf_dir).cache.read().drop("bucket")


@query
def stream_markers_history(spark, sf_dir):
    """Its markers in event time: the first slice of each type since the last normal one."""
    return _restated(spark, sf_dir).markers.read().drop("bucket")


def _changes(spark, sf_dir):
    """All newest predictions written into a cache that has those of every other truck already."""
    predictions = scoring.hybrid_prediction(_features(spark, sf_dir), scoring.RuleScorer())
    predictions = session.cut_lineage(predictions, "predictions")
    even = F.regexp_extract("entity_id", "[0-9]+", 0).cast("long") % 2 == 0
    cache = derived.prediction_cache(spark, sf_dir)
    known = refresh.upsert_predictions(cache, predictions.filter(even), as_of=derived.START)
    return refresh.prediction_changes(known, predictions, as_of=AS_OF)


@query
def refresh_changes(spark, sf_dir):
    """What writing the newest predictions does to every row of the cache."""
    return _changes(spark, sf_dir).select("entity_id", "predicted_failure_type", "last_updated", "change")


@query
def refresh_markers_from_changes(spark, sf_dir):
    """Markers kept from what a write has named, without another look at the cache."""
    changes = session.cut_lineage(_changes(spark, sf_dir), "changes")
    return refresh.markers_from_changes(derived.first_failure_markers(spark, sf_dir), changes, as_of=AS_OF)


@query
def stream_status(spark, sf_dir):
    """Users on line within two hours of the newest event, from the changes of a status stream."""
    base = session.scratch_path(spark, "stream-status")
    run_status(
        _event_stream(spark, sf_dir), f"{base}/changes", checkpoint=f"{base}/checkpoint", fresh_s=7200
    ).awaitTermination()
    return status_now(spark.read.schema(CHANGES).parquet(f"{base}/changes"))
