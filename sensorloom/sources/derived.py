"""Telemetry, traces and state tables derived from the order tables.

Every line item is one reading of its supplier's truck. The same expressions
are written in ``oracles.py`` for the second engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.functions.timeops import epoch_to_ts, ntz
from sensorloom.plans.replay import tag_traces
from sensorloom.schemas import DEFAULT_STATUS, SENSORS
from sensorloom.session import cut_lineage

START = "2024-01-01 00:00:00"
STEP = 5
CLOCK = 100

# Rows of one key that a task ranks at most; a key with more is ranked in pieces.
TASK_ROWS = 4_000_000
# One small expression: a list of literals would be looked at again with every step of a plan.
_THOUSANDTHS = f"cast(split('{','.join(str(i / 1000) for i in range(1, 1000))}', ',') AS array<double>)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, key: str, order: list[str], *, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` with ``epoch`` 1..n per key in the given order, whose first two columns are numbers.

    Keys are counted first. Those with at most ``task_rows`` rows are ranked by one
    window each; the others, at most one per ``task_rows`` rows of the table, in pieces:
    the order of a key is cut at quantiles of its first column, nulls first, and a value
    that many rows share is cut again by the second one. Rows are ranked within a
    piece and offset by the counts of the pieces before. All this is one lazy
    plan, written as one statement so that it is analysed once.
    """
    columns, by = ", ".join(df.columns), ", ".join(order)
    one, two = order[:2]

    def cuts(name: str, of: str, group: str, value: str) -> str:
        """As many quantiles as cut a group into pieces of ``task_rows`` rows, nulls where it is small."""
        return f"""{name} AS (
            SELECT {group}, CASE WHEN n > {task_rows} THEN array_distinct(array_compact(transform(
                       sequence(1, cast(least(ceil(n / {task_rows}), 1000) AS int) - 1),
                       i -> get(steps, cast(i * 1000 / least(ceil(n / {task_rows}), 1000) AS int) - 1)))) END AS cuts
            FROM (SELECT {group}, count(*) AS n, percentile_approx({value}, {_THOUSANDTHS}, 10000) AS steps
                  FROM {of} GROUP BY {group}))"""

    def place(value: str) -> str:
        return f"""CASE WHEN {value} IS NULL OR cuts IS NULL THEN 0
            ELSE 2 * size(filter(cuts, c -> c < {value})) + int(array_contains(cuts, {value})) + 1 END"""

    return df.sparkSession.sql(
        f"""
        WITH held AS (SELECT *, struct({key}) AS _key FROM {{df}}),
        large AS (SELECT _key FROM held GROUP BY _key HAVING count(*) > {task_rows}),
        split AS (SELECT /*+ BROADCAST(large) */ held.* FROM held JOIN large USING (_key)),
        {cuts("first", "split", "_key", one)},
        placed AS (SELECT split.*, {place(one)} AS _one FROM split JOIN first USING (_key)),
        {cuts("second", "placed", "_key, _one", two)},
        pieces AS (SELECT placed.*, {place(two)} AS _two FROM placed JOIN second USING (_key, _one)),
        offsets AS (
            SELECT _key, _one, _two, sum(count(*)) OVER (PARTITION BY _key ORDER BY _one, _two) - count(*) AS _offset
            FROM pieces GROUP BY _key, _one, _two)
        SELECT /*+ BROADCAST(large) */ {columns},
               cast(row_number() OVER (PARTITION BY _key ORDER BY {by}) AS long) AS epoch
        FROM held LEFT ANTI JOIN large USING (_key)
        UNION ALL
        SELECT {columns}, _offset + row_number() OVER (PARTITION BY _key, _one, _two ORDER BY {by})
        FROM pieces JOIN offsets USING (_key, _one, _two)
        """,
        df=df,
    )


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_returnflag",
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return numbered(lines, "l_suppkey", order)


def _truck(column: str):
    return F.concat(F.lit("TRUCK_"), F.col(column).cast("string")).alias("entity_id")


def _sensors():
    return [
        (F.lit(180.0) + F.col("l_quantity")).alias("engine_temp"),
        (F.lit(40.0) + F.lit(100.0) * F.col("l_discount")).alias("trans_oil_pressure"),
        (F.lit(12.0) + F.lit(28.0) * F.col("l_tax")).alias("battery_voltage"),
    ]


def written_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked line items as a table, for jobs that read several traces from them."""
    return cut_lineage(_ranked(spark, sf_dir), "ranked")


def normal_seed(spark: SparkSession, sf_dir: str, ranked: DataFrame | None = None) -> DataFrame:
    """Epoch-indexed trace of every truck."""
    ranked = _ranked(spark, sf_dir) if ranked is None else ranked
    return ranked.select(_truck("l_suppkey"), "epoch", *_sensors())


def faulty_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trace as text for a file, with no number for returned items' epochs."""
    epoch = F.when(F.col("l_returnflag") == "R", "zz").otherwise(F.col("epoch").cast("string"))
    return _ranked(spark, sf_dir).select(_truck("l_suppkey"), epoch.alias("epoch"), *_sensors())


def telemetry_of(normal: DataFrame) -> DataFrame:
    """The traces laid on the timeline from its start."""
    return normal.select(
        epoch_to_ts(ntz(START), F.col("epoch"), STEP).alias("timestamp"),
        "entity_id",
        *SENSORS,
        F.lit(DEFAULT_STATUS).alias("status"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_of(normal_seed(spark, sf_dir))


def failure_seeds(
    spark: SparkSession, sf_dir: str, ranked: DataFrame | None = None
) -> dict[str, DataFrame]:
    """One trace per failure type: the fleet's mean reading per epoch, drifting.

    Sums are over whole numbers, so the means do not depend on their order.
    """
    ranked = _ranked(spark, sf_dir) if ranked is None else ranked
    mean = ranked.groupBy("epoch").agg(
        (F.sum(F.col("l_quantity").cast("long")) / F.count(F.lit(1))).alias("q"),
        (F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count(F.lit(1))).alias("d"),
        (F.sum(F.round(F.col("l_tax") * 100).cast("long")) / F.count(F.lit(1))).alias("t"),
    )
    temp, pressure, volts = F.lit(180.0) + F.col("q"), F.lit(40.0) + F.col("d"), F.lit(0.28) * F.col("t")
    epoch = F.col("epoch")

    def trace(t, p, v) -> DataFrame:
        return mean.select(
            "epoch",
            t.alias("engine_temp"),
            p.alias("trans_oil_pressure"),
            v.alias("battery_voltage"),
        )

    steady = F.lit(12.0) + volts
    return {
        "ENGINE": trace(temp + F.lit(0.05) * epoch, pressure, steady),
        "TRANSMISSION": trace(temp, pressure - F.lit(0.02) * epoch, steady),
        "ELECTRICAL": trace(
            temp, pressure, F.lit(12.0) + volts * (F.lit(1.0) + epoch / F.lit(300.0))
        ),
    }


def failure_traces(spark: SparkSession, sf_dir: str, ranked: DataFrame | None = None) -> DataFrame:
    return tag_traces(failure_seeds(spark, sf_dir, ranked))


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: ``CLOCK`` epochs have been written so far."""
    return spark.range(1).select(
        F.lit("NORMAL_TO_TELEMETRY").alias("stream_name"),
        ntz(START).alias("start_ts"),
        F.lit(CLOCK).cast("long").alias("next_epoch"),
        F.lit(STEP).cast("long").alias("step_seconds"),
        ntz(START).alias("last_updated"),
    )


def failure_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trucks of suppliers with a low balance are configured to fail, the lowest enabled."""
    s = F.col("s_suppkey")
    kind = s % 3
    return table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") < 5000).select(
        _truck("s_suppkey"),
        F.when(kind == 0, "ENGINE").when(kind == 1, "TRANSMISSION").otherwise("ELECTRICAL").alias(
            "failure_type"
        ),
        (F.col("s_acctbal") < 4000).alias("enabled"),
        (F.lit(90) + s % 30).alias("effective_from_epoch"),
        F.nullif((s * 13) % 900, F.lit(0)).alias("failure_next_epoch"),
        ntz(START).alias("created_at"),
        epoch_to_ts(ntz(START), s, 1).alias("updated_at"),
    )


def prediction_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trucks of suppliers that are not in debt have a cached prediction."""
    s = F.col("s_suppkey")
    kind = s % 4
    when = epoch_to_ts(ntz(START), (s * 397) % 4800 - 1200, 1)
    name = (
        F.when(kind == 0, "NORMAL")
        .when(kind == 1, "ENGINE_FAILURE")
        .when(kind == 2, "TRANSMISSION_FAILURE")
        .otherwise("ELECTRICAL_FAILURE")
    )
    model = (
        F.when(kind == 0, "none").when(kind == 3, "temporal_16_features").otherwise("basic_11_features")
    )
    return table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") >= 0).select(
        _truck("s_suppkey"),
        when.alias("prediction_timestamp"),
        name.alias("predicted_failure_type"),
        F.when(kind != 0, s % 48 + F.lit(0.5)).cast("double").alias("predicted_hours_to_failure"),
        model.alias("ttf_model_used"),
        F.lit(200.0).alias("current_engine_temp"),
        F.lit(45.0).alias("current_trans_pressure"),
        F.lit(13.0).alias("current_battery_voltage"),
        (when + F.expr("interval '1.234' second")).alias("last_updated"),
    )


def first_failure_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trucks of suppliers with a high balance have a marker."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") >= 3000).select(
        _truck("s_suppkey"),
        ntz(START).alias("first_failure_time"),
        F.when(s % 3 == 1, "ENGINE_FAILURE").otherwise("ELECTRICAL_FAILURE").alias("failure_type"),
        ntz(START).alias("last_updated"),
    )


def written_so_far(normal: DataFrame) -> DataFrame:
    """Readings already there: all up to the clock, and those that a later,
    interrupted run left behind."""
    ahead = (F.col("epoch") <= CLOCK + 5) & (F.col("engine_temp") >= 220)
    return telemetry_of(normal.filter((F.col("epoch") <= CLOCK) | ahead))


def event_readings(events: DataFrame) -> DataFrame:
    """Events seen as readings of their user.

    All three are whole numbers (the value in hundredths), so that sums of
    them come out the same in any order.
    """
    return events.select(
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("USER_"), F.col("user_id").cast("string")).alias("entity_id"),
        F.round(F.col("value") * 100).alias("engine_temp"),
        F.get_json_object("props", "$.k").cast("double").alias("trans_oil_pressure"),
        F.length("event_type").cast("double").alias("battery_voltage"),
        F.lit(DEFAULT_STATUS).alias("status"),
    )
