from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sensorloom.functions.checks import any_missing, clamp_at_zero, greatest_or_null
from sensorloom.functions.timeops import (
    datediff_boundary,
    epoch_to_ts,
    newest,
    ntz,
    time_slice,
    time_text,
    trailing,
)
from sensorloom.sources.versioned import append_by_day


def ts(*args):
    return datetime(*args)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.fixture(scope="module")
def edges(spark):
    rows = [
        ("2024-01-01 00:04:59.9",),
        ("2024-01-01 00:05:00",),
        ("1969-12-31 23:59:59.5",),
        (None,),
    ]
    return spark.createDataFrame(rows, "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))


def test_slices_are_aligned_and_keep_null(edges):
    start = [r.s for r in edges.select(time_slice("t").alias("s")).collect()]
    end = [r.e for r in edges.select(time_slice("t", edge="end").alias("e")).collect()]
    assert start == [ts(2024, 1, 1), ts(2024, 1, 1, 0, 5), ts(1969, 12, 31, 23, 55), None]
    assert end == [ts(2024, 1, 1, 0, 5), ts(2024, 1, 1, 0, 10), ts(1970, 1, 1), None]


def test_null_slice_is_a_group(edges):
    counted = edges.groupBy(time_slice("t").alias("s")).count()
    assert {r.s: r["count"] for r in counted.collect()}[None] == 1


def test_slice_rejects_other_edges():
    with pytest.raises(ValueError):
        time_slice("t", edge="middle")


@pytest.mark.parametrize(
    "unit,a,b,expected",
    [
        ("minute", "2024-01-01 12:00:59", "2024-01-01 12:01:00", 1),
        ("minute", "2024-01-01 12:01:00", "2024-01-01 12:00:59", -1),
        ("minute", "2024-01-01 12:00:00", "2024-01-01 12:00:59", 0),
        ("second", "1969-12-31 23:59:59.9", "1970-01-01 00:00:00.1", 1),
        ("hour", "2024-01-01 12:59:59", "2024-01-01 14:00:00", 2),
        ("day", "2024-01-01 23:59:59", "2024-01-02 00:00:00", 1),
    ],
)
def test_datediff_counts_boundaries(spark, unit, a, b, expected):
    assert one(spark, d=datediff_boundary(unit, ntz(a), ntz(b))).d == expected


def test_datediff_of_null_is_null(spark):
    missing = F.lit(None).cast("timestamp_ntz")
    assert one(spark, d=datediff_boundary("minute", missing, ntz("2024-01-01"))).d is None


def test_epoch_to_ts(spark):
    got = one(spark, t=epoch_to_ts(ntz("2024-01-01"), F.lit(1_000_000).cast("long"), 5))
    assert got.t == ts(2024, 2, 27, 20, 53, 20)


def test_text_truncates(spark):
    t = ntz("2024-01-01 10:20:30.9999")
    got = one(spark, s=time_text(t), m=time_text(t, millis=True))
    assert got.s == "2024-01-01 10:20:30"
    assert got.m == "2024-01-01 10:20:30.999"


def test_trailing(spark):
    df = spark.createDataFrame(
        [(1, ts(2024, 1, 1, 10)), (2, ts(2024, 1, 1, 11)), (3, ts(2024, 1, 1, 12)), (4, None)],
        "i int, t timestamp_ntz",
    )
    assert [r.i for r in trailing(df, "t", hours=1).orderBy("i").collect()] == [2, 3]
    assert [r.i for r in trailing(df, "t", hours=0.5, as_of=ts(2024, 1, 1, 11, 30)).collect()] == [2, 3]


def test_ranges_prune_days(spark, tmp_path):
    path = str(tmp_path / "t")
    days = [ts(2024, 1, d, h) for d in range(1, 9) for h in (1, 23)]
    append_by_day(spark.createDataFrame([(d,) for d in [*days, None]], "t timestamp_ntz"), path, ts="t")
    table = spark.read.parquet(path)
    df = trailing(table, "t", hours=30, day="date")
    assert sorted(r.t for r in df.collect()) == days[-3:]
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert any("date" in f and ">=" in f for f in filters)
    fixed = trailing(table, "t", hours=24, as_of=ts(2024, 1, 8, 12), day="date")
    assert len(fixed.inputFiles()) and sorted(r.t for r in fixed.collect()) == days[-3:]
    assert table.select(newest(table, "t", day="date").alias("n")).first().n == days[-1]


def test_value_checks(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (None, 2.0), (float("nan"), 2.0), (-3.0, None)], "a double, b double"
    )
    rows = df.select(
        any_missing(["a", "b"]).alias("missing"),
        greatest_or_null(F.col("a"), F.col("b")).alias("g"),
        clamp_at_zero(F.col("a")).alias("z"),
    ).collect()
    assert [r.missing for r in rows] == [False, True, True, True]
    assert rows[0].g == 2.0 and rows[1].g is None and rows[3].g is None
    assert rows[0].z == 1.0 and rows[1].z is None and rows[3].z == 0.0
