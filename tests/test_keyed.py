from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorloom.operators import keyed, windows
from sensorloom.operators.windows import latest_per


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def target(spark):
    return spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")


def test_upsert_writes_null_over_a_value(spark, target):
    source = spark.createDataFrame([("b", None), ("c", 3.0)], "k string, v double")
    assert rows(keyed.upsert(target, source, "k")) == [("a", 1.0), ("b", None), ("c", 3.0)]


def test_upsert_twice_is_upsert_once(spark, target):
    source = spark.createDataFrame([("b", None), ("c", 3.0)], "k string, v double")
    once = keyed.upsert(target, source, "k")
    assert rows(keyed.upsert(once, source, "k")) == rows(once)


def test_upsert_keeps_the_newest_source_row(spark, target):
    source = spark.createDataFrame([("b", 5.0, 1), ("b", 6.0, 2)], "k string, v double, at int")
    wide = target.withColumn("at", F.lit(0))
    assert rows(keyed.upsert(wide, source, "k", order="at")) == [("a", 1.0, 0), ("b", 6.0, 2)]


def test_upsert_leaves_unnamed_columns_and_fills_inserts(spark):
    wide = spark.createDataFrame([("a", 1, "x")], "k string, v int, note string")
    source = spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    got = keyed.upsert(wide, source, "k", insert_defaults={"note": "new"})
    assert rows(got) == [("a", 2, "x"), ("b", 3, "new")]


def test_upsert_null_keys_never_match(spark, target):
    source = spark.createDataFrame([(None, 9.0)], "k string, v double")
    with_null = target.unionByName(source)
    assert keyed.upsert(with_null, source, "k").count() == 4


def test_append_twice_adds_nothing(spark, target):
    new = spark.createDataFrame([("b", 9.0), ("c", 3.0)], "k string, v double")
    once = keyed.append_if_absent(target, new, "k")
    assert rows(once) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    assert rows(keyed.append_if_absent(once, new, "k")) == rows(once)


def test_update_where_ignores_null_conditions(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    got = keyed.update_where(df, F.col("v") < 5, {"v": F.lit(0)})
    assert rows(got) == [("a", 0), ("b", None)]


def test_update_if_exists_does_not_multiply(spark, target):
    other = spark.createDataFrame([("a", 2.0), ("a", 2.0)], "kind string, n double")
    got = keyed.update_if_exists(
        target, other, {"kind": F.col("k"), "n": F.col("v") + 1}, {"v": F.col("v") + 1}
    )
    assert rows(got) == [("a", 2.0), ("b", 2.0)]


def test_update_from_map_ignores_unknown_keys_and_sets_null(spark, target):
    updates = spark.createDataFrame([("a", None), ("z", 1.0)], "k string, v double")
    assert rows(keyed.update_from_map(target, updates, "k")) == [("a", None), ("b", 2.0)]


def test_update_from_map_does_not_multiply(spark, target):
    updates = spark.createDataFrame([("a", 5.0), ("a", 7.0), ("a", None)], "k string, v double")
    twice = target.unionByName(target)
    assert rows(keyed.update_from_map(twice, updates, "k")) == [("a", 7.0)] * 2 + [("b", 2.0)] * 2


def test_delete_not_in(spark, target):
    keep = spark.createDataFrame([("b",), ("b",)], "k string")
    assert rows(keyed.delete_not_in(target, keep, "k")) == [("b", 2.0)]


def test_emptied_and_defaults(spark, target):
    assert keyed.emptied(target).count() == 0
    got = keyed.with_defaults(target, {"v": 0.0, "status": "NORMAL"})
    assert rows(got) == [("a", 1.0, "NORMAL"), ("b", 2.0, "NORMAL")]


def test_window_builders(spark):
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(5)], "k string, t int, v double")
    w = windows.by_entity_time("k", "t")
    got = df.select(
        "t",
        windows.delta("v", w).alias("delta"),
        windows.slope("v", w, 2.0).alias("slope"),
        windows.acceleration("v", w).alias("acceleration"),
        windows.rolling_mean("v", w).alias("rolling"),
        windows.cumulative_sum("v", w).alias("total"),
        windows.cumulative_count_if(F.col("v") > 1, w).alias("hits"),
    ).orderBy("t").collect()
    assert [r.delta for r in got] == [None, 1, 3, 5, 7]
    assert [r.slope for r in got] == [None, 0.5, 1.5, 2.5, 3.5]
    assert [r.acceleration for r in got] == [None, None, 2, 2, 2]
    assert [round(r.rolling, 6) for r in got] == [0, 0.5, 1.666667, 4.666667, 9.666667]
    assert [r.total for r in got] == [0, 1, 5, 14, 30]
    assert [r.hits for r in got] == [0, 0, 1, 2, 3]


def test_latest_puts_null_first(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("a", t, 1, "x"), ("a", None, 2, "y"), ("b", t, 3, "x")],
        "k string, t timestamp_ntz, n int, s string",
    )
    expected = [("a", None, 2, "y"), ("b", t, 3, "x")]
    assert rows(latest_per(df, "k", "t")) == expected
    assert rows(latest_per(df, "k", "t", few=["s"])) == expected
    assert rows(latest_per(df.drop("s"), "k", "t")) == [r[:3] for r in expected]


_readings = st.lists(
    st.tuples(
        st.sampled_from(["a", "b", None]),
        st.one_of(st.none(), st.integers(0, 50)),
        st.sampled_from(["x", "y"]),
    ),
    min_size=1,
    max_size=30,
    unique_by=lambda r: r[:2],
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(_readings)
def test_latest_agrees_with_sorting(spark, readings):
    base = datetime(2024, 1, 1)
    data = [(k, None if s is None else base.replace(second=s), s, kind) for k, s, kind in readings]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, n int, s string")
    best = {}
    for row in data:
        old = best.get(row[0])
        if old is None or old[1] is not None and (row[1] is None or row[1] > old[1]):
            best[row[0]] = row
    expected = sorted(best.values(), key=str)
    assert rows(latest_per(df, "k", "t", few=["s"])) == expected
    assert rows(latest_per(df, "k", ["t", "n"])) == expected


def test_latest_with_further_aggregates_of_the_key(spark):
    data = [("a", datetime(2024, 1, 1), 1, "x"), ("a", None, 2, "y"), ("b", None, 3, "z")]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, n int, s string")
    expected = [("a", None, 2, datetime(2024, 1, 1)), ("b", None, 3, None)]
    seen = {"seen": F.max("t")}
    assert rows(latest_per(df.drop("s"), "k", "t", extra=seen)) == expected
    assert rows(latest_per(df, "k", "t", extra=seen).drop("s")) == expected
    with pytest.raises(ValueError):
        latest_per(df, "k", "t", few=["s"], extra=seen)
