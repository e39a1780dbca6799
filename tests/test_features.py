import math
from datetime import datetime, timedelta
from statistics import mean, stdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.plans import array_rules, features, models, partials, scoring, serving
from sensorloom.schemas import (
    BASIC_FEATURES,
    ELECTRICAL_FAILURE,
    ENGINE_FAILURE,
    NORMAL,
    TELEMETRY,
    TEMPORAL_FEATURES,
    TRANSMISSION_FAILURE,
)
from sensorloom.sources import derived

START = datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def reading(seconds, value, entity="a"):
    at = None if seconds is None else START + timedelta(seconds=seconds)
    return (at, entity, 200.0 + value, 45.0 + value, 13.0 + value, "NORMAL")


def window(index, n, entity="a"):
    """``n`` readings in the slice of that index, values made from both."""
    return [reading(300 * index + 4 * i, math.sin(index * 7 + i * i), entity) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, TELEMETRY)


def rounded(df, digits=9):
    return df.select(
        *[
            F.round(c, digits).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def same(a, b):
    a, b = rounded(a), rounded(b.select(*a.columns))
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def thin(spark):
    return window(0, 60) + window(1, 5) + window(2, 60) + window(6, 1) + window(7, 20)


def expected(parts, i):
    """Features of the i-th window from plain arithmetic."""
    temp = [mean(r[2] for r in p) for p in parts]
    sd = [stdev([r[4] for r in p]) if len(p) > 1 else None for p in parts]
    known = [s for s in sd[: i + 1] if s is not None]
    lag = lambda xs, k=1: xs[i - k] if i >= k else None
    out = {
        "slope_engine_temp": (temp[i] - lag(temp)) / 5.0 if i >= 1 else 0.0,
        "rolling_avg_engine_temp": mean(temp[max(0, i - 2) : i + 1]),
        "cumulative_volatility": sum(known),
        "elevated_window_count": sum(s > 0.7 for s in known),
        "volatility_delta": sd[i] - lag(sd) if i >= 1 and lag(sd) is not None else 0.0,
        "temp_acceleration": (temp[i] - lag(temp)) - (lag(temp) - lag(temp, 2)) if i >= 2 else 0.0,
    }
    return out


def test_thin_windows_feed_later_ones(spark, thin):
    got = features.temporal_features(features.window_stats(frame(spark, thin)))
    rows = got.orderBy("feature_timestamp").collect()
    parts = [window(0, 60), window(1, 5), window(2, 60), window(6, 1), window(7, 20)]
    assert len(rows) == 3
    for row, i in zip(rows, (0, 2, 4)):
        for name, value in expected(parts, i).items():
            assert row[name] == pytest.approx(value, abs=1e-9), (i, name)


def test_single_row_window_has_no_deviation(spark):
    stats = features.window_stats(frame(spark, window(0, 1))).first()
    assert stats.stddev_engine_temp is None and stats.record_count == 1


def test_null_times_form_a_last_window(spark, thin):
    rows = thin + [reading(None, 1.0)] * 12
    got = features.temporal_features(features.window_stats(frame(spark, rows)))
    assert got.count() == 4
    last = features.latest_features(got).first()
    assert last.feature_timestamp is None
    assert last.cumulative_volatility == pytest.approx(
        sum(stdev([r[4] for r in window(i, n)]) for i, n in ((0, 60), (1, 5), (2, 60), (7, 20)))
    )


@pytest.mark.parametrize("cut", [1, 2, 3, 6, 8])
def test_carry_gives_the_same_features(spark, thin, cut):
    rows = thin + window(1, 30, "b") + window(6, 30, "b") + window(7, 30, "c")
    stats = features.window_stats(frame(spark, rows))
    at = F.lit(str(START + timedelta(minutes=5 * cut))).cast("timestamp_ntz")
    early, late = stats.filter(F.col("window_start") < at), stats.filter(F.col("window_start") >= at)
    carry = features.feature_carry(early)
    both = features.temporal_features(early).unionByName(features.temporal_features(late, carry=carry))
    assert same(both, features.temporal_features(stats))


def test_carry_of_carry(spark, thin):
    stats = features.window_stats(frame(spark, thin))
    part = lambda lo, hi: stats.filter(
        F.col("window_start").between(
            F.lit(str(START + timedelta(minutes=5 * lo))).cast("timestamp_ntz"),
            F.lit(str(START + timedelta(minutes=5 * hi))).cast("timestamp_ntz"),
        )
    )
    stepwise = features.feature_carry(part(2, 6), carry=features.feature_carry(part(0, 1)))
    assert same(stepwise, features.feature_carry(part(0, 6)))
    nothing_new = features.feature_carry(part(90, 91), carry=stepwise)
    assert same(nothing_new, stepwise)


def test_segments_give_the_same_features(spark, thin):
    days = [
        (START + timedelta(days=d), "a" if d % 3 else "b", 200.0 + d * d % 7, 40.0 + d % 5, 12 + d % 2.3, "NORMAL")
        for d in range(40)
        for _ in range(2)
        if d not in (9, 10, 11, 12, 13, 14, 15, 16, 17)
    ]
    tel = frame(spark, thin + days + [reading(None, 1.0)] * 3)
    stats = features.window_stats(tel)
    plain = features.temporal_features(stats, min_records=1)
    for length in (1, 4, 1000):
        assert same(features.temporal_features(stats, min_records=1, segment_days=length), plain)


def test_carry_and_segments_exclude_each_other(spark, thin):
    stats = features.window_stats(frame(spark, thin))
    with pytest.raises(ValueError):
        features.running_features(stats, carry=features.feature_carry(stats), segment_days=1)


def test_partials_add_up(spark, thin):
    rows = thin + [reading(None, 0.5)] * 2 + [(START, "n", None, 1.0, None, "NORMAL")] * 3
    halves = [frame(spark, rows[::2]), frame(spark, rows[1::2])]
    merged = partials.merge_partials(*[partials.window_partials(h) for h in halves])
    assert same(partials.stats_of(merged), features.window_stats(frame(spark, rows)))


def test_constant_readings_have_no_deviation_after_merging(spark):
    rows = [(START, "a", 199.3, 45.1, 13.7, "NORMAL")] * 7
    parts = [partials.window_partials(frame(spark, rows[:3])), partials.window_partials(frame(spark, rows))]
    assert partials.stats_of(partials.merge_partials(*parts)).first().stddev_engine_temp < 1e-12


def test_counts_of_the_cut_traces(spark):
    """Known counts when every trace is cut at epoch 560."""
    normal = derived.normal_seed(spark, SF).filter("epoch <= 560")
    tel = derived.telemetry_of(normal)
    stats = features.window_stats(tel)
    assert (tel.count(), stats.count(), stats.filter("record_count >= 12").count()) == (5585, 100, 99)
    status = serving.fleet_status(tel, normal).groupBy("status").count()
    assert {r.status: r["count"] for r in status.collect()} == {"ONLINE": 9, "OFFLINE": 1}
    predicted = scoring.hybrid_prediction(features.temporal_features(stats), scoring.RuleScorer())
    classes = predicted.groupBy("predicted_failure_type").count().collect()
    assert {r.predicted_failure_type: r["count"] for r in classes} == {
        NORMAL: 5,
        ENGINE_FAILURE: 3,
        ELECTRICAL_FAILURE: 2,
    }


# --- scoring ------------------------------------------------------------


def feature_row(**changes):
    row = dict.fromkeys(TEMPORAL_FEATURES, 0.0)
    row.update(avg_engine_temp=200.0, rolling_avg_trans_oil_pressure=50.0, rolling_avg_engine_temp=200.0)
    row.update(elevated_window_count=0)
    row.update(changes)
    return row


@pytest.fixture(scope="module")
def cases(spark):
    rows = {
        "normal": feature_row(),
        "engine": feature_row(rolling_avg_engine_temp=300.0),
        "transmission": feature_row(rolling_avg_trans_oil_pressure=30.0, slope_trans_oil_pressure=-1.0),
        "electrical": feature_row(
            stddev_battery_voltage=0.9, elevated_window_count=3, cumulative_volatility=3.0
        ),
        "null": feature_row(rolling_avg_engine_temp=300.0, stddev_battery_voltage=None),
        "nan": feature_row(rolling_avg_engine_temp=300.0, stddev_engine_temp=float("nan")),
    }
    types = ", ".join(
        f"{c} {'bigint' if c == 'elevated_window_count' else 'double'}" for c in TEMPORAL_FEATURES
    )
    data = [(k, START, *[r[c] for c in TEMPORAL_FEATURES]) for k, r in rows.items()]
    return spark.createDataFrame(data, f"entity_id string, feature_timestamp timestamp_ntz, {types}")


def routed(predictions):
    return {
        r.entity_id: (r.predicted_failure_type, r.predicted_hours_to_failure, r.ttf_model_used)
        for r in predictions.collect()
    }


def test_rules_route_clamp_and_pass_over_missing_values(cases):
    got = routed(scoring.hybrid_prediction(cases, scoring.RuleScorer()))
    assert got["normal"] == (NORMAL, None, "none")
    assert got["null"] == got["nan"] == (NORMAL, None, "none")
    assert got["engine"] == (ENGINE_FAILURE, 0.0, "basic_11_features")
    assert got["transmission"][0] == TRANSMISSION_FAILURE
    assert got["transmission"][1] == pytest.approx(10.0 / 60)
    assert got["electrical"] == (ELECTRICAL_FAILURE, pytest.approx(4.0 / 0.05 / 60), "temporal_16_features")


def test_array_functions_agree_with_rules(cases):
    scorer = models.FunctionScorer(array_rules.classifier, array_rules.basic, array_rules.temporal)
    got = routed(scoring.hybrid_prediction(cases, scorer))
    rules = routed(scoring.hybrid_prediction(cases, scoring.RuleScorer()))
    assert {k: (c, None if h is None else round(h, 9), m) for k, (c, h, m) in got.items()} == {
        k: (c, None if h is None else round(h, 9), m) for k, (c, h, m) in rules.items()
    }


def test_models_see_only_their_route(cases):
    def only(kind):
        def load():
            def predict(matrix):
                hot = matrix[:, BASIC_FEATURES.index("rolling_avg_engine_temp")] > 250
                low = matrix[:, BASIC_FEATURES.index("rolling_avg_trans_oil_pressure")] < 40
                if kind == "basic" and not (hot | low).all():
                    raise AssertionError("a row of another route")
                if kind == "temporal" and (hot | low).any():
                    raise AssertionError("a row of another route")
                return np.full(len(matrix), -1.0)

            return predict

        return load

    scorer = models.FunctionScorer(array_rules.classifier, only("basic"), only("temporal"))
    got = routed(scoring.hybrid_prediction(cases, scorer))
    assert got["engine"][1] == got["electrical"][1] == 0.0
    assert got["normal"][1] is None


def test_trained_models(spark, tmp_path):
    rows = features.temporal_features(features.window_stats(derived.telemetry(spark, SF)))
    rules = scoring.RuleScorer()
    labelled = rows.withColumns(
        {"kind": rules.class_expr(), "near": rules.basic_expr(), "far": rules.temporal_expr()}
    ).cache()
    scorer = models.fit_scorer(
        labelled, label="kind", basic_hours="near", temporal_hours="far", trees=2, depth=3
    )
    scorer.save(str(tmp_path / "models"))
    loaded = models.MLScorer.load(str(tmp_path / "models"))
    got = routed(scoring.hybrid_prediction(rows, scorer))
    assert routed(scoring.hybrid_prediction(rows, loaded)) == got
    assert len(got) == 10
    for kind, hours, model in got.values():
        assert (kind == NORMAL) == (hours is None) == (model == "none")
        assert hours is None or hours >= 0.0
    missing = rows.withColumn("avg_engine_temp", F.lit(None).cast("double"))
    assert set(routed(scoring.hybrid_prediction(missing, loaded)).values()) == {(NORMAL, None, "none")}
