"""The default rules over plain arrays, as an outside model would be written.

Each loader returns a function of a matrix whose columns are the features in
their fixed order.
"""

from __future__ import annotations

import numpy as np

from sensorloom.plans.scoring import RuleScorer
from sensorloom.schemas import (
    BASIC_FEATURES,
    ELECTRICAL_FAILURE,
    ENGINE_FAILURE,
    NORMAL,
    TEMPORAL_FEATURES,
    TRANSMISSION_FAILURE,
)

_RULES = RuleScorer()


def _column(matrix, names, name) -> np.ndarray:
    return matrix[:, names.index(name)]


def _hours(distance, rate) -> np.ndarray:
    return distance / np.maximum(np.abs(rate), _RULES.least_rate) / 60.0


def classifier():
    """The classifier sees no running totals, so volatility alone decides."""

    def predict(m):
        volatile = _column(m, BASIC_FEATURES, "stddev_battery_voltage") > _RULES.volatility
        low = _column(m, BASIC_FEATURES, "rolling_avg_trans_oil_pressure") < _RULES.low_pressure
        hot = _column(m, BASIC_FEATURES, "rolling_avg_engine_temp") > _RULES.hot_engine
        return np.select(
            [volatile, low, hot],
            [ELECTRICAL_FAILURE, TRANSMISSION_FAILURE, ENGINE_FAILURE],
            default=NORMAL,
        )

    return predict


def basic():
    def predict(m):
        engine = _hours(
            _RULES.temp_limit - _column(m, BASIC_FEATURES, "rolling_avg_engine_temp"),
            _column(m, BASIC_FEATURES, "slope_engine_temp"),
        )
        transmission = _hours(
            _column(m, BASIC_FEATURES, "rolling_avg_trans_oil_pressure") - _RULES.pressure_limit,
            _column(m, BASIC_FEATURES, "slope_trans_oil_pressure"),
        )
        return np.minimum(engine, transmission)

    return predict


def temporal():
    def predict(m):
        elevated = np.maximum(_column(m, TEMPORAL_FEATURES, "elevated_window_count"), 1.0)
        spent = _column(m, TEMPORAL_FEATURES, "cumulative_volatility") / elevated
        rate = _column(m, TEMPORAL_FEATURES, "volatility_delta") / _RULES.minutes
        return _hours(_RULES.volatility_limit - spent, rate)

    return predict
