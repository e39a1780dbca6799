"""Table schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

SENSORS = ("engine_temp", "trans_oil_pressure", "battery_voltage")

_SENSOR_FIELDS = [T.StructField(name, T.DoubleType()) for name in SENSORS]


def _struct(*fields) -> T.StructType:
    return T.StructType([f if isinstance(f, T.StructField) else T.StructField(*f) for f in fields])


_NTZ, _STR, _LONG, _DBL = T.TimestampNTZType(), T.StringType(), T.LongType(), T.DoubleType()

TELEMETRY = _struct(("timestamp", _NTZ), ("entity_id", _STR), *_SENSOR_FIELDS, ("status", _STR))
NORMAL_SEED = _struct(("entity_id", _STR), ("epoch", _LONG), *_SENSOR_FIELDS)
FAILURE_SEED = _struct(("epoch", _LONG), *_SENSOR_FIELDS)
FAILURE_TRACES = _struct(("failure_type", _STR), ("epoch", _LONG), *_SENSOR_FIELDS)
STREAM_STATE = _struct(
    ("stream_name", _STR),
    ("start_ts", _NTZ),
    ("next_epoch", _LONG),
    ("step_seconds", _LONG),
    ("last_updated", _NTZ),
)
FAILURE_CONFIG = _struct(
    ("entity_id", _STR),
    ("failure_type", _STR),
    ("enabled", T.BooleanType()),
    ("effective_from_epoch", _LONG),
    ("failure_next_epoch", _LONG),
    ("created_at", _NTZ),
    ("updated_at", _NTZ),
)
PREDICTION_CACHE = _struct(
    ("entity_id", _STR),
    ("prediction_timestamp", _NTZ),
    ("predicted_failure_type", _STR),
    ("predicted_hours_to_failure", _DBL),
    ("ttf_model_used", _STR),
    ("current_engine_temp", _DBL),
    ("current_trans_pressure", _DBL),
    ("current_battery_voltage", _DBL),
    ("last_updated", _NTZ),
)
ACTIVE_FAILURES = _struct(
    ("entity_id", _STR),
    ("failure_type", _STR),
    ("started_at", _NTZ),
    ("epoch_started", _LONG),
    ("last_updated", _NTZ),
)
FIRST_FAILURE_MARKERS = _struct(
    ("entity_id", _STR),
    ("first_failure_time", _NTZ),
    ("failure_type", _STR),
    ("last_updated", _NTZ),
)

# Fixed values. Configuration names a failure by the first list, predictions
# name a class by the second; the two are never joined.
FAILURE_TYPES = ("ENGINE", "TRANSMISSION", "ELECTRICAL")
NORMAL = "NORMAL"
ENGINE_FAILURE = "ENGINE_FAILURE"
TRANSMISSION_FAILURE = "TRANSMISSION_FAILURE"
ELECTRICAL_FAILURE = "ELECTRICAL_FAILURE"
MODEL_BASIC = "basic_11_features"
MODEL_TEMPORAL = "temporal_16_features"
MODEL_NONE = "none"
DEFAULT_STATUS = "NORMAL"

BASIC_FEATURES = (
    "avg_engine_temp",
    "avg_trans_oil_pressure",
    "avg_battery_voltage",
    "stddev_battery_voltage",
    "stddev_engine_temp",
    "stddev_trans_oil_pressure",
    "slope_engine_temp",
    "slope_trans_oil_pressure",
    "slope_battery_voltage",
    "rolling_avg_engine_temp",
    "rolling_avg_trans_oil_pressure",
)
TEMPORAL_FEATURES = BASIC_FEATURES + (
    "cumulative_volatility",
    "elevated_window_count",
    "volatility_delta",
    "temp_acceleration",
    "pressure_acceleration",
)
