"""The named queries in SQL, run by a second engine to check the results."""

from __future__ import annotations

# Relations that the queries share, in order of dependence.
_RELATIONS = {
    "ranked": """
        SELECT *, row_number() OVER (
            PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice
        ) AS epoch
        FROM lineitem""",
    "normal_seed": """
        SELECT 'TRUCK_' || l_suppkey AS entity_id, epoch, l_returnflag,
               180.0::DOUBLE + l_quantity AS engine_temp,
               40.0::DOUBLE + 100.0::DOUBLE * l_discount AS trans_oil_pressure,
               12.0::DOUBLE + 28.0::DOUBLE * l_tax AS battery_voltage
        FROM ranked""",
    "telemetry": """
        SELECT TIMESTAMP '2024-01-01 00:00:00' + to_seconds(5 * epoch) AS ts, entity_id, epoch,
               engine_temp, trans_oil_pressure, battery_voltage, 'NORMAL' AS status
        FROM normal_seed""",
    "mean_seed": """
        SELECT epoch,
               sum(l_quantity::BIGINT)::DOUBLE / count(*)::DOUBLE AS q,
               sum(round(l_discount * 100)::BIGINT)::DOUBLE / count(*)::DOUBLE AS d,
               sum(round(l_tax * 100)::BIGINT)::DOUBLE / count(*)::DOUBLE AS t
        FROM ranked GROUP BY epoch""",
    "failure_traces": """
        SELECT 'ENGINE' AS failure_type, epoch,
               (180.0::DOUBLE + q) + 0.05::DOUBLE * epoch AS engine_temp,
               40.0::DOUBLE + d AS trans_oil_pressure,
               12.0::DOUBLE + 0.28::DOUBLE * t AS battery_voltage
        FROM mean_seed
        UNION ALL
        SELECT 'TRANSMISSION', epoch, 180.0::DOUBLE + q,
               (40.0::DOUBLE + d) - 0.02::DOUBLE * epoch,
               12.0::DOUBLE + 0.28::DOUBLE * t
        FROM mean_seed
        UNION ALL
        SELECT 'ELECTRICAL', epoch, 180.0::DOUBLE + q, 40.0::DOUBLE + d,
               12.0::DOUBLE + (0.28::DOUBLE * t) * (1.0::DOUBLE + epoch / 300.0::DOUBLE)
        FROM mean_seed""",
    "failure_config": """
        SELECT 'TRUCK_' || s_suppkey AS entity_id,
               CASE s_suppkey % 3
                   WHEN 0 THEN 'ENGINE' WHEN 1 THEN 'TRANSMISSION' ELSE 'ELECTRICAL'
               END AS failure_type,
               s_acctbal < 4000 AS enabled,
               90 + s_suppkey % 30 AS effective_from_epoch,
               nullif((s_suppkey * 13) % 900, 0) AS failure_next_epoch,
               TIMESTAMP '2024-01-01 00:00:00' AS created_at,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(s_suppkey) AS updated_at
        FROM supplier WHERE s_acctbal < 5000""",
    "cache_times": """
        SELECT s_suppkey, s_suppkey % 4 AS kind,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds((s_suppkey * 397) % 4800 - 1200) AS made
        FROM supplier WHERE s_acctbal >= 0""",
    "prediction_cache": """
        SELECT 'TRUCK_' || s_suppkey AS entity_id, made AS prediction_timestamp,
               CASE kind WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'ENGINE_FAILURE'
                   WHEN 2 THEN 'TRANSMISSION_FAILURE' ELSE 'ELECTRICAL_FAILURE'
               END AS predicted_failure_type,
               CASE WHEN kind <> 0 THEN (s_suppkey % 48)::DOUBLE + 0.5::DOUBLE END
                   AS predicted_hours_to_failure,
               CASE kind WHEN 0 THEN 'none' WHEN 3 THEN 'temporal_16_features'
                   ELSE 'basic_11_features' END AS ttf_model_used,
               200.0::DOUBLE AS current_engine_temp, 45.0::DOUBLE AS current_trans_pressure,
               13.0::DOUBLE AS current_battery_voltage,
               made + INTERVAL 1234 MILLISECOND AS last_updated
        FROM cache_times""",
    "markers": """
        SELECT 'TRUCK_' || s_suppkey AS entity_id,
               TIMESTAMP '2024-01-01 00:00:00' AS first_failure_time,
               CASE WHEN s_suppkey % 3 = 1 THEN 'ENGINE_FAILURE' ELSE 'ELECTRICAL_FAILURE' END
                   AS failure_type,
               TIMESTAMP '2024-01-01 00:00:00' AS last_updated
        FROM supplier WHERE s_acctbal >= 3000""",
    "existing": """
        SELECT * FROM telemetry
        WHERE epoch <= 100 OR (epoch <= 105 AND engine_temp >= 220)""",
    "agg": """
        SELECT time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS bucket_time, entity_id,
               avg(engine_temp) AS avg_engine_temp,
               avg(trans_oil_pressure) AS avg_trans_oil_pressure,
               avg(battery_voltage) AS avg_battery_voltage,
               count(*) AS point_count, max(ts) AS latest_timestamp
        FROM telemetry GROUP BY 1, 2""",
    "stats": """
        SELECT entity_id, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start,
               max(ts) AS feature_timestamp,
               avg(engine_temp) AS avg_engine_temp,
               avg(trans_oil_pressure) AS avg_trans_oil_pressure,
               avg(battery_voltage) AS avg_battery_voltage,
               stddev_samp(engine_temp) AS stddev_engine_temp,
               stddev_samp(trans_oil_pressure) AS stddev_trans_oil_pressure,
               stddev_samp(battery_voltage) AS stddev_battery_voltage,
               count(*) AS record_count
        FROM telemetry GROUP BY 1, 2""",
    "running": """
        SELECT *,
               (avg_engine_temp - lag(avg_engine_temp) OVER w) / 5.0::DOUBLE AS slope_engine_temp,
               (avg_trans_oil_pressure - lag(avg_trans_oil_pressure) OVER w) / 5.0::DOUBLE
                   AS slope_trans_oil_pressure,
               (avg_battery_voltage - lag(avg_battery_voltage) OVER w) / 5.0::DOUBLE
                   AS slope_battery_voltage,
               avg(avg_engine_temp) OVER last3 AS rolling_avg_engine_temp,
               avg(avg_trans_oil_pressure) OVER last3 AS rolling_avg_trans_oil_pressure,
               sum(stddev_battery_voltage) OVER sofar AS cumulative_volatility,
               (sum(CASE WHEN stddev_battery_voltage > 0.7::DOUBLE THEN 1 ELSE 0 END) OVER sofar)::BIGINT
                   AS elevated_window_count,
               stddev_battery_voltage - lag(stddev_battery_voltage) OVER w AS volatility_delta,
               (avg_engine_temp - lag(avg_engine_temp) OVER w)
                   - (lag(avg_engine_temp) OVER w - lag(avg_engine_temp, 2) OVER w)
                   AS temp_acceleration,
               (avg_trans_oil_pressure - lag(avg_trans_oil_pressure) OVER w)
                   - (lag(avg_trans_oil_pressure) OVER w - lag(avg_trans_oil_pressure, 2) OVER w)
                   AS pressure_acceleration
        FROM stats
        WINDOW w AS (PARTITION BY entity_id ORDER BY feature_timestamp),
               last3 AS (PARTITION BY entity_id ORDER BY feature_timestamp
                         ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
               sofar AS (PARTITION BY entity_id ORDER BY feature_timestamp
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "features": """
        SELECT entity_id, feature_timestamp, avg_engine_temp, avg_trans_oil_pressure,
               avg_battery_voltage, stddev_battery_voltage, stddev_engine_temp,
               stddev_trans_oil_pressure,
               coalesce(slope_engine_temp, 0) AS slope_engine_temp,
               coalesce(slope_trans_oil_pressure, 0) AS slope_trans_oil_pressure,
               coalesce(slope_battery_voltage, 0) AS slope_battery_voltage,
               rolling_avg_engine_temp, rolling_avg_trans_oil_pressure,
               coalesce(cumulative_volatility, 0) AS cumulative_volatility,
               coalesce(elevated_window_count, 0) AS elevated_window_count,
               coalesce(volatility_delta, 0) AS volatility_delta,
               coalesce(temp_acceleration, 0) AS temp_acceleration,
               coalesce(pressure_acceleration, 0) AS pressure_acceleration
        FROM running WHERE record_count >= 12""",
    "latest": """
        SELECT * FROM features
        QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY feature_timestamp DESC) = 1""",
    "scored": """
        SELECT *,
               avg_engine_temp IS NULL OR avg_trans_oil_pressure IS NULL
                   OR avg_battery_voltage IS NULL OR stddev_battery_voltage IS NULL
                   OR stddev_engine_temp IS NULL OR stddev_trans_oil_pressure IS NULL AS missing,
               CASE
                   WHEN avg_engine_temp IS NULL OR avg_trans_oil_pressure IS NULL
                       OR avg_battery_voltage IS NULL OR stddev_battery_voltage IS NULL
                       OR stddev_engine_temp IS NULL OR stddev_trans_oil_pressure IS NULL
                       THEN 'NORMAL'
                   WHEN stddev_battery_voltage > 0.7::DOUBLE AND elevated_window_count >= 2
                       THEN 'ELECTRICAL_FAILURE'
                   WHEN rolling_avg_trans_oil_pressure < 44.7::DOUBLE THEN 'TRANSMISSION_FAILURE'
                   WHEN rolling_avg_engine_temp > 206.0::DOUBLE THEN 'ENGINE_FAILURE'
                   ELSE 'NORMAL'
               END AS predicted_failure_type,
               least(
                   greatest(0.0::DOUBLE, (250.0::DOUBLE - rolling_avg_engine_temp)
                       / greatest(abs(slope_engine_temp), 0.05::DOUBLE) / 60.0::DOUBLE),
                   greatest(0.0::DOUBLE, (rolling_avg_trans_oil_pressure - 20.0::DOUBLE)
                       / greatest(abs(slope_trans_oil_pressure), 0.05::DOUBLE) / 60.0::DOUBLE)
               ) AS hours_basic,
               greatest(0.0::DOUBLE,
                   (5.0::DOUBLE - cumulative_volatility
                       / greatest(elevated_window_count::DOUBLE, 1.0::DOUBLE))
                   / greatest(abs(volatility_delta / 5.0::DOUBLE), 0.05::DOUBLE) / 60.0::DOUBLE
               ) AS hours_temporal
        FROM latest""",
    "predictions": """
        SELECT feature_timestamp AS prediction_timestamp, entity_id,
               avg_engine_temp AS current_engine_temp,
               avg_trans_oil_pressure AS current_trans_pressure,
               avg_battery_voltage AS current_battery_voltage,
               predicted_failure_type,
               CASE WHEN predicted_failure_type = 'ELECTRICAL_FAILURE' THEN hours_temporal
                    WHEN predicted_failure_type <> 'NORMAL' THEN hours_basic
               END AS predicted_hours_to_failure,
               CASE WHEN predicted_failure_type = 'ELECTRICAL_FAILURE' THEN 'temporal_16_features'
                    WHEN predicted_failure_type <> 'NORMAL' THEN 'basic_11_features'
                    ELSE 'none'
               END AS ttf_model_used
        FROM scored""",
    "array_predictions": """
        SELECT feature_timestamp AS prediction_timestamp, entity_id,
               avg_engine_temp AS current_engine_temp,
               avg_trans_oil_pressure AS current_trans_pressure,
               avg_battery_voltage AS current_battery_voltage, kind AS predicted_failure_type,
               CASE WHEN kind = 'ELECTRICAL_FAILURE' THEN hours_temporal
                    WHEN kind <> 'NORMAL' THEN hours_basic END AS predicted_hours_to_failure,
               CASE WHEN kind = 'ELECTRICAL_FAILURE' THEN 'temporal_16_features'
                    WHEN kind <> 'NORMAL' THEN 'basic_11_features' ELSE 'none' END AS ttf_model_used
        FROM (SELECT *, CASE
                  WHEN missing THEN 'NORMAL'
                  WHEN stddev_battery_voltage > 0.7::DOUBLE THEN 'ELECTRICAL_FAILURE'
                  WHEN rolling_avg_trans_oil_pressure < 44.7::DOUBLE THEN 'TRANSMISSION_FAILURE'
                  WHEN rolling_avg_engine_temp > 206.0::DOUBLE THEN 'ENGINE_FAILURE'
                  ELSE 'NORMAL' END AS kind
              FROM scored)""",
    "refreshed": """
        SELECT coalesce(s.entity_id, t.entity_id) AS entity_id,
               CASE WHEN s.entity_id IS NULL THEN t.prediction_timestamp
                    ELSE s.prediction_timestamp END AS prediction_timestamp,
               CASE WHEN s.entity_id IS NULL THEN t.predicted_failure_type
                    ELSE s.predicted_failure_type END AS predicted_failure_type,
               CASE WHEN s.entity_id IS NULL THEN t.predicted_hours_to_failure
                    ELSE s.predicted_hours_to_failure END AS predicted_hours_to_failure,
               CASE WHEN s.entity_id IS NULL THEN t.ttf_model_used
                    ELSE s.ttf_model_used END AS ttf_model_used,
               CASE WHEN s.entity_id IS NULL THEN t.current_engine_temp
                    ELSE s.current_engine_temp END AS current_engine_temp,
               CASE WHEN s.entity_id IS NULL THEN t.current_trans_pressure
                    ELSE s.current_trans_pressure END AS current_trans_pressure,
               CASE WHEN s.entity_id IS NULL THEN t.current_battery_voltage
                    ELSE s.current_battery_voltage END AS current_battery_voltage,
               CASE WHEN s.entity_id IS NULL THEN t.last_updated
                    ELSE TIMESTAMP '2024-01-01 02:00:00' END AS last_updated
        FROM prediction_cache t FULL OUTER JOIN predictions s ON t.entity_id = s.entity_id""",
    "ages": """
        SELECT p.entity_id, p.prediction_timestamp, p.predicted_failure_type,
               p.predicted_hours_to_failure, p.ttf_model_used, p.last_updated,
               t.latest AS latest_telemetry_time,
               CASE WHEN t.latest >= p.prediction_timestamp
                    THEN date_diff('minute', p.prediction_timestamp, t.latest) ELSE 0
               END AS age_minutes,
               CASE WHEN t.latest >= p.prediction_timestamp
                         AND date_diff('minute', p.prediction_timestamp, t.latest) <= 5 THEN 'green'
                    WHEN t.latest >= p.prediction_timestamp
                         AND date_diff('minute', p.prediction_timestamp, t.latest) < 60 THEN 'orange'
                    WHEN t.latest < p.prediction_timestamp THEN 'green'
                    ELSE 'red'
               END AS age_color,
               p.entity_id || '_' || strftime(p.last_updated, '%Y-%m-%d %H:%M:%S.%g')
                   AS prediction_key
        FROM prediction_cache p CROSS JOIN (SELECT max(ts) AS latest FROM telemetry) t""",
    "normal_rows": """
        SELECT n.entity_id, n.epoch, n.engine_temp, n.trans_oil_pressure, n.battery_voltage
        FROM normal_seed n
        WHERE NOT EXISTS (
            SELECT 1 FROM failure_config f
            WHERE f.enabled AND f.entity_id = n.entity_id
              AND coalesce(f.effective_from_epoch, 0) <= n.epoch)""",
    "failing_epochs": """
        SELECT entity_id, failure_type, 100 + g.seq + 1 AS epoch,
               coalesce(failure_next_epoch, 0)
                   + (g.seq + 1 - greatest(0, coalesce(effective_from_epoch, 0) - 101)) AS trace_epoch
        FROM failure_config, (SELECT unnest(range(720)) AS seq) g
        WHERE enabled AND 100 + g.seq + 1 >= coalesce(effective_from_epoch, 0)""",
    "failure_rows": """
        SELECT e.entity_id, e.epoch, f.engine_temp, f.trans_oil_pressure, f.battery_voltage
        FROM failing_epochs e
        JOIN failure_traces f ON f.failure_type = e.failure_type AND f.epoch = e.trace_epoch""",
}

_NEEDS = {
    "ranked": [],
    "normal_seed": ["ranked"],
    "telemetry": ["normal_seed"],
    "mean_seed": ["ranked"],
    "failure_traces": ["mean_seed"],
    "failure_config": [],
    "cache_times": [],
    "prediction_cache": ["cache_times"],
    "markers": [],
    "existing": ["telemetry"],
    "agg": ["telemetry"],
    "stats": ["telemetry"],
    "running": ["stats"],
    "features": ["running"],
    "latest": ["features"],
    "scored": ["latest"],
    "predictions": ["scored"],
    "array_predictions": ["scored"],
    "refreshed": ["prediction_cache", "predictions"],
    "ages": ["prediction_cache", "telemetry"],
    "normal_rows": ["normal_seed", "failure_config"],
    "failing_epochs": ["failure_config"],
    "failure_rows": ["failing_epochs", "failure_traces"],
}


# Events seen as readings of their user, and their six-hour slices.
_EVENT_READINGS = """
        SELECT ts, 'USER_' || user_id AS entity_id, round(value * 100) AS engine_temp,
               (props->>'$.k')::DOUBLE AS trans_oil_pressure,
               length(event_type)::DOUBLE AS battery_voltage, 'NORMAL' AS status
        FROM events"""


def _event_relations() -> dict[str, str]:
    """The shared relations over event readings and six-hour slices."""
    out = {**_RELATIONS, "telemetry": _EVENT_READINGS}
    out["stats"] = out["stats"].replace("INTERVAL 5 MINUTE", "INTERVAL 6 HOUR")
    for name in ("running", "scored"):
        out[name] = out[name].replace("5.0::DOUBLE AS slope", "360.0::DOUBLE AS slope")
    out["running"] = out["running"].replace("/ 5.0::DOUBLE", "/ 360.0::DOUBLE")
    out["features"] = out["features"].replace("record_count >= 12", "record_count >= 2")
    out["scored"] = (
        out["scored"]
        .replace("> 206.0::DOUBLE", "> 6000.0::DOUBLE")
        .replace("250.0::DOUBLE - rolling", "50000.0::DOUBLE - rolling")
        .replace("volatility_delta / 5.0::DOUBLE", "volatility_delta / 360.0::DOUBLE")
    )
    return out


def _with_events(needs: list[str], body: str) -> str:
    return _with(needs, body, _event_relations(), {**_NEEDS, "telemetry": []})


def _with(needs: list[str], body: str, relations=_RELATIONS, needed=_NEEDS) -> str:
    wanted: set[str] = set()
    todo = list(needs)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += needed[name]
    parts = [f"{n} AS ({sql})" for n, sql in relations.items() if n in wanted]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_SENSORS = _r("engine_temp", "trans_oil_pressure", "battery_voltage")
_MEANS = _r("avg_engine_temp", "avg_trans_oil_pressure", "avg_battery_voltage")
_CHART_MEANS = """round(avg_engine_temp, 6) AS engine_temp,
       round(avg_trans_oil_pressure, 6) AS trans_oil_pressure,
       round(avg_battery_voltage, 6) AS battery_voltage"""
_FEATURES = "entity_id, feature_timestamp, elevated_window_count, " + _r(
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
    "cumulative_volatility",
    "volatility_delta",
    "temp_acceleration",
    "pressure_acceleration",
)
_CACHE = """entity_id, prediction_timestamp, predicted_failure_type,
       round(predicted_hours_to_failure, 6) AS predicted_hours_to_failure, ttf_model_used,
       round(current_engine_temp, 6) AS current_engine_temp,
       round(current_trans_pressure, 6) AS current_trans_pressure,
       round(current_battery_voltage, 6) AS current_battery_voltage"""
_LATEST_READING = """
    SELECT * FROM telemetry
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC) = 1"""
_NEW_MARKERS = """
    SELECT p.entity_id, time_bucket(INTERVAL 5 MINUTE, p.prediction_timestamp) AS first_failure_time,
           p.predicted_failure_type AS failure_type,
           TIMESTAMP '2024-01-01 02:00:00' AS last_updated
    FROM {cache} p
    WHERE p.predicted_failure_type <> 'NORMAL'
      AND NOT EXISTS (SELECT 1 FROM markers m WHERE m.entity_id = p.entity_id
                      AND m.failure_type = p.predicted_failure_type)"""
_STAMPED = """
    SELECT TIMESTAMP '2024-01-01 00:00:00' + to_seconds(5 * epoch) AS "timestamp", entity_id,
           {sensors}, 'NORMAL' AS status
    FROM {rows} r
    WHERE epoch BETWEEN 101 AND {last}
      AND NOT EXISTS (
          SELECT 1 FROM existing x WHERE x.entity_id = r.entity_id AND x.epoch = r.epoch)"""

_TICK = """
    SELECT entity_id, epoch, engine_temp, trans_oil_pressure, battery_voltage
    FROM normal_rows
    UNION ALL
    SELECT c.entity_id, 101 AS epoch, f.engine_temp, f.trans_oil_pressure, f.battery_voltage
    FROM failure_config c
    JOIN failure_traces f ON f.failure_type = c.failure_type
        AND f.epoch = coalesce(c.failure_next_epoch, 0) + 1
    WHERE c.enabled AND c.effective_from_epoch <= 101"""

_SNAPSHOT = f"""
    SELECT ts AS "timestamp", entity_id, {_SENSORS}, status FROM telemetry
    WHERE ts = (SELECT max(ts) FROM telemetry)"""
_CHART_AGG = f"""
    SELECT strftime(bucket_time, '%Y-%m-%d %H:%M:%S') AS "timestamp", entity_id, {_CHART_MEANS}
    FROM agg
    WHERE bucket_time >= (SELECT max(bucket_time) FROM agg) - INTERVAL {{back}}
    ORDER BY bucket_time, entity_id LIMIT 2000"""
_CHART_INLINE = f"""
    SELECT strftime(bucket_time, '%Y-%m-%d %H:%M:%S') AS "timestamp", entity_id, {_CHART_MEANS}
    FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS bucket_time, entity_id,
                 avg(engine_temp) AS avg_engine_temp,
                 avg(trans_oil_pressure) AS avg_trans_oil_pressure,
                 avg(battery_voltage) AS avg_battery_voltage
          FROM telemetry
          WHERE ts >= (SELECT max(ts) FROM telemetry) - INTERVAL {{back}}
          GROUP BY 1, 2)
    ORDER BY bucket_time, entity_id LIMIT 2000"""


def all_oracles() -> dict[str, str]:
    tel, cfg = ["telemetry"], ["failure_config"]
    out = {
        "latest_telemetry": _with(
            tel,
            f'SELECT entity_id, ts AS "timestamp", {_SENSORS}, status FROM ({_LATEST_READING})',
        ),
        "latest_telemetry_json": _with(
            tel,
            f"""SELECT '{{"entity_id":"' || entity_id || '","timestamp":"'
                || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g')
                || '","engine_temp":' || engine_temp::VARCHAR
                || ',"trans_oil_pressure":' || trans_oil_pressure::VARCHAR
                || ',"battery_voltage":' || battery_voltage::VARCHAR
                || ',"status":"' || status || '"}}' AS record
                FROM ({_LATEST_READING})""",
        ),
        "fleet_status": _with(
            tel,
            f"""SELECT e.entity_id,
                CASE WHEN l.ts IS NULL THEN 'OFFLINE'
                     WHEN date_diff('second', l.ts, (SELECT max(ts) FROM telemetry)) <= 10
                         THEN 'ONLINE' ELSE 'OFFLINE' END AS status,
                l.ts AS "timestamp", {_SENSORS}
                FROM (SELECT DISTINCT entity_id FROM normal_seed) e
                LEFT JOIN ({_LATEST_READING}) l ON l.entity_id = e.entity_id""",
        ),
        "snapshot_at_max": _with(
            tel,
            _SNAPSHOT,
        ),
        "agg_5min": _with(
            ["agg"],
            f"SELECT bucket_time, entity_id, {_MEANS}, point_count, latest_timestamp FROM agg",
        ),
        "chart_from_agg": _with(
            ["agg"],
            _CHART_AGG.format(back="30 MINUTE"),
        ),
        "chart_inline": _with(
            tel,
            _CHART_INLINE.format(back="30 MINUTE"),
        ),
        "chart_dashboard": _with(
            tel,
            f"""SELECT bucket_time AS "timestamp", entity_id, {_CHART_MEANS}
                FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket_time,
                             entity_id, avg(engine_temp) AS avg_engine_temp,
                             avg(trans_oil_pressure) AS avg_trans_oil_pressure,
                             avg(battery_voltage) AS avg_battery_voltage
                      FROM telemetry
                      WHERE ts >= TIMESTAMP '2024-01-01 01:20:00' - INTERVAL 1 HOUR
                      GROUP BY 1, 2)
                ORDER BY bucket_time, entity_id LIMIT 300""",
        ),
        "event_slices": """
            SELECT slice_end, count(*) AS n, round(avg(value), 6) AS mean_value,
                   max(date_diff('minute', ts, slice_end)) AS most_minutes_left,
                   min(date_diff('hour', slice_end, ts)) AS least_hours_after,
                   max(date_diff('day', ts, slice_end)) AS most_days_left,
                   max(date_diff('second', ts, slice_end)) AS most_seconds_left
            FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS slice_end, ts, value
                  FROM events)
            GROUP BY slice_end""",
        "event_trailing": """
            SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts_text, user_id,
                   round(value, 6) AS value
            FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR""",
        "event_latest_per_user": """
            SELECT event_id, ts, user_id, event_type, round(value, 6) AS value, props FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
        "window_stats": _with(
            ["stats"],
            f"""SELECT entity_id, window_start, feature_timestamp, {_MEANS},
                {_r("stddev_engine_temp", "stddev_trans_oil_pressure", "stddev_battery_voltage")},
                record_count FROM stats""",
        ),
        "temporal_features": _with(["features"], f"SELECT {_FEATURES} FROM features"),
        "temporal_features_carried": _with(["features"], f"SELECT {_FEATURES} FROM features"),
        "temporal_features_segmented": _with_events(
            ["features"], f"SELECT {_FEATURES} FROM features"
        ),
        "latest_features": _with(["latest"], f"SELECT {_FEATURES} FROM latest"),
        "classify_failure": _with(
            ["scored"], "SELECT entity_id, feature_timestamp, predicted_failure_type FROM scored"
        ),
        "ttf_basic": _with(
            ["scored"],
            """SELECT entity_id, feature_timestamp,
               CASE WHEN NOT missing THEN round(hours_basic, 6) END AS predicted_hours_to_failure
               FROM scored""",
        ),
        "ttf_temporal": _with(
            ["scored"],
            """SELECT entity_id, feature_timestamp,
               CASE WHEN NOT missing THEN round(hours_temporal, 6) END AS predicted_hours_to_failure
               FROM scored""",
        ),
        "hybrid_prediction": _with(["predictions"], f"SELECT {_CACHE} FROM predictions"),
        "upsert_predictions": _with(["refreshed"], f"SELECT {_CACHE}, last_updated FROM refreshed"),
        "new_failure_markers": _with(
            ["prediction_cache", "markers"], _NEW_MARKERS.format(cache="prediction_cache")
        ),
        "clear_markers": _with(
            ["prediction_cache", "markers"],
            """SELECT * FROM markers WHERE entity_id IN (
                   SELECT entity_id FROM prediction_cache WHERE predicted_failure_type <> 'NORMAL')""",
        ),
        "refresh_markers": _with(
            ["refreshed", "markers"],
            f"""SELECT * FROM (SELECT * FROM markers UNION ALL
                               {_NEW_MARKERS.format(cache="refreshed")})
                WHERE entity_id IN (
                    SELECT entity_id FROM refreshed WHERE predicted_failure_type <> 'NORMAL')""",
        ),
        "markers_list": _with(
            ["markers"], "SELECT entity_id, first_failure_time, failure_type, last_updated FROM markers"
        ),
        "markers_list_text": _with(
            ["markers"],
            """SELECT entity_id, strftime(first_failure_time, '%Y-%m-%d %H:%M:%S')
                   AS first_failure_time, failure_type FROM markers""",
        ),
        "prediction_age_by_entity": _with(
            ["prediction_cache", "telemetry"],
            """SELECT p.entity_id, p.prediction_timestamp, p.predicted_failure_type,
                      p.predicted_hours_to_failure, p.ttf_model_used, p.last_updated,
                      t.latest AS latest_telemetry_time,
                      date_diff('minute', p.prediction_timestamp, t.latest) AS age_minutes
               FROM prediction_cache p
               LEFT JOIN (SELECT entity_id, max(ts) AS latest FROM telemetry GROUP BY 1) t
                   ON t.entity_id = p.entity_id""",
        ),
        "prediction_age_fleet": _with(["ages"], "SELECT * FROM ages"),
        "stale_check": _with(
            ["ages"],
            """SELECT max(age_minutes) AS max_age_minutes,
                      coalesce(max(age_minutes) >= 60, false) AS is_stale FROM ages""",
        ),
        "active_failures_list": _with(
            cfg,
            """SELECT entity_id, failure_type,
                      TIMESTAMP '2024-01-01 00:00:00' + to_seconds(5 * effective_from_epoch)
                          AS started_at,
                      updated_at AS last_updated
               FROM failure_config WHERE enabled AND effective_from_epoch <= 100""",
        ),
        "trace_lengths": _with(
            ["failure_traces"],
            "SELECT failure_type, count(*) AS max_epochs FROM failure_traces GROUP BY 1",
        ),
        "failure_status": _with(
            ["failure_traces", "failure_config"],
            """SELECT c.entity_id, c.failure_type, c.effective_from_epoch,
                      c.failure_next_epoch AS current_failure_epoch, l.max_epochs,
                      CASE WHEN c.failure_next_epoch > l.max_epochs THEN 'OFFLINE' ELSE 'ACTIVE' END
                          AS status
               FROM failure_config c
               JOIN (SELECT failure_type, count(*) AS max_epochs FROM failure_traces GROUP BY 1) l
                   ON l.failure_type = c.failure_type
               WHERE c.enabled""",
        ),
        "replay_tick": _with(
            ["normal_rows", "failure_traces", "existing"],
            _STAMPED.format(sensors=_SENSORS, rows=f"({_TICK})", last=101),
        ),
        "advance_cursor": _with(
            ["failure_config", "failure_traces"],
            """SELECT c.* REPLACE (
                   CASE WHEN c.enabled AND c.effective_from_epoch <= 101 AND EXISTS (
                            SELECT 1 FROM failure_traces f WHERE f.failure_type = c.failure_type
                              AND f.epoch = coalesce(c.failure_next_epoch, 0) + 1)
                        THEN coalesce(c.failure_next_epoch, 0) + 1
                        ELSE c.failure_next_epoch END AS failure_next_epoch)
               FROM failure_config c""",
        ),
        "backfill_normal": _with(
            ["normal_rows", "existing"],
            _STAMPED.format(sensors=_SENSORS, rows="normal_rows", last=820),
        ),
        "backfill_failure": _with(
            ["failure_rows", "existing"],
            _STAMPED.format(sensors=_SENSORS, rows="failure_rows", last=820),
        ),
        "batch_cursor_update": _with(
            cfg,
            """SELECT * EXCLUDE (steps) REPLACE (
                   CASE WHEN steps > 0 THEN coalesce(failure_next_epoch, 0) + steps
                        ELSE failure_next_epoch END AS failure_next_epoch)
               FROM (SELECT *, CASE
                         WHEN NOT enabled OR 820 < effective_from_epoch THEN 0
                         WHEN effective_from_epoch > 100
                             THEN least(720, 820 - effective_from_epoch + 1)
                         ELSE 720 END AS steps
                     FROM failure_config)""",
        ),
        "activate_failure": _with(
            cfg,
            """SELECT 'TRUCK_' || s.s_suppkey AS entity_id, 'ENGINE' AS failure_type, true AS enabled,
                      101::BIGINT AS effective_from_epoch,
                      coalesce(c.failure_next_epoch, 0) AS failure_next_epoch,
                      c.created_at, c.updated_at
               FROM supplier s LEFT JOIN failure_config c ON c.entity_id = 'TRUCK_' || s.s_suppkey""",
        ),
        "register_entities": _with(
            cfg,
            """SELECT 'TRUCK_' || s.s_suppkey AS entity_id,
                      coalesce(c.failure_type, 'ENGINE') AS failure_type,
                      coalesce(c.enabled, false) AS enabled,
                      c.effective_from_epoch, c.failure_next_epoch, c.created_at, c.updated_at
               FROM supplier s LEFT JOIN failure_config c ON c.entity_id = 'TRUCK_' || s.s_suppkey""",
        ),
        "fill_cursor_defaults": _with(
            cfg,
            """SELECT * REPLACE (CASE WHEN enabled THEN coalesce(failure_next_epoch, 0)
                                      ELSE failure_next_epoch END AS failure_next_epoch)
               FROM failure_config""",
        ),
        "load_trace_csv": _with(
            ["normal_seed"],
            f"SELECT entity_id, epoch, {_SENSORS} FROM normal_seed WHERE l_returnflag <> 'R'",
        ),
        "load_rejects": _with(
            ["normal_seed"],
            """SELECT entity_id || ',zz,' || engine_temp::VARCHAR || ','
                      || trans_oil_pressure::VARCHAR || ',' || battery_voltage::VARCHAR AS line
               FROM normal_seed WHERE l_returnflag = 'R'""",
        ),
        "load_audit": _with(
            ["normal_seed", "failure_traces"],
            """SELECT table_name, row_count, table_name || ': ' || row_count || ' rows' AS data
               FROM (SELECT 'NORMAL_SEED' AS table_name, count(*) AS row_count FROM normal_seed
                     UNION ALL
                     SELECT failure_type || '_FAILURE_SEED', count(*) FROM failure_traces GROUP BY 1)""",
        ),
        "idempotent_append": _with(
            tel, f'SELECT ts AS "timestamp", entity_id, {_SENSORS}, status FROM telemetry'
        ),
        "load_pipeline": _with(
            ["normal_seed"],
            """SELECT table_name, row_count, table_name || ': ' || row_count || ' rows' AS data
               FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'NORMAL_SEED_REJECTS'
                                 ELSE 'NORMAL_SEED' END AS table_name, count(*) AS row_count
                     FROM normal_seed GROUP BY 1)""",
        ),
        "customer_upsert": """
            SELECT coalesce(c.c_custkey, o.o_custkey) AS c_custkey,
                   round(coalesce(c.c_acctbal, o.o_totalprice), 6) AS balance,
                   CASE WHEN c.c_custkey IS NULL THEN 'NEW' ELSE c.c_mktsegment END AS segment,
                   o.o_orderdate AS last_order, o.o_orderpriority AS priority
            FROM (SELECT * FROM customer WHERE c_acctbal >= 0) c
            FULL OUTER JOIN (
                SELECT * FROM orders QUALIFY row_number() OVER (
                    PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o
            ON o.o_custkey = c.c_custkey""",
        "customer_update_if_exists": """
            SELECT c.* REPLACE (
                round(c_acctbal, 6) AS c_acctbal,
                CASE WHEN c_acctbal >= 0 AND EXISTS (
                         SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')
                     THEN 'WAITING' ELSE c_mktsegment END AS c_mktsegment)
            FROM customer c""",
        "supplier_update_from_map": """
            SELECT s.* REPLACE (round(coalesce(u.price, s_acctbal), 6) AS s_acctbal)
            FROM supplier s LEFT JOIN (
                SELECT l_suppkey, max(l_extendedprice) AS price FROM lineitem
                WHERE l_returnflag = 'R' AND l_quantity > 49 GROUP BY 1) u
            ON u.l_suppkey = s.s_suppkey""",
        "delete_all": """
            SELECT 'TRUCK_' || s_suppkey AS entity_id, 'ENGINE' AS failure_type, false AS enabled,
                   NULL::BIGINT AS effective_from_epoch, NULL::BIGINT AS failure_next_epoch,
                   NULL::TIMESTAMP AS created_at, NULL::TIMESTAMP AS updated_at
            FROM supplier""",
        "state_defaults": """
            SELECT c_name AS stream_name,
                   CASE WHEN c_custkey % 3 > 0 THEN TIMESTAMP '2024-01-01 00:00:00'
                        ELSE TIMESTAMP '2024-01-01 02:00:00' END AS start_ts,
                   CASE WHEN c_custkey % 5 > 0 THEN c_custkey ELSE 0 END AS next_epoch,
                   CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 7 ELSE 5 END AS step_seconds
            FROM customer""",
        "snapshot_at_max_by_day": _with_events(tel, _SNAPSHOT),
        "chart_from_agg_by_day": _with_events(["agg"], _CHART_AGG.format(back="48 HOUR")),
        "chart_inline_by_day": _with_events(tel, _CHART_INLINE.format(back="48 HOUR")),
        "hybrid_prediction_ml": _with(
            ["scored"],
            f"""SELECT entity_id, feature_timestamp AS prediction_timestamp,
                       round(avg_engine_temp, 6) AS current_engine_temp,
                       round(avg_trans_oil_pressure, 6) AS current_trans_pressure,
                       round(avg_battery_voltage, 6) AS current_battery_voltage,
                       predicted_failure_type AS rule_class,
                       round(CASE WHEN predicted_failure_type = 'ELECTRICAL_FAILURE' THEN hours_temporal
                                  WHEN predicted_failure_type <> 'NORMAL' THEN hours_basic END, 6) AS rule_hours,
                       true AS classes_agree, true AS all_classes_told, true AS hours_agree,
                       true AS missing_is_normal, true AS hours_fit_class, true AS tag_fits_class
                FROM scored""",
        ),
        "hybrid_prediction_function": _with(
            ["array_predictions"], f"SELECT {_CACHE} FROM array_predictions"
        ),
        "stream_agg_5min": _with_events(
            ["agg"],
            f"SELECT bucket_time, entity_id, {_MEANS}, point_count, latest_timestamp FROM agg",
        ),
        "stream_agg_5min_closed": _with_events(
            ["agg"],
            f"""SELECT bucket_time, entity_id, {_MEANS}, point_count, latest_timestamp FROM agg
                WHERE bucket_time <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
        ),
        "stream_latest": _with_events(
            ["telemetry"],
            f'SELECT entity_id, ts AS "timestamp", {_SENSORS}, status FROM ({_LATEST_READING})',
        ),
        "stream_append": _with_events(
            ["telemetry"],
            f'SELECT entity_id, ts AS "timestamp", {_SENSORS}, status FROM telemetry',
        ),
        "stream_append_history": _with_events(
            ["telemetry"],
            f'SELECT entity_id, ts AS "timestamp", {_SENSORS}, status FROM telemetry',
        ),
        "stream_refresh_cache": _with_events(
            ["predictions"],
            f"""SELECT {_CACHE}, TIMESTAMP '2024-01-01 02:00:00' AS last_updated
                FROM predictions""",
        ),
        "stream_refresh_markers": _with_events(
            ["predictions"],
            """SELECT entity_id,
                      time_bucket(INTERVAL 5 MINUTE, prediction_timestamp) AS first_failure_time,
                      predicted_failure_type AS failure_type,
                      TIMESTAMP '2024-01-01 02:00:00' AS last_updated
               FROM predictions WHERE predicted_failure_type <> 'NORMAL'""",
        ),
        "stream_features_all": _with_events(["features"], f"SELECT {_FEATURES} FROM features"),
        "stream_features": _with_events(
            ["features"],
            f"""SELECT {_FEATURES} FROM features
                WHERE feature_timestamp < time_bucket(
                    INTERVAL 6 HOUR, (SELECT max(ts) FROM events) - INTERVAL 2 DAY)""",
        ),
    }
    out["latest_telemetry_json_file"] = out["latest_telemetry_json"]
    # The same results by other jobs.
    out["load_observed"] = out["stream_load_audit"] = out["load_pipeline"]
    out["stream_load_rows"] = out["load_trace_csv"]
    out["stream_load_rejects"] = out["load_rejects"]
    out["stream_features_keyed"] = out["stream_features_all"]
    out["stream_refresh_touched"] = out["stream_refresh_cache"]
    out["refresh_markers_from_changes"] = out["refresh_markers"]
    classified = _event_relations()["scored"].replace("FROM latest", "FROM features")
    out["stream_markers_history"] = _with_events(
        ["features"],
        f"""SELECT entity_id, time_bucket(INTERVAL 5 MINUTE, min(feature_timestamp)) AS first_failure_time,
                   predicted_failure_type AS failure_type, TIMESTAMP '2024-01-01 02:00:00' AS last_updated
            FROM (SELECT *, max(CASE WHEN predicted_failure_type = 'NORMAL' THEN feature_timestamp END)
                              OVER (PARTITION BY entity_id) AS normal
                  FROM ({classified}))
            WHERE predicted_failure_type <> 'NORMAL' AND (normal IS NULL OR feature_timestamp > normal)
            GROUP BY entity_id, predicted_failure_type""",
    )
    out["stream_status"] = _with_events(
        ["telemetry"],
        f"""SELECT entity_id, CASE WHEN date_diff('second', ts, (SELECT max(ts) FROM events)) <= 7200
                                   THEN 'ONLINE' ELSE 'OFFLINE' END AS status,
                   ts AS "timestamp", {_SENSORS}
            FROM ({_LATEST_READING})""",
    )
    out["refresh_changes"] = _with(
        ["prediction_cache", "predictions"],
        """SELECT coalesce(p.entity_id, c.entity_id) AS entity_id,
                  CASE WHEN p.entity_id IS NULL THEN c.predicted_failure_type
                       ELSE p.predicted_failure_type END AS predicted_failure_type,
                  CASE WHEN p.entity_id IS NULL THEN c.last_updated
                       ELSE TIMESTAMP '2024-01-01 02:00:00' END AS last_updated,
                  CASE WHEN p.entity_id IS NULL THEN 'kept'
                       WHEN substr(p.entity_id, 7)::BIGINT % 2 = 0 THEN 'unchanged'
                       WHEN c.entity_id IS NULL THEN 'inserted' ELSE 'updated' END AS change
           FROM prediction_cache c FULL OUTER JOIN predictions p ON p.entity_id = c.entity_id""",
    )
    return out
