"""Scoring of the newest features: class, then hours to failure by class."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.checks import any_missing, clamp_at_zero
from sensorloom.plans.features import latest_features
from sensorloom.schemas import (
    BASIC_FEATURES,
    ELECTRICAL_FAILURE,
    ENGINE_FAILURE,
    MODEL_BASIC,
    MODEL_NONE,
    MODEL_TEMPORAL,
    NORMAL,
    TEMPORAL_FEATURES,
    TRANSMISSION_FAILURE,
)
from sensorloom.session import cut_lineage

CLASS = "predicted_failure_type"
HOURS = "predicted_hours_to_failure"


class Scorer(Protocol):
    """Three models over feature columns.

    ``columns`` says that the scores are plain column expressions, which cost
    nothing on rows they are not asked for; models behind a function call are
    given only the rows of their route.
    """

    columns: bool

    def classify(self, df: DataFrame) -> DataFrame: ...

    def ttf_basic(self, df: DataFrame) -> DataFrame: ...

    def ttf_temporal(self, df: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class RuleScorer:
    """Deterministic thresholds in place of trained models.

    Only ``volatility`` is a given constant; the other limits are choices of
    this library, made so that all classes occur in the test data.
    """

    volatility: float = 0.7
    elevated: int = 2
    low_pressure: float = 44.7
    hot_engine: float = 206.0
    temp_limit: float = 250.0
    pressure_limit: float = 20.0
    volatility_limit: float = 5.0
    least_rate: float = 0.05
    minutes: float = 5.0

    columns = True

    def class_expr(self) -> Column:
        electrical = (F.col("stddev_battery_voltage") > self.volatility) & (
            F.col("elevated_window_count") >= self.elevated
        )
        return (
            F.when(any_missing(BASIC_FEATURES), NORMAL)
            .when(electrical, ELECTRICAL_FAILURE)
            .when(F.col("rolling_avg_trans_oil_pressure") < self.low_pressure, TRANSMISSION_FAILURE)
            .when(F.col("rolling_avg_engine_temp") > self.hot_engine, ENGINE_FAILURE)
            .otherwise(NORMAL)
        )

    def _hours(self, distance: Column, rate_per_minute: Column) -> Column:
        rate = F.greatest(F.abs(rate_per_minute), F.lit(self.least_rate))
        return clamp_at_zero(distance / rate / F.lit(60.0))

    def basic_expr(self) -> Column:
        """Hours until the rolling mean reaches its limit, whichever is nearer."""
        engine = self._hours(
            F.lit(self.temp_limit) - F.col("rolling_avg_engine_temp"), F.col("slope_engine_temp")
        )
        transmission = self._hours(
            F.col("rolling_avg_trans_oil_pressure") - F.lit(self.pressure_limit),
            F.col("slope_trans_oil_pressure"),
        )
        return F.when(~any_missing(BASIC_FEATURES), F.least(engine, transmission))

    def temporal_expr(self) -> Column:
        """Hours until the summed volatility reaches its limit."""
        left = F.lit(self.volatility_limit) - F.col("cumulative_volatility") / F.greatest(
            F.col("elevated_window_count").cast("double"), F.lit(1.0)
        )
        rate = F.col("volatility_delta") / F.lit(self.minutes)
        return F.when(~any_missing(TEMPORAL_FEATURES), self._hours(left, rate))

    def classify(self, df: DataFrame) -> DataFrame:
        return df.withColumn(CLASS, self.class_expr())

    def ttf_basic(self, df: DataFrame) -> DataFrame:
        return df.withColumn(HOURS, self.basic_expr())

    def ttf_temporal(self, df: DataFrame) -> DataFrame:
        return df.withColumn(HOURS, self.temporal_expr())


def is_temporal(column: str = CLASS) -> Column:
    """Whether a class asks for the model over temporal features."""
    return F.col(column) == ELECTRICAL_FAILURE


def is_basic(column: str = CLASS) -> Column:
    """Whether a class asks for the model over basic features."""
    return F.col(column).isin(ENGINE_FAILURE, TRANSMISSION_FAILURE)


def route_hours(classified: DataFrame, scorer: Scorer) -> DataFrame:
    """Hours to failure from the model that the class calls for, and its tag."""
    if scorer.columns:
        spare = "_spare_hours"
        both = scorer.ttf_basic(classified).withColumnRenamed(HOURS, spare)
        both = scorer.ttf_temporal(both)
        hours = F.when(is_temporal(), F.col(HOURS)).when(is_basic(), F.col(spare))
        scored = both.withColumn(HOURS, hours).drop(spare)
    else:
        # One row per entity, read by three branches: written once, not computed thrice.
        classified = cut_lineage(classified, "classified")
        temporal = scorer.ttf_temporal(classified.filter(is_temporal()))
        basic = scorer.ttf_basic(classified.filter(is_basic()))
        rest = classified.filter(~F.coalesce(is_temporal() | is_basic(), F.lit(False)))
        rest = rest.withColumn(HOURS, F.lit(None).cast("double"))
        scored = temporal.unionByName(basic).unionByName(rest)
    tag = F.when(is_temporal(), MODEL_TEMPORAL).when(is_basic(), MODEL_BASIC).otherwise(MODEL_NONE)
    return scored.withColumn("ttf_model_used", tag)


def hybrid_prediction(features: DataFrame, scorer: Scorer) -> DataFrame:
    """One prediction per entity from its newest features."""
    scored = route_hours(scorer.classify(latest_features(features)), scorer)
    return scored.select(
        F.col("feature_timestamp").alias("prediction_timestamp"),
        "entity_id",
        F.col("avg_engine_temp").alias("current_engine_temp"),
        F.col("avg_trans_oil_pressure").alias("current_trans_pressure"),
        F.col("avg_battery_voltage").alias("current_battery_voltage"),
        CLASS,
        HOURS,
        "ttf_model_used",
    )
