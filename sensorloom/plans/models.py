"""Scorers backed by trained models.

Trained files are not part of this library. ``fit_scorer`` trains Spark ML
models on any labelled features; ``FunctionScorer`` runs models of other
libraries batch by batch inside the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.checks import any_missing, clamp_at_zero
from sensorloom.plans.scoring import CLASS, HOURS, is_basic, is_temporal
from sensorloom.schemas import BASIC_FEATURES, NORMAL, TEMPORAL_FEATURES

_VECTOR, _LABEL, _INDEX, _PREDICTED = "_features", "_label", "_index", "_predicted"


def _assembler(columns) -> VectorAssembler:
    # A missing value becomes NaN and is overruled after prediction.
    return VectorAssembler(inputCols=list(columns), outputCol=_VECTOR, handleInvalid="keep")


def class_or_normal(predicted: Column) -> Column:
    return F.when(any_missing(BASIC_FEATURES), NORMAL).otherwise(predicted)


def hours_or_null(predicted: Column, columns) -> Column:
    return F.when(~any_missing(columns), clamp_at_zero(predicted))


@dataclass(frozen=True)
class MLScorer:
    """Three Spark ML pipelines, loaded once per job."""

    classifier: PipelineModel
    basic: PipelineModel
    temporal: PipelineModel

    columns = False

    def classify(self, df: DataFrame) -> DataFrame:
        out = self.classifier.transform(df)
        return out.select(*df.columns, class_or_normal(F.col(_PREDICTED)).alias(CLASS))

    def _hours(self, model: PipelineModel, df: DataFrame, features) -> DataFrame:
        out = model.transform(df)
        return out.select(*df.columns, hours_or_null(F.col(_PREDICTED), features).alias(HOURS))

    def ttf_basic(self, df: DataFrame) -> DataFrame:
        return self._hours(self.basic, df, BASIC_FEATURES)

    def ttf_temporal(self, df: DataFrame) -> DataFrame:
        return self._hours(self.temporal, df, TEMPORAL_FEATURES)

    def save(self, path: str) -> None:
        for name in ("classifier", "basic", "temporal"):
            getattr(self, name).write().overwrite().save(f"{path}/{name}")

    @staticmethod
    def load(path: str) -> MLScorer:
        return MLScorer(
            *[PipelineModel.load(f"{path}/{n}") for n in ("classifier", "basic", "temporal")]
        )


def fit_scorer(
    labelled: DataFrame,
    *,
    label: str,
    basic_hours: str,
    temporal_hours: str,
    trees: int = 20,
    depth: int = 5,
    seed: int = 7,
) -> MLScorer:
    """Train the three models on feature rows with their class and both kinds of hours.

    Each regressor learns its own hours on the rows whose class routes to it,
    or on all rows if there is none of these. Rows with a missing feature or
    without hours are left out of the training that needs them.
    """
    classes = labelled.filter(~any_missing(BASIC_FEATURES)).withColumnRenamed(label, _LABEL)
    index = StringIndexer(inputCol=_LABEL, outputCol=_INDEX, stringOrderType="alphabetAsc").fit(
        classes
    )
    forest = RandomForestClassifier(
        featuresCol=_VECTOR,
        labelCol=_INDEX,
        predictionCol="_class",
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
    )
    name = IndexToString(inputCol="_class", outputCol=_PREDICTED, labels=index.labels)
    stages = Pipeline(stages=[_assembler(BASIC_FEATURES), forest, name])
    classifier = stages.fit(index.transform(classes))

    def regression(features, hours: str, route: Column) -> PipelineModel:
        usable = labelled.filter(~any_missing(features) & F.col(hours).isNotNull())
        routed = usable.filter(route)
        rows = usable if routed.isEmpty() else routed
        trained = GBTRegressor(
            featuresCol=_VECTOR,
            labelCol=hours,
            predictionCol=_PREDICTED,
            maxIter=trees,
            maxDepth=depth,
            seed=seed,
        )
        return Pipeline(stages=[_assembler(features), trained]).fit(rows)

    return MLScorer(
        classifier,
        regression(BASIC_FEATURES, basic_hours, is_basic(label)),
        regression(TEMPORAL_FEATURES, temporal_hours, is_temporal(label)),
    )


def agreement(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: how well predictions agree with given classes and hours.

    ``truth`` has entity_id, class, basic_hours and temporal_hours. ``class_share`` is the
    share of equal classes, ``class_kinds`` how many classes are told at least once
    rightly out of ``true_kinds``, and ``hours_error`` the mean distance of the hours to
    those of the model that the class calls for, in standard deviations of these.
    """
    both = scored.join(truth, "entity_id")
    right = F.col(CLASS) == F.col("class")
    hours = F.when(is_temporal(), F.col("temporal_hours")).when(is_basic(), F.col("basic_hours"))
    return both.agg(
        F.avg(right.cast("int")).alias("class_share"),
        F.count_distinct(F.when(right, F.col("class"))).alias("class_kinds"),
        F.count_distinct("class").alias("true_kinds"),
        (F.avg(F.abs(F.col(HOURS) - hours)) / F.nullif(F.stddev_pop(hours), F.lit(0.0))).alias("hours_error"),
    )


Predict = Callable[[np.ndarray], np.ndarray]


def _batched(load: Callable[[], Predict], features, result: str) -> Column:
    """A model as an Arrow function: loaded once per task, called per batch.

    Rows with a missing feature never reach the model.
    """

    @F.pandas_udf(result)
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        model = load()
        for frame in batches:
            matrix = frame.to_numpy(dtype=float)
            whole = ~np.isnan(matrix).any(axis=1)
            # A NaN stands for no hours: it turns into a null on the way back.
            out = np.full(len(frame), np.nan) if result == "double" else np.full(len(frame), None)
            if whole.any():
                out[whole] = model(matrix[whole])
            yield pd.Series(out)

    return predict(F.struct(*[F.col(f).cast("double").alias(f) for f in features]))


@dataclass(frozen=True)
class FunctionScorer:
    """Models of another library: each loader returns a function of a matrix.

    The functions see the feature columns in their fixed order and return a
    class name or hours per row.
    """

    load_classifier: Callable[[], Predict]
    load_basic: Callable[[], Predict]
    load_temporal: Callable[[], Predict]

    columns = False

    def classify(self, df: DataFrame) -> DataFrame:
        predicted = _batched(self.load_classifier, BASIC_FEATURES, "string")
        return df.withColumn(CLASS, F.coalesce(predicted, F.lit(NORMAL)))

    def ttf_basic(self, df: DataFrame) -> DataFrame:
        predicted = _batched(self.load_basic, BASIC_FEATURES, "double")
        return df.withColumn(HOURS, clamp_at_zero(predicted))

    def ttf_temporal(self, df: DataFrame) -> DataFrame:
        predicted = _batched(self.load_temporal, TEMPORAL_FEATURES, "double")
        return df.withColumn(HOURS, clamp_at_zero(predicted))
