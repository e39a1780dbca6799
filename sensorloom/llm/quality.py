"""Quality by regularised quadratic discriminant analysis of document statistics.

Whole texts become ``N_FEATURES`` transformed statistics (logs of sizes and of shares of
characters, word lengths, repetition). Of each class the mean and covariance are
computed by Spark over all labelled rows learned from; covariances are shrunk
towards the pooled one and its mean variance. A score is the difference of the
two Gaussian log densities, each a Mahalanobis distance through a cached Cholesky
factor, mapped to a probability by a logistic fit on rows kept for that.

Defined results: a null text counts as empty, and empty texts get the score of
their statistics; documents labelled both ways teach nothing; with a class
missing every score is 0.5; equal texts score equally.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import fresh, prepare
from sensorloom.llm.langid import remainder
from sensorloom.llm.pieces import text_bytes
from sensorloom.session import cut_lineage

N_FEATURES = 13
SHRINK_POOLED = 0.05
SHRINK_ROUND = 0.02
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[44, 46]] = True
_OTHER = ~(_LETTER | _DIGIT | _SPACE | _STOP)


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of one whole text."""
    text = text or b""
    raw = np.frombuffer(text, dtype=np.uint8)
    held = np.bincount(raw, minlength=256)
    n = max(1, len(raw))
    words = text.split()
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
    distinct = len(set(words))
    runs = sum(a == b for a, b in zip(words, words[1:]))
    lines = [line for line in text.split(b"\n") if line.strip()]
    letters = int(held[_LETTER].sum())

    def share(count, of) -> float:
        return math.log((count + 0.5) / (of + 1.0))

    return [
        math.log1p(len(words)),
        float(sizes.mean()) if len(words) else 0.0,
        float(math.log1p(sizes.std())) if len(words) else 0.0,
        share(held[_UPPER].sum(), letters),
        share(held[_DIGIT].sum(), n),
        share(held[_OTHER].sum(), n),
        share(held[_STOP].sum(), len(words)),
        share(letters, n),
        share(len(words) - distinct, len(words)),
        share(runs, len(words)),
        share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(len(words) / max(1, len(lines))),
        share(int(held[_OTHER].max()), n),
    ]


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log determinants of the classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, for each row."""
        density = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            z = (x - mean) @ factor.T
            density.append(-0.5 * (z * z).sum(axis=1) - log_det)
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.clip(self.slope * self.difference(x) + self.offset, -700, 700)
        return 1 / (1 + np.exp(-at))


def with_statistics(rows: DataFrame) -> DataFrame:
    """Replaces the column text by ``stats``."""
    prepare(rows.sparkSession)

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t) for t in text_bytes(texts)], type=pa.list_(pa.float64()))

    return rows.withColumn("stats", of(F.col("text"))).drop("text")


def fit(labelled: DataFrame, usable, calibrates) -> Model | None:
    """Learns from (stats, label): densities where ``usable``, the logistic where ``calibrates``.

    One row of sums per class, then one row per rounded log density difference,
    reach the driver, whatever the number of rows.
    """
    d = N_FEATURES
    one = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(d)]
    two = [
        F.sum(F.col("stats")[i] * F.col("stats")[j]).alias(f"s{i}_{j}")
        for i in range(d)
        for j in range(i, d)
    ]
    rows = labelled.filter(usable).groupBy("label").agg(F.count(F.lit(1)).alias("n"), *one, *two)
    sums = {r["label"]: r for r in rows.collect()}
    if set(sums) != {0, 1}:
        return None
    means, spreads, sizes = [], [], []
    for label in (0, 1):
        r = sums[label]
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        square = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                square[i, j] = square[j, i] = r[f"s{i}_{j}"] / r["n"]
        means.append(mean)
        spreads.append(square - np.outer(mean, mean))
        sizes.append(r["n"])
    pooled = sum(n * s for n, s in zip(sizes, spreads)) / sum(sizes)
    variance = np.diag(np.maximum(np.diag(pooled), 1e-3))
    factors, log_dets = [], []
    for spread in spreads:
        shrunk = (1 - SHRINK_POOLED - SHRINK_ROUND) * spread
        shrunk += SHRINK_POOLED * pooled + SHRINK_ROUND * variance
        low = np.linalg.cholesky(shrunk + 1e-6 * np.eye(d))
        factors.append(np.linalg.inv(low))
        log_dets.append(float(np.log(np.diag(low)).sum()))
    model = Model(np.array(means), np.array(factors), np.array(log_dets))
    points = labelled.filter(calibrates)
    at = F.round(F.least(F.greatest(_difference(points, model), F.lit(-60.0)), F.lit(60.0)), 1)
    table = points.groupBy(at.alias("at"), "label").count().collect()
    slope, offset = logistic([(r["at"], r["label"], r["count"]) for r in table])
    return Model(model.means, model.factors, model.log_dets, slope, offset)


def _applied(rows: DataFrame, of):
    """A function of the statistics in batches, as a column."""
    prepare(rows.sparkSession)

    @F.arrow_udf("double")
    def run(stats: pa.Array) -> pa.Array:
        x = stats.flatten().to_numpy(zero_copy_only=False).reshape(len(stats), N_FEATURES)
        return pa.array(of(x), type=pa.float64())

    return run(F.col("stats"))


def _difference(rows: DataFrame, model: Model):
    return _applied(rows, model.difference)


def logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression on one number, by Newton's method."""
    if len({label for _, label, _ in points}) < 2:
        return 1.0, 0.0
    x = np.array([[at, 1.0] for at, _, _ in points])
    y = np.array([float(label) for _, label, _ in points])
    weight = np.array([float(n) for _, _, n in points])
    # A weak prior keeps the slope finite where the classes do not overlap.
    prior = np.array([[1.0, 0.0], [0.0, 1e-3]])
    beta = np.array([0.1, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (weight * (p - y)) + prior @ (beta - np.array([0.5, 0.0]))
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + prior
        step = np.linalg.solve(bend, slope)
        beta = beta - step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def scored(rows: DataFrame, model: Model | None) -> DataFrame:
    """Replaces ``stats`` by score."""
    score = F.lit(0.5) if model is None else _applied(rows, model.score)
    return rows.withColumn("score", score).drop("stats")


def one_label(labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, label) of the documents labelled 0 or 1 and one way only."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_most"))
    return known.filter("label = _most").select("doc_id", F.col("label").cast("int").alias("label"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document; rows whose remainder by 3 is 1 are not learned from.

    Those with 0 give the densities, those with 2 the logistic.
    """
    rows = with_statistics(docs.select("doc_id", remainder(3).alias("fold"), "text"))
    rows = cut_lineage(rows, "quality-stats")
    labelled = rows.join(one_label(labels), "doc_id")
    model = fit(labelled, F.col("fold") == 0, F.col("fold") == 2)
    held_out = F.coalesce(F.col("fold") == 1, F.lit(False))
    return scored(rows, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def score_rows(docs: DataFrame, model: Model | None) -> DataFrame:
    """Whole rows with the column ``quality_score`` added."""
    name = fresh(docs.columns, "quality_score")
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    prepare(docs.sparkSession)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t) for t in text_bytes(texts)]).reshape(-1, N_FEATURES)
        return pa.array(model.score(x), type=pa.float64())

    return docs.withColumn(name, of(F.col("text")))
