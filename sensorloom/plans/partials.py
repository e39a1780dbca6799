"""Slice statistics that can be added up, for readings arriving in parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions.timeops import time_slice
from sensorloom.schemas import SENSORS

PARTIALS = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("window_start", T.TimestampNTZType()),
        T.StructField("feature_timestamp", T.TimestampNTZType()),
        T.StructField("record_count", T.LongType()),
    ]
    + [
        T.StructField(f"{part}_{s}", kind)
        for s in SENSORS
        for part, kind in (("n", T.LongType()), ("mean", T.DoubleType()), ("m2", T.DoubleType()))
    ]
)


def window_partials(tel: DataFrame, *, minutes: int = 5) -> DataFrame:
    """Count, mean and summed squared deviation per entity, slice and sensor."""
    sliced = tel.select(
        "entity_id",
        time_slice("timestamp", minutes=minutes).alias("window_start"),
        "timestamp",
        *SENSORS,
    )
    parts = []
    for s in SENSORS:
        parts += [
            F.count(s).alias(f"n_{s}"),
            F.avg(s).alias(f"mean_{s}"),
            (F.var_pop(s) * F.count(s)).alias(f"m2_{s}"),
        ]
    return sliced.groupBy("entity_id", "window_start").agg(
        F.max("timestamp").alias("feature_timestamp"),
        F.count(F.lit(1)).alias("record_count"),
        *parts,
    )


def merge_partials(left: DataFrame, right: DataFrame) -> DataFrame:
    """Statistics of the union of two sets of readings.

    Each side has one row per entity and slice. Deviations are joined pairwise
    around the two means, which stays exact where sums of squares would not.
    """
    a, b = left.alias("a"), right.alias("b")
    same = F.col("a.entity_id").eqNullSafe(F.col("b.entity_id")) & F.col(
        "a.window_start"
    ).eqNullSafe(F.col("b.window_start"))
    joined = a.join(b, same, "full_outer")

    def either(name: str) -> Column:
        return F.coalesce(F.col(f"a.{name}"), F.col(f"b.{name}"))

    def count(side: str, name: str) -> Column:
        return F.coalesce(F.col(f"{side}.{name}"), F.lit(0).cast("long"))

    out = [
        either("entity_id").alias("entity_id"),
        either("window_start").alias("window_start"),
        F.greatest("a.feature_timestamp", "b.feature_timestamp").alias("feature_timestamp"),
        (count("a", "record_count") + count("b", "record_count")).alias("record_count"),
    ]
    for s in SENSORS:
        na, nb = count("a", f"n_{s}"), count("b", f"n_{s}")
        gap = F.col(f"b.mean_{s}") - F.col(f"a.mean_{s}")
        both = (na > 0) & (nb > 0)
        mean = F.col(f"a.mean_{s}") + gap * nb / (na + nb)
        m2 = F.col(f"a.m2_{s}") + F.col(f"b.m2_{s}") + gap * gap * na * nb / (na + nb)
        out += [
            (na + nb).alias(f"n_{s}"),
            F.when(both, mean).otherwise(either(f"mean_{s}")).alias(f"mean_{s}"),
            F.when(both, m2).otherwise(either(f"m2_{s}")).alias(f"m2_{s}"),
        ]
    return joined.select(*out)


def stats_of(partials: DataFrame) -> DataFrame:
    """The columns of ``features.window_stats`` from added-up parts."""
    return partials.select(
        "entity_id",
        "window_start",
        "feature_timestamp",
        *[F.col(f"mean_{s}").alias(f"avg_{s}") for s in SENSORS],
        *[
            F.when(F.col(f"n_{s}") > 1, F.sqrt(F.col(f"m2_{s}") / (F.col(f"n_{s}") - 1))).alias(
                f"stddev_{s}"
            )
            for s in SENSORS
        ],
        "record_count",
    )
