"""Tests for unusable feature values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_missing(columns) -> Column:
    """True when any of the columns is NULL or NaN."""
    return F.expr(" OR ".join(f"`{c}` IS NULL OR isnan(double(`{c}`))" for c in columns))


def greatest_or_null(*columns: Column) -> Column:
    """The greatest value, NULL as soon as one input is NULL."""
    some_null = reduce(lambda a, b: a | b, [c.isNull() for c in columns])
    return F.when(~some_null, F.greatest(*columns))


def clamp_at_zero(column: Column) -> Column:
    """Negative values become zero, NULL stays NULL."""
    return F.when(column.isNotNull(), F.greatest(F.lit(0.0), column))
