"""Latest row per key and column builders over ordered windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T


def _names(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def descending_rank(columns) -> Column:
    """One sortable value whose maximum is the first row in descending order.

    NULL counts as the largest value, so it comes first.
    """
    parts = []
    for name in _names(columns):
        parts += [F.col(name).isNull(), F.col(name)]
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


# Types whose running maximum is kept in place by a hash aggregate.
_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)

# Fixed value: the last instant a timestamp can hold.
_LAST_INSTANT = "294247-01-10 04:00:54.775807"


def _thinned(df: DataFrame, groups: list[str], order: str, extra: dict[str, Column]) -> DataFrame:
    """The newest row per group, by a hash aggregate over fixed-width columns."""
    rank = F.coalesce(F.col(order), F.lit(_LAST_INSTANT).cast("timestamp_ntz"))
    rest = [c for c in df.columns if c not in groups]
    more = [c.alias(n) for n, c in extra.items()]
    return df.groupBy(*groups).agg(*[F.max_by(c, rank).alias(c) for c in rest], *more)


def latest_per(df: DataFrame, key, order, *, few=(), extra: dict[str, Column] | None = None) -> DataFrame:
    """The row with the greatest ``order`` of every ``key``.

    Written as an aggregate, not as a ranking: each map task sends one row per
    key, so a key that holds a large share of the table costs its reducer one
    row per task.

    Fixed-width columns can be carried through a hash aggregate, anything else
    makes Spark sort. ``few`` names text columns with few values per key: by
    grouping by them too, the hash aggregate still does the bulk of the work
    and leaves a handful of rows per key. ``extra`` names further aggregates
    of each key, taken in the same pass.
    """
    if extra and few:
        raise ValueError("further aggregates go without few")
    extra = extra or {}
    keys, orders = _names(key), _names(order)
    types = {f.name: f.dataType for f in df.schema.fields}
    groups = keys + [c for c in few if c not in keys]
    fixed = all(isinstance(types[c], _FIXED_WIDTH) for c in df.columns if c not in groups)
    if fixed and len(orders) == 1 and isinstance(types[orders[0]], T.TimestampNTZType):
        thin = _thinned(df, groups, orders[0], extra).select(*df.columns, *extra)
        if groups == keys:
            return thin
        df = thin
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), descending_rank(orders)).alias("_row"),
        *[c.alias(n) for n, c in extra.items()],
    )
    columns = [c if c in keys else F.col("_row")[c].alias(c) for c in df.columns]
    return picked.select(*columns, *extra)


def by_entity_time(entity="entity_id", ts: str = "feature_timestamp") -> WindowSpec:
    """Rows of an entity (or of a part of its history) in time order, a NULL time last."""
    return Window.partitionBy(*_names(entity)).orderBy(F.col(ts).asc_nulls_last())


def delta(column, window: WindowSpec) -> Column:
    """Change against the previous row."""
    return F.col(column) - F.lag(column).over(window)


def slope(column, window: WindowSpec, minutes: float = 5.0) -> Column:
    """Change per minute against the previous row, whatever the gap between them."""
    return delta(column, window) / F.lit(minutes)


def acceleration(column, window: WindowSpec) -> Column:
    """Change of the change over the last three rows."""
    before = F.lag(column).over(window)
    return (F.col(column) - before) - (before - F.lag(column, 2).over(window))


def rolling_mean(column, window: WindowSpec, n: int = 3) -> Column:
    """Mean of the current row and the ``n - 1`` before it."""
    return F.avg(column).over(window.rowsBetween(1 - n, Window.currentRow))


def cumulative_sum(column, window: WindowSpec) -> Column:
    """Running sum up to the current row."""
    return F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def cumulative_count_if(condition: Column, window: WindowSpec) -> Column:
    """Running count of the rows that meet the condition."""
    hit = F.when(condition, F.lit(1)).otherwise(F.lit(0))
    return F.sum(hit).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
