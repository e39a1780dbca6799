"""Keyed writes as functions from frames to the new content of the table.

Parquet tables have no row-level MERGE, UPDATE or DELETE. Each function below
takes the table as it is and returns the table as it should be; the caller
writes that as a new version (see ``sources.versioned``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.windows import latest_per


def _names(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def _typed(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns of ``like`` in its order and types; absent ones are NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        ]
    )


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Add the columns that ``df`` lacks with their default value."""
    missing = {name: value for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(
        {n: v if isinstance(v, Column) else F.lit(v) for n, v in missing.items()}
    )


def absent_rows(target: DataFrame, new: DataFrame, keys) -> DataFrame:
    """Rows of ``new`` whose key is not in ``target`` yet."""
    keys = _names(keys)
    return new.join(target.select(*keys), keys, "left_anti")


def append_if_absent(target: DataFrame, new: DataFrame, keys) -> DataFrame:
    """``target`` plus the rows of ``new`` whose key it does not hold."""
    return target.unionByName(_typed(absent_rows(target, new, keys), target))


def insert_if_absent(target: DataFrame, rows: DataFrame, key) -> DataFrame:
    """Insert-only merge: existing keys are left untouched."""
    return append_if_absent(target, rows, key)


def upsert(
    target: DataFrame,
    source: DataFrame,
    key,
    *,
    order=None,
    insert_defaults: dict | None = None,
    update_keep: tuple[str, ...] = (),
) -> DataFrame:
    """Update the matched keys, insert the others.

    Matched rows take every column the source has, a NULL included; the match
    is told by flags, never by a NULL value. ``order`` keeps the newest source
    row per key. Columns in ``update_keep`` keep a non-NULL target value.
    ``insert_defaults`` fills columns the source lacks on inserted rows.
    """
    return _upserted(target, source, key, order, insert_defaults, update_keep, None).select(*target.columns)


# What an upsert does to a row: the last one is not in the source.
INSERTED, UPDATED, UNCHANGED, KEPT = "inserted", "updated", "unchanged", "kept"


def upsert_changes(
    target: DataFrame,
    source: DataFrame,
    key,
    *,
    order=None,
    insert_defaults: dict | None = None,
    update_keep: tuple[str, ...] = (),
    stamps: tuple[str, ...] = (),
) -> DataFrame:
    """The content of ``upsert`` with ``change``: inserted, updated, unchanged, or kept.

    A matched row whose columns all stay as they were is unchanged, whatever its
    ``stamps`` (columns that say when it was written).
    """
    return _upserted(target, source, key, order, insert_defaults, update_keep, stamps)


def _upserted(target, source, key, order, insert_defaults, update_keep, stamps) -> DataFrame:
    keys = _names(key)
    if order is not None:
        source = latest_per(source, keys, order)
    have = set(source.columns)
    defaults = insert_defaults or {}
    t = target.withColumn("_in_target", F.lit(True)).alias("t")
    s = source.withColumn("_in_source", F.lit(True)).alias("s")
    matched_on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    joined = t.join(s, matched_on, "full_outer")
    in_source = F.col("_in_source").isNotNull()
    in_target = F.col("_in_target").isNotNull()

    def value(name: str) -> Column:
        old = F.col(f"t.{name}")
        if name not in have:
            given = defaults.get(name)
            inserted = given if isinstance(given, Column) else F.lit(given)
            return F.when(in_target, old).otherwise(inserted)
        new = F.col(f"s.{name}")
        if name in update_keep:
            new = F.when(in_target, F.coalesce(old, new)).otherwise(new)
        return F.when(in_source, new).otherwise(old)

    content = [value(f.name).cast(f.dataType).alias(f.name) for f in target.schema.fields]
    if stamps is None:
        return joined.select(*content)
    same = F.lit(True)
    for f in target.schema.fields:
        if f.name not in stamps:
            same = same & value(f.name).cast(f.dataType).eqNullSafe(F.col(f"t.{f.name}"))
    change = F.when(~in_source, KEPT).when(~in_target, INSERTED).when(same, UNCHANGED).otherwise(UPDATED)
    return joined.select(*content, change.alias("change"))


def update_where(target: DataFrame, condition: Column, sets: dict[str, Column]) -> DataFrame:
    """Set columns on the rows that meet the condition; NULL counts as not met."""
    types = {f.name: f.dataType for f in target.schema.fields}
    return target.withColumns(
        {n: F.when(condition, v).otherwise(F.col(n)).cast(types[n]) for n, v in sets.items()}
    )


def update_if_exists(
    target: DataFrame,
    other: DataFrame,
    on: dict[str, Column],
    sets: dict[str, Column],
    *,
    condition: Column | None = None,
) -> DataFrame:
    """Update the rows for which a matching row exists in ``other``.

    ``on`` maps a column of ``other`` to the expression over ``target`` that
    has to equal it.
    """
    names = list(on)
    found = other.select(*[F.col(n).alias(f"_k_{n}") for n in names]).distinct()
    found = found.withColumn("_found", F.lit(True))
    probe = target.join(found, [on[n] == F.col(f"_k_{n}") for n in names], "left")
    hit = F.col("_found").isNotNull()
    if condition is not None:
        hit = hit & condition
    return update_where(probe, hit, sets).select(*target.columns)


def update_from_map(target: DataFrame, updates: DataFrame, key) -> DataFrame:
    """Overwrite columns of the rows whose key appears in ``updates``.

    Keys missing from ``target`` are ignored, unlike in ``upsert``. Of several
    updates of a key the greatest counts, so no row of ``target`` is repeated.
    """
    keys = _names(key)
    fresh = [c for c in updates.columns if c not in keys]
    updates = updates.groupBy(*keys).agg(F.max(F.struct(*fresh)).alias("_u"))
    updates = updates.select(*keys, *[F.col(f"_u.{c}").alias(c) for c in fresh])
    renamed = updates.select(
        *[F.col(c).alias(f"_u_{c}") for c in updates.columns], F.lit(True).alias("_given")
    )
    joined = target.join(renamed, [F.col(k) == F.col(f"_u_{k}") for k in keys], "left")
    sets = {c: F.col(f"_u_{c}") for c in fresh}
    return update_where(joined, F.col("_given").isNotNull(), sets).select(*target.columns)


def delete_not_in(target: DataFrame, keep: DataFrame, key) -> DataFrame:
    """Rows of ``target`` whose key is in ``keep``."""
    keys = _names(key)
    return target.join(keep.select(*keys), keys, "left_semi").select(*target.columns)


def emptied(target: DataFrame) -> DataFrame:
    """The table without its rows."""
    return target.limit(0)
