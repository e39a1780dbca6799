"""What several operators share: row keys, spread ranks, word counts, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.session import cut_lineage, ship_package

# Slices of a hash in which ranks and running totals are worked out; a slice of
# a group holds its 4096th part, whatever the group's size.
SLICES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Sequence[str], name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Words of a text, a null one having none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int | str, *parts: Column) -> Column:
    """A hash as 32 hex digits, the same in any SQL engine that has MD5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def unit(digest: Column) -> Column:
    """The first 32 bits of such a hash as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def slice_of(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def named_or_null(name: str) -> Column:
    """A text column as a key that is never null: nulls sort after all texts."""
    return F.concat(F.when(F.col(name).isNull(), "1").otherwise("0"), F.coalesce(F.col(name), F.lit("")))


def running(
    rows: DataFrame, group: list[str], piece: Column, order: list[str], sums: dict[str, Column]
) -> DataFrame:
    """Totals over the rows before each one, in an order of any number of rows.

    ``piece`` must rise with ``order``. For every name in ``sums`` the result
    has ``<name>_before`` and ``<name>_total`` of the row's group. Totals of the
    pieces are summed first, so that no task orders more than one piece of one
    group: a group with a third of all rows is spread over its pieces.
    """
    at = fresh(rows.columns, "_piece")
    rows = rows.withColumn(at, piece)
    pieces = rows.groupBy(*group, at).agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    whole = Window.partitionBy(*group)
    before = whole.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        *group,
        at,
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_upto_{n}") for n in sums],
        *[F.sum(f"_sum_{n}").over(whole).alias(f"{n}_total") for n in sums],
    )
    inside = Window.partitionBy(*group, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(pieces, [*group, at])
    return joined.withColumns(
        {
            f"{n}_before": F.col(f"_upto_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0))
            for n, c in sums.items()
        }
    ).drop(at, *[f"_upto_{n}" for n in sums])


def placed(rows: DataFrame, group: str, order: list[Column], lead: list[Column], label: str) -> DataFrame:
    """``rows``, written, with ``place``: their number within the group, from 0.

    Rows are put in order over all tasks, dealt out by ``lead``, which rises with ``order``
    and is short; a row's place follows from its number in its task and the counts of the
    tasks before. A group of any size is spread over as many tasks as it needs.
    """
    ordered = rows.repartitionByRange(F.col(group), *lead).sortWithinPartitions(F.col(group), *order)
    ordered = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()), label)
    ordered = ordered.withColumn("_task", F.shiftright("_at", 33))
    tasks = ordered.groupBy(group, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select(
        group, "_task", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    place = F.col("_before") + F.col("_at") - F.col("_first")
    return ordered.join(tasks, [group, "_task"]).withColumn("place", place).drop("_at", "_task", "_first", "_before")


def with_identity(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds 128 hash bits of a whole row: equal exactly for rows equal in all columns."""
    plain = [
        F.col(f"`{f.name}`") if not _has_map(f.dataType) else F.to_json(F.col(f"`{f.name}`"))
        for f in df.schema.fields
    ]
    # A mark for each null, as hashing skips nulls.
    marks = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in plain])
    names = [fresh(df.columns, "_row_a"), fresh(df.columns, "_row_b")]
    return df.withColumns(
        {names[0]: F.xxhash64(marks, *plain), names[1]: F.xxhash64(F.lit("b"), marks, *plain)}
    ), names


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.MapType)


def attach(wide: DataFrame, keys: list[str], placed: DataFrame) -> DataFrame:
    """The rows of ``wide`` once for each row of ``placed`` with their key.

    Equal rows of ``wide`` are taken once, since ``placed`` has one row for
    each of them already. Whole rows are shuffled once, by their hash.
    """
    number = fresh(wide.columns, "_copy")
    one = Window.partitionBy(*keys).orderBy(*keys)
    single = wide.withColumn(number, F.row_number().over(one)).filter(F.col(number) == 1).drop(number)
    return single.join(placed, keys).drop(*keys)


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, root): for each end of a link the smallest node it is joined to.

    ``links`` has the columns a and b. Nodes are hung onto ever smaller
    neighbours until every component is a star around its smallest node; the
    number of rounds grows with the logarithm of the longest path. Rounds are
    written to the shared folder; only their row count and checksum reach the
    driver.
    """
    links = links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).filter("a != b").distinct()
    links = cut_lineage(links, label)
    seen = _state(links)
    while seen[0]:
        links = cut_lineage(_to_small(_to_large(links)), label)
        now = _state(links)
        if now == seen:
            break
        seen = now
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _state(links: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(mixed)).first())


def _to_large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest one instead."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.distinct()


def _to_small(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest one."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def blocks(
    rows: DataFrame, key: list[str], member: list[str], limit: int, needs: Column
) -> DataFrame:
    """Rows that share a key, cut into pairs of blocks of about ``limit`` rows.

    Rows that are alone with their key go, as do keys for which the aggregate
    ``needs`` does not hold. A key with many rows is cut into
    blocks by a hash of ``member``, and every pair of its blocks becomes a piece
    of work of its own: (key, _left, _right); ``_own`` is the row's block. So
    each two rows of a key meet, and no task has to hold more than two blocks.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), needs.alias("_needs"))
    sizes = sizes.filter("_n > 1 and _needs").drop("_needs")
    cut = F.ceil(F.col("_n") / F.lit(limit)).cast("int")
    met = rows.join(sizes, key).withColumn("_cut", cut).drop("_n")
    met = met.withColumn("_own", F.pmod(F.xxhash64(*member), F.col("_cut")).cast("int"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cut") - 1)))
    met = met.withColumns({"_left": F.least("_own", "_other"), "_right": F.greatest("_own", "_other")})
    return met.drop("_cut", "_other")


# Whole texts are long: batches for Python are bounded in rows and bytes. A batch ends
# with the row that passes the bound, so one text is more than that at most.
ARROW_ROWS = 500
ARROW_BYTES = 8 << 20


def prepare(spark) -> None:
    """Ships this package to the Python workers and bounds what they get at once."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
