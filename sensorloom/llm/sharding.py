"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash. A row of rank r among
the n of its source stands at (r + u) / n of the way through the corpus, u being
a fixed number in [0, 1) for the source, which spreads sources of a few rows.
Sorted by that fraction the sources are interleaved in proportion, so every
stretch of the order matches the mixture; it is cut into stretches whose row
counts differ by one at most.

Defined results: a null source is a stratum of its own; a null text has size 1
and checksum 0; rows equal in all columns each get a place; an empty table gives
an empty result; other columns are ignored or, in ``shard_rows``, kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import (
    SLICES,
    attach,
    fresh,
    named_or_null,
    running,
    seeded,
    slice_of,
    unit,
    with_identity,
)
from sensorloom.session import cut_lineage

N_SHARDS = 8
SEED = 7


def places(rows: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` (doc_id, source, and any narrow columns) with ``shard`` and ``slot``.

    Give this narrow rows: they are shuffled twice. ``slot`` counts from 0
    within a shard. Ties of the hash are broken by the other columns.
    """
    columns = rows.columns
    drawn = rows.withColumns(
        {"_source": named_or_null("source"), "_hash": seeded(seed, F.col("doc_id"))}
    )
    ranked = running(
        drawn, ["_source"], slice_of(F.col("_hash")), ["_hash", *columns], {"n": F.lit(1)}
    )
    shift = unit(seeded(seed, F.lit("source"), F.col("_source")))
    ranked = ranked.withColumn("_at", (F.col("n_before") + shift) / F.col("n_total"))
    ranked = cut_lineage(
        ranked.select(*columns, "_source", F.col("n_before").alias("_rank"), "_at"), "shard-ranks"
    )
    piece = F.floor(F.col("_at") * SLICES).cast("int")
    placed = running(ranked, [], piece, ["_at", "_source", "_rank"], {"n": F.lit(1)})
    shard = F.expr(f"n_before * {n_shards} div n_total")
    first = F.expr(f"(shard * n_total + {n_shards - 1}) div {n_shards}")
    placed = placed.withColumn("shard", shard.cast("int"))
    return placed.withColumn("slot", (F.col("n_before") - first).cast("long")).select(
        *columns, "shard", "slot"
    )


def shard_rows(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """Whole rows with the columns ``shard`` and ``slot`` added.

    Places are worked out on the keys alone; whole rows are shuffled once.
    """
    keyed, keys = with_identity(docs)
    placed = places(keyed.select("doc_id", "source", *keys), n_shards, seed)
    shard, slot = fresh(docs.columns, "shard"), fresh(docs.columns, "slot")
    placed = placed.select(*keys, F.col("shard").alias(shard), F.col("slot").alias(slot))
    return attach(keyed, keys, placed)


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, seed: int = SEED) -> None:
    """One folder per shard, its rows in slot order within each file."""
    placed = shard_rows(docs, n_shards, seed)
    placed.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions(
        "shard", "slot"
    ).write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: size, checksum and place."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    return places(rows, n_shards, seed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
