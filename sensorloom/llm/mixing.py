"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets. Sources ordered by name, a null name last, weigh 3, 1, 2 in turn and
   share 150 % of all words; no target passes twice its source, and what is cut
   off is shared by weight among the others. All shares meet one level per unit
   of weight: the greatest of (words left) / (weight left) with the sources in
   order of the level at which each is full.
2. Draws. The documents of a source are permuted by a seeded hash. The first
   pass takes them up to the target, a second pass starts over where the target
   is larger than the source. A document is in where the middle of it is.
   The drawn documents are cut into blocks of about ``block_words`` words: the
   block quotas of the source are exact.
3. Tree. A node owns some blocks and a range of output shards. Its left child
   gets as many blocks as its share of the shards demands: those with the
   smallest hashes of that node's level. This is a draw without replacement, so the sources' block
   counts on both sides are multivariate hypergeometric. Leaves are shards: blocks
   are disjoint, and every shard has the same number of blocks, give or take one.
4. Each shard is ordered by another hash: a local shuffle.

All of it is columns and joins; a source is worked on in 4096 slices of the hash.

Defined results: a null source is a source; a null or empty text has no words
and nothing of it is taken, though it may be drawn; rows equal in all columns are
drawn one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import (
    attach,
    fresh,
    n_words,
    named_or_null,
    running,
    seeded,
    slice_of,
    with_identity,
)
from sensorloom.session import cut_lineage

SHARE = 1.5
LIMIT = 2
WEIGHTS = (3, 1, 2)
N_SHARDS = 8
BLOCK_WORDS = 65_536
SEED = 11


def targets(sizes: DataFrame) -> DataFrame:
    """(_source, n_total) to targets in words; one row per source throughout."""
    by_name = Window.orderBy("_source")
    turn = (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1
    weighed = sizes.withColumn("_weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), turn))
    weighed = weighed.withColumn("_full", F.col("n_total") * LIMIT)
    by_level = Window.orderBy(F.col("_full") / F.col("_weight"), "_source")
    everything = Window.partitionBy()
    full_before = F.coalesce(
        F.sum("_full").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    weight_left = F.sum("_weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    share = F.sum("n_total").over(everything) * F.lit(SHARE)
    level = weighed.withColumn("_level", (share - full_before) / weight_left)
    level = level.withColumn("_level", F.max("_level").over(everything))
    target = F.least(F.col("_full").cast("double"), F.col("_level") * F.col("_weight"))
    return level.select("_source", target.alias("target"))


def draw(
    rows: DataFrame,
    n_shards: int = N_SHARDS,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``rows`` (doc_id, source, size and any narrow columns) with what is drawn.

    Adds source_size, target and ``shards``, the output shards that get the
    document: none, one or two.
    """
    columns = rows.columns
    drawn = rows.withColumns(
        {"_source": named_or_null("source"), "_hash": seeded(seed, F.col("doc_id"))}
    )
    drawn = cut_lineage(drawn, "mix-rows")
    sizes = drawn.groupBy("_source").agg(F.sum("size").alias("n_total"))
    order = ["_hash", *columns]
    drawn = running(drawn, ["_source"], slice_of(F.col("_hash")), order, {"n": F.col("size")})
    drawn = drawn.join(targets(sizes), "_source")
    rest = F.col("target") - F.col("n_total")
    middle = F.col("n_before") + F.col("size") / 2
    block = F.floor(F.col("n_before") / F.lit(block_words))
    first = F.when(middle <= F.col("target"), F.struct(F.lit(1).alias("turn"), block.alias("block")))
    second = F.when(middle <= rest, F.struct(F.lit(2).alias("turn"), block.alias("block")))
    drawn = drawn.withColumn("_takes", F.array_compact(F.array(first, second)))
    drawn = cut_lineage(drawn.drop("_hash", "n_before"), "mix-draws")
    takes = drawn.select("_source", F.explode("_takes").alias("_take")).distinct()
    dealt = _tree(takes.select("_source", "_take.turn", "_take.block"), n_shards, seed)
    # At most two blocks hold a document, so its shards are looked up one by one.
    # A document without a block gets a key of its own: nulls would share one task.
    kept = drawn
    alone = F.struct(F.lit(0).alias("turn"), F.xxhash64("doc_id").alias("block"))
    for i in (1, 2):
        part = dealt.select(
            "_source",
            F.struct("turn", "block").alias(f"_take{i}"),
            F.col("shard").alias(f"_shard{i}"),
        )
        kept = kept.withColumn(f"_take{i}", F.coalesce(F.get("_takes", F.lit(i - 1)), alone))
        kept = kept.join(part, ["_source", f"_take{i}"], "left")
    return kept.select(
        *columns,
        F.col("n_total").alias("source_size"),
        "target",
        F.array_compact(F.array("_shard1", "_shard2")).alias("shards"),
    )


def _tree(takes: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """Deals blocks (_source, turn, block) to shards, halving level by level."""
    nodes = takes.withColumns({"_from": F.lit(0), "_to": F.lit(n_shards)})
    nodes = cut_lineage(nodes, "mix-tree")
    for depth in range(math.ceil(math.log2(max(1, n_shards)))):
        key = [F.col(c) for c in ("_source", "turn", "block")]
        hashed = nodes.withColumn("_hash", seeded(seed, F.lit(f"level{depth}"), *key))
        ranked = running(
            hashed,
            ["_from", "_to"],
            slice_of(F.col("_hash")),
            ["_hash", "_source", "turn", "block"],
            {"n": F.lit(1)},
        )
        middle = F.expr("(_from + _to) div 2").cast("int")
        quota = F.expr("n_total * ((_from + _to) div 2 - _from) div (_to - _from)")
        left = F.col("n_before") < quota
        split = ranked.withColumns({"_mid": middle, "_left": left})
        nodes = split.select(
            "_source",
            "turn",
            "block",
            F.when(F.col("_left"), F.col("_from")).otherwise(F.col("_mid")).alias("_from"),
            F.when(F.col("_left"), F.col("_mid")).otherwise(F.col("_to")).alias("_to"),
        )
        nodes = cut_lineage(nodes, "mix-tree")
    return nodes.withColumnRenamed("_from", "shard").drop("_to")


def mix(
    docs: DataFrame, n_shards: int = N_SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED
) -> DataFrame:
    """Whole rows as often as they are drawn, with ``shard`` and ``mix_order``.

    ``mix_order`` is the place of a row within its shard as a hash to sort by.
    Whole rows are shuffled once.
    """
    keyed, keys = with_identity(docs)
    rows = keyed.select("doc_id", "source", n_words(F.col("text")).alias("size"), *keys)
    shard, order = fresh(docs.columns, "shard"), fresh(docs.columns, "mix_order")
    drawn = draw(rows, n_shards, block_words, seed).select(
        *keys, "doc_id", F.posexplode("shards").alias("_turn", shard)
    )
    drawn = drawn.withColumn(order, seeded(seed, F.lit("local"), F.col("doc_id"), F.col("_turn")))
    return attach(keyed, keys, drawn.select(*keys, shard, order))


def digest(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per document: what its source gives and what the mix takes of it."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    drawn = draw(rows, seed=seed)
    taken = F.col("size") * F.size("shards")
    return drawn.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
