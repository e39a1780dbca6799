"""Laying epoch-indexed traces on a timeline, idempotently.

Entities follow their own normal trace until a failure takes effect; from then
on they follow the shared trace of the failure type, from their own cursor.
One epoch and many epochs are the same job with a different range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.timeops import as_of_column, between_times
from sensorloom.operators.keyed import absent_rows, update_from_map, update_if_exists, upsert
from sensorloom.plans.clock import Clock
from sensorloom.schemas import DEFAULT_STATUS, FAILURE_TYPES, SENSORS

KEYS = ["timestamp", "entity_id"]

# Epochs per block of the failure-trace join.
_BLOCK = 60
# Copies of a block, each for a share of the entities.
_SALTS = 32


def tag_traces(traces: dict[str, DataFrame]) -> DataFrame:
    """One frame of all failure traces, named by type."""
    tagged = [
        df.select(F.lit(kind).alias("failure_type"), "epoch", *SENSORS)
        for kind, df in traces.items()
    ]
    out = tagged[0]
    for more in tagged[1:]:
        out = out.unionByName(more)
    return out


def _effective(config: DataFrame) -> DataFrame:
    """Enabled failures with NULL cursors and start epochs read as zero."""
    return config.filter("enabled").select(
        "entity_id",
        "failure_type",
        F.coalesce("effective_from_epoch", F.lit(0)).alias("eff"),
        F.coalesce("failure_next_epoch", F.lit(0)).alias("cur"),
    )


def _stamp(
    rows: DataFrame, clock: Clock, existing: DataFrame, epochs: int, day: str | None = None
) -> DataFrame:
    """Give rows their time and drop those already there.

    Only the touched time range of ``existing`` is read, and only its days if
    it is laid out by ``day``.
    """
    stamped = rows.select(
        clock.time_of(F.col("epoch")).alias("timestamp"),
        "entity_id",
        *SENSORS,
        F.lit(DEFAULT_STATUS).alias("status"),
    )
    first, last = clock.time_of(clock.epoch + 1), clock.time_of(clock.epoch + epochs)
    there = between_times(existing, "timestamp", first, last, day=day)
    return absent_rows(there, stamped, KEYS)


def _normal_rows(config: DataFrame, normal: DataFrame, clock: Clock, epochs: int) -> DataFrame:
    """Normal-trace rows of the range, without epochs a failure has taken over."""
    ranged = normal.filter(F.col("epoch").between(clock.epoch + 1, clock.epoch + epochs)).alias("n")
    taken = _effective(config).select("entity_id", "eff").alias("f")
    replaced = (F.col("n.entity_id") == F.col("f.entity_id")) & (F.col("f.eff") <= F.col("n.epoch"))
    return ranged.join(taken, replaced, "left_anti").select("entity_id", "epoch", *SENSORS)


def _failure_rows(
    config: DataFrame, failure_traces: DataFrame, clock: Clock, epochs: int
) -> DataFrame:
    """Failure-trace rows of the range for all failing entities at once.

    An entity reads the trace epochs after its cursor, as many as the range
    holds once the failure is in effect. The range condition is joined by
    blocks of epochs, so an entity costs one row per block before the join,
    not one per epoch. Entities of a type may all stand at one epoch, so the
    key is salted: each block of a trace is there ``_SALTS`` times, and an
    entity meets one of them.
    """
    delay = F.greatest(F.lit(0), F.col("eff") - (clock.epoch + 1))
    wanted = _effective(config).select(
        "entity_id",
        "failure_type",
        (F.col("cur") + 1).alias("first"),
        (F.col("cur") + epochs - delay).alias("last"),
        (F.lit(clock.epoch) + delay - F.col("cur")).alias("shift"),
    )
    wanted = wanted.filter(F.col("first") <= F.col("last"))
    block, salts = F.lit(_BLOCK), F.lit(_SALTS).cast("long")
    blocks = wanted.withColumn(
        "block",
        F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))),
    )
    blocks = blocks.withColumn("salt", F.pmod(F.xxhash64("entity_id"), salts))
    pieces = failure_traces.withColumns(
        {
            "block": F.floor(F.col("epoch") / block),
            "salt": F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)),
        }
    )
    joined = blocks.join(pieces, ["failure_type", "block", "salt"]).filter(
        F.col("epoch").between(F.col("first"), F.col("last"))
    )
    return joined.select("entity_id", (F.col("epoch") + F.col("shift")).alias("epoch"), *SENSORS)


def backfill_normal(
    state: DataFrame,
    config: DataFrame,
    normal: DataFrame,
    existing: DataFrame,
    *,
    epochs: int,
    day: str | None = None,
) -> DataFrame:
    """New readings of the next ``epochs`` epochs from the normal traces."""
    clock = Clock.of(state)
    return _stamp(_normal_rows(config, normal, clock, epochs), clock, existing, epochs, day)


def backfill_failure(
    state: DataFrame,
    config: DataFrame,
    failure_traces: DataFrame,
    existing: DataFrame,
    *,
    epochs: int,
    day: str | None = None,
) -> DataFrame:
    """New readings of the next ``epochs`` epochs from the failure traces."""
    clock = Clock.of(state)
    rows = _failure_rows(config, failure_traces, clock, epochs)
    return _stamp(rows, clock, existing, epochs, day)


def replay_tick(
    state: DataFrame,
    config: DataFrame,
    normal: DataFrame,
    failure_traces: DataFrame,
    existing: DataFrame,
) -> DataFrame:
    """New readings of the next epoch.

    Here a failure without a start epoch is not in effect, and an entity whose
    failure trace has ended brings no row.
    """
    clock = Clock.of(state)
    started = config.filter(F.col("effective_from_epoch") <= clock.epoch + 1)
    rows = _normal_rows(started, normal, clock, 1).unionByName(
        _failure_rows(started, failure_traces, clock, 1)
    )
    return _stamp(rows, clock, existing, 1)


def advance_cursor(config: DataFrame, failure_traces: DataFrame, *, epoch) -> DataFrame:
    """Cursors one further for failures in effect whose trace goes on."""
    following = F.coalesce("failure_next_epoch", F.lit(0)) + 1
    return update_if_exists(
        config,
        failure_traces,
        {"failure_type": F.col("failure_type"), "epoch": following},
        {"failure_next_epoch": following},
        condition=F.col("enabled") & (F.col("effective_from_epoch") <= epoch),
    )


def batch_cursor_update(config: DataFrame, *, clock, epochs: int) -> DataFrame:
    """Cursors as a bulk backfill of ``epochs`` epochs leaves them."""
    clock = clock if isinstance(clock, Column) else F.lit(clock)
    eff = F.col("eff")
    ahead = F.least(F.lit(epochs), clock + epochs - eff + 1)
    steps = F.when(eff > clock, ahead).otherwise(F.lit(epochs))
    updates = (
        _effective(config)
        .withColumn("steps", F.when(clock + epochs >= eff, steps))
        .filter(F.col("steps") > 0)
        .select("entity_id", (F.col("cur") + F.col("steps")).alias("failure_next_epoch"))
    )
    return update_from_map(config, updates, "entity_id")


def activate_failure(
    config: DataFrame, entities: DataFrame, failure_type: str, *, clock
) -> DataFrame:
    """Enable a failure for the given entities from the next epoch on.

    A cursor already there is kept; a new one starts at zero.
    """
    kind = failure_type.upper()
    if kind not in FAILURE_TYPES:
        raise ValueError(f"unknown failure type {failure_type!r}")
    clock = clock if isinstance(clock, Column) else F.lit(clock)
    rows = entities.select("entity_id").distinct().select(
        "entity_id",
        F.lit(kind).alias("failure_type"),
        F.lit(True).alias("enabled"),
        (clock + 1).alias("effective_from_epoch"),
        F.lit(0).alias("failure_next_epoch"),
    )
    return upsert(config, rows, "entity_id", update_keep=("failure_next_epoch",))


def advance_clock(state: DataFrame, *, epochs: int) -> DataFrame:
    """The stream state ``epochs`` further."""
    return state.withColumn("next_epoch", F.col("next_epoch") + epochs)


def fill_state_defaults(state: DataFrame, *, as_of=None, step_seconds: int = 5) -> DataFrame:
    """Stream state with NULL fields replaced by their defaults."""
    return state.withColumns(
        {
            "start_ts": F.coalesce("start_ts", as_of_column(as_of)),
            "step_seconds": F.coalesce("step_seconds", F.lit(step_seconds).cast("long")),
            "next_epoch": F.coalesce("next_epoch", F.lit(0).cast("long")),
        }
    )
