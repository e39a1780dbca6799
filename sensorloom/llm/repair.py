"""Conversation structure repair: the cheapest edits that give every conversation legal turns.

A conversation's rows are taken by turn (nulls first; rows of one turn by role, then
text). Each row's first fault counts: ``blank`` (no character but white space),
``duplicate`` (role and text seen earlier in the conversation), ``truncated`` (its last such
character is not ``.``, ``!`` or ``?``). Edits of a row are Keep (cost 0), Rerole to user or
assistant (1) and Delete (2, the only one for blank and duplicate rows); an empty user
or assistant row can be Inserted anywhere (5); a truncated row that stays costs 5. The
roles left have to begin with the letters ``(s?(ua)+)?``. Of the cheapest ways the one
whose audit (initials of the edits in order) comes first in ASCII is taken.

The choice is a shortest path over an acyclic graph of (row, last role kept). A path's
weight is one integer: its high digits are the cost, its low digits, of three bits each
at fixed places, the letters of its audit, with zeros behind the last one. The least
integer is the cheapest path, ties settled. Only four paths are alive after a row. What
they all begin with is final and leaves the weights, so these stay short in long
conversations.

Rows are shuffled by conversation and streamed in order; a task holds one batch and
the paths' unsettled letters, never a conversation. Whether a row is a duplicate is
found by aggregates before that, so it needs no memory of what was seen.

Defined results: a null role or text is one space; null conv_ids are one conversation;
rows equal in all four columns follow each other as copies; without rows a
conversation has zeros, an empty audit and no repaired rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import prepare
from sensorloom.session import cut_lineage

REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
# Letters of the audit in ASCII order, three bits each; zero stands behind the last one.
LETTERS = " DIKR"
_D, _I, _K, _R = 1, 2, 3, 4
BITS = 3
# Letters that weights have room for at first.
ROOM = 64
# Kinds of prefixes of legal sequences: none, s, ends in u, ends in a.
NONE, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {
    "s": {NONE: SYSTEM},
    "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\x0b\x0c\r"
_MOST = (1 << 63) - 1


class Paths:
    """The least path to each kind of prefix, row after row."""

    def __init__(self):
        self.room = ROOM
        self.weights: list[int | None] = [0, None, None, None]
        self.sizes = [0, 0, 0, 0]
        self.cost = 0
        self.settled: list[str] = []

    def _edge(self, weight: int, size: int, cost: int, letter: int) -> int:
        return weight + (cost << BITS * self.room) + (letter << BITS * (self.room - 1 - size))

    def _offer(self, weights, sizes, to: int, weight: int, size: int) -> None:
        if weights[to] is None or weight < weights[to]:
            weights[to], sizes[to] = weight, size

    def _insert(self) -> None:
        """Rows inserted here. A third one would lead back to a prefix reached before."""
        w, n = self.weights, self.sizes
        for sources, to in (((NONE, SYSTEM, ASSISTANT), USER), ((USER,), ASSISTANT)):
            for at in sources:
                if w[at] is not None:
                    self._offer(w, n, to, self._edge(w[at], n[at], INSERT, _I), n[at] + 1)

    def delete(self, copies: int = 1) -> None:
        """Rows that have to go. Inserting before them is never better: D comes before I."""
        while copies:
            some = min(copies, 1 << 12)
            self._make_room(some)
            letters = ((1 << BITS * some) - 1) // ((1 << BITS) - 1) * _D
            for at, weight in enumerate(self.weights):
                if weight is not None:
                    shift = BITS * (self.room - self.sizes[at] - some)
                    self.weights[at] = weight + (DELETE * some << BITS * self.room) + (letters << shift)
                    self.sizes[at] += some
            copies -= some

    def row(self, initial: str, truncated: bool) -> None:
        """A row that may stay."""
        self._make_room(3)
        before = list(self.weights), list(self.sizes)
        self._insert()
        w, n = [None] * 4, [0] * 4
        for at, (weight, size) in enumerate(zip(*before)):
            if weight is not None:
                self._offer(w, n, at, self._edge(weight, size, DELETE, _D), size + 1)
        extra = CUT_OFF if truncated else 0
        keeps = KEEPS.get(initial, {})
        for at, (weight, size) in enumerate(zip(self.weights, self.sizes)):
            if weight is None:
                continue
            if at in keeps:
                self._offer(w, n, keeps[at], self._edge(weight, size, extra, _K), size + 1)
            to = ASSISTANT if at == USER else USER
            self._offer(w, n, to, self._edge(weight, size, REROLE + extra, _R), size + 1)
        self.weights, self.sizes = w, n

    def end(self) -> tuple[int, str]:
        """Cost and audit of the least path to a legal sequence."""
        self._make_room(2)
        self._insert()
        found = [(w, n) for w, n in zip(self.weights, self.sizes) if w is not None]
        legal = [self.weights[at] for at in (NONE, ASSISTANT) if self.weights[at] is not None]
        weight = min(legal)
        size = next(n for w, n in found if w == weight)
        cost = weight >> BITS * self.room
        return self.cost + cost, "".join(self.settled) + self._text(weight, size)

    def _text(self, weight: int, size: int) -> str:
        """The first letters of a weight."""
        digits = weight >> BITS * (self.room - size)
        mask = (1 << BITS) - 1
        return "".join(LETTERS[digits >> BITS * k & mask] for k in range(size - 1, -1, -1))

    def _make_room(self, letters: int) -> None:
        """Settles what all paths begin with; widens the weights if that is not enough.

        With two inserted rows or a deleted one, any path can go on as any other does, so
        one that costs more than that above the cheapest never wins and goes first.
        """
        if max(self.sizes) + letters <= self.room:
            return
        least = min(w for w in self.weights if w is not None) >> BITS * self.room
        for at, weight in enumerate(self.weights):
            if weight is not None and weight >> BITS * self.room > least + 2 * INSERT:
                self.weights[at] = None
        alive = [at for at, w in enumerate(self.weights) if w is not None]
        low = (1 << BITS * self.room) - 1
        digits = {at: self.weights[at] & low for at in alive}
        costs = {at: self.weights[at] >> BITS * self.room for at in alive}
        differ = 0
        for at in alive:
            differ |= digits[at] ^ digits[alive[0]]
        common = self.room - -(-differ.bit_length() // BITS)
        common = min(common, *[self.sizes[at] for at in alive])
        self.settled.append(self._text(self.weights[alive[0]] & low, common))
        self.cost += least
        longest = max(self.sizes[at] for at in alive) - common
        room = max(ROOM, 2 * (longest + letters))
        rest = (1 << BITS * (self.room - common)) - 1
        for at in range(4):
            if at not in digits:
                self.sizes[at] = 0
                continue
            kept = digits[at] & rest
            shift = BITS * (room - self.room + common)
            kept = kept << shift if shift >= 0 else kept >> -shift
            self.weights[at] = ((costs[at] - least) << BITS * room) + kept
            self.sizes[at] -= common
        self.room = room


def fault(text: str, seen: bool) -> str | None:
    """The first fault of a row; only its last character that is not white space is looked for."""
    bare = text.rstrip(SPACES)
    if not bare:
        return "blank"
    if seen:
        return "duplicate"
    return None if bare[-1] in ".!?" else "truncated"


def counted(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): different rows, nulls of role and text as one space."""
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as ``counted`` gives them, after damage decided by a checksum of conv_id and turn.

    Of every twenty values 0 drops the row, 1 empties its text, 2 removes its sentence
    marks, 3 repeats it and 4 sets its role to user. A conversation's dropped rows stay as one
    row with no copies and no text, so that it is known.
    """
    blank = F.lit(" ")
    ids = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(ids[0], F.lit(":"), ids[1]).cast("binary")) % 20
    dropped = kind == 0
    text = F.coalesce("text", blank)
    rows = conversations.select(
        "conv_id",
        F.when(~dropped, F.col("turn")).alias("turn"),
        F.when(kind == 4, "user").when(~dropped, F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).when(~dropped, text).alias("text"),
        F.when(dropped, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))


def _with_seen(rows: DataFrame) -> DataFrame:
    """Adds ``seen``: whether an earlier turn of the conversation has this role and text.

    The first turn of each role and text is an aggregate of fixed-width columns, joined
    back, so a conversation that says one thing all the time is no hot group.
    """
    key = [F.col("conv_id").isNull(), F.col("conv_id"), F.col("role"), F.col("text")]
    rows = rows.withColumns({"_a": F.xxhash64(*key), "_b": F.xxhash64(F.lit("b"), *key)})
    first = rows.groupBy("_a", "_b").agg(
        F.min("turn").alias("_least"), F.max(F.col("turn").isNull()).alias("_at_null")
    )
    earlier = F.col("turn").isNotNull() & (F.col("_at_null") | (F.col("_least") < F.col("turn")))
    seen = F.coalesce(earlier, F.lit(False)).alias("seen")
    return rows.join(first, ["_a", "_b"]).select("conv_id", "turn", "role", "text", "copies", seen)


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_AUDITED = pa.schema(
    [("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string())]
)
_AUDITED_SQL = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"


class _Audit:
    """One conversation while its rows go by."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.paths = Paths()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = 0
        self.before: str | None = None
        self.first = self.last = None
        self.turns = 0

    def add(self, turn, role: str, text: str, copies: int, seen: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.turns += 1
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        # Copies of a row stand beside each other, and no pair of equal roles is legal.
        self.illegal += copies - 1
        self.before = initial
        found = fault(text, seen)
        if found in ("blank", "duplicate"):
            self.faults[found] += copies
            self.paths.delete(copies)
            return
        self.paths.row(initial, found == "truncated")
        self.faults["truncated"] += found == "truncated"
        self.faults["duplicate"] += copies - 1
        self.paths.delete(copies - 1)

    def result(self) -> dict:
        cost, audit = self.paths.end()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {
            "conv_id": self.conv_id,
            "gaps": min(gaps, _MOST),
            **self.faults,
            "illegal": self.illegal,
            "cost": cost,
            "audit": audit,
        }


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batched(rows: Iterator[dict], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``limit`` bytes of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(v) for v in row.values() if isinstance(v, str))
        if size >= limit:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def results() -> Iterator[dict]:
        now = None
        for conv_id, turn, role, text, copies, seen in _rows(batches):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now.result()
                now = _Audit(conv_id)
            if copies:
                now.add(turn, role, text, copies, seen)
        if now is not None:
            yield now.result()

    yield from _batched(results(), _AUDITED)


def judged(rows: DataFrame) -> DataFrame:
    """Rows as ``counted`` or ``damaged`` give them with ``seen``, written for several readers."""
    prepare(rows.sparkSession)
    return cut_lineage(_with_seen(rows), "repair-rows")


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) from judged rows."""
    prepare(rows.sparkSession)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    ordered = rows.repartition("conv_id").sortWithinPartitions(*order)
    return ordered.mapInArrow(_audited, _AUDITED_SQL)


class _Edits:
    """One conversation's audit while it is applied."""

    def __init__(self, conv_id, audit: dict):
        self.conv_id, self.audit = conv_id, audit
        self.letters = audit["audit"]
        self.at = 0
        self.last = NONE

    def inserted(self) -> Iterator[tuple]:
        """The rows inserted here."""
        while self.letters[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._next_role(), "", "I"

    def given(self, role: str, text: str) -> Iterator[tuple]:
        """A given row as it stays, after what is inserted before it."""
        yield from self.inserted()
        edit = self.letters[self.at]
        self.at += 1
        if edit == "K":
            self.last = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
            yield role, text, edit
        elif edit == "R":
            yield self._next_role(), text, edit

    def _next_role(self) -> str:
        self.last = ASSISTANT if self.last == USER else USER
        return ROLES[self.last]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Edits, tuple | None]]:
    """(conversation, row that stays) in order; each conversation comes first with no row."""
    now = None
    for conv_id, role, text, copies, audit in _rows(batches):
        if audit is not None:
            if now is not None:
                yield from ((now, row) for row in now.inserted())
            now = _Edits(conv_id, audit)
            yield now, None
            continue
        for _ in range(copies):
            yield from ((now, row) for row in now.given(role, text))
    if now is not None:
        yield from ((now, row) for row in now.inserted())


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows, in order."""
    kind = "struct<" + ", ".join(f"{c}: bigint" for c in _COUNTS) + ", audit: string>"
    given = rows.select(
        "conv_id",
        F.lit(1).alias("tag"),
        "turn",
        "role",
        "text",
        "copies",
        F.lit(None).cast(kind).alias("audit"),
    )
    heads = found.select(
        "conv_id",
        F.lit(0).alias("tag"),
        F.lit(None).cast("long").alias("turn"),
        F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("text"),
        F.lit(0).cast("long").alias("copies"),
        F.struct(*_COUNTS, "audit").alias("audit"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "tag", "turn", "role", "text")]
    both = given.unionByName(heads).repartition("conv_id").sortWithinPartitions(*order)
    return both.select("conv_id", "role", "text", "copies", "audit")


_REPAIRED = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]
)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def results() -> Iterator[dict]:
        place = 0
        for now, row in _walk(batches):
            if row is None:
                place = 0
                continue
            yield dict(zip(_REPAIRED.names, (now.conv_id, place, *row)))
            place += 1

    yield from _batched(results(), _REPAIRED)


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the repaired conversations, edits K, R or I."""
    rows = judged(counted(conversations))
    return _with_audits(rows, audits(rows)).mapInArrow(
        _repaired, "conv_id long, place long, role string, text string, edit string"
    )


_DIGEST = _AUDITED.append(pa.field("repaired_sha256", pa.string()))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def results() -> Iterator[dict]:
        now, content, some = None, None, False
        for owner, row in _walk(batches):
            if row is None:
                if now is not None:
                    yield {"conv_id": now.conv_id, **now.audit, "repaired_sha256": content.hexdigest()}
                now, content, some = owner, hashlib.sha256(), False
                continue
            content.update((("\n" if some else "") + f"{row[0]}:{row[1]}").encode())
            some = True
        if now is not None:
            yield {"conv_id": now.conv_id, **now.audit, "repaired_sha256": content.hexdigest()}

    yield from _batched(results(), _DIGEST)


def digest(conversations: DataFrame) -> DataFrame:
    """One row per conversation: faults after damage, the cheapest edits, and a hash of what they give."""
    rows = judged(damaged(conversations))
    return _with_audits(rows, audits(rows)).mapInArrow(_digested, f"{_AUDITED_SQL}, repaired_sha256 string")
