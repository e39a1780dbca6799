"""The prefix trie of conversations, from adaptive radix trees over fixed-width turn ids.

A turn (role, text) becomes an id of ``WIDTH`` bytes, big-endian: the size of its text in 4
bytes and 96 bits of its MD5. A conversation is the string of its ids. Strings are put
in order over all tasks, in chunks of about ``CHUNK_BYTES``; each chunk becomes radix trees
(``radix``) in one task, whose nodes at whole turns are nodes of the trie.

A node's conversations may lie in several chunks. Each chunk also gets the last string before
it and the first one after it, which count as nothing but tell it which nodes an earlier
chunk has opened and which ones go on later. With that, all numbers of a node are sums
(or least values) over the chunks, so equal nodes are simply aggregated: counts, opened
children and leaves, and n * bytes over a subtree less bytes once per opened node. No
node is collected anywhere, however many conversations begin with it.

Conversations longer than ``BLOCK`` turns are cut into blocks of that many turns; a block hangs
below the node its conversation has reached, and blocks are worked off from the deepest to the
first, so that a tree's depth and a string's size are bounded.

Defined results: turns are ordered by turn (nulls first), then role and text; a null role
or text is empty; repeated rows are turns of their own; rows without a conv_id belong to no
conversation; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import placed, prepare
from sensorloom.llm.radix import Node, Tree
from sensorloom.session import cut_lineage

WIDTH = 16
BLOCK = 16_384
CHUNK_BYTES = 4 << 20
# Bytes of a string by which strings are dealt to chunks.
_LEAD = 1024
_PIECE = 1 << 20
_ROOT = bytes(WIDTH)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_id) of every row, places from 0; a turn id as hex digits."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    by = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    lead = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.left("text", F.lit(64)).asc()]
    size = F.lpad(F.hex(F.octet_length("text")), 8, "0")
    # Role and text cannot run into each other: the role's length comes first.
    mark = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    found = placed(rows, "conv_id", by, lead, "trie-rows").select(
        "conv_id", "place", F.concat(size, F.left(mark, F.lit(24))).alias("turn_id")
    )
    return cut_lineage(found, "trie-turns")


def rebuilt(given: DataFrame) -> DataFrame:
    """(conv_id, place, turn_id): each conversation with the first turns of another one.

    Conversation c begins with the first h turns of conversation c - c % 5 and goes on with its own
    after its first h; h is a checksum of c modulo 9. A conversation that is left with no
    turns has one row with null place and id.
    """
    sizes = given.groupBy("conv_id").agg(F.count("turn_id").alias("n"))
    cut = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("long")
    heads = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), cut.alias("h"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = heads.join(bases, "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("long")))
    )
    # At most eight rows of a conversation, and at most five conversations that want them.
    first = given.filter("place < 8").select(F.col("conv_id").alias("base"), "place", "turn_id")
    begun = heads.join(first, "base").filter("place < taken").select("conv_id", "place", "turn_id")
    own = given.join(heads.select("conv_id", "h", "taken"), "conv_id").filter("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "turn_id")
    left = begun.unionByName(own)
    none = heads.select("conv_id").join(left.select("conv_id").distinct(), "conv_id", "left_anti")
    return left.unionByName(none, allowMissingColumns=True)


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(conv_id, level, key, ends): the strings of ids, a block of turns each."""
    level = F.floor(F.coalesce("place", F.lit(0)) / F.lit(block)).cast("int")
    rows = rows.withColumn("level", level)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "turn_id"))), lambda t: t["turn_id"])
    key = F.unhex(F.array_join(ids, ""))
    strings = rows.groupBy("conv_id", "level").agg(key.alias("key"))
    last = F.max("level").over(Window.partitionBy("conv_id"))
    return strings.select("conv_id", "level", "key", (F.col("level") == last).alias("ends"))


def _step(above: bytes, turn: bytes) -> bytes:
    """The name of the node one turn below another one."""
    return hashlib.blake2b(above + turn, digest_size=WIDTH).digest()


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block of a conversation with the node it hangs below; blocks come in order."""
    now, node = None, _ROOT
    for batch in batches:
        units = []
        for conv_id, key in zip(batch["conv_id"].to_pylist(), batch["key"].to_pylist()):
            if conv_id != now:
                now, node = conv_id, _ROOT
            units.append(node)
            for at in range(0, len(key), WIDTH):
                node = _step(node, key[at : at + WIDTH])
        yield batch.append_column("unit", pa.array(units, type=pa.binary()))


def _strings(rows: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(conv_id, level, key, ends, unit) and the number of levels."""
    strings = cut_lineage(_blocks(rows, block), "trie-strings")
    levels = (strings.agg(F.max("level")).first()[0] or 0) + 1
    if levels == 1:
        return strings.withColumn("unit", F.lit(_ROOT)), 1
    ordered = strings.repartition("conv_id").sortWithinPartitions("conv_id", "level")
    schema = "conv_id long, level int, key binary, ends boolean, unit binary"
    return cut_lineage(ordered.mapInArrow(_named, schema), "trie-units"), levels


def _distinct(strings: DataFrame) -> DataFrame:
    """One row per different string below a node, with what its conversations add up to."""
    return strings.groupBy("unit", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("least"),
        F.max(F.when(F.col("ends"), 1)).isNotNull().alias("ended"),
    )


_MARKS = ("end_a", "end_b")
_SUMS = ("children", "leaves", "saved")


def _end_marks() -> list[Column]:
    """The name of a string for the hash of the conversations that end with it."""
    return [
        F.xxhash64("unit", "key").alias("end_a"),
        F.xxhash64(F.lit("b"), "unit", "key").alias("end_b"),
    ]


def _chunks(strings: DataFrame, chunk_bytes: int) -> DataFrame:
    """Strings in order, in chunks, each with its neighbours' nearest strings (side -1 and 1)."""
    strings = cut_lineage(strings, "trie-distinct")
    size = strings.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    n = int(size // chunk_bytes) + 1
    lead = [F.col("unit"), F.substring("key", 1, _LEAD)]
    dealt = strings.repartitionByRange(n, *lead).withColumn("chunk", F.spark_partition_id())
    dealt = cut_lineage(dealt.withColumn("side", F.lit(0)), "trie-chunks")
    held = F.struct("unit", "key")
    ends = dealt.groupBy("chunk").agg(F.min(held).alias("first"), F.max(held).alias("last"))
    ends = cut_lineage(ends, "trie-ends")
    # Numbers of the chunks that have strings: as many rows as there are tasks.
    order = Window.orderBy("chunk")
    near = ends.select("chunk").withColumns(
        {"before": F.lag("chunk").over(order), "after": F.lead("chunk").over(order)}
    )
    both = ends.join(near, "chunk")
    halo = both.filter("after IS NOT NULL").select(
        F.col("after").alias("chunk"), "last.unit", "last.key", F.lit(-1).alias("side")
    )
    halo = halo.unionByName(
        both.filter("before IS NOT NULL").select(
            F.col("before").alias("chunk"), "first.unit", "first.key", F.lit(1).alias("side")
        )
    )
    rows = dealt.unionByName(halo, allowMissingColumns=True)
    return rows.repartition(n, "chunk").sortWithinPartitions("chunk", "unit", "key")


class _Entry:
    """What one string adds to the nodes on its way."""

    __slots__ = ("n", "least", "side", "below", "marks")

    def __init__(self, n, least, side, below, marks):
        self.n, self.least, self.side, self.below, self.marks = n, least, side, below, marks


class _Sums:
    """What a subtree adds up to within one chunk."""

    __slots__ = ("n", "least", "known", "tops", "any", "leaves", "saved")

    def __init__(self):
        self.n, self.least, self.known = 0, None, False
        # Trie nodes right below: those opened here, and whether there is any at all.
        self.tops, self.any = 0, False
        self.leaves = self.saved = 0

    def add(self, other: _Sums) -> None:
        self.n += other.n
        self.least = other.least if self.least is None else self.least if other.least is None else min(self.least, other.least)
        self.known |= other.known
        self.tops += other.tops
        self.any |= other.any
        self.leaves += other.leaves
        self.saved += other.saved


class _Frame:
    """A radix node on the way down and up."""

    __slots__ = ("node", "turns", "below", "sums", "start", "tail", "name")

    def __init__(self, node: Node, label: bytes, above: _Frame | None, unit: bytes):
        path = label + node.prefix
        tail = above.tail if above is not None else b""
        self.start = (above.start + len(above.turns)) if above is not None else 0
        path = tail + path
        whole = len(path) // WIDTH * WIDTH
        # Whole turns end within or at the end of this node's bytes: (name, name above, bytes).
        self.turns = []
        self.name = above.name if above is not None else unit
        for at in range(0, whole, WIDTH):
            turn = path[at : at + WIDTH]
            name = _step(self.name, turn)
            self.turns.append((name, self.name, struct.unpack_from(">I", turn)[0]))
            self.name = name
        self.tail = path[whole:]
        self.node, self.below, self.sums = node, node.below(), _Sums()


def _closed(frame: _Frame, unit: bytes, level_depth: int, is_root: bool) -> Iterator[tuple]:
    """Settles a radix node whose children are done: its rows, deepest turn first."""
    sums = frame.sums
    own = [0, 0, 0]
    marks = (None, None)
    for entry in frame.node.values:
        sums.n += entry.n
        if entry.n:
            sums.least = entry.least if sums.least is None else min(sums.least, entry.least)
        sums.known |= entry.side < 0
        if entry.below is not None:
            own = [a + b for a, b in zip(own, entry.below)]
        if entry.marks[0] is not None:
            marks = entry.marks
    sums.leaves += own[1]
    sums.saved += own[2]
    opened = sums.n > 0 and not sums.known
    children, childless = sums.tops + own[0], not sums.any and not own[0]
    # The first radix node also holds the node of no turns.
    nodes = [(unit, None, 0), *frame.turns] if is_root else frame.turns
    depth = frame.start + len(frame.turns)
    for name, above, size in reversed(nodes):
        if opened:
            sums.leaves += childless
            sums.saved -= size
        sums.saved += sums.n * size
        if sums.n:
            yield name, above, level_depth + depth, sums.n, sums.least, children, sums.leaves, sums.saved, *marks
        children, childless, marks = int(opened), False, (None, None)
        sums.tops, sums.any = int(opened), True
        depth -= 1


def _nodes(tree: Tree, unit: bytes, level_depth: int) -> Iterator[tuple]:
    """The rows of a chunk's trie nodes below ``unit``, itself included."""
    stack = [_Frame(tree.root, b"", None, unit)]
    while stack:
        frame = stack[-1]
        step = next(frame.below, None)
        if step is not None:
            stack.append(_Frame(step[1], bytes([step[0]]), frame, unit))
            continue
        stack.pop()
        yield from _closed(frame, unit, level_depth, not stack)
        if stack:
            stack[-1].sums.add(frame.sums)


_PIECES = pa.schema(
    [
        (name, pa.int64())
        for name in ("a", "b", "above_a", "above_b", "depth", "n", "least", *_SUMS, *_MARKS)
    ]
)


def _longs(name: bytes | None) -> tuple[int | None, int | None]:
    return struct.unpack(">qq", name) if name is not None else (None, None)


def _grown(level_depth: int):
    """Rows of a chunk, in order, to the pieces of its trie nodes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for (_, unit), group in groupby(rows(batches), key=lambda r: r[:2]):
            tree = Tree()
            for _, _, key, side, n, least, children, leaves, saved, end_a, end_b in group:
                below = None if children is None else (children, leaves, saved)
                tree.add(key, _Entry(n or 0, least, side, below, (end_a, end_b)))
            for name, above, *numbers in _nodes(tree, unit, level_depth):
                held.append((*_longs(name), *_longs(above), *numbers))
                if len(held) == 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=_PIECES)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=_PIECES)

    return run


def _merged(pieces: DataFrame) -> DataFrame:
    """One row per node from those of the chunks."""
    return pieces.groupBy("a", "b", "above_a", "above_b", "depth").agg(
        F.sum("n").alias("n"),
        F.min("least").alias("least"),
        *[F.sum(c).alias(c) for c in _SUMS],
        *[F.max(c).alias(c) for c in _MARKS],
    )


def _level(strings: DataFrame, level: int, below: DataFrame | None, block: int, chunk_bytes: int) -> DataFrame:
    """The nodes of one level of blocks; its topmost ones are those that blocks hang below."""
    here = _distinct(strings.filter(F.col("level") == level))
    marks = [F.when(F.col("ended"), m).alias(n) for m, n in zip(_end_marks(), _MARKS)]
    if below is None:
        sums = [F.lit(None).cast("long").alias(c) for c in _SUMS]
        here = here.select("unit", "key", "n", "least", *sums, *marks)
    else:
        # The node a full block leads to is known by the block's name, and so is what hangs there.
        here = here.join(below, ["unit", "key"], "left").select("unit", "key", "n", "least", *_SUMS, *marks)
    schema = ", ".join(f"{name} long" for name in _PIECES.names)
    rows = _chunks(here, chunk_bytes).select("chunk", "unit", "key", "side", "n", "least", *_SUMS, *_MARKS)
    return cut_lineage(_merged(rows.mapInArrow(_grown(level * block), schema)), f"trie-level-{level}")


def _hanging(strings: DataFrame, level: int, nodes: DataFrame) -> DataFrame:
    """(unit, key, children, leaves, saved): what hangs below each full block of the level above."""
    units = strings.filter(F.col("level") == level).groupBy("unit").agg(F.min("conv_id").alias("conv_id"))
    blocks = strings.filter(F.col("level") == level - 1).select("conv_id", F.col("unit").alias("upper"), "key")
    tops = nodes.filter(F.col("above_a").isNull()).select("a", "b", *_SUMS)
    name = [F.conv(F.substring(F.hex("unit"), at, 16), 16, -10).cast("long") for at in (1, 17)]
    named = units.withColumns({"a": name[0], "b": name[1]}).join(tops, ["a", "b"])
    return named.join(blocks, "conv_id").select(F.col("upper").alias("unit"), "key", *_SUMS)


def _hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decimal ids of each string's conversations, joined, in pieces of bounded size."""
    schema = pa.schema([("end_a", pa.int64()), ("end_b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    now, held, first, size, out = None, [], None, 0, []
    for batch in batches:
        for a, b, conv_id in zip(*(batch[c].to_pylist() for c in ("end_a", "end_b", "conv_id"))):
            if (a, b) != now or size >= _PIECE:
                if held:
                    out.append((*now, first, ",".join(held)))
                now, held, first, size = (a, b), [], conv_id, 0
            held.append(str(conv_id))
            size += len(held[-1]) + 1
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)
                out = []
    if held:
        out.append((*now, first, ",".join(held)))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("end_a", pa.int64()), ("end_b", pa.int64()), ("ends_sha256", pa.string())])
    now, content, out = None, None, []
    for batch in batches:
        for a, b, ids in zip(*(batch[c].to_pylist() for c in ("end_a", "end_b", "ids"))):
            if (a, b) == now:
                content.update(b"," + ids.encode())
                continue
            if now is not None:
                out.append((*now, content.hexdigest()))
            now, content = (a, b), hashlib.sha256(ids.encode())
        if len(out) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)
            out = []
    if now is not None:
        out.append((*now, content.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=schema)


def _end_hashes(strings: DataFrame) -> DataFrame:
    """(end_a, end_b, ends_sha256): the hash of the conversations that end with a string.

    Ids are ordered over all tasks; only their joined pieces meet where they are hashed.
    """
    ended = strings.filter("ends").select(*_end_marks(), "conv_id")
    key = ["end_a", "end_b", "conv_id"]
    runs = ended.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(
        _hashed_runs, "end_a long, end_b long, first long, ids string"
    )
    order = ["end_a", "end_b", "first"]
    whole = runs.repartition("end_a", "end_b").sortWithinPartitions(*order)
    return whole.mapInArrow(_hashed, "end_a long, end_b long, ends_sha256 string")


def trie(rows: DataFrame, block: int = BLOCK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The nodes of (conv_id, place, turn_id) rows.

    Columns: node_id and parent_id (hex), conv_id (the least member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    prepare(rows.sparkSession)
    strings, levels = _strings(rows, block)
    found, below = None, None
    for level in range(levels - 1, -1, -1):
        nodes = _level(strings, level, below, block, chunk_bytes)
        if level:
            below = _hanging(strings, level, nodes)
            # A topmost node is there already as the last one of the level above.
            nodes = nodes.filter(F.col("above_a").isNotNull())
        found = nodes if found is None else found.unionByName(nodes)
    above = found.select(
        F.col("a").alias("above_a"), F.col("b").alias("above_b"), F.col("least").alias("parent_conv_id")
    )
    hexed = lambda a, b: F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        found.join(above, ["above_a", "above_b"], "left")
        .join(_end_hashes(strings), ["end_a", "end_b"], "left")
        .select(
            hexed("a", "b").alias("node_id"),
            hexed("above_a", "above_b").alias("parent_id"),
            F.col("least").alias("conv_id"),
            "depth",
            "parent_conv_id",
            F.col("n").alias("n_convs"),
            F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )


def digest(conversations: DataFrame, **sizes: int) -> DataFrame:
    """The nodes of the rebuilt conversations."""
    return trie(rebuilt(turns(conversations)), **sizes).drop("node_id", "parent_id")
