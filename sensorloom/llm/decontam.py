"""Benchmark decontamination by the q-gram lemma.

Texts are reduced to lower-case letters and digits (bytes of other scripts stay)
with single spaces. Every window of ``PASSAGE`` bytes of a benchmark item is a
passage, wherever it begins; a shorter item of at least ``SHORTEST`` is one passage.
A document is contaminated if some substring of it is within k edits of a passage, k
being one edit per ``BYTES_PER_EDIT`` bytes.

Such a region shares at least w - q + 1 - k q of the passage's w - q + 1 q-grams
(positions in the passage), at diagonals (document position less item
position) that differ by k at most. Diagonals are put into bands of 2 (k + 1), each
overlapping the next by half, so one band has them all. The items' q-grams are
indexed once, not once per window; windows of a band with enough of them are counted
again by q-grams of ``SHORT_Q`` bytes, by the same lemma, and what is left is verified by
an alignment confined to the band's diagonals. Nothing within the bound is missed and
nothing beyond it is reported.

The benchmark is a stated query set: its passages go to all tasks in blocks of
about ``BLOCK_BYTES``, however large the benchmark is; documents are read once
and not shuffled.

Defined results: null and empty documents are clean; null and shorter items are
ignored; items with equal passages are all reported, repeated ones once; with no
benchmark everything is clean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import fresh, prepare
from sensorloom.llm.pieces import text_bytes

Q = 10
SHORT_Q = 4
PASSAGE = 60
SHORTEST = 30
BYTES_PER_EDIT = 15
BLOCK_BYTES = 1 << 21
_FILTER_BITS = 22
_JOINT = 1 << 20
_ALIGNED = 1 << 14
_KEPT = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32
    for c in range(256)
)


def normal(text: bytes | None) -> bytes:
    return b" ".join((text or b"").translate(_KEPT).split())


def whole(item: bytes) -> list[bytes]:
    """A normalised item as one piece, each window of which is a passage."""
    return [item] if len(item) >= SHORTEST else []


def passages(item: bytes) -> list[bytes]:
    """A normalised item cut into passages half a passage apart."""
    if len(item) < SHORTEST:
        return []
    if len(item) <= PASSAGE:
        return [item]
    starts = [*range(0, len(item) - PASSAGE, PASSAGE // 2), len(item) - PASSAGE]
    return [item[s : s + PASSAGE] for s in starts]


def qgrams(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q bytes at each position."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    eight = np.ndarray(n, dtype="<u8", buffer=text.data, strides=(1,))
    two = np.ndarray(n, dtype="<u2", buffer=text.data, offset=8, strides=(1,))
    value = (eight ^ (two.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(
        0x9E3779B97F4A7C15
    )
    return value ^ (value >> np.uint64(29))


def _distinct_windows(grams: np.ndarray, window: int) -> np.ndarray:
    """Which q-grams of a piece are in the first one of some equal windows."""
    span = window - Q + 1
    n = len(grams) - span + 1
    if n == 1:
        return np.ones(len(grams), dtype=bool)
    value = np.zeros(n, dtype=np.uint64)
    for at in range(0, window, Q):
        at = min(at, span - 1)
        value = (value ^ grams[at : at + n]) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
    first = np.unique(value, return_index=True)[1]
    change = np.zeros(len(grams) + 1, dtype=np.int64)
    change[first] += 1
    change[first + span] -= 1
    return np.cumsum(change)[:-1] > 0


@dataclass(frozen=True)
class Index:
    """Pieces of some items, one after the other, and where each q-gram is in them."""

    letters: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    windows: np.ndarray
    edits: np.ndarray
    items: list[int | None]
    grams: np.ndarray
    firsts: np.ndarray
    entries: np.ndarray
    filter: np.ndarray

    @property
    def texts(self) -> list[np.ndarray]:
        return [self.letters[s : s + n] for s, n in zip(self.starts, self.sizes)]

    @staticmethod
    def of(rows: list[tuple[int | None, bytes | None]], cut=passages) -> Index | None:
        found = sorted({(p, i) for i, t in rows for p in cut(normal(t))}, key=repr)
        if not found:
            return None
        letters = np.frombuffer(b"".join(p for p, _ in found) + bytes(SHORT_Q), dtype=np.uint8)
        sizes = np.array([len(p) for p, _ in found])
        windows = np.minimum(sizes, PASSAGE)
        grams, entries = [], []
        for number, (piece, _) in enumerate(found):
            own = qgrams(np.frombuffer(piece, dtype=np.uint8))
            kept = np.flatnonzero(_distinct_windows(own, int(windows[number])))
            grams.append(own[kept])
            entries.append(np.stack([np.full(len(kept), number), kept], axis=1))
        every, places = np.concatenate(grams), np.concatenate(entries)
        order = np.argsort(every, kind="stable")
        unique, firsts = np.unique(every[order], return_index=True)
        marks = np.zeros(1 << _FILTER_BITS, dtype=bool)
        marks[unique >> np.uint64(64 - _FILTER_BITS)] = True
        return Index(
            letters,
            np.cumsum(sizes) - sizes,
            sizes,
            windows,
            windows // BYTES_PER_EDIT,
            [i for _, i in found],
            unique,
            np.append(firsts, len(every)),
            places[order],
            marks,
        )


def _laid(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins, begins + 1, ... for each of the sizes, one after the other."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _short_qgrams(letters: np.ndarray) -> np.ndarray:
    return np.ndarray(len(letters) - SHORT_Q + 1, dtype="<u4", buffer=letters.data, strides=(1,))


def _runs(text: np.ndarray, index: Index) -> tuple[np.ndarray, ...]:
    """(piece, band, first, last): runs of windows of a piece with enough shared q-grams in a band."""
    values = qgrams(text)
    spots = np.flatnonzero(index.filter[values >> np.uint64(64 - _FILTER_BITS)])
    at = np.searchsorted(index.grams, values[spots])
    at = np.minimum(at, len(index.grams) - 1)
    real = index.grams[at] == values[spots]
    spots, at = spots[real], at[real]
    many = index.firsts[at + 1] - index.firsts[at]
    entry = index.entries[_laid(index.firsts[at], many)]
    piece, offset = entry[:, 0], entry[:, 1]
    low = (np.repeat(spots, many) - offset) // (index.edits[piece] + 1)
    # A diagonal is in the band that starts at its step and in the one before.
    shift = int(index.sizes.max()) + 2
    key = piece * np.int64(1 << 40) + (low + shift)
    key, offset = np.concatenate([key, key - 1]), np.concatenate([offset, offset])
    span = index.windows - Q + 1
    least = np.maximum(1, span - index.edits * Q)
    # Most bands have a q-gram or two: they are put aside before offsets are compared.
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.diff(key[order], prepend=-1))
    sizes = np.diff(np.append(begin, len(order)))
    enough = sizes >= least[key[order[begin]] >> 40]
    order = order[np.repeat(enough, sizes)]
    order = order[np.lexsort((offset[order], key[order]))]
    key, offset = key[order], offset[order]
    new = (np.diff(key, prepend=-1) != 0) | (np.diff(offset, prepend=-1) != 0)
    key, offset = key[new], offset[new]
    piece = key >> 40
    last = np.arange(len(key)) + least[piece] - 1
    inside = last < len(key)
    last = np.minimum(last, len(key) - 1)
    inside &= (key[last] == key) & (offset[last] - offset < span[piece])
    key, piece, end, offset = key[inside], piece[inside], offset[last[inside]], offset[inside]
    # Windows that hold the q-grams from here to the last one needed; both ends rise within a band.
    first = np.maximum(0, end - span[piece] + 1)
    final = np.minimum(offset, index.sizes[piece] - index.windows[piece])
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (first[1:] > final[:-1] + 1)
    ends = np.append(new[1:], True)[: len(new)]
    return piece[new], (key[new] & ((1 << 40) - 1)) - shift, first[new], final[ends]


def candidates(text: np.ndarray, index: Index) -> tuple[np.ndarray, ...]:
    """(piece, start, band, shared): windows with enough shared q-grams of both sizes."""
    piece, band, first, final = _runs(text, index)
    step = index.edits[piece] + 1
    span = index.windows[piece] - SHORT_Q + 1
    sizes = final - first + span
    place = _laid(first, sizes)
    mine = _short_qgrams(index.letters)[place + np.repeat(index.starts[piece], sizes)]
    place += np.repeat(band * step, sizes)
    width = np.repeat(2 * step, sizes)
    theirs = _short_qgrams(text)
    same = np.zeros(len(place), dtype=bool)
    for shift in range(int(width.max(initial=0))):
        here = place + shift
        inside = (here >= 0) & (here < len(theirs)) & (shift < width)
        same |= inside & (theirs[np.clip(here, 0, len(theirs) - 1)] == mine)
    total = np.concatenate([[0], np.cumsum(same)])
    count = final - first + 1
    at = _laid(np.cumsum(sizes) - sizes, count)
    start = _laid(first, count)
    piece, band, span = (np.repeat(x, count) for x in (piece, band, span))
    shared = total[at + span] - total[at]
    kept = shared >= span - index.edits[piece] * SHORT_Q
    return piece[kept], start[kept], band[kept], shared[kept]


def aligned(text: np.ndarray, piece: np.ndarray, start: np.ndarray, band: np.ndarray, index: Index) -> np.ndarray:
    """Fewest edits from each window to a substring of the text within its band."""
    out = np.empty(len(piece), dtype=np.int64)
    for edits in np.unique(index.edits[piece]):
        rows = np.flatnonzero(index.edits[piece] == edits)
        step = int(edits) + 1
        width = 2 * step
        begin = band[rows] * step + start[rows]
        letters = index.starts[piece[rows]] + start[rows]
        sizes = index.windows[piece[rows]]
        cost = np.zeros((len(rows), width), dtype=np.int64)
        best = np.full(len(rows), np.iinfo(np.int64).max)
        shift = np.arange(width)
        for i in range(int(sizes.max())):
            here = begin[:, None] + i + shift
            inside = (here >= 0) & (here < len(text))
            letter = np.where(inside, text[np.clip(here, 0, len(text) - 1)], 0)
            # Windows that have ended are done: what they are compared with does not matter.
            wanted = index.letters[np.minimum(letters + i, len(index.letters) - 1)]
            wrong = ~inside | (letter != wanted[:, None])
            new = cost + wrong
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            # Letters of the text that the passage lacks, any number in a row.
            new = np.minimum.accumulate(new - shift, axis=1) + shift
            cost = new
            done = sizes == i + 1
            best[done] = cost[done].min(axis=1)
        out[rows] = best
    return out


def _verified(text: np.ndarray, starts: list[int], index: Index) -> set[tuple[int, int]]:
    """(number of the text, number of the piece) of which some window is found."""
    piece, start, band, shared = candidates(text, index)
    middle = band * (index.edits[piece] + 1) + start + index.windows[piece] // 2
    owner = np.searchsorted(starts, np.maximum(middle, 0), side="right") - 1
    pair = owner * np.int64(len(index.items)) + piece
    # The likeliest window of each text and piece first; the others if that one is none.
    order = np.lexsort((-shared, pair))
    first = np.diff(pair[order], prepend=-1) != 0
    found = np.empty(0, dtype=np.int64)
    for rows in (order[first], order[~first]):
        rows = rows[~np.isin(pair[rows], found)]
        for at in range(0, len(rows), _ALIGNED):
            part = rows[at : at + _ALIGNED]
            near = aligned(text, piece[part], start[part], band[part], index) <= index.edits[piece[part]]
            found = np.union1d(found, pair[part[near]])
    return {(int(f) // len(index.items), int(f) % len(index.items)) for f in found}


def matches(texts: list[bytes | None], index: Index) -> list[set[int]]:
    """Numbers of the pieces of which a window is found in each text."""
    found: list[set[int]] = [set() for _ in texts]
    gap = b"\n" * (PASSAGE // BYTES_PER_EDIT + 2)
    at = 0
    while at < len(texts):
        # Texts are looked through together; the gap costs more edits than there are.
        parts, starts, size = [], [], 0
        while at + len(parts) < len(texts) and (not parts or size < _JOINT):
            part = normal(texts[at + len(parts)])
            starts.append(size)
            parts.append(part)
            size += len(part) + len(gap)
        joint = np.frombuffer(gap.join(parts) + gap, dtype=np.uint8)
        for o, p in _verified(joint, starts, index):
            found[at + o].add(p)
        at += len(parts)
    return found


def _indexes(benchmark: DataFrame, block_bytes: int):
    """The benchmark's index in blocks; only one block's items are on the driver at once."""
    known = benchmark.filter("text is not null").select("item_id", "text")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // block_bytes + 1
    for i in range(n):
        block = known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else known
        rows = [(r.item_id, r.text.encode("utf-8", "replace")) for r in block.toLocalIterator()]
        index = Index.of(rows, whole)
        if index is not None:
            yield index


def items_column(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Column:
    """The item_ids of which a document holds a passage, sorted."""
    spark = docs.sparkSession
    prepare(spark)

    def one(index: Index) -> Column:
        shared = spark.sparkContext.broadcast(index)

        @F.arrow_udf("array<long>")
        def of(texts: pa.Array) -> pa.Array:
            items = shared.value.items
            found = matches(text_bytes(texts), shared.value)
            return pa.array([list({items[p] for p in f}) for f in found], type=pa.list_(pa.int64()))

        return of(F.col("text"))

    columns = [one(index) for index in _indexes(benchmark, block_bytes)]
    if not columns:
        return F.array().cast("array<long>")
    return F.sort_array(F.array_distinct(F.concat(*columns)))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a passage of the benchmark."""
    held = fresh(docs.columns, "_items")
    found = docs.withColumn(held, items_column(docs, benchmark))
    return found.filter(F.size(held) == 0).drop(held)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with the benchmark items found in it."""
    rows = docs.select("doc_id", "text")
    found = rows.withColumn("item_ids", items_column(rows, benchmark))
    return found.select(
        "doc_id",
        (F.size("item_ids") > 0).alias("contaminated"),
        F.size("item_ids").cast("long").alias("n_items"),
        "item_ids",
    )
