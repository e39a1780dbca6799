"""Helpers for functions that run in tasks, over Arrow batches and numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Vectors added up by one task.
FAN = 32
VECTORS = "piece int, vector binary"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_bytes(texts: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return texts.cast(kind).to_pylist()


def shingle_bounds(text: bytes, n_words: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text, lower-cased and joined by one space, and where shingles begin and end."""
    raw = np.frombuffer(text.lower(), dtype=np.uint8)
    space = _SPACE[raw]
    # A space stays where a word ends and another one follows somewhere.
    ends_word = space.copy()
    ends_word[1:] &= ~space[:-1]
    ends_word[:1] = False
    kept = np.where(space, 32, raw)[~space | ends_word]
    if len(kept) and kept[-1] == 32:
        kept = kept[:-1]
    if not len(kept):
        return b"", np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(kept == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(kept)]])
    if len(starts) >= n_words:
        starts, ends = starts[: len(starts) - n_words + 1], ends[n_words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return kept.astype(np.uint8).tobytes(), starts, ends


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Rows with equal ``key`` together, from batches sorted by it.

    Keys are whole numbers. At most one group and one batch are held; groups of
    one row are left out.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in key])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        starts = np.concatenate([[0], cuts])
        ends = np.concatenate([cuts, [batch.num_rows]])
        first = tuple(keys[:, 0])
        if last is not None and first != last:
            yield from _whole(held)
            held = []
        if len(starts) > 1:
            held.append(batch.slice(0, int(ends[0])))
            yield from _whole(held)
            held = []
            for i in np.flatnonzero(ends[1:-1] - starts[1:-1] > 1) + 1:
                yield pa.Table.from_batches([batch.slice(int(starts[i]), int(ends[i] - starts[i]))])
        held.append(batch.slice(int(starts[-1]), int(ends[-1] - starts[-1])))
        last = tuple(keys[:, -1])
    yield from _whole(held)


def _whole(held: list[pa.RecordBatch]) -> Iterator[pa.Table]:
    if sum(b.num_rows for b in held) > 1:
        yield pa.Table.from_batches(held).combine_chunks()


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and links a-b the smallest node each one is joined to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each ``piece``, from batches sorted by it; one piece and one batch are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        piece = batch.column("piece").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                if held and held[-1].column("piece")[0].as_py() != piece[start]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def vector_row(piece: int, vector: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([piece], pa.int32()), pa.array([vector.astype("<f8").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["piece", "vector"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, first = None, None
    for batch in batches:
        for piece, raw in zip(batch.column("piece").to_pylist(), batch.column("vector").to_pylist()):
            vector = np.frombuffer(raw, dtype="<f8")
            total, first = (vector, piece) if total is None else (total + vector, first)
    if total is not None:
        yield vector_row(first, total)


def summed(vectors: DataFrame, n: int) -> np.ndarray:
    """The sum of the vectors of ``n`` pieces, made by tasks of ``FAN`` each; one vector reaches the driver."""
    while n > 1:
        n = -(-n // FAN)
        vectors = vectors.repartition(n, F.pmod("piece", F.lit(n))).sortWithinPartitions("piece")
        vectors = vectors.mapInArrow(_added, VECTORS)
    return np.frombuffer(vectors.collect()[0]["vector"], dtype="<f8")
