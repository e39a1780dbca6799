"""Stupid-backoff language-model scores from n-gram count tables.

Documents are dealt to blocks of about ``BLOCK_BYTES`` by a hash. A block gives
its different n-grams with their counts, as 60-bit hashes: 12 bits name the bucket,
16 and 32 bits travel as lists. The count table is partitioned by the bucket,
sums every n-gram over all blocks, and returns the sums that
a block cannot know from itself. A block then scores its documents. An n-gram
has one row per block at most, however frequent it is, so no key is hot, and
what is shuffled and summed grows with the text.

The score of a word is count(n-gram) / count(context), or ``BACKOFF`` times the score
with one word less of context if that n-gram was not seen; a single word scores
count / all words. A document is scored by the counts of all other documents: its
own are taken off, else each text would vouch for itself. A word no other
document has counts as seen once. Words are lower-cased (A-Z).

Defined results: a null or wordless text has 0 words, sum 0 and a null mean; with no
other words the divisor is 1; equal texts under different ids support each other;
rows are scored one by one, so repeated rows too; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import prepare
from sensorloom.llm.pieces import text_bytes

ORDER = 2
BACKOFF = 0.4
BLOCK_BYTES = 7 << 20
BUCKET_BITS = 12
# A total and the place it belongs to within its bucket and block are one number.
_PLACES = 1 << 20
_LONG = 64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(17).integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
# The lowest four bits of a hash are not used: what is left of a bucket's
# n-grams fits a short and an int.
_SPARE = np.uint64(4)
_USED = np.uint64(0xFFFFFFFFFFFFFFF0)
_EMPTY = np.uint64(0x632BE59BD9B4E010)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the texts, and the text it is from."""
    joined = b"\n".join(t or b"" for t in texts).lower()
    raw = np.frombuffer(joined, dtype=np.uint8)
    space = _SPACE[raw]
    width = np.int32 if len(raw) < 1 << 31 else np.int64
    changes = space != np.concatenate([[True], space[:-1]])
    edge = np.flatnonzero(changes).astype(width)
    if len(edge) % 2:
        edge = np.append(edge, width(len(raw)))
    starts, sizes = edge[0::2], edge[1::2] - edge[0::2]
    order = np.argsort(-np.minimum(sizes, _LONG).astype(np.int8), kind="stable").astype(width)
    first, sizes = starts[order], sizes[order]
    values = np.zeros(len(first), dtype=np.uint64)
    longest = min(_LONG, int(sizes[0])) if len(sizes) else 0
    # Words sorted by size: the first so many have a k-th byte.
    having = np.searchsorted(-np.minimum(sizes, _LONG), -np.arange(longest), side="left")
    for k, n in enumerate(having):
        values[:n] = values[:n] * _STEP + _BYTES[raw[first[:n] + k]]
    values = _mixed(values + sizes.astype(np.uint64))
    for i in range(int(np.searchsorted(-sizes, -_LONG, side="left"))):
        values[i] = xxhash.xxh64_intdigest(joined[first[i] : first[i] + sizes[i]], 1)
    hashes = np.empty_like(values)
    hashes[order] = values
    begins = np.cumsum([0] + [len(t or b"") + 1 for t in texts])[:-1].astype(width)
    return hashes, (np.searchsorted(begins, starts, side="right") - 1).astype(np.int32)


def grams(hashes: np.ndarray, owner: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the hash of the n-gram ending at each word, and whether there is one."""
    out = [(_mixed(hashes + np.uint64(1)) & _USED, np.ones(len(hashes), dtype=bool))]
    for n in range(2, order + 1):
        before, had = out[-1]
        gram = np.zeros_like(hashes)
        gram[1:] = _mixed(before[:-1] * _STEP + hashes[1:] + np.uint64(n)) & _USED
        has = np.zeros(len(hashes), dtype=bool)
        has[1:] = had[:-1] & (owner[1:] == owner[:-1])
        out.append((gram, has))
    return out


def _distinct(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a block, sorted, and their counts."""
    hashes, owner = words(texts)
    every = np.sort(np.concatenate([g[has] for g, has in grams(hashes, owner, order)]))
    first = _starts(every)
    # The n-gram of no words: as many as there are words.
    unique = every[first]
    counts = np.diff(np.append(first, len(every)))
    at = int(np.searchsorted(unique, _EMPTY))
    return np.insert(unique, at, _EMPTY), np.insert(counts, at, len(hashes))


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(values):
        return np.empty(0, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])


def _bucket_starts(unique: np.ndarray) -> np.ndarray:
    shift = np.uint64(64 - BUCKET_BITS)
    return np.searchsorted(unique >> shift, np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64))


def _counted(order: int):
    def run(table: pa.Table) -> pa.Table:
        unique, counts = _distinct(text_bytes(table["text"].combine_chunks()), order)
        starts = _bucket_starts(unique)
        full = np.flatnonzero(starts[1:] > starts[:-1])
        offsets = pa.array(np.append(starts[full], len(unique)), type=pa.int32())
        low = (unique >> _SPARE).astype(np.uint32).view(np.int32)
        high = (unique >> (_SPARE + np.uint64(32))).astype(np.uint16).view(np.int16)
        return pa.table(
            {
                "block": pa.array(np.full(len(full), table["block"][0].as_py()), type=pa.int64()),
                "bucket": pa.array(full, type=pa.int32()),
                "high": pa.ListArray.from_arrays(offsets, pa.array(high)),
                "low": pa.ListArray.from_arrays(offsets, pa.array(low)),
                "counts": pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
            }
        )

    return run


def log_scores(owner, found, unique, totals, n_texts, backoff, own_off=True):
    """Sum of log10 scores of each text, and its words."""
    n_words = np.bincount(owner, minlength=n_texts)
    seen = []
    for gram, has in found:
        # Words are in the order of their texts, and so are equal n-grams once sorted.
        order = np.argsort(gram, kind="stable")
        order = order[has[order]]
        sorted_grams, sorted_owners = gram[order], owner[order]
        first = _starts(sorted_grams)
        sizes = np.diff(np.append(first, len(order)))
        count = np.repeat(totals[np.searchsorted(unique, sorted_grams[first])], sizes)
        if own_off and len(order):
            other = sorted_owners[1:] != sorted_owners[:-1]
            other |= sorted_grams[1:] != sorted_grams[:-1]
            first = np.concatenate([[0], np.flatnonzero(other) + 1])
            sizes = np.diff(np.append(first, len(order)))
            count = count - np.repeat(sizes, sizes)
        whole = np.zeros(len(owner), dtype=np.int64)
        whole[order] = count
        seen.append(whole)
    everything = totals[np.searchsorted(unique, _EMPTY)]
    everything = np.maximum(1, everything - (n_words[owner] if own_off else 0))
    score = np.log10(np.maximum(seen[0], 1) / everything)
    for n in range(1, len(found)):
        has = found[n][1]
        context = np.zeros(len(owner), dtype=np.int64)
        context[1:] = seen[n - 1][:-1]
        used = has & (seen[n] > 0)
        longer = np.log10(np.maximum(seen[n], 1) / np.maximum(context, 1))
        score = np.where(used, longer, np.where(has, np.log10(backoff) + score, score))
    return np.bincount(owner, weights=score, minlength=n_texts), n_words


def _scored(order: int, backoff: float, own_off: bool):
    def run(docs: pa.Table, sums: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SCORES.empty_table()
        texts = text_bytes(docs["text"].combine_chunks())
        unique, totals = _distinct(texts, order)
        totals = totals.astype(np.int64) if own_off else np.zeros(len(unique), dtype=np.int64)
        starts = _bucket_starts(unique)
        if sums.num_rows:
            lists = sums["found"].combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            news = lists.flatten().to_numpy()
            at = np.repeat(starts[sums["bucket"].to_numpy()], sizes) + news % _PLACES
            totals[at] = news // _PLACES
        hashes, owner = words(texts)
        found = grams(hashes, owner, order)
        value, n_words = log_scores(owner, found, unique, totals, docs.num_rows, backoff, own_off)
        return pa.table({"doc_id": docs["doc_id"], "n_words": n_words, "log_score": value}, _SCORES)

    return run


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])


def _in_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    size = F.sum(F.octet_length("text"))
    n = (docs.select(size).first()[0] or 0) // block_bytes + 1
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))
    return docs.select("doc_id", "text", block.alias("block"))


def score(
    docs: DataFrame,
    corpus: DataFrame | None = None,
    order: int = ORDER,
    backoff: float = BACKOFF,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, log_score, mean_score) of every document.

    Counts are those of ``corpus``; without one they are those of all other
    documents.
    """
    prepare(docs.sparkSession)
    schema = "block long, bucket int, high array<short>, low array<int>, counts array<int>"
    blocked = _in_blocks(docs, block_bytes)
    counted = blocked.groupBy("block").applyInArrow(_counted(order), schema)
    given = F.lit(0) if corpus is not None else F.col("count")
    rows = counted.withColumn("asks", F.lit(True))
    if corpus is not None:
        other = _in_blocks(corpus, block_bytes).groupBy("block")
        other = other.applyInArrow(_counted(order), schema)
        rows = rows.unionByName(other.withColumn("asks", F.lit(False)))
        given = F.when(F.col("asks"), 0).otherwise(F.col("count"))
    # N-grams travel as lists and are exploded where their bucket is.
    rows = rows.repartition("bucket").select(
        "block", "bucket", "asks", F.posexplode(F.arrays_zip("high", "low", "counts")).alias("at", "g")
    )
    gram = F.shiftleft(F.col("g.high").cast("long"), 32) + F.col("g.low")
    rows = rows.select(
        "block", "bucket", "asks", "at", gram.alias("gram"), F.col("g.counts").cast("long").alias("count")
    )
    total = F.expr("sum(given) over (partition by bucket, gram)")
    rows = rows.withColumn("given", given).withColumn("total", total)
    # A block knows what only it has.
    news = rows.filter("asks and total != given")
    sums = news.groupBy("bucket", "block").agg(
        F.collect_list(F.col("total") * _PLACES + F.col("at")).alias("found")
    )
    scored = (
        blocked.groupBy("block")
        .cogroup(sums.groupBy("block"))
        .applyInArrow(
            _scored(order, backoff, corpus is None), "doc_id long, n_words long, log_score double"
        )
    )
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.withColumn("mean_score", mean)


def digest(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per document, to six digits: sums depend on their order in the last ones."""
    return score(docs, order=order).select(
        "doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_score", 6).alias("mean_score")
    )
