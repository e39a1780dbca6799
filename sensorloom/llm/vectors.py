"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A vector, padded with zeros to a power of two, is turned by three rounds of
random signs and a fast Hadamard transform; its code is the axis, with sign, it
is closest to. Codes of ``N_PARTS`` such rotations make a bucket, in each of
``N_TABLES`` tables. A vector is filed in its own bucket and also looks into the
``N_PROBES`` next likely ones, in order of how little closer its own axes are.
Vectors that meet are compared by cosine in double precision, so no link is
wrong; of pairs with a cosine of just 0.9 about 99 of 100 meet (see the tests).

Equal vectors are one node with a weight. A pair that meets several times counts
in the first table and bucket only, which both vectors' codes tell; links are
counted inside buckets and only counts and a spanning forest are given on. Full
buckets are cut into pairs of blocks.

Defined results: null, empty, zero vectors and those with null or non-finite
components have no links and are their own component; vectors of different
length never link; rows of equal vectors link with each other, whatever their
ids; an empty table gives an empty result. Nodes are told apart by 64 hash bits of the vector.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import blocks, components, prepare
from sensorloom.llm.pieces import groups, roots
from sensorloom.session import cut_lineage

MIN_COSINE = 0.9
N_TABLES = 8
N_PARTS = 3
N_PROBES = 7
SEED = 5
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, orthonormal."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def codes(
    x: np.ndarray,
    tables: int = N_TABLES,
    parts: int = N_PARTS,
    probes: int = N_PROBES,
    seed: int = SEED,
) -> np.ndarray:
    """Buckets of each row: (rows, tables, 1 + probes), its own bucket first."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng(seed)
    near = min(3, 2 * width)
    combos = np.array(list(itertools.product(range(near), repeat=parts)))
    out = np.empty((len(x), tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        cost = np.zeros((len(x), len(combos)))
        code = np.zeros((len(x), len(combos)), dtype=np.int64)
        for part in range(parts):
            turned = x
            for _ in range(3):
                turned = hadamard(turned * signs.choice([-1.0, 1.0], size=width))
            axes = np.concatenate([turned, -turned], axis=1)
            best = np.argsort(-axes, axis=1, kind="stable")[:, :near]
            height = np.take_along_axis(axes, best, axis=1)
            loss = (height[:, :1] - height) ** 2
            cost += loss[:, combos[:, part]]
            code = code * (2 * width) + best[:, combos[:, part]]
        order = np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes]
        found = np.take_along_axis(code, order, axis=1)
        # Tiny widths have fewer buckets than probes: the last one is repeated and ignored.
        out[:, t] = np.pad(found, ((0, 0), (0, 1 + probes - found.shape[1])), mode="edge")
    return out


def _hashed(tables: int, parts: int, probes: int):
    def run(batches):
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            sizes = np.array([len(v) for v in vectors])
            out = [None] * len(vectors)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = np.array([vectors[i] for i in rows], dtype=np.float64)
                found = codes(x / _norms(x), tables, parts, probes)
                for i, code in zip(rows, found.reshape(len(rows), -1)):
                    out[i] = code
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    batch.column("weight"),
                    batch.column("embedding"),
                    pa.array(out, type=pa.list_(pa.int64())),
                ],
                names=["node", "weight", "embedding", "codes"],
            )

    return run


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths, safe for components whose squares would over- or underflow."""
    scale = np.abs(x).max(axis=1, keepdims=True)
    return scale * np.sqrt(((x / scale) ** 2).sum(axis=1, keepdims=True))


def first_meeting(codes_a: np.ndarray, codes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first table, and the smallest bucket there, in which each pair meets."""
    a_found = (codes_b == codes_a[:, :, :1]).any(axis=2)
    b_found = (codes_a == codes_b[:, :, :1]).any(axis=2)
    first = (a_found | b_found).argmax(axis=1)
    rows = np.arange(len(first))
    none = np.iinfo(np.int64).max
    at_a = np.where(a_found[rows, first], codes_a[rows, first, 0], none)
    at_b = np.where(b_found[rows, first], codes_b[rows, first, 0], none)
    return first, np.minimum(at_a, at_b)


def bucket_links(x, found, looks, own, across, table, code, threshold):
    """Linked rows of one bucket for which it is the first meeting."""
    links_a, links_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    rank = np.arange(len(x))
    step = max(1, 500_000 // len(x))
    for at in range(0, len(x), step):
        rows = slice(at, at + step)
        meet = (x[rows] @ x.T >= threshold) & (rank[None, :] > rank[rows, None])
        meet &= ~(looks[rows, None] & looks[None, :])
        if across:
            meet &= own[rows, None] != own[None, :]
        a, b = np.nonzero(meet)
        a += at
        for part in range(0, len(a), 20_000):
            i, j = a[part : part + 20_000], b[part : part + 20_000]
            first, bucket = first_meeting(found[i], found[j])
            here = (first == table) & (bucket == code)
            links_a.append(i[here])
            links_b.append(j[here])
    return np.concatenate(links_a), np.concatenate(links_b)


def _verified(tables: int, threshold: float):
    key = ["size", "table", "code", "_left", "_right"]

    def run(batches):
        for group in groups(batches, key):
            size, table, code, left, right = (group[k][0].as_py() for k in key)
            n = group.num_rows
            x = group["embedding"].combine_chunks().flatten().to_numpy().astype(np.float64)
            x = x.reshape(n, size)
            x = x / _norms(x)
            found = group["codes"].combine_chunks().flatten().to_numpy().reshape(n, tables, -1)
            looks, own = group["looks"].to_numpy(), group["_own"].to_numpy()
            a, b = bucket_links(x, found, looks, own, left != right, table, code, threshold)
            if not len(a):
                continue
            weight = group["weight"].to_numpy()
            counts = np.bincount(a, weights=weight[b], minlength=n)
            counts += np.bincount(b, weights=weight[a], minlength=n)
            root = roots(n, a, b)
            rows = np.flatnonzero(counts)
            node = group["node"].to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(node[rows]),
                    pa.array(node[root[rows]]),
                    pa.array(counts[rows].astype(np.int64)),
                ],
                names=["a", "b", "links"],
            )

    return run


def usable(embedding) -> F.Column:
    """Whether a vector can link at all."""
    finite = F.forall(
        embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def near_duplicates(
    vectors: DataFrame,
    threshold: float = MIN_COSINE,
    tables: int = N_TABLES,
    parts: int = N_PARTS,
    probes: int = N_PROBES,
    block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    prepare(vectors.sparkSession)
    rows = vectors.select("vec_id", "embedding", usable(F.col("embedding")).alias("_ok"))
    # Zero has two signs; both are the same component of a vector.
    rows = rows.withColumn(
        "embedding",
        F.when(F.col("_ok"), F.transform("embedding", lambda v: F.when(v == 0, 0.0).otherwise(v.cast("double")))),
    )
    rows = rows.withColumn("node", F.when(F.col("_ok"), F.xxhash64("embedding"))).drop("_ok")
    nodes = rows.filter("node is not null").groupBy("node").agg(
        F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding")
    )
    nodes = nodes.mapInArrow(
        _hashed(tables, parts, probes),
        "node long, weight long, embedding array<double>, codes array<long>",
    )
    nodes = cut_lineage(nodes, "vectors")
    each = 1 + probes
    filed = nodes.select(
        "node", F.size("embedding").cast("long").alias("size"), F.posexplode("codes").alias("at", "code")
    )
    filed = filed.select(
        "size",
        F.expr(f"cast(at div {each} as long)").alias("table"),
        "code",
        "node",
        (F.col("at") % each > 0).alias("looks"),
    )
    # A repeated last probe of a short vector is one meeting.
    filed = filed.groupBy("size", "table", "code", "node").agg(F.every("looks").alias("looks")) if (
        parts * 3 < each
    ) else filed
    met = blocks(filed, ["size", "table", "code"], ["node"], block, needs=~F.every("looks"))
    key = ["size", "table", "code", "_left", "_right"]
    full = met.join(nodes, "node").repartition(*key).sortWithinPartitions(*key)
    found = full.mapInArrow(_verified(tables, threshold), "a long, b long, links long")
    found = cut_lineage(found, "vector-links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(found.select("a", "b"), "vector-components")
    ids = rows.filter("node is not null").groupBy("node").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight")
    )
    ids = ids.join(counts, "node", "left").join(joined, "node", "left")
    ids = ids.withColumn("root", F.coalesce("root", "node"))
    ids = cut_lineage(ids, "vector-nodes")
    least = ids.groupBy("root").agg(F.min("first").alias("least"))
    ids = ids.join(least, "root").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "least"
    )
    # Rows that cannot link have no node; a key of their own keeps them apart.
    rows = rows.select("vec_id", "node", F.coalesce("node", F.xxhash64("vec_id")).alias("_key"))
    result = rows.join(ids.withColumnRenamed("node", "_node"), (F.col("_key") == F.col("_node")), "left")
    own = F.col("node").isNull()
    component = F.when(own, F.col("vec_id")).otherwise(F.col("least"))
    return result.select(
        "vec_id",
        F.when(own, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
