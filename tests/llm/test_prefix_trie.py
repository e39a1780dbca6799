"""The prefix trie against plain prefixes, its SQL, and radix trees against sorted keys."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorloom.llm import oracles, prefix_trie, queries, radix

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The digest's rows, from the prefixes of all rebuilt conversations."""
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(turns)] for c, turns in own.items()}
    members, ends, children = {}, {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        # The remainder has the sign of c, as in SQL.
        turns = (*own.get(c - int(math.fmod(c, 5)), [])[:h], *turns[h:])
        ends.setdefault(turns, []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
            if d:
                children.setdefault(turns[: d - 1], set()).add(turns[:d])
    leaves, saved = Counter(), Counter()
    for node, convs in members.items():
        size = len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(convs) - 1) * size
    return sorted(
        (
            min(convs), len(node), min(members[node[:-1]]) if node else -1, len(convs), len(children.get(node, ())),
            leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends.get(node, ())))).encode()).hexdigest(),
        )
        for node, convs in members.items()
    )


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df):
    assert df.columns == NAMES
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def test_query_equals_plain_prefixes(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert found(queries.all_queries()["op11_prefix_trie"](spark, SF)) == plain(rows)


def test_sql_equals_plain_prefixes():
    engine = duckdb.connect()
    engine.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    rows = engine.sql("SELECT * FROM conversations").fetchall()
    got = engine.sql(oracles.ORACLES["op11_prefix_trie"])
    assert sorted(got.columns) == sorted(NAMES)
    got = [tuple(-1 if v is None else v for v in r) for r in got.select(", ".join(NAMES)).fetchall()]
    assert sorted(got) == plain(rows)


@pytest.fixture(scope="module")
def odd():
    long = "word " * 40_000
    rows = [
        (0, None, None, None), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 2, "user", ""), (0, 9, "system", "é" * 9),
        (1, 0, "user", "only"), (2, 5, "user", "a"), (None, 0, "user", "nobody"), (7, -3, None, long), (7, 0, "u", None),
        (-6, 0, "user", "below zero"), (-10, 0, "user", "base"), (11, 1, "user", "a"), (11, 2, "user:a", ""), (12, 1, "user", ":a"),
    ]
    # Conversations that branch at every depth, a hot one that many repeat, and a long one.
    for c in range(20, 140):
        rows += [(c, i, "user" if i % 2 else "assistant", f"{i}" if i < c % 13 else f"{c % 17}-{i}") for i in range(c % 15)]
    for c in range(200, 300):
        rows += [(c, i, "user", f"the same {i}") for i in range(6)]
    return rows + [(400, i, "user", f"long {i % 7}") for i in range(900)]


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 600}, {"chunk_bytes": 900, "block": 4}, {"block": 1}])
def test_chunks_and_blocks(spark, odd, sizes):
    rows = odd if sizes.get("block", 9999) > 9 else [r for r in odd if r[0] != 400] + [(400, i, "user", "x") for i in range(20)]
    if sizes.get("block") == 1:
        rows = [r for r in rows if r[0] is None or r[0] < 60 and (r[1] or 0) < 4]
    made = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("place", "key", "_at", "unit")})
    assert found(prefix_trie.digest(made, **sizes)) == plain(rows)


def test_no_conversations(spark):
    assert not prefix_trie.digest(spark.createDataFrame([], SCHEMA)).collect()
    assert not prefix_trie.digest(spark.createDataFrame([(None, 1, "user", "a")], SCHEMA)).collect()


def test_node_ids(spark):
    rows = [(c, i, f"{i:08x}" * 4) for c in range(4) for i in range(c)]
    nodes = prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, place long, turn_id string")).collect()
    ids = {n.node_id for n in nodes}
    assert len(ids) == 4 and {n.parent_id for n in nodes} - {None} <= ids


KEYS = st.lists(st.binary(max_size=6) | st.binary(min_size=2, max_size=2), max_size=400, unique=True)


def walked(node, path=b""):
    path += node.prefix
    yield from ((path, v) for v in node.values)
    for label, below in node.below():
        yield from walked(below, path + bytes([label]))


@given(KEYS)
@settings(max_examples=100, deadline=None)
def test_radix_tree_keeps_all_keys_in_order(keys):
    tree = radix.Tree()
    for key in keys:
        tree.add(key, len(key))
    assert list(walked(tree.root)) == [(k, len(k)) for k in sorted(keys)]


def test_layouts_grow():
    tree, kinds = radix.Tree(), []
    for i in range(256):
        tree.add(bytes([i, 1]), i)
        if tree.root.children is not None:
            kinds.append(type(tree.root.children))
    assert list(dict.fromkeys(kinds)) == [radix.Layout4, radix.Layout16, radix.Layout48, radix.Layout256]
    assert [kinds.index(k) for k in dict.fromkeys(kinds)] == [0, 4, 16, 48]
    assert [v for _, v in walked(tree.root)] == list(range(256))
