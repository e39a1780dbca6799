"""The text operators against brute force, and on odd rows."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from sensorloom.llm import (
    common,
    decontam,
    langid,
    mixing,
    near_texts,
    ngram_lm,
    pii,
    quality,
    queries,
    sharding,
    simhash,
    token_files,
    vectors,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows, clashing extra columns."""
    long = "word another " * 40_000
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, "a", 0),
        (3, " \t\n", "en", None, 3),
        (4, "the same text as the other one here", "en", "a", 1),
        (5, "the same text as the other one here", "fr", "b", 1),
        (5, "the same text as the other one here", "fr", "b", 1),
        (None, "no id but words enough for a shingle", None, None, None),
        (None, None, None, None, None),
        (6, long, "en", "b", len(long)),
        (7, "mail a@b.co or +1 (988) 555-2485, 4111 1111 1111 1111 at 10.0.0.1", "en", "c", 9),
        (8, "123 !?", "en", "c", 6),
    ]
    made = spark.createDataFrame(rows, DOCS)
    return made.withColumns(
        {n: F.lit("x") for n in ("shard", "slot", "score", "_piece", "_items", "_text", "n_total", "key")}
    )


def empty(df):
    return df.limit(0)


def smallest(n, linked):
    """The smallest member of each one's component."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- shared --------------------------------------------------------------


def test_components(spark):
    links = [(i, i + 1) for i in range(40, 60)] + [(3, 99), (99, 7), (7, 7), (12, 3)]
    found = common.components(spark.createDataFrame(links, "a long, b long")).collect()
    expected = smallest(100, links)
    assert {r.node: r.root for r in found} == {
        i: expected[i] for i in {n for a, b in links if a != b for n in (a, b)}
    }
    assert not common.components(spark.createDataFrame([], "a long, b long")).collect()


def test_blocks_let_every_two_rows_meet_once(spark):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 1), (3, 4)) for i in range(n)], "k int, i int")
    met = common.blocks(rows, ["k"], ["i"], 8, needs=F.lit(True) & (F.count("i") > 0)).collect()
    groups = {}
    for r in met:
        groups.setdefault((r.k, r._left, r._right), []).append((r.i, r._own))
    pairs = [
        (k, *sorted((a[0], b[0])))
        for (k, left, right), g in groups.items()
        for n, a in enumerate(g)
        for b in g[:n]
        if left == right or a[1] != b[1]
    ]
    assert sorted(pairs) == sorted((k, i, j) for k, n in ((1, 50), (3, 4)) for j in range(n) for i in range(j))


# --- sharding and mixing -------------------------------------------------


@pytest.mark.parametrize("name", ["op1_sharding", "op9_mixing", "op4_lm_score"])
def test_queries_equal_their_sql(spark, name):
    engine = duckdb.connect()
    engine.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.all_queries()[name](spark, SF)
    columns = ", ".join(sorted(got.columns))
    expected = engine.sql(f"SELECT {columns} FROM ({queries.all_oracles()[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*sorted(got.columns)).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def test_shards_are_even_and_follow_the_mixture(spark, docs):
    rows = sharding.shard_rows(docs, 8).toPandas()
    sizes = rows.groupby("shard").size()
    assert len(rows) == 200 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    share = rows.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (share.max(axis=1) - share.min(axis=1)).max() <= 2


def test_sharding_odd_rows(spark, odd):
    rows = sharding.shard_rows(odd, 3)
    assert rows.columns[-2:] == ["shard_", "slot_"]
    assert sorted(r.slot_ * 3 + r.shard_ for r in rows.collect()) == sorted(
        s * 3 + k for k, n in enumerate((4, 4, 3)) for s in range(n)
    )
    assert sharding.digest(odd).count() == 11
    assert sharding.digest(empty(odd)).count() == 0
    assert sharding.shard_rows(empty(odd)).count() == 0


def test_mixing_takes_what_it_says(spark, docs):
    plan = mixing.digest(docs).toPandas()
    assert (plan.taken <= 2 * plan["size"]).all()
    by = docs.select("doc_id", "source").toPandas().merge(plan, on="doc_id").groupby("source")
    most = by["size"].max()
    assert ((by.taken.sum() - by.target.max()).abs() <= most).all()
    mixed = mixing.mix(docs, n_shards=4, block_words=2000)
    counts = mixed.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    taken = plan.set_index("doc_id")
    words = taken["size"] * counts.reindex(taken.index).fillna(0)
    assert (words == taken.taken).all()
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, mixing.mix(docs, 4, 2000).collect()))


def test_tree_splits_blocks_evenly(spark):
    blocks = spark.createDataFrame([(f"s{i % 3}", 1, i) for i in range(103)], "_source string, turn int, block long")
    for shards in (1, 3, 8):
        dealt = mixing._tree(blocks, shards, 1).toPandas()
        sizes = dealt.groupby("shard").size()
        assert len(dealt) == 103 and len(sizes) == shards and sizes.max() - sizes.min() <= 2


def test_mixing_odd_rows(spark, odd):
    assert mixing.digest(odd).filter("taken > 2 * size or taken < 0").count() == 0
    assert mixing.digest(odd).count() == 11
    mixed = mixing.mix(odd)
    assert mixed.columns[-2:] == ["shard_", "mix_order"]
    assert mixed.groupBy(*odd.columns).count().filter("count > 4").count() == 0
    assert mixing.mix(empty(odd)).count() == 0


# --- near duplicates -----------------------------------------------------


def brute_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÉ \t\n\x0b\x1c.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == brute_fingerprint(text)


def test_chains_find_every_link(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base.tolist():
        for _ in range(12):
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                b ^= 1 << int(bit)
            prints.add(b)
    prints = sorted(prints, key=lambda p: p - (1 << 64) if p >> 63 else p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    rows = simhash.classes(frame).collect()
    linked = [
        (i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4
    ]
    expected = smallest(len(prints), linked)
    assert {r.fingerprint: r._root for r in rows} == {p: signed[expected[i]] for i, p in enumerate(signed)}


def test_full_keys_are_cut_into_blocks(spark):
    prints = [(i << 40) | 5 for i in range(64)]
    frame = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    links = simhash.links(frame, block=8)
    found = common.components(links.select("a", "b")).collect()
    assert len(found) == 64 and {r.root for r in found} == {5}


def test_simhash_query(spark, docs):
    rows = {r.doc_id: r for r in queries.all_queries()["op3_simhash"](spark, SF).collect()}
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = [brute_fingerprint(t) for _, t in texts]
    linked = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = smallest(len(prints), linked)
    for i, (doc_id, _) in enumerate(texts):
        assert rows[doc_id].fingerprint == f"{prints[i]:016x}"
        assert rows[doc_id].component_id == texts[root[i]][0]


def test_simhash_odd_rows(spark, odd):
    rows = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.digest(odd).collect()}
    zero = "0" * 16
    assert rows[(2, zero)] == rows[(3, zero)] == rows[(None, zero)] == 1
    assert {c for (i, _), c in rows.items() if i in (4, 5)} == {4}
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i) == [1, 4, 6, 7, 8] and ids.count(None) == 1
    assert simhash.deduplicate(empty(odd)).count() == 0 and simhash.digest(empty(odd)).count() == 0


def shingle_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(rng, words, edits):
    """Some words replaced, from which the similarity follows."""
    words = list(words)
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def test_deduplicate_joins_similar_texts(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(40):
        words = rng.choice(vocabulary, rng.integers(60, 400))
        rows += [" ".join(words)] + [edited(rng, words, e) for e in (1, 2, 3, 5, 8, 30)]
    # A dense group of different texts, and a passage many texts share.
    dense = rng.choice(vocabulary, 300)
    rows += [edited(rng, dense, 1) for _ in range(40)]
    rows += [" ".join([*dense[:60], *rng.choice(vocabulary, 200)]) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicate(frame).collect()}
    sets = [shingle_set(t) for t in rows]
    prints = [brute_fingerprint(t) for t in rows]
    linked = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if similarity(sets[i], sets[j]) >= 0.8 or (prints[i] ^ prints[j]).bit_count() <= 4
    ]
    assert len(linked) > 800
    assert kept == set(smallest(len(rows), linked))


def test_near_pairs_in_blocks(spark):
    rng = np.random.default_rng(4)
    words = rng.choice([f"w{i}" for i in range(500)], 200)
    texts = [edited(rng, words, 2) for _ in range(30)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sketches = near_texts.with_sketch(frame).withColumn("fingerprint", F.lit(0).cast("long")).drop("text").cache()
    found = common.components(near_texts.links(sketches, sketches, ["doc_id"], block=4)).collect()
    sets = [shingle_set(t) for t in texts]
    linked = [(i, j) for i in range(30) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    groups = len(set(smallest(30, linked)))
    alone = 30 - len({i for pair in linked for i in pair})
    assert len({r.root for r in found}) + alone == groups and len(found) + alone == 30


def test_deduplicate_joins_texts_that_differ_in_repeats(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for rule in "=-*_#~":
        words = rng.choice(vocabulary, 1000).tolist()
        lines = [rng.choice(vocabulary, 12).tolist() for _ in range(2)]
        rows += [words, words[:500] + [rule] * 300 + words[500:], words + lines[0] * 20, words + lines[1] * 20]
    rows = [" ".join(r) for r in rows]
    sets = [shingle_set(t) for t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    prints = [brute_fingerprint(t) for t in rows]
    assert max((prints[i] ^ prints[j]).bit_count() for i, j in linked) > 24
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicate(frame).collect()}
    assert kept == set(smallest(len(rows), linked)) == set(range(0, 24, 4))


def test_vector_links(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 24))
    rows = [v + rng.normal(size=24) * s for v in base for s in (0, 0.05, 0.1, 0.3)]
    rows += [rows[0], rows[0] * 2, np.zeros(24), np.full(24, np.nan)]
    table = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    table += [(900, None), (901, []), (902, [1.0, None]), (903, [1.0]), (904, [-1.0]), (None, table[4][1])]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vectors.near_duplicates(frame, block=16).collect()}
    x = np.array([v for _, v in table[:122]] + [table[4][1]])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    root = smallest(len(x), zip(*np.nonzero(np.tril(near))))
    exact = 0
    for i in range(122):
        assert got[i].n_links <= near[i].sum()
        exact += got[i].n_links == near[i].sum()
        assert got[i].component_id == root[i] and got[i].kept == (root[i] == i)
    assert exact >= 115
    for i in (122, 123, 900, 901, 902, 903, 904):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_vector_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = vectors.codes(x), vectors.codes(0.9 * x + np.sqrt(1 - 0.81) * z)
    met = (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)
    assert met.any(axis=1).mean() >= 0.97


# --- models --------------------------------------------------------------


def test_language(spark, docs, odd):
    rows = langid.digest(docs).join(docs, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert len(held) and (held.lang_pred == held.lang).mean() >= 0.95
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert langid.keep_known(docs).count() >= 198
    found = langid.digest(odd).toPandas()
    assert len(found) == 11 and found.score.between(0, 1).all()
    undecided = found[found.lang_pred == "und"]
    assert sorted(undecided.doc_id.dropna()) == [1, 2, 3, 8] and (undecided.score == 0).all()
    assert set(langid.digest(odd.withColumn("lang", F.lit(None).cast("string"))).toPandas().lang_pred) == {"und"}
    assert langid.digest(empty(odd)).count() == 0


def test_quality(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.digest(docs, labels).join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() >= 0.97
    marks = spark.createDataFrame(
        [(4, 1), (4, 0), (5, 1), (None, 0), (6, None), (7, 0), (8, 0), (8, 0)], "doc_id long, quality int"
    )
    found = quality.digest(odd, marks).toPandas()
    assert len(found) == 11 and found.score.between(0, 1).all()
    assert (quality.digest(odd, marks.limit(0)).toPandas().score == 0.5).all()
    assert quality.digest(empty(odd), marks).count() == 0


# --- personal data -------------------------------------------------------

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute_spans(text):
    def right(kind, s):
        digits = [int(c) for c in s if c.isdigit()]
        if kind == 1:
            return all(int(p) <= 255 for p in s.split("."))
        if kind == 2:
            back = digits[::-1]
            total = sum(back[0::2]) + sum(d * 2 - 9 * (d > 4) for d in back[1::2])
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    return sorted(
        (m.start(), k, m.end())
        for k, p in enumerate(PATTERNS)
        for m in re.finditer(p, text, re.A)
        if right(k, m.group())
    )


def test_base_spans(spark):
    rng = np.random.default_rng(3)
    pieces = ["a@b.co", "@", ".", "é😀", " ", "-", "1.2.3.4", "300.1.1.1", "4111111111111111", "4111 1111-1111 1111",
              "+1 (988) 555-2485", "+", "7", "12", "x_y", "a@b.c-d@e.f", "(", ")", "0255.1.1.1", "\n"]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 12))) for _ in range(400)]
    texts += ["5" * 30_000, "a" * 50_000, "1-" * 20_000, "+1" * 1000, "1." * 20_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.with_spans(frame, None, "base", "spans").select("doc_id", "base").collect()
    for r in rows:
        assert [(s.start, s.kind, s.end) for s in r.base] == [tuple(x) for x in brute_spans(texts[r.doc_id])]


def test_added_spans_and_redaction(spark, odd):
    trees = [(7, 0.5, -2.0, 2.0)]
    scorer = pii.Scorer(trees, [1.0], {0: 0.6})
    frame = spark.createDataFrame([(1, "write to bob (at) mail (dot) org or a@b.co"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.redact(frame, scorer).collect()}
    assert out == {1: "write to [EMAIL] or [EMAIL]", 2: None}
    found = {r.doc_id: r for r in pii.digest(odd).collect()}
    assert found[7].spans.split(",")[0] == "email:5:11" and found[7].n_card == 1
    assert found[1].base_sha256 == hashlib.sha256(b"").hexdigest() and found[1].spans == ""
    assert pii.digest(odd).count() == 11 and pii.digest(empty(odd)).count() == 0


def test_trees_as_expressions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    scorer = pii.train(docs)
    assert len(scorer.trees) == pii.TREES and all(0.5 <= t <= 1 for t in scorer.thresholds.values())


# --- scores, benchmark, token files --------------------------------------


def test_language_model_blocks_do_not_matter(spark, docs, odd):
    one = ngram_lm.digest(docs).toPandas().sort_values("doc_id")
    many = ngram_lm.score(docs, block_bytes=20_000).toPandas().sort_values("doc_id")
    assert np.allclose(one.log_score, many.log_score, atol=1e-5)
    three = ngram_lm.score(docs.limit(20), corpus=docs, order=3).toPandas()
    assert len(three) == 20 and (three.log_score < 0).all()
    found = {r.doc_id: r for r in ngram_lm.digest(odd).collect()}
    assert found[1].n_words == 0 and found[1].log_score == 0 and found[1].mean_score is None
    assert found[6].n_words == 80_000
    assert ngram_lm.digest(empty(odd)).count() == 0


def test_trigram_scores_equal_their_sql(spark):
    engine = duckdb.connect()
    engine.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ["doc_id", "n_words", "log_score", "mean_score"]
    sql = queries.all_oracles()["op4_lm_score_trigrams"]
    expected = engine.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    rows = [tuple(r) for r in queries.all_queries()["op4_lm_score_trigrams"](spark, SF).select(*names).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def fewest_edits(passage, text):
    before = np.zeros(len(text) + 1, int)
    raw, shift = np.frombuffer(text, dtype=np.uint8), np.arange(len(text) + 1)
    for i, letter in enumerate(passage):
        now = np.full(len(text) + 1, i + 1)
        now[1:] = np.minimum(before[:-1] + (raw != letter), before[1:] + 1)
        before = np.minimum.accumulate(now - shift) + shift
    return before.min()


def test_passages_within_the_edit_budget(spark, docs):
    items = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:10]
    index = decontam.Index.of([*items, (77, None), (78, b"too short")])
    rng = np.random.default_rng(4)
    texts = [r.text.encode() for r in docs.limit(120).collect()]
    hits = 0
    planted = []
    for n, text in enumerate(texts):
        item = decontam.normal(items[n % 10][1])
        start = rng.integers(0, max(1, len(item) - 80))
        part = bytearray(item[start : start + int(rng.integers(50, 100))])
        for _ in range(rng.integers(0, 7)):
            at, kind = rng.integers(len(part)), rng.integers(3)
            part[at : at + (kind != 2)] = b"" if kind == 1 else bytes([97 + int(rng.integers(26))])
        planted.append(text[:200] + b" " + bytes(part) + b" " + text[200:300])
    for text, found in zip(planted, decontam.matches(planted, index)):
        plain = decontam.normal(text)
        expected = {
            p
            for p in range(len(index.sizes))
            if fewest_edits(bytes(index.texts[p][: index.sizes[p]]), plain) <= index.edits[p]
        }
        assert found == expected
        hits += bool(found)
    assert 40 <= hits < 120


def test_quotes_are_found_wherever_they_begin(spark, docs):
    rows = [(r.item_id, r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t[:200]) for i, t in sorted(rows, key=lambda r: -len(decontam.normal(r[1])))[:2]]
    rows += [(77, None), (78, b"too short"), (79, b"one two three four five six seven eight"), (80, b"ab cd " * 40)]
    index = decontam.Index.of(rows, decontam.whole)
    items = [bytes(t) for t in index.texts]
    rng = np.random.default_rng(6)
    outer = [decontam.normal(r.text.encode())[:80] for r in docs.limit(90).collect()]
    texts, longest = [], max(items, key=len)
    for start in range(0, 30):
        texts += [outer[start] + b" " + longest[start : start + 60] + b" " + outer[start + 30]]
    for n in range(50):
        item = items[n % len(items)]
        size = min(len(item), int(rng.integers(58, 75)))
        part = bytearray(item[(start := int(rng.integers(0, len(item) - size + 1))) : start + size])
        for _ in range(rng.integers(0, 8)):
            at, kind = rng.integers(len(part)), rng.integers(3)
            part[at : at + (kind != 2)] = b"" if kind == 1 else bytes([97 + int(rng.integers(26))])
        texts.append(outer[n] + b" " + bytes(part) + b" " + outer[n + 30])
    found = decontam.matches(texts, index)
    for text, got in zip(texts, found):
        plain = decontam.normal(text)
        expected = {
            p
            for p, item in enumerate(items)
            if any(
                fewest_edits(item[s : s + 60], plain) <= min(len(item), 60) // 15
                for s in range(max(1, len(item) - 59))
            )
        }
        assert got == expected
    assert all(found[:30]) and 20 <= sum(map(bool, found[30:])) < 50
    frame = spark.createDataFrame([(i, t.decode("utf-8", "ignore")) for i, t in enumerate(texts[:30])], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, t.decode("utf-8", "ignore")) for i, t in rows if t], "item_id long, text string")
    assert decontam.decontaminate(frame, benchmark).count() == 0


def test_decontamination(spark, docs, odd):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontam.items_column(docs, benchmark)
    many = decontam.items_column(docs, benchmark, block_bytes=3000)
    both = docs.select("text", one.alias("one"), many.alias("many")).collect()
    plain = {r.item_id: decontam.normal(r.text.encode()) for r in benchmark.collect()}
    assert all(r.one == r.many for r in both)
    for r in both:
        text = decontam.normal(r.text.encode())
        assert {i for i, p in plain.items() if p in text} <= set(r.one)
    rows = benchmark.unionByName(spark.createDataFrame([(None, None), (None, "x" * 70)], benchmark.schema))
    kept = decontam.decontaminate(odd, rows)
    assert kept.columns == odd.columns and kept.count() == 11
    assert decontam.digest(empty(odd), rows).count() == 0
    assert decontam.decontaminate(odd, benchmark.limit(0)).count() == 11


def test_token_files(spark, odd, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    assert whole.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    awkward = ["a  b\n\n c d  e\x1cf", "it's <|endoftext|> now  ", "  ", "x" * 200]
    mark, gaps = "<|endoftext|>", ["", " ", "  ", "\n\n ", "x", " y", "z \t"]
    awkward += [f"a{before}{mark}{after}b" for before in gaps for after in gaps] + [mark, mark * 3, f" {mark} {mark}"]
    more = spark.createDataFrame([(100 + i, t, None, None, None) for i, t in enumerate(awkward)], DOCS)
    rows = odd.select("doc_id", "text").unionByName(more.select("doc_id", "text"))
    rows = rows.unionByName(docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    folder = str(tmp_path / "ids")
    got = token_files.digest(rows, folder, path).collect()
    expected = sorted(
        ((r.doc_id is not None, r.doc_id or 0), whole.encode(r.text or "", add_special_tokens=False).ids + [0])
        for r in rows.collect()
    )
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens) for r in got) == [
        (k, len(i)) for k, i in expected
    ]
    checks = {(k, zlib.crc32(np.array(i, dtype="<u4").tobytes())) for k, i in expected}
    assert {((r.doc_id is not None, r.doc_id or 0), r.ids_crc32) for r in got} == checks
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(np.cumsum([0] + [r.n_tokens for r in ordered])[:-1])
    assert [r.doc_id or 0 for r in ordered] == sorted(r.doc_id or 0 for r in ordered)
    assert token_files.digest(empty(rows), str(tmp_path / "none"), path).count() == 0


def test_a_word_is_encoded_once_whatever_mark_ends_it(tmp_path):
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    ids = lambda t: np.array([*whole.encode(t, add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
    encoder = token_files.Encoder(path)
    marks = [".", ",", ";", ":", "!", "?", "...", ".,", "'s.", "'S,", "1.", "\u0301.", "\xb2.", "\xd7.", " .", "\n.", "<|endoftext|>.", ".<|endoftext|>"]
    for word in ("word", "\xe9t\xe9", "\u01c5", "\u4e2d", "don't", "x1y", "a-b"):
        for mark in marks:
            text = f"{word}{mark} {word}{mark}{word}\n{mark}{word}"
            assert encoder.encode(text) == ids(text) == encoder.encode(text)
    encoder = token_files.Encoder(path)
    encoder.encode("one word, one word. one word! one word? one word; one word: one word")
    assert [c for c in encoder.known if "word" in c] == [" word"]
    # Names that hold a cut are found all the same.
    whole.add_tokens([AddedToken("Mr. X"), AddedToken("<gap>", rstrip=True)])
    whole.save(str(tmp_path / "names.json"))
    named = token_files.Encoder(str(tmp_path / "names.json"))
    for text in ("Dear Mr. X, hello", "a <gap>  b", None, ""):
        assert named.encode(text) == ids(text or "")


def test_single_documents_and_damage(tmp_path):
    import zstandard

    path = tmp_path / "one"
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (1, 5, 3_000_000, 2)]
    with path.open("wb") as out:
        writer = token_files.Writer(out)
        for i, part in enumerate(ids):
            writer.add(None if i == 3 else i, part)
        writer.close()
    import pyarrow.fs

    with pyarrow.fs.LocalFileSystem().open_input_file(str(path)) as source:
        reader = token_files.Reader(source)
        assert [reader.document(i) for i in (2, 0, 3)] == [ids[2], ids[0], ids[3]]
        assert reader.find(None) == [3] and reader.find(1) == [1]
    plain = zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).read()
    assert plain == b"".join(ids)
    data = bytearray(path.read_bytes())
    data[10] ^= 255
    path.write_bytes(data)
    with pyarrow.fs.LocalFileSystem().open_input_file(str(path)) as source:
        with pytest.raises((ValueError, zstandard.ZstdError)):
            token_files.Reader(source).document(0)


# --- pipeline ------------------------------------------------------------


def test_pipeline(spark, docs):
    rows = corpus_pipeline.run(spark, SF).toPandas()
    sizes = rows.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and (rows.groupby("doc_id").size() <= 2).all()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    kept = sorted(set(rows.doc_id))
    assert not any((prints[a] ^ prints[b]).bit_count() <= 4 for a in kept for b in kept if a < b)
    benchmark = [decontam.normal(r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [decontam.normal(t.encode()) for t in rows.text]
    assert not any(p in t for p in benchmark for t in texts)


def test_pipeline_stages_on_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).columns == odd.columns, name
        assert stage(spark, empty(odd), SF).count() == 0, name
