"""Conversation repair against plain enumerations and its SQL."""

import hashlib
import itertools
import re
import zlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from sensorloom.llm import oracles, queries, repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain_faults(rows):
    """Faults of (role, text) rows in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = re.findall(r"[^\x20\x09-\x0D]", text)
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_way(rows, faults, inserts):
    """(cost, audit, repaired rows) of every legal way with at most so many inserted rows."""
    slots = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]
    gaps = [list(itertools.chain.from_iterable(itertools.product("ua", repeat=k) for k in range(inserts + 1)))] * (
        len(rows) + 1
    )
    gaps = [[g for k in range(inserts + 1) for g in itertools.product("ua", repeat=k)]] * (len(rows) + 1)
    names = {"u": "user", "a": "assistant"}
    for edits in itertools.product(*slots):
        for added in itertools.product(*gaps):
            if sum(map(len, added)) > inserts:
                continue
            cost, audit, out = 0, "", []
            for i in range(len(rows) + 1):
                for x in added[i]:
                    cost, audit = cost + 5, audit + "I"
                    out.append((names[x], ""))
                if i == len(rows):
                    break
                edit, (role, text) = edits[i], rows[i]
                audit += edit[0]
                if edit == "D":
                    cost += 2
                    continue
                cost += (edit != "K") + 5 * (faults[i] == "truncated")
                out.append((role if edit == "K" else names[edit[1]], text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
                yield cost, audit, out


def least(rows):
    """The cheapest way by a table of (cost, audit, rows) triples, compared as such."""
    faults = plain_faults(rows)
    names = {"u": "user", "a": "assistant"}
    nexts = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": (0, "", ())}

    def better(table, state, way):
        if state not in table or way < table[state]:
            table[state] = way

    def with_inserts(table):
        for _ in range(2):
            for state, (c, a, out) in list(table.items()):
                for x in "ua":
                    if (state, x) in nexts:
                        better(table, nexts[state, x], (c + 5, a + "I", (*out, (names[x], ""))))
        return table

    for (role, text), f in zip(rows, faults):
        now = {}
        for state, (c, a, out) in with_inserts(best).items():
            better(now, state, (c + 2, a + "D", out))
            if f in ("blank", "duplicate"):
                continue
            extra = 5 * (f == "truncated")
            if (state, role[:1]) in nexts:
                better(now, nexts[state, role[:1]], (c + extra, a + "K", (*out, (role, text))))
            for x in "ua":
                if (state, x) in nexts:
                    better(now, nexts[state, x], (c + 1 + extra, a + "R", (*out, (names[x], text))))
        best = now
    ends = [way for state, way in with_inserts(best).items() if state in ("", "a")]
    return min(ends)


def by_paths(rows):
    paths = repair.Paths()
    for (role, text), f in zip(rows, plain_faults(rows)):
        if f in ("blank", "duplicate"):
            paths.delete()
        else:
            paths.row(role[:1], f == "truncated")
    return paths.end()


ROWS = st.lists(
    st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.sampled_from(["a.", "b!", "c", " ", "d?"])),
    max_size=4,
)


@given(ROWS)
@settings(max_examples=150, deadline=None)
def test_least_path_of_all_ways(rows):
    cost, audit, out = min(every_way(rows, plain_faults(rows), 2))
    assert by_paths(rows) == (cost, audit)
    assert least(rows)[:2] == (cost, audit)


@given(
    st.lists(
        st.tuples(st.sampled_from(["user", "assistant", "assistant", "system", "x"]), st.sampled_from(["a.", "b!", "c", "d?", "e.", "f.", "g"])),
        max_size=300,
    ),
    st.integers(1, 5),
)
@settings(max_examples=60, deadline=None)
def test_long_conversations_settle_their_letters(rows, unlike):
    rows = [(role, f"{i // unlike}{text}") for i, (role, text) in enumerate(rows)]
    assert by_paths(rows) == least(rows)[:2]


def test_weights_stay_short():
    paths = repair.Paths()
    for i in range(5000):
        paths.row("ua"[i % 2], False)
        paths.delete(3)
    assert paths.room < 1000 and paths.end() == (30000, "KDDD" * 5000)
    paths = repair.Paths()
    paths.delete(1_000_000)
    assert paths.end() == (2_000_000, "D" * 1_000_000)


def plain(conversations):
    """The whole digest in plain Python."""
    damaged, ids = {}, []
    for conv_id, turn, role, text in conversations:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv_id, turn))
        kind = zlib.crc32(key.encode()) % 20
        rows = damaged.setdefault(conv_id, [])
        ids.append(conv_id)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv_id, rows in damaged.items():
        rows.sort()
        turns = [t for known, t, _, _ in rows if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [r[2:] for r in rows]
        faults = plain_faults(pairs)
        letters = [r[0][:1] for r in pairs]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        cost, audit, left = least(pairs)
        text = "\n".join(f"{r}:{t}" for r, t in left)
        out[conv_id] = (
            gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def found(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    got = {r.conv_id: tuple(r[n] for n in names) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_equals_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert found(queries.all_queries()["op13_repair"](spark, SF)) == plain(rows)


def test_sql_equals_plain_python():
    engine = duckdb.connect()
    engine.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    rows = engine.sql("SELECT * FROM conversations").fetchall()
    got = engine.sql(oracles.ORACLES["op13_repair"]).fetchall()
    assert {r[0]: r[1:] for r in got} == plain(rows) and len(got) == len({r[0] for r in rows})


def test_odd_conversations(spark):
    long = "word " * 50_000
    rows = [
        (1, None, None, None), (1, None, "user", "no turn."), (1, 3, "user", "no turn."), (1, 3, "user", "no turn."),
        (1, 3, "assistant", None), (2, 5, None, "x."), (2, -4, "", "y."), (2, 9_000_000_000, "assistant", long),
        (None, 0, "user", "who?"), (None, 1, "assistant", "nobody."), (None, None, "system", "s."),
        (7, 1, "uncle", "\x0b\x0c "), (7, 2, "aunt", " "), (7, 2, "aunt", " ."), (8, 1, "user", "é"),
    ]
    rows += [(9, i, "user", "the same.") for i in range(400)] + [(9, 5, "user", "the same.")] * 50
    rows += [(100 + i, 0, "user", "hi.") for i in range(40)]  # Some lose their only row.
    made = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS copies", "1 AS seen", "2 AS audit", "3 AS tag")
    expected = plain(rows)
    assert found(repair.digest(made)) == expected
    assert any(v[-2:] == ("", hashlib.sha256(b"").hexdigest()) and not any(v[:-2]) for v in expected.values())
    assert not repair.digest(made.limit(0)).collect()
    assert not repair.repair(made.limit(0)).collect()


def test_repaired_rows(spark):
    rows = [
        (1, 0, "assistant", "Hello."), (1, 1, "user", "What?"), (1, 2, "user", "What?"), (1, 3, "assistant", "This."),
        (2, 0, "system", "Be brief."), (2, 1, "user", "Why?"), (3, 0, "user", " "),
    ]
    got = repair.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect()
    by_conv = {}
    for r in got:
        by_conv.setdefault(r.conv_id, []).append((r.role, r.text))
        assert r.place == len(by_conv[r.conv_id]) - 1
    for conv_id in (1, 2, 3):
        assert tuple(by_conv.get(conv_id, ())) == least([r[2:] for r in rows if r[0] == conv_id])[2]


def test_one_hot_conversation(spark):
    """A third of all rows in one conversation, over many batches."""
    rows = [(0, i, ("user", "assistant", "system")[i * i % 3], f"{i % 700} said{'.' if i % 11 else ''}") for i in range(3000)]
    rows += [(1 + i, i % 3, "user", "short.") for i in range(3000)]
    assert found(repair.digest(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
