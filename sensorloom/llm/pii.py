"""Personal data: candidate spans, boosted trees, calibrated thresholds; columns throughout.

1. Base spans follow fixed formats (e-mail address, IPv4 address, payment card
   with a valid check digit, international phone number) and always stay.
2. Generators with looser formats propose overlapping candidate spans of each kind.
3. Boosted trees score candidates from their format (lengths, digits, groups,
   separators) and context (the characters and words beside them, up to the next
   candidates of their kind). Positive are candidates at a base span of their kind, and
   masked variants of base spans in their place: an address with its sign spelled out or
   spaced, a phone number without its plus, a card or an IP address with other separators.
   Other candidates are negative. Validity itself (check digit, part sizes) is no feature,
   so candidates that look like the real thing score high.
4. A kind's threshold is the least score, 0.5 at least, from which ``PRECISION`` of the
   candidates kept aside are positive. Candidates that reach it and overlap no base span
   are added, of each run of overlapping ones the best.

The trees and thresholds are learned from all candidates of all documents. Candidates that look
alike, with the same numbers and label, are one weighted row, so what is trained on follows the
variety of formats, not the size of the table; each kind and label has the same weight in all,
so that none crowds out another. Trees are trained by Spark ML and applied as expressions. Patterns are possessive and start at the edge of a run, and whatever runs
over a text's spans is a scan in blocks (``_scan``), so the time grows with the text and
its spans, not their square. Positions count code points, the end exclusive.

Defined results: a null text is an empty one and has no spans; a kind without base
spans in the table has no added ones; equal texts have equal spans; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import fresh
from sensorloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
TREES = 10
DEPTH = 3
PRECISION = 0.95
SEED = 13
# Items that a scan takes in one go. It copies this many numbers per item, and as many as
# the square of the number of such blocks.
_BLOCK = 128
_BEFORE, _AFTER = 24, 12
# What can stand in the name of a mail address.
_NAME = r"[A-Za-z0-9._%+-]"
_EDGE = rf"(?:(?<!{_NAME})|\G)"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
BASE = (
    rf"{_EDGE}{_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    r"[0-9]++(?:[\x20-][0-9]++)*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
LOOSE = (
    rf"{_EDGE}{_NAME}++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]++)*+",
    r"(?<![0-9])[0-9]{1,3}(?:[.,][0-9]{1,3}){3,5}(?![0-9])",
    r"(?<![0-9])[0-9](?:[ .-]?[0-9]){11,18}(?![0-9])",
    r"(?<![0-9+])[+(]?[0-9][ ().0-9-]{5,20}[0-9](?![0-9])",
)
_SPAN = "struct<start:int,kind:int,end:int,txt:string,before:string,after:string>"
_WORDS = (
    r"mail|e-mail|contact|@",
    r"tel|phone|call|mobile|fax",
    r"card|visa|account|pay|iban",
    r"\bip\b|host|server|addr|login",
)


_BUILT: dict[tuple, Column] = {}


def _built_once(build: Callable[[str], Column]) -> Callable[[str], Column]:
    """Large expressions over a named column are built once per application, as building them takes seconds."""

    @wraps(build)
    def held(name: str) -> Column:
        key = (build.__name__, name, id(SparkContext._gateway))
        if key not in _BUILT:
            _BUILT[key] = build(name)
        return _BUILT[key]

    return held


def _maybe(text: Column, kind: int) -> Column:
    """A cheap test that texts without the kind mostly fail."""
    if kind == 0:
        return F.contains(text, F.lit("@"))
    if kind == 3:
        return F.contains(text, F.lit("+"))
    return text.rlike("[0-9]")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(items: Column, carry: Column, carried: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """For each item a whole number, from it and what the items before it have left.

    ``step`` gives (carry, number). An aggregate copies what it has gathered with every item,
    so numbers are gathered in blocks: first what each block starts with, then within each.
    """
    nothing = F.array().cast("array<int>")

    def blocks(held: Column) -> Column:
        last = F.floor((F.size(held) - 1) / F.lit(_BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(held, i * _BLOCK + 1, F.lit(_BLOCK)))

    def starts(cut: Column) -> Column:
        begin = F.struct(carry.cast(carried).alias("c"), F.array().cast(f"array<{carried}>").alias("o"))

        def over(state: Column, block: Column) -> Column:
            return F.aggregate(
                block,
                state.c,
                lambda c, item: step(c, item)[0].cast(carried),
                lambda c: F.struct(c.alias("c"), F.array_append(state.o, state.c).alias("o")),
            )

        return F.aggregate(cut, begin, over, lambda state: state.o)

    def within(block: Column, start: Column) -> Column:
        def add(state: Column, item: Column) -> Column:
            left, made = step(state.c, item)
            return F.struct(left.cast(carried).alias("c"), F.array_append(state.o, made.cast("int")).alias("o"))

        return F.aggregate(block, F.struct(start.alias("c"), nothing.alias("o")), add, lambda state: state.o)

    def whole(held: Column) -> Column:
        found = _let(blocks(held), lambda cut: F.flatten(F.zip_with(cut, starts(cut), within)))
        return F.when(F.size(held) > 0, found).otherwise(nothing)

    return _let(items, whole)


def _with(items: Column, numbers: Callable[[Column], Column], made: Callable[[Column, Column], Column]) -> Column:
    """Each item together with its number."""
    return _let(items, lambda held: F.zip_with(held, numbers(held), made))


def _found(text: Column, pattern: str, kind: int) -> Column:
    """All matches with their places and surroundings: the text is split at them, and lengths are added up."""
    pieces = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
        F.split(text, pattern, -1).alias("gaps"),
    )

    def steps(p: Column) -> Column:
        n = F.size(p.matches)
        zipped = F.arrays_zip(
            p.matches.alias("txt"), F.slice(p.gaps, F.lit(1), n).alias("gap"), F.slice(p.gaps, F.lit(2), n).alias("next")
        )
        return F.transform(
            zipped,
            lambda z: F.struct(
                F.length(z.txt).alias("size"),
                F.length(z.gap).alias("skip"),
                z.txt.alias("txt"),
                F.right(z.gap, F.lit(_BEFORE)).alias("before"),
                F.left(z.next, F.lit(_AFTER)).alias("after"),
            ),
        )

    def starts(held: Column) -> Column:
        return _scan(held, F.lit(0), "int", lambda at, s: (at + s["skip"] + s["size"], at + s["skip"]))

    def span(s: Column, start: Column) -> Column:
        return F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), (start + s["size"]).alias("end"),
            s.txt.alias("txt"), s.before.alias("before"), s.after.alias("after"),
        )

    return _with(_let(pieces, steps), starts, span)


def _only(text: Column, what: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{what}]", ""))


def _luhn(text: Column) -> Column:
    def valid(digits: Column) -> Column:
        size = F.length(digits)

        def add(total: Column, i: Column) -> Column:
            digit = F.substring(digits, size - i + 1, F.lit(1)).cast("int")
            doubled = digit * 2 - F.when(digit > 4, 9).otherwise(0)
            return total + F.when(i % 2 == 0, doubled).otherwise(digit)

        total = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add)
        return F.when(size.between(12, 19), total % 10 == 0).otherwise(False)

    return _let(F.regexp_replace(text, "[ -]", ""), valid)


def _valid(kind: int) -> Callable[[Column], Column]:
    return (
        lambda s: F.lit(True),
        lambda s: s.txt.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        lambda s: _luhn(s.txt),
        lambda s: _only(s.txt, "0-9").between(9, 15),
    )[kind]


@_built_once
def base_spans(name: str) -> Column:
    """Spans of a text column in the fixed formats, kind after kind."""
    text = F.col(name)
    nothing = F.array().cast(f"array<{_SPAN}>")
    return F.concat(
        *[
            F.when(_maybe(text, k), F.filter(_found(text, BASE[k], k), _valid(k))).otherwise(nothing)
            for k in range(len(KINDS))
        ]
    )


@_built_once
def candidate_spans(name: str) -> Column:
    """Spans of a text column proposed by the loose formats, kind after kind."""
    text = F.col(name)
    nothing = F.array().cast(f"array<{_SPAN}>")
    some = (
        F.contains(text, F.lit("@")) | F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]")),
        text.rlike("[0-9][.,][0-9]"),
        text.rlike("[0-9][ .-]?[0-9]"),
        text.rlike("[0-9][ ().0-9-][ ().0-9-]"),
    )
    return F.concat(
        *[
            F.when(test, _found(text, LOOSE[k], k)).otherwise(nothing) for k, test in enumerate(some)
        ]
    )


def features(span: Column) -> list[Column]:
    """Format and context of a candidate as numbers."""
    txt, before, after = span.txt, span.before, span.after
    left, right = F.right(before, F.lit(1)), F.left(after, F.lit(1))

    def sort_of(char: Column) -> Column:
        return (
            F.when(char.rlike(r"\s"), 1).when(char.rlike("[0-9]"), 3).when(char.rlike(r"\p{L}"), 2)
            .when(char == "", 0).otherwise(4)
        )

    values = [
        F.length(txt),
        _only(txt, "0-9"),
        _only(txt, "A-Za-z"),
        _only(txt, " "),
        _only(txt, "."),
        _only(txt, "-"),
        _only(txt, "()"),
        F.size(F.split(txt, "[^0-9A-Za-z]+", -1)),
        F.array_max(F.transform(F.split(txt, "[^0-9]+", -1), F.length)),
        F.when(F.startswith(txt, F.lit("+")), 1).otherwise(0),
        F.when(F.contains(txt, F.lit("@")), 1).otherwise(0),
        F.when(txt.rlike(r"(?i)\(at\)|\[at\]"), 1).otherwise(0),
        F.when(txt.rlike(r"(?i)[a-z0-9](?:\.| ?\(dot\) ?| ?\[dot\] ?)[a-z]{2,}$"), 1).otherwise(0),
        sort_of(left),
        sort_of(right),
        _only(before, "0-9"),
        _only(after, "0-9"),
        *[F.when(F.lower(before).rlike(w), 1).otherwise(0) for w in _WORDS],
        *[F.when(span.kind == k, 1).otherwise(0) for k in range(len(KINDS))],
    ]
    return [v.cast("double") for v in values]


def variants(span: Column) -> Column:
    """Masked forms of a base span, in its place."""
    txt = span.txt
    forms = (
        [
            F.regexp_replace(txt, "@", " (at) "),
            F.regexp_replace(txt, "@", " @ "),
            F.regexp_replace(F.regexp_replace(txt, "@", " (at) "), r"\.([A-Za-z0-9-]+)$", " (dot) $1"),
            F.regexp_replace(F.regexp_replace(txt, "@", " [at] "), r"\.(?=[A-Za-z0-9.-]*$)", " [dot] "),
        ],
        [F.regexp_replace(txt, r"\.", ",")],
        [F.regexp_replace(F.regexp_replace(txt, "[ -]", ""), "([0-9]{4})(?=[0-9])", f"$1{by}") for by in (".", "-", " ")],
        [F.regexp_replace(txt, r"^\+", ""), F.regexp_replace(txt, r"^\+", "(")],
    )
    by_kind = F.lit(None).cast("array<string>")
    for k, some in enumerate(forms):
        by_kind = F.when(span.kind == k, F.array(*some)).otherwise(by_kind)
    whole = F.lit(None).cast("string")
    for k, pattern in enumerate(LOOSE):
        whole = F.when(span.kind == k, F.lit(f"^(?:{pattern})$")).otherwise(whole)
    made = F.transform(
        by_kind,
        lambda t: F.struct(
            span.start.alias("start"), span.kind.alias("kind"), span.end.alias("end"),
            t.alias("txt"), span.before.alias("before"), span.after.alias("after"),
        ),
    )
    return F.filter(made, lambda v: (v.txt != txt) & F.regexp_like(v.txt, whole))


def overlap(a: Column, b: Column) -> Column:
    return (a.start < b.end) & (b.start < a.end)


class Scorer:
    """Trees as nested tuples (feature, limit, low, high) or leaves, with a threshold per kind."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[int, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def probability(self, values: Callable[[int], Column]) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, limit, low, high = node
            return F.when(values(feature) <= limit, walk(low)).otherwise(walk(high))

        margin = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            margin = margin + walk(tree) * F.lit(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(margin * -2.0))

    def threshold(self, kind: Column) -> Column:
        found = F.lit(2.0)
        for k, least in self.thresholds.items():
            found = F.when(kind == k, F.lit(least)).otherwise(found)
        return found


def _parsed(text: str) -> list:
    """The trees of a Spark ML ensemble, from its description."""
    trees = []
    lines = [line.strip() for line in text.splitlines()]

    def node(i: int):
        if lines[i].startswith("Predict:"):
            return float(lines[i].split(":")[1]), i + 1
        feature, limit = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", lines[i]).groups()
        low, i = node(i + 1)
        high, i = node(i + 1)
        return (int(feature), float(limit), low, high), i

    for i, line in enumerate(lines):
        if re.match(r"Tree \d+ ", line):
            trees.append(node(i + 1)[0])
    return trees


_MARKED = "struct<span:" + _SPAN + ",label:boolean>"


def _hits(spans: Column, base: Column) -> Column:
    """Each span with whether a base span overlaps it: ``{span, label}`` in order of place.

    In one order the furthest end so far tells of base spans that begin earlier, in the
    other the nearest start of those that begin later.
    """

    def marked(items: Column, real: bool) -> Column:
        return F.transform(items, lambda s: F.struct(s.start.alias("start"), F.lit(real).alias("real"), s.alias("span")))

    def forward(held: Column) -> Column:
        def step(end: Column, item: Column) -> tuple[Column, Column]:
            return F.when(item.real, F.greatest(end, item.span.end)).otherwise(end), (item.start < end).cast("int")

        return _scan(held, F.lit(-1), "int", step)

    def backward(held: Column) -> Column:
        def step(begin: Column, item: Column) -> tuple[Column, Column]:
            return F.when(item.real, F.least(begin, item.start)).otherwise(begin), (begin < item.span.end).cast("int")

        return F.reverse(_scan(F.reverse(held), F.lit(2**31 - 1), "int", step))

    def hits(held: Column) -> Column:
        return F.zip_with(forward(held), backward(held), lambda a, b: F.greatest(a, b))

    def told(item: Column, hit: Column) -> Column:
        return F.struct(item.real.alias("real"), item.span.alias("span"), (hit > 0).alias("label"))

    def all_told(both: Column) -> Column:
        kept = F.filter(_with(F.sort_array(both), hits, told), lambda i: ~i.real)
        return F.transform(kept, lambda i: F.struct(i.span.alias("span"), i.label.alias("label")))

    both = F.concat(marked(spans, False), marked(base, True))
    # Most texts have no candidates.
    return _let(both, lambda b: F.when(F.size(b) > 0, all_told(b)).otherwise(F.array().cast(f"array<{_MARKED}>")))


def _of_kind(spans: Column, kind: int | Column) -> Column:
    return F.filter(spans, lambda s: s.kind == kind)


def _drawn(share: float, *parts) -> Column:
    """Whether a row is among the share drawn by a hash, at any size of the table."""
    return (F.xxhash64(*parts, F.lit(SEED)).cast("double") / F.lit(2.0**64) + F.lit(0.5)) < F.lit(share)


def _drawn_documents(docs: DataFrame, train_docs: int) -> DataFrame:
    """(text, base): about ``train_docs`` different texts with each kind of span, and as many without any."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans("text"))
    has = [F.size(_of_kind(F.col("base"), k)) > 0 for k in range(len(KINDS))]
    sorts = [*has, ~F.coalesce(F.size("base") > 0, F.lit(False))]
    sizes = rows.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(sorts)]).first()
    shares = [min(1.0, train_docs / max(1, n)) if n else 0.0 for n in sizes]
    # Only documents that may be drawn are looked at again.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.filter(_drawn(max(shares), "doc_id", "text")).withColumn("base", base_spans("text"))
    wanted = F.lit(False)
    for condition, share in zip(sorts, shares):
        wanted = wanted | (condition & _drawn(share, "doc_id", "text"))
    return rows.filter(wanted).select("text", "base").dropDuplicates(["text"])


def _candidates(docs: DataFrame) -> DataFrame:
    """(values, kind, label, fold, n): how many candidates of all documents look so."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    # A text is on one side of the split, with all its copies.
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(4)))
    rows = rows.withColumn("base", base_spans("text")).withColumn("proposed", candidate_spans("text"))
    kinds = F.array(*[F.lit(k) for k in range(len(KINDS))])
    own = F.struct(F.col("proposed").alias("proposed"), F.col("base").alias("base"))
    found = _let(
        own,
        lambda o: F.flatten(F.transform(kinds, lambda k: _hits(_of_kind(o.proposed, k), _of_kind(o.base, k)))),
    )
    masked = F.transform(
        F.flatten(F.transform("base", variants)), lambda v: F.struct(v.alias("span"), F.lit(True).alias("label"))
    )
    marked = F.concat(found.cast(f"array<{_MARKED}>"), masked.cast(f"array<{_MARKED}>"))
    rows = rows.select("fold", F.explode(marked).alias("m"))
    rows = rows.select(
        F.array(*features(F.col("m.span"))).alias("values"),
        F.col("m.span.kind").alias("kind"),
        F.col("m.label").cast("double").alias("label"),
        "fold",
    )
    return rows.groupBy("values", "kind", "label", "fold").agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, train_docs: int | None = None) -> Scorer | None:
    """Learns what candidates at a base span of their kind, and masked base spans, look like.

    From all documents, or from some drawn by a hash if ``train_docs`` of each kind will do.
    """
    if train_docs is not None:
        docs = cut_lineage(_drawn_documents(docs, train_docs), "pii-documents")
    rows = cut_lineage(_candidates(docs), "pii-candidates")
    sides = rows.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()
    if {r["label"] for r in sides} != {0.0, 1.0}:
        return None
    weight, whole = F.lit(0.0), sum(r["n"] for r in sides)
    for r in sides:
        share = whole / len(sides) / r["n"]
        weight = F.when((F.col("kind") == r["kind"]) & (F.col("label") == r["label"]), share).otherwise(weight)
    learn = rows.filter("fold > 0").withColumn("weight", F.col("n") * weight)
    learn = learn.select(array_to_vector("values").alias("features"), "label", "weight")
    if learn.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight").fit(learn)
    scorer = Scorer(_parsed(model.toDebugString), list(model.treeWeights), {})
    score = scorer.probability(lambda i: F.col("values")[i])
    # Scores in hundredths: at most 101 rows for each kind.
    kept = rows.filter("fold = 0").groupBy("kind", F.floor(score * 100).cast("int").alias("at"))
    told = [F.coalesce(F.sum(F.when(F.col("label") == v, F.col("n"))), F.lit(0)).alias(c) for v, c in ((1, "yes"), (0, "no"))]
    bins = kept.agg(*told).collect()
    scorer.thresholds = _thresholds([(r["kind"], r["at"], r["yes"], r["no"]) for r in bins])
    return scorer


def _thresholds(bins: list[tuple[int, int, int, int]], precision: float = PRECISION) -> dict[int, float]:
    """For each kind the least hundredth from 0.5 on, from which enough of (kind, hundredth, yes, no) are right."""
    found = {}
    for kind in range(len(KINDS)):
        for least in range(50, 101):
            yes = sum(b[2] for b in bins if b[0] == kind and b[1] >= least)
            no = sum(b[3] for b in bins if b[0] == kind and b[1] >= least)
            if yes and yes >= precision * (yes + no):
                found[kind] = least / 100
                break
    return found


def _best_of_runs(scored: Column) -> Column:
    """Of each run of overlapping ``{span, score}``, in order of place, the best; of equal ones the first."""

    def forward(held: Column) -> Column:
        """Twice whether an item begins a run, and whether one before it in its run is as good."""

        def step(state: Column, c: Column) -> tuple[Column, Column]:
            goes_on = c.span.start < state.end
            best = F.when(goes_on, F.greatest(state.best, c.score)).otherwise(c.score)
            end = F.when(goes_on, F.greatest(state.end, c.span.end)).otherwise(c.span.end)
            beaten = goes_on & (state.best >= c.score)
            return F.struct(end.alias("end"), best.alias("best")), (~goes_on).cast("int") * 2 + beaten.cast("int")

        start = F.struct(F.lit(-1).alias("end"), F.lit(-1.0).alias("best"))
        return _scan(held, start, "struct<end:int,best:double>", step)

    def backward(told: Column) -> Column:
        """Whether an item is left: nothing after it in its run is better, or before it as good."""

        def step(best: Column, t: Column) -> tuple[Column, Column]:
            left = (best <= t.score) & (t.code % 2 == 0)
            return F.when(t.code >= 2, -1.0).otherwise(F.greatest(best, t.score)), left.cast("int")

        return F.reverse(_scan(F.reverse(told), F.lit(-1.0), "double", step))

    coded = _with(
        scored,
        forward,
        lambda c, code: F.struct(c.span.alias("span"), c.score.alias("score"), code.alias("code")),
    )
    kept = _with(coded, backward, lambda t, left: F.when(left == 1, t.span))
    return F.array_compact(kept)


def with_spans(docs: DataFrame, scorer: Scorer | None, base: str, spans: str) -> DataFrame:
    """Adds the columns ``base`` and ``spans``: base spans, and all spans, by place and kind."""
    text = fresh(docs.columns, "_text")
    rows = docs.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumn(base, F.sort_array(base_spans(text)))
    if scorer is None or not scorer.thresholds:
        return rows.withColumn(spans, F.col(base)).drop(text)
    proposed = fresh(rows.columns, "_proposed")
    # Proposals come in order of place.
    rows = rows.withColumn(proposed, _hits(candidate_spans(text), F.col(base)))

    def rated(c: Column) -> Column:
        return F.struct(c.span.alias("span"), F.array(*features(c.span)).alias("values"))

    def scored(rate: Column) -> Column:
        score = scorer.probability(lambda i: rate["values"][i])
        return F.struct(rate.span.alias("span"), (F.floor(score * 100) / 100).alias("score"))

    def chosen(marked: Column) -> Column:
        free = F.transform(F.filter(marked, lambda c: ~c.label), rated)
        return F.filter(F.transform(free, scored), lambda c: c.score >= scorer.threshold(c.span.kind))

    kind = f"array<struct<span:{_SPAN},score:double>>"
    rows = rows.withColumn(proposed, F.when(F.size(proposed) > 0, chosen(F.col(proposed))).otherwise(F.array().cast(kind)))
    added = F.sort_array(F.concat(F.col(base), _best_of_runs(F.col(proposed))))
    rows = rows.withColumn(spans, F.when(F.size(proposed) > 0, added).otherwise(F.col(base)))
    return rows.drop(text, proposed)


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    )
    return F.array_join(
        F.transform(
            ordered,
            lambda s: F.concat_ws(
                ":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string")
            ),
        ),
        ",",
    )


def redact(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """The documents with every span replaced by its kind, as in [EMAIL]."""
    base, spans = fresh(docs.columns, "_base"), fresh(docs.columns, "_spans")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")

    def begun(held: Column) -> Column:
        """Where the text that is not covered yet goes on before each span."""
        return _scan(held, F.lit(0), "int", lambda at, s: (F.greatest(at, s.end), at))

    def written(held: Column) -> Column:
        def cut(s: Column, at: Column) -> Column:
            kept = F.slice(held.letters, at + 1, F.greatest(s.start - at, F.lit(0)))
            # A span that begins within the one before has no mark of its own.
            return F.concat(F.array_join(kept, ""), F.when(s.start >= at, F.get(names, s.kind)).otherwise(""))

        end = F.aggregate(held.spans, F.lit(0), lambda at, s: F.greatest(at, s.end))
        rest = F.array_join(F.slice(held.letters, end + 1, F.size(held.letters)), "")
        return F.concat(F.array_join(_with(held.spans, begun, cut), ""), rest)

    found = with_spans(docs, scorer, base, spans)
    held = F.struct(F.split(text, "", -1).alias("letters"), F.col(spans).alias("spans"))
    replaced = F.when(F.size(F.col(spans)) > 0, _let(held, written)).otherwise(text)
    return found.withColumn("text", replaced).drop(base, spans)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts and checksum of base spans, and all spans."""
    rows = docs.select("doc_id", "text")
    found = with_spans(rows, train(rows), "base", "all_spans")

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("all_spans").alias("spans"),
    )
