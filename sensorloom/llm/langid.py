"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the byte n-grams of 2 to 4 of a lower-cased text in which anything
but letters is one space, hashed into ``BUCKETS`` rows of an embedding table.
The mean of a text's rows goes through a linear softmax; both are trained by
stochastic gradient descent in numpy, in tasks. As mean and map are linear,
a prediction is the mean of one short row of class scores per subword.

All labelled rows count, whole. Four fifths train, in pieces of bounded size, each
in a task of its own; the class scores of the pieces are averaged. The last fifth, told by
a hash of the text, calibrates: a temperature for the scores, and the score under
which a prediction is rejected, so that 999 of 1000 right ones pass. One vector of sums
and counts by rounded score reach the driver.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and
rejected; so is every text if nothing can be learned; equal texts are predicted
equally; texts of any length are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import fresh, prepare
from sensorloom.llm.pieces import VECTORS, pieces, summed, vector_row
from sensorloom.session import cut_lineage

BUCKETS = 1 << 15
NGRAMS = (2, 3, 4)
DIM = 16
# What one task trains on at a time: about so many rows and bytes of letters.
PIECE_ROWS = 2048
PIECE_BYTES = 16 << 20
# Passes over the rows of a piece: of the only one, and of one of several.
EPOCHS, EPOCHS_OF_MANY = 6, 3
RATE = 0.5
PASS = 0.999
UNKNOWN = "und"
SEED = 3
_CHUNK = 1 << 20
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TEMPERATURES = np.geomspace(0.1, 10, 81)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """For every class the scores of all buckets; ``threshold`` is the least accepted score."""

    labels: tuple[str, ...]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def letters(text: str) -> bytes:
    """The lower-cased text in which anything but letters is one space, within spaces."""
    data = text.lower().encode("utf-8", "replace").translate(_LETTERS)
    return b" " + b" ".join(data.split()) + b" "


def buckets(data: bytes):
    """Hashed subwords of such letters, in parts of bounded size."""
    raw = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(raw), _CHUNK):
        part = raw[at : at + _CHUNK + max(NGRAMS) - 1].astype(np.uint64)
        gram = part
        for n in range(2, max(NGRAMS) + 1):
            gram = gram[:-1] << np.uint64(8)
            gram |= part[n - 1 :]
            if n in NGRAMS:
                hashed = (gram[:_CHUNK] + np.uint64(n << 40)) * _MIX
                yield (hashed >> np.uint64(64 - 15)).view(np.int64)


def _counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and the share of each."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for part in buckets(data):
        total += np.bincount(part, minlength=BUCKETS)
    index = np.flatnonzero(total)
    return index.astype(np.uint16), (total[index] / total.sum()).astype(np.float32)


def _packed(batches):
    for batch in batches:
        # A context of its own, as a worker may run this twice in one stage.
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True)
        texts = pa.array([pack.compress(letters(t)) for t in batch.column("text").to_pylist()], pa.binary())
        names = ["text", *batch.schema.names[1:]]
        yield pa.RecordBatch.from_arrays([texts, *batch.columns[1:]], names=names)


def _fitted(labels: tuple[str, ...], epochs: int):
    """For each task the sum of its pieces' class scores, weighted by rows, and of their rows."""

    def run(batches):
        total, first = None, None
        unpack = zstandard.ZstdDecompressor()
        for rows in pieces(batches):
            x = [_counts(unpack.decompress(t)) for t in rows["text"].to_pylist()]
            y = [labels.index(v) for v in rows["label"].to_pylist()]
            piece = rows["piece"][0].as_py()
            scores, bias = _descend(x, y, len(labels), epochs, piece)
            vector = np.concatenate([scores.ravel() * len(x), bias * len(x), [len(x)]])
            total, first = (vector, piece) if total is None else (total + vector, first)
        if total is not None:
            yield vector_row(first, total)

    return run


def _descend(x, y, n_labels: int, epochs: int, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Class scores of every bucket and the bias, by stochastic gradient descent."""
    rng = np.random.default_rng([SEED, piece])
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weights = np.zeros((DIM, n_labels))
    bias = np.zeros(n_labels)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for i in rng.permutation(len(x)):
            index, weight = x[i]
            rows = table[index]
            mean = weight @ rows
            error = _softmax((mean @ weights + bias)[None, :])[0]
            error[y[i]] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            # Subwords share a step in proportion to their weight, scaled to its mean square.
            rows -= np.outer(weight / (weight @ weight), (rate * back).astype(np.float32))
            table[index] = rows
    return table @ weights, bias


def _tempered(best: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The loss of the scores ``best`` of rows with labels ``y`` under every temperature."""
    rows = np.arange(len(y))
    return np.array([-np.log(_softmax(best / t)[rows, y] + 1e-12).sum() for t in _TEMPERATURES])


def train(docs: DataFrame, usable, label: str = "lang") -> Model | None:
    """Learns from text and label of all rows for which ``usable`` holds."""
    spark = docs.sparkSession
    prepare(spark)
    check = F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(5)) == 0
    rows = docs.filter(usable & F.col("text").rlike(r"\p{L}") & F.col(label).isNotNull())
    rows = rows.select("doc_id", "text", F.col(label).alias("label"), check.alias("checks"))
    sides = rows.groupBy("label", "checks").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    sides = sides.collect()
    if not sides:
        return None
    labels = tuple(sorted({s["label"] for s in sides}))
    if len({s["checks"] for s in sides}) == 2:
        learn, sides = rows.filter(~check), [s for s in sides if not s["checks"]]
        checked = rows.filter(check)
    else:
        learn = checked = rows
    n, size = (sum(s[c] for s in sides) for c in ("n", "size"))
    parts = max(1, -(-n // PIECE_ROWS), -(-size // PIECE_BYTES))
    piece = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("piece")
    dealt = learn.select("text", "label", piece, F.xxhash64("text").alias("place"))
    dealt = dealt.mapInArrow(_packed, "text binary, label string, piece int, place long")
    dealt = dealt.repartition(parts, "piece").sortWithinPartitions("piece", "place", "text", "label")
    run = _fitted(labels, EPOCHS if parts == 1 else EPOCHS_OF_MANY)
    total = summed(dealt.mapInArrow(run, VECTORS), parts)
    mean = (total[:-1] / total[-1]).reshape(BUCKETS + 1, len(labels))
    scores = np.ascontiguousarray(mean[:BUCKETS].T, dtype=np.float32)
    return _calibrated(checked, Model(labels, scores, mean[BUCKETS], 1.0, 0.0))


def _calibrated(checked: DataFrame, model: Model) -> Model:
    """The model with the temperature and the threshold that fit the rows given."""
    shared, labels = checked.sparkSession.sparkContext.broadcast(model), model.labels

    def judged(batches):
        for batch in batches:
            raw = [raw_scores(t, shared.value) for t in batch.column("text").to_pylist()]
            y = [labels.index(v) for v in batch.column("label").to_pylist()]
            arrays = [pa.array(raw, pa.list_(pa.float64())), pa.array(y, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=["raw", "y"])

    def batch_of(batch):
        raw = batch.column("raw").flatten().to_numpy().reshape(-1, len(labels))
        return raw, batch.column("y").to_numpy()

    def lost(batches):
        for batch in batches:
            losses = pa.array([_tempered(*batch_of(batch))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([losses], names=["loss"])

    judgements = checked.select("text", "label").mapInArrow(judged, "raw array<double>, y int")
    judgements = cut_lineage(judgements, "language-scores")
    losses = judgements.mapInArrow(lost, "loss array<double>")
    losses = losses.agg(*[F.sum(F.col("loss")[i]) for i in range(len(_TEMPERATURES))]).first()
    at = min(range(len(losses)), key=lambda i: (losses[i], abs(np.log(_TEMPERATURES[i]))))
    temperature = float(_TEMPERATURES[at])

    def passed(batches):
        for batch in batches:
            raw, y = batch_of(batch)
            best = _softmax(raw / temperature)
            right = best.max(axis=1)[best.argmax(axis=1) == y]
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(right * 10_000) / 10_000)], names=["score"])

    table = judgements.mapInArrow(passed, "score double").groupBy("score").count().orderBy("score").collect()
    threshold, before = 0.0, 0
    for score, count in table:
        threshold, before = min(0.5, score), before + count
        if before > (1 - PASS) * sum(r["count"] for r in table):
            break
    return Model(model.labels, model.scores, model.bias, temperature, threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def raw_scores(text: str, model: Model) -> np.ndarray:
    """The mean class scores of a text's subwords."""
    total, n = np.zeros(len(model.labels)), 0
    for part in buckets(letters(text)):
        total += [own.take(part).sum(dtype=np.float64) for own in model.scores]
        n += len(part)
    return total / max(1, n) + model.bias


def predict_one(text: str | None, model: Model | None) -> tuple[str, float]:
    if model is None or text is None or not has_letter(text):
        return UNKNOWN, 0.0
    mean = raw_scores(text, model)
    probability = _softmax(mean[None, :] / model.temperature)[0]
    best = int(probability.argmax())
    return model.labels[best], float(probability[best])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred, score (calibrated, 0 to 1) and accepted."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def of(texts: pa.Array) -> pa.Array:
        found = [predict_one(t, shared.value) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [
                pa.array([f[0] for f in found], type=pa.string()),
                pa.array([f[1] for f in found], type=pa.float64()),
            ],
            names=["lang", "score"],
        )

    held = fresh(docs.columns, "_language")
    columns = docs.columns
    guessed = docs.withColumn(held, of(F.col("text")))
    threshold = model.threshold if model else 0.0
    accepted = (F.col(f"{held}.lang") != UNKNOWN) & (F.col(f"{held}.score") >= threshold)
    return guessed.select(
        *[F.col(f"`{c}`") for c in columns],
        F.col(f"{held}.lang").alias(fresh(columns, "lang_pred")),
        F.col(f"{held}.score").alias(fresh(columns, "score")),
        accepted.alias(fresh(columns, "accepted")),
    )


def remainder(divisor: int):
    """The checksum of doc_id as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def digest(docs: DataFrame) -> DataFrame:
    """One row per document; rows whose remainder by 5 is 0 are not learned from."""
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    model = train(docs, ~held_out)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return predict(rows, model).drop("text")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is told with enough certainty."""
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    model = train(docs, ~held_out)
    judged = predict(docs, model)
    accepted = judged.columns[-1]
    return judged.filter(F.col(accepted)).select(*[F.col(f"`{c}`") for c in docs.columns])
