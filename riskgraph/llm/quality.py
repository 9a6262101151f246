"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text is read as tokens: runs of letters and digits (with all non-ASCII
characters) and runs of other visible characters. Its features are hashed
n-grams of two streams: the lower-cased tokens (n = 1, 2) and their shapes (which
of lower case, upper case, digits, other; n = 1, 2, 3). A feature's value is its share of
the text's n-grams times ``SCALE``, so a score is a sparse dot product and long texts count as short ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.llm.text import BYTE, POWER, PRIME, U, WORD, chunks, mix

SCALE = 40.0
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.where(WORD, 1, 8).astype(np.uint8)  # bits: lower or non-ASCII, upper, digit, other
KIND[65:91] = 2
KIND[48:58] = 4


@dataclass(frozen=True)
class Params:
    """``max_rows`` bounds the labelled rows that the model is fitted on: the first by a hash of their id."""

    bits: int = 18
    max_rows: int = 8000
    epochs: int = 4
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.05
    threshold: float = 0.7


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All feature indices in text order, and how many each text has."""
    coded = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    bounds = np.cumsum([0] + [len(c) + 1 for c in coded])
    group = np.where(SPACE[data], 0, np.where(WORD[data], 1, 2)).astype(np.uint8)
    edge = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(data)]])
    seen = group[edge[:-1]] > 0
    starts, lengths = edge[:-1][seen], np.diff(edge)[seen]
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    inside = np.flatnonzero(group)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    raw = data[inside]
    words = mix(np.add.reduceat(BYTE[LOWER[raw]] * POWER[place & 4095], first))
    shape = np.bitwise_or.reduceat(KIND[raw], first).astype(U)
    shape = mix(shape * U(4) + np.minimum(lengths, 3).astype(U))
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.arange(len(words))
    out, place = [words, shape], [at, at]
    for stream, most in ((words, 2), (shape, 3)):
        h = stream
        for n in range(2, most + 1):
            h = h[: len(words) - n + 1] * PRIME + stream[n - 1 :]
            whole = at[: len(h)] + n <= ends[: len(h)]
            out.append(mix(h + U(n))[whole])
            place.append(at[: len(h)][whole])
    order = np.argsort(np.concatenate(place), kind="stable")
    index = (np.concatenate(out) >> U(64 - bits)).astype(np.int64)[order]
    total = sum(np.maximum(counts - n + 1, 0) for n in (1, 1, 2, 2, 3))
    return index, total


def sparse(index: np.ndarray, total: np.ndarray):
    """Each text's distinct feature indices and values."""
    for part in np.split(index, np.cumsum(total)[:-1]):
        at, many = np.unique(part, return_counts=True)
        yield at, many * (SCALE / max(1, len(part)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, p: Params) -> np.ndarray:
    """Weights of ``2**bits`` features and a bias (last), by per-coordinate FTRL-Proximal."""
    z, n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)
    bias = np.array([1 << p.bits])

    def weights(z, n):
        w = -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
        return np.where(np.abs(z) <= p.l1, 0.0, w)

    for epoch in range(p.epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, x = np.concatenate([rows[k][0], bias]), np.append(rows[k][1], 1.0)
            w = weights(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - labels[k]) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha * w
            n[at] += g * g
    return weights(z, n)


def fit(df: DataFrame, p: Params = Params(), text: str = "text", label: str = "label", order: str = "order") -> np.ndarray:
    """Weights learnt from the rows of ``df`` (label 0 or 1), in the order of column ``order``.

    ``df`` must be a bounded sample: one task holds its sparse features and
    returns at most ``2**bits + 1`` non-zero weights. Without rows all weights are 0 and every score is 0.5.
    """

    def extract(batches):
        for batch in batches:
            a, b, c = (batch.column(i).to_pylist() for i in range(3))
            for part, texts in chunks(list(zip(b, c)), a):
                for (y, o), (at, x) in zip(part, sparse(*features(texts, p.bits))):
                    yield pa.RecordBatch.from_pydict({"y": pa.array([y], pa.int32()), "o": pa.array([o], pa.int64()), "at": pa.array([at.astype(np.int32).tobytes()]), "x": pa.array([x.astype(np.float32).tobytes()])})

    def train(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: (r["o"], r["y"], r["at"]))
        w = ftrl([(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(float)) for r in rows], np.array([r["y"] for r in rows]), p)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at, pa.int32()), "w": pa.array(w[at])})

    sparse_rows = df.select(F.col(text), F.col(label).cast("int"), F.col(order).cast("long")).mapInArrow(extract, "y int, o bigint, at binary, x binary")
    learnt = sparse_rows.repartition(1).mapInArrow(train, "i int, w double").collect()
    w = np.zeros((1 << p.bits) + 1)
    for i, x in learnt:
        w[i] = x
    return w


def scores(texts: list[str], w: np.ndarray, bits: int) -> np.ndarray:
    index, total = features(texts, bits)
    dot = np.zeros(len(texts))
    some = total > 0
    if some.any():  # each text is summed by itself, so that equal texts have equal scores
        dot[some] = np.add.reduceat(w[index], (np.cumsum(total) - total)[some])
    dot = dot * (SCALE / np.maximum(total, 1)) + w[-1]
    return 1 / (1 + np.exp(-np.clip(dot, -30, 30)))


def score(df: DataFrame, w: np.ndarray, p: Params = Params(), text: str = "text") -> DataFrame:
    """``df`` with a last column ``score`` (0 to 1): one pass without a shuffle. An empty or null text gets the bias alone. An input column ``score`` is replaced."""
    held = df.sparkSession.sparkContext.broadcast(w.astype(np.float64))
    df = df.drop("score")
    names = df.columns
    at = names.index(text)

    def run(batches):
        for batch in batches:
            found = [scores(texts, held.value, p.bits) for _, texts in chunks([None] * len(batch), batch.column(at).to_pylist())]
            made = pa.array(np.concatenate(found) if found else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*names, "score"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())]))


def held_out(doc_id) -> F.Column:
    """Whether a row's label must not be learnt from: crc32 of the id's decimal text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """Text, label and order of at most ``max_rows`` labelled documents that are not held out.

    Labels other than 0 and 1 and rows without an id are passed over; of several labels of a
    document the smallest holds, and of several texts the smallest. The sample is of fixed size, so its ids are broadcast to the scan of the texts.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = usable.groupBy("doc_id").agg(F.min("quality").alias("label")).withColumn("order", F.xxhash64("doc_id"))
    ids = ids.orderBy("order", "doc_id").limit(p.max_rows)
    met = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"), F.min("order").alias("order")).select("text", "label", "order")


def classify(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 from the threshold on).

    Fits on ``training_sample`` and scores every whole text, repeated rows each
    for itself; only texts are inputs of a score. Input columns of these three names are replaced.
    """
    w = fit(training_sample(docs, labels, p), p)
    docs = docs.drop("held_out", "score", "predicted")
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"))), w, p).withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))
