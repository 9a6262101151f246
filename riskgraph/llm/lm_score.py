"""Stupid-backoff scores under a bigram model counted over the whole corpus.

A word after another one scores c(v w) / c(v) if the pair's count reaches ``min_count``,
else ``backoff`` * c(w) / N; a document's first word scores c(w) / N. Logs are taken in
millionths and rounded, so that sums are exact whatever their order.

Documents are exploded to their distinct pairs, which are dealt to the partitions of the count table by
hash, as packed columns: pairs by their first word, so that its pairs sum to its own
count. The counts of the most frequent words are known beforehand, and their pairs are dealt by both words, so that
no word's pairs meet in one task. Pairs of two common words are counted before they meet the documents and never dealt: as a pair
is no more frequent than its words, none that is left holds more than 1 / ``common`` of all tokens. Words that are backed off to are dealt once more, to their own counts. Scores are summed per document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.shared import by_bucket, cut, joined, pack, runs, split_by, tagged, take, unpack
from riskgraph.llm.text import U, chunks, mix, word_hashes

NO_ID = 2**63 - 1
HELD = 1 << 22  # characters whose pairs a task gathers before it sends them
RARE = U(1 << 63)  # marks the code of a word outside the frequent ones: 63 bits of its hash
START, END = U(1 << 62), U((1 << 62) + 1)  # stand for the second word: v opens, or closes, its document
PAIR = (("v", "<u8"), ("w", "<u8"), ("id", "<i8"), ("tag", "<i8"), ("m", "<u4"))
ASK = (("w", "<u8"), ("id", "<i8"), ("tag", "<i8"), ("m", "<u4"))
COUNT = (("w", "<u8"), ("c", "<i8"))
SUM = (("id", "<i8"), ("tag", "<i8"), ("s", "<i8"), ("n", "<i8"))


@dataclass(frozen=True)
class Params:
    """``frequent`` and ``common`` bound what all tasks get: the counts of words of at least 1 / ``frequent`` of all tokens, and of the pairs
    of two words of at least 1 / ``common`` each, of which there can't be more than ``common`` squared. They change no result.
    """

    min_count: int = 2
    backoff: float = 0.4
    frequent: int = 300_000
    common: int = 1000


def log(c) -> np.ndarray:
    """ln in millionths."""
    return np.rint(1e6 * np.log(c)).astype(np.int64)


def unigrams(docs: DataFrame, text: str) -> DataFrame:
    """``h`` and ``c``: the count of every word of the corpus, by its hash. Tasks count before the shuffle."""

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def send():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"h": pa.array(h.astype(np.int64)), "c": pa.array(c.astype(np.int64))})

        for batch in batches:
            for _, texts in chunks([None] * len(batch), batch.column(0).to_pylist()):
                held.append(word_hashes(texts)[0])
                size += len(held[-1])
                if size > HELD:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    return docs.select(text).mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


class Frequent:
    """The frequent words' codes (their place in the order of hashes) and counts."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, common: int = 0):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.total = hashes[order], counts[order], total
        self.logs, self.log_total = log(self.counts), int(log(max(1, total)))
        chosen = np.flatnonzero(self.counts * common >= max(1, total))
        self.dense = np.full(len(self.hashes) + 1, -1)  # the common words' places in the table of their pairs; the last is for all other words
        self.dense[chosen] = np.arange(len(chosen))
        self.pairs = np.zeros((len(chosen), len(chosen)), np.int64)

    def places(self, code: np.ndarray) -> np.ndarray:
        """Of codes, the places in ``pairs``, -1 for words that aren't common."""
        return self.dense[np.minimum(code, U(len(self.hashes))).astype(np.int64)]

    def codes(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return h | RARE
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at.astype(U), h | RARE)


def common_pairs(docs: DataFrame, text: str, known) -> DataFrame:
    """``at`` (place of the first word times the number of common words, plus that of the second) and ``c`` of the pairs of common words. Tasks count before the shuffle."""

    def run(batches):
        frequent = known.value
        n = len(frequent.pairs)
        found = np.zeros(n * n, np.int64)
        for batch in batches:
            for _, texts in chunks([None] * len(batch), batch.column(0).to_pylist()):
                words, counts = word_hashes(texts)
                place = frequent.places(frequent.codes(words))
                inner = np.ones(len(words), bool)
                inner[np.cumsum(counts)[counts > 0] - 1] = False
                v = np.flatnonzero(inner)
                v = v[(place[v] >= 0) & (place[v + 1] >= 0)]
                at, many = np.unique(place[v] * n + place[v + 1], return_counts=True)
                found[at] += many
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "c": pa.array(found[at], pa.int64())})

    return docs.select(text).mapInArrow(run, "at bigint, c bigint").groupBy("at").agg(F.sum("c").alias("c"))


def _home(code: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(code) % U(buckets)).astype(np.int64)


def _summed(s: dict) -> dict:
    """SUM rows, one per document."""
    order = np.lexsort((s["tag"], s["id"]))
    s = take(s, order)
    start = np.flatnonzero(runs(s["id"], s["tag"]))
    if not len(start):
        return s
    return {"id": s["id"][start], "tag": s["tag"][start], "s": np.add.reduceat(s["s"], start), "n": np.add.reduceat(s["n"], start)}


def _scored(r: dict, s: np.ndarray) -> dict:
    m = r["m"].astype(np.int64)
    return {"id": r["id"], "tag": r["tag"], "s": s * m, "n": m}


def _pairs(buckets: int, known, p: Params):
    """Documents (id, tag, text) to rows (bucket, pairs, sums)."""

    def explode(ids, tags, texts, frequent: Frequent):
        words, counts = word_hashes(texts)
        code = frequent.codes(words)
        doc = np.repeat(np.arange(len(texts)), counts)
        ends = np.cumsum(counts)[counts > 0] - 1
        starts = ends + 1 - counts[counts > 0]
        inner = np.ones(len(code), bool)
        inner[ends] = False
        v, d = code[inner], doc[inner]
        w = code[np.flatnonzero(inner) + 1]
        order = np.lexsort((w, v, d))
        v, w, d = v[order], w[order], d[order]
        first = np.flatnonzero(runs(v, w, d))
        m = np.diff(np.append(first, len(v)))
        v, w, d = v[first], w[first], d[first]
        a, b = frequent.places(v), frequent.places(w)
        both = (a >= 0) & (b >= 0)
        pair, one, two = frequent.pairs[a[both], b[both]], v[both].astype(np.int64), w[both].astype(np.int64)
        seen = pair >= p.min_count
        scored = np.where(seen, log(np.maximum(pair, 1)) - frequent.logs[one], frequent.logs[two] - frequent.log_total + int(log(p.backoff))) if len(one) else np.zeros(0, np.int64)
        scored, times, owner = scored * m[both], m[both], d[both]
        v, w, d, m = v[~both], w[~both], d[~both], m[~both]
        rare = code >= RARE
        open_, close = starts[rare[starts]], ends[rare[ends]]
        v = np.concatenate([v, code[open_], code[close]])
        w = np.concatenate([w, np.full(len(open_), START), np.full(len(close), END)])
        d = np.concatenate([d, doc[open_], doc[close]])
        m = np.concatenate([m, np.ones(len(open_) + len(close), np.int64)])
        easy = starts[~rare[starts]]
        ids, tags = np.array(ids, np.int64), np.array(tags, np.int64)
        logs = frequent.logs[code[easy].astype(np.int64)] - frequent.log_total if len(easy) else np.zeros(0, np.int64)
        owner = np.concatenate([doc[easy], owner])
        sums = {"id": ids[owner], "tag": tags[owner], "s": np.concatenate([logs, scored]), "n": np.concatenate([np.ones(len(easy), np.int64), times])}
        return {"v": v, "w": w, "id": ids[d], "tag": tags[d], "m": m}, sums

    def send(held, sums):
        s = joined(held, PAIR)
        home = np.where(s["v"] >= RARE, _home(s["v"], buckets), _home(s["v"] * U(1 << 20) + s["w"], buckets))
        # like sizes of codes side by side, then documents: columns compress best so
        order = np.lexsort((s["tag"], s["id"], s["w"] >= RARE, s["v"] >= RARE, home))
        s, home = take(s, order), home[order]
        edge = np.searchsorted(home, np.arange(buckets + 1))
        done = pack(_summed(joined(sums, SUM)), SUM)
        for b in np.flatnonzero(np.diff(edge)):
            yield int(b), pack(take(s, slice(edge[b], edge[b + 1])), PAIR), None
        yield int(home[0]) if len(home) else 0, None, done

    def rows(batches):
        frequent, held, sums, size = known.value, [], [], 0
        for batch in batches:
            for part, texts in chunks(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), batch.column(2).to_pylist()):
                a, b = explode([i for i, _ in part], [t for _, t in part], texts, frequent)
                held.append(a)
                sums.append(_summed(b))
                size += sum(map(len, texts))
                if size >= HELD:
                    yield from send(held, sums)
                    held, sums, size = [], [], 0
        if held:
            yield from send(held, sums)

    def run(batches):
        for bucket, pairs, done in rows(batches):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "pairs": pa.array([pairs], pa.binary()), "sums": pa.array([done], pa.binary())})

    return run


def resolve(s: dict, frequent: Frequent, p: Params) -> tuple[dict, dict, dict]:
    """One bucket's pairs to scores, words that are backed off to (ASK), and the counts of its rare words."""
    s = take(s, np.lexsort((s["w"], s["v"])))
    m = s["m"].astype(np.int64)
    new = runs(s["v"], s["w"])
    pair = np.add.reduceat(m, np.flatnonzero(new))[np.cumsum(new) - 1] if len(m) else m
    new = runs(s["v"])
    word = np.add.reduceat(m * (s["w"] != START), np.flatnonzero(new)) if len(m) else m
    names, rare = s["v"][new], s["v"][new] >= RARE
    counts = {"w": names[rare], "c": word[rare]}
    own = word[np.cumsum(new) - 1] if len(m) else m
    if len(frequent.counts):
        own = np.where(s["v"] < RARE, frequent.counts[np.minimum(s["v"], U(len(frequent.counts) - 1)).astype(np.int64)], own)
    opens, closes = s["w"] == START, s["w"] == END
    seen = ~opens & ~closes & (pair >= p.min_count)
    back = ~opens & ~closes & ~seen
    easy = back & (s["w"] < RARE)
    low = int(log(p.backoff)) - frequent.log_total
    parts = [(opens, log(own[opens]) - frequent.log_total), (seen, log(pair[seen]) - log(own[seen]))]
    if easy.any():
        parts.append((easy, frequent.logs[s["w"][easy].astype(np.int64)] + low))
    sums = _summed(joined([_scored(take(s, which), x) for which, x in parts], SUM))
    ask = back & ~easy
    return sums, {c: s[c][ask] for c, _ in ASK}, counts


def score(docs: DataFrame, p: Params = Params(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``score`` (millionths of nats) and ``per_token`` (nats) of every row's whole text.

    Counts are over all rows of ``docs``, repeated ones included. A text without words, or a null one,
    scores 0 and its ``per_token`` is null. Null ids are kept; rows of one id and text are scored each for itself, and
    rows of one id and other texts are told apart by a 64-bit hash of the text. Other columns
    of ``docs`` are ignored, whatever their names; an empty table has no rows.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = 4 * parts
    rows = docs.select(F.col(doc_id), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("__id"), F.col(text).cast("string").alias("__text"))
    rows, _ = tagged(rows, "__id", "__text")
    counts = cut(unigrams(rows, "__text"))
    total = counts.agg(F.sum("c")).first()[0] or 0
    top = counts.where(F.col("c") * p.frequent >= max(1, total)).toArrow()
    frequent = Frequent(top["h"].to_numpy().astype(U), top["c"].to_numpy(), total, p.common)
    pairs = common_pairs(rows, "__text", spark.sparkContext.broadcast(frequent)).toArrow()
    frequent.pairs.reshape(-1)[pairs["at"].to_numpy()] = pairs["c"].to_numpy()
    known = spark.sparkContext.broadcast(frequent)

    def row(bucket: int, **cells):
        kinds = {"ask": None, "counts": None, "sums": None} | cells
        return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32())} | {c: pa.array([v], pa.binary()) for c, v in kinds.items()})

    def send_sums(sums: list[dict]):
        done = _summed(joined(sums, SUM))
        for b, part in split_by(_home(done["id"].astype(U) ^ mix(done["tag"].astype(U)), parts), parts, done):
            yield row(b, sums=pack(part, SUM))

    def count():
        asks, sums = [], []

        def send():
            ask = joined(asks, ASK)
            ask = take(ask, np.lexsort((ask["tag"], ask["id"])))
            for b, part in split_by(_home(ask["w"], buckets), buckets, ask):
                yield row(b, ask=pack(part, ASK))
            yield from send_sums(sums)
            asks.clear()
            sums.clear()

        def one(bucket, cells):
            found, ask, own = resolve(joined([unpack(x, PAIR) for x in cells["pairs"]], PAIR), known.value, p)
            yield row(bucket, counts=pack(own, COUNT))
            asks.append(ask)
            sums.append(_summed(joined([found, *(unpack(x, SUM) for x in cells["sums"])], SUM)))
            if sum(len(x["w"]) for x in asks) + sum(len(x["id"]) for x in sums) > HELD:
                yield from send()

        return one, send

    def back_off():
        sums = []

        def send():
            yield from send_sums(sums)
            sums.clear()

        def one(bucket, cells):
            ask, own = (joined([unpack(x, k) for x in cells[c]], k) for c, k in (("ask", ASK), ("counts", COUNT)))
            own = take(own, np.argsort(own["w"]))
            c = own["c"][np.searchsorted(own["w"], ask["w"])] if len(ask["w"]) else np.ones(0, np.int64)
            found = _scored(ask, log(c) + int(log(p.backoff)) - known.value.log_total)
            sums.append(_summed(joined([found, *(unpack(x, SUM) for x in cells["sums"])], SUM)))
            if sum(len(x["id"]) for x in sums) > HELD:
                yield from send()

        return one, send

    def documents(bucket, cells):
        done = _summed(joined([unpack(x, SUM) for x in cells["sums"]], SUM))
        yield pa.RecordBatch.from_pydict({"__id": pa.array(done["id"]), "__tag": pa.array(done["tag"]), "s": pa.array(done["s"]), "n": pa.array(done["n"])})

    dealt = "bucket int, ask binary, counts binary, sums binary"
    sent = rows.select("__id", "__tag", "__text").mapInArrow(_pairs(buckets, known, p), "bucket int, pairs binary, sums binary")
    asked = by_bucket(sent, parts, None, dealt, count)
    backed = by_bucket(asked, parts, None, dealt, back_off).select("bucket", "sums")
    summed = by_bucket(backed, parts, documents, "__id bigint, __tag bigint, s bigint, n bigint")
    # rows of one id and text were summed together, null ids with those of NO_ID: each gets its share
    alike = rows.groupBy("__id", "__tag").agg(F.count("*").alias("many"), F.count_if(F.col(doc_id).isNull()).alias("nulls"), F.max(doc_id).alias(doc_id))
    met = alike.join(summed, ["__id", "__tag"], "left").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("many"))))
    met = met.select(F.when(F.col("k") > F.col("nulls"), F.col(doc_id)).alias(doc_id), F.expr("coalesce(n, 0) div many").alias("n_tokens"), F.expr("coalesce(s, 0) div many").alias("score"))
    return met.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens") / F.lit(1e6)))
