"""Near-duplicate classes by ProbMinHash, banding and verification.

Texts are sets of five-word shingles weighted by 1 + ln of their counts. ProbMinHash
draws each shingle's arrivals as a Poisson process of its weight's rate and
deals them to registers; a register keeps the shingle that arrives first. A shingle stops
at the first arrival later than all registers hold. Two texts' registers agree with their probability
Jaccard. Bands of registers give candidates, which are verified by the exact Jaccard of the whole shingle sets.

Copies with the same words are one node. Within a bucket the nodes are verified against a pivot, not against each other; what
pivots leave open is settled exactly afterwards (``_open_pairs``), so that no pair of a bucket is lost and none is emitted twice.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.shared import components, cut, join_hot
from riskgraph.llm.text import PRIME, U, chunks, mix, shingle_hashes, word_hashes


@dataclass(frozen=True)
class Params:
    """Pairs are accepted by the Jaccard of their sets. Their registers agree with the probability Jaccard, which is 0.8 or
    more for a set Jaccard of 0.8 if shingles occur equally often in both, and then a pair shares no band with a probability of 1e-10;
    where counts differ it may be less: at a probability Jaccard of 0.6 a pair is missed with a probability of 4e-4.
    """

    words: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 3
    small: int = 32  # buckets of at most so many nodes have their open pairs verified without a bound


def weighted_shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (hash, count, text), each text's number of them, and the word hashes' (hash, count)."""
    words, counts = word_hashes(texts)
    hashes, many = shingle_hashes(words, counts, n)
    owner = np.repeat(np.arange(len(texts)), many)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(hashes)))
    return hashes[first], weight, owner[first], (words, counts), np.bincount(owner[first], minlength=len(texts))


def prob_minhash(hashes: np.ndarray, counts: np.ndarray, owner: np.ndarray, texts: int, m: int) -> np.ndarray:
    """Registers (texts, m): the shingle that arrives first. Texts without shingles keep 0.

    Arrival t of a shingle comes an exponential time of its weight's rate after
    arrival t - 1 and falls in a register drawn for it. Rounds draw twice as many
    arrivals each for the shingles whose last one came before the latest of its text's registers.
    """
    weight = 1 + np.log(counts)
    when, who = np.full(texts * m, np.inf), np.zeros(texts * m, U)
    active, clock, done, draw = np.arange(len(hashes)), np.zeros(len(hashes)), 0, 1
    while len(active):
        t = np.arange(done, done + draw, dtype=U)
        seed = mix(hashes[active][:, None] + (t * U(2) + U(1))[None, :] * U(0xD1B54A32D192ED03))
        gap = -np.log1p(-(seed >> U(11)).astype(np.float64) * 2.0**-53) / weight[active][:, None]
        arrival = clock[active][:, None] + np.cumsum(gap, 1)
        register = (mix(seed + U(0x9E3779B97F4A7C15)) % U(m)).astype(np.int64) + owner[active][:, None] * m
        clock[active] = arrival[:, -1]
        flat, at = arrival.ravel(), register.ravel()
        early = flat < when[at]
        flat, at, ids = flat[early], at[early], np.repeat(hashes[active], draw)[early]
        order = np.argsort(-flat, kind="stable")  # the earliest is written last and stays
        when[at[order]], who[at[order]] = flat[order], ids[order]
        latest = when.reshape(texts, m).max(1)
        active = active[clock[active] < latest[owner[active]]]
        done, draw = done + draw, draw * 2 if len(active) * draw < len(hashes) else draw
    return who.reshape(texts, m)


def _describe(p: Params):
    def run(batches):
        for batch in batches:
            at = 0
            for _, texts in chunks([None] * len(batch), batch.column(1).to_pylist()):
                hashes, weight, owner, (words, counts), n = weighted_shingles(texts, p.words)
                registers = prob_minhash(hashes, weight, owner, len(texts), p.bands * p.rows).reshape(len(texts), p.bands, p.rows)
                band = np.arange(1, p.bands + 1, dtype=U)[None, :] * U(0xA0761D6478BD642F)
                for j in range(p.rows):
                    band = mix(band * PRIME + registers[:, :, j])
                bands = [x.tobytes() for x in band]
                nodes = []
                for k, part in enumerate(np.split(words, np.cumsum(counts)[:-1])):
                    raw = part.tobytes() if len(part) else b"\0" + texts[k].encode("utf-8", "replace")
                    nodes.append(hashlib.blake2b(raw, digest_size=16).digest())
                keys = [np.frombuffer(b, np.int64) if n[k] else [] for k, b in enumerate(bands)]
                made = [pa.array(nodes, pa.binary()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)), *made], ["doc_id", "row", "node", "n", "bands"])
                at += len(texts)

    return run


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of two weighted sets (sorted hashes, counts): which of a's elements are in b, and where b has each."""
    (x, _), (y, _) = a, b
    at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
    return (y[at] == x) if len(y) else np.zeros(len(x), bool), at


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard of two sets."""
    common = int(overlap(a, b)[0].sum())
    return common / (len(a[0]) + len(b[0]) - common) if common else 0.0


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """What registers estimate: the probability that two weighted sets' first arrivals are of one element."""
    (x, v), (y, w) = a, b
    hit, at = overlap(a, b)
    v, w = v / v.sum(), w / w.sum()
    rest = np.ones(len(y), bool)
    rest[at[hit]] = False
    both = np.stack([np.concatenate([v[hit], v[~hit], np.zeros(rest.sum())]), np.concatenate([w[at[hit]], np.zeros((~hit).sum()), w[rest]])])
    return float(sum(1 / np.maximum(both[0] / i, both[1] / j).sum() for i, j in zip(v[hit], w[at[hit]])))


def _verify(p: Params):
    """Rows (a, b, sketch, a_text, b_text) to whether the pair reaches the threshold and, where ``sketch`` is set, what b differs from a in.

    ``n`` is the number of b's shingles; ``lacks`` and ``adds`` are the hashes of those that only a and only b has.
    """

    def run(batches):
        last: tuple = (None, None)
        for batch in batches:
            out = []
            for i in range(len(batch)):
                a, b, sketch = (batch.column(k)[i].as_py() for k in range(3))
                texts = [batch.column(4)[i].as_py() or ""] + ([] if last[0] == a else [batch.column(3)[i].as_py() or ""])
                hashes, weight, owner, _, n = weighted_shingles(texts, p.words)
                if last[0] != a:
                    last = (a, (hashes[n[0] :], weight[n[0] :]))
                own = (hashes[: n[0]], weight[: n[0]])
                row = {"a": a, "b": b, "similar": similarity(last[1], own) >= p.threshold}
                if sketch:
                    hit, at = overlap(last[1], own)
                    rest = np.ones(len(own[0]), bool)
                    rest[at[hit]] = False
                    row |= {"n": len(own[0]), "lacks": last[1][0][~hit].tobytes(), "adds": own[0][rest].tobytes()}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=_VERIFIED)

    return run


_VERIFIED = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similar", pa.bool_()), ("n", pa.int32()), ("lacks", pa.binary()), ("adds", pa.binary())])


def _verified(pairs: DataFrame, a: DataFrame, b: DataFrame, p: Params) -> DataFrame:
    """``pairs`` (a, b, sketch) as ``_verify`` sees them, with the texts (node, text) of either side. A frequent ``a`` is split by AQE's skew join."""
    met = pairs.join(b.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    met = met.join(a.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    return met.select("a", "b", "sketch", "a_text", "b_text").mapInArrow(_verify(p), "a binary, b binary, similar boolean, n int, lacks binary, adds binary")


def _open_pairs(buckets: DataFrame, labels: DataFrame, seen: DataFrame, p: Params) -> DataFrame:
    """The pairs of a bucket that its pivot left open: neither is the pivot and no links connect them yet.

    Buckets up to ``small`` nodes give all such pairs, a bounded multiple of their nodes. In larger
    ones what two nodes differ from the pivot in gives their intersection exactly: the pivot's shingles that neither
    lacks and those that both add. It is counted for blocks of nodes by matrix products, and of two components only the first
    pair of two blocks that reaches the threshold is given, so groups give few pairs and lose no link.
    """
    held = buckets.where("NOT pivot").join(labels, "node", "left").withColumn("label", F.coalesce("label", F.col("node")))
    split = held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    held = cut(held.join(split.select("key"), "key").select("key", "node", "label", "top", "size"))

    a, b = (held.where(F.col("size") <= p.small).select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("node", "label"))) for side in "ab")
    few = a.join(b, "key").where((F.col("a_node") < F.col("b_node")) & (F.col("a_label") != F.col("b_label"))).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    facts = seen.where("n IS NOT NULL").select(F.col("a").alias("top"), F.col("b").alias("node"), "n", "lacks", "adds")
    large = held.where(F.col("size") > p.small).select("top", "node", "label").distinct()
    parts = large.groupBy("top").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    large = large.join(facts, ["top", "node"]).join(parts, "top").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    blocks = large.groupBy("top", "block").applyInArrow(_pack, "top binary, block int, nodes array<binary>, labels array<binary>, sizes array<int>, lacks array<binary>, adds array<binary>")
    other = blocks.select("top", *(F.col(c).alias(f"b_{c}") for c in ("block", "nodes", "labels", "sizes", "lacks", "adds")))
    met = blocks.join(other, "top").where("block <= b_block").drop("top")
    many = met.mapInArrow(_compare(p), "a binary, b binary")
    return few.union(many).distinct().withColumn("sketch", F.lit(False))


BLOCK = 512
#: Open pairs up to which only the texts that they ask for are shuffled: their nodes are broadcast, 32 bytes a pair.
FEW = 200_000


def _pack(table: pa.Table) -> pa.Table:
    """One block of a large bucket's nodes and what they differ from their pivot in."""
    cells = {"top": table["top"][:1].to_pylist(), "block": table["block"][:1].to_pylist()}
    cells |= {to: [table[c].to_pylist()] for to, c in (("nodes", "node"), ("labels", "label"), ("sizes", "n"), ("lacks", "lacks"), ("adds", "adds"))}
    many = pa.list_(pa.binary())
    kinds = {"top": pa.binary(), "block": pa.int32(), "nodes": many, "labels": many, "sizes": pa.list_(pa.int32()), "lacks": many, "adds": many}
    return pa.table({c: pa.array(cells[c], k) for c, k in kinds.items()})


def _shared_counts(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many hashes each of ``a`` shares with each of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    x, y = (np.frombuffer(b"".join(s), np.uint64) for s in (a, b))
    common = np.intersect1d(x, y)
    place = [np.repeat(np.arange(len(s)), [len(c) // 8 for c in s]) for s in (a, b)]
    held = []
    for v, rows in ((x, place[0]), (y, place[1])):
        at = np.minimum(np.searchsorted(common, v), max(0, len(common) - 1))
        hit = common[at] == v if len(common) else np.zeros(len(v), bool)
        held.append((rows[hit], at[hit]))
    for low in range(0, len(common), 4096):
        dense = []
        for (rows, at), n in zip(held, out.shape):
            part = (at >= low) & (at < low + 4096)
            m = np.zeros((n, min(4096, len(common) - low)), np.float32)
            m[rows[part], at[part] - low] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _compare(p: Params):
    """Two blocks of one pivot to pairs that reach the threshold: the first of any two components."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n, m = np.array(r["sizes"]), np.array(r["b_sizes"])
                adds, lacks_b = np.array([len(x) // 8 for x in r["adds"]]), np.array([len(x) // 8 for x in r["b_lacks"]])
                # the pivot's size is n + what a node lacks - what it adds
                inner = (n - adds)[:, None] - lacks_b[None, :] + _shared_counts(r["lacks"], r["b_lacks"]) + _shared_counts(r["adds"], r["b_adds"])
                ids = {x: i for i, x in enumerate(dict.fromkeys(r["labels"] + r["b_labels"]))}
                one, two = (np.array([ids[x] for x in r[c]]) for c in ("labels", "b_labels"))
                x, y = np.nonzero((inner / (n[:, None] + m[None, :] - inner) >= p.threshold) & (one[:, None] != two[None, :]))
                first = np.unique(np.minimum(one[x], two[y]) * len(ids) + np.maximum(one[x], two[y]), return_index=True)[1]
                pairs = sorted({tuple(sorted((r["nodes"][i], r["b_nodes"][j]))) for i, j in zip(x[first], y[first])})
                if pairs:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([q for q, _ in pairs], pa.binary()), "b": pa.array([q for _, q in pairs], pa.binary())})

    return run


def _linked(docs: DataFrame, p: Params, text: str, doc_id: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, row, node), nodes (node, many, at), links (a, b) between nodes and labels of linked nodes."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("text"))
    described = cut(rows.mapInArrow(_describe(p), "doc_id bigint, row bigint, node binary, n int, bands array<bigint>"))
    nodes = described.groupBy("node").agg(F.count("*").alias("many"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("at"))

    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    keyed = cut(keyed.join(shared, "key"))
    central = keyed.groupBy("node").agg(F.sum("size").alias("central"))
    pivots = keyed.join(central, "node").groupBy("key").agg(F.max(F.struct("central", "n", "node")).alias("top"))
    buckets = cut(keyed.join(pivots.select("key", F.col("top.node").alias("top")), "key").select("key", "node", "size", "top", (F.col("node") == F.col("top")).alias("pivot")))

    sides = buckets.groupBy("node").agg(F.bool_or("pivot").alias("is_a"), F.bool_or(~F.col("pivot")).alias("is_b"))
    wanted = sides.join(nodes.select("node", F.col("at.doc_id").alias("doc_id"), F.col("at.row").alias("row")), "node")
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["row"] == wanted["row"]))
    texts = cut(texts.groupBy("node").agg(F.first("text").alias("text"), F.first("is_a").alias("is_a"), F.first("is_b").alias("is_b")))
    pairs = buckets.where("NOT pivot").groupBy(F.col("top").alias("a"), F.col("node").alias("b")).agg((F.max("size") > p.small).alias("sketch"))
    seen = cut(_verified(pairs, texts.where("is_a"), texts.where("is_b"), p))  # a text goes only to the sides that ask for it
    links = seen.where("similar").select("a", "b")
    labels = components(links)
    left = cut(_open_pairs(buckets, labels, seen, p))
    asked = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if left.count() <= FEW:
        texts = texts.join(F.broadcast(asked), "node", "left_semi")
    more = cut(_verified(left, texts, texts, p).where("similar").select("a", "b"))
    if more.limit(1).count():
        links = links.union(more)
        labels = components(links)
    return described.select("doc_id", "row", "node"), nodes.select("node", "many", "at"), links, labels


def classes(docs: DataFrame, p: Params = Params(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``row`` (hash of the text), ``class_id``, ``class_size``, ``links`` and ``first`` for every row of ``docs``.

    ``class_id`` is the smallest id of the rows linked, directly or over others, by a
    similarity of at least the threshold or by having the same words in the same order. ``links`` are the pairs of different
    texts of the class that were found and verified (``pairs`` gives them; they connect the whole class). ``first`` marks one row per class: one with that
    id. Null texts are empty; texts without words are alike only if equal. A text of fewer words than a shingle has one shingle, of all its words.
    Null ids come after all others. Repeated rows are rows of one class. Other columns of ``docs`` are ignored, whatever their names; an
    empty table has no rows.
    """
    members, nodes, links, labels = _linked(docs, p, text, doc_id)
    labelled = cut(nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", F.col("node"))))
    linked = links.join(labels, F.col("a") == F.col("node")).groupBy("label").agg(F.count("*").alias("links"))
    least = labelled.groupBy("label").agg(F.count("*").alias("texts"), F.min("at").alias("first_at"), F.sum("many").alias("class_size"))
    least = cut(least.join(linked, "label", "left").withColumn("links", F.coalesce("links", F.lit(0))))
    of_node = join_hot(labelled.select("node", "many", "label"), least, "label", "texts").drop("label")
    met = join_hot(members, cut(of_node), "node", "many")
    first = F.col("doc_id").eqNullSafe(F.col("first_at.doc_id")) & (F.col("row") == F.col("first_at.row"))
    return met.select("doc_id", "row", F.col("first_at.doc_id").alias("class_id"), "class_size", "links", first.alias("first"))


def pairs(docs: DataFrame, p: Params = Params(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``a_id`` and ``b_id``: verified pairs of different texts, each by its row of the smallest id. With ``classes`` they give all membership."""
    _, nodes, links, _ = _linked(docs, p, text, doc_id)
    ids = nodes.select("node", F.col("at.doc_id").alias("id"))
    met = links.join(ids.withColumnsRenamed({"node": "a", "id": "a_id"}), "a").join(ids.withColumnsRenamed({"node": "b", "id": "b_id"}), "b")
    return met.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"))


def deduplicate(docs: DataFrame, p: Params = Params(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that come first in their class, one per class, with all columns."""
    # ids as plain keys, so that rows of one id and text lie together for the join and for what makes them one: texts are shuffled once
    key = ["__none", "__id", "__text_hash"]
    place = lambda c: {"__none": c.isNull(), "__id": F.coalesce(c, F.lit(0).cast("long"))}
    kept = classes(docs, p, text, doc_id).where("first").withColumns(place(F.col("doc_id"))).withColumn("__text_hash", F.col("row")).select(*key).distinct()
    keyed = docs.withColumns(place(F.col(doc_id).cast("long"))).withColumn("__text_hash", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return keyed.join(kept, key, "left_semi").dropDuplicates([*key, doc_id]).select(*docs.columns)
