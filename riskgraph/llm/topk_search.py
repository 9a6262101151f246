"""Exact top-k by inner product: a KD-tree per shard, searched best first.

Vectors are dealt to shards of bounded size by a hash of their id. Each shard's
tree splits at the median of its widest dimension and keeps the tight bounding box of every
node; a box's largest possible inner product with a query bounds its subtree. A query
first searches its home shard; its k-th score there goes with it to all other
shards and cuts off every box that can't reach it.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.llm.shared import cut

SHARD_ROWS = 4096
LEAF_ROWS = 256
BLOCK_QUERIES = 256


def quantised(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``vec_id``, ``dim`` and ``vec``, the int64 components floor(scale * x). Rows whose id or vector is null, or whose vector holds a null or non-finite component, are left out."""

    def run(batches):
        for batch in batches:
            ids, dims, vecs = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not v.is_valid:
                    continue
                x = v.values
                if x.null_count:
                    continue
                x = x.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                ids.append(i)
                dims.append(len(x))
                vecs.append(np.floor(scale * x).astype("<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "dim": pa.array(dims, pa.int32()), "vec": pa.array(vecs, pa.binary())})

    return df.select(F.col(vec_id).cast("long"), F.col(vector)).mapInArrow(run, "vec_id bigint, dim int, vec binary")


def _matrix(cells, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<i8").reshape(-1, dim)


def build_tree(x: np.ndarray, leaf: int = LEAF_ROWS):
    """Row order, and for each node its first and last row, children (-1: leaf) and box."""
    order = np.arange(len(x))
    spans, children, low, high = [], [], [], []

    def grow(a: int, b: int) -> int:
        own, part = len(spans), x[order[a:b]]
        lo, hi = (part.min(0), part.max(0)) if x.shape[1] else (np.zeros(0), np.zeros(0))
        spans.append((a, b))
        children.append((-1, -1))
        low.append(lo)
        high.append(hi)
        if b - a > leaf and x.shape[1] and (hi > lo).any():
            axis, middle = int(np.argmax(hi - lo)), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], middle)]
            children[own] = (grow(a, a + middle), grow(a + middle, b))
        return own

    grow(0, len(x))
    return order, np.array(spans), np.array(children), np.array(low), np.array(high)


def search(x: np.ndarray, ids: np.ndarray, spans, children, low, high, queries: np.ndarray, own: np.ndarray, k: int, bounds: np.ndarray):
    """For each query the (score, id) arrays of its k best rows with a score of at least its bound, own id excluded; ties go to smaller ids."""
    if max(1, x.shape[1]) * float(np.abs(x).max(initial=0)) * float(np.abs(queries).max(initial=0)) < 2**52:
        x, queries, low, high = (v.astype(np.float64) for v in (x, queries, low, high))  # exact, and in BLAS
    limits = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    for q, me, limit, bound in zip(queries, own, limits, bounds):
        best, best_ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        heap = [(-limit[0], 0)]
        while heap:
            reach, node = heapq.heappop(heap)
            if -reach < bound:
                break
            if children[node][0] >= 0:
                for c in children[node]:
                    if limit[c] >= bound:
                        heapq.heappush(heap, (-limit[c], int(c)))
                continue
            a, b = spans[node]
            s = x[a:b] @ q
            good = np.flatnonzero((s >= bound) & (ids[a:b] != me))
            if not len(good):
                continue
            best, best_ids = np.concatenate([best, s[good].astype(np.int64)]), np.concatenate([best_ids, ids[a:b][good]])
            if len(best) >= k:
                first = np.lexsort((best_ids, -best))[:k]
                best, best_ids = best[first], best_ids[first]
                bound = max(bound, best[-1])
        yield best, best_ids


_TREE = "dim int, shard int, ids binary, vecs binary, spans binary, children binary, low binary, high binary"
_LEAST = -(2**62)


def _grow(table: pa.Table) -> pa.Table:
    dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
    ids = table["vec_id"].to_numpy()
    x = _matrix(table["vec"].to_pylist(), dim) if dim else np.zeros((len(ids), 0), np.int64)
    order, spans, children, low, high = build_tree(x)
    cells = [ids[order].astype("<i8"), x[order], spans.astype("<i8"), children.astype("<i8"), low.astype("<i8"), high.astype("<i8")]
    names = ["ids", "vecs", "spans", "children", "low", "high"]
    return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32())} | {n: pa.array([c.tobytes()], pa.binary()) for n, c in zip(names, cells)})


def _find(k: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                cells = {n: np.frombuffer(r[n], "<i8") for n in ("ids", "vecs", "spans", "children", "low", "high", "q_ids", "q_vecs", "q_bounds")}
                many, n = len(cells["q_ids"]), len(cells["ids"])
                found = search(cells["vecs"].reshape(n, dim), cells["ids"], cells["spans"].reshape(-1, 2), cells["children"].reshape(-1, 2), cells["low"].reshape(-1, dim), cells["high"].reshape(-1, dim), cells["q_vecs"].reshape(many, dim), cells["q_ids"], k, cells["q_bounds"])
                rows = [(np.full(len(s), q), i, s) for q, (s, i) in zip(cells["q_ids"], found)]
                a, b, c = (np.concatenate(z) if rows else np.zeros(0, np.int64) for z in (list(zip(*rows)) or [(), (), ()]))
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64())})

    return run


def _pack(table: pa.Table) -> pa.Table:
    cells = {"q_ids": table["vec_id"].to_numpy().astype("<i8").tobytes(), "q_vecs": b"".join(table["vec"].to_pylist()), "q_bounds": table["bound"].to_numpy().astype("<i8").tobytes()}
    return pa.table({"dim": pa.array([table["dim"][0].as_py()], pa.int32()), "part": pa.array([table["part"][0].as_py()], pa.int32())} | {n: pa.array([c], pa.binary()) for n, c in cells.items()})


_PACK = "dim int, part int, q_ids binary, q_vecs binary, q_bounds binary"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's k best vectors.

    Both inputs come from ``quantised``; scores must fit a long. Candidates are the
    vectors of the query's dimension with another ``vec_id``; repeated candidate rows
    each count, and of queries with one id the smallest vector counts. Ties go to the smaller id.
    A query without candidates has no row; an empty table gives none.

    Shards hold about SHARD_ROWS rows whatever the data, and queries travel in
    blocks of about BLOCK_QUERIES to each shard; so a task holds one shard and one block.
    """
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    home = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).cast("int")
    trees = cut(vectors.withColumn("shard", home).groupBy("dim", "shard").applyInArrow(_grow, _TREE))
    asked = queries.groupBy("vec_id").agg(F.min("vec").alias("vec"), F.min_by("dim", "vec").alias("dim")).withColumn("home", home)
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))

    at_home = asked.withColumn("bound", F.lit(_LEAST)).withColumn("part", F.col("home"))
    at_home = at_home.groupBy("dim", "part").applyInArrow(_pack, _PACK).withColumn("shard", F.col("part"))
    found = "query_id bigint, vec_id bigint, score bigint"
    tree_columns = [c.split()[0] for c in _TREE.split(", ")]
    first = trees.join(at_home, ["dim", "shard"]).select(*tree_columns, "q_ids", "q_vecs", "q_bounds").mapInArrow(_find(k), found)

    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    bounded = asked.join(kth, asked.vec_id == kth.query_id, "left").withColumn("bound", F.coalesce("kth", F.lit(_LEAST)))
    blocked = bounded.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("dim", "part").applyInArrow(_pack, _PACK)
    sent = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    every = trees.join(sent, ["dim", "shard"]).select(*tree_columns, "q_ids", "q_vecs", "q_bounds").mapInArrow(_find(k), found)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
