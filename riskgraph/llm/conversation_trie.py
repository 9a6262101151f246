"""The trie of all conversations' prefixes, from double-array tries of prefix shards.

A turn is told by 128 bits of the SHA-256 of its role and text, a prefix by the exclusive or of 128 bits of each of
its turns and their depths, so a prefix's key can be continued from any place of a conversation. Conversations
travel in segments of ``segment`` turns at most, so no row, group or task holds an unbounded one.

Equal segments are counted first. The distinct ones are dealt by ranges of their turns, so a shard holds neighbours
in the trie whatever the number of conversations that share a prefix. A shard packs its nodes over dense turn ids into
BASE and CHECK, and all its segments walk these arrays side by side to add up their nodes. The nodes that several
shards share are then merged by their keys.

What a subtree adds up comes without rounds: a node belongs to its smallest member, whose nodes are the tail of its
path. Each conversation's tail is summed, and its sum is added to the nodes of its path before the tail.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskgraph.llm.double_array import pack
from riskgraph.llm.shared import cut, join_hot
from riskgraph.llm.text import U, mix

SEGMENT = 256  # turns
SHARD = 50_000  # turns that are packed into one double array
CHUNK = 4096  # conversation ids in a row
ROOT = bytes(16)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, at, digest, n_bytes``: turns in order, by ranges, so that a conversation of any length lies in many partitions.

    ``at`` counts the rows of a partition. Rows of one turn number come in the order of their digests.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = ("conv_id", "turn", "digest")  # nulls come first
    dealt = rows.repartitionByRange(_parts(rows), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return cut(dealt.select("conv_id", F.shiftright("at", 33).alias("part"), "at", "digest", "n_bytes"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, d, digest, n_bytes``, each conversation after its rebuilding, and ``conv_id, length`` of all conversations."""
    by_part = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"), F.sum("n").over(whole).alias("own"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = by_part.groupBy("conv_id").agg(F.first("own").alias("own")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 5})
    family = Window.partitionBy("base")  # the conversations of one base: nine at most
    there = F.coalesce(F.max(F.when(F.col("conv_id") == F.col("base"), F.col("own"))).over(family), F.lit(0))
    convs = convs.withColumn("head", F.least("h", there)).withColumn("length", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = cut(convs.select("conv_id", "h", "head", "length", F.when(F.col("conv_id") == F.col("base"), F.collect_list(F.struct("conv_id", "h")).over(family)).alias("family")))
    placed = turns.join(by_part.select("conv_id", "part", "shift").join(convs, "conv_id"), ["conv_id", "part"]).withColumn("pos", F.col("at") + F.col("shift"))
    own = F.when(F.col("pos") > F.col("h"), F.array(F.struct("conv_id", (F.col("head") + F.col("pos") - F.col("h")).alias("d"))))
    given = F.when(F.col("pos") <= 8, F.transform(F.filter("family", lambda c: c["h"] >= F.col("pos")), lambda c: F.struct(c["conv_id"].alias("conv_id"), F.col("pos").alias("d"))))
    kind = "array<struct<conv_id:bigint,d:bigint>>"
    to = F.explode(F.concat(*(F.coalesce(x.cast(kind), F.array().cast(kind)) for x in (own, given))))
    return placed.select(to.alias("to"), "digest", "n_bytes").select("to.*", "digest", "n_bytes"), convs.select("conv_id", "length")


def _bits(digests: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """128 bits of each turn (two words of its digest) at its depth."""
    d = depth.astype(U)
    return np.stack([mix(digests[:, 0] ^ mix(d * U(0x9E3779B97F4A7C15))), mix(digests[:, 1] ^ mix(d * U(0xBF58476D1CE4E5B9) + U(1)))], 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U).view(np.int64))


def _packed(batches, segment):
    """A segment's turns as bytes, with the exclusive or of their bits."""
    for batch in batches:
        conv, seg, lists = batch.columns
        out = []
        for s, row in zip(seg.to_pylist(), lists):
            digests, sizes = row.values.field(1).to_pylist(), row.values.field(2).to_numpy(zero_copy_only=False)
            turns = b"".join(digests)
            words = np.frombuffer(turns, ">u8").astype(U).reshape(-1, 2)
            x = np.bitwise_xor.reduce(_bits(words, s * segment + 1 + np.arange(len(words))), 0)
            out.append((turns, sizes.astype("<i8").tobytes(), len(words), *x))
        turns, sizes, n, x, y = zip(*out) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays([conv, seg, pa.array(turns, pa.binary()), pa.array(sizes, pa.binary()), pa.array(n, pa.int64()), _signed(np.array(x, U)), _signed(np.array(y, U))], ["conv_id", "seg", "turns", "sizes", "n", "x", "y"])


def segments(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv_id, seg, turns, sizes, x, y, r, s, many, last``: (r, s) is the key of what stands before the segment; many: more than one may be."""
    seg = F.floor((F.col("d") - 1) / segment).cast("long")
    grouped = turns.groupBy("conv_id", seg.alias("seg")).agg(F.sort_array(F.collect_list(F.struct("d", "digest", "n_bytes"))).alias("turns"))
    made = cut(grouped.mapInArrow(lambda batches: _packed(batches, segment), "conv_id bigint, seg bigint, turns binary, sizes binary, n bigint, x bigint, y bigint"))
    full = (F.col("seg") > 0) | (F.col("n") == segment)
    order = Window.partitionBy("conv_id").orderBy("seg")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero, columns = F.lit(0).cast("long"), ("conv_id", "seg", "turns", "sizes", "x", "y")
    one = made.where(~full).select(*columns, zero.alias("r"), zero.alias("s"), F.lit(False).alias("many"), F.lit(True).alias("last"))
    more = made.where(full).select(*columns, F.coalesce(F.bit_xor("x").over(before), zero).alias("r"), F.coalesce(F.bit_xor("y").over(before), zero).alias("s"), F.lit(True).alias("many"), F.lead("seg").over(order).isNull().alias("last"))
    return one.union(more)


def _key(a: Column, b: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _paths(words: np.ndarray, root: np.ndarray, before: int) -> list[bytes]:
    """The keys of the prefixes of turns that come after ``before`` others."""
    keys = np.bitwise_xor.accumulate(np.concatenate([root[None], _bits(words, before + 1 + np.arange(len(words)))]), 0)[1:]
    raw = keys.astype(">u8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def _first_seen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ids of pairs of words, in the order in which the pairs are first seen."""
    order = np.lexsort((np.arange(len(a)), b, a))
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    group = np.cumsum(fresh) - 1
    rank = np.empty(int(group[-1]) + 1, np.int64)
    rank[np.argsort(order[fresh])] = np.arange(len(rank))
    out = np.empty(len(a), np.int64)
    out[order] = rank[group]
    return out


def shard(rows: list[tuple], segment: int = SEGMENT) -> tuple[list, list]:
    """Node rows (key, parent's key, depth, bytes, members, smallest member) of one shard, and (smallest member, keys) of its whole conversations.

    ``rows`` are distinct (r, s, seg, turns, sizes, conv_id, members, many). Below a node for each distinct beginning
    (r, s, seg) hang the turns, whose dense ids are given in the order of depth and row.
    """
    words = [np.frombuffer(row[3], ">u8").astype(U).reshape(-1, 2) for row in rows]
    length = np.array([len(w) for w in words])
    start, row_of = np.cumsum(length) - length, np.repeat(np.arange(len(rows)), length)
    flat, sizes = np.concatenate(words), np.concatenate([np.frombuffer(row[4], "<i8") for row in rows])
    level = np.arange(len(flat)) - start[row_of]
    order = np.lexsort((row_of, level))
    ids = np.empty(len(flat), np.int64)
    ids[order] = _first_seen(flat[order, 0], flat[order, 1])
    roots = np.array([row[:2] for row in rows], np.int64).view(U)
    seg = np.array([row[2] for row in rows], np.int64)
    beginnings: dict[tuple, int] = {}
    first = np.array([beginnings.setdefault(row[:3], len(beginnings)) for row in rows])
    key = _bits(flat, seg[row_of] * segment + 1 + level)

    parents, labels, depth, nbytes, keys, above = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [], [], [], []
    made = len(beginnings)
    parents.append(np.zeros(made, np.int64))
    labels.append(np.arange(made))
    node, now, count = 1 + first, roots.copy(), 1 + made
    for k in range(int(length.max())):
        active = np.flatnonzero(length > k)
        at = start[active] + k
        _, one, back = np.unique(node[active] * (len(flat) + 1) + ids[at], return_index=True, return_inverse=True)
        above.append(now[active[one]])
        now[active] ^= key[at]
        parents.append(node[active[one]])
        labels.append(ids[at[one]])
        depth.append(seg[active[one]] * segment + 1 + k)
        nbytes.append(sizes[at[one]])
        keys.append(now[active[one]])
        node[active] = count + back
        count += len(one)
    packed = pack(np.concatenate(parents), np.concatenate(labels))

    members, least = np.zeros(len(packed.base), np.int64), np.full(len(packed.base), np.iinfo(np.int64).max)
    weight, conv = np.array([row[6] for row in rows], np.int64), np.array([row[5] for row in rows], np.int64)
    state = packed.step(np.full(len(rows), packed.place[0]), first)
    for k in range(int(length.max())):
        active = np.flatnonzero(length > k)
        state[active] = packed.step(state[active], ids[start[active] + k])
        np.add.at(members, state[active], weight[active])
        np.minimum.at(least, state[active], conv[active])
    place = packed.place[1 + made :]
    raw = lambda parts: [bytes(r) for r in np.concatenate(parts).astype(">u8").view("V16").ravel().tolist()]
    nodes = list(zip(raw(keys), raw(above), np.concatenate(depth).tolist(), np.concatenate(nbytes).tolist(), members[place].tolist(), least[place].tolist()))
    return nodes, [(row[5], _paths(w, roots[i], 0)) for i, (row, w) in enumerate(zip(rows, words)) if not row[7]]


KINDS = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
NAMES = ["h", "p", "depth", "n_bytes", "members", "conv_id", "path"]


def _shards(batches, segment, most):
    def done(rows):
        nodes, paths = shard(rows, segment)
        both = [(*n, None) for n in nodes] + [(None, None, None, None, None, c, p) for c, p in paths]
        for at in range(0, len(both), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*both[at : at + 20_000]), KINDS)], NAMES)

    rows, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(row)
            size += len(row[3]) // 16
            if size >= most:
                yield from done(rows)
                rows, size = [], 0
    if rows:
        yield from done(rows)


def _long_paths(batches, segment):
    for batch in batches:
        out = [_paths(np.frombuffer(t, ">u8").astype(U).reshape(-1, 2), np.array([r, s], np.int64).view(U), seg * segment) for seg, t, r, s in zip(*(c.to_pylist() for c in batch.columns[1:]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, KINDS[-1])], ["conv_id", "seg", "path"])


def _joined(batches, most):
    """Of rows by (key, conv_id): runs of at most ``most`` ids of one key."""
    key, ids = None, []
    for batch in batches:
        out = []
        for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if h != key or len(ids) == most:
                if ids:
                    out.append((key, ids[0], ",".join(map(str, ids))))
                key, ids = h, []
            ids.append(c)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.string()))], ["h", "first", "ids"])
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], ["h", "first", "ids"])


def _hashed(batches):
    key, state = None, None
    for batch in batches:
        out = []
        for h, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if h != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = h, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.binary(), pa.string()))], ["h", "sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["h", "sha"])


def digests_of_ends(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``h, sha`` of ``conv_id, h``: SHA-256 of each key's ids, ascending. Ranges of ids are joined to text first, so that a hot key has few rows and is hashed as they come."""
    parts = _parts(ends)
    chunks = ends.select("h", "conv_id").repartitionByRange(parts, "conv_id").sortWithinPartitions("h", "conv_id").mapInArrow(lambda batches: _joined(batches, chunk), "h binary, first bigint, ids string")
    return chunks.repartition(parts, "h").sortWithinPartitions("h", "first").mapInArrow(_hashed, "h binary, sha string")


def trie(conversations: DataFrame, segment: int = SEGMENT, size: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Rows without conv_id are of no conversation and take no part; a null turn comes first; a null role or text is
    empty; rows of one turn number, repeated ones too, all stay, in the order of their digests; other columns are ignored, whatever
    their names; an empty table gives no rows, not even the root.
    """
    turns, convs = rebuilt(numbered(conversations.select("conv_id", "turn", "role", "text")))
    strings = segments(turns, segment)
    parts = _parts(conversations)
    distinct = strings.groupBy("r", "s", "seg", "turns", "sizes", "many").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("members")).select("r", "s", "seg", "turns", "sizes", "conv_id", "members", "many")
    order = ("r", "s", "seg", "turns", "many")
    found = cut(distinct.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(lambda batches: _shards(batches, segment, size), "h binary, p binary, depth bigint, n_bytes bigint, members bigint, conv_id bigint, path array<binary>"))

    key = ("h", "p", "depth", "n_bytes")
    merged = found.where("h IS NOT NULL").groupBy(*key).agg(F.sum("members").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    merged = cut(merged.unionByName(root.select(F.lit(ROOT).alias("h"), F.lit(None).cast("binary").alias("p"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_bytes"), "n_convs", "conv_id")))
    children = merged.where("p IS NOT NULL").groupBy(F.col("p").alias("h")).agg(F.count("*").alias("n_children"))
    ends = strings.where("last").select("conv_id", _key(F.col("r").bitwiseXOR(F.col("x")), F.col("s").bitwiseXOR(F.col("y"))).alias("h"))
    ends = ends.union(convs.where("length = 0").select("conv_id", F.lit(ROOT)))
    nodes = merged.join(children, "h", "left").join(digests_of_ends(ends, chunk), "h", "left").na.fill(0, ["n_children"])
    nodes = cut(nodes.withColumns({"saves": (F.col("n_convs") - 1) * F.col("n_bytes"), "leaf": (F.col("n_children") == 0).cast("long"), "seg": F.floor((F.col("depth") - 1) / segment).cast("long")}))

    # a conversation's own nodes, the tail of its path: what each has below it on the path
    tail = Window.partitionBy("conv_id", "seg").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = nodes.where("depth > 0").withColumns({"below_saves": F.sum("saves").over(tail), "below_leaves": F.sum("leaf").over(tail)})
    later = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, 0)
    after = nodes.where(F.col("depth") > segment).groupBy("conv_id", "seg").agg(F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf"))
    after = after.select("conv_id", (F.col("seg") - 1).alias("seg"), F.sum("saves").over(later).alias("after_saves"), F.sum("leaf").over(later).alias("after_leaves"))
    own = own.join(after, ["conv_id", "seg"], "left").na.fill(0, ["after_saves", "after_leaves"])

    # and what it adds to the nodes before its own
    sums = nodes.where("depth > 0").groupBy("conv_id").agg(F.min("depth").alias("from"), F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf"))
    whole = found.where("h IS NULL").select("conv_id", F.lit(0).cast("long").alias("seg"), "path")
    paths = whole.union(strings.where("many").select("conv_id", "seg", "turns", "r", "s").mapInArrow(lambda batches: _long_paths(batches, segment), "conv_id bigint, seg bigint, path array<binary>"))
    before = F.slice("path", F.lit(1), F.greatest(F.col("from") - 1 - F.col("seg") * segment, F.lit(0)).cast("int"))
    given = paths.join(sums, "conv_id").select(F.explode(before).alias("h"), "saves", "leaf").groupBy("h").agg(F.sum("saves").alias("given_saves"), F.sum("leaf").alias("given_leaves"))
    inner = own.join(given, "h", "left").na.fill(0, ["given_saves", "given_leaves"])
    inner = inner.select("h", "p", "conv_id", "depth", "n_convs", "n_children", (F.col("below_leaves") + F.col("after_leaves") + F.col("given_leaves")).alias("n_leaves"), (F.col("below_saves") + F.col("after_saves") + F.col("given_saves")).alias("saved_tokens"), "sha")
    totals = nodes.agg(F.sum("leaf").alias("n_leaves"), F.sum("saves").alias("saved_tokens"))
    top = nodes.where("depth = 0").crossJoin(F.broadcast(totals)).select(*inner.columns)  # one row each
    parents = nodes.where("n_children > 0").select(F.col("h").alias("p"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    both = join_hot(inner.withColumnRenamed("n_children", "children"), parents, "p", "n_children").withColumnRenamed("children", "n_children")
    all_ = both.unionByName(top.withColumn("parent_conv_id", F.lit(None).cast("long")))
    return all_.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
