"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import itertools
import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that lost executors don't lose it and later plans start from it.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset, as in tests, one is made.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def tagged(df: DataFrame, row_id: str, text: str, unsigned: Column | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with ``__tag``, and the columns that tell its rows apart: the id alone where ids are unique, else also a 64-bit hash of the text.

    The hash is drawn anew until no two texts of one id share it, as 60 bits of another hash tell.
    Rows of one id and text are one to both columns. With ``unsigned`` the tags of a table with repeated ids are
    negative except in the rows that it holds for, which sets these apart from others of the same id.
    """
    repeated = df.groupBy(row_id).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if not repeated:
        return df.withColumn("__tag", F.lit(0).cast("long")), [row_id]
    other = F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(-1))
    for seed in itertools.count():
        tag = F.xxhash64(F.lit(seed), text)
        if unsigned is not None:
            tag = F.when(unsigned, tag.bitwiseAND(F.lit(2**63 - 1))).otherwise(tag.bitwiseOR(F.lit(-(2**63))))
        found = df.withColumn("__tag", tag)
        met = found.select(row_id, "__tag", other.alias("other")).groupBy(row_id, "__tag").agg(F.min("other").alias("a"), F.max("other").alias("b"))
        if not met.where("a <> b").limit(1).count():
            return found, [row_id, "__tag"]


def pack(columns: dict, layout) -> bytes:
    """Columns one after the other, each as planes of its bytes (leading zeros then compress well), compressed."""
    planes = b"".join(np.ascontiguousarray(columns[c].astype(t).view(np.uint8).reshape(len(columns[c]), np.dtype(t).itemsize).T).tobytes() for c, t in layout)
    return zlib.compress(planes, 1)


def unpack(data: bytes, layout) -> dict:
    flat, sizes, at, out = np.frombuffer(zlib.decompress(data), np.uint8), [np.dtype(t).itemsize for _, t in layout], 0, {}
    n = len(flat) // sum(sizes)
    for (c, t), size in zip(layout, sizes):
        out[c] = np.ascontiguousarray(flat[at : at + n * size].reshape(size, n).T).view(t).ravel()
        at += n * size
    return out


def joined(parts: list[dict], layout) -> dict:
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, t) for c, t in layout}


def take(columns: dict, which: np.ndarray) -> dict:
    return {c: v[which] for c, v in columns.items()}


def runs(*columns: np.ndarray) -> np.ndarray:
    """Of sorted columns, where a new combination of values begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def by_bucket(df: DataFrame, parts: int, finish: Callable[[int, dict[str, list]], Iterator], schema: str, start: Callable[[], tuple] | None = None) -> DataFrame:
    """``df`` (a column ``bucket`` and binary columns) dealt by bucket; ``finish`` gets one bucket's cells by column at a time and yields record batches.

    Where a task keeps something from bucket to bucket, ``start`` gives it a ``finish`` and a generator function to end with.
    """
    names = [c for c in df.columns if c != "bucket"]

    def run(batches):
        one, last = start() if start else (finish, lambda: ())
        bucket, cells = None, {}
        for batch in batches:
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in ("bucket", *names)}
            for i in range(len(batch)):
                b = columns["bucket"][i].as_py()
                if b != bucket:
                    if bucket is not None:
                        yield from one(bucket, cells)
                    bucket, cells = b, {c: [] for c in names}
                for c in names:
                    if columns[c][i].is_valid:
                        cells[c].append(columns[c][i].as_py())
        if bucket is not None:
            yield from one(bucket, cells)
        yield from last()

    return df.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def split_by(home: np.ndarray, homes: int, columns: dict) -> Iterator[tuple[int, dict]]:
    """Each home's part of the columns, in their order."""
    order = np.argsort(home, kind="stable")
    columns, home = take(columns, order), home[order]
    edge = np.searchsorted(home, np.arange(homes + 1))
    for b in np.flatnonzero(np.diff(edge)):
        yield int(b), take(columns, slice(edge[b], edge[b + 1]))


def join_hot(left: DataFrame, right: DataFrame, key: str, many: str, share: int = 10_000) -> DataFrame:
    """``left`` with ``right``'s columns (one row per ``key``; nulls where there is none); ``many`` says how many rows of ``left`` each key has and is dropped.

    Keys that hold 1 / ``share`` of all rows or more, of which there can't be more than ``share``, are broadcast, so
    that their rows stay where they are; the rest is shuffled, and no task gets a large part of it.
    """
    total = right.agg(F.sum(many)).first()[0] or 0
    hot = F.col(many) * share >= max(1, total)
    few = right.where(hot).drop(many)
    met = left.join(F.broadcast(few), key)
    rest = left.where(F.col(key).isNotNull()).join(F.broadcast(few.select(key)), key, "left_anti").join(right.where(~hot & F.col(key).isNotNull()).drop(many), key, "left")
    none = left.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in few.schema.fields if f.name != key))
    return met.select(*rest.columns).union(rest).union(none.select(*rest.columns))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node it is linked to over any number of ``edges`` (a, b).

    Each round takes the smallest label among a node and its neighbours and then the label's own label,
    until no label changes. A hub's edges are pre-aggregated or split by AQE; nothing but counts comes to the driver.
    """
    both = edges.select("a", "b").where("a <> b")
    both = cut(both.union(both.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("over"))
        labels = cut(least.join(jump, "to", "left").select("node", F.least("to", "over").alias("label"), (F.least("to", "over") < F.col("old")).alias("moved")))
        if not labels.where("moved").limit(1).count():
            return labels.select("node", "label")
