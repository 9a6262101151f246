"""Boosted regression trees over rows that lie in tasks as blocks of bins: the trees of several training sets grow side by side, one job a level."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.sources import files

BINS = 32  # of a feature
HELD = 2048  # values of a feature that a task reports; more are thinned by rank
CUT_EVERY = 10  # rounds after which the state is written to the checkpoint folder
WAVES = 4  # most blocks a core


@dataclass
class Boosted:
    """Perfect trees: ``feature`` and ``bin`` of the inner nodes (a bin above goes right), ``value`` of the leaves; the first tree counts whole, the others by the step. ``cuts``: the upper limits of each feature's bins."""

    cuts: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def probability(self, columns: list[np.ndarray]) -> np.ndarray:
        bins = binned(columns, self.cuts)
        return 1 / (1 + np.exp(-2 * sum((fallen(bins, f, b, v) for f, b, v in self.trees), np.zeros(len(columns[0])))))


def binned(columns: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x, "left").astype(np.uint8) for x, c in zip(columns, cuts)])


def fallen(bins: np.ndarray, feature, limit, values, node: int = 0):
    """The value of the leaf that each row falls to; ``values`` may be those of any level."""
    if node >= len(values) - 1:
        return values[node - len(values) + 1]
    left, right = (fallen(bins, feature, limit, values, 2 * node + side) for side in (1, 2))
    return np.where(bins[feature[node]] > limit[node], right, left)


def _columns(batches, names: list[str]) -> list[np.ndarray]:
    table = pa.Table.from_batches(list(batches))
    return [table.column(n).to_numpy().astype(float) for n in names]


def _values(columns: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each feature's values and their counts, at most HELD of them: a thinned one stands for the ranks up to its own."""
    out = []
    for x in columns:
        v, n = np.unique(x, return_counts=True)
        if len(v) > HELD:
            upto = np.cumsum(n)
            at = np.unique(np.append(np.searchsorted(upto, np.arange(1, HELD) * len(x) / HELD), [0, len(v) - 1]))
            v, n = v[at], np.diff(upto[at], prepend=0)
        out.append((v, n))
    return out


def _limits(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Where a feature's bins end: between all values, if there are few, else where the ranks come closest to equal shares. As Spark's trees choose them, though from all rows."""
    v, place = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    n = np.bincount(place, np.concatenate([f[1] for f in found]))
    middle = (v[:-1] + v[1:]) / 2
    if len(middle) < BINS:
        return middle
    upto, stride, out = np.cumsum(n), n.sum() / BINS, []
    target = stride
    for i in range(1, len(v)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out[: BINS - 1])


def _sums(block, grown: list, level: int, wanted: list) -> np.ndarray:
    """Rows and residuals by training set, wanted node, feature and bin."""
    out = np.zeros((2, len(grown), max(map(len, wanted)), len(block["bins"]), BINS))
    for held, (start, end) in enumerate(block["parts"]):
        bins, y = block["bins"][:, start:end], block["y"][start:end]
        for k, (feature, limit) in enumerate(grown):
            if k == held or start == end or not wanted[k]:
                continue
            rest = 4 * y / (1 + np.exp(2 * y * block["margin"][k, start:end])) if block["rounds"] else y
            mine = bins
            base = np.zeros(end - start, np.int64)
            if level:
                place = np.full(2**level, -1, np.int64)
                place[wanted[k]] = np.arange(len(wanted[k]))
                base = place[fallen(bins, feature, limit, np.arange(2**level, dtype=np.uint8))]
                rows = np.flatnonzero(base >= 0)
                mine, base, rest = bins[:, rows], base[rows], rest[rows]
            base = base * BINS
            size = len(wanted[k]) * BINS
            for f, b in enumerate(mine):
                at = base + b
                out[0, k, : len(wanted[k]), f] += np.bincount(at, minlength=size).reshape(-1, BINS)
                out[1, k, : len(wanted[k]), f] += np.bincount(at, rest, size).reshape(-1, BINS)
    return out


def _best(rows: np.ndarray, sums: np.ndarray, least: int) -> tuple[int, int] | None:
    """Feature and bin of a node's best split by variance, the first of equal ones; none, if nothing is gained."""
    n, s = rows[0].sum(), sums[0].sum()
    nl, sl = np.cumsum(rows, 1)[:, :-1], np.cumsum(sums, 1)[:, :-1]
    nr, sr = n - nl, s - sl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((nl >= max(least, 1)) & (nr >= max(least, 1)), sl * sl / nl + sr * sr / nr - s * s / n, -1.0)
    at = int(np.argmax(gain))
    return divmod(at, BINS - 1) if gain.flat[at] > 1e-12 * max(n, 1) else None


def _grow(state, sets: int, depth: int, least: int) -> list:
    """One tree for each training set: (feature, limit, leaf means). Of two siblings only the smaller one is summed, the other is what the parent has beside it."""
    inner = 2**depth - 1
    feature, limit = np.zeros((sets, inner), int), np.full((sets, inner), 255, np.uint8)
    value = np.zeros((sets, 2**depth))
    known: list[dict] = [{} for _ in range(sets)]  # node of the level: its sums
    wanted = [[0] for _ in range(sets)]
    pairs: list[dict] = [{} for _ in range(sets)]  # summed node: its sibling and their parent's sums
    for level in range(depth):
        if any(wanted):
            grown = [(feature[k].copy(), limit[k].copy()) for k in range(sets)]
            found = sum(state.map(lambda b, g=grown, d=level, w=wanted: _sums(b, g, d, w)).collect())
        for k in range(sets):
            known[k] = {}
            for i, node in enumerate(wanted[k]):
                known[k][node] = found[:, k, i]
                if node in pairs[k]:
                    sibling, parent = pairs[k][node]
                    known[k][sibling] = parent - found[:, k, i]
            wanted[k], pairs[k] = [], {}
            for node, (rows, sums) in sorted(known[k].items()):
                at = 2**level - 1 + node
                n, s = rows[0].sum(), sums[0].sum()
                split = _best(rows, sums, least)
                leaves = slice(node << (depth - level), (node + 1) << (depth - level))
                value[k, leaves] = s / n if n else 0.0
                if split is None:
                    continue
                f, b = feature[k, at], limit[k, at] = split
                nl, sl = rows[f, : b + 1].sum(), sums[f, : b + 1].sum()
                half = 1 << (depth - level - 1)
                value[k, leaves.start : leaves.start + half] = sl / nl
                value[k, leaves.start + half : leaves.stop] = (s - sl) / (n - nl)
                small, large = (2 * node, 2 * node + 1) if nl <= n - nl else (2 * node + 1, 2 * node)
                wanted[k].append(small)
                pairs[k][small] = (large, np.stack([rows, sums]))
    return [(feature[k], limit[k], value[k]) for k in range(sets)]


def _after(block, trees: list):
    margin = np.stack([m + fallen(block["bins"], *t) for m, t in zip(block["margin"], trees)])
    return {**block, "margin": margin, "rounds": block["rounds"] + 1}


def boost(df: DataFrame, names: list[str], label: str, fold: str, sets: int, depth: int, rounds: int, step: float, least: int) -> list[Boosted]:
    """For each k below ``sets`` the trees of the rows whose ``fold`` isn't k, with the logistic loss of Spark's gradient-boosted trees (labels 0 and 1, no nulls in ``names``).

    A partition is a block: its rows' bins, one byte each, and their margins. A level is one job for all sets; what comes back of a block
    doesn't grow with its rows. The partitions should be a few for each core; a block's rows lie in memory.
    """
    sc = df.sparkSession.sparkContext
    given = df.select(*names, F.col(label).cast("double").alias("__y"), F.col(fold).cast("int").alias("__k"))

    def report(batches):
        batches = list(batches)
        if batches:
            found = _values(_columns(batches, names))
            yield pa.RecordBatch.from_arrays([pa.array([f[0].tolist() for f in found]), pa.array([f[1].tolist() for f in found], pa.list_(pa.float64()))], ["v", "n"])

    reports = [(np.array(r.v), np.array(r.n)) for r in given.mapInArrow(report, "v array<double>, n array<double>").collect()]
    cuts = [_limits(reports[i :: len(names)]) for i in range(len(names))]

    def pack(batches):
        batches = list(batches)
        if batches:
            *columns, y, k = _columns(batches, [*names, "__y", "__k"])
            order = np.argsort(k, kind="stable")
            ends = np.searchsorted(k[order], np.arange(sets + 1))
            yield pa.RecordBatch.from_arrays([pa.array([binned(columns, cuts)[:, order].tobytes()], pa.binary()), pa.array([(2 * y[order] - 1).tobytes()], pa.binary()), pa.array([ends.tolist()], pa.list_(pa.int64()))], ["bins", "y", "ends"])

    def opened(row):
        y = np.frombuffer(row.y)
        return {"bins": np.frombuffer(row.bins, np.uint8).reshape(len(names), -1), "y": y, "parts": list(zip(row.ends[:-1], row.ends[1:])), "margin": np.zeros((sets, len(y))), "rounds": 0}

    if not sc.getCheckpointDir():
        sc.setCheckpointDir(files.scratch(df.sparkSession, "trees"))
    state = given.mapInArrow(pack, "bins binary, y binary, ends array<bigint>").rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)
    models, before = [Boosted(cuts, []) for _ in range(sets)], []
    for n in range(rounds):
        weight = step if n else 1.0
        trees = [(f, b, v * weight) for f, b, v in _grow(state, sets, depth, least)]
        for m, tree in zip(models, trees):
            m.trees.append(tree)
        for old in before:  # its successor has been made by now
            old.unpersist()
        before = [state]
        if n + 1 < rounds:
            state = state.map(lambda b, t=trees: _after(b, t)).persist(StorageLevel.MEMORY_AND_DISK)
            if (n + 1) % CUT_EVERY == 0:
                state.checkpoint()
    for old in before:
        old.unpersist()
    return models


def probabilities(models: list[Boosted], names: list[str]) -> Column:
    """Each model's probability of label 1, as an array."""

    def of(*columns: pd.Series) -> pd.Series:
        given = [c.to_numpy(float) for c in columns]
        return pd.Series(list(np.stack([m.probability(given) for m in models], 1)))

    return F.pandas_udf(of, "array<double>")(*names)


__all__ = ["BINS", "WAVES", "Boosted", "boost", "probabilities"]
