"""Removal of byte strings that an earlier document also has, by blockwise suffix sorting.

A full suffix array of the corpus takes more than the corpus itself, so suffixes are
sorted through a cover sample: in every window of ``LENGTH`` bytes one place is sampled,
chosen by the window's content alone (the smallest hash of K bytes, of equals the left one), so equal windows sample
equal places. As in a difference cover, two equal strings thus meet at a common
offset in the sample, and are compared by their offsets and the samples' ranks.

1. Each task takes the sampled suffixes of its documents, with a rank (hash) of the whole stretch
   of bytes whose windows they stand for, and deals them to suffix buckets by their first K bytes.
2. Buckets are sorted one at a time. A tie over the whole stretch with an earlier document
   settles all windows of a sample at once. Samples that tie with an earlier document over K bytes and G more on one
   side, but not over the whole stretch, stay open: a window's other LENGTH - K bytes lie at least by half on one side.
3. The windows of open samples are ranked each by itself.
4. Each document's removed windows are united and its remaining bytes are hashed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.shared import by_bucket, cut, joined, pack, runs, tagged, take, unpack
from riskgraph.llm.text import U, mix

LENGTH = 50
K = 12
W = LENGTH - K + 1  # places of a sample in a window
G = (LENGTH - K + 1) // 2
BLOCK = 1 << 19  # bytes of text read at once; a longer document is a block of its own
HELD = 1 << 24  # bytes of text whose samples a task gathers before it sends them
PIECE = 1 << 22  # a document's bytes beyond this are read as further pieces
OVERLAP = 256  # of pieces, so that each window lies whole in one, with all that its sample's sides need
PLACE = 23  # bits of a place within a block
NO_ID = 2**63 - 1  # stands for null; a row of this very id comes before nulls, as their tags tell (see ``_nulls``)

STEP = U(0x9DDFEA08EB382D69)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse, up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK * 2)
        for k, base in enumerate((STEP, U(pow(int(STEP), -1, 2**64)))):
            p = np.empty(size, U)
            p[0] = 1
            p[1:] = base
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


class Block:
    """Some documents' bytes in a row, with hashes of any stretch."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts) + bytes(16), np.uint8)
        self.n = len(self.data) - 16
        self.starts = np.cumsum([0] + [len(t) for t in texts])
        self.sums: dict[int, np.ndarray] = {}

    def hashes(self, a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
        """Hashes of the bytes from each a up to b; each ``seed`` gives another function."""
        power, inverse = _power(self.n)
        if seed not in self.sums:
            sums = self.sums[seed] = np.zeros(self.n + 1, U)
            np.cumsum(mix(self.data[: self.n].astype(U) + U(1 + 256 * seed)) * power[: self.n], out=sums[1:])
        sums = self.sums[seed]
        return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(U))

    def samples(self):
        """Each sample with its windows: document, place, first window, number of windows - 1."""
        n = self.n
        if n < LENGTH:
            return (np.zeros(0, np.int64),) * 4
        x = self.data.astype(U)
        x = x[:-1] | (x[1:] << U(8))
        four = x[:-2] | (x[2:] << U(16))
        eight = four[:-4] | (four[4:] << U(32))
        h = mix(eight[: n - K + 1] * U(0xA0761D6478BD642F) ^ four[8 : n - K + 9] * U(0xE7037ED1A0B428DB))
        low = U((1 << PLACE) - 1)
        h = (h & ~low) | np.arange(len(h), dtype=U)
        size = 1
        least = h
        while size * 2 <= W:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < W:
            least = np.minimum(least[: len(h) - W + 1], least[W - size :])
        window = np.arange(len(least))
        doc = np.searchsorted(self.starts, window, "right") - 1
        whole = window + LENGTH <= self.starts[doc + 1]
        place = (least & low).astype(np.int64)
        new = np.ones(len(window), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]
        new &= whole
        first = np.flatnonzero(new)
        # a run of windows ends where the next one begins or where windows leave their document
        stop = np.concatenate([np.flatnonzero(new | ~whole), [len(window)]])
        last = stop[np.searchsorted(stop, first, "right")] - 1
        return doc[first], place[first], first, last - first


def _blocks(batch: pa.RecordBatch):
    """Runs of pieces (ids, tags, where they begin in their text, bytes) of about BLOCK bytes."""
    ids, tags, bases, texts, size = [], [], [], [], 0
    for i, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
        raw = (text.as_py() or "").encode("utf-8", "replace")
        for base in range(0, max(1, len(raw) - OVERLAP), PIECE):
            piece = raw[base : base + PIECE + OVERLAP]
            if size and size + len(piece) > BLOCK:
                yield ids, tags, bases, texts
                ids, tags, bases, texts, size = [], [], [], [], 0
            ids.append(i)
            tags.append(tag)
            bases.append(base)
            texts.append(piece)
            size += len(piece)
    if ids:
        yield ids, tags, bases, texts


#: Columns of a sample on its way to its bucket, and their types.
SAMPLE = (("key", "<u4"), ("left", "<u2"), ("right", "<u2"), ("rank", "<u8"), ("id", "<i8"), ("tag", "<i8"), ("at", "<u4"), ("more", "u1"), ("off", "u1"))
#: Windows of a document: the first of a run, and how many more.
FOUND = (("id", "<i8"), ("tag", "<i8"), ("at", "<u4"), ("more", "u1"))
#: Single windows on their way to their bucket, told apart by 96 bits: there are far more of them than of samples.
WINDOW = (("rank", "<u8"), ("check", "<u4"), ("id", "<i8"), ("tag", "<i8"), ("at", "<u4"))


def _nulls(s: dict) -> np.ndarray:
    """Which rows have a null id: those that stand for it and whose tag isn't negative (also a row of that very id, if no other shares it)."""
    return (s["id"] == NO_ID) & (s["tag"] >= 0)


def _by_document(s: dict) -> tuple[np.ndarray, ...]:
    """Sort keys, the main one last, that put rows in the order of their documents."""
    nulls = _nulls(s)
    return (nulls, s["id"]) if nulls.any() else (s["id"],)


def _after_first(s: dict, run: np.ndarray) -> np.ndarray:
    """Which rows are of a later document than the first row of their run."""
    if not len(run):
        return run
    first, nulls = np.flatnonzero(run)[np.cumsum(run) - 1], _nulls(s)
    return (s["id"] > s["id"][first]) | (nulls & ~nulls[first])


def _settled(s: dict) -> np.ndarray:
    """Of samples sorted by (key, left, right, rank, document): which tie over their whole stretch with an earlier document."""
    return _after_first(s, runs(s["key"], s["left"], s["right"], s["rank"]))


def _ordered(s: dict) -> dict:
    return take(s, np.lexsort((*_by_document(s), s["rank"], s["right"], s["left"], s["key"])))


def _gather(buckets: int):
    """Documents (id, tag, text) to rows (bucket, samples) and (any bucket, windows settled within the task)."""

    def send(held: list[tuple[np.ndarray, dict]]):
        if not held:
            return
        home = np.concatenate([h for h, _ in held])
        s = joined([x for _, x in held], SAMPLE)
        order = np.lexsort((*_by_document(s), s["rank"], s["right"], s["left"], s["key"], home))
        s, home = take(s, order), home[order]
        known = _settled(s)
        if known.any():
            yield int(home[0]), None, pack(take(s, known), FOUND)
        s, home = take(s, ~known), home[~known]
        edge = np.searchsorted(home, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edge)):
            yield int(b), pack(take(s, np.arange(edge[b], edge[b + 1])), SAMPLE), None

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            for ids, tags, bases, texts in _blocks(batch):
                block = Block(texts)
                doc, place, first, more = block.samples()
                if len(doc):
                    whole = block.hashes(place, place + K)
                    a, b = block.starts[doc], block.starts[doc + 1]
                    s = {
                        "key": (whole >> U(32)).astype("<u4"),
                        "left": block.hashes(np.maximum(place - G, a), place).astype("<u2"),
                        "right": block.hashes(place + K, np.minimum(place + K + G, b)).astype("<u2"),
                        "rank": block.hashes(first, first + more + LENGTH) + (place - first).astype(U) * STEP,
                        "id": np.array(ids, np.int64)[doc],
                        "tag": np.array(tags, np.int64)[doc],
                        "at": (first - a + np.array(bases, np.int64)[doc]).astype("<u4"),
                        "more": more.astype("u1"),
                        "off": (place - first).astype("u1"),
                    }
                    held.append(((whole & U(0xFFFFFFFF)).astype(np.int64) % buckets, s))
                size += block.n
                if size >= HELD:
                    yield from send(held)
                    held, size = [], 0
        yield from send(held)

    def run(batches):
        for bucket, samples, found in rows(batches):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "samples": pa.array([samples], pa.binary()), "found": pa.array([found], pa.binary())})

    return run


def resolve(s: dict) -> tuple[dict, dict]:
    """One bucket's samples to those settled (all their windows are removed) and those left open."""
    s = _ordered(s)
    known = _settled(s)
    settled, s = take(s, known), take(s, ~known)
    # what is left may tie with another document over K bytes and G more on a side
    ties = {}
    for side in ("left", "right"):
        order = np.lexsort((*_by_document(s), s[side], s["key"]))
        at = take({c: s[c] for c in ("key", side, "id", "tag")}, order)
        run = runs(at["key"], at[side])
        tie = np.zeros(len(order), bool)
        if len(order):
            end = np.append(run[1:], True)  # the last of each run is of its latest document
            tie[order] = _after_first(at, run)[end][np.cumsum(run) - 1]
        ties[side] = tie
    # a window with G bytes or more on a side that doesn't tie is in no other document
    place = s["at"].astype(np.int64) + s["off"]
    first = np.where(ties["left"], s["at"], np.maximum(s["at"], place - G + 1))
    last = s["at"].astype(np.int64) + s["more"]
    last = np.where(ties["right"], last, np.minimum(last, place - (LENGTH - K - G + 1)))
    open_ = (ties["left"] | ties["right"]) & (first <= last)
    s = {"id": s["id"], "tag": s["tag"], "at": first.astype("<u4"), "more": (last - first).clip(0).astype("u1")}
    return settled, take(s, open_)


def _to_documents(found: dict, column: str, homes: int):
    """Windows to rows (bucket: their document's home, settled, open), with the windows in ``column``."""
    home = (mix(found["id"].astype(U) ^ mix(found["tag"].astype(U))) % U(homes)).astype(np.int64)
    order = np.lexsort((found["more"], found["at"], found["tag"], found["id"], home))
    found, home = take(found, order), home[order]
    once = runs(*found.values())  # rows of one id and text have the same windows
    found, home = take(found, once), home[once]
    edge = np.searchsorted(home, np.arange(homes + 1))
    for b in np.flatnonzero(np.diff(edge)):
        cells = {"settled": None, "open": None} | {column: pack(take(found, slice(edge[b], edge[b + 1])), FOUND)}
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(b)], pa.int32())} | {c: pa.array([v], pa.binary()) for c, v in cells.items()})


def _sort_bucket(homes: int):
    def finish(bucket, cells):
        settled, open_ = resolve(joined([unpack(x, SAMPLE) for x in cells["samples"]], SAMPLE))
        yield from _to_documents(joined([settled, *(unpack(x, FOUND) for x in cells["found"])], FOUND), "settled", homes)
        yield from _to_documents(open_, "open", homes)

    return finish


def _per_document(bucket, cells):
    """One row per document: (id, tag, settled, open), windows as pairs of the first and how many more."""
    parts = {c: joined([unpack(x, FOUND) for x in cells[c]], FOUND) for c in ("settled", "open")}
    kind = np.concatenate([np.full(len(parts[c]["id"]), k) for k, c in enumerate(parts)])
    both = joined(list(parts.values()), FOUND)
    order = np.lexsort((both["at"], kind, both["tag"], both["id"]))
    both, kind = take(both, order), kind[order]
    pairs = np.stack([both["at"], both["more"].astype("<u4")], 1)
    start = np.flatnonzero(runs(both["id"], both["tag"]))
    stop = np.append(start[1:], len(order))
    middle = start + np.add.reduceat(kind == 0, start) if len(start) else start
    for a in range(0, len(start), 10_000):
        part = slice(a, a + 10_000)
        yield pa.RecordBatch.from_pydict({
            "__id": pa.array(both["id"][start[part]], pa.int64()),
            "__tag": pa.array(both["tag"][start[part]], pa.int64()),
            "settled": pa.array([pairs[x:y].tobytes() for x, y in zip(start[part], middle[part])], pa.binary()),
            "open": pa.array([pairs[x:y].tobytes() for x, y in zip(middle[part], stop[part])], pa.binary()),
        })


def _first_of_each(w: dict) -> np.ndarray:
    """Of windows sorted by (rank, check, document): whether an earlier document has each."""
    return _after_first(w, runs(w["rank"], w["check"]))


def _windows(buckets: int, homes: int):
    """Rows (id, tag, text, open) to rows (bucket, windows) and, for windows that an earlier document of the task has, (home, settled)."""

    def send(held):
        w = joined(held, WINDOW)
        w = take(w, np.lexsort((*_by_document(w), w["check"], w["rank"])))
        known = _first_of_each(w)
        found = take(w, known)
        late = pack({c: found[c] if c != "more" else np.zeros(len(found["id"])) for c, _ in FOUND}, FOUND)
        w = take(w, ~known)
        home = (mix(w["rank"]) % U(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        w, home = take(w, order), home[order]
        edge = np.searchsorted(home, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edge)):
            yield batch_of(int(b), pack(take(w, slice(edge[b], edge[b + 1])), WINDOW), None)
        if len(found["id"]):
            yield batch_of(0 if not len(home) else int(home[0]), None, late)

    def batch_of(bucket, windows, found):
        return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "windows": pa.array([windows], pa.binary()), "found": pa.array([found], pa.binary())})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for k in range(len(batch)):
                i, tag, text, cells = (c[k].as_py() for c in batch.columns[:4])
                pairs = np.frombuffer(cells, "<u4").reshape(-1, 2).astype(np.int64)
                many = pairs[:, 1] + 1
                at = np.unique(np.repeat(pairs[:, 0] - (np.cumsum(many) - many), many) + np.arange(int(many.sum())))
                block = Block([(text or "").encode("utf-8", "replace")])
                rank = block.hashes(at, at + LENGTH)
                held.append({"rank": rank, "check": (block.hashes(at, at + LENGTH, 1) >> U(32)).astype("<u4"), "id": np.full(len(at), i, np.int64), "tag": np.full(len(at), tag, np.int64), "at": at.astype("<u4")})
                size += len(at)
                if size >= HELD // 16:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    return run


def _sort_windows(homes: int):
    def finish(bucket, cells):
        w = joined([unpack(x, WINDOW) for x in cells["windows"]], WINDOW)
        w = take(w, np.lexsort((*_by_document(w), w["check"], w["rank"])))
        late = take(w, _first_of_each(w))
        found = {c: late[c] if c != "more" else np.zeros(len(late["id"]), "u1") for c, _ in FOUND}
        yield from _to_documents(joined([found, *(unpack(x, FOUND) for x in cells["found"])], FOUND), "settled", homes)

    return finish


def _covered(cells, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of bytes that the windows cover."""
    pairs = np.frombuffer(b"".join(c for c in cells if c), "<u4").reshape(-1, 2).astype(np.int64)
    if not len(pairs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 0] + pairs[:, 1] + LENGTH, -1)
    inside = np.cumsum(change)[:n] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _remove(with_text: bool):
    def run(batches):
        for batch in batches:
            out = []
            for text, *cells in zip(*batch.columns[:3]):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                a, b = _covered([c.as_py() for c in cells], len(raw))
                kept = b"".join(raw[x:y] for x, y in zip(np.append(0, b), np.append(a, len(raw))))
                out.append((len(raw), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            made = [pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *made], [*batch.schema.names[3:], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """``doc_id``, ``keep``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept_text`` of every row.

    A byte goes if a string of LENGTH bytes that covers it also starts in a document
    with a smaller id. Strings are judged on the input. A null text is empty; a null id comes after all
    others. Rows with one id are of equal rank and don't remove from each other; repeated rows stay. Other columns are ignored, whatever their names; an empty table gives no rows. ``kept_text`` (if asked
    for, else null) leaves out bytes of characters that were cut in two. Texts must be shorter than 4 GB.

    Only samples and windows go by bucket; texts go once to their document's windows. A bucket that many
    documents share shrinks first within each task: of samples that tie over their whole stretch only the earliest is sent.
    """
    spark = docs.sparkSession
    buckets = parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = F.col(doc_id).cast("long")
    rows = docs.select(F.coalesce(own, F.lit(NO_ID)).alias("__id"), own.isNull().alias("__null"), F.col(text).cast("string").alias("__text"), F.struct(F.col(doc_id), *keep).alias("__row"))
    rows, keys = tagged(rows, "__id", "__text", F.col("__null"))
    homed = "bucket int, settled binary, open binary"
    by_document = "__id bigint, __tag bigint, settled binary, open binary"

    sent = rows.select("__id", "__tag", "__text").mapInArrow(_gather(buckets), "bucket int, samples binary, found binary")
    known = by_bucket(sent, parts, _sort_bucket(parts), homed)
    known = cut(by_bucket(known, parts, _per_document, by_document))

    # both joins read one exchange of the texts, as they take the same columns from it
    placed = rows.repartition(parts, *keys)
    open_ = known.where("length(open) > 0").select(*keys, "open")
    windows = placed.join(open_, keys).select("__id", "__tag", "__text", "open", "__row").mapInArrow(_windows(buckets, parts), "bucket int, windows binary, found binary")
    late = by_bucket(by_bucket(windows, parts, _sort_windows(parts), homed), parts, _per_document, by_document)

    met = placed.join(known.select(*keys, "settled"), keys, "left").join(late.select(*keys, F.col("settled").alias("late")), keys, "left")
    met = met.select("__text", "settled", "late", "__row")
    made = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"
    done = met.mapInArrow(_remove(with_text), f"__row {met.schema['__row'].dataType.simpleString()}, {made}")
    return done.select("__row.*", *(c.split()[0] for c in made.split(", ")))
