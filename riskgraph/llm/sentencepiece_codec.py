"""SentencePiece encoding and decoding in numpy batches.

Words of equal length advance together. Substrings are hashed by code point and
probed against the sorted keys of the vocabulary. A unigram model is decoded by
Viterbi, with vectorised maxima and stored backpointers. A BPE model defines its
tokens by its merge order instead, so there the words advance by their best-scoring
merges, found by the same probes and maxima; Viterbi over merge ranks would give other ids than the model's.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.text import U, chunks, mix

MARK = "▁"
NONE = -np.inf
STEP = U(0x9E3779B97F4A7C15)
LONG = 200  # words of more characters are merged one by one
CACHED = 200_000


@dataclass(frozen=True)
class Model:
    """What encoding and decoding need: pieces by id, their scores, which are whole-text pieces, and byte ids."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    normal: tuple[bool, ...]
    byte_ids: tuple[int, ...]  # of the bytes 0 to 255; empty without byte fallback
    unknown: int
    bpe: bool
    dummy_prefix: bool = True

    @staticmethod
    def load(path: str) -> Model:
        """From a SentencePiece model file with the identity normaliser."""
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models without normalisation are read")
        kinds = [p.type for p in m.pieces]
        bytes_at = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if kinds[i] == 6}
        return Model(tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), tuple(k in (1, 4, 5) for k in kinds), tuple(bytes_at[b] for b in range(256)) if len(bytes_at) == 256 else (), kinds.index(2), m.trainer_spec.model_type == 2, m.normalizer_spec.add_dummy_prefix)


def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes of each row of code points, and the powers that subtract them."""
    n, width = codes.shape
    values = mix(codes.astype(U) + U(1))
    sums = np.zeros((n, width + 1), U)
    for j in range(width):
        sums[:, j + 1] = sums[:, j] * STEP + values[:, j]
    return sums, np.cumprod(np.concatenate([np.ones(1, U), np.full(width, STEP)]))


def _code_points(words: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), width)


class Codec:
    """Encodes and decodes texts under a model; words met before come from a bounded cache."""

    def __init__(self, model: Model):
        self.model = model
        self.known = {p: i for i, (p, ok) in enumerate(zip(model.pieces, model.normal)) if ok}
        self.longest = max(map(len, self.known), default=1)
        keys, ids = [], []
        by_length: dict[int, list[str]] = {}
        for p in self.known:
            by_length.setdefault(len(p), []).append(p)
        for width, group in by_length.items():
            sums, _ = _prefix(_code_points(group, width))
            keys.append(mix(sums[:, -1] + U(width)))
            ids += [self.known[p] for p in group]
        keys = np.concatenate(keys) if keys else np.zeros(0, U)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(ids, np.int64)[order]
        self.marked = np.zeros(1 << 21, bool)  # by the lower bits of keys: most substrings are no pieces, and most of those end here
        self.marked[(keys & U(len(self.marked) - 1)).astype(np.int64)] = True
        self.score = np.array(model.scores)
        self.least = min((model.scores[i] for i in self.known.values()), default=0.0) - 10
        # a word ends where white space follows something else, unless a piece reaches over that place
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.known)
        self.words = re.compile(".+" if crossing else f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        self.cache: dict[str, bytes] = {}
        coded = [self._bytes(i) for i in range(len(model.pieces))]
        self.lengths = np.array([len(c) for c in coded])
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.table = np.frombuffer(b"".join(coded), np.uint8)

    def _bytes(self, i: int) -> bytes:
        if i in self.model.byte_ids:
            return bytes([self.model.byte_ids.index(i)])
        if i == self.model.unknown:
            return " ⁇ ".encode()
        return self.model.pieces[i].replace(MARK, " ").encode() if self.model.normal[i] else b""

    def probe(self, sums, power, rows, a, b) -> np.ndarray:
        """Ids of the pieces that equal characters a to b of the rows, -1 where there is none."""
        h = mix(sums[rows, b] - sums[rows, a] * power[b - a] + (b - a).astype(U))
        out = np.full(len(h), -1)
        maybe = np.flatnonzero(self.marked[(h & U(len(self.marked) - 1)).astype(np.int64)])
        if len(maybe):
            h = h[maybe]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == h, self.key_ids[at], -1)
        return out

    def viterbi(self, words: list[str]) -> list[list[tuple[int, int]]]:
        """Best-scoring segmentation of words of one length, as spans; of equals the one with the longer last piece."""
        width = len(words[0])
        sums, power = _prefix(_code_points(words, width))
        n, rows = len(words), np.arange(len(words))
        best, back = np.full((n, width + 1), NONE), np.zeros((n, width + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, width + 1):
            for size in range(min(end, self.longest), 0, -1):
                h = mix(sums[:, end] - sums[:, end - size] * power[size] + U(size))
                here = rows if size == 1 else np.flatnonzero(self.marked[(h & U(len(self.marked) - 1)).astype(np.int64)])
                if not len(here):
                    continue
                at = np.minimum(np.searchsorted(self.keys, h[here]), len(self.keys) - 1) if len(self.keys) else np.zeros(len(here), int)
                hit = self.keys[at] == h[here] if len(self.keys) else np.zeros(len(here), bool)
                gain = np.where(hit, self.score[self.key_ids[at]], self.least if size == 1 else NONE) if len(self.keys) else np.full(len(here), self.least)
                total = best[here, end - size] + gain
                better = total > best[here, end]
                best[here[better], end], back[here[better], end] = total[better], size
        out = []
        for r in range(n):
            end, spans = width, []
            while end:
                spans.append((end - int(back[r, end]), end))
                end = spans[-1][0]
            out.append(spans[::-1])
        return out

    def merges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """BPE segmentation of words of one length: the best-scoring neighbours merge first, of equals the left ones.

        Returns (words, characters): the id of the symbol that starts at each character (-1: not a piece), and whether one starts there.
        """
        width, n = len(words[0]), len(words)
        sums, power = _prefix(_code_points(words, width))
        after = np.tile(np.arange(1, width + 2), (n, 1))  # where the symbol that starts here ends
        before = np.tile(np.arange(-1, width), (n, 1))
        starts = np.ones((n, width), bool)
        gain, merged = np.full((n, width), NONE), np.full((n, width), -1)

        def weigh(rows, at):
            """Score and id of merging the symbols from ``at`` with their next ones."""
            middle = after[rows, at]
            whole = middle < width
            rows, at, middle = rows[whole], at[whole], middle[whole]
            ids = self.probe(sums, power, rows, at, after[rows, middle])
            gain[rows, at] = np.where(ids >= 0, self.score[ids], NONE)
            merged[rows, at] = ids

        row, at = np.divmod(np.arange(n * width), width)
        symbol = self.probe(sums, power, row, at, at + 1).reshape(n, width)
        weigh(row, at)
        rows = np.arange(n)
        while len(rows) and width > 1:
            at = np.argmax(gain[rows], 1)
            rows, at = rows[gain[rows, at] > NONE], at[gain[rows, at] > NONE]
            middle = after[rows, at]
            end = after[rows, middle]
            symbol[rows, at] = merged[rows, at]
            after[rows, at], before[rows, end] = end, at
            starts[rows, middle] = False
            gain[rows, middle] = NONE
            gain[rows, at] = NONE
            weigh(rows, at)
            left = before[rows, at]
            weigh(rows[left >= 0], left[left >= 0])
        return symbol, starts

    def merge_long(self, word: str) -> list[tuple[int, int]]:
        """``merges`` for one long word, with a heap of neighbours."""
        n, after, before = len(word), list(range(1, len(word) + 2)), list(range(-1, len(word)))
        alive, heap = [True] * n, []

        def offer(a: int) -> None:
            m = after[a]
            if a >= 0 and m < n and (i := self.known.get(word[a : after[m]])) is not None:
                heapq.heappush(heap, (-self.model.scores[i], a, m, after[m]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, m, e = heapq.heappop(heap)
            if not (alive[a] and m < n and alive[m] and after[a] == m and after[m] == e):
                continue
            after[a], alive[m], before[e] = e, False, a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        spans, a = [], 0
        while a < n:
            spans.append((a, after[a]))
            a = after[a]
        return spans

    def _ids(self, word: str, spans) -> bytes:
        out = []
        for a, b in spans:
            i = self.known.get(word[a:b])
            if i is not None:
                out.append(i)
            elif self.model.byte_ids:
                out += [self.model.byte_ids[x] for x in word[a:b].encode("utf-8", "replace")]
            else:
                out.append(self.model.unknown)
        return np.array(out, np.int32).tobytes()

    def learn(self, words: set[str]) -> None:
        """Put the words into the cache."""
        if len(self.cache) + len(words) > CACHED:
            self.cache = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for width, group in by_length.items():
            if self.model.bpe and width <= LONG:
                symbol, starts = self.merges(group)
                known = ((symbol >= 0) | ~starts).all(1)
                flat = symbol[starts].astype(np.int32).tobytes()
                ends = (np.cumsum(starts.sum(1)) * 4).tolist()
                for k, (w, a, b) in enumerate(zip(group, [0, *ends], ends)):
                    if known[k]:
                        self.cache[w] = flat[a:b]
                    else:
                        at = [*np.flatnonzero(starts[k]).tolist(), width]
                        self.cache[w] = self._ids(w, zip(at, at[1:]))
            else:
                for w, spans in zip(group, map(self.merge_long, group) if self.model.bpe else self.viterbi(group)):
                    self.cache[w] = self._ids(w, spans)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words.findall(((MARK if self.model.dummy_prefix else "") + t.replace(" ", MARK)) if t else "") for t in texts]
        words = set().union(*split)
        if len(self.cache) + len(words) > CACHED:
            self.cache = {}
        self.learn(words - self.cache.keys())
        return [np.frombuffer(b"".join(map(self.cache.__getitem__, s)), np.int32) for s in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids; bytes that aren't UTF-8 become U+FFFD."""
        size = self.lengths[ids]
        first = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(ids) else np.zeros(0, np.int64)
        at = np.arange(int(size.sum())) - np.repeat(first, size) + np.repeat(self.offsets[ids], size)
        text = self.table[at].tobytes()
        if self.model.dummy_prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", "replace")


def encode(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``token_ids`` (array<int>), ``n_tokens`` and ``round_trip`` of every row's whole text.

    ``round_trip`` says whether decoding the ids gives the text back; only the
    mark U+2581 itself doesn't come back. Null and empty texts have no tokens and are
    true. Repeated rows stay; other columns are ignored. One pass without a shuffle; the model is as large as its vocabulary.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    chosen = df.select(F.col(text).alias("__text"), *keep)

    def run(batches):
        codec = Codec(held.value)
        for batch in batches:
            at = 0
            for _, texts in chunks([None] * len(batch), batch.column(0).to_pylist()):
                found = codec.encode(texts)
                same = [codec.decode(ids) == t for ids, t in zip(found, texts)]
                sizes = np.array([len(x) for x in found], np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(found), pa.int32()))
                kept = [c.slice(at, len(texts)) for c in batch.columns[1:]]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(sizes, pa.int32()), pa.array(same)], [*batch.schema.names[1:], "token_ids", "n_tokens", "round_trip"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]] + ["token_ids array<int>", "n_tokens int", "round_trip boolean"])
    return chosen.mapInArrow(run, schema)


def decode(df: DataFrame, model: Model, ids: str = "token_ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the ``text`` of each row's token ids; null ids give a null text, ids that are null or outside the vocabulary are passed over."""
    held = df.sparkSession.sparkContext.broadcast(model)
    chosen = df.select(F.col(ids).alias("__ids"), *keep)

    def run(batches):
        codec = Codec(held.value)
        top = len(held.value.pieces)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array([i for i in x if i is not None and 0 <= i < top], np.int64)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], "text"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]] + ["text string"])
    return chosen.mapInArrow(run, schema)
