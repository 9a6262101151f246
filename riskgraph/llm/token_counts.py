"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer.

Two deterministic machines are compiled from the tokenizer's file:

- ``Splitter`` reads character classes and annotates transitions with the word
  boundaries that they settle (before the symbol read, or before the one ahead of
  it). A stream of texts is cut into chunks; each chunk's map from every state to
  the state it leaves behind is computed side by side, the maps are composed by a
  parallel prefix scan, and a second pass from the states so found emits the boundaries.
- ``Words`` reads the bytes of a word and annotates transitions with the change of
  the number of tokens; a word's count is the sum along its path. A prefix's tokens
  are told by its last one, as a sequence is BPE's own exactly if each two
  neighbours are. A state is what the future can depend on: for each place at which
  a token may still be open, its node in the vocabulary's trie (a double array), the
  token before it and how many fewer tokens there are. The transition is compiled to
  tables of nodes and of neighbours, and the distinct words of a block advance together,
  their states side by side in arrays. Long words run by numbered states, made when
  they are first met: their states recur, while those of short words are too many
  to number (over a million in 50 MB of text).
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgraph.llm.double_array import pack
from riskgraph.llm.text import U, mix

#: Character classes; the letters that can stand in a contraction are classes of their own.
OTHER, LETTER, NUMBER, SPACE, WHITE, QUOTE, STMD, RV, E, L, END, UNKNOWN = range(12)
LETTERS, WHITES = (LETTER, STMD, RV, E, L), (SPACE, WHITE)
KINDS = 11
#: States of the splitter. C: after a contraction; Q, QR, QL: in what may become one; W1, V1: one white character (space, other); W2, V2: more.
START, IN_L, IN_N, IN_O, Q, QR, QL, C, W1, V1, W2, V2 = range(12)
STATES = 12
HERE, BEFORE = 1, 2  # outputs: a boundary before this symbol, before the one ahead of it

CHUNK = 64
BLOCK = 1 << 20
LONG = 64  # bytes of a word from which it runs by numbered states
MAX_STATES = 20_000
PAIRS = 1 << 20  # places of the table of neighbours
NEVER = 1 << 40


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """``next`` (times KINDS) and ``output`` by state * KINDS + class."""
    after, out = np.zeros(STATES * KINDS, np.uint8), np.zeros(STATES * KINDS, np.uint8)
    fresh = {OTHER: IN_O, NUMBER: IN_N, SPACE: W1, WHITE: V1, QUOTE: Q, END: START} | dict.fromkeys(LETTERS, IN_L)
    joins = {
        IN_L: dict.fromkeys(LETTERS, IN_L), IN_N: {NUMBER: IN_N}, IN_O: {OTHER: IN_O, QUOTE: IN_O},
        Q: {STMD: C, RV: QR, L: QL, OTHER: IN_O, QUOTE: IN_O},
        QR: {E: C}, QL: {L: C}, START: {}, C: {},
        W1: dict.fromkeys(LETTERS, IN_L) | {NUMBER: IN_N, OTHER: IN_O, QUOTE: IN_O, SPACE: W2, WHITE: V2},
        V1: {SPACE: W2, WHITE: V2}, W2: {SPACE: W2, WHITE: V2}, V2: {SPACE: W2, WHITE: V2},
    }
    for state in range(STATES):
        for kind in range(KINDS):
            to, said = (joins[state][kind], 0) if kind in joins[state] else (fresh[kind], HERE)
            if state in (QR, QL) and to != C:  # the quote stood alone: the letter after it began a word
                said |= BEFORE
                if kind in LETTERS:
                    to, said = IN_L, BEFORE
            if state in (W2, V2) and kind not in (*WHITES, END):  # the last white character parts from the others
                said |= BEFORE
                if state == W2:
                    to, said = joins[W1][kind], BEFORE
            after[state * KINDS + kind], out[state * KINDS + kind] = to * KINDS, said
    return after, out


AFTER, OUT = compile_splitter()


def boundaries(kinds: np.ndarray) -> np.ndarray:
    """Whether a word (or an END) begins at each symbol of a stream that starts a text."""
    lanes = -(-len(kinds) // CHUNK)
    padded = np.full(lanes * CHUNK, END, np.uint8)
    padded[: len(kinds)] = kinds
    columns = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
    maps = np.repeat((np.arange(STATES) * KINDS).astype(np.uint8)[:, None], lanes, 1)
    for column in columns:
        maps = AFTER[maps + column]
    maps = np.ascontiguousarray(maps.T) // KINDS
    step = 1
    while step < lanes:  # maps[i] becomes the map of all chunks up to i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8) * np.uint8(KINDS)
    said = np.zeros((CHUNK, lanes), np.uint8)
    for j, column in enumerate(columns):
        at = state + column
        said[j], state = OUT[at], AFTER[at]
    said = said.T.ravel()[: len(kinds)]
    found = (said & HERE).astype(bool)
    found[:-1] |= (said[1:] & BEFORE).astype(bool)
    return found


class Vocabulary:
    """A byte-level BPE tokenizer as tables. Tokens are numbered by rank: bytes first, then merges in their order."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, split = told["model"], told["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model.get("type") != "BPE" or not plain or told["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            raise ValueError("only byte-level BPE without normaliser and prefix space is compiled")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
            raise ValueError("added tokens must match as they are")
        self.special = sorted((t["content"].encode() for t in told["added_tokens"]), key=len, reverse=True)
        self.split = Tokenizer.from_file(path).pre_tokenizer
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        if not all(c in model["vocab"] for c in byte):
            raise ValueError("the vocabulary lacks a byte")
        number, tokens = dict(byte), [bytes([b]) for b in range(256)]
        left, right = [-1] * 256, [-1] * 256
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            if a + b in number:
                raise ValueError("two merges give one token")
            number[a + b] = len(tokens)
            left.append(number[a])
            right.append(number[b])
            tokens.append(tokens[number[a]] + tokens[number[b]])
        self.left, self.right, self.longest = np.array(left), np.array(right), max(map(len, tokens))
        keys = (self.left[256:] << 24) | self.right[256:]
        order = np.argsort(keys)
        self.merge_keys, self.merges = keys[order], order + 256
        own = np.arange(len(tokens))
        first = np.concatenate([np.full(256, NEVER), self.first_merge(self.left[256:], self.right[256:])])
        sound = (own < 256) | (first == own)  # BPE gives the token for its own bytes
        for t in range(256, len(tokens)):  # parts come before the whole
            sound[t] &= sound[left[t]] and sound[right[t]]
        node, parents, labels, at = {}, [0], [0], {0: -1}
        for t, token in enumerate(tokens):
            if not sound[t]:
                continue
            u = 0
            for b in token:
                u, before = node.get(u << 8 | b, -1), u
                if u < 0:
                    u = node[before << 8 | b] = len(parents)
                    parents.append(before)
                    labels.append(b)
            at[u] = t
        # ``pack`` wants parents first, which is how the nodes were made
        self.trie = pack(np.array(parents), np.array(labels))
        self.token = np.full(len(self.trie.base), -1)
        self.token[self.trie.place[list(at)]] = list(at.values())
        self.pair_keys, self.pair_fits = np.full(PAIRS, -1), np.zeros(PAIRS, bool)

    def first_merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first merge across the border of two tokens when BPE works on their bytes together, NEVER if there is none.

        Until then each side merges as if alone, so a part at the border waits from its own rank to that of the part it goes
        into; a merge across comes before a merge of the right side by the same rank, and after one of the left.
        """
        out = np.full(len(a), NEVER)
        x, into_x = a.copy(), np.full(len(a), NEVER)
        which = np.arange(len(a))
        while len(which):
            y, into_y, some = b[which].copy(), np.full(len(which), NEVER), np.arange(len(which))
            while len(some):
                key = (x[some] << 24) | y[some]
                at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
                rank = np.where(self.merge_keys[at] == key, self.merges[at], NEVER)
                fits = (rank < into_x[some]) & (rank <= into_y[some])
                out[which[some]] = np.minimum(out[which[some]], np.where(fits, rank, NEVER))
                into_y[some] = y[some]
                y[some] = self.left[y[some]]
                some = some[y[some] >= 0]
            into_x, x = x, self.right[x]
            on = x >= 0
            which, x, into_x = which[on], x[on], into_x[on]
        return out

    def fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether BPE leaves the two tokens as they are; -1 stands for a word's start. Pairs met come from a table of fixed size."""
        key = (before << 24) | token
        slot = (mix(key.astype(U)) & U(PAIRS - 1)).astype(np.int64)
        out = self.pair_fits[slot]
        new = (self.pair_keys[slot] != key) & (before >= 0)
        if new.any():
            keys, back = np.unique(key[new], return_inverse=True)
            found = self.first_merge(keys >> 24, keys & 0xFFFFFF) == NEVER
            out[new] = found[back]
            slot = (mix(keys.astype(U)) & U(PAIRS - 1)).astype(np.int64)
            self.pair_keys[slot], self.pair_fits[slot] = -1, False
            for s, k, f in zip(slot.tolist(), keys.tolist(), found.tolist()):
                self.pair_keys[s], self.pair_fits[s] = k, f
        out[before < 0] = True
        return out

    def kind(self, code: int) -> int:
        """The class of a character, as the pre-tokenizer treats it."""
        c = chr(code)
        if c in "stmd":
            return STMD
        if c in "rv":
            return RV
        if c in "el'":
            return {"e": E, "l": L, "'": QUOTE}[c]
        if c == " ":
            return SPACE
        for before, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(self.split.pre_tokenize_str(before + c)) == 1:
                return kind
        return WHITE


class Counter:
    """Counts tokens of words, texts and batches of texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.forget()

    def forget(self) -> None:
        """Drop the numbered states; they are made anew when they are met."""
        start = ((int(self.v.trie.place[0]), -1, 0),)
        self.states, self.number, self.move = [start], {start: 0}, {}

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a numbered state by a byte: the next state and the change of the number of tokens."""
        nodes, lasts, fewer = map(np.array, zip(*self.states[state]))
        to = self.v.trie.step(nodes, byte)
        token = np.where(to >= 0, self.v.token[to], -1)
        ends = np.flatnonzero(token >= 0)
        (end,) = ends[self.v.fits(lasts[ends], token[ends])]
        change = 1 - int(fewer[end])
        made = (*((n, last, less + change) for n, last, less in zip(to.tolist(), lasts.tolist(), fewer.tolist()) if n >= 0), (int(self.v.trie.place[0]), int(token[end]), 0))
        number = self.number.setdefault(made, len(self.states))
        if number == len(self.states):
            self.states.append(made)
        self.move[state << 8 | byte] = number, change
        return number, change

    def count_long(self, word: bytes) -> int:
        state = total = 0
        for b in word:
            moved = self.move.get(state << 8 | b) or self.compile(state, b)
            state = moved[0]
            total += moved[1]
        if len(self.states) > MAX_STATES:
            self.forget()
        return total

    def count_words(self, data: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of words of at most LONG bytes, which advance together byte by byte.

        ``lane, start, node`` are the open places of all words. At each byte exactly one token that fits ends in each word.
        """
        v, order = self.v, np.argsort(-lengths, kind="stable")
        first, lengths, root = first[order], lengths[order], int(self.v.trie.place[0])
        width = int(lengths[0])
        last, count = np.full((len(first), width + 1), -1), np.zeros((len(first), width + 1), np.int64)
        lane = start = node = np.zeros(0, np.int64)
        for j in range(width):
            active = int(np.searchsorted(-lengths, -j, "left"))
            keep = lane < active
            lane = np.concatenate([lane[keep], np.arange(active)])
            start = np.concatenate([start[keep], np.full(active, j)])
            node = v.trie.step(np.concatenate([node[keep], np.full(active, root)]), data[first[lane] + j])
            on = node >= 0
            lane, start, node = lane[on], start[on], node[on]
            token = v.token[node]
            ends = np.flatnonzero(token >= 0)
            ends = ends[v.fits(last[lane[ends], start[ends]], token[ends])]
            if len(ends) != active:
                raise ValueError("the merges don't give each prefix one last token")
            last[lane[ends], j + 1] = token[ends]
            count[lane[ends], j + 1] = count[lane[ends], start[ends]] + 1
        out = np.zeros(len(first), np.int64)
        out[order] = count[np.arange(len(first)), lengths]
        return out

    def _codes(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the characters of UTF-8 bytes begin, and their classes."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        code = data[at].astype(np.int32)
        lead = data[at]
        for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
            which = np.flatnonzero((lead >= low) & (lead < high))
            if len(which):
                c = lead[which].astype(np.int32) & mask
                for k in range(1, more + 1):
                    c = c << 6 | data[at[which] + k].astype(np.int32) & 0x3F
                code[which] = c
        kinds = self.kinds[code]
        if (kinds == UNKNOWN).any():
            for c in np.unique(code[kinds == UNKNOWN]).tolist():
                self.kinds[c] = self.v.kind(c)
            kinds = self.kinds[code]
        return at, kinds

    def _words(self, data: np.ndarray, lengths: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First bytes, ends and segments of the words of segments that lie one after the other.

        Where the last segment goes on beyond ``data`` (``whole`` is false), its last word is left out.
        """
        at, kinds = self._codes(data)
        edge = np.cumsum(lengths)
        segment = np.searchsorted(edge, at, "right")
        stream = np.full(len(at) + len(lengths), END, np.uint8)
        place = np.empty(len(stream), np.int64)
        ends = np.searchsorted(at, edge, "left") + np.arange(len(lengths))
        stream[np.arange(len(at)) + segment] = kinds
        place[np.arange(len(at)) + segment] = at
        place[ends] = edge
        of = np.zeros(len(stream), np.int64)
        of[np.arange(len(at)) + segment] = segment
        if not whole:
            stream, place = stream[:-1], place[:-1]
        starts = np.flatnonzero(boundaries(stream))
        first, last = starts[:-1], starts[1:]
        real = stream[first] != END
        return place[first[real]], place[last[real]], of[first[real]]

    def _counts(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Tokens of the words data[first:last]; equal words of up to 15 bytes are counted once."""
        out, lengths = np.zeros(len(first), np.int64), last - first
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        short = np.flatnonzero(lengths <= 7)
        which, back = [], []
        if len(short):
            n = lengths[short].astype(U)
            key = padded[first[short][:, None] + np.arange(8)].view("<u8").ravel()
            key = key & ((U(1) << (n * U(8))) - U(1)) | n << U(56)
            _, one, again = np.unique(key, return_index=True, return_inverse=True)
            which, back = [short[one]], [again]
        longer = np.flatnonzero((lengths > 7) & (lengths <= 15))
        again = np.zeros(len(longer), np.int64)
        if len(longer):
            rows = padded[first[longer][:, None] + np.arange(16)]
            rows[np.arange(16) >= lengths[longer][:, None]] = 0
            rows[:, 15] = lengths[longer]
            high, low = rows.view(">u8").astype(U).T
            order = np.lexsort((low, high))
            h, w = high[order], low[order]
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
            again[order] = np.cumsum(fresh) - 1
            which.append(longer[order[fresh]])
        rest = np.flatnonzero((lengths > 15) & (lengths <= LONG))
        which.append(rest)
        chosen = np.concatenate(which) if which else rest
        if len(chosen):
            found = self.count_words(data, first[chosen], lengths[chosen])
            at = 0
            if len(short):
                out[short] = found[back[0]]
                at = len(which[0])
            out[longer] = found[at + again]
            out[rest] = found[len(found) - len(rest) :]
        for i in np.flatnonzero(lengths > LONG).tolist():
            out[i] = self.count_long(data[first[i] : last[i]].tobytes())
        return out

    def count(self, data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Tokens of the segments data[first:last] without added tokens; about BLOCK bytes are worked at a time."""
        total, i = np.zeros(len(first), np.int64), 0
        while i < len(first):
            if last[i] - first[i] > BLOCK:
                total[i] = self._long(data[first[i] : last[i]])
                i += 1
                continue
            j, size = i, 0
            while j < len(first) and (j == i or size + last[j] - first[j] <= BLOCK) and last[j] - first[j] <= BLOCK:
                size += last[j] - first[j]
                j += 1
            part = np.concatenate([data[a:b] for a, b in zip(first[i:j], last[i:j])])
            a, b, of = self._words(part, last[i:j] - first[i:j], True)
            total[i:j] = np.bincount(of, self._counts(part, a, b), j - i).astype(np.int64)
            i = j
        return total

    def _long(self, data: np.ndarray) -> int:
        """Tokens of one long segment: block after block, each from the last boundary of the one before."""
        at = total = 0
        size = BLOCK
        while at < len(data):
            end = min(len(data), at + size)
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            part = data[at:end]
            a, b, _ = self._words(part, np.array([len(part)]), end == len(data))
            total += int(self._counts(part, a, b).sum())
            if end == len(data):
                return total
            moved = int(b[-1]) if len(b) else 0
            at, size = at + moved, BLOCK if moved else 2 * size
        return total

    def count_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and tokens of each text; null texts are empty. A special string within a text is one token and parts the text."""
        texts = texts.cast(pa.large_string()) if texts.null_count == 0 else texts.fill_null("").cast(pa.large_string())
        _, offsets, values = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
        first, last, row, extra = at[:-1], at[1:], np.arange(len(texts)), np.zeros(len(texts), np.int64)
        raw = memoryview(data)[at[0] : at[-1]].tobytes() if any(self.v.special) else b""
        if any(s in raw for s in self.v.special):
            pieces = []
            for i, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
                text = data[a:b].tobytes()
                while True:  # the leftmost special string, of those the longest
                    hits = [(k, -len(s), s) for s in self.v.special if (k := text.find(s)) >= 0]
                    if not hits:
                        break
                    k, _, s = min(hits)
                    pieces.append((a, a + k, i))
                    extra[i] += 1
                    a, text = a + k + len(s), text[k + len(s) :]
                pieces.append((a, b, i))
            first, last, row = (np.array(c, np.int64) for c in zip(*pieces))
        counts = self.count(data, first, last)
        return at[1:] - at[:-1], np.bincount(row, counts, len(texts)).astype(np.int64) + extra if len(row) else extra


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's transducer for a tokenizer's file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(Vocabulary(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: ``keep``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    A null text is empty and has no tokens; rows repeat as they do in ``docs``; other columns are ignored, whatever their
    names; an empty table gives no rows. No shuffle: a task holds a batch and its worker's tables, whose
    sizes are fixed. A text of any length is worked in blocks. ``path`` must exist on every executor.
    """

    def run(batches):
        for batch in batches:
            sizes, counts = counter(path).count_texts(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > limit)], [*batch.schema.names[1:], "n_bytes", "n_tokens", "over_limit"])

    kept = docs.select(F.col(text).alias("__text"), *keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[1:]] + ["n_bytes bigint, n_tokens bigint, over_limit boolean"])
    return kept.mapInArrow(run, schema)
