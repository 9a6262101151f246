"""Batches of text as numpy arrays of word hashes.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII
characters of the lower-cased text. Hashes are 64-bit and depend on the word's
bytes alone, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the splitmix64 finaliser)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_a:_b] = True
WORD[95] = True
BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
PRIME = U(0x9DDFEA08EB382D69)
POWER = np.cumprod(np.concatenate([np.ones(1, U), np.full(4095, PRIME)]))


def chunks(ids: list, texts: list, max_bytes: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """Runs of rows of about ``max_bytes`` characters; a longer text is a run of its own. Null texts become empty."""
    start = size = 0
    texts = [t or "" for t in texts]
    for i, t in enumerate(texts):
        if size and size + len(t) > max_bytes:
            yield ids[start:i], texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield ids[start:], texts[start:]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and how many words each text has."""
    coded = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    bounds = np.cumsum([0] + [len(c) + 1 for c in coded])
    inside = WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    h = np.add.reduceat(BYTE[data[inside]] * POWER[place & 4095], first)
    return mix(h + lengths.astype(U)), np.diff(np.searchsorted(starts, bounds))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word shingles, and how many each text has. A text of fewer words has one shingle of all it has, or none without words."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    many = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    at = np.arange(int(many.sum())) + np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
    size = np.repeat(np.minimum(counts, n), many)
    padded = np.concatenate([words, np.zeros(n, U)])
    h = size.astype(U)
    for j in range(n):
        h = h * PRIME + np.where(j < size, padded[at + j], U(0))
    return mix(h), many
