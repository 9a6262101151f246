"""Tries packed into the arrays BASE and CHECK.

The child of node ``u`` by label ``x`` is place ``BASE[u] + x`` if ``CHECK`` there is ``u``, and there is none otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Nodes with more children than this go behind all others instead of looking for a gap.
WIDE = 16
#: Gaps tried before a node goes behind all others.
TRIES = 64


@dataclass(frozen=True)
class DoubleArray:
    base: np.ndarray
    check: np.ndarray
    place: np.ndarray  # of each node of the trie that was packed

    def step(self, at: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Places of the children, -1 where there is none."""
        to = self.base[at] + label
        return np.where(self.check[to] == at, to, -1)


def pack(parent: np.ndarray, label: np.ndarray) -> DoubleArray:
    """The trie whose node ``i`` (0: the root) hangs below ``parent[i]`` by ``label[i]``; parents come before their children.

    Labels are dense (0 to k - 1). Places begin at k, so that no base is negative, and k free ones end the arrays, so that every step stays within.
    """
    n, k = len(parent), int(label[1:].max()) + 1 if len(parent) > 1 else 1
    order = np.lexsort((label[1:], parent[1:])) + 1
    edge = np.searchsorted(parent[order], np.arange(n + 1))
    children, labels = order.tolist(), label[order].tolist()
    size = 2 * n + 2 * k + 2
    used = bytearray(size)
    base, check, place = [0] * size, [-1] * size, [0] * n
    place[0] = k
    used[k] = 1
    behind, cursor = k + 1, k + 1  # behind all used places; no free place lies before the cursor
    edges = edge.tolist()
    for u in range(n):
        a, b = edges[u], edges[u + 1]
        if a == b:
            continue
        here, least = place[u], labels[a]
        at, tries = cursor, 0 if b - a <= WIDE else TRIES
        while True:
            if tries >= TRIES:
                at = max(at, behind)
            while used[at]:
                at += 1
            found = at - least
            if at >= behind or not any(used[found + x] for x in labels[a + 1 : b]):
                break
            at += 1
            tries += 1
        last = found + labels[b - 1]
        if last >= size - k:
            more = last + size
            used.extend(bytes(more - size))
            base.extend([0] * (more - size))
            check.extend([-1] * (more - size))
            size = more
        base[here] = found
        for i in range(a, b):
            to = found + labels[i]
            used[to], check[to], place[children[i]] = 1, here, to
        behind = max(behind, last + 1)
        while used[cursor]:
            cursor += 1
    end = behind + k
    return DoubleArray(np.array(base[:end], np.int64), np.array(check[:end], np.int64), np.array(place, np.int64))
