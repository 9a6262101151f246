"""The conversation trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from riskgraph.llm import conversation_trie


def trie_by_hand(rows):
    """The contract over (conv_id, turn, role, text); turns of one number come in the order of their digests."""
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            said[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in said.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])[:h] + ts[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        mine = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = mine + sum(saved[k] for k in children[node])
    return sorted(
        (min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, cs in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_by_spark(spark, rows, **more):
    table = spark.createDataFrame([(*r, 5, "p") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, h string")
    got = conversation_trie.trie(table, **more)
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


def talks(seed, n=60):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-20, 3 * n), n):
        start = [("system", rng.choice(["be kind", "be brief", None]))] + [(rng.choice(["user", "assistant", None, ""]), rng.choice(["é", "yes", "", None, "no no"])) for _ in range(rng.randint(0, 12))]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(start)]
    hot = [("user", "same"), ("assistant", "same"), ("user", "bye")]
    rows += [(c, i, *t) for c in range(1000, 1050) for i, t in enumerate(hot)]
    rows += [(7001, None, "user", "late"), (7001, None, "user", "late"), (7001, 3, "b", "x"), (7001, 3, "a", "y"), (7001, -1, "a", "z"), (None, 1, "user", "lost"), (8004, None, None, None), (9007, 0, "only", "turn")]
    rows += [(9003, i, "user", f"t{i // 3}") for i in range(150)] + [(9005, i, "user", f"t{i // 3}") for i in range(150)] + [(9006, i, "user", f"t{i // 3}") for i in range(140)]
    return rows


@pytest.mark.parametrize("segment, size, chunk", [(256, 50_000, 4096), (4, 9, 2), (1, 1, 1)])
def test_trie_equals_plain_python(spark, segment, size, chunk):
    rows = talks(segment)
    assert trie_by_spark(spark, rows, segment=segment, size=size, chunk=chunk) == trie_by_hand(rows)


def test_a_segment_that_just_fits(spark):
    rows = [(c, i, "user", f"{min(i, c)}") for c in (5, 6, 10, 11, 15) for i in range(8)]
    assert trie_by_spark(spark, rows, segment=4) == trie_by_hand(rows)


def test_only_turnless_and_no_conversations(spark):
    empty = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(empty, 0, "user", "gone")]
    assert trie_by_spark(spark, rows) == trie_by_hand(rows) and len(trie_by_hand(rows)) == 1
    assert trie_by_spark(spark, []) == [] and trie_by_spark(spark, [(None, 0, "user", "x")]) == []
