"""Suffix and near duplicates against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from riskgraph.llm import near_dedup, suffix_dedup
from riskgraph.llm.near_dedup import Params, probability_jaccard, similarity, weighted_shingles

DOCS = "doc_id bigint, text string"


def removed_by_hand(rows):
    """Every byte under a 50-byte string that a document of smaller id has, by a dictionary of all strings."""
    seen, out = {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    grams = {}
    for i in order:
        raw = (rows[i][1] or "").encode()
        grams[i] = [raw[k : k + 50] for k in range(len(raw) - 49)]
        for g in grams[i]:
            rank = (rows[i][0] is None, rows[i][0] or 0)
            seen[g] = min(seen.get(g, rank), rank)
    for i in order:
        raw, rank = (rows[i][1] or "").encode(), (rows[i][0] is None, rows[i][0] or 0)
        gone = bytearray(len(raw))
        for k, g in enumerate(grams[i]):
            if seen[g] < rank:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, x in zip(raw, gone) if not x)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (not k or not gone[k - 1]))
        out.setdefault(rows[i][0], []).append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def removed_by_spark(spark, rows):
    out = {}
    for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3)).drop("kept_text").collect():
        out.setdefault(r[0], []).append(tuple(r)[1:])
    return {k: sorted(v) for k, v in out.items()}


def random_docs(seed, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 30))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(0, 6))]
        rows.append((i * 3, "\n".join(parts)))
    return rows


def test_suffix_dedup_puts_nulls_after_the_largest_id(spark):
    """Null rows lose what the row of id 2^63-1 holds, not the other way round, and nothing to each other."""
    rng, last = random.Random(9), 2**63 - 1
    passage, other, third = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (400, 90, 70))
    rows = [(None, passage), (None, f"one {passage[30:300]} {other}"), (None, f"two {other} {third}"), (last, f"x{passage}"), (last, f"{third} {passage[:120]}"), (5, passage[200:260])]
    for given in (rows, rows[:4], rows[1:], [rows[0], rows[3]], [rows[0]], [rows[3], rows[5]]):
        got = removed_by_spark(spark, given)
        assert got == removed_by_hand(given)
    assert removed_by_spark(spark, [rows[0], rows[3]])[None][0][1] == 400


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_equals_brute_force(spark, seed):
    rows = random_docs(seed)
    assert removed_by_spark(spark, rows) == removed_by_hand(rows)


def test_suffix_dedup_edges(spark):
    run = "ab" * 300  # windows that repeat within a document
    text = "".join(chr(97 + i * i % 23) for i in range(400))
    rows = [(1, text), (2, text), (2, text), (2, "x" + text[:60]), (3, None), (4, ""), (5, text[:49]), (6, text[:50]), (7, run), (8, run + "z"), (None, text + "!"), (9, "é" * 40), (10, "é" * 40)]
    assert removed_by_spark(spark, rows) == removed_by_hand(rows)


def test_suffix_dedup_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    rows = [(i, t * 3) for i, t in random_docs(5, 12)]
    block = list(suffix_dedup._gather(4)(iter([_batch(rows)])))
    assert block
    assert removed_by_spark(spark, rows) == removed_by_hand(rows)


def test_suffix_dedup_tells_surroundings_apart(spark):
    """Texts that share one passage and whose stretches' hashes are equal in their lower 32 bits."""
    shared = "6352f1fcc8610fde1d8eb5a3f46dd9daea28c5d46b268b11d2725ff965df"
    pairs = [
        ("2e8c6a0e43746c8a904c4fe9db2857f59cae", "bfb1497dd3828758c977d537b3d999966dc4", "15652d31d83be37843e870e7667a49b476e6", "3a2ff7a1bee38d5fc77a702c3b4707a6cc66"),
        ("209e1002dae074cdcff0a9e5232fca59d5bc", "7ecb419ec09f8af2630599092afed2baf8b0", "12751c20bed4995bc80d0a3a99e6865bd47f", "7f85dd148035daddce7615bdc36c0743a23c"),
        ("236332ccd504d5861ca7a593a591d825bc85", "900e006b4be9f44e4d53c6b98abfc96e7983", "ef19eba62ed3d07002632c2fa55ab175c9d6", "ca34680b65727857d6cc3747f8b714d34e3e"),
    ]
    for a, b, c, d in pairs:
        rows = [(1, a + shared + b), (2, c + shared + d)]
        assert removed_by_spark(spark, rows) == removed_by_hand(rows)


def test_suffix_dedup_of_many_texts_with_one_id(spark):
    rows = [(i if i < 5 else 7 if i % 2 else None, t) for i, t in random_docs_numbered(3, 120)]
    assert removed_by_spark(spark, rows + rows[-10:]) == removed_by_hand(rows + rows[-10:])


def random_docs_numbered(seed, n):
    return [(k, t) for k, (_, t) in enumerate(random_docs(seed, n))]


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([0] * len(rows), pa.int32()), pa.array([r[1] for r in rows])], ["i", "t", "x"])


def test_suffix_dedup_of_nothing(spark):
    assert removed_by_spark(spark, []) == {}


def test_kept_text_and_other_columns(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(120))
    df = spark.createDataFrame([(1, text, "a"), (2, "start " + text[:80] + " end", "b")], "doc_id bigint, text string, n_bytes_of string")
    got = {r.doc_id: (r.n_bytes_of, r.kept_text) for r in suffix_dedup.remove_repeats(df, keep=("n_bytes_of",), with_text=True).collect()}
    assert got == {1: ("a", text), 2: ("b", "start  end")}


def classes_by_hand(rows, p=Params()):
    texts = [t or "" for _, t in rows]
    h, w, o, (words, counts), n = weighted_shingles(texts, p.words)
    sets, at = [], 0
    for k in n:
        sets.append((h[at : at + k], w[at : at + k]))
        at += k
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (n[i] and n[j] and similarity(sets[i], sets[j]) >= p.threshold) or (not n[i] and texts[i] == texts[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(sorted(g, key=lambda d: (d is None, d or 0)) for g in groups.values())


def classes_by_spark(spark, rows, p=Params()):
    groups = {}
    for r in near_dedup.classes(spark.createDataFrame(rows, DOCS), p).collect():
        groups.setdefault(r.class_id, []).append(r)
    for c, members in groups.items():
        assert all(m.class_size == len(members) for m in members)
        assert c == min((m.doc_id for m in members), key=lambda d: (d is None, d or 0))
    return sorted(sorted((m.doc_id for m in g), key=lambda d: (d is None, d or 0)) for g in groups.values())


def family(rng, n, words, edits):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, edits)):
            t[rng.randrange(words)] = f"n{rng.randint(0, 10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("small", [32, 4])
def test_near_dedup_equals_brute_force(spark, small):
    rng = random.Random(small)
    texts = family(rng, 50, 60, 4) + family(rng, 12, 30, 2) + family(rng, 8, 200, 12) + [" ".join(f"u{rng.random()}" for _ in range(40)) for _ in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert classes_by_spark(spark, rows, Params(small=small)) == classes_by_hand(rows)


def test_near_dedup_edges(spark):
    line = "the same line again and again for ever " * 20
    rows = [(1, "one two three four five six"), (2, "One, two; three four five SIX!"), (3, None), (4, ""), (5, "..."), (6, "..."), (7, "a b"), (8, "a b"), (9, line), (10, line + "extra"), (11, "x" * 100_000), (11, "x" * 100_000)]
    assert classes_by_spark(spark, rows) == [[1, 2], [3, 4], [5, 6], [7, 8], [9, 10], [11, 11]]


def test_near_dedup_finds_all_classes_of_the_given_documents(spark):
    """All pairs of sf0.01 that share a shingle, by an inverted index."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    h, _, owner, _, n = weighted_shingles([t or "" for _, t in rows], 5)
    holders, shared = {}, {}
    for x, k in zip(h.tolist(), owner.tolist()):
        holders.setdefault(x, []).append(k)
    for held in holders.values():
        for i, j in itertools.combinations(held, 2):
            shared[i, j] = shared.get((i, j), 0) + 1
    alike = [(rows[i][0], rows[j][0]) for (i, j), c in shared.items() if c >= 0.8 * (n[i] + n[j] - c)]
    class_of = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(alike) > 50 and all(class_of[a] == class_of[b] for a, b in alike)
    assert sum(len(g) for g in _groups(alike)) == sum(1 for d, c in class_of.items() if sum(x == c for x in class_of.values()) > 1)


def _groups(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    return list(groups.values())


@pytest.mark.parametrize(("shingles", "repeats"), [(40, 100), (120, 40)])
def test_near_dedup_where_counts_differ(spark, shingles, repeats):
    """One text of each pair repeats a line that the other has once: the sets are alike, the weights are not."""
    rng = random.Random(repeats)
    rows = []
    for k in range(40):
        line = " ".join(f"r{rng.randint(0, 10**9)}" for _ in range(8))
        rest = " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(shingles))
        rows += [(2 * k, f"{rest} {line}"), (2 * k + 1, f"{rest} " + " ".join([line] * repeats))]
    want = classes_by_hand(rows)
    got = classes_by_spark(spark, rows)
    assert len(set(map(tuple, want)) ^ set(map(tuple, got))) <= 3  # of 40 pairs at most one is missed


def test_pairs_connect_the_classes(spark):
    rng = random.Random(9)
    rows = list(enumerate(family(rng, 30, 60, 4) + family(rng, 6, 40, 2) + family(rng, 5, 40, 0)))
    df = spark.createDataFrame(rows, DOCS)
    links = [tuple(r) for r in near_dedup.pairs(df).collect()]
    in_links = {x for link in links for x in link}
    whole = {tuple(sorted(x for x in g if x in in_links)) for g in classes_by_spark(spark, rows)} - {()}
    assert {tuple(sorted(g)) for g in _groups(links)} == whole


def test_near_dedup_of_nothing(spark):
    assert classes_by_spark(spark, []) == []


def test_deduplicate_keeps_one_row(spark):
    rows = [(5, "a b c d e f g", "x"), (4, "a b c d e f g", "y"), (4, "a b c d e f g", "y"), (None, "a b c d e f g", "z"), (6, "other words stand here now", "w")]
    got = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string, node string")).collect()
    assert sorted((r.doc_id, r.node) for r in got) == [(4, "y"), (6, "w")]


def test_registers_estimate_probability_jaccard():
    rng = random.Random(3)
    a = [f"w{i}" for i in range(200)]
    texts = [" ".join(a), " ".join(a[:150] + [f"v{i}" for i in range(50)]), " ".join(rng.choice("pq") for _ in range(100))]
    h, w, o, _, n = weighted_shingles(texts, 5)
    who = near_dedup.prob_minhash(h, w, o, 3, 2048)
    w = 1 + np.log(w)
    first = (h[: n[0]], w[: n[0]]), (h[n[0] : n[0] + n[1]], w[n[0] : n[0] + n[1]])
    assert abs((who[0] == who[1]).mean() - probability_jaccard(*first)) < 0.05


def test_near_dedup_sends_each_side_only_the_texts_it_asks_for(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    one, two = " ".join(words[:200]), " ".join(words[200:])
    docs = spark.createDataFrame([(i, f"{base} end{i}") for i, base in enumerate([one, one, one, two, two])], "doc_id long, text string")
    calls, verified = [], near_dedup._verified

    def spy(pairs, a, b, p):
        calls.append([{r[0] for r in df.select(c).distinct().collect()} for df, c in ((pairs, "a"), (a, "node"), (pairs, "b"), (b, "node"))])
        return verified(pairs, a, b, p)

    monkeypatch.setattr(near_dedup, "_verified", spy)
    got = sorted(tuple(r) for r in near_dedup.classes(docs).select("doc_id", "class_id").collect())
    assert got == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)]
    for asked_a, given_a, asked_b, given_b in calls:
        assert given_a <= asked_a | asked_b and given_b <= asked_a | asked_b
    first = calls[0]
    assert first[0] == first[1] and first[2] == first[3]


def test_deduplicate_shuffles_texts_once(spark):
    docs = spark.createDataFrame([(i, f"a text of its own {i} " * 9) for i in range(50)], "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = near_dedup.deduplicate(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = plan.split("Exchange hashpartitioning")[1:]
    assert sum("__text_hash" in part.split("\n")[0] and "doc_id" in part.split("\n")[0] for part in moved) == 0
