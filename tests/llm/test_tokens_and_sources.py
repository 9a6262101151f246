"""Source divergence and token counts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from riskgraph.llm import divergence, token_counts
from riskgraph.llm.double_array import pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


def audit_by_hand(rows, min_docs=3, top=200):
    """The contract in plain Python over (lang, source, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, groups, n = defaultdict(Counter), set(), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))
        docs[lang].update(set(found))
        n[lang, source].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in docs[lang].items() if k >= min_docs]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(n[g])

        def shares(counts):
            total = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        q, mine = shares(whole), {s: shares(n[lang, s]) for l, s in groups if l == lang}
        for s, p in mine.items():
            pairs = [(sum((p[t] - r[t]) ** 2 // r[t] for t in kept), o) for o, r in mine.items() if o != s]
            words = [((p[t] - q[t]) ** 2 // q[t], t) for t in kept if n[lang, s][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", words, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def audit_by_spark(spark, rows, **more):
    docs = spark.createDataFrame([(s, l, t, 7, "x") for l, s, t in rows], "source string, lang string, text string, n bigint, term string")
    got = divergence.audit(docs, **more)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("cells", [1 << 19, 5])
def test_divergence_equals_plain_python(spark, cells):
    rng = random.Random(5)
    words = ["the", "The", "é", "É", "naïve", "x1y", "foo_bar", "straße", "ﬁ", "a-b", "  ", "zz", "Ω", "1 2", "\x85", " "]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "ü"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for _ in range(120)]
    rows += [("en", "hot", "the same words again") for _ in range(80)]
    rows += [("fr", "one", "rare"), ("fr", "two", None), ("it", "alone", "ciao ciao"), ("en", "empty", ""), ("en", "long", "word " * 40_000)]
    assert audit_by_spark(spark, rows, cells=cells) == audit_by_hand(rows)
    assert audit_by_spark(spark, rows, top=2) == audit_by_hand(rows, top=2)


def test_divergence_of_many_flushes_and_of_nothing(spark):
    rows = [("en", f"s{i % 3}", f"w{'abcdefghij'[i % 10]} common w{'xyz'[i % 3]}") for i in range(60)]
    assert audit_by_spark(spark, rows, held=2) == audit_by_hand(rows)
    assert audit_by_spark(spark, []) == []


def test_shares_beyond_64_bits():
    n, below = np.array([[10**10, 0]]), np.array([[10**10 + 2]])
    assert divergence._shares(n, below).tolist() == [[1 + 10**9 * (10**10 + 1) // (10**10 + 2), 1 + 10**9 // (10**10 + 2)]]


def test_double_array_equals_a_dictionary():
    rng = random.Random(2)
    words = {tuple(rng.randrange(rng.choice([2, 40, 300])) for _ in range(rng.randint(1, 7))) for _ in range(3000)}
    node, parent, label = {(): 0}, [0], [0]
    for w in sorted(words, key=len):
        for i in range(1, len(w) + 1):
            if w[:i] not in node:
                node[w[:i]] = len(parent)
                parent.append(node[w[: i - 1]])
                label.append(w[i - 1])
    packed = pack(np.array(parent), np.array(label))
    assert len(set(packed.place.tolist())) == len(parent)
    tried = [(p, x) for p in node for x in rng.sample(range(300), 5)] + [(w[:-1], w[-1]) for w in node if w]
    got = packed.step(packed.place[[node[p] for p, _ in tried]], np.array([x for _, x in tried]))
    assert got.tolist() == [packed.place[node[(*p, x)]] if (*p, x) in node else -1 for p, x in tried]
    alone = pack(np.array([0]), np.array([0]))
    assert alone.step(alone.place, np.zeros(1, int)).tolist() == [-1]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def counted(texts):
    return token_counts.counter(PATH).count_texts(pa.array(texts, pa.string()))[1].tolist()


def test_counts_equal_the_library(library):
    rng = random.Random(1)
    parts = ["a", "e", "l", "s", "t", "r", "v", "d", "'", " ", "  ", "\n", "\t", "1", "23", "!", "-", "é", "中", "文", "　", "\xa0", "I'll", "don't", "'re", "''s", " 's", "<|endoftext|>", "<|end", "\x00", "😀", "____", "....", "A", "\x85", "ﷺ", "​", "Ⅷ", "²", "the", " and", "ing"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["", "'l", "'r", "'ll", "x'", " " * 500 + "x", "\n" * 99, "-" * 3000, "ab" * 2000, "中" * 900, "=*" * 2000, "a" * 4001, "<|endoftext|>" * 3]
    texts += ["".join(chr(rng.choice([rng.randint(0xE000, 0x10FFFF), rng.randint(0, 0xD7FF)])) for _ in range(20_000))]
    texts += pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    assert counted(texts) == library(texts)


def test_counts_of_long_texts_in_blocks(library, monkeypatch):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    texts += ["y" * 5000 + " end", "é" * 3000, "word " * 3000 + "<|endoftext|>" + "x  " * 1000]
    want = library(texts)
    for size in (100, 999):
        monkeypatch.setattr(token_counts, "BLOCK", size)
        assert counted(texts) == want


def test_numbered_states_are_made_anew(library, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(300)) for _ in range(20)]
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    assert counted(texts) == library(texts)


def test_neighbours_equal_merging(library):
    v = token_counts.counter(PATH).v
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 5000, 3000), rng.integers(0, 5000, 3000)

    def text(t):
        return bytes([t]) if t < 256 else text(v.left[t]) + text(v.right[t])

    rank = {k: i for i, k in enumerate(zip(v.left[256:].tolist(), v.right[256:].tolist()))}

    def merged(word):
        parts = list(word)
        while len(parts) > 1:
            best, i = min((rank.get(p, 10**9), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best == 10**9:
                break
            parts[i : i + 2] = [256 + best]
        return parts

    want = [merged(text(x) + text(y)) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert v.fits(a, b).tolist() == want and v.fits(a, b).tolist() == want and 0 < sum(want) < 3000


def test_token_counts_of_a_table(spark, library):
    rows = [(1, None, 5), (2, "", 5), (3, "two words", 5), (3, "two words", 5), (None, "x " * 600, 6), (4, "naïve", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = token_counts.token_counts(docs, PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n := library([t or ""])[0], n > 512) for i, t, _ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(docs.limit(0), PATH).collect() == []
