"""Quality, language model, tokens, licences and mixing."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgraph.llm import license_scan, lm_score, mixing, quality, sentencepiece_codec
from riskgraph.llm.queries import MODEL_PATH
from riskgraph.llm.sentencepiece_codec import Codec, Model


def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert right[1] > 80 and right[0] > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "", 9), (None, "fine words here", 9), (3, "%%% ***" * 50_000, 9)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 7)], "doc_id bigint, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    none = quality.classify(docs.limit(0), labels.limit(0))
    assert none.collect() == [] and none.columns == ["doc_id", "text", "held_out", "score", "predicted"]


def test_ftrl_equals_plain_python():
    rng = np.random.default_rng(3)
    p = quality.Params(bits=5, epochs=2)
    rows = [(np.sort(rng.choice(32, 6, replace=False)), rng.random(6)) for _ in range(40)]
    labels = rng.integers(0, 2, 40)
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= p.l1:
            return 0.0
        return -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for epoch in range(p.epochs):
        for k in np.random.default_rng(epoch).permutation(40):
            x = {**dict(zip(rows[k][0].tolist(), rows[k][1].tolist())), 32: 1.0}
            w = {i: weight(i) for i in x}
            error = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x))) - labels[k]
            for i in x:
                g = error * x[i]
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / p.alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = quality.ftrl(rows, labels, p)
    assert np.allclose(got, [weight(i) if i in n else 0.0 for i in range(33)]) and (got != 0).sum() > 10


def features_by_hand(text):
    """Counts of the n-grams whose hashes are the features: words (n = 1, 2) and shapes (n = 1, 2, 3)."""
    import re

    tokens = re.findall(r"(?:[0-9A-Za-z_]|[^\x00-\x7f])+|[^\s0-9A-Za-z_\x80-\U0010ffff]+", text)
    lower = [t.lower() if t.isascii() else "".join(c.lower() if c.isascii() else c for c in t) for t in tokens]
    shape = [(frozenset("l" if not c.isascii() or c.islower() or c == "_" else "u" if c.isupper() else "d" if c.isdigit() else "o" for c in t), min(len(t.encode()), 3)) for t in tokens]
    grams = [tuple(s[i : i + k]) + (kind, k) for kind, s, most in (("w", lower, 2), ("s", shape, 3)) for k in range(1, most + 1) for i in range(len(s) - k + 1)]
    return {g: grams.count(g) for g in grams}


def test_features_equal_plain_python():
    texts = ["The cat, the dog; THE end 42x", "", "a", "%% ## a_b é1 É", "one two one two one"]
    index, total = quality.features(texts, 40)
    at = 0
    for text, n in zip(texts, total):
        want = features_by_hand(text)
        _, many = np.unique(index[at : at + n], return_counts=True)
        assert sorted(many) == sorted(want.values())
        at += n


def test_equal_texts_have_equal_scores():
    w = np.random.default_rng(0).normal(size=(1 << 18) + 1)
    alone = quality.scores(["some words stand here, 12 of them"], w, 18)[0]
    assert (quality.scores(["x " * 5000, "some words stand here, 12 of them", "", "some words stand here, 12 of them"], w, 18)[[1, 3]] == alone).all()


def test_the_training_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] * 3, "doc_id bigint, quality int")
    assert quality.training_sample(docs, labels, quality.Params(max_rows=3)).count() <= 3


def scores_by_hand(texts, p=lm_score.Params()):
    import re

    docs = [re.findall(r"(?:[^\W]|[^\x00-\x7f])+", t.lower()) for t in texts]
    uni, bi = {}, {}
    for d in docs:
        for w in d:
            uni[w] = uni.get(w, 0) + 1
        for v, w in itertools.pairwise(d):
            bi[v, w] = bi.get((v, w), 0) + 1
    n = sum(uni.values())
    log = lambda x: round(1e6 * math.log(x))
    out = []
    for d in docs:
        s = log(uni[d[0]]) - log(n) if d else 0
        for v, w in itertools.pairwise(d):
            s += log(bi[v, w]) - log(uni[v]) if bi[v, w] >= p.min_count else log(p.backoff) + log(uni[w]) - log(n)
        out.append((len(d), s))
    return out


@pytest.mark.parametrize(("frequent", "common"), [(300_000, 1000), (300_000, 0), (300_000, 7), (9, 5), (0, 0), (0, 9)])
def test_lm_scores_equal_brute_force(spark, frequent, common):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("the of a b c dé Foo_1 x9".split()) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", "one", "a b " * 20_000 + "word " * 3]
    p = lm_score.Params(frequent=frequent, common=common)
    got = lm_score.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), p).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.score) for r in got] == scores_by_hand(texts, p)


def test_lm_edges(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a b a b"), (2, "a b a b"), (2, "c"), (None, "a a")], "doc_id bigint, text string")
    got = lm_score.score(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in got) == [(False, 1, 0), (False, 1, 0), (False, 2, 1), (False, 2, 4), (False, 2, 4), (True, 0, 2)]
    assert len({r.score for r in got if r.n_tokens == 4}) == 1 and all(r.per_token is None for r in got if not r.n_tokens)
    assert lm_score.score(df.limit(0)).collect() == []


def test_lm_scores_of_null_ids_beside_the_largest(spark):
    rows = [(None, "aa bb cc"), (2**63 - 1, "aa bb cc"), (None, "aa bb cc"), (None, "dd"), (2**63 - 1, None)]
    got = lm_score.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len((t or "").split())) for i, t in rows)
    assert len({r.score for r in got if r.n_tokens == 3}) == 1


def test_lm_scores_of_many_texts_with_one_id(spark):
    texts = [f"the {'of ' * (k % 7)}word{k} end" for k in range(120)]
    got = lm_score.score(spark.createDataFrame([(5 if k % 2 else None, t) for k, t in enumerate(texts)], "doc_id bigint, text string")).collect()
    by_hand = scores_by_hand(texts)
    for i, rows in ((None, by_hand[::2]), (5, by_hand[1::2])):
        assert sorted((r.n_tokens, r.score) for r in got if r.doc_id == i) == sorted(rows)


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    rng = random.Random(0)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    texts += ["", " ", "   a  b ", "tabs\tand\nlines \x00", "你好 🙂 é", "<s> </s> <0x41>", "x" * 500, " " * 40, "".join(rng.choice("abcde fg") for _ in range(2000))]
    got = Codec(Model.load(MODEL_PATH)).encode(texts)
    assert [g.tolist() for g in got] == library.encode(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id bigint, text string")
    encoded = sentencepiece_codec.encode(df, Model.load(MODEL_PATH))
    assert encoded.where("NOT round_trip").count() == 0
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(encoded, Model.load(MODEL_PATH)).collect()}
    assert [back[i] for i in range(len(texts))] == texts and back[None] == ""


def test_the_mark_does_not_come_back(spark):
    df = spark.createDataFrame([(1, "a▁b")], "doc_id bigint, text string")
    assert not sentencepiece_codec.encode(df, Model.load(MODEL_PATH)).first().round_trip


def test_viterbi_equals_brute_force():
    pieces = ["<unk>", "a", "b", "ab", "ba", "aba", "bab", "▁", "▁a", "▁ab", "c"]
    scores = [0.0, -2.0, -2.3, -3.1, -2.9, -4.05, -4.4, -1.5, -2.2, -3.3, -5.0]
    model = Model(tuple(pieces), tuple(scores), tuple(i > 0 for i in range(len(pieces))), (), 0, False)
    codec = Codec(model)

    def best(word):
        top = (-math.inf, None)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            spans, a = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    spans.append(word[a:i])
                    a = i
            spans.append(word[a:])
            s = sum(scores[pieces.index(x)] if x in pieces[1:] else (codec.least if len(x) == 1 else -math.inf) for x in spans)
            top = max(top, (s, spans), key=lambda t: t[0])
        return top

    words = ["▁" + "".join(w) for n in range(1, 7) for w in itertools.product("abz", repeat=n)][:700]
    for w in words:
        spans = codec.viterbi([w])[0]
        mine = sum(scores[pieces.index(w[a:b])] if w[a:b] in pieces[1:] else codec.least for a, b in spans)
        assert abs(mine - best(w)[0]) < 1e-9


def test_licences(spark):
    rows = [
        (1, "code here\n# Licensed under the Apache License, Version 2.0.\nmore", "repo/a/x.py"),
        (2, "Released under the MIT License.", "repo/LICENSE"),
        (3, "nothing at all", "repo/b/c/y.py"),
        (4, "Licensed under CC BY-NC 4.0.", "repo/b/LICENSE.txt"),
        (5, "plain", "repo/b/c/d/z.py"),
        (6, None, "other/q.txt"),
        (7, "plain", None),
        (8, "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files,\nto deal in the Software without restriction", "lib/COPYING"),
        (9, "my driving license was lost in the park on a sunny day last year", "solo/t.txt"),
        (9, "my driving license was lost in the park on a sunny day last year", "solo/t.txt"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, path string")
    got = sorted((r.doc_id, r.license, r.origin) for r in license_scan.inherit(license_scan.scan(df)).collect())
    assert got == [(1, "Apache-2.0", "own"), (2, "MIT", "own"), (3, "CC-BY-NC-4.0", "inherited"), (4, "CC-BY-NC-4.0", "own"), (5, "CC-BY-NC-4.0", "inherited"), (6, None, "none"), (7, None, "none"), (8, "MIT", "own"), (9, None, "none"), (9, None, "none")]
    assert license_scan.inherit(license_scan.scan(df.limit(0))).collect() == []


def flat_matcher():
    return license_scan.Matcher(1000, [3 + k % 5 for k in range(len(license_scan.VOCABULARY))], 0.6)


def test_each_template_finds_itself():
    found = flat_matcher().scan([text for _, text in license_scan.TEMPLATES])
    assert [f[0] for f in found] == [name for name, _ in license_scan.TEMPLATES] and min(f[2] for f in found) > 0.99


def best_by_hand(matcher, text):
    """Every window of every template's size, by dictionaries."""
    tokens = license_scan.words(text)
    idf = dict(zip(license_scan.VOCABULARY, matcher.idf))
    weigh = lambda part: {w: part.count(w) * idf.get(w, matcher.idf[-1]) for w in set(part)}
    top = (0.0, None)
    for name, template in license_scan.TEMPLATES:
        own = license_scan.words(template)
        t = weigh(own)
        for a in range(len(tokens)):
            part = tokens[a : a + len(own)]
            denied = not set(own) & set(license_scan.NEGATIONS) and set(tokens[max(0, a - 5) : a + len(part)]) & set(license_scan.NEGATIONS)
            digits = [w for w in license_scan.words(name) if w in own and w.isdigit() and w != "0" and (len(own) <= 20 or "version" in own)]
            letters = [(w, license_scan.SPELLED.get(w)) for w in ["spdx", "identifier", *license_scan.words(name)] if not w.isdigit() and len(own) <= 20]
            stated = [w for i, w in enumerate(tokens) if a <= i < a + len(part) + 3 and w.isdigit() and len(w) < 3 and (i < a + len(part) or tokens[i - 1] in ("version", "v"))]
            denied = denied or any(not (w in part or s in part) for w, s in letters if w in own or s in own) or any(w not in stated for w in digits if stated)
            if tokens[a] not in idf or denied or 2 * len(part) < len(own):
                continue
            w = weigh(part)
            c = sum(x * w.get(k, 0) for k, x in t.items()) / math.sqrt(sum(x * x for x in t.values()) * sum(x * x for x in w.values()))
            if c > top[0] + 1e-12:
                top = (c, name)
    return top if top[0] >= matcher.threshold else (0.0, None)


def test_licences_equal_brute_force():
    rng = random.Random(5)
    matcher = flat_matcher()
    texts = ["", "word", "not released under the MIT License", license_scan._BSD_OPENING.split(":")[0]]
    for k, (_, t) in enumerate(license_scan.TEMPLATES):
        part = t.split()
        part = [w for w in part if rng.random() > 0.1 * (k % 3)]
        filler = [rng.choice(("alpha", "beta", "the", "of", "use")) for _ in range(40)]
        texts.append(" ".join(filler[:20] + part + filler[20:]))
    for text, (name, cosine, _) in zip(texts, matcher.scan(texts)):
        want = best_by_hand(matcher, text)
        assert abs(cosine - want[0]) < 1e-9 and name == want[1]
    assert [f[0] for f in matcher.scan(texts)][:4] == [None] * 4


def test_sentences_versions_and_identifiers():
    wanted = {
        "There is no fee. Released under the MIT License.": "MIT", "There is no fee! released under the MIT License": "MIT", "This is not released under the MIT License.": None,
        "No part of it is old.\n\nReleased under the MIT License": "MIT", "It was never (v. 2) released under the MIT License": None,
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under the Apache License, Version 3.0.": None, "x y z Licensed under the Apache License, Version 1.1": None, "Licensed under the Apache License.": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3": "GPL-3.0", "Released under the XYZ License": None, "Licensed under the BSD 3-Clause License": "BSD-3-Clause",
        "// SPDX-License-Identifier: MIT\nint main": "MIT", "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "SPDX-License-Identifier: CC-BY-SA-4.0": "CC-BY-SA-4.0", "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "SPDX-License-Identifier: Foo": None,
    }
    assert {t: f[0] for t, f in zip(wanted, flat_matcher().scan(list(wanted)))} == wanted


def test_a_notice_within_a_long_line():
    text = "plain words stand here " * 125 + "Released under the MIT License. " + "and go on after it " * 120
    assert flat_matcher().scan([text, text.replace(" ", "\n")])[0][0] == "MIT"
    assert flat_matcher().scan(["This is free and unencumbered software released into the public domain."])[0][0] == "Unlicense"


def test_licences_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License", "a/LICENSE", 1, 2, 3, "x"), (2, None, "a/b/c", 1, 2, 3, "x")], "doc_id bigint, text string, path string, license int, depth int, parts int, dir string")
    got = license_scan.inherit(license_scan.scan(df, keep=("doc_id", "depth", "parts", "dir")))
    assert sorted((r.doc_id, r.license, r.origin, r.dir) for r in got.collect()) == [(1, "MIT", "own", "x"), (2, "MIT", "inherited", "x")]


def test_raking_meets_its_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", f"l{j}", str(k), float(rng.integers(1, 1000))) for i in range(4) for j in range(3) for k in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, observed double")
    targets = [[("s0", 0.1), ("s1", 0.2), ("s2", 0.3), ("s3", 0.4)], [("l0", 0.5), ("l1", 0.3), ("l2", 0.2)], [("0", 0.35), ("1", 0.65)]]
    frames = [spark.createDataFrame(t, f"{m} string, share double") for t, m in zip(targets, mixing.MARGINS)]
    got = mixing.rake(cells, frames).collect()
    x = np.array([r[3] for r in rows]).reshape(4, 3, 2) / sum(r[3] for r in rows)
    for _ in range(200):
        for axis, t in enumerate(targets):
            x *= np.expand_dims(np.array([s for _, s in t]) / x.sum(tuple({0, 1, 2} - {axis})), tuple({0, 1, 2} - {axis}))
    for r in got:
        assert abs(r.fitted - x[int(r.source[1]), int(r.lang[1]), int(r.topic)]) < 1e-4 and r.gap <= 1e-4


def test_mixing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs, temperature=0.5).cache()
    rate = got.agg(F.sum(F.col("mix_tokens") * F.col("mix_probability"))).first()[0]
    kept = got.where("mix_kept").agg(F.sum("mix_tokens")).first()[0]
    p = F.col("mix_probability")
    deviation = got.agg(F.sum(p * (1 - p) * F.col("mix_tokens") ** 2)).first()[0] ** 0.5  # a quarter of the rate here, as some texts are long
    assert abs(kept - rate) < 3 * deviation and got.agg(F.max("mix_probability")).first()[0] == 1.0
    want = docs.join(got.select("doc_id", "mix_tokens"), "doc_id").groupBy("lang").agg(F.sum("mix_tokens").alias("t")).collect()
    total = sum(r.t**0.5 for r in want)
    for r in got.groupBy("lang").agg(F.sum(F.col("mix_tokens") * F.col("mix_probability")).alias("t")).collect():
        assert abs(r.t / rate - next(w.t for w in want if w.lang == r.lang) ** 0.5 / total) < 1e-3


@pytest.mark.parametrize("repeats", [50.0, 1.5])
def test_mixing_by_repeats_leaves_no_document_out(spark, repeats):
    """Proportions as those of the sample where the scale suffices; else no more than the stated growth, and still every document."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.union(docs.limit(20)).union(docs.limit(1).withColumn("text", F.lit("")))
    ids = docs.withColumn("empty", F.col("text") == "").groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    weighed = mixing.mix(docs, temperature=0.5).cache()
    got = mixing.mix(docs, temperature=0.5, repeats=repeats).cache()
    assert got.columns == weighed.columns
    times = {(r.doc_id, r.text): r.n for r in got.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    assert all(times[r.doc_id, r.text] >= r.n and times[r.doc_id, r.text] % r.n == 0 for r in ids.collect())
    tokens, total = (d.agg(F.sum("mix_tokens")).first()[0] for d in (got, docs.join(weighed.select("doc_id", "mix_tokens"), "doc_id")))
    if repeats < 2:
        assert tokens < (repeats + 1) * total
    else:
        share = {r.lang: r.t for r in weighed.groupBy("lang").agg(F.sum(F.col("mix_tokens") * F.col("mix_weight")).alias("t")).collect()}
        for r in got.groupBy("lang").agg(F.sum("mix_tokens").alias("t")).collect():
            assert abs(r.t / tokens - share[r.lang] / sum(share.values())) < 0.03


def test_raking_tells_goals_that_no_cells_meet(spark):
    cells = spark.createDataFrame([("a", "x", "x/0", 5.0), ("b", "y", "y/0", 5.0)], "source string, lang string, topic string, observed double")
    goals = [[("a", 0.5), ("b", 0.5)], [("x", 0.9), ("y", 0.1)], [("x/0", 0.9), ("y/0", 0.1)]]
    frames = [spark.createDataFrame(t, f"{m} string, share double") for t, m in zip(goals, mixing.MARGINS)]
    assert mixing.rake(cells, frames, rounds=5).first().gap > 0.1


def test_mixing_gives_the_same_rows_with_many_cells(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

    def rows():
        return sorted((r.doc_id, r.mix_topic, r.mix_tokens, r.mix_kept, round(r.mix_weight, 6), round(r.mix_probability, 6)) for r in mixing.mix(docs).collect())

    few = rows()
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert rows() == few


def test_topics_part_texts_by_their_words(spark):
    rng = random.Random(4)
    kinds = [[f"{k}{i}" for i in range(60)] for k in "pqrs"]
    rows = [(i, " ".join(rng.choice(kinds[i % 4] + ["the", "of"]) for _ in range(60)), "en" if i < 200 else "xx") for i in range(220)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.mix_topic for r in mixing.with_topic(df, mixing.learn_topics(df)).collect()}
    for k in range(4):
        assert len({got[i] for i in range(k, 200, 4)}) == 1
    assert len({got[i] for i in range(200)}) == 4
    for k in range(4):  # the rare language has topics too
        assert len({got[i] for i in range(200 + k, 220, 4)}) == 1
    assert len({got[i] for i in range(200, 220)}) == 4 and got[200].startswith("xx/")


def test_topics_are_learnt_from_all_documents(spark):
    """As k-means over every distinct row, more than 4,000 of them; neither parts nor copies of rows change the topics."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice([f"{'pqrs'[i % 4]}{j}" for j in range(40)] + ["the", "of"]) for _ in range(20)), "en") for i in range(6000)] + [(i, f"z{i % 4}", f"t{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    p = mixing.TopicParams(languages=1)
    model, again = (mixing.learn_topics(d, p) for d in (df.repartition(2), df.union(df.limit(500)).repartition(7)))
    assert set(model) == {"en", None} and all(np.array_equal(model[k], again[k]) for k in model)
    ordered = sorted((r.order, r.text) for r in mixing.topic_sample(df, mixing.TopicParams(sample=10_000, languages=1)).where("lang = 'en'").collect())
    want = mixing.k_means([at for _, at in mixing._classes([t for _, t in ordered])], p)
    assert len(ordered) == 6000 and np.allclose(model["en"], want, atol=1e-3)


def test_topics_are_learnt_from_a_bounded_sample_of_each_language(spark, monkeypatch):
    rows = [(None, "the same words here", "en")] * 9000 + [(i, f"w{i} w{i % 7} words", "en") for i in range(3000)] + [(i, f"r{i} r{i % 5}", "rare") for i in range(60)]
    rows += [(i, f"z{i % 4} z{i % 4}a", f"tiny{i % 30}") for i in range(300)] + [(7, None, "en"), (8, "", None), (9, "?!", "signs")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6)
    p = mixing.TopicParams(sample=100, languages=2)
    orders = {}
    for r in mixing.topic_sample(df, p).distinct().collect():
        orders.setdefault(r.lang, []).append(r.order)
    assert set(orders) == {"en", "rare", None} and 100 <= len(orders["en"]) < 400 and len(orders["rare"]) == 60 and 100 <= len(orders[None]) < 400
    model = mixing.learn_topics(df, p)
    assert set(model) == {"en", "rare", None}
    # as k-means over the first hundred distinct rows
    rows_of = {r.order: r.text for r in mixing.topic_sample(df, p).where("lang = 'en'").collect()}
    first = [at for _, at in mixing._classes([rows_of[o] for o in sorted(rows_of)[:100]])]
    assert np.array_equal(model["en"], mixing.k_means(first, p))
    got = {(r.doc_id, r.lang): r.mix_topic for r in mixing.with_topic(df, model).collect()}
    assert len({v for (_, g), v in got.items() if g and g.startswith("tiny")}) > 30 and got[9, "signs"] == "signs/0" and got[8, None] == "(none)/0"


def test_mixing_edges(spark):
    df = spark.createDataFrame([(1, None, None, None, 5), (2, "", "en", "a", 5), (None, "some words", "en", None, 5), (3, "some words", "de", "a", 5), (3, "some words", "de", "a", 5)], "doc_id bigint, text string, lang string, source string, mix_weight int")
    df = df.selectExpr("*", "1 AS weight", "2 AS p", "'t' AS topic", "3 AS many", "'o' AS observed", "4 AS __many")
    got = mixing.mix(df).collect()
    assert mixing.mix(df).columns == [*(c for c in df.columns if c != "mix_weight"), *(f"mix_{c}" for c in mixing.MADE)]
    assert len(got) == 5 and all(r.mix_probability == 1.0 for r in got if not r.mix_tokens)
    assert len({r.mix_kept for r in got if r.doc_id == 3}) == 1
    assert mixing.mix(df.limit(0)).collect() == []
