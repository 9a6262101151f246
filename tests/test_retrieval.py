"""Retrieval: whole jobs, and the search with bounds against brute force."""

import math
import random
from collections import defaultdict

import pytest

import __spark_entry__ as contract
from riskgraph.operators import retrieval


def test_similar_cases_of_every_case(spark, sf_dir):
    cases = contract.queries()["scan_closed_cases"](spark, sf_dir).count()
    assert contract.queries()["similar_cases"](spark, sf_dir).select("query_id").distinct().count() == cases > 0


def test_whole_index_and_all_queries(spark, sf_dir):
    whole = contract.queries()["tfidf_index"](spark, sf_dir)
    assert whole.where("weight <= 0.2").limit(1).count() == 1
    asked = whole.where("doc_id % 20 = 0").select("doc_id").distinct().count()
    assert contract.queries()["search_documents"](spark, sf_dir).select("query_id").distinct().count() == asked > 0


def by_hand(index, queries, k):
    docs, out = defaultdict(dict), []
    for d, t, w in index:
        docs[d][t] = w
    asked = defaultdict(dict)
    for q, t, w in queries:
        asked[q][t] = w
    for q, v in asked.items():
        scores = [(math.floor(sum(w * x.get(t, 0) for t, w in v.items()) * 1e6 + 0.5) / 1e6, d) for d, x in docs.items() if d != q]
        out += [(q, d, s, n + 1) for n, (s, d) in enumerate(sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1]))[:k])]
    return sorted(out)


def by_spark(spark, index, queries, k, **more):
    schema = "doc_id bigint, term string, weight double"
    found = retrieval.search(spark.createDataFrame(index, schema), spark.createDataFrame(queries, schema).withColumnRenamed("doc_id", "query_id"), k, **more)
    return sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in found.collect())


def texts(seed, n=120):
    """Documents of which a third are copies of one, many are alike but for a word, and some have only rare words."""
    rng, index = random.Random(seed), []
    for d in range(n):
        if d % 3 == 0:
            bag = ["same", "old", "story"]
        elif d % 3 == 1:
            bag = ["same", "old", rng.choice("abcd")] + [f"r{rng.randint(0, 40)}"]
        else:
            bag = [f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(rng.randint(1, 25))] + [f"r{rng.randint(0, 40)}"] * rng.randint(0, 1)
        count = {t: 1 + math.log(bag.count(t)) for t in bag}
        norm = math.sqrt(sum(c * c for c in count.values()))
        index += [(d, t, round(c / norm, 3)) for t, c in count.items()]
    return index


@pytest.mark.parametrize("pairs", [0, 2, 10_000])
def test_search_equals_brute_force(spark, pairs):
    index = texts(pairs)
    queries = [r for r in index if r[0] % 7 == 0] + [(500, "same", 0.6), (500, "elsewhere", 0.8), (501, "nowhere", 1.0)]
    assert by_spark(spark, index, queries, 3, pairs=pairs) == by_hand(index, queries, 3)


def test_search_of_nothing(spark):
    assert by_spark(spark, [], [(1, "a", 1.0)], 3) == by_spark(spark, [(1, "a", 1.0)], [], 3) == []


def test_a_category_filters_before_the_ranks(spark):
    index = texts(8)
    schema = "doc_id bigint, term string, weight double"
    among = spark.createDataFrame([(d,) for d in range(0, 120, 2)] * 2, "doc_id bigint")
    asked = [r for r in index if r[0] < 10]
    got = retrieval.search(spark.createDataFrame(index, schema), spark.createDataFrame(asked, schema).withColumnRenamed("doc_id", "query_id"), 4, among=among)
    assert sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in got.collect()) == by_hand([r for r in index if r[0] % 2 == 0], asked, 4)


def test_similar_cases_equal_brute_force_and_few_pairs_meet(spark):
    from riskgraph.sources.adapter import Tables

    notes = retrieval.note_documents(Tables(spark, "/root/testdata/sf0.01").closed_case)
    index = spark.createDataFrame(retrieval.tfidf_index(notes).collect(), "doc_id string, term string, weight double")
    search = retrieval.Search.of(index, index.withColumnRenamed("doc_id", "query_id"), 3)
    got = sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in search.run().collect())
    rows = [tuple(r) for r in index.collect()]
    some = {d for d, _, _ in rows if d.endswith("7")}
    want = by_hand(rows, [r for r in rows if r[0] in some], 3)
    assert [(q, d, n) for q, d, _, n in got if q in some] == [(q, d, n) for q, d, _, n in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip([r for r in got if r[0] in some], want))
    n = notes.count()
    assert sum(df.count() for df in search.met) < n * n / 10


@pytest.mark.parametrize("k", [1, 3])
def test_search_in_blocks_equals_brute_force(spark, monkeypatch, k):
    """Copies over many small blocks, ids as numbers and strings, texts without terms; what is shuffled is no pair."""
    monkeypatch.setattr(retrieval, "BLOCK", {"doc": 7, "query": 5})
    monkeypatch.setattr(retrieval, "HELD", 10)
    monkeypatch.setattr(retrieval, "DENSE", 6)
    rng = random.Random(k)
    bodies = [rng.choice(["same old story", "same old tale", None, "", " ".join(f"w{int(rng.expovariate(0.1))}" for _ in range(rng.randint(1, 25)))]) for _ in range(150)]
    for kind, name in (("bigint", lambda i: i), ("string", lambda i: f"D-{i}")):
        docs = spark.createDataFrame([(name(i), b, i) for i, b in enumerate(bodies)], f"doc_id {kind}, content string, n int").repartition(4)
        index = [tuple(r) for r in retrieval.tfidf_index(docs).collect()]
        asked = {name(i) for i in range(0, 150, 2)}
        got = retrieval.search_documents(docs, docs.where("n % 2 = 0"), k, among=docs.where("n % 3 > 0"))
        want = by_hand([r for r in index if r[0] in {name(i) for i in range(150) if i % 3}], [r for r in index if r[0] in asked], k)
        assert sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in got.collect()) == want


@pytest.mark.parametrize("alike", [False, True])
def test_copies_meet_once_and_each_is_answered(spark, monkeypatch, alike):
    """300 documents of few texts over five partitions, of which a task puts only some together: the results are those of brute force, and blocks hold a text once with its k + 1 first ids."""
    monkeypatch.setattr(retrieval, "BLOCK", {"doc": 4, "query": 3})
    monkeypatch.setattr(retrieval, "TOGETHER", 1000)
    rng = random.Random(7)
    bodies = ["same old story", "old story same same", "same old tale", "", "one alone"] + [rng.choice(["same old story", "same old tale", f"tale w{rng.randint(0, 5)}"]) for _ in range(295)]
    docs = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "doc_id bigint, content string").repartition(5)
    index = [tuple(r) for r in retrieval.tfidf_index(docs).collect()]
    got = retrieval.search_documents(docs, docs.where("doc_id % 2 = 0"), 3, alike=alike)
    assert sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in got.collect()) == by_hand(index, [r for r in index if r[0] % 2 == 0], 3)
    classes = retrieval._weighed(docs, retrieval.vocabulary(docs), "content", retrieval.STOP_WORDS, True, 4).collect()
    assert len({bytes(c.key) for c in classes}) <= 10 and max(len(c.ids) for c in classes) == 4 and len(classes) < 290


@pytest.mark.parametrize("adds", [1, 5, 10_000])
def test_products_are_added_some_at_a_time(spark, monkeypatch, adds):
    """Scores don't depend on how many products are worked at once; long texts, counts of more than a byte, one frequent term and rare ones."""
    monkeypatch.setattr(retrieval, "ADDS", adds)
    monkeypatch.setattr(retrieval, "BLOCK", {"doc": 9, "query": 4})
    monkeypatch.setattr(retrieval, "DENSE", 2)
    rng = random.Random(adds)
    bodies = ["often " * 70_000 + "rare", "often " * 300, "often rare", None] + [" ".join(f"w{int(rng.expovariate(0.2))}" for _ in range(rng.randint(1, 30))) for _ in range(40)]
    docs = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "doc_id bigint, content string").repartition(3)
    index = [tuple(r) for r in retrieval.tfidf_index(docs).collect()]
    got = retrieval.search_documents(docs, docs.where("doc_id % 2 = 0"), 3, alike=True)
    assert sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in got.collect()) == by_hand(index, [r for r in index if r[0] % 2 == 0], 3)


@pytest.mark.parametrize("name", ["search_documents", "search_in_category"])
def test_copies_of_other_tasks_meet_once_too_and_counts_travel_for_weights(spark, sf_dir, name):
    plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(ids" in plan and "counts" in plan and "weights" not in plan
