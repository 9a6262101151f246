"""Batches and write-backs that fail or come again; chains, clusters and components by hand."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskgraph.operators import graph, memory, network
from riskgraph.streaming import streams

SCHEMA = "txn_id string, card_id string, ts timestamp, amt double"
START = datetime(2024, 1, 30)


def batch(spark, *rows):
    return spark.createDataFrame([(i, "K", START + timedelta(days=d), a) for i, d, a in rows], SCHEMA)


def stored(spark, path):
    return sorted((r.txn_id, r.amt, r.month) for r in spark.read.schema(SCHEMA + ", month string, batch bigint").parquet(path).collect())


def test_replayed_and_failed_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    streams.open_table(spark, path, SCHEMA)
    streams.open_table(spark, path, SCHEMA)
    streams.put_batch(batch(spark, ("a", 0, 1.0), ("b", 5, 2.0), ("b", 5, 2.0)), 0, path)
    want = [("a", 1.0, "2024-01"), ("b", 2.0, "2024-02")]
    assert stored(spark, path) == want
    second = batch(spark, ("b", 5, 9.0), ("c", 6, 3.0), ("d", 40, 4.0))
    broken = second.withColumn("amt", F.when(F.col("txn_id") == "d", F.raise_error(F.lit("lost"))).otherwise(F.col("amt")))
    with pytest.raises(Exception, match="lost"):
        streams.put_batch(broken, 1, path)
    assert stored(spark, path) == want
    for _ in range(2):  # after its failure, and once more
        streams.put_batch(second, 1, path)
        assert stored(spark, path) == [*want, ("c", 3.0, "2024-02"), ("d", 4.0, "2024-03")]
    streams.put_batch(batch(spark, ("a", 0, 1.0), ("b", 5, 2.0), ("b", 5, 2.0)), 0, path)
    assert stored(spark, path) == [*want, ("c", 3.0, "2024-02"), ("d", 4.0, "2024-03")]


def test_a_stream_in_batches(spark, tmp_path):
    path, state, source = (str(tmp_path / x) for x in ("t", "s", "in"))
    streams.open_table(spark, path, SCHEMA)
    for k, rows in enumerate([[("a", 0, 1.0)], [("a", 0, 1.0), ("b", 1, 2.0)], []]):
        batch(spark, *rows).write.parquet(f"{source}/{k}")
        streams.ingest_batches(spark.readStream.schema(SCHEMA).parquet(f"{source}/*"), path, state)
    assert stored(spark, path) == [("a", 1.0, "2024-01"), ("b", 2.0, "2024-01")]


def test_a_write_back_is_seen_whole_or_not(spark, tmp_path):
    path = str(tmp_path / "w")
    cases = spark.createDataFrame([("c1", "open"), ("c2", "open")], "case_id string, outcome string")
    evidence = spark.createDataFrame([("c1", "z", "graph", "q"), ("c1", "a", "graph", "q"), ("c9", "a", "graph", "q")], "case_id string, claim string, source string, ref string")
    affected = spark.createDataFrame([("c1", "t1"), ("c1", "t1"), ("c2", "t2")], "case_id string, txn_id string")
    similar = spark.createDataFrame([("c1", "old")], "from_id string, to_id string")
    unit = memory.unit_of(cases, evidence, affected, similar)
    memory.write_unit(path, 0, unit)
    failing = unit | {"similar_to": similar.withColumn("to_id", F.raise_error(F.lit("lost")).cast("string"))}
    with pytest.raises(Exception, match="lost"):
        memory.write_unit(path, 1, failing)
    assert {r.unit for r in memory.read_unit(spark, path, "case").collect()} == {0}
    memory.write_unit(path, 0, unit)
    got = {name: sorted(tuple(r)[1:] if r[0] == 0 else tuple(r)[:-1] for r in memory.read_unit(spark, path, name).collect()) for name in unit}
    assert [r[:3] for r in got["evidence"]] == [("EV-c1-1", "c1", "a"), ("EV-c1-2", "c1", "z")]
    assert len(got["case"]) == 2 and len(got["raised"]) == 2 and len(got["similar_to"]) == 1


def test_equal_versions_have_an_order(spark):
    base = spark.createDataFrame([("k", 1, 5.0, "x"), ("k", 1, None, "z"), ("m", 2, 1.0, "a")], "id string, version int, amt double, note string")
    new = spark.createDataFrame([("k", 1, 7.0, "a"), ("k", 1, 7.0, "b"), ("m", 1, 9.0, "q"), (None, 1, 1.0, "n")], base.schema)
    got = sorted(map(tuple, graph.upsert(base, new, ["id"], "version").collect()), key=str)
    assert got == [("k", 1, 7.0, "b"), ("m", 2, 1.0, "a"), (None, 1, 1.0, "n")]


def test_chains_rise_along_each_edge(spark):
    at = lambda s: START + timedelta(seconds=s)
    txn = [(c, i, at(s)) for c in "pqrs" for i, s in (("1", 0), ("2", 5), ("3", 9), ("4", 20), ("5", 20))]
    good = [("1", "2"), ("2", "3"), ("3", "4"), ("4", "5")]
    edges = [("p", a, b, 0) for a, b in good] + [("q", a, b, 0) for a, b in [("1", "2"), ("2", "3"), ("4", "5"), ("5", "4")]]  # a chain beside a cycle of no seconds
    edges += [("r", a, b, 0) for a, b in good[:3]] + [("s", a, b, 0) for a, b in [("1", "2"), ("1", "3"), ("3", "4"), ("4", "5")]]
    found = graph.next_chain_integrity(spark.createDataFrame(txn, "card_id string, txn_id string, ts timestamp"), spark.createDataFrame(edges, "card_id string, from_id string, to_id string, delta_sec int"))
    assert {r.card_id: r.is_chain for r in found.collect()} == {"p": True, "q": False, "r": False, "s": False}


def clusters_by_hand(rows, least, width):
    out = []
    for amt in {r[0] for r in rows}:
        times = sorted({m for a, _, m in rows if a == amt})
        inside = lambda m: [c for a, c, t in rows if a == amt and m - width < t <= m]
        full = [m for m in times if len(set(inside(m))) >= least]
        runs = []
        for m in full:
            if runs and m - runs[-1][-1] < width:
                runs[-1].append(m)
            else:
                runs.append([m])
        out += [(amt, r[0], r[-1], max(len(set(inside(m))) for m in r), max(len(inside(m)) for m in r)) for r in runs]
    return sorted(out)


def test_clusters_of_equal_amounts_slide(spark):
    rng = random.Random(2)
    rows = [(rng.choice([5.0, 7.5]), f"C{rng.randint(0, 5)}", rng.choice([rng.randint(0, 30_000), 1440 * rng.randint(0, 20)])) for _ in range(150)]
    rows += [(9.99, c, 1440 * 3 + m) for c, m in (("a", -20), ("b", 5), ("c", 20))]  # forty minutes over midnight
    rows += [(8.0, "same", m) for m in range(10)] + [(6.0, "x", 0), (6.0, "y", 10), (6.0, "z", 1440)]
    txn = spark.createDataFrame([(a, c, START + timedelta(minutes=m)) for a, c, m in rows], "amt double, customer_id string, ts timestamp")
    minutes = lambda t: int((t - START).total_seconds() // 60)
    got = sorted((r.amt, minutes(r.reached_at), minutes(r.last_at), r.n_customers, r.n_txns) for r in network.identical_amounts(txn).collect())
    want = clusters_by_hand(rows, 3, 1440)
    assert got == want and any(r[0] == 9.99 for r in got) and not any(r[0] in (8.0, 6.0) for r in got)


def components_by_hand(edges):
    label = {}
    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
    while True:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] != low:
                    label[x], moved = low, True
        if not moved:
            return sorted(label.items())


@pytest.mark.parametrize("share", [2, 10_000])
def test_components_with_chains_and_hubs(spark, share):
    rng = random.Random(share)
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(70)] + [("hub", f"n{i:03}") for i in range(150)] + [(f"z{rng.randint(0, 60)}", f"z{rng.randint(0, 60)}") for _ in range(40)] + [("me", "me"), ("hub", "n000"), ("n000", "hub")]
    rng.shuffle(edges)
    got = network.components(spark.createDataFrame(edges, "a string, b string"), share)
    assert sorted(map(tuple, got.collect())) == components_by_hand(edges)
    assert network.components(spark.createDataFrame([], "a string, b string")).collect() == []
