"""Card testing as a stream in event time: order, lateness, expiry, restarts."""

import itertools
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from riskgraph.streaming import streams

SCHEMA = "txn_id string, card_id string, ts timestamp, amt double, channel string"
START = datetime(2024, 1, 1)


class Feed:
    """Files that arrive one by one, each worked by a run that goes on from the checkpoint."""

    def __init__(self, spark, folder, late="60 minutes", minutes=60):
        self.spark, self.folder, self.late, self.minutes = spark.newSession(), folder, late, minutes
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKS)
        self.number = itertools.count()

    def send(self, rows):
        path = f"{self.folder}/in/{next(self.number)}"
        self.spark.createDataFrame([(i, c, START + timedelta(minutes=m), a, ch) for i, c, m, a, ch in rows], SCHEMA).write.parquet(path)
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.folder}/in/*").withWatermark("ts", self.late)
        streams.run_once(streams.card_testing(stream, self.minutes), f"{self.folder}/state", f"{self.folder}/out")
        return sorted(tuple(r) for r in self.spark.read.schema("card_id string, large_txn_id string, probes int, exposure double").parquet(f"{self.folder}/out").collect())

    def state(self, name):
        return self.spark.read.format("statestore").option("path", f"{self.folder}/state").option("stateVarName", name).load().count()


def probes(card, *minutes):
    return [(f"{card}-p{m}", card, m, 2.0, "online") for m in minutes]


def test_rows_out_of_order_late_and_replayed(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    # the purchase arrives before two of its probes; nothing is told before the watermark has passed it
    assert feed.send([("big", "A", 40, 90.0, "in_person"), *probes("A", 10)]) == []
    assert feed.send(probes("A", 20, 30)) == []
    told = [("A", "big", 3, 96.0)]
    assert feed.send([("x", "Z", 120, 1.0, "online")]) == told
    # a run without new files changes nothing, and a row behind the watermark is dropped
    assert feed.send([]) == told
    assert feed.send([("big2", "B", 50, 99.0, "online"), *probes("B", 30, 35, 40)]) == told
    assert feed.send([("y", "Z", 400, 1.0, "online")]) == told


def test_a_silent_card_has_no_state(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), late="10 minutes")
    feed.send(probes("A", 0, 1, 2))
    assert feed.state("pending") == 3 and feed.state("probes") == 0
    feed.send(probes("B", 30))
    assert feed.state("probes") == 3
    feed.send([("big", "A", 58, 70.0, "in_person"), *probes("B", 59)])
    assert feed.send(probes("C", 200)) == [("A", "big", 3, 76.0)]
    assert feed.state("probes") == 0  # A's run ended with the purchase, B's window has passed
    assert feed.state("pending") == 1


def by_hand(rows, minutes=60):
    """The scan that the processor replaces."""
    found, cards = [], {}
    for i, c, m, a, ch in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if ch == "online" and a <= 5:
            cards.setdefault(c, []).append((m, a))
        elif a >= 50:
            run = [p for p in cards.get(c, []) if p[0] >= m - minutes]
            if len(run) >= 3:
                found.append((c, i, len(run), sum(p[1] for p in run) + a))
            cards[c] = []
    return sorted(found)


def test_stream_equals_batch_and_scan(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"{k:04}", f"K{rng.randint(0, 5)}", rng.randint(0, 600), rng.choice([1.0, 2.5, 5.0, 7.0, 50.0, 80.0]), rng.choice(["online", "online", "in_person"])) for k in range(500)]
    feed = Feed(spark, str(tmp_path), late="1000 minutes")
    shuffled = rng.sample(rows, len(rows))
    for part in (shuffled[:200], shuffled[200:]):
        feed.send(part)
    got = feed.send([("end", "none", 5000, 1.0, "online")])
    table = spark.createDataFrame([(i, c, START + timedelta(minutes=m), a, ch) for i, c, m, a, ch in rows], SCHEMA)
    batch = sorted(tuple(r) for r in streams.card_testing_batch(table).collect())
    assert got == batch == by_hand(rows) and len(got) > 10


def test_equal_times_and_one_hot_card(spark):
    rows = [(f"{k:05}", "hot", k // 50, 1.0 if k % 97 else 60.0, "online") for k in range(5000)]
    table = spark.createDataFrame([(i, c, START + timedelta(minutes=m), a, ch) for i, c, m, a, ch in rows], SCHEMA)
    assert sorted(tuple(r) for r in streams.card_testing_batch(table).collect()) == by_hand(rows)
    assert streams.card_testing_batch(table.where(F.lit(False))).collect() == []


def test_velocity_of_a_table_equals_its_windows_and_shuffles_only_panes(spark):
    """Cards with gaps, ties, and missing times, cards and amounts."""
    rng = random.Random(5)
    at = [None] + [datetime(2024, 1, 1) + timedelta(minutes=m) for m in [0, 59, 60] + [int(rng.expovariate(0.0005)) for _ in range(200)]]
    rows = [(rng.choice(["a", "b", "b", "b", None]), rng.choice(at), rng.choice([None, 1.25, -3.5, 0.1, 7.0])) for _ in range(300)] + [("c", at[1], None)]
    txn = spark.createDataFrame(rows, "card_id string, ts timestamp, amt double")
    key = lambda r: (r.card_id or "", r.hours, r.start)
    got = streams.velocity_batch(txn, (24, 48))
    want = streams.velocity(txn, 24).union(streams.velocity(txn, 48))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, sorted(got.collect(), key=key)), key=str) == sorted(map(tuple, sorted(want.collect(), key=key)), key=str)
    plan = streams.velocity_batch(txn, (24, 48))._jdf.queryExecution().executedPlan().toString()  # not run yet
    assert plan.count("Exchange hashpartitioning") == 2 == plan.count("Exchange")


def test_cards_that_share_state_are_told_apart(spark, tmp_path):
    """Thirty cards over two groups, in six files that arrive out of order within the delay."""
    rng = random.Random(11)
    rows = [(f"{k:04}", f"c{rng.randrange(30)}", rng.randrange(300), 2.0 if rng.random() < 0.8 else 60.0, "online") for k in range(900)]
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKS)
    for k in range(7):
        part = rows[k::6] if k < 6 else [("end", "z", 1000, 1.0, "online")]
        session.createDataFrame([(i, c, START + timedelta(minutes=m), a, ch) for i, c, m, a, ch in part], SCHEMA).write.parquet(f"{tmp_path}/in/{k}")
        stream = session.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*").withWatermark("ts", "300 minutes")
        streams.run_once(streams.card_testing(stream, groups=2), f"{tmp_path}/state", f"{tmp_path}/out")
        if k == 5:
            held = session.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "pending").load()
            assert held.count() > 500 and held.select("key").distinct().count() == 2
    got = sorted(tuple(r) for r in spark.read.schema("card_id string, large_txn_id string, probes int, exposure double").parquet(f"{tmp_path}/out").collect())
    assert got == by_hand(rows) and len(got) > 20


def test_velocity_run_by_run_equals_the_stream_of_windows(spark, sf_dir, tmp_path):
    """One stream of panes, taken up in four runs, has the windows that two streams of windows have closed."""
    from riskgraph.plans import report_queries
    from riskgraph.sources.adapter import Tables

    t = Tables(spark, sf_dir)
    assert len(report_queries.in_order(t, 300)) == 4
    got = sorted(map(tuple, report_queries.stream_velocity_run(t, 300).collect()))
    source, *_ = report_queries._stream(t, "velocity-check")
    want = []
    for hours in (24, 48):
        streams.run_once(streams.velocity(streams.ingest(spark, source, report_queries.STREAM_SCHEMA, "txn_id"), hours), f"{tmp_path}/state{hours}", f"{tmp_path}/out{hours}")
        want += map(tuple, spark.read.parquet(f"{tmp_path}/out{hours}").collect())
    assert got == sorted(want) and len(got) > 1000
