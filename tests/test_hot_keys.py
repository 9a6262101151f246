"""Work that a hot card, value or hub must not bring into one task equals the plain form."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskgraph.operators import cards, reports
from riskgraph.operators.quantiles import quantiles

PS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.95, "e": 1.0}


@pytest.mark.parametrize("levels", [1, 3])
def test_quantiles_equal_numpy(spark, levels):
    rng = random.Random(levels)
    values = {"hot": [rng.choice([0.0, -3.5, 1e-9, 7.25, rng.gauss(0, 1000), rng.random() * 1e12]) for _ in range(1500)], "one": [4.0], "two": [1.0, 2.0], None: [rng.random() for _ in range(40)], "near": [1.0 + i * 1e-13 for i in range(50)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("hot", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r for r in quantiles(df, ["k"], "v", PS, levels).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        assert np.allclose([got[k][n] for n in PS], np.quantile(vs, list(PS.values())), rtol=1e-12, atol=0)


def test_no_task_gets_a_hot_groups_values(spark):
    """Of a group of half of all rows, the last step sees only the ranges that hold the ranks."""
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * 0.01).alias("v"))
    got = quantiles(df.where("k = 'hot'"), ["k"], "v", {"m": 0.5}).first()
    assert abs(got.m - 99.99) < 1e-9
    at = F.floor(F.log1p("v") * 64)
    sizes = [r["n"] for r in df.where("k = 'hot'").groupBy(at).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 10_000 / 30


def table(spark, seed, n=900):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        card = "hot" if rng.random() < 0.5 else f"K{rng.randint(0, 4)}"
        minutes = rng.choice([rng.randint(0, 200_000), 11_520 * rng.randint(0, 12), 2880 * rng.randint(0, 50)])  # with ties, and on the edges of buckets
        rows.append((f"{i:04}", card, f"C{rng.randint(0, 9)}", start + timedelta(minutes=minutes), rng.choice([1.0, 20.25, 99.5, 300.0]), rng.choice(["online", "in_person"]), rng.choice(["1", "2", "3", None])))
    return spark.createDataFrame(rows, "txn_id string, card_id string, customer_id string, ts timestamp, amt double, channel string, addr1 string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_baseline_of_hot_cards(spark):
    txn = table(spark, 1)
    assert cards.baseline(txn, hot=60).exceptAll(cards.baseline(txn)).count() == 0 and cards.baseline(txn, hot=60).count() == 6
    assert reports.distribution_stats(txn, "amt", hot=0).collect() == reports.distribution_stats(txn, "amt").collect()
    cases = txn.select(F.col("amt").alias("exposure_usd"), "channel", "addr1")
    assert sorted(reports.exposure_quantiles(cases, ("channel", "addr1"), 0).collect(), key=str) == sorted(reports.exposure_quantiles(cases, ("channel", "addr1")).collect(), key=str)


@pytest.mark.parametrize("before, after", [(48, 48), (0, 48), (48, 0)])
def test_windows_in_time_buckets_equal_whole_windows(spark, before, after):
    txn = table(spark, before + 2 * after).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    made = {"n": F.count("*"), "s": F.sum(F.col("amt").cast("decimal(18,2)")), "m": F.max("amt")}
    w = Window.partitionBy("card_id").orderBy("us").rangeBetween(-before * cards.HOUR, after * cards.HOUR)
    want = txn.withColumns({c: e.over(w) for c, e in made.items()})
    got = cards.around(txn, before * cards.HOUR, after * cards.HOUR, made)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    hot = cards.spread(txn.where("card_id = 'hot'"), before * cards.HOUR, after * cards.HOUR)
    assert hot.select("bucket").distinct().count() > 8 and hot.count() < 2.3 * txn.where("card_id = 'hot'").count()


def test_region_of_an_alert_without_a_transaction(spark):
    txn = table(spark, 5)
    last = {r.card_id: r.flagged_txn_id for r in cards.last_in_person(txn).collect()}
    named = spark.createDataFrame([("a", "hot", last["hot"]), ("b", "K1", last["K1"])], "case_id string, card_id string, flagged_txn_id string")
    open_ = named.withColumn("flagged_txn_id", F.lit(None).cast("string")).union(spark.createDataFrame([("c", "nobody", None)], named.schema))
    assert sorted(cards.region_anomaly(txn, open_).collect()) == sorted(cards.region_anomaly(txn, named).collect())
