"""Sections of policies, published tables, sketches, disagreements, reports and point-in-time features on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskgraph.operators import features, network, policy, reports, retrieval
from riskgraph.plans import registry
from riskgraph.sources import files

DAY = dt.datetime(2024, 1, 1)


POLICY = """Preface.
# Card policy
Applies to all.
## 3. Rules
**R1. Verify first.** Ask the holder
before a block.
**R2. Block.** When denied.
### 3a. A case is no report
Both may be needed.
**R9. Unknown pattern.**
## 4. Stopping
At 0.85.
#hashtag **R5** and ** R6. no ** stay text."""


def test_sections_have_ids_titles_and_parents(spark):
    got = retrieval.policy_sections(spark.createDataFrame([(1, POLICY)], "doc_id long, text string")).orderBy("n").collect()
    assert [(r.n, r.kind, r.ref, r.title, r.parent) for r in got] == [
        (0, "text", None, "", None), (1, "section", None, "Card policy", None), (2, "section", "3", "Rules", 1), (3, "rule", "R1", "Verify first.", 2), (4, "rule", "R2", "Block.", 2),
        (5, "section", "3a", "A case is no report", 2), (6, "rule", "R9", "Unknown pattern.", 5), (7, "section", "4", "Stopping", 1),
    ]
    assert [r.body for r in got] == ["Preface.", "Applies to all.", "", "Ask the holder\nbefore a block.", "When denied.", "Both may be needed.", "", "At 0.85.\n#hashtag **R5** and ** R6. no ** stay text."]


def test_sections_of_null_empty_repeated_and_long_documents(spark):
    long = "\n".join(f"## {i}. Part\nbody {i}" for i in range(2000))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "# A"), (3, "# A"), (None, long)], "doc_id long, text string")
    got = retrieval.policy_sections(docs).collect()
    assert sorted((r.doc_id, r.kind, r.title, r.body) for r in got if r.doc_id) == [(1, "text", "", ""), (2, "text", "", ""), (3, "section", "A", ""), (3, "section", "A", "")]
    assert [(r.n, r.ref, r.body, r.parent) for r in sorted((r for r in got if r.doc_id is None), key=lambda r: r.n)] == [(i, str(i), f"body {i}", None) for i in range(2000)]
    assert retrieval.policy_sections(docs.limit(0)).count() == 0


@pytest.fixture
def plain_plans(spark):
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_published_tables_join_without_exchange_and_read_only_their_months(spark, plain_plans):
    rows = spark.range(400).select((F.col("id") % 7).cast("string").alias("card_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(int(id % 100))").alias("ts"), "id")
    rows = rows.union(spark.sql("select 'x', cast(null as timestamp_ntz), 1000L"))
    names = []
    for n in ("a", "b"):
        names.append(f"published_{n}")
        files.publish_tables(rows, names[-1], files.scratch(spark, n), buckets=4)
    a, b = (spark.table(n) for n in names)
    joined = a.where("month = '2024-02'").join(b.where("month >= '2024-03'").groupBy("card_id").agg(F.count("*").alias("later")), "card_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PartitionFilters: [isnotnull(month" in plan
    want = rows.where("month(ts) = 2").count()
    assert joined.count() == want and a.count() == 401 and a.where("month is null").count() == 1


def test_buckets_follow_the_rows():
    assert [files.buckets_for(n, 100) for n in (0, 1, 100, 101, 200, 201, 1600, 1601)] == [1, 1, 1, 2, 2, 4, 16, 32]


def test_sketches_find_the_exact_ranking(spark):
    uses = spark.range(60_000).select(F.concat(F.lit("d"), (F.col("id") % 50).cast("string")).alias("device"), F.pmod(F.xxhash64("id"), 20 + 40 * (F.col("id") % 50)).cast("string").alias("card_id"), F.lit(1.0).alias("amt"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(int(id % 9))").alias("ts"))
    sketches = network.fanout_sketches(uses)
    assert sketches.count() == len({(i % 50, i % 9) for i in range(60_000)})
    merged = sketches.groupBy("device").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("e")).join(network.fanout(uses), "device").collect()
    assert all(abs(r.e - r.n_cards) <= 6 * 1.04 / 64 * r.n_cards + 1 for r in merged)
    assert network.fanout_ranking_by_sketch(uses, sketches, 5).collect() == network.fanout_ranking(uses, 5).collect()
    assert network.fanout_ranking_by_sketch(uses.limit(0), sketches.limit(0), 5).count() == 0


def test_disagreements_list_what_either_has_alone(spark):
    given = spark.createDataFrame([("a", "none", 1500.0, "denies", 0.9), ("b", "none", 0.0, "confirms", 0.2), ("c", "none", 50.0, "denies", 0.9)], "case_id string, pattern string, exposure_usd double, customer_response string, probability double")
    closed = spark.createDataFrame([("a", "confirmed_fraud", "CREATE_CASE|WARN_CUSTOMER", "No"), ("b", "cleared", "CLOSE_NO_FRAUD", "No"), ("c", "confirmed_fraud", None, None)], "case_id string, outcome string, actions_taken string, report_filed string")
    got = {r.case_id: (r.not_recommended, r.not_recorded, r.filing_differs) for r in policy.disagreements(policy.evaluate(given), closed).collect()}
    assert got == {"a": ("WARN_CUSTOMER", "BLOCK_CARD,FILE_REPORT", True), "c": ("", "CREATE_CASE,BLOCK_CARD", False)}


def test_report_covers_all_affected_transactions(spark):
    case = spark.createDataFrame([("a", "k", "c", "risk_score", "none", "fraud", 0.9, True, "because")], "case_id string, card_id string, customer_id string, trigger_type string, pattern string, verdict string, probability double, file boolean, reason string")
    txn = spark.createDataFrame([("1", 10.0, DAY), ("2", 20.5, DAY + dt.timedelta(days=3))], "txn_id string, amt double, ts timestamp_ntz")
    affected = spark.createDataFrame([("a", "1"), ("a", "2")], "case_id string, txn_id string")
    got = reports.sar_report(case, affected, txn).first()
    assert (got.total, str(got.first_date), str(got.last_date)) == (30.5, "2024-01-01", "2024-01-04") and "It covers 2 transactions with a total of 30.50 dollars." in got.narrative


def test_registered_reports_have_first_and_last_dates(spark, sf_dir):
    got = registry.QUERIES["sar_report"](spark, "/root/testdata/sf0.01").select("first_date", "last_date").collect()
    assert all(r.first_date <= r.last_date for r in got) and any(r.first_date < r.last_date for r in got)


def test_features_of_cases_with_late_missing_and_unknown_histories(spark):
    h = lambda n: DAY + dt.timedelta(hours=n)
    schema = "txn_id string, card_id string, ts timestamp_ntz, amt double, risk_score double, channel string, addr1 string, m1 string, m4 string, m6 string"
    txn = spark.createDataFrame(
        [("1", "k", h(1), 3.0, 0.1, "online", "r", "F", "M0", "T"), ("2", "k", h(2), 4.0, 0.1, "online", "s", "T", None, "T"), ("3", "k", h(2.5), 90.0, 0.6, "online", "s", "T", "M1", "F"), ("4", "k", h(9), 9.0, 0.9, "in_person", None, "T", "M1", "T"), ("5", "late", h(30), 7.0, 0.3, "in_person", "r", "T", "M1", "T"), ("6", "late", h(31), 8.0, 0.4, "online", "r", "T", "M1", "T"), ("7", None, h(1), 8.0, 0.4, "online", "r", "T", "M1", "T")],
        schema,
    )
    cases = spark.createDataFrame(
        [("known", "k", "3", h(5)), ("flagged comes later", "k", "4", h(5)), ("nothing yet", "late", "6", h(5)), ("first of card", "late", None, h(5)), ("no card", "none", "1", h(5)), ("null", None, None, None)],
        "case_id string, card_id string, flagged_txn_id string, opened_at timestamp_ntz",
    )
    identity = spark.createDataFrame([], "txn_id string, id_15 string, id_23 string")
    closed = spark.createDataFrame([], "card_id string, opened_at timestamp_ntz, outcome string")
    got = {r.case_id: r for r in features.case_features(cases, txn, identity, closed, minutes=120).collect()}
    assert set(got) == {"known", "flagged comes later", "nothing yet", "first of card", "no card", "null"}
    r = got["known"]
    assert (r.flagged_amount, r.prior_txns_count, r.txns_24h, r.exposure_48h, r.conf_testing, r.mismatch_count) == (90.0, 2, 3, 97.0, 0.72, 1)
    assert r.concurrent_home_count == 1  # home is r, the smaller of two regions seen once
    assert got["flagged comes later"].flagged_amount == 90.0  # the last one known
    assert (got["nothing yet"].flagged_amount, got["nothing yet"].prior_txns_count) == (8.0, 0)
    assert (got["first of card"].flagged_amount, got["no card"].flagged_amount, got["null"].flagged_amount) == (7.0, 50.0, 50.0)
    stats = {r.case_id: r for r in features.history_stats(features.history(cases, txn)).collect()}
    assert stats["known"].home_region == "r" and stats["known"].prior_p75 == 3.75 and stats["first of card"].home_region == "r" and "null" not in stats


def test_a_bucket_stays_small_as_tables_grow():
    """A month's bucket is sorted by one task, so its rows must not grow with the table."""
    assert all(rows / files.buckets_for(rows) <= 1_000_000 for rows in (6_000_000, 36_000_000, 360_000_000))
