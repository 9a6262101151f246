"""Hand-made rows: boundaries, ties and empty histories."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskgraph.functions.params import CardTesting
from riskgraph.operators import cards, evaluate, graph, network, policy
from riskgraph.operators.reports import sentence_count

T0 = datetime(2024, 1, 1)
TXN = "txn_id string, card_id string, customer_id string, ts timestamp_ntz, amt double, channel string, product_cd string, addr1 string, p_email string, m1 string, m4 string, m6 string, risk_score double"


def txns(spark, rows):
    """Rows of (id, card, seconds, amount, channel[, region])."""
    full = [(i, c, "C" + c, T0 + timedelta(seconds=s), a, ch, "W", *(rest or (None,)), None, "T", "M0", "T", 0.1) for i, c, s, a, ch, *rest in rows]
    return spark.createDataFrame(full, TXN)


def scan_by_hand(rows, p):
    """The forward scan, as plainly as possible."""
    found = {}
    for card in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == card), key=lambda r: (r[2], r[0]))
        hit = None
        for i, r in enumerate(own):
            if hit or not (r[4] == "online" and r[3] <= p.max_auth):
                continue
            run = [r]
            for n in own[i + 1 :]:
                if n[2] - r[2] > p.window_minutes * 60:
                    break
                if n[4] == "online" and n[3] <= p.max_auth:
                    run.append(n)
                elif n[3] >= p.large:
                    if len(run) >= 3:
                        hit = (len(run), n[0], round(sum(x[3] for x in run) + n[3], 2))
                    break
        probes = [r for r in own if r[4] == "online" and r[3] <= p.max_auth]
        if len(own) >= 2 and not hit and len(probes) >= 3:
            hit = (len(probes), None, round(sum(x[3] for x in probes), 2))
        found[card] = hit or (0, None, 0.0)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_card_testing_equals_a_forward_scan(spark, seed):
    rng = random.Random(seed)
    p = CardTesting(window_minutes=60)
    rows = [(f"{i:04d}", f"K{rng.randint(0, 9)}", rng.randint(0, 200) * 120, rng.choice([1.0, 2.5, 5.0, 20.0, 50.0, 120.0]), rng.choice(["online", "online", "in_person"])) for i in range(300)]
    got = {r.card_id: (r.probe_count, r.large_txn_id, round(r.exposure, 2)) for r in cards.card_testing(txns(spark, rows), p).collect()}
    want = scan_by_hand(rows, p)
    counts = {c: sum(1 for r in rows if r[1] == c) for c in want}
    assert {c: v for c, v in got.items() if counts[c] >= 2} == {c: v for c, v in want.items() if counts[c] >= 2}


def test_card_testing_window_edge(spark):
    probes = lambda c: [(f"{c}{i}", c, i, 1.0, "online") for i in range(3)]
    rows = [*probes("A"), ("A9", "A", 3600, 60.0, "in_person"), *probes("B"), ("B9", "B", 3601 + 2, 150.0, "online"), ("C1", "C", 0, 1.0, "online")]
    got = {r.card_id: r.confidence for r in cards.card_testing(txns(spark, rows)).collect()}
    assert got == {"A": 0.86, "B": 0.55, "C": 0.0}


def test_single_transaction_baseline_and_ties(spark):
    t = txns(spark, [("1", "A", 0, 10.0, "online", "r2"), ("2", "B", 0, 1.0, "online", "r2"), ("3", "B", 0, 3.0, "online", "r1")])
    got = {r.card_id: r for r in cards.baseline(t).collect()}
    assert got["A"].std == 0 and got["A"].p95 == 10.0 and got["B"].median == 2.0
    assert {r.card_id: r.home_region for r in cards.home_region(t).collect()} == {"A": "r2", "B": "r1"}
    assert [(r.from_id, r.to_id) for r in graph.next_edges(t).collect()] == [("2", "3")]


def test_device_key_of_absent_parts(spark):
    rows = [(None, "", "nan", "None"), ("unknown", "null", " ", None), ("Dev", None, "chrome", "nan")]
    df = spark.createDataFrame(rows, "device_info string, id_30 string, id_31 string, id_33 string")
    assert [r[0] for r in df.select(graph.device_key()).collect()] == ["unknown", "unknown", "Dev | chrome"]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z1", "z2")], "a string, b string")
    got = {r.node: r.component for r in network.components(edges).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and got["z2"] == "z1"


def test_greedy_exploration_tries_the_next_row(spark):
    t = txns(spark, [("1", "A", 0, 9.0, "online"), ("2", "B", 0, 8.0, "online"), ("3", "B", 1, 7.0, "online")]).withColumn("risk_score", F.lit(0.9))
    uses = spark.createDataFrame([("d", "1"), ("d", "2"), ("e", "3")], "device string, txn_id string").join(t.drop("device"), "txn_id").select("device", "card_id", "customer_id", "txn_id", "ts", "amt")
    none = spark.createDataFrame([], "case_id string, flagged_txn_id string, card_id string")
    assert sorted(r.txn_id for r in network.exploration_candidates(t, uses, none, "2023-01-01").collect()) == ["1"]
    assert sorted(r.txn_id for r in network.exploration_greedy(t, uses, none, "2023-01-01").collect()) == ["1", "3"]


def test_auc_of_equal_scores_and_of_one_class(spark):
    s = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, p double")
    assert evaluate.roc_auc(s).first().auc == 0.5
    assert evaluate.roc_auc(s.where("y = 1")).first().auc is None
    assert evaluate.binary_metrics(s).first().precision == 0.0


@pytest.mark.parametrize("exposure,route", [(2500.0, "L1"), (2500.01, "L2"), (0.0, "L1")])
def test_block_route(spark, exposure, route):
    assert spark.range(1).select(policy.action_route(F.lit("BLOCK_CARD"), F.lit(exposure))).first()[0] == route


CASES = [
    # probability, further fields, actions in order
    (0.14, {}, "ALLOW_TRANSACTION,STEP_UP_AUTH,VERIFY_WITH_CUSTOMER"),
    (0.14, {"single_signal": True}, "ALLOW_TRANSACTION,STEP_UP_AUTH,VERIFY_WITH_CUSTOMER"),
    (0.30, {}, "STEP_UP_AUTH,VERIFY_WITH_CUSTOMER,CREATE_CASE"),
    (0.29, {}, "STEP_UP_AUTH,VERIFY_WITH_CUSTOMER"),
    (0.70, {}, "CREATE_CASE,BLOCK_CARD"),
    (0.70, {"exposure_usd": 999.99}, "CREATE_CASE,BLOCK_CARD"),
    (0.70, {"exposure_usd": 1000.0}, "CREATE_CASE,BLOCK_CARD,FILE_REPORT"),
    (0.50, {"exposure_usd": 500.01}, "STEP_UP_AUTH,VERIFY_WITH_CUSTOMER,CREATE_CASE,ESCALATE_TO_ANALYST"),
    (0.90, {"customer_response": "confirmed"}, "CLOSE_NO_FRAUD"),
    (0.10, {"customer_response": "no-reply"}, "DECLINE_TRANSACTION,MONITOR_CARD"),
    (0.10, {"customer_response": "no_reply", "exposure_usd": 600.0}, "DECLINE_TRANSACTION,CREATE_CASE,MONITOR_CARD,ESCALATE_TO_ANALYST"),
    (0.90, {"customer_response": "denied", "recurring_match": True}, "VERIFY_WITH_CUSTOMER,WARN_CUSTOMER,CREATE_CASE"),
    (0.20, {"customer_response": "denies", "pending_auths": True}, "DECLINE_TRANSACTION,CREATE_CASE,BLOCK_CARD"),
    (0.80, {"shared_origin": "device"}, "CREATE_CASE,BLOCK_CARD,MONITOR_CONNECTED_CARDS,FILE_REPORT"),
    (0.80, {"shared_origin": "None", "connected_cards_count": 1}, "CREATE_CASE,BLOCK_CARD"),
    (0.80, {"cards_confirmed_fraud_count": 2}, "CREATE_CASE,BLOCK_CARD,BLOCK_ALL_CARDS"),
    (0.90, {"pattern": "undocumented"}, "CREATE_CASE,BLOCK_CARD,FILE_REPORT,ESCALATE_TO_ANALYST"),
    (0.60, {"pattern": "undocumented"}, "STEP_UP_AUTH,VERIFY_WITH_CUSTOMER,CREATE_CASE"),
    (0.90, {"pattern": "card_testing", "exposure_usd": 80.0}, "DECLINE_TRANSACTION,STEP_UP_AUTH,CREATE_CASE"),
    (0.90, {"pattern": "card_testing", "has_cleared_over_100": True}, "DECLINE_TRANSACTION,CREATE_CASE,BLOCK_CARD"),
    (0.90, {"evidence_conflict": True}, "CREATE_CASE,BLOCK_CARD,ESCALATE_TO_ANALYST"),
]


def test_policy_table(spark):
    names = list(policy.DEFAULTS)
    rows = [(str(i), p, *(f.get(n) for n in names)) for i, (p, f, _) in enumerate(CASES)]
    kinds = {"pattern": "string", "exposure_usd": "double", "customer_response": "string", "shared_origin": "string", "cards_confirmed_fraud_count": "int", "connected_cards_count": "int"}
    df = spark.createDataFrame(rows, "case_id string, probability double, " + ", ".join(f"{n} {kinds.get(n, 'boolean')}" for n in names))
    got = {r.case_id: r.a for r in policy.evaluate(df).select("case_id", policy.action_names().alias("a")).collect()}
    assert [got[str(i)] for i in range(len(CASES))] == [a for _, _, a in CASES]


def test_sentences(spark):
    df = spark.createDataFrame([("One is. Two are! No. And three?",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(sentence_count(F.col("t"))).collect()][:2] == [3, 0]


def test_activity_of_one_customer_is_shared_by_tasks(spark):
    """Times on the edges of the window and of stretches, missing ones, two alerts on a transaction; one customer's pairs come from many tasks."""
    start = datetime(2024, 1, 3)
    txn = [(str(i), "c" if i % 9 else "d", start + timedelta(hours=12 * i) if i % 31 else None, float(i)) for i in range(120)]
    alerts = [(f"A{n}-{i}", str(i)) for i in range(0, 120, 5) for n in range(1 + (i == 50))]
    got = cards.activity_window(spark.createDataFrame(txn, "txn_id string, customer_id string, ts timestamp_ntz, amt double"), spark.createDataFrame(alerts, "case_id string, flagged_txn_id string"))
    of = {t[0]: t for t in txn}
    want = [(a, t[0], t[2], t[3], t[0] == f) for a, f in alerts for t in txn if of[f][2] and t[2] and t[1] == of[f][1] and abs(t[2] - of[f][2]) <= timedelta(days=7)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 10


def test_activity_window_reckons_an_alerts_limits_once_and_not_for_each_pair(spark):
    """Days added to a time are dear, and there are far more pairs than alerts."""
    txn = spark.createDataFrame([("1", "c", datetime(2024, 1, 3), 1.0)], "txn_id string, customer_id string, ts timestamp_ntz, amt double")
    plan = cards.activity_window(txn, spark.createDataFrame([("A", "1")], "case_id string, flagged_txn_id string"))._jdf.queryExecution().executedPlan().toString()
    pairs, limits = next(x for x in plan.splitlines() if "SortMergeJoin" in x and "ts#" in x), [x for x in plan.splitlines() if "INTERVAL" in x]
    assert "INTERVAL" not in pairs and limits
