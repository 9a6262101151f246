"""Metrics and policy over the adapter's views."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.operators import cards, evaluate, features, policy
from riskgraph.plans.base import query, r4
from riskgraph.plans.card_queries import BURSTS
from riskgraph.plans.feature_queries import FEATURES


@query(
    "binary_metrics",
    f"""n AS (SELECT count(*) FILTER (WHERE p >= 0.7e0 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.7e0 AND y <> 1) AS fp, count(*) FILTER (WHERE p < 0.7e0 AND y = 1) AS fn FROM scored)
    SELECT tp, fp, fn, {r4('tp::DOUBLE / (tp + fp)')} AS precision, {r4('tp::DOUBLE / (tp + fn)')} AS recall, {r4('2 * tp::DOUBLE / (2 * tp + fp + fn)')} AS f1 FROM n""",
)
def binary_metrics(t):
    return evaluate.binary_metrics(t.scored)


@query(
    "roc_auc",
    f"""r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS k FROM scored), s AS (SELECT count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg, sum(k) FILTER (WHERE y = 1) AS ranks FROM r)
    SELECT {r4('(ranks - pos * (pos + 1) / 2e0) / (pos * neg)')} AS auc FROM s""",
)
def roc_auc(t):
    return evaluate.roc_auc(t.scored)


@query("brier_score", f"SELECT {r4('avg((p - y) * (p - y))')} AS brier FROM scored")
def brier_score(t):
    return evaluate.brier_score(t.scored)


@query("calibration_curve", f"SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, {r4('avg(p)')} AS mean_p, {r4('avg(y::DOUBLE)')} AS share FROM scored GROUP BY 1")
def calibration_curve(t):
    return evaluate.calibration_curve(t.scored)


CASES = "cs AS (SELECT case_id, pattern, (outcome = 'confirmed_fraud')::INT AS y, least(0.99e0, floor(exposure_usd / 2) / 100e0 + CASE WHEN outcome = 'confirmed_fraud' THEN 0.4e0 ELSE 0.1e0 END) AS p FROM closed_case)"


def case_scores(t):
    p = F.least(F.lit(0.99), F.floor(F.col("exposure_usd") / 2) / F.lit(100.0) + F.when(F.col("outcome") == "confirmed_fraud", 0.4).otherwise(0.1))
    return t.closed_case.select("case_id", "pattern", (F.col("outcome") == "confirmed_fraud").cast("int").alias("y"), p.alias("p"))


@query(
    "pattern_metrics",
    f"""{CASES} SELECT pattern, count(*) AS n, count(*) FILTER (WHERE y = 1) AS fraud, count(*) FILTER (WHERE y <> 1) AS cleared, {r4('avg(p)')} AS mean_p,
    {r4('coalesce(count(*) FILTER (WHERE y = 1 AND p >= 0.7e0)::DOUBLE / nullif(count(*) FILTER (WHERE y = 1), 0), 0)')} AS recall, {r4('coalesce(count(*) FILTER (WHERE y = 1 AND p >= 0.7e0)::DOUBLE / nullif(count(*) FILTER (WHERE p >= 0.7e0), 0), 0)')} AS precision FROM cs GROUP BY 1""",
)
def pattern_metrics(t):
    return evaluate.pattern_metrics(case_scores(t))


#: Each detector and the feature that holds its confidence.
DETECTORS = {"testing": "conf_testing", "burst": "conf_burst", "new_device": "conf_new_device", "region": "conf_region", "takeover": "conf_ato"}
TARGETS = "tgt AS (SELECT case_id, card_id, first_fraud_txn_id AS flagged_txn_id, opened_at FROM closed_case)"
DETECTED = f"""{TARGETS}, {FEATURES.replace("FROM alert a", "FROM tgt a")}, det AS ({" UNION ALL ".join(f"SELECT ft.case_id, c.pattern, (c.outcome = 'confirmed_fraud')::INT AS y, '{d}' AS detector, {f} AS confidence FROM ft JOIN closed_case c ON c.case_id = ft.case_id" for d, f in DETECTORS.items())})"""


def detected(t):
    """Every closed case with the confidence of each of the five detectors at the time it was opened."""
    target = t.closed_case.select("case_id", "card_id", F.col("first_fraud_txn_id").alias("flagged_txn_id"), "opened_at")
    found = features.case_features(target, t.txn, t.identity, t.closed_case, 20.0, 50.0, 2880)
    truth = t.closed_case.select("case_id", "pattern", (F.col("outcome") == "confirmed_fraud").cast("int").alias("y"))
    scores = F.array(*(F.struct(F.lit(d).alias("detector"), F.col(f).alias("confidence")) for d, f in DETECTORS.items()))
    return found.join(truth, "case_id").select("case_id", "pattern", "y", F.explode(scores).alias("d")).select("case_id", "pattern", "y", "d.*")


@query(
    "detector_threshold_curve",
    f"""{DETECTED}, n AS (SELECT detector, threshold, count(*) FILTER (WHERE y = 1 AND confidence >= threshold) AS tp, count(*) FILTER (WHERE y <> 1 AND confidence >= threshold) AS fp, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg
        FROM det, (SELECT unnest([0.5e0, 0.65e0, 0.7e0, 0.8e0, 0.85e0]) AS threshold) GROUP BY 1, 2)
    SELECT detector, threshold, tp, fp, {r4('coalesce(tp::DOUBLE / nullif(pos, 0), 0)')} AS hit_rate, {r4('coalesce(fp::DOUBLE / nullif(neg, 0), 0)')} AS fpr, {r4('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)')} AS precision, {r4('coalesce(2 * tp::DOUBLE / nullif(tp + fp + pos, 0), 0)')} AS f1 FROM n""",
)
def detector_threshold_curve(t):
    return evaluate.threshold_curve(detected(t))


CONFUSION = [*DETECTORS, "none"]


@query(
    "detector_confusion",
    f"""{DETECTED}, k AS (SELECT pattern, detector AS predicted FROM det WHERE confidence >= 0.7e0 UNION ALL SELECT pattern, 'none' FROM det GROUP BY case_id, pattern HAVING max(confidence) < 0.7e0)
    SELECT pattern, {", ".join(f"""count(*) FILTER (WHERE predicted = '{c}') AS "{c}" """ for c in CONFUSION)} FROM k GROUP BY 1""",
)
def detector_confusion(t):
    """Flags per true pattern: each detector that reaches 0.70 counts, ``none`` where none does."""
    found = detected(t).groupBy("case_id", "pattern").agg(F.collect_list(F.when(F.col("confidence") >= 0.7, F.col("detector"))).alias("hits"))
    return evaluate.confusion(found.select("case_id", "pattern", F.explode(F.when(F.size("hits") > 0, F.col("hits")).otherwise(F.array(F.lit("none")))).alias("predicted")), CONFUSION)


@query("batch_cost_stats", f"SELECT outcome, count(*) AS n, {r4('avg(exposure_usd)')} AS mean, min(exposure_usd) AS min, max(exposure_usd) AS max, {r4('quantile_cont(exposure_usd, 0.5)')} AS p50, {r4('quantile_cont(exposure_usd, 0.95)')} AS p95, {r4('sum(exposure_usd)')} AS sum FROM closed_case GROUP BY 1")
def batch_cost_stats(t):
    return evaluate.batch_stats(t.closed_case, "exposure_usd", "outcome")


ASSESS = """asm AS (SELECT a.case_id, a.trigger_type, a.customer_response AS resp, t.amt * 3 AS x, coalesce(a.risk_score, 0.5e0) AS p, CASE WHEN CAST(t.txn_id AS BIGINT) % 7 = 0 THEN 'card_testing' WHEN CAST(t.txn_id AS BIGINT) % 11 = 0 THEN 'undocumented' ELSE 'none' END AS pattern,
    CASE WHEN CAST(t.txn_id AS BIGINT) % 5 = 0 THEN 'device' END AS origin, CAST(t.txn_id AS BIGINT) % 13 = 0 AS conflict, CAST(t.txn_id AS BIGINT) % 17 = 0 AS recurring, CAST(CAST(t.txn_id AS BIGINT) % 4 AS INT) AS connected, CAST(t.txn_id AS BIGINT) % 3 = 0 AS single, t.amt > 100 AS cleared, a.risk_score
    FROM alert a JOIN txn t ON t.txn_id = a.flagged_txn_id)"""


def assessments(t):
    n = F.col("txn_id").cast("bigint")
    met = t.alert.withColumnRenamed("flagged_txn_id", "txn_id").select("case_id", "txn_id", "trigger_type", "customer_response", "risk_score").join(t.txn.select("txn_id", "amt"), "txn_id")
    return met.select(
        "case_id", "trigger_type", "customer_response", "risk_score", (F.col("amt") * 3).alias("exposure_usd"), F.coalesce("risk_score", F.lit(0.5)).alias("probability"),
        F.when(n % 7 == 0, "card_testing").when(n % 11 == 0, "undocumented").otherwise("none").alias("pattern"), F.when(n % 5 == 0, "device").alias("shared_origin"), (n % 13 == 0).alias("evidence_conflict"),
        (n % 17 == 0).alias("recurring_match"), (n % 4).cast("int").alias("connected_cards_count"), (n % 3 == 0).alias("single_signal"), (F.col("amt") > 100).alias("has_cleared_over_100"),
    )


def rules(resp: str) -> str:
    """The rules in the oracle's words: each action's condition, in order of execution. Given names end in the response they are for."""
    stop = f"(CASE WHEN recurring AND {resp} = 'denies' THEN 'r7' WHEN {resp} = 'confirms' THEN 'r3' WHEN {resp} = 'no_reply' THEN 'r4' WHEN (single OR p < 0.7e0) AND {resp} = 'none' AND pattern <> 'card_testing' THEN 'r1' ELSE 'go' END)"
    hard = f"(cleared OR x > 100 OR {resp} = 'denies')"
    r8 = f"({stop} IN ('r1', 'go') AND (conflict OR (p > 0.15e0 AND p < 0.7e0 AND x > 500 AND {resp} = 'none')))"
    r5 = f"({stop} = 'go' AND pattern = 'card_testing')"
    block = f"({stop} = 'go' AND ({resp} = 'denies' OR p >= 0.7e0 OR pattern IN ('undocumented', 'card_testing')))"
    left = f"({stop} = 'go' AND NOT {block} AND NOT {r8} AND NOT {r5})"
    case = f"({stop} = 'r7' OR ({stop} = 'r4' AND (p >= 0.3e0 OR x > 500)) OR ({r8} AND p >= 0.3e0) OR {r5} OR ({stop} = 'r1' AND p >= 0.3e0) OR {block} OR ({left} AND p >= 0.3e0))"
    given = [
        ("DECLINE_TRANSACTION", f"{stop} = 'r4' OR {r5}"), ("ALLOW_TRANSACTION", f"({stop} = 'r1' AND p < 0.15e0) OR ({left} AND p < 0.3e0)"), ("STEP_UP_AUTH", f"({r5} AND NOT {hard}) OR {stop} = 'r1'"),
        ("VERIFY_WITH_CUSTOMER", f"{stop} IN ('r7', 'r1') OR ({left} AND p >= 0.3e0)"), ("WARN_CUSTOMER", f"{stop} = 'r7'"), ("CREATE_CASE", case),
        ("BLOCK_CARD", f"({r5} AND {hard}) OR ({block} AND NOT (pattern = 'card_testing' AND NOT {hard}))"), ("MONITOR_CARD", f"{stop} = 'r4'"), ("MONITOR_CONNECTED_CARDS", f"{block} AND (origin IS NOT NULL OR connected >= 2)"),
        ("FILE_REPORT", f"{block} AND (x >= 1000 OR origin IS NOT NULL OR connected >= 2 OR pattern = 'undocumented')"), ("ESCALATE_TO_ANALYST", f"({stop} = 'r4' AND (x > 500 OR conflict)) OR {r8} OR ({block} AND pattern = 'undocumented')"), ("CLOSE_NO_FRAUD", f"{stop} = 'r3'"),
    ]
    return f"list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{a}{chr(39)} END' for a, c in given)}], lambda v: v IS NOT NULL)"


ROUTE = "CASE WHEN a = 'BLOCK_CARD' THEN CASE WHEN x <= 2500 THEN 'L1' ELSE 'L2' END WHEN a = 'DECLINE_TRANSACTION' THEN 'L1' WHEN a IN ('BLOCK_ALL_CARDS', 'FILE_REPORT') THEN 'L2' ELSE 'auto' END"
ACTIONS = f"{ASSESS}, act AS (SELECT *, {rules('resp')} AS acts FROM asm)"


@query("evaluate_policy", f"{ACTIONS} SELECT case_id, array_to_string(acts, ',') AS actions FROM act")
def evaluate_policy(t):
    return policy.evaluate(assessments(t)).select("case_id", policy.action_names().alias("actions"))


@query("action_route", f"{ACTIONS}, e AS (SELECT case_id, x, unnest(acts) AS a FROM act) SELECT case_id, a AS action, {ROUTE} AS route FROM e")
def action_route(t):
    return policy.evaluate(assessments(t)).select("case_id", F.explode("actions").alias("a")).select("case_id", F.col("a.action").alias("action"), F.col("a.route").alias("route"))


@query("approval_queue", f"{ACTIONS}, e AS (SELECT case_id, x, unnest(acts) AS a FROM act), r AS (SELECT case_id, a AS action, {ROUTE} AS route FROM e) SELECT * FROM r WHERE route <> 'auto'")
def approval_queue(t):
    return policy.approval_queue(policy.evaluate(assessments(t)))


@query("normalize_response", "SELECT case_id, customer_response AS response FROM alert")
def normalize_response(t):
    messy = F.concat(F.lit(" "), F.upper(F.regexp_replace("customer_response", "_", "-")), F.lit(" "))
    return t.alert.select("case_id", policy.normalize_response(messy).alias("response"))


@query(
    "initial_vs_final_actions",
    f"""{ASSESS}, io AS (SELECT case_id, {rules("'none'")} AS i, {rules('resp')} AS f FROM asm),
    d AS (SELECT *, list_filter(f, lambda v: NOT list_contains(i, v)) AS added, list_filter(i, lambda v: NOT list_contains(f, v)) AS dropped FROM io),
    c AS (SELECT *, concat_ws('; ', CASE WHEN len(added) > 0 THEN 'added ' || array_to_string(added, ',') END, CASE WHEN len(dropped) > 0 THEN 'dropped ' || array_to_string(dropped, ',') END) AS w FROM d)
    SELECT case_id, array_to_string(i, ',') AS initial, array_to_string(f, ',') AS "final", CASE WHEN w = '' THEN 'no change' ELSE w END AS what_changed FROM c""",
)
def initial_vs_final_actions(t):
    return policy.initial_and_final(assessments(t))


@query(
    "sar_decision",
    f"""{ASSESS} SELECT case_id, x >= 1000 OR origin IS NOT NULL OR connected >= 2 OR pattern = 'undocumented' AS file,
    concat_ws('; and ', CASE WHEN x >= 1000 THEN 'exposure reaches the filing limit' END, CASE WHEN origin IS NOT NULL OR connected >= 2 THEN 'origin shared with other cards' END, CASE WHEN pattern = 'undocumented' THEN 'undocumented pattern' END) AS reason FROM asm""",
)
def sar_decision(t):
    return policy.sar_decision(assessments(t))


@query(
    "posterior_update",
    """SELECT case_id, CASE customer_response WHEN 'confirms' THEN floor(greatest(0.18e0, least(0.32e0, coalesce(risk_score, 0.5e0) * 0.25e0 + 0.12e0)) * 100 + 0.5e0) / 100
    WHEN 'denies' THEN floor(least(0.95e0, greatest(0.78e0, coalesce(risk_score, 0.7e0) * 0.2e0 + 0.72e0)) * 100 + 0.5e0) / 100 ELSE 0.58e0 END AS probability,
    CASE customer_response WHEN 'confirms' THEN 'legitimate' WHEN 'denies' THEN 'fraud' ELSE 'uncertain' END AS verdict, CASE customer_response WHEN 'confirms' THEN 'closed_legitimate' WHEN 'denies' THEN 'closed_fraud' ELSE 'open' END AS status FROM alert""",
)
def posterior_update(t):
    r = F.col("customer_response")
    return t.alert.select("case_id", policy.posterior(F.col("risk_score"), r).alias("probability"), policy.verdict(r).alias("verdict"), policy.status(r).alias("status"))


@query(
    "evidence_request_type",
    f"{ASSESS} SELECT case_id, CASE WHEN trigger_type = 'analyst_request' THEN 'analyst_info' WHEN pattern = 'card_testing' THEN 'step_up_auth' ELSE 'customer_validation' END AS type FROM asm",
)
def evidence_request_type(t):
    return assessments(t).select("case_id", policy.evidence_request_type(F.col("trigger_type"), F.col("pattern")).alias("type"))


@query("needs_evidence", f"{ASSESS} SELECT case_id, connected < 2 AND (conflict OR recurring OR (p > 0.15e0 AND p < 0.85e0)) AS needed FROM asm")
def needs_evidence(t):
    return assessments(t).select("case_id", policy.needs_evidence(F.col("probability"), F.col("evidence_conflict"), F.col("recurring_match"), F.col("connected_cards_count")).alias("needed"))


@query(
    "stop_reason",
    f"""{ASSESS} SELECT case_id, CASE WHEN resp IN ('confirms', 'denies') THEN 'response settled the question' WHEN (p >= 0.85e0 OR p <= 0.15e0) AND connected >= 2 THEN 'evidence is decisive'
    WHEN resp = 'no_reply' THEN 'no reply within the window' ELSE 'open' END AS reason FROM asm""",
)
def stop_reason(t):
    return assessments(t).select("case_id", policy.stop_reason(F.col("probability"), F.col("connected_cards_count"), F.col("customer_response")).alias("reason"))


@query("assessment_flags", f"{BURSTS} SELECT a.case_id, coalesce(b.n, 0) < 2 AS single_signal, t.amt > 100 AS has_cleared_over_100 FROM alert a JOIN txn t ON t.txn_id = a.flagged_txn_id LEFT JOIN bursts b ON b.txn_id = t.txn_id")
def assessment_flags(t):
    bursts = cards.online_bursts(t.txn).select("txn_id", "burst_count")
    met = t.alert.select("case_id", F.col("flagged_txn_id").alias("txn_id")).join(t.txn.select("txn_id", "amt"), "txn_id").join(bursts, "txn_id", "left")
    return met.select("case_id", (F.coalesce("burst_count", F.lit(0)) < 2).alias("single_signal"), (F.col("amt") > 100).alias("has_cleared_over_100"))


@query(
    "classify_pattern",
    """s AS (SELECT txn_id, risk_score * 2 AS p, CASE WHEN m1 = 'F' THEN 0.86e0 ELSE 0.05e0 END AS a, CASE WHEN m6 = 'F' THEN 0.86e0 ELSE 0.1e0 END AS b, CASE WHEN amt > 80 THEN 0.7e0 ELSE 0.45e0 END AS c FROM txn)
    SELECT txn_id, CASE WHEN p < 0.25e0 THEN 'none' WHEN a >= 0.65e0 AND a >= b AND a >= c THEN 'card_testing' WHEN b >= 0.65e0 AND b >= c THEN 'account_takeover' WHEN c >= 0.65e0 THEN 'card_not_present_fraud' WHEN p >= 0.7e0 THEN 'undocumented' ELSE 'none' END AS pattern FROM s""",
)
def classify_pattern(t):
    scores = {"card_testing": F.when(F.col("m1") == "F", 0.86).otherwise(0.05), "account_takeover": F.when(F.col("m6") == "F", 0.86).otherwise(0.1), "card_not_present_fraud": F.when(F.col("amt") > 80, 0.7).otherwise(0.45)}
    return t.txn.select("txn_id", evaluate.classify_pattern(F.col("risk_score") * 2, scores).alias("pattern"))


CLOSED = "asm AS (SELECT case_id, outcome, actions_taken, report_filed, CASE outcome WHEN 'cleared' THEN 'confirms' ELSE 'denies' END AS resp, exposure_usd AS x, CASE outcome WHEN 'cleared' THEN 0.2e0 ELSE 0.9e0 END AS p, pattern, NULL AS origin, false AS conflict, false AS recurring, 0 AS connected, false AS single, false AS cleared FROM closed_case)"


@query(
    "policy_disagreements",
    f"""asm AS (SELECT c.case_id, outcome, string_split(actions_taken, '|') AS took, report_filed = 'Yes' AS filed, CASE outcome WHEN 'cleared' THEN 'confirms' ELSE 'denies' END AS resp, exposure_usd AS x, coalesce(t.risk_score, 0.5e0) AS p, pattern, NULL AS origin, false AS conflict, false AS recurring,
        coalesce(len(string_split(connected_card_ids, '|')), 0) AS connected, false AS single, false AS cleared FROM closed_case c LEFT JOIN txn t ON t.txn_id = c.first_fraud_txn_id), act AS (SELECT *, {rules('resp')} AS acts FROM asm),
    d AS (SELECT case_id, outcome, p AS probability, array_to_string(list_filter(took, lambda v: NOT list_contains(acts, v)), ',') AS not_recommended, array_to_string(list_filter(acts, lambda v: NOT list_contains(took, v)), ',') AS not_recorded, list_contains(acts, 'FILE_REPORT') <> filed AS filing_differs FROM act)
    SELECT * FROM d WHERE not_recommended <> '' OR not_recorded <> '' OR filing_differs""",
)
def policy_disagreements(t):
    """Each closed case whose recorded actions the policy would not give, judged by its first transaction's risk score."""
    fraud = F.col("outcome") != "cleared"
    risk = t.txn.select(F.col("txn_id").alias("first_fraud_txn_id"), F.col("risk_score"))
    given = t.closed_case.join(risk, "first_fraud_txn_id", "left").select(
        "case_id", "pattern", "exposure_usd", F.when(fraud, "denies").otherwise("confirms").alias("customer_response"), F.coalesce("risk_score", F.lit(0.5)).alias("probability"),
        F.coalesce(F.size(F.split("connected_card_ids", "\\|")), F.lit(0)).alias("connected_cards_count"),
    )
    return policy.disagreements(policy.evaluate(given), t.closed_case)


@query(
    "policy_agreement",
    f"""{CLOSED}, act AS (SELECT *, {rules('resp')} AS acts FROM asm) SELECT outcome, count(*) AS n, count(*) FILTER (WHERE list_has_all(acts, string_split(actions_taken, '|'))) AS actions_agree,
    count(*) FILTER (WHERE list_contains(acts, 'FILE_REPORT') = (report_filed = 'Yes')) AS filing_agrees FROM act GROUP BY 1""",
)
def policy_agreement(t):
    fraud = F.col("outcome") != "cleared"
    given = t.closed_case.select("case_id", "pattern", "exposure_usd", F.when(fraud, "denies").otherwise("confirms").alias("customer_response"), F.when(fraud, 0.9).otherwise(0.2).alias("probability"))
    return policy.policy_agreement(policy.evaluate(given), t.closed_case)
