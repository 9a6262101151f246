"""The flagship: every alert investigated, with its evidence, assessment and actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.operators import investigate, memory, model, network, reports
from riskgraph.plans.base import nested, query
from riskgraph.plans.card_queries import WIDE
from riskgraph.plans.feature_queries import FEATURES, case_features_of
from riskgraph.plans.network_queries import USES, affected_transactions, connected, e_similar_to
from riskgraph.plans.policy_queries import rules
from riskgraph.plans.report_queries import FULL, labelled
from riskgraph.sources import files


def evidence(t):
    return investigate.evidence_items(t.alert, t.txn, t.identity, t.closed_case, connected(t), WIDE)


def _two(e: str) -> str:
    return f"CAST(CAST(floor({e} * 100 + 0.5e0) / 100 AS DECIMAL(18,2)) AS STRING)"


def _claim(detector: str, ref: str, confidence: str, n: str, claim: str, ids: str, source: str) -> str:
    return f"SELECT a.case_id, '{detector}' AS detector, CAST({confidence} AS DOUBLE) AS confidence, CAST({n} AS BIGINT) AS n, {claim} AS claim, 'graph' AS source, {ref} AS ref, {ids} AS entity_ids FROM alert a JOIN {source}"


_CARD = "'query:{}(card_id=' || a.card_id || ')'"
EVIDENCE = f"""{USES}, ow AS (SELECT device, count(DISTINCT card_id) - 1 AS others FROM uses GROUP BY 1), {nested("card_baseline", "e_bl")}, {nested("detect_card_testing", "e_ct")}, {nested("detect_cnp_burst", "e_bu")},
    {nested("detect_new_device", "e_nd")}, {nested("detect_region_anomaly", "e_rg")}, {nested("detect_account_takeover", "e_at")}, {nested("case_memory_lookup", "e_mm")}, ev AS (
    {_claim("baseline", _CARD.format("card_baseline"), "NULL", "x.n", f"'Card ' || a.card_id || ' has ' || x.n || ' transactions with a median of ' || {_two('x.median')} || ' and a mean of ' || {_two('x.mean')} || '.'", "a.card_id || ',' || a.customer_id", "e_bl x ON x.card_id = a.card_id")}
    UNION ALL {_claim("testing", _CARD.format("detect_card_testing"), "confidence", "probe_count", f"probe_count || ' small authorisations on card ' || a.card_id || ' came before purchase ' || large_txn_id || ', ' || {_two('exposure')} || ' in all.'", "a.card_id || ',' || large_txn_id", "e_ct x ON x.card_id = a.card_id WHERE confidence >= 0.7e0")}
    UNION ALL {_claim("burst", _CARD.format("detect_cnp_burst"), "confidence", "burst_count", f"burst_count || ' online transactions of card ' || a.card_id || ' stand around the flagged one, ' || {_two('exposure')} || ' in all.'", "a.flagged_txn_id || ',' || a.card_id", "e_bu x ON x.case_id = a.case_id WHERE confidence >= 0.7e0")}
    UNION ALL {_claim("new_device", "'query:detect_new_device(txn_id=' || a.flagged_txn_id || ')'", "confidence", "1", "'Transaction ' || a.flagged_txn_id || ' came from a device new to the account' || CASE WHEN is_proxy THEN ', behind a proxy.' ELSE '.' END", "a.flagged_txn_id", "e_nd x ON x.txn_id = a.flagged_txn_id WHERE confidence >= 0.7e0")}
    UNION ALL {_claim("region", _CARD.format("detect_region_anomaly"), "confidence", "concurrent_home", "'The purchase in region ' || region || ' is the card''s first there, with ' || concurrent_home || ' in its home region ' || home_region || ' at that time.'", "a.flagged_txn_id || ',' || a.card_id", "e_rg x ON x.case_id = a.case_id WHERE confidence >= 0.7e0")}
    UNION ALL {_claim("takeover", _CARD.format("detect_account_takeover"), "confidence", "mismatches", "mismatches || ' match flags of transaction ' || a.flagged_txn_id || ' disagree; the card has ' || in_person || ' purchases in person and ' || online || ' online.'", "a.flagged_txn_id || ',' || a.card_id", "e_at x ON x.case_id = a.case_id WHERE confidence >= 0.7e0")}
    UNION ALL {_claim("ring", "'query:device_neighbors(device=' || d.device || ')'", "CASE WHEN others >= 2 THEN 0.95e0 ELSE 0.82e0 END", "others", "'Device ' || d.device || ' is shared with ' || others || ' other cards.'", "d.device", "dev d ON d.txn_id = a.flagged_txn_id JOIN ow ON ow.device = d.device WHERE others > 0")}
    UNION ALL {_claim("memory", _CARD.format("case_memory_lookup"), "confidence", "len(string_split(prior_cases, ','))", "'The account has ' || len(string_split(prior_cases, ',')) || ' prior cases, ' || confirmed || ' of them confirmed fraud.'", "array_to_string(string_split(prior_cases, ',')[1:5], ',')", "e_mm x ON x.case_id = a.case_id WHERE prior_cases IS NOT NULL")})"""


@query("evidence_items", f"{EVIDENCE} SELECT * FROM ev")
def evidence_items(t):
    return evidence(t)


PATTERN = "CASE WHEN flagged_risk_score < 0.25e0 THEN 'none' WHEN max_graph_pattern >= 0.6e0 THEN CASE max_graph_pattern WHEN conf_testing THEN 'card_testing' WHEN conf_new_device THEN 'card_not_present_new_device' WHEN conf_region THEN 'out_of_region_use' WHEN conf_ato THEN 'account_takeover' ELSE 'card_not_present_fraud' END WHEN flagged_risk_score >= 0.7e0 THEN 'undocumented' ELSE 'none' END"
_LATE = "['FILE_REPORT', 'ESCALATE_TO_ANALYST', 'GENERATE_REPORT', 'CLOSE_NO_FRAUD']"


@query(
    "investigate_alerts",
    f"""{FEATURES}, {EVIDENCE}, ek AS (SELECT case_id, count(*) AS n_evidence, string_agg(detector, ',' ORDER BY detector) AS detectors, max(confidence) AS top_confidence, max(n) FILTER (WHERE detector = 'ring') AS others FROM ev GROUP BY 1),
    pt AS (SELECT a.*, ft.flagged_risk_score AS p, ft.flagged_amount, {PATTERN} AS pattern, has_corroborated_pattern = 0 AS single, ft.flagged_amount > 100 AS cleared FROM alert a JOIN ft ON ft.case_id = a.case_id),
    sb AS (SELECT pt.case_id, t.card_id, t.ts FROM pt JOIN ev ON ev.case_id = pt.case_id AND ev.detector = 'burst' AND pt.p >= 0.7e0 JOIN txn t ON t.txn_id = pt.flagged_txn_id AND t.channel = 'online'),
    af AS (SELECT case_id, flagged_txn_id AS txn_id FROM pt UNION SELECT sb.case_id, t.txn_id FROM sb JOIN txn t ON t.card_id = sb.card_id AND t.channel = 'online' AND t.ts BETWEEN sb.ts - interval '48' hour AND sb.ts + interval '48' hour),
    ax AS (SELECT af.case_id, CAST(count(*) AS INT) AS n_affected, CAST(sum(CAST(t.amt AS DECIMAL(18,2))) AS DOUBLE) AS x FROM af JOIN txn t ON t.txn_id = af.txn_id GROUP BY 1),
    i0 AS (SELECT pt.*, greatest(flagged_amount, ax.x) AS x, n_affected, n_evidence, detectors, top_confidence, CASE WHEN trigger_type = 'analyst_request' THEN 'device' END AS origin, CASE WHEN trigger_type = 'analyst_request' THEN coalesce(others, 0) ELSE 0 END AS connected, false AS conflict, false AS recurring
           FROM pt JOIN ax ON ax.case_id = pt.case_id JOIN ek ON ek.case_id = pt.case_id),
    i1 AS (SELECT *, {rules("'none'")} AS i FROM i0), i2 AS (SELECT *, list_has_any(i, ['VERIFY_WITH_CUSTOMER', 'STEP_UP_AUTH']) OR (p > 0.15e0 AND p < 0.85e0) AS asked FROM i1),
    f0x AS (SELECT * EXCLUDE (p, x, pattern, single, cleared), p AS prior, x AS first_exposure, pattern AS first_pattern, CASE WHEN asked THEN customer_response ELSE 'none' END AS resp FROM i2),
    f1x AS (SELECT *, CASE WHEN NOT asked THEN prior WHEN resp = 'confirms' THEN floor(greatest(0.18e0, least(0.32e0, coalesce(risk_score, 0.5e0) * 0.25e0 + 0.12e0)) * 100 + 0.5e0) / 100
            WHEN resp = 'denies' THEN floor(least(0.95e0, greatest(0.78e0, coalesce(risk_score, 0.7e0) * 0.2e0 + 0.72e0)) * 100 + 0.5e0) / 100 ELSE 0.58e0 END AS p,
            CASE WHEN resp = 'confirms' THEN 0e0 ELSE first_exposure END AS x, CASE WHEN resp = 'confirms' THEN 'none' ELSE first_pattern END AS pattern, false AS single, false AS cleared FROM f0x),
    f2x AS (SELECT *, {rules("resp")} AS f FROM f1x),
    f3x AS (SELECT *, CASE WHEN NOT asked THEN i WHEN origin IS NOT NULL AND NOT list_contains(f, 'MONITOR_CONNECTED_CARDS') THEN list_concat(list_filter(f, lambda v: NOT list_contains({_LATE}, v)), ['MONITOR_CONNECTED_CARDS'], list_filter(f, lambda v: list_contains({_LATE}, v))) ELSE f END AS g,
            CASE WHEN asked THEN CASE resp WHEN 'confirms' THEN 'legitimate' WHEN 'denies' THEN 'fraud' ELSE 'uncertain' END WHEN prior >= 0.7e0 THEN 'fraud' WHEN prior < 0.3e0 THEN 'legitimate' ELSE 'uncertain' END AS verdict FROM f2x)
    SELECT case_id, n_evidence, detectors, top_confidence, prior, first_pattern, first_exposure, n_affected, array_to_string(i, ',') AS initial_actions,
    CASE WHEN asked THEN CASE WHEN trigger_type = 'analyst_request' THEN 'analyst_info' WHEN first_pattern = 'card_testing' THEN 'step_up_auth' ELSE 'customer_validation' END END AS request, p AS probability, pattern, x AS exposure_usd, verdict,
    CASE verdict WHEN 'fraud' THEN 'closed_fraud' WHEN 'legitimate' THEN 'closed_legitimate' ELSE 'open' END AS status, array_to_string(g, ',') AS final_actions, i <> g AS changed, list_contains(g, 'FILE_REPORT') AS file,
    CASE WHEN resp IN ('confirms', 'denies') THEN 'response settled the question' WHEN (prior >= 0.85e0 OR prior <= 0.15e0) AND n_evidence >= 2 THEN 'evidence is decisive' WHEN resp = 'no_reply' THEN 'no reply within the window' ELSE 'open' END AS stop_reason FROM f3x""",
)
def investigate_alerts(t):
    """Every alert in one pass. Nothing is trained here: the flagged transaction's risk score stands for the probability, and ``score_case`` takes the model's."""
    t = t.kept()
    scored = network.checkpointed(case_features_of(t).withColumn("probability", F.col("flagged_risk_score")))
    return investigate.investigate(t.alert, t.txn, network.checkpointed(evidence(t)), scored)


@query("score_case")
def score_case(t):
    """The investigation with the trained probability, and the signals that contribute to it."""
    t = t.kept()
    fitted = model.train(network.checkpointed(labelled(t)), "case_id", "y", FULL)
    scored = network.checkpointed(fitted.predict(case_features_of(t)))
    signals = reports.contributing_signals(scored.join(t.alert.select("case_id", "flagged_txn_id", "card_id"), "case_id")).groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list("signal")), ",").alias("signals"))
    found = investigate.investigate(t.alert, t.txn, network.checkpointed(evidence(t)), scored)
    return found.withColumnRenamed("final_actions", "actions").join(signals, "case_id", "left").fillna("", ["signals"])


@query(
    "case_write_back_unit",
    f"""{EVIDENCE}, {nested("affected_transactions", "wu_af")}, {nested("e_similar_to", "wu_si")}
    SELECT 'case' AS kind, case_id AS from_id, 'open' AS to_id FROM alert
    UNION ALL SELECT 'evidence', case_id, 'EV-' || case_id || '-' || row_number() OVER (PARTITION BY case_id ORDER BY claim, source, ref) || ': ' || claim FROM ev
    UNION ALL SELECT 'raised', case_id, txn_id FROM wu_af UNION ALL SELECT 'similar_to', from_id, to_id FROM wu_si""",
)
def case_write_back_unit(t):
    """The alerts written back as two units of one write: cases with evidence claims, RAISED and SIMILAR_TO edges. The first half is written twice, and a third unit that is never noted isn't seen."""
    t = t.kept()
    path = files.scratch(t.spark, "write-back")
    cases = network.checkpointed(t.alert.select("case_id", F.lit("open").alias("outcome")))
    half = F.pmod(F.xxhash64("case_id"), F.lit(2))
    claims, affected, similar = network.checkpointed(evidence(t)), network.checkpointed(affected_transactions(t)), network.checkpointed(e_similar_to(t))
    for n, part in ((0, 0), (0, 0), (1, 1)):
        some = cases.where(half == part)
        key = some.select("case_id")
        memory.write_unit(path, n, memory.unit_of(some, claims, affected.join(key, "case_id", "left_semi"), similar.join(key.withColumnRenamed("case_id", "from_id"), "from_id", "left_semi")))
    cases.write.parquet(f"{path}/case/unit=2")
    read = lambda name: memory.read_unit(t.spark, path, name)
    rows = read("case").select(F.lit("case").alias("kind"), F.col("case_id").alias("from_id"), F.col("outcome").alias("to_id"))
    rows = rows.union(read("evidence").select(F.lit("evidence"), "case_id", F.concat("evidence_id", F.lit(": "), "claim")))
    for name in ("raised", "similar_to"):
        rows = rows.union(read(name).select(F.lit(name), "from_id", "to_id"))
    return rows
