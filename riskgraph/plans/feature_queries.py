"""Point-in-time features over the alerts as cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.operators import features
from riskgraph.plans.base import query, r4
from riskgraph.plans.card_queries import DEC

HISTORY = """hk AS (SELECT a.case_id, a.flagged_txn_id, a.opened_at, t.*, t.ts <= a.opened_at AS known FROM alert a JOIN txn t ON t.card_id = a.card_id),
    hn AS (SELECT *, count(*) FILTER (WHERE known) OVER (PARTITION BY case_id) AS n_known, row_number() OVER (PARTITION BY case_id ORDER BY txn_id = flagged_txn_id DESC, ts, txn_id) AS f FROM hk),
    hr AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY txn_id = flagged_txn_id DESC, ts DESC, txn_id DESC) = 1 AS target FROM hn WHERE known OR (n_known = 0 AND f = 1)),
    tg AS (SELECT * FROM hr WHERE target),
    h AS (SELECT hr.*, tg.ts AS t_ts, tg.amt AS t_amt, tg.channel AS t_channel, tg.addr1 AS t_addr1, hr.ts < tg.ts AS prior FROM hr JOIN tg ON tg.case_id = hr.case_id)"""
STATS = f"""{HISTORY}, hs AS (SELECT case_id, count(*) FILTER (WHERE prior) AS n, coalesce(CAST(sum({DEC}) FILTER (WHERE prior) AS DOUBLE) / nullif(count(*) FILTER (WHERE prior), 0), max(t_amt)) AS prior_mean,
    coalesce(quantile_cont(amt, 0.75) FILTER (WHERE prior), max(t_amt)) AS prior_p75, coalesce(quantile_cont(amt, 0.95) FILTER (WHERE prior), max(t_amt)) AS prior_p95,
    coalesce(CAST(count(*) FILTER (WHERE prior AND channel = 'in_person') AS DOUBLE) / nullif(count(*) FILTER (WHERE prior), 0), max((t_channel = 'in_person')::INT::DOUBLE)) AS in_person,
    coalesce(CAST(count(*) FILTER (WHERE prior AND channel = 'online') AS DOUBLE) / nullif(count(*) FILTER (WHERE prior), 0), max((t_channel = 'online')::INT::DOUBLE)) AS online,
    count(*) FILTER (WHERE prior AND addr1 = t_addr1) AS in_region, max(t_addr1) AS t_addr1 FROM h GROUP BY 1),
    hm AS (SELECT case_id, addr1 FROM (SELECT case_id, addr1, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, addr1) AS r FROM h WHERE prior AND addr1 IS NOT NULL GROUP BY case_id, addr1) WHERE r = 1),
    st AS (SELECT hs.*, CASE WHEN n = 0 THEN t_addr1 ELSE hm.addr1 END AS home FROM hs LEFT JOIN hm ON hm.case_id = hs.case_id)"""
IN48 = "ts >= opened_at - interval '48' hour"
SPEED = f"""sp AS (SELECT case_id, count(*) FILTER (WHERE ts >= opened_at - interval '24' hour) AS txns_24h, count(*) FILTER (WHERE {IN48}) AS txns_48h,
    count(*) FILTER (WHERE {IN48} AND channel = 'online') AS online_48h, coalesce(CAST(sum({DEC}) FILTER (WHERE {IN48}) AS DOUBLE), 0e0) AS exposure_48h,
    count(DISTINCT channel) FILTER (WHERE {IN48}) AS channels_48h, max(amt) FILTER (WHERE {IN48} AND channel = 'online') AS largest FROM h GROUP BY 1)"""
RATE = """pr AS (SELECT a.case_id, count(c.case_id) AS prior_cases_count, coalesce(CAST(count(*) FILTER (WHERE c.outcome = 'confirmed_fraud') AS DOUBLE) / nullif(count(c.case_id), 0), 0.5e0) AS prior_fraud_rate
    FROM alert a LEFT JOIN closed_case c ON c.card_id = a.card_id AND c.opened_at < a.opened_at GROUP BY 1)"""


def rows(t):
    return features.history(t.alert, t.txn)


@query(
    "feature_history_stats",
    f"{STATS} SELECT case_id, n AS prior_txns_count, {r4('prior_mean')} AS prior_mean, {r4('prior_p75')} AS prior_p75, {r4('prior_p95')} AS prior_p95, {r4('in_person')} AS prior_in_person_pct, {r4('online')} AS prior_online_pct, in_region AS prior_in_region, home AS home_region FROM st",
)
def feature_history_stats(t):
    return features.rounded(features.history_stats(rows(t)), ("prior_mean", "prior_p75", "prior_p95", "prior_in_person_pct", "prior_online_pct"))


@query("feature_velocity", f"{HISTORY}, {SPEED} SELECT case_id, txns_24h, txns_48h, online_48h, exposure_48h FROM sp")
def feature_velocity(t):
    return features.velocity(rows(t)).select("case_id", "txns_24h", "txns_48h", "online_48h", "exposure_48h")


@query("feature_ratios", f"{STATS} SELECT st.case_id, {r4('tg.amt / (prior_mean + 0.001e0)')} AS amount_to_mean_ratio, {r4('tg.amt / (prior_p75 + 0.001e0)')} AS amount_to_p75_ratio FROM st JOIN tg ON tg.case_id = st.case_id")
def feature_ratios(t):
    found = features.case_features(t.alert, t.txn, t.identity, t.closed_case)
    return features.rounded(found.select("case_id", "amount_to_mean_ratio", "amount_to_p75_ratio"), ("amount_to_mean_ratio", "amount_to_p75_ratio"))


@query("prior_case_rate", f"{RATE} SELECT case_id, prior_cases_count, {r4('prior_fraud_rate')} AS prior_fraud_rate FROM pr")
def prior_case_rate(t):
    return features.rounded(features.prior_case_rate(t.alert, t.closed_case), ("prior_fraud_rate",))


#: One row per alert with the 29 features; card testing with limits that occur in these tables.
FEATURES = f"""{STATS}, {SPEED}, {RATE},
    co AS (SELECT h.case_id, count(*) FILTER (WHERE h.addr1 = st.home AND h.txn_id <> h.flagged_txn_id AND h.ts BETWEEN h.t_ts - interval '48' hour AND h.t_ts + interval '48' hour) AS c FROM h JOIN st ON st.case_id = h.case_id GROUP BY 1),
    ol AS (SELECT case_id, txn_id, ts, amt, amt <= 20 AS probe, row_number() OVER (PARTITION BY case_id ORDER BY ts, txn_id) AS place, sum((amt <= 20)::INT) OVER (PARTITION BY case_id ORDER BY ts, txn_id) AS cp FROM h WHERE channel = 'online'),
    lg AS (SELECT p.case_id, p.place, x.cp - p.cp + 1 AS run, x.amt FROM ol p JOIN ol x ON x.case_id = p.case_id AND x.place > p.place AND p.probe AND NOT x.probe AND x.amt >= 50 AND x.ts <= p.ts + interval '2880' minute
           WHERE NOT EXISTS (SELECT 1 FROM ol y WHERE y.case_id = p.case_id AND NOT y.probe AND y.amt >= 50 AND y.place > p.place AND y.place < x.place)),
    te AS (SELECT case_id, max_by(CASE WHEN run >= 3 THEN CASE WHEN amt > 100 THEN 0.94e0 ELSE 0.86e0 END ELSE 0.72e0 END, place) AS conf FROM lg WHERE run >= 2 GROUP BY 1),
    f0 AS (SELECT a.case_id, tg.risk_score AS flagged_risk_score, tg.amt AS flagged_amount, (tg.channel = 'online')::INT AS flagged_is_online, (tg.channel = 'in_person')::INT AS flagged_is_in_person,
        coalesce((i.id_15 = 'New')::INT, 0) AS is_new_device, coalesce(contains(lower(i.id_23), 'proxy')::INT, 0) AS is_proxy, (i.txn_id IS NOT NULL)::INT AS has_device,
        coalesce((tg.m1 = 'F')::INT, 0) + coalesce((tg.m4 IN ('M0', 'M2', 'F'))::INT, 0) + coalesce((tg.m6 = 'F')::INT, 0) AS mismatch_count,
        (st.in_region = 0 AND tg.addr1 IS NOT NULL AND tg.channel = 'in_person')::INT AS is_new_region, co.c AS concurrent_home_count,
        tg.amt / (prior_mean + 0.001e0) AS amount_to_mean_ratio, tg.amt / (prior_p75 + 0.001e0) AS amount_to_p75_ratio, st.n AS prior_txns_count, st.in_person AS prior_in_person_pct, st.online AS prior_online_pct,
        txns_24h, txns_48h, online_48h, exposure_48h, coalesce(te.conf, 0.05e0) AS conf_testing,
        CASE WHEN online_48h BETWEEN 2 AND 6 THEN CASE WHEN largest > prior_p75 THEN 0.85e0 ELSE 0.72e0 END WHEN online_48h = 1 THEN 0.45e0 ELSE 0.2e0 END AS conf_burst,
        CASE WHEN i.id_15 = 'New' THEN CASE WHEN contains(lower(i.id_23), 'proxy') THEN 0.9e0 ELSE 0.82e0 END WHEN i.id_15 = 'Found' THEN 0.25e0 ELSE 0.1e0 END AS conf_new_device, channels_48h, prior_cases_count, prior_fraud_rate
        FROM alert a JOIN tg ON tg.case_id = a.case_id JOIN st ON st.case_id = a.case_id JOIN sp ON sp.case_id = a.case_id JOIN co ON co.case_id = a.case_id JOIN pr ON pr.case_id = a.case_id
        LEFT JOIN identity i ON i.txn_id = a.flagged_txn_id LEFT JOIN te ON te.case_id = a.case_id),
    f1 AS (SELECT *, CASE WHEN is_new_region = 1 AND concurrent_home_count > 0 THEN 0.88e0 WHEN is_new_region = 1 THEN 0.38e0 ELSE 0.1e0 END AS conf_region,
        CASE WHEN channels_48h > 1 AND mismatch_count >= 1 THEN 0.88e0 WHEN channels_48h > 1 THEN 0.72e0 WHEN mismatch_count >= 2 THEN 0.75e0 ELSE 0.15e0 END AS conf_ato FROM f0),
    f2 AS (SELECT *, greatest(conf_testing, conf_burst, conf_new_device, conf_region, conf_ato) AS max_graph_pattern FROM f1),
    ft AS (SELECT *, (max_graph_pattern >= 0.7e0)::INT AS has_corroborated_pattern, flagged_risk_score * (1 - (max_graph_pattern >= 0.7e0)::INT) AS lone_risk_score FROM f2)"""
ROUNDED = ("amount_to_mean_ratio", "amount_to_p75_ratio", "prior_in_person_pct", "prior_online_pct", "prior_fraud_rate")


def case_features_of(t):
    return features.case_features(t.alert, t.txn, t.identity, t.closed_case, 20.0, 50.0, 2880)


@query("case_features", f"{FEATURES} SELECT case_id, {', '.join(f'{r4(c)} AS {c}' if c in ROUNDED else c for c in features.FEATURES)} FROM ft")
def case_features(t):
    return features.rounded(case_features_of(t), ROUNDED)


SCORES = ("conf_testing", "conf_burst", "conf_new_device", "conf_region", "conf_ato", "max_graph_pattern", "has_corroborated_pattern", "lone_risk_score")


@query("feature_pattern_scores", f"{FEATURES} SELECT case_id, {', '.join(SCORES)} FROM ft")
def feature_pattern_scores(t):
    return case_features_of(t).select("case_id", *(F.col(c) for c in SCORES))
