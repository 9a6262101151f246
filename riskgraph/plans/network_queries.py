"""Link analysis and case memory over the adapter's views."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.operators import cards, graph, memory, network
from riskgraph.plans.base import query
from riskgraph.plans.card_queries import BURSTS, DEC
from riskgraph.plans.graph_queries import DEVICES

USES = f"{DEVICES}, uses AS (SELECT d.device, t.card_id, t.customer_id, t.txn_id, t.ts, t.amt FROM txn t JOIN dev d ON d.txn_id = t.txn_id)"
INVOLVES = "inv AS (SELECT DISTINCT case_id, unnest(string_split(txn_ids, '|')) AS txn_id FROM closed_case)"
CONNECTED = "con AS (SELECT DISTINCT case_id, unnest(string_split(connected_card_ids, '|')) AS card_id FROM closed_case WHERE connected_card_ids IS NOT NULL)"
AMOUNT = f"CAST(sum({DEC}) AS DOUBLE)"


def uses(t):
    return network.device_uses(t.txn, t.identity)


def involves(t):
    return graph.listed(t.closed_case, "case_id", "txn_ids")


def connected(t):
    return graph.listed(t.closed_case, "case_id", "connected_card_ids")


@query(
    "device_neighbors",
    f"""{USES}, n AS (SELECT device, string_agg(DISTINCT card_id, ',' ORDER BY card_id) AS cards, count(DISTINCT card_id) AS n_cards, count(DISTINCT customer_id) AS n_customers, count(*) AS n_txns, {AMOUNT} AS exposure FROM uses GROUP BY 1)
    SELECT *, CASE WHEN n_cards >= 3 THEN 0.95e0 WHEN n_cards = 2 THEN 0.82e0 ELSE 0.2e0 END AS confidence FROM n""",
)
def device_neighbors(t):
    return network.device_neighbors(uses(t))


@query("device_cards", f"{USES} SELECT device, card_id, count(*) AS n_txns, {AMOUNT} AS exposure FROM uses GROUP BY 1, 2")
def device_cards(t):
    return network.device_cards(uses(t))


@query(
    "device_neighbors_window",
    f"""{USES}, c AS (SELECT device, min(ts) AS center_ts FROM uses GROUP BY 1),
    n AS (SELECT u.device, array_to_string(list_sort(list(DISTINCT card_id))[1:20], ',') AS cards, count(DISTINCT card_id) AS n_cards, count(DISTINCT customer_id) AS n_customers, count(*) AS n_txns, {AMOUNT} AS exposure
          FROM uses u JOIN c ON c.device = u.device AND u.ts BETWEEN c.center_ts - interval '2' day AND c.center_ts + interval '2' day GROUP BY 1)
    SELECT *, CASE WHEN n_cards >= 3 THEN 0.95e0 WHEN n_cards = 2 THEN 0.82e0 ELSE 0.2e0 END AS confidence FROM n""",
)
def device_neighbors_window(t):
    u = uses(t)
    return network.device_neighbors(u, u.groupBy("device").agg(F.min("ts").alias("center_ts")), 2, listed=20)


@query(
    "connected_cards",
    f"""{USES} SELECT DISTINCT a.case_id, u.device, o.card_id FROM alert a JOIN uses u ON u.txn_id = a.flagged_txn_id JOIN uses o ON o.device = u.device AND o.card_id <> a.card_id""",
)
def connected_cards(t):
    return network.connected_cards(uses(t), t.alert)


def _cluster(key: str, confidence: str) -> str:
    return f"""{INVOLVES}, c AS (SELECT t.{key}, count(*) AS n_cases, count(DISTINCT k.card_id) AS n_cards, string_agg(DISTINCT k.card_id, ',' ORDER BY k.card_id) AS cards,
    CAST(sum(CAST(exposure_usd AS DECIMAL(18,2))) AS DOUBLE) AS exposure FROM txn t JOIN inv ON inv.txn_id = t.txn_id JOIN closed_case k ON k.case_id = inv.case_id
    WHERE outcome = 'confirmed_fraud' AND t.{key} IS NOT NULL GROUP BY 1) SELECT *, {confidence} AS confidence FROM c"""


@query("region_cluster", _cluster("addr1", "CASE WHEN n_cards >= 3 THEN 0.88e0 WHEN n_cards >= 1 THEN 0.7e0 ELSE 0.15e0 END"))
def region_cluster(t):
    return network.region_cluster(t.txn, involves(t), t.closed_case)


@query("email_cluster", _cluster("p_email", "CASE WHEN n_cards >= 3 THEN 0.82e0 ELSE 0.35e0 END"))
def email_cluster(t):
    return network.email_cluster(t.txn, involves(t), t.closed_case)


FANOUT = f"{USES}, f AS (SELECT device, count(DISTINCT card_id) AS n_cards, count(*) AS n_txns, {AMOUNT} AS amount FROM uses GROUP BY 1)"


@query("device_fanout_ranking", f"{FANOUT} SELECT * FROM f ORDER BY n_cards DESC, n_txns DESC, device LIMIT 10")
def device_fanout_ranking(t):
    return network.fanout_ranking(uses(t), 10)


@query("device_fanout_by_sketch", f"{FANOUT} SELECT * FROM f ORDER BY n_cards DESC, n_txns DESC, device LIMIT 10")
def device_fanout_by_sketch(t):
    """The same ten devices, found by daily sketches of their cards and counted exactly only where they come near."""
    return network.fanout_ranking_by_sketch(uses(t), network.fanout_sketches(uses(t)), 10)


@query("region_fanout_ranking", f"SELECT addr1, count(DISTINCT card_id) AS n_cards, count(*) AS n_txns, {AMOUNT} AS amount FROM txn WHERE addr1 IS NOT NULL GROUP BY 1 ORDER BY n_cards DESC, n_txns DESC, addr1 LIMIT 5")
def region_fanout_ranking(t):
    return network.fanout_ranking(t.txn, 5, "addr1")


@query("high_fanout_devices", f"{FANOUT} SELECT * FROM f WHERE n_cards >= 50")
def high_fanout_devices(t):
    return network.high_fanout(uses(t), 50)


@query("structured_amounts", f"SELECT count(*) AS n, coalesce({AMOUNT}, 0e0) AS amount FROM txn WHERE channel = 'online' AND amt BETWEEN 99e0 AND 99.99e0")
def structured_amounts(t):
    return network.structured_amounts(t.txn)


SAME = """sa AS (SELECT a.amt, a.ts, count(DISTINCT b.customer_id) AS n_customers, count(*) AS n_txns FROM (SELECT DISTINCT amt, ts FROM txn) a JOIN txn b ON b.amt = a.amt AND b.ts > a.ts - interval '24' hour AND b.ts <= a.ts GROUP BY 1, 2 HAVING count(DISTINCT b.customer_id) >= 3),
    sf AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY amt ORDER BY ts) + interval '24' hour THEN 0 ELSE 1 END AS fresh FROM sa), sr AS (SELECT *, sum(fresh) OVER (PARTITION BY amt ORDER BY ts) AS run FROM sf),
    same AS (SELECT amt, min(ts) AS reached_at, max(ts) AS last_at, max(n_customers) AS n_customers, max(n_txns) AS n_txns FROM sr GROUP BY amt, run)"""


@query("identical_amount_clusters", f"{SAME} SELECT amt, reached_at, last_at, n_customers, n_txns FROM same")
def identical_amount_clusters(t):
    return network.identical_amounts(t.txn)


@query(
    "undocumented_sweep",
    f"""{FANOUT}, {SAME}, sa1 AS (SELECT count(*) AS n, coalesce({AMOUNT}, 0e0) AS amount FROM txn WHERE channel = 'online' AND amt BETWEEN 99e0 AND 99.99e0)
    SELECT 'device_fanout' AS kind, device AS subject, n_cards AS n, amount, 'Device ' || device || ' serves ' || n_cards || ' cards with a total of ' || CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) || '.' AS claim, 0.88e0 AS confidence FROM f WHERE n_cards >= 50
    UNION ALL SELECT 'structured_amounts', 'online', n, amount, n || ' online transactions stand just below a limit, with a total of ' || CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) || '.', CASE WHEN n > 0 THEN 0.88e0 ELSE 0e0 END FROM sa1
    UNION ALL SELECT 'identical_amounts', strftime(reached_at, '%Y-%m-%d %H:%M:%S'), n_customers, CAST({DEC} * n_txns AS DOUBLE), n_customers || ' customers paid ' || CAST({DEC} AS VARCHAR) || ' within one window, first reached at ' || strftime(reached_at, '%Y-%m-%d %H:%M:%S') || '.', 0.88e0 FROM same""",
)
def undocumented_sweep(t):
    return network.undocumented_sweep(t.txn, uses(t), 50)


@query(
    "shared_device_components",
    f"""{USES}, e AS (SELECT DISTINCT 'card:' || card_id AS a, 'device:' || device AS b FROM uses),
    g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT * FROM (WITH RECURSIVE w(node, other) AS (SELECT a, a FROM g UNION SELECT w.node, g.b FROM w JOIN g ON g.a = w.other) SELECT node, min(other) AS component FROM w GROUP BY node)),
    k AS (SELECT *, CASE WHEN starts_with(node, 'card:') THEN substr(node, 6) END AS card, row_number() OVER (PARTITION BY component ORDER BY node) AS n FROM r)
    SELECT component, count(card) AS n_cards, count(*) FILTER (WHERE card IS NULL) AS n_devices, string_agg(card, ',' ORDER BY card) FILTER (WHERE n <= 10) AS sample FROM k GROUP BY 1 HAVING count(card) >= 2""",
)
def shared_device_components(t):
    return network.shared_device_components(uses(t))


@query("cards_sharing_devices", f"{USES} SELECT DISTINCT card_id FROM uses WHERE device IN (SELECT device FROM uses GROUP BY 1 HAVING count(DISTINCT card_id) >= 2)")
def cards_sharing_devices(t):
    return network.cards_sharing_devices(uses(t))


@query(
    "case_subgraph",
    f"""{USES}, rc AS (SELECT * FROM (SELECT a.case_id, t.*, row_number() OVER (PARTITION BY a.case_id ORDER BY t.ts DESC, t.txn_id DESC) AS r FROM alert a JOIN txn t ON t.card_id = a.card_id) WHERE r <= 6),
    rd AS (SELECT rc.*, d.device FROM rc LEFT JOIN dev d ON d.txn_id = rc.txn_id),
    oc AS (SELECT DISTINCT a.case_id, a.card_id, o.card_id AS other FROM alert a JOIN uses u ON u.txn_id = a.flagged_txn_id JOIN uses o ON o.device = u.device AND o.card_id <> a.card_id),
    ok AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY other) AS r FROM oc) WHERE r <= 3),
    pc AS (SELECT * FROM (SELECT a.case_id, a.card_id, c.case_id AS closed, row_number() OVER (PARTITION BY a.case_id ORDER BY c.opened_at DESC, c.case_id) AS r FROM alert a JOIN closed_case c ON c.card_id = a.card_id) WHERE r <= 3)
    SELECT case_id, 'OWNS' AS kind, customer_id AS from_id, card_id AS to_id FROM alert
    UNION ALL SELECT case_id, 'MADE', card_id, txn_id FROM rd
    UNION ALL SELECT case_id, 'BILLED_IN', txn_id, addr1 FROM rd WHERE addr1 IS NOT NULL
    UNION ALL SELECT case_id, 'PURCHASER_EMAIL', txn_id, p_email FROM rd WHERE p_email IS NOT NULL
    UNION ALL SELECT case_id, 'FROM_DEVICE', txn_id, device FROM rd WHERE device IS NOT NULL
    UNION ALL SELECT case_id, 'SHARES_DEVICE', card_id, other FROM ok
    UNION ALL SELECT case_id, 'ON_CARD', closed, card_id FROM pc""",
)
def case_subgraph(t):
    return network.case_subgraph(t.alert, t.txn, uses(t), t.closed_case)


CANDIDATES = f"""{USES}, few AS (SELECT * FROM alert), cand AS (SELECT t.txn_id, t.card_id, coalesce(d.device, 'offline_' || coalesce(t.addr1, 'none')) AS device, t.risk_score, t.amt
    FROM txn t LEFT JOIN dev d ON d.txn_id = t.txn_id WHERE t.ts >= TIMESTAMP '2024-01-03' AND t.risk_score >= 0.2e0
    AND t.txn_id NOT IN (SELECT flagged_txn_id FROM few) AND t.card_id NOT IN (SELECT card_id FROM few))"""


@query(
    "exploration_candidates",
    f"""{CANDIDATES}, a AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY risk_score DESC, amt DESC, txn_id) AS r FROM cand),
    b AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY risk_score DESC, amt DESC, txn_id) AS q FROM a WHERE r = 1)
    SELECT txn_id, card_id, device, risk_score, amt FROM b WHERE q = 1 ORDER BY risk_score DESC, amt DESC, txn_id LIMIT 20""",
)
def exploration_candidates(t):
    return network.exploration_candidates(t.txn, uses(t), t.alert, "2024-01-03", 0.2)


@query("exploration_greedy")
def exploration_greedy(t):
    return network.exploration_greedy(t.txn, uses(t), t.alert, "2024-01-03", 0.2)


MEMORY = f"""{CONNECTED}, oc AS (SELECT case_id AS prior, card_id FROM closed_case), d1 AS (SELECT DISTINCT a.case_id, x.prior FROM alert a JOIN (SELECT * FROM oc UNION SELECT case_id, card_id FROM con) x ON x.card_id = a.card_id),
    d2 AS (SELECT DISTINCT a.case_id, oc.prior FROM alert a JOIN txn t ON t.customer_id = a.customer_id JOIN oc ON oc.card_id = t.card_id WHERE a.case_id NOT IN (SELECT case_id FROM d1)),
    pm AS (SELECT u.case_id, u.prior, c.outcome FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2) u JOIN closed_case c ON c.case_id = u.prior),
    mem AS (SELECT a.case_id, string_agg(DISTINCT pm.prior, ',' ORDER BY pm.prior) AS prior_cases, count(*) FILTER (WHERE pm.outcome = 'confirmed_fraud') AS confirmed, count(*) FILTER (WHERE pm.outcome = 'cleared') AS cleared
            FROM alert a LEFT JOIN pm ON pm.case_id = a.case_id GROUP BY 1)"""


@query("case_memory_lookup", f"{MEMORY} SELECT *, CASE WHEN confirmed > 0 THEN 0.85e0 WHEN cleared > 0 THEN 0.2e0 ELSE 0.5e0 END AS confidence FROM mem")
def case_memory_lookup(t):
    return memory.case_memory_lookup(t.alert, t.closed_case, connected(t), t.txn)


@query("case_memory_lookup_devices")
def case_memory_lookup_devices(t):
    return memory.case_memory_lookup(t.alert, t.closed_case, connected(t), t.txn, uses(t))


@query(
    "cases_by_shared_device",
    """u AS (SELECT DISTINCT t.customer_id, i.device_info FROM txn t JOIN identity i ON i.txn_id = t.txn_id WHERE i.device_info IS NOT NULL),
    p AS (SELECT DISTINCT a.customer_id, b.customer_id AS other FROM u a JOIN u b ON b.device_info = a.device_info AND b.customer_id <> a.customer_id)
    SELECT DISTINCT p.customer_id, c.case_id FROM p JOIN closed_case c ON c.customer_id = p.other""",
)
def cases_by_shared_device(t):
    return memory.cases_by_shared_device(t.txn, t.identity, t.closed_case)


@query("case_exposure", f"{INVOLVES} SELECT inv.case_id, CAST(sum(abs({DEC})) AS DOUBLE) AS exposure, count(*) AS n_txns FROM inv JOIN txn t ON t.txn_id = inv.txn_id GROUP BY 1")
def case_exposure(t):
    return memory.case_exposure(involves(t), t.txn)


@query(
    "affected_transactions",
    f"""{BURSTS}, s AS (SELECT a.case_id, t.card_id, t.ts FROM alert a JOIN txn t ON t.txn_id = a.flagged_txn_id JOIN bursts b ON b.txn_id = t.txn_id WHERE b.n BETWEEN 2 AND 6 AND a.risk_score >= 0.35e0)
    SELECT case_id, flagged_txn_id AS txn_id FROM alert UNION SELECT s.case_id, t.txn_id FROM s JOIN txn t ON t.card_id = s.card_id AND t.channel = 'online' AND t.ts BETWEEN s.ts - interval '48' hour AND s.ts + interval '48' hour""",
)
def affected_transactions(t):
    strong = cards.cnp_burst(t.txn, t.alert).join(t.alert.select("case_id", F.when(F.col("risk_score") >= 0.35, 0.9).alias("probability")), "case_id")
    return memory.affected_transactions(t.alert, t.txn, strong)


@query(
    "case_write_back",
    """SELECT case_id, outcome, 1 AS version FROM closed_case UNION ALL SELECT case_id, 'open', 2 FROM alert""",
)
def case_write_back(t):
    old = t.closed_case.select("case_id", "outcome", F.lit(1).alias("version"))
    return memory.case_write_back(old, t.alert.select("case_id", F.lit("open").alias("outcome"), F.lit(2).alias("version")))


@query(
    "evidence_rows",
    """e AS (SELECT case_id, unnest(string_split(actions_taken, '|')) AS claim, generate_subscripts(string_split(actions_taken, '|'), 1) AS n FROM closed_case)
    SELECT 'EV-' || case_id || '-' || CAST(n AS STRING) AS evidence_id, case_id, claim FROM e""",
)
def evidence_rows(t):
    return memory.evidence_rows(t.closed_case.select("case_id", F.split("actions_taken", "\\|").alias("evidence")))


@query("e_similar_to", f"{MEMORY} SELECT DISTINCT case_id AS from_id, prior AS to_id FROM pm")
def e_similar_to(t):
    return memory.similar_edges(memory.case_memory_lookup(t.alert, t.closed_case, connected(t), t.txn))


@query(
    "case_memory_audit",
    """d AS (SELECT case_id, outcome, pattern, exposure_usd + CASE WHEN n_txns = 2 AND exposure_usd > 100 THEN 1e0 ELSE 0e0 END AS x FROM closed_case WHERE pattern <> 'account_takeover')
    SELECT c.case_id, c.outcome = 'cleared' AS no_evidence, concat_ws(',', CASE WHEN d.case_id IS NULL OR NOT abs(c.exposure_usd - d.x) <= 0.05e0 THEN 'exposure_usd' END,
    CASE WHEN d.case_id IS NULL THEN 'outcome' END, CASE WHEN d.case_id IS NULL THEN 'pattern' END) AS differs FROM closed_case c LEFT JOIN d ON d.case_id = c.case_id""",
)
def case_memory_audit(t):
    c = t.closed_case
    changed = c.where("pattern <> 'account_takeover'").withColumn("exposure_usd", F.expr("exposure_usd + if(n_txns = 2 and exposure_usd > 100, 1D, 0D)"))
    return memory.case_memory_audit(c, changed, c.where("outcome <> 'cleared'"))


@query(
    "monitor_expiry",
    f"""m AS (SELECT DISTINCT card_id, opened_at AS started_at FROM alert), s AS (SELECT m.card_id, m.started_at, count(*) AS n_txns, {AMOUNT} AS amount FROM m JOIN txn t ON t.card_id = m.card_id AND t.ts > m.started_at AND t.ts <= m.started_at + interval '72' hour GROUP BY ALL)
    SELECT m.card_id, m.started_at, coalesce(n_txns, 0) AS n_txns, coalesce(amount, 0e0) AS amount FROM m LEFT JOIN s ON s.card_id = m.card_id AND s.started_at = m.started_at""",
)
def monitor_expiry(t):
    return memory.monitor_expiry(t.alert.select("card_id", F.col("opened_at").alias("started_at")), t.txn)
