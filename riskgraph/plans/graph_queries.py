"""Graph construction over the adapter's views."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.operators import graph
from riskgraph.plans.base import query

DEVICE = "concat_ws(' | ', device_info, id_30, id_31, id_33)"
DEVICES = f"dev AS (SELECT txn_id, {DEVICE} AS device FROM identity)"


@query("v_customer", "SELECT DISTINCT customer_id AS id FROM txn")
def v_customer(t):
    return graph.vertices(t.txn, "customer_id")


@query("v_email_domain", "SELECT DISTINCT p_email AS id FROM txn WHERE p_email IS NOT NULL")
def v_email_domain(t):
    return graph.vertices(t.txn, "p_email")


@query("v_billing_region", "SELECT DISTINCT addr1 AS id FROM txn WHERE addr1 IS NOT NULL")
def v_billing_region(t):
    return graph.vertices(t.txn, "addr1")


@query("v_card", "r AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY ts, txn_id) AS n FROM txn) SELECT card_id AS id, customer_id, product_cd FROM r WHERE n = 1")
def v_card(t):
    return graph.cards(t.txn)


@query(
    "resolve_card_id",
    """m AS (SELECT txn_id, customer_id, card_id FROM txn WHERE ts < TIMESTAMP '2024-01-04' AND CAST(txn_id AS BIGINT) % 3 = 0),
    o AS (SELECT customer_id, min(card_id) AS only FROM m GROUP BY 1 HAVING count(DISTINCT card_id) = 1)
    SELECT t.txn_id, t.customer_id, coalesce(m.card_id, o.only, concat(t.customer_id, '-K1')) AS card_id
    FROM txn t LEFT JOIN m ON m.txn_id = t.txn_id LEFT JOIN o ON o.customer_id = t.customer_id""",
)
def resolve_card_id(t):
    known = t.txn.where("ts < timestamp_ntz'2024-01-04 00:00:00' AND cast(txn_id AS bigint) % 3 = 0")
    return graph.resolve_card_id(t.txn, known.select("txn_id", "customer_id", "card_id"))


@query("device_key", f"{DEVICES} SELECT txn_id, device FROM dev")
def device_key(t):
    return t.identity.select("txn_id", graph.device_key().alias("device"))


@query(
    "v_device_profile",
    f"d AS (SELECT *, {DEVICE} AS id, row_number() OVER (PARTITION BY {DEVICE} ORDER BY txn_id) AS n FROM identity) SELECT id, device_info, id_30, id_31, id_33, device_type FROM d WHERE n = 1",
)
def v_device_profile(t):
    return graph.devices(t.identity)


@query("v_closed_case", "SELECT case_id, customer_id, card_id, opened_at, outcome, pattern, exposure_usd FROM closed_case")
def v_closed_case(t):
    return t.closed_case.select("case_id", "customer_id", "card_id", "opened_at", "outcome", "pattern", "exposure_usd")


@query("e_owns", "SELECT DISTINCT customer_id AS from_id, card_id AS to_id FROM txn")
def e_owns(t):
    return graph.edges(t.txn, "customer_id", "card_id")


@query("e_made", "SELECT DISTINCT card_id AS from_id, txn_id AS to_id FROM txn")
def e_made(t):
    return graph.edges(t.txn, "card_id", "txn_id")


@query("e_purchaser_email", "SELECT DISTINCT txn_id AS from_id, p_email AS to_id FROM txn WHERE p_email IS NOT NULL")
def e_purchaser_email(t):
    return graph.edges(t.txn, "txn_id", "p_email")


@query("e_billed_in", "SELECT DISTINCT txn_id AS from_id, addr1 AS to_id FROM txn WHERE addr1 IS NOT NULL")
def e_billed_in(t):
    return graph.edges(t.txn, "txn_id", "addr1")


@query("e_from_device", f"{DEVICES} SELECT DISTINCT txn_id AS from_id, device AS to_id FROM dev")
def e_from_device(t):
    return graph.from_device(t.identity)


NEXT = """nx AS (SELECT card_id, txn_id AS from_id, lead(txn_id) OVER w AS to_id,
    CAST(trunc((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6) AS BIGINT) AS delta_sec
    FROM txn WINDOW w AS (PARTITION BY card_id ORDER BY ts, txn_id))"""


@query("e_next", f"{NEXT} SELECT * FROM nx WHERE to_id IS NOT NULL")
def e_next(t):
    return graph.next_edges(t.txn)


@query("e_involves", "SELECT DISTINCT case_id AS from_id, unnest(string_split(txn_ids, '|')) AS to_id FROM closed_case")
def e_involves(t):
    return graph.listed(t.closed_case, "case_id", "txn_ids")


@query("e_connected_to", "SELECT DISTINCT case_id AS from_id, unnest(string_split(connected_card_ids, '|')) AS to_id FROM closed_case WHERE connected_card_ids IS NOT NULL")
def e_connected_to(t):
    return graph.listed(t.closed_case, "case_id", "connected_card_ids")


@query("e_on_card", "SELECT DISTINCT case_id AS from_id, card_id AS to_id FROM closed_case")
def e_on_card(t):
    return graph.edges(t.closed_case, "case_id", "card_id")


@query(
    "graph_counts",
    f"""{NEXT}, {DEVICES} SELECT 'Customer' AS name, count(DISTINCT customer_id) AS n FROM txn
    UNION ALL SELECT 'Card', count(DISTINCT card_id) FROM txn UNION ALL SELECT 'Transaction', count(*) FROM txn
    UNION ALL SELECT 'DeviceProfile', count(DISTINCT device) FROM dev UNION ALL SELECT 'ClosedCase', count(*) FROM closed_case
    UNION ALL SELECT 'NEXT', count(*) FROM nx WHERE to_id IS NOT NULL
    UNION ALL SELECT 'BILLED_IN', count(*) FROM txn WHERE addr1 IS NOT NULL
    UNION ALL SELECT 'EmailDomain', count(DISTINCT p_email) FROM txn UNION ALL SELECT 'BillingRegion', count(DISTINCT addr1) FROM txn
    UNION ALL SELECT 'OWNS', count(*) FROM (SELECT DISTINCT customer_id, card_id FROM txn) UNION ALL SELECT 'MADE', count(*) FROM (SELECT DISTINCT card_id, txn_id FROM txn)
    UNION ALL SELECT 'PURCHASER_EMAIL', count(*) FROM txn WHERE p_email IS NOT NULL UNION ALL SELECT 'FROM_DEVICE', count(*) FROM (SELECT DISTINCT txn_id, device FROM dev)
    UNION ALL SELECT 'INVOLVES', count(*) FROM (SELECT DISTINCT case_id, unnest(string_split(txn_ids, '|')) FROM closed_case)
    UNION ALL SELECT 'CONNECTED_TO', count(*) FROM (SELECT DISTINCT case_id, unnest(string_split(connected_card_ids, '|')) FROM closed_case)
    UNION ALL SELECT 'ON_CARD', count(*) FROM (SELECT DISTINCT case_id, card_id FROM closed_case)""",
)
def graph_counts(t):
    """Every vertex and edge type."""
    tables = {"Customer": graph.vertices(t.txn, "customer_id"), "Card": graph.cards(t.txn), "Transaction": t.txn, "DeviceProfile": graph.devices(t.identity)}
    tables |= {"ClosedCase": t.closed_case, "NEXT": graph.next_edges(t.txn), "BILLED_IN": graph.edges(t.txn, "txn_id", "addr1")}
    tables |= {"EmailDomain": graph.vertices(t.txn, "p_email"), "BillingRegion": graph.vertices(t.txn, "addr1"), "OWNS": graph.edges(t.txn, "customer_id", "card_id"), "MADE": graph.edges(t.txn, "card_id", "txn_id")}
    tables |= {"PURCHASER_EMAIL": graph.edges(t.txn, "txn_id", "p_email"), "FROM_DEVICE": graph.from_device(t.identity), "ON_CARD": graph.edges(t.closed_case, "case_id", "card_id")}
    tables |= {"INVOLVES": graph.listed(t.closed_case, "case_id", "txn_ids"), "CONNECTED_TO": graph.listed(t.closed_case, "case_id", "connected_card_ids")}
    return graph.counts(tables)


@query(
    "next_chain_integrity",
    f"""{NEXT}, e AS (SELECT nx.card_id, count(*) AS n, min(delta_sec) AS low, bool_and(a.ts < b.ts OR (a.ts = b.ts AND a.txn_id < b.txn_id)) AS rises, count(DISTINCT from_id) = count(*) AND count(DISTINCT to_id) = count(*) AS once
        FROM nx JOIN txn a ON a.txn_id = from_id JOIN txn b ON b.txn_id = to_id WHERE to_id IS NOT NULL GROUP BY 1)
    SELECT t.card_id, t.n AS n_txns, coalesce(e.n, 0) AS n_edges, e.low AS min_delta, coalesce(e.n, 0) = t.n - 1 AND coalesce(rises AND once, true) AS is_chain
    FROM (SELECT card_id, count(*) AS n FROM txn GROUP BY 1) t LEFT JOIN e ON e.card_id = t.card_id""",
)
def next_chain_integrity(t):
    return graph.next_chain_integrity(t.txn, graph.next_edges(t.txn))


@query(
    "case_edge_coverage",
    """SELECT case_id, CAST(1 AS BIGINT) AS on_card, CAST(len(list_distinct(string_split(txn_ids, '|'))) AS BIGINT) AS involves,
    CAST(coalesce(len(list_distinct(string_split(connected_card_ids, '|'))), 0) AS BIGINT) AS connected_to, true AS reachable FROM closed_case""",
)
def case_edge_coverage(t):
    c = t.closed_case
    return graph.case_edge_coverage(c, graph.edges(c, "case_id", "card_id"), graph.listed(c, "case_id", "txn_ids"), graph.listed(c, "case_id", "connected_card_ids"))


@query(
    "upsert_by_key",
    """b AS (SELECT txn_id, amt, 1 AS version FROM txn WHERE CAST(txn_id AS BIGINT) % 4 <> 3 UNION ALL
           SELECT txn_id, amt + 1, 2 FROM txn WHERE CAST(txn_id AS BIGINT) % 2 = 1)
    SELECT txn_id, max_by(amt, version) AS amt, max(version) AS version FROM b GROUP BY txn_id""",
)
def upsert_by_key(t):
    base = t.txn.where("cast(txn_id AS bigint) % 4 <> 3").select("txn_id", "amt", F.lit(1).alias("version"))
    new = t.txn.where("cast(txn_id AS bigint) % 2 = 1").select("txn_id", (F.col("amt") + 1).alias("amt"), F.lit(2).alias("version"))
    return graph.upsert(base, new, ["txn_id"], "version")


@query(
    "insert_or_ignore",
    """SELECT DISTINCT customer_id AS from_id, card_id AS to_id FROM txn""",
)
def insert_or_ignore(t):
    online, rest = t.txn.where("channel = 'online'"), t.txn
    return graph.insert_or_ignore(graph.edges(online, "customer_id", "card_id"), graph.edges(rest, "customer_id", "card_id"), ["from_id", "to_id"])
