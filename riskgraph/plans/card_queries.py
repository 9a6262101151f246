"""Detectors and per-card queries over the adapter's views.

The constants are wider than the defaults where those give nothing on these tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.functions.params import Burst, CardTesting
from riskgraph.operators import cards
from riskgraph.plans.base import query, r4
from riskgraph.plans.graph_queries import DEVICES

WIDE = CardTesting(window_minutes=2880, max_auth=20.0, large=50.0)
HOME = """home AS (SELECT card_id, addr1 AS home_region FROM (
    SELECT card_id, addr1, row_number() OVER (PARTITION BY card_id ORDER BY count(*) DESC, addr1) AS r FROM txn WHERE addr1 IS NOT NULL GROUP BY card_id, addr1) WHERE r = 1)"""
DEC = "CAST(amt AS DECIMAL(18,2))"


@query(
    "card_window",
    """b AS (SELECT a.card_id, a.ts AS center_ts, x.txn_id, x.amt, x.ts BETWEEN a.ts - interval '24' hour AND a.ts + interval '24' hour AS near
          FROM txn a JOIN alert l ON l.flagged_txn_id = a.txn_id JOIN txn x ON x.card_id = a.card_id)
    SELECT card_id, center_ts, count(*) FILTER (WHERE near) AS n_txns, CAST(coalesce(sum(CAST(amt AS DECIMAL(18,2))) FILTER (WHERE near), 0) AS DOUBLE) AS total,
    string_agg(txn_id, ',' ORDER BY txn_id) FILTER (WHERE near) AS txn_ids, CASE WHEN count(*) FILTER (WHERE near) > 1 THEN 0.5e0 ELSE 0.1e0 END AS confidence
    FROM b GROUP BY card_id, center_ts""",
)
def card_window(t):
    flagged = t.alert.select(F.col("flagged_txn_id").alias("txn_id")).join(t.txn, "txn_id")
    return cards.card_window(t.txn, flagged.select("card_id", F.col("ts").alias("center_ts")))


@query(
    "card_baseline",
    f"""SELECT card_id, count(*) AS n, {r4(f'CAST(sum({DEC}) AS DOUBLE) / count(*)')} AS mean, {r4('median(amt)')} AS median,
    {r4('quantile_cont(amt, 0.25)')} AS p25, {r4('quantile_cont(amt, 0.75)')} AS p75, {r4('quantile_cont(amt, 0.95)')} AS p95,
    min(amt) AS "min", max(amt) AS "max", {r4('coalesce(stddev_samp(amt), 0)')} AS std FROM txn GROUP BY card_id""",
)
def card_baseline(t):
    return cards.baseline(t.txn)


@query(
    "card_category_counts",
    """SELECT card_id, 'channel' AS category, channel AS value, count(*) AS n FROM txn GROUP BY ALL
    UNION ALL SELECT card_id, 'product', product_cd, count(*) FROM txn GROUP BY ALL
    UNION ALL SELECT card_id, 'region', addr1, count(*) FROM txn WHERE addr1 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT card_id, 'email', p_email, count(*) FROM txn WHERE p_email IS NOT NULL GROUP BY ALL""",
)
def card_category_counts(t):
    return cards.category_counts(t.txn)


@query("home_region", f"{HOME} SELECT * FROM home")
def home_region(t):
    return cards.home_region(t.txn)


@query(
    "detect_card_testing",
    f"""o AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY ts, txn_id) AS place, channel = 'online' AND amt <= 20 AS probe FROM txn),
    l AS (SELECT *, NOT probe AND amt >= 50 AS large, sum(probe::INT) OVER (PARTITION BY card_id ORDER BY place) AS cp,
          sum(CASE WHEN probe THEN {DEC} ELSE 0 END) OVER (PARTITION BY card_id ORDER BY place) AS spent FROM o),
    r AS (SELECT p.card_id, p.place, p.cp, p.spent, p.amt, x.place AS x_place, x.cp AS x_cp, x.spent AS x_spent, x.txn_id AS x_id, x.amt AS x_amt
          FROM l p JOIN l x ON x.card_id = p.card_id AND x.place > p.place AND x.large AND p.probe AND x.ts <= p.ts + interval '2880' minute
          WHERE NOT EXISTS (SELECT 1 FROM l y WHERE y.card_id = p.card_id AND y.large AND y.place > p.place AND y.place < x.place) AND x.cp - p.cp + 1 >= 3),
    f AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY place) AS n FROM r),
    c AS (SELECT card_id, count(*) AS n_txns, sum(probe::INT) AS probes, sum(CASE WHEN probe THEN {DEC} END) AS all_amt FROM l GROUP BY 1)
    SELECT c.card_id, CASE WHEN n_txns < 2 THEN 0e0 WHEN x_amt > 100 THEN 0.94e0 WHEN x_id IS NOT NULL THEN 0.86e0 WHEN probes >= 3 THEN 0.55e0 ELSE 0.05e0 END AS confidence,
    CASE WHEN n_txns >= 2 AND (x_id IS NOT NULL OR probes >= 3) THEN 'card_testing' ELSE 'none' END AS pattern, coalesce(x_amt > 100, false) AS cleared_over_100,
    CAST(CASE WHEN x_id IS NOT NULL THEN x_cp - cp + 1 WHEN probes >= 3 THEN probes ELSE 0 END AS BIGINT) AS probe_count, x_id AS large_txn_id,
    CAST(CASE WHEN x_id IS NOT NULL THEN x_spent - spent + {DEC} + CAST(x_amt AS DECIMAL(18,2)) WHEN probes >= 3 THEN all_amt ELSE 0 END AS DOUBLE) AS exposure
    FROM c LEFT JOIN f ON f.card_id = c.card_id AND f.n = 1""",
)
def detect_card_testing(t):
    return cards.card_testing(t.txn, WIDE)


BURSTS = f"""bursts AS (SELECT card_id, txn_id, count(*) OVER w AS n, CAST(sum({DEC}) OVER w AS DOUBLE) AS exposure, max(amt) OVER w AS largest FROM txn WHERE channel = 'online'
    WINDOW w AS (PARTITION BY card_id ORDER BY ts RANGE BETWEEN interval '48' hour PRECEDING AND interval '48' hour FOLLOWING))"""


@query("online_bursts", f"{BURSTS} SELECT card_id, txn_id, n AS burst_count, exposure, largest FROM bursts")
def online_bursts(t):
    return cards.online_bursts(t.txn).drop("ts", "amt")


@query(
    "detect_cnp_burst",
    f"""{BURSTS}, last_ AS (SELECT card_id, amt FROM (SELECT card_id, amt, row_number() OVER (PARTITION BY card_id ORDER BY ts DESC, txn_id DESC) AS r FROM txn WHERE channel = 'online') WHERE r = 1),
    st AS (SELECT card_id, quantile_cont(amt, 0.75) AS p75, CAST(sum({DEC}) AS DOUBLE) / count(*) AS mean FROM txn GROUP BY 1),
    m AS (SELECT a.case_id, a.card_id, CAST(coalesce(b.n, CASE WHEN l.card_id IS NOT NULL THEN 1 END, 0) AS BIGINT) AS n, coalesce(b.exposure, l.amt, 0e0) AS exposure,
          coalesce(coalesce(b.largest, l.amt) > st.p75 OR coalesce(b.largest, l.amt) > st.mean * 1.5e0, false) AS odd
          FROM alert a LEFT JOIN bursts b ON b.txn_id = a.flagged_txn_id LEFT JOIN last_ l ON l.card_id = a.card_id LEFT JOIN st ON st.card_id = a.card_id)
    SELECT case_id, card_id, n AS burst_count, exposure, odd AS anomalous,
    CASE WHEN n = 0 THEN 0e0 WHEN n BETWEEN 2 AND 6 AND odd THEN 0.84e0 WHEN n BETWEEN 2 AND 6 THEN 0.7e0 WHEN n = 1 THEN 0.45e0 ELSE 0.6e0 END AS confidence FROM m""",
)
def detect_cnp_burst(t):
    return cards.cnp_burst(t.txn, t.alert, Burst())


@query(
    "densest_window",
    f"""w AS (SELECT card_id, txn_id, ts, count(*) OVER w AS n, CAST(sum({DEC}) OVER w AS DOUBLE) AS exposure FROM txn WHERE channel = 'online'
          WINDOW w AS (PARTITION BY card_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND interval '48' hour FOLLOWING)),
    r AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY n DESC, ts, txn_id) AS k FROM w)
    SELECT card_id, txn_id AS start_txn_id, ts AS start_ts, n, exposure FROM r WHERE k = 1""",
)
def densest_window(t):
    return cards.densest_window(t.txn)


@query(
    "detect_new_device",
    f"""{DEVICES} SELECT t.txn_id, coalesce(d.device, 'unknown') AS device, coalesce(i.id_15 = 'New', false) AS is_new, coalesce(contains(lower(i.id_23), 'proxy'), false) AS is_proxy,
    CASE WHEN channel <> 'online' THEN 0e0 WHEN i.id_15 = 'New' AND i.id_23 IS NOT NULL THEN 0.85e0 WHEN i.id_15 = 'New' THEN 0.78e0 WHEN i.id_15 = 'Found' THEN 0.3e0 ELSE 0.5e0 END AS confidence,
    CASE WHEN channel = 'online' AND i.id_15 = 'New' THEN 'card_not_present_new_device' ELSE 'none' END AS pattern
    FROM txn t LEFT JOIN identity i ON i.txn_id = t.txn_id LEFT JOIN dev d ON d.txn_id = t.txn_id""",
)
def detect_new_device(t):
    return cards.new_device(t.txn, t.identity)


REGION = f"""{HOME}, rv AS (SELECT card_id, addr1, count(*) AS visits FROM txn WHERE addr1 IS NOT NULL GROUP BY ALL),
    tg AS (SELECT a.case_id, t.*, h.home_region FROM alert a JOIN txn t ON t.txn_id = a.flagged_txn_id LEFT JOIN home h ON h.card_id = t.card_id),
    co AS (SELECT tg.case_id, count(*) AS n FROM tg JOIN txn x ON x.card_id = tg.card_id AND x.addr1 = tg.home_region AND x.txn_id <> tg.txn_id
           AND x.ts BETWEEN tg.ts - interval '48' hour AND tg.ts + interval '48' hour GROUP BY 1),
    rg AS (SELECT tg.case_id, tg.txn_id, tg.channel, tg.addr1 AS region, tg.home_region, CAST(greatest(coalesce(rv.visits, 0) - 1, 0) AS BIGINT) AS prior, coalesce(co.n, 0) AS concurrent_home
           FROM tg LEFT JOIN rv ON rv.card_id = tg.card_id AND rv.addr1 = tg.addr1 LEFT JOIN co ON co.case_id = tg.case_id)"""


@query(
    "detect_region_anomaly",
    f"""{REGION} SELECT case_id, txn_id, region, home_region, prior, concurrent_home,
    CASE WHEN prior = 0 AND channel = 'in_person' AND region IS NOT NULL THEN CASE WHEN concurrent_home > 0 THEN 0.88e0 ELSE 0.38e0 END WHEN prior >= 10 THEN 0.1e0 ELSE 0.25e0 END AS confidence,
    CASE WHEN prior = 0 AND channel = 'in_person' AND region IS NOT NULL AND concurrent_home > 0 THEN 'out_of_region_use' ELSE 'none' END AS pattern FROM rg""",
)
def detect_region_anomaly(t):
    return cards.region_anomaly(t.txn, t.alert)


@query(
    "detect_account_takeover",
    """h AS (SELECT card_id, count(*) FILTER (WHERE channel = 'in_person') AS in_person, count(*) FILTER (WHERE channel = 'online') AS online FROM txn GROUP BY 1),
    m AS (SELECT a.case_id, t.txn_id, t.channel, CAST((m1 = 'F')::INT + coalesce((m4 = 'M2')::INT, 0) + (m6 = 'F')::INT AS INTEGER) AS mismatches, h.in_person, h.online
          FROM alert a JOIN txn t ON t.txn_id = a.flagged_txn_id JOIN h ON h.card_id = t.card_id)
    SELECT case_id, txn_id, mismatches, in_person, online,
    CASE WHEN channel = 'online' AND online <= 1 AND in_person >= 15 AND mismatches >= 1 THEN 0.88e0 WHEN mismatches >= 2 THEN 0.78e0 ELSE 0.2e0 END AS confidence,
    CASE WHEN (channel = 'online' AND online <= 1 AND in_person >= 15 AND mismatches >= 1) OR mismatches >= 2 THEN 'account_takeover' ELSE 'none' END AS pattern FROM m""",
)
def detect_account_takeover(t):
    return cards.account_takeover(t.txn, t.alert)


@query(
    "flag_rarity",
    f"""l AS (SELECT txn_id, customer_id, 'm1' AS flag, m1 AS value FROM txn UNION ALL SELECT txn_id, customer_id, 'm4', m4 FROM txn WHERE m4 IS NOT NULL UNION ALL SELECT txn_id, customer_id, 'm6', m6 FROM txn),
    s AS (SELECT *, {r4('CAST(count(*) OVER (PARTITION BY customer_id, flag, value) AS DOUBLE) / count(*) OVER (PARTITION BY customer_id, flag)')} AS share FROM l) SELECT *, share < 0.1e0 AS rare FROM s""",
)
def flag_rarity(t):
    return cards.flag_rarity(t.txn)


@query(
    "feature_outliers",
    """l AS (SELECT txn_id, customer_id, 'amt' AS feature, amt AS value FROM txn UNION ALL SELECT txn_id, customer_id, 'risk_score', risk_score FROM txn),
    s AS (SELECT *, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS std FROM l WINDOW w AS (PARTITION BY customer_id, feature))
    SELECT txn_id, customer_id, feature, value FROM s WHERE abs(value - mean) > 3 * std""",
)
def feature_outliers(t):
    return cards.outliers(t.txn, ("amt", "risk_score"))


@query("amount_percentile", f"SELECT txn_id, card_id, {r4('cume_dist() OVER (PARTITION BY card_id ORDER BY amt)')} AS share FROM txn")
def amount_percentile(t):
    return cards.amount_percentile(t.txn)


@query(
    "activity_window",
    """f AS (SELECT a.case_id, t.txn_id, t.customer_id, t.ts FROM alert a JOIN txn t ON t.txn_id = a.flagged_txn_id)
    SELECT f.case_id, x.txn_id, x.ts, x.amt, x.txn_id = f.txn_id AS is_flagged FROM f JOIN txn x ON x.customer_id = f.customer_id AND x.ts BETWEEN f.ts - interval '7' day AND f.ts + interval '7' day""",
)
def activity_window(t):
    return cards.activity_window(t.txn, t.alert)


@query(
    "probe_cluster",
    """s AS (SELECT card_id, txn_id, ts, lead(ts, 2) OVER w AS t3, lead(txn_id, 2) OVER w AS third_txn_id FROM txn WHERE channel = 'online' AND amt < 20 WINDOW w AS (PARTITION BY card_id ORDER BY ts, txn_id))
    SELECT card_id, txn_id, third_txn_id FROM s WHERE t3 <= ts + interval '2880' minute""",
)
def probe_cluster(t):
    return cards.probe_cluster(t.txn, 20.0, 2880)


@query(
    "device_first_seen",
    f"""{DEVICES} SELECT customer_id, device, count(*) AS n, min(ts) AS first_ts, count(*) = 1 AS is_new FROM txn JOIN dev ON dev.txn_id = txn.txn_id GROUP BY 1, 2""",
)
def device_first_seen(t):
    return cards.device_first_seen(t.txn, t.identity)


@query(
    "recurring_charge",
    """b AS (SELECT card_id, product_cd, floor(amt / 20) * 20 AS amt, ts, txn_id FROM txn),
    g AS (SELECT card_id, product_cd, amt, CAST(trunc((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY card_id, product_cd, amt ORDER BY ts, txn_id))) / 1e6) AS BIGINT) / 86400e0 AS days FROM b)
    SELECT card_id, product_cd, amt, count(*) AS repeats FROM g WHERE days BETWEEN 1 AND 3 GROUP BY ALL HAVING count(*) >= 2""",
)
def recurring_charge(t):
    rounded = t.txn.withColumn("amt", (F.floor(F.col("amt") / 20) * 20).cast("double"))
    return cards.recurring_charges(rounded, 1, 3)


@query(
    "recurring_mentions",
    """SELECT conv_id, turn, contains(lower(text), 'recurring') OR contains(lower(text), 'subscription') OR contains(lower(text), 'gym') AS recurring FROM conversations""",
)
def recurring_mentions(t):
    return t.read("conversations").select("conv_id", "turn", cards.mentions_recurring(F.col("text")).alias("recurring"))
