"""Scans, profiling, retrieval, validation, streams and the flagship investigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskgraph.functions.expressions import r4 as r4_of
from riskgraph.operators import evaluate, features, graph, model, network, policy, reports, retrieval
from riskgraph.plans.base import nested, query, r4
from riskgraph.plans.card_queries import DEC
from riskgraph.plans.feature_queries import FEATURES, case_features_of
from riskgraph.plans.network_queries import INVOLVES, affected_transactions, involves
from riskgraph.plans.policy_queries import ASSESS, assessments, rules
from riskgraph.sources import files
from riskgraph.streaming import streams


def _csv(t, df, name: str) -> str:
    path = files.scratch(t.spark, name)
    df.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path, header=True)
    return path


@query("scan_transactions", "SELECT txn_id, product_cd, addr1, p_email, customer_id, channel, m1, m4, m6, ts, amt, risk_score FROM txn")
def scan_transactions(t):
    out = t.txn.select(F.col("txn_id").alias("TransactionID"), F.col("amt").alias("TransactionAmt"), "ts", "channel", "risk_score", F.col("product_cd").alias("ProductCD"), "addr1", F.col("p_email").alias("P_emaildomain"), "customer_id", F.col("m1").alias("M1"), F.col("m4").alias("M4"), F.col("m6").alias("M6"))
    return files.scan_transactions(t.spark, _csv(t, out, "transactions"))


@query("scan_identity", "SELECT txn_id, id_15, id_23, id_30, id_31, id_33, device_type, device_info FROM identity")
def scan_identity(t):
    out = t.identity.select(F.col("txn_id").alias("TransactionID"), "id_15", "id_23", "id_30", "id_31", "id_33", F.col("device_type").alias("DeviceType"), F.col("device_info").alias("DeviceInfo"))
    return files.scan_identity(t.spark, _csv(t, out, "identity"))


@query("scan_closed_cases", "SELECT * REPLACE (report_filed = 'Yes' AS report_filed) FROM closed_case")
def scan_closed_cases(t):
    dotted = t.closed_case.withColumn("first_fraud_txn_id", F.concat("first_fraud_txn_id", F.lit(".0")))
    return files.scan_closed_cases(t.spark, _csv(t, dotted, "closed_cases"))


@query("scan_case_pack", "SELECT * FROM alert")
def scan_case_pack(t):
    return files.scan_case_pack(t.spark, _csv(t, t.alert, "case_pack"))


def answers(t):
    r = F.col("customer_response")
    case = F.struct(policy.status(r).alias("status"), policy.verdict(r).alias("verdict"), policy.posterior(F.col("risk_score"), r).alias("fraud_probability"), F.lit("none").alias("pattern"), F.array("flagged_txn_id").alias("affected_txn_ids"), F.coalesce("risk_score", F.lit(0.0)).alias("exposure_usd"))
    return t.alert.select("case_id", F.lit("settled").alias("stop_reason"), F.lit(9).alias("tool_calls"), case.alias("case"))


@query(
    "scan_case_answers",
    """SELECT case_id, 'settled' AS stop_reason, CASE customer_response WHEN 'confirms' THEN 'legitimate' WHEN 'denies' THEN 'fraud' ELSE 'uncertain' END AS verdict,
    CASE customer_response WHEN 'confirms' THEN floor(greatest(0.18e0, least(0.32e0, coalesce(risk_score, 0.5e0) * 0.25e0 + 0.12e0)) * 100 + 0.5e0) / 100
    WHEN 'denies' THEN floor(least(0.95e0, greatest(0.78e0, coalesce(risk_score, 0.7e0) * 0.2e0 + 0.72e0)) * 100 + 0.5e0) / 100 ELSE 0.58e0 END AS probability,
    coalesce(risk_score, 0e0) AS exposure, 1 AS n_txns, opened_at, trigger_type FROM alert""",
)
def scan_case_answers(t):
    path = files.scratch(t.spark, "answers")
    files.write_case_answers(answers(t), path)
    return files.scan_case_answers(t.spark, path, t.alert)


@query("write_case_answers")
def write_case_answers(t):
    path = files.scratch(t.spark, "answers")
    files.write_case_answers(answers(t), path)
    return t.spark.read.schema(files.ANSWER).json(path).select("case_id", "stop_reason", "case.status")


@query("write_next_edges")
def write_next_edges(t):
    path = files.scratch(t.spark, "next")
    files.write_next_edges(graph.next_edges(t.txn), path)
    return t.spark.read.schema("from_txn_id STRING, to_txn_id STRING, card_id STRING, delta_sec BIGINT").csv(path, header=True)


def published(t):
    """Transactions and closed cases as tables of as many buckets."""
    n, tables = files.buckets_for(t.txn.count()), []
    for df, name, at in ((t.txn, "transactions", "ts"), (t.closed_case, "cases", "opened_at")):
        path = files.scratch(t.spark, name)
        table = f"{name}_{path.rsplit('-', 1)[1]}"
        files.publish_tables(df, table, path, "card_id", at, n)
        tables.append(t.spark.table(table))
    return tables


@query(
    "publish_tables",
    "m AS (SELECT strftime(ts, '%Y-%m') AS month, card_id, count(*) AS n FROM txn GROUP BY 1, 2), k AS (SELECT card_id, count(*) AS n_cases FROM closed_case GROUP BY 1) SELECT m.*, coalesce(n_cases, 0) AS n_cases FROM m LEFT JOIN k ON k.card_id = m.card_id",
)
def publish_tables(t):
    """Per month and card its transactions, and the card's closed cases, from the two published tables."""
    txn, cases = published(t)
    return txn.groupBy("month", "card_id").agg(F.count("*").alias("n")).join(cases.groupBy("card_id").agg(F.count("*").alias("n_cases")), "card_id", "left").fillna(0, ["n_cases"])


COLUMNS = ("txn_id", "card_id", "customer_id", "ts", "amt", "product_cd", "channel", "risk_score", "addr1", "p_email", "m1", "m4", "m6")
COUNTED = ("card_id", "customer_id", "product_cd", "channel", "addr1", "p_email", "m1", "m4", "m6")


@query(
    "null_profile",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, {r4(f'count(*) FILTER (WHERE {c} IS NULL)::DOUBLE / count(*)')} AS null_share, {f'count(DISTINCT {c})' if c in COUNTED else 'CAST(NULL AS BIGINT)'} AS n_distinct FROM txn" for c in COLUMNS),
)
def null_profile(t):
    """All columns; those of few values, and cards and customers, with their distinct values."""
    return reports.null_profile(t.txn.select(*COLUMNS), COUNTED)


@query("file_dimensions", "SELECT 'txn' AS name, count(*) AS n_rows, 12 + 1 AS n_columns FROM txn UNION ALL SELECT 'identity', count(*), 8 FROM identity UNION ALL SELECT 'closed_case', count(*), 14 FROM closed_case")
def file_dimensions(t):
    return reports.file_dimensions({"txn": t.txn, "identity": t.identity, "closed_case": t.closed_case})


@query(
    "category_share",
    f"""c AS (SELECT 'channel' AS category, channel AS value FROM txn UNION ALL SELECT 'product_cd', product_cd FROM txn UNION ALL SELECT 'addr1', coalesce(addr1, '(null)') FROM txn
    UNION ALL SELECT 'device_type', device_type FROM identity UNION ALL SELECT 'id_15', coalesce(id_15, '(null)') FROM identity UNION ALL SELECT 'trigger_type', trigger_type FROM alert), n AS (SELECT category, value, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT *, {r4('n::DOUBLE / sum(n) OVER (PARTITION BY category)')} AS share FROM n""",
)
def category_share(t):
    return reports.category_share(t.txn, ["channel", "product_cd", "addr1"]).union(reports.category_share(t.identity, ["device_type", "id_15"])).union(reports.category_share(t.alert, ["trigger_type"]))


@query("score_histogram", "SELECT b AS bin, count(t.txn_id) AS n FROM (SELECT unnest(range(10))::INT AS b) LEFT JOIN txn t ON least(floor(t.risk_score * 10), 9)::INT = b GROUP BY 1")
def score_histogram(t):
    return reports.score_histogram(t.txn, "risk_score")


@query("distribution_stats", f"SELECT count(amt) AS n, {r4('avg(amt)')} AS mean, {r4('median(amt)')} AS median, {r4('stddev_samp(amt)')} AS std, min(amt) AS min, max(amt) AS max FROM txn")
def distribution_stats(t):
    return reports.distribution_stats(t.txn, "amt")


@query(
    "score_precision_proxy",
    f"{INVOLVES}, o AS (SELECT DISTINCT inv.txn_id, c.outcome FROM inv JOIN closed_case c ON c.case_id = inv.case_id) SELECT count(*) FILTER (WHERE outcome = 'confirmed_fraud') AS fraud, count(*) FILTER (WHERE outcome = 'cleared') AS cleared FROM txn t JOIN o ON o.txn_id = t.txn_id WHERE risk_score > 0.3e0",
)
def score_precision_proxy(t):
    return reports.score_precision_proxy(t.txn, involves(t), t.closed_case, 0.3)


@query("identity_coverage", "SELECT count(*) AS online, count(i.txn_id) AS with_identity, count(*) - count(i.txn_id) AS without FROM txn t LEFT JOIN identity i ON i.txn_id = t.txn_id WHERE channel = 'online'")
def identity_coverage(t):
    return reports.identity_coverage(t.txn, t.identity)


@query(
    "outcome_pattern_matrix",
    " UNION ALL ".join(f"""SELECT '{a} x {b}' AS matrix, coalesce({a}, '(all)') AS row, coalesce({b}, '(all)') AS "column", count(*) AS n FROM closed_case GROUP BY CUBE ({a}, {b})""" for a, b in (("pattern", "outcome"), ("outcome", "report_filed"), ("pattern", "report_filed"))),
)
def outcome_pattern_matrix(t):
    return reports.outcome_pattern_matrix(t.closed_case)


@query(
    "exposure_quantiles",
    " UNION ALL ".join(f"SELECT '{by}' AS by, {by} AS value, min(exposure_usd) AS min, {r4('quantile_cont(exposure_usd, 0.25)')} AS p25, {r4('quantile_cont(exposure_usd, 0.5)')} AS median, {r4('quantile_cont(exposure_usd, 0.75)')} AS p75, max(exposure_usd) AS max, {r4('avg(exposure_usd)')} AS mean FROM closed_case GROUP BY 2" for by in ("outcome", "pattern", "report_filed")),
)
def exposure_quantiles(t):
    return reports.exposure_quantiles(t.closed_case)


@query("action_vocabulary", "SELECT action, count(*) AS n FROM (SELECT unnest(string_split(actions_taken, '|')) AS action FROM closed_case) GROUP BY 1")
def action_vocabulary(t):
    return reports.action_vocabulary(t.closed_case)


@query("action_combos", "SELECT actions_taken, count(*) AS n FROM closed_case GROUP BY 1 ORDER BY n DESC, actions_taken LIMIT 10")
def action_combos(t):
    return reports.action_combos(t.closed_case)


@query("connected_card_stats", f"SELECT count(*) AS n, count(connected_card_ids) AS with_list, {r4('median(len(string_split(connected_card_ids, chr(124))))')} AS median, max(len(string_split(connected_card_ids, '|')))::INT AS longest FROM closed_case")
def connected_card_stats(t):
    return reports.connected_card_stats(t.closed_case)


@query("date_ranges", "SELECT 'txn' AS name, min(ts) AS first, max(ts) AS last FROM txn UNION ALL SELECT 'case', min(opened_at), max(opened_at) FROM closed_case")
def date_ranges(t):
    return reports.date_ranges({"txn": (t.txn, "ts"), "case": (t.closed_case, "opened_at")})


@query("sentence_count", r"SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 3))::INT AS n FROM documents")
def sentence_count(t):
    return t.read("documents").select("doc_id", reports.sentence_count(F.col("text")).alias("n"))


NOTE = "'Case ' || case_id || ' on card ' || card_id || '. Outcome: ' || replace(outcome, '_', ' ') || '. Pattern: ' || replace(pattern, '_', ' ') || '. Actions: ' || replace(actions_taken, '|', ', ') || '.'"


@query("note_documents", f"""SELECT case_id AS doc_id, 'case_note' AS category, {NOTE} AS content, '{{"customer_id":"' || customer_id || '","outcome":"' || outcome || '"}}' AS metadata_json FROM closed_case""")
def note_documents(t):
    return retrieval.note_documents(t.closed_case)


def headed(t):
    """The documents with some of their lines as headings and rules, as they have none."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    text = lambda n: n.cast("string")
    heading = lambda x, i: F.concat(F.lit("## "), text(i), F.lit(". "), F.substring(x, 1, 30))
    rule = lambda x, i: F.concat(F.lit("**R"), text(i), F.lit(". Limit ** "), x)
    note = lambda i: F.concat(F.lit("### "), text(i), F.lit("a. Note"))
    return t.read("documents").select("doc_id", F.array_join(F.transform(lines, lambda x, i: F.when(i % 5 == 1, heading(x, i)).when(i % 5 == 3, rule(x, i)).when(i % 5 == 4, note(i)).otherwise(x)), "\n").alias("text"))


@query(
    "policy_sections",
    r"""hd AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: CASE (i - 1) % 5 WHEN 1 THEN '## ' || (i - 1) || '. ' || x[:30] WHEN 3 THEN '**R' || (i - 1) || '. Limit ** ' || x WHEN 4 THEN '### ' || (i - 1) || 'a. Note' ELSE x END) AS ls FROM documents),
    ln AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM hd)),
    lv AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6}[ \t]') THEN length(regexp_extract(line, '^#+')) WHEN regexp_matches(line, '^\*\*[A-Z]?[0-9]+[a-z]?\.[ \t]*[^*]+\*\*') THEN 7 END AS level FROM ln),
    mk AS (SELECT *, count(*) FILTER (WHERE level IS NOT NULL OR i = 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n FROM lv),
    sc AS (SELECT doc_id, n, coalesce(min(level), 0) AS level, arg_min(line, i) AS head, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level IS NULL) AS rest FROM mk GROUP BY 1, 2),
    pa AS (SELECT doc_id, n, max(p) AS parent FROM (SELECT a.doc_id, a.n, b.n AS p FROM sc a JOIN sc b ON b.doc_id = a.doc_id AND b.n < a.n AND b.level BETWEEN 1 AND a.level - 1) GROUP BY 1, 2)
    SELECT sc.doc_id, sc.n::INT AS n, CASE level WHEN 0 THEN 'text' WHEN 7 THEN 'rule' ELSE 'section' END AS kind, level::INT AS level,
    CASE level WHEN 0 THEN NULL WHEN 7 THEN regexp_extract(head, '^\*\*([A-Z]?[0-9]+[a-z]?)', 1) ELSE nullif(regexp_extract(head, '^#+[ \t]+([0-9]+[a-z]?)\.[ \t]', 1), '') END AS ref,
    CASE level WHEN 0 THEN '' WHEN 7 THEN trim(regexp_extract(head, '^\*\*[A-Z]?[0-9]+[a-z]?\.([^*]+)', 1)) ELSE trim(regexp_replace(head, '^#+[ \t]+([0-9]+[a-z]?\.[ \t]+)?', '')) END AS title,
    regexp_replace(concat_ws(chr(10), CASE level WHEN 7 THEN regexp_replace(head, '^\*\*[^*]+\*\*', '') END, rest), '^\s+|\s+$', '', 'g') AS body, pa.parent::INT AS parent FROM sc LEFT JOIN pa ON pa.doc_id = sc.doc_id AND pa.n = sc.n""",
)
def policy_sections(t):
    return retrieval.policy_sections(headed(t))


TERMS = f"""tk AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}'), lambda w: NOT list_contains([{', '.join(f"'{w}'" for w in retrieval.STOP_WORDS)}], w)) AS w FROM documents),
    tt AS (SELECT doc_id, unnest(w) AS term FROM tk UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM tk),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tt GROUP BY 1, 2), vo AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 25000),
    rw AS (SELECT tf.doc_id, tf.term, (1 + ln(tf.tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + vo.df)::DOUBLE) + 1) AS w FROM tf JOIN vo ON vo.term = tf.term),
    ix AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM rw)"""


WHOLE_INDEX = f"{TERMS} SELECT doc_id, term, {r4('weight')} AS weight FROM ix"


@query("tfidf_index", WHOLE_INDEX)
def tfidf_index(t):
    """Every weight of every document, to four decimals."""
    return retrieval.tfidf_index(t.read("documents"), "text").withColumn("weight", r4_of(F.col("weight")))


SEARCH_BY_20 = f"""{TERMS}, sc AS (SELECT q.doc_id AS query_id, d.doc_id, floor(sum(q.weight * d.weight) * 1e6 + 0.5e0) / 1e6 AS score FROM ix q JOIN ix d ON d.term = q.term AND d.doc_id <> q.doc_id WHERE q.doc_id % 20 = 0 GROUP BY 1, 2),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM sc WHERE score > 0) SELECT * FROM rk WHERE rank <= 5"""


@query("search_documents", SEARCH_BY_20)
def search_documents(t):
    """The stated query set, ids divisible by 20, against all documents."""
    docs = t.read("documents")
    return retrieval.search_documents(docs, docs.where("doc_id % 20 = 0"), text="text", alike=True)


@query("search_in_category", SEARCH_BY_20.replace("WHERE q.doc_id % 20 = 0", "WHERE q.doc_id % 20 = 0 AND d.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')"))
def search_in_category(t):
    """The same queries against the documents of one category, weighed by the whole corpus."""
    docs = t.read("documents")
    return retrieval.search_documents(docs, docs.where("doc_id % 20 = 0"), text="text", among=docs.where("lang = 'en'"), alike=True)


@query("similar_cases")
def similar_cases(t):
    notes = retrieval.note_documents(t.closed_case)
    return retrieval.search_documents(notes, notes, 3, alike=True)


def verdicts(t):
    r = F.col("customer_response")
    return t.alert.select("case_id", "trigger_type", policy.verdict(r).alias("verdict"), policy.posterior(F.col("risk_score"), r).alias("probability"), "flagged_txn_id").join(t.txn.select(F.col("txn_id").alias("flagged_txn_id"), F.col("amt").alias("exposure")), "flagged_txn_id")


VERDICTS = """vd AS (SELECT a.case_id, a.trigger_type, CASE customer_response WHEN 'confirms' THEN 'legitimate' WHEN 'denies' THEN 'fraud' ELSE 'uncertain' END AS verdict,
    CASE customer_response WHEN 'confirms' THEN floor(greatest(0.18e0, least(0.32e0, coalesce(a.risk_score, 0.5e0) * 0.25e0 + 0.12e0)) * 100 + 0.5e0) / 100
    WHEN 'denies' THEN floor(least(0.95e0, greatest(0.78e0, coalesce(a.risk_score, 0.7e0) * 0.2e0 + 0.72e0)) * 100 + 0.5e0) / 100 ELSE 0.58e0 END AS probability, t.amt AS exposure FROM alert a JOIN txn t ON t.txn_id = a.flagged_txn_id)"""
EXPOSURE = "CAST(sum(CAST(exposure AS DECIMAL(18,2))) AS DOUBLE)"


@query(
    "audit_ledger",
    f"""{VERDICTS}, {ASSESS}, vb AS (SELECT vd.*, asm.risk_score, array_to_string({rules('resp')}, ',') AS actions, least(floor(probability * 10), 9)::INT AS bin FROM vd JOIN asm ON asm.case_id = vd.case_id),
    vs AS (SELECT verdict, count(*) AS verdict_cases, {r4('avg(probability)')} AS mean_p, {r4('coalesce(stddev_samp(probability), 0)')} AS std_p, {EXPOSURE} AS verdict_exposure FROM vd GROUP BY 1)
    SELECT case_id, trigger_type, risk_score, vb.verdict, probability, exposure, actions, bin, count(*) OVER (PARTITION BY bin) AS bin_cases, verdict_cases, mean_p, std_p, verdict_exposure FROM vb JOIN vs ON vs.verdict = vb.verdict""",
)
def audit_ledger(t):
    acts = policy.evaluate(assessments(t)).select("case_id", "risk_score", policy.action_names().alias("actions"))
    return reports.audit_ledger(verdicts(t).drop("flagged_txn_id").join(acts, "case_id"))


@query("batch_summary", f"{VERDICTS}, {ASSESS} SELECT count(*) AS n, count(*) FILTER (WHERE verdict = 'fraud') AS fraud, count(*) FILTER (WHERE verdict = 'legitimate') AS legitimate, count(*) FILTER (WHERE verdict = 'uncertain') AS uncertain, count(*) FILTER (WHERE x >= 1000 OR origin IS NOT NULL OR connected >= 2 OR pattern = 'undocumented') AS filings, {EXPOSURE} AS exposure, {r4('avg(probability)')} AS mean_p FROM vd JOIN asm ON asm.case_id = vd.case_id")
def batch_summary(t):
    """Filings are those of the policy."""
    return reports.batch_summary(verdicts(t).join(policy.sar_decision(assessments(t)).select("case_id", "file"), "case_id"))


@query("case_filter_counts", f"{VERDICTS} SELECT trigger_type, verdict, count(*) AS n FROM vd GROUP BY 1, 2")
def case_filter_counts(t):
    return reports.case_filter_counts(verdicts(t))


def documents_of(t):
    """Case documents with some faults of each kind."""
    n = F.col("flagged_txn_id").cast("bigint")
    legit = F.col("verdict") == "legitimate"
    v = verdicts(t).join(t.alert.select("case_id", "opened_at", "customer_response"), "case_id")
    file = (n % 3 == 0) & (~legit | (n % 61 == 0))
    act = lambda name, route, reason: F.struct(F.lit(name).alias("action"), F.lit(route).alias("route") if isinstance(route, str) else route.alias("route"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    block = act("BLOCK_CARD", F.when(n % 41 == 0, "auto").otherwise("L1"), F.when(n % 43 == 0, "because").otherwise("R2: the customer denied it"))
    closing = F.when(legit, F.array(act("CLOSE_NO_FRAUD", "auto", "R3: confirmed"))).otherwise(F.array(block))
    told = F.concat(F.lit("Card "), "flagged_txn_id", F.lit(" was used. It was not its holder. They were asked. They denied it. The card is blocked. This is filed."))
    written = [
        F.when(n % 59 == 0, "fits none").otherwise("").alias("pattern_description"), F.when(legit, "").when(n % 23 == 0, "other").otherwise(F.col("flagged_txn_id")).alias("first_txn_id"),
        F.when(n % 29 == 0, F.array(F.lit("CC-none"))).otherwise(F.array().cast("array<string>")).alias("similar"),
        F.array(F.struct(F.lit("a claim").alias("claim"), F.when(n % 31 == 0, "web").otherwise("graph").alias("source"), F.when(n % 37 == 0, "see notes").otherwise("query:card_baseline(card_id=1)").alias("ref"), F.array("case_id").alias("entity_ids"))).alias("evidence"),
        F.when(n % 19 == 0, "One thing.").otherwise("Two things were seen. Both are told.").alias("summary"), F.array(act("VERIFY_WITH_CUSTOMER", "auto", "R1: unclear")).alias("initial"),
        F.when(file & (n % 53 != 0), F.concat(closing, F.array(act("FILE_REPORT", "L2", "Policy 3a")))).otherwise(closing).alias("final"), F.when(n % 47 == 0, 0).otherwise(1).alias("n_requests"), F.lit("the customer answered").alias("what_changed"),
        F.when(file, F.array("flagged_txn_id")).otherwise(F.array().cast("array<string>")).alias("subjects"), F.when(file, F.col("exposure")).otherwise(0.0).alias("total"),
        F.when(file, F.array(F.lit("2024-01-02"), F.when(n % 67 == 0, "2024-01-01").otherwise("2024-01-03"))).otherwise(F.array().cast("array<string>")).alias("dates"), F.lit("settled").alias("stop_reason"), F.when(n % 71 == 0, "CASE-none").otherwise(F.col("case_id")).alias("graph_case_id"),
    ]
    return v.select(
        "case_id", F.when(n % 7 == 0, "pending").otherwise(policy.status(F.col("customer_response"))).alias("status"), "verdict", F.when(n % 11 == 0, F.col("probability") + 1).otherwise(F.col("probability")).alias("probability"), F.lit("none").alias("pattern"),
        F.when(legit, 0.0).when(n % 5 == 0, F.col("exposure") + 1).otherwise(F.col("exposure")).alias("exposure"), F.when(legit, F.array().cast("array<string>")).otherwise(F.array(F.when(n % 13 == 0, "missing").otherwise(F.col("flagged_txn_id")))).alias("txn_ids"),
        file.alias("file"), F.when(file, F.when(n % 2 == 0, told).otherwise("Something happened. That is all.")).otherwise("").alias("narrative"), "opened_at", F.when(n % 17 == 0, F.expr("opened_at - interval '1' hour")).alias("closed_at"), *written,
    )


@query(
    "validate_cases",
    f"""{VERDICTS}, dc AS (SELECT v.*, CAST(a.flagged_txn_id AS BIGINT) AS n, a.opened_at, verdict = 'legitimate' AS legit FROM vd v JOIN alert a ON a.case_id = v.case_id),
    dd AS (SELECT *, n % 3 = 0 AND (NOT legit OR n % 61 = 0) AS file FROM dc)
    SELECT case_id, unnest(list_filter([CASE WHEN n % 7 = 0 THEN 'status' END, CASE WHEN n % 11 = 0 THEN 'probability_range' END, CASE WHEN NOT legit AND n % 13 = 0 THEN 'transaction_exists' END,
    CASE WHEN NOT legit AND (n % 13 = 0 OR n % 5 = 0) THEN 'exposure_matches' END, CASE WHEN n % 7 = 0 AND verdict <> 'uncertain' THEN 'status_fits_verdict' END, CASE WHEN n % 59 = 0 THEN 'only_undocumented_is_described' END,
    CASE WHEN n % 19 = 0 THEN 'summary_sentences' END, CASE WHEN legit AND file THEN 'legitimate_files_nothing' END, CASE WHEN verdict = 'fraud' AND (n % 23 = 0) <> (n % 13 = 0) OR verdict = 'fraud' AND n % 23 = 0 THEN 'first_is_affected' END,
    CASE WHEN n % 29 = 0 THEN 'similar_case_exists' END, CASE WHEN n % 31 = 0 THEN 'evidence_source' END, CASE WHEN n % 37 = 0 THEN 'evidence_ref' END, CASE WHEN n % 47 = 0 THEN 'unasked_is_unchanged' END,
    CASE WHEN NOT legit AND (n % 41 = 0 OR exposure + CASE WHEN n % 5 = 0 THEN 1e0 ELSE 0e0 END > 2500) THEN 'action_route' END, CASE WHEN NOT legit AND n % 43 = 0 THEN 'action_cites_rule' END, CASE WHEN file AND n % 53 = 0 THEN 'file_agrees_with_final' END,
    CASE WHEN file AND n % 2 <> 0 THEN 'filed_has_narrative' END, CASE WHEN file AND n % 2 <> 0 THEN 'subjects_are_named' END, CASE WHEN file AND n % 67 = 0 THEN 'filed_dates' END, CASE WHEN n % 71 = 0 THEN 'written_is_found' END,
    CASE WHEN n % 17 = 0 THEN 'date_order' END], lambda c: c IS NOT NULL)) AS code FROM dd""",
)
def validate_cases(t):
    return reports.validate_cases(documents_of(t), t.txn, t.closed_case, t.alert)


@query(
    "normalize_case",
    f"""{VERDICTS}, dc AS (SELECT v.*, CAST(a.flagged_txn_id AS BIGINT) AS n, a.flagged_txn_id AS id, verdict = 'legitimate' AS legit FROM vd v JOIN alert a ON a.case_id = v.case_id),
    dd AS (SELECT *, n % 3 = 0 AND (NOT legit OR n % 61 = 0) AS file, n % 47 = 0 AS unasked FROM dc),
    de AS (SELECT *, CASE WHEN legit THEN [] WHEN n % 23 = 0 AND n % 13 = 0 THEN ['missing', 'other'] WHEN n % 23 = 0 THEN [id, 'other'] WHEN n % 13 = 0 THEN ['missing', id] ELSE [id] END AS ids FROM dd),
    df AS (SELECT *, CASE WHEN legit THEN 0e0 WHEN list_contains(ids, id) THEN CAST(CAST(exposure AS DECIMAL(18,2)) AS DOUBLE) WHEN n % 5 = 0 THEN exposure + 1 ELSE exposure END AS x, file AND NOT legit AND n % 53 <> 0 AND NOT unasked AS filed FROM de)
    SELECT case_id, verdict, CASE verdict WHEN 'fraud' THEN 'closed_fraud' WHEN 'legitimate' THEN 'closed_legitimate' ELSE 'open' END AS status, CASE WHEN n % 11 = 0 THEN 1e0 ELSE probability END AS probability, 'none' AS pattern,
    array_to_string(list_sort(ids), ',') AS txn_ids, CASE WHEN legit THEN '' WHEN n % 23 = 0 THEN 'other' ELSE id END AS first_txn_id, x AS exposure, '' AS similar, 'graph query:' || CASE WHEN n % 37 = 0 THEN 'see notes' ELSE 'card_baseline(card_id=1)' END AS evidence,
    'VERIFY_WITH_CUSTOMER auto R1: unclear' AS initial, CASE WHEN unasked THEN 'VERIFY_WITH_CUSTOMER auto R1: unclear' ELSE CASE WHEN legit THEN 'CLOSE_NO_FRAUD auto R3: confirmed' ELSE 'BLOCK_CARD ' || CASE WHEN x <= 2500 THEN 'L1' ELSE 'L2' END || CASE WHEN n % 43 = 0 THEN ' R1: because' ELSE ' R2: the customer denied it' END END
      || CASE WHEN file AND n % 53 <> 0 THEN '; FILE_REPORT L2 Policy 3a' ELSE '' END END AS "final", CASE WHEN unasked THEN 'nothing' ELSE 'the customer answered' END AS what_changed, filed AS file, CASE WHEN filed THEN x ELSE 0e0 END AS total,
    CASE WHEN filed THEN CASE WHEN n % 67 = 0 THEN '2024-01-01,2024-01-02' ELSE '2024-01-02,2024-01-03' END ELSE '' END AS dates, CASE WHEN filed AND n % 2 = 0 THEN id ELSE '' END AS subjects FROM df""",
)
def normalize_case(t):
    return reports.normalize_case(documents_of(t), t.txn, t.closed_case)


@query(
    "sar_report",
    f"""{VERDICTS}, {ASSESS}, {nested("affected_transactions", "af")}, ag AS (SELECT af.case_id, count(*) AS n, sum({DEC}) AS total, min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date FROM af JOIN txn t ON t.txn_id = af.txn_id GROUP BY 1),
        sr AS (SELECT asm.*, a.card_id, a.customer_id, a.flagged_txn_id, vd.verdict, vd.probability,
        concat_ws('; and ', CASE WHEN x >= 1000 THEN 'exposure reaches the filing limit' END, CASE WHEN origin IS NOT NULL OR connected >= 2 THEN 'origin shared with other cards' END, CASE WHEN pattern = 'undocumented' THEN 'undocumented pattern' END) AS reason
        FROM asm JOIN alert a ON a.case_id = asm.case_id JOIN vd ON vd.case_id = asm.case_id WHERE x >= 1000 OR origin IS NOT NULL OR connected >= 2 OR pattern = 'undocumented')
    SELECT sr.case_id, customer_id || ',' || sr.card_id AS subjects, CAST(total AS DOUBLE) AS total, first_date, last_date,
    'This report concerns card ' || sr.card_id || ' of customer ' || sr.customer_id || '. The alert came from a ' || replace(trigger_type, '_', ' ') || '. It covers ' || n || CASE n WHEN 1 THEN ' transaction' ELSE ' transactions' END || ' with a total of ' || CAST(total AS VARCHAR)
    || ' dollars. They took place between ' || CAST(first_date AS VARCHAR) || ' and ' || CAST(last_date AS VARCHAR) || '. '
    || CASE pattern WHEN 'none' THEN 'The activity fits no documented pattern.' WHEN 'undocumented' THEN 'The activity fits a pattern that is not documented yet.' ELSE 'The activity fits the pattern ' || replace(pattern, '_', ' ') || '.' END
    || CASE verdict WHEN 'fraud' THEN ' The customer denied the transactions.' WHEN 'legitimate' THEN ' The customer confirmed the transactions.' ELSE ' The customer has not settled the question.' END
    || ' The probability of fraud is put at ' || CAST(CAST(probability AS DECIMAL(4,2)) AS VARCHAR) || '. The filing reason is: ' || reason || '.' AS narrative FROM sr JOIN ag ON ag.case_id = sr.case_id""",
)
def sar_report(t):
    given = assessments(t)
    decided = policy.sar_decision(given).join(given.select("case_id", "pattern"), "case_id")
    cases = verdicts(t).drop("flagged_txn_id").join(decided, "case_id").join(t.alert.select("case_id", "card_id", "customer_id"), "case_id")
    return reports.sar_report(cases, affected_transactions(t), t.txn)


@query(
    "contributing_signals",
    f"""{FEATURES}, fs AS (SELECT ft.*, a.flagged_txn_id, a.card_id, a.flagged_txn_id || ',' || a.card_id AS pair_ids FROM ft JOIN alert a ON a.case_id = ft.case_id),
    sg AS (SELECT case_id, 'testing' AS signal, 'query:detect_card_testing' AS ref, 'high_fraud' AS impact, pair_ids AS entity_ids FROM fs WHERE conf_testing >= 0.5e0
    UNION ALL SELECT case_id, 'new_device', 'query:detect_new_device', 'high_fraud', flagged_txn_id FROM fs WHERE is_new_device = 1
    UNION ALL SELECT case_id, 'proxy', 'query:detect_new_device', 'high_fraud', flagged_txn_id FROM fs WHERE is_proxy = 1
    UNION ALL SELECT case_id, 'new_region', 'query:detect_region_anomaly', 'high_fraud', pair_ids FROM fs WHERE is_new_region = 1
    UNION ALL SELECT case_id, 'takeover', 'query:detect_account_takeover', 'high_fraud', pair_ids FROM fs WHERE conf_ato >= 0.6e0
    UNION ALL SELECT case_id, 'mismatch', 'query:card_baseline', 'moderate_fraud', flagged_txn_id FROM fs WHERE conf_ato < 0.6e0 AND mismatch_count >= 1
    UNION ALL SELECT case_id, 'burst', 'query:detect_cnp_burst', 'moderate_fraud', pair_ids FROM fs WHERE conf_burst >= 0.6e0 OR online_48h >= 2
    UNION ALL SELECT case_id, 'amount_ratio', 'query:card_baseline', 'moderate_fraud', pair_ids FROM fs WHERE amount_to_mean_ratio >= 2e0
    UNION ALL SELECT case_id, 'prior_fraud', 'query:similar_prior_cases', 'high_fraud', card_id FROM fs WHERE prior_fraud_rate > 0.6e0 AND prior_cases_count >= 1
    UNION ALL SELECT case_id, 'lone_risk', 'query:card_baseline', 'unsupported_alert', flagged_txn_id FROM fs WHERE lone_risk_score > 0.5e0)
    SELECT *, 'graph' AS source FROM sg UNION ALL SELECT case_id, 'baseline', 'query:card_baseline', 'legitimate_activity', pair_ids, 'graph' FROM fs WHERE flagged_risk_score < 0.3e0 AND case_id NOT IN (SELECT case_id FROM sg)""",
)
def contributing_signals(t):
    """The alert's own risk score stands for the probability, as nothing is trained here; ``score_case`` has the model's."""
    given = case_features_of(t).withColumn("probability", F.col("flagged_risk_score")).join(t.alert.select("case_id", "flagged_txn_id", "card_id"), "case_id")
    return reports.contributing_signals(given)


def labelled(t):
    """Closed cases as (case_id, features, y)."""
    cases = t.closed_case.select("case_id", "card_id", F.col("first_fraud_txn_id").alias("flagged_txn_id"), "opened_at")
    return features.case_features(cases, t.txn, t.identity, t.closed_case, 20.0, 50.0, 2880).join(t.closed_case.select("case_id", (F.col("outcome") == "confirmed_fraud").cast("int").alias("y")), "case_id")


FULL = model.Model()


@query("stratified_split")
def stratified_split(t):
    return model.stratified_split(t.closed_case.select("case_id", "outcome"), "case_id", "outcome")


@query("train_fraud_model")
def train_fraud_model(t):
    rows = network.checkpointed(labelled(t))
    split = model.stratified_split(rows, "case_id", "y")
    fitted = model.train(split.where("train"), "case_id", "y", FULL)
    return evaluate.binary_metrics(fitted.predict(split.where("NOT train")).select(F.col("probability").alias("p"), "y"))


@query("predict_probability")
def predict_probability(t):
    rows = network.checkpointed(labelled(t))
    return model.train(rows, "case_id", "y", FULL).predict(case_features_of(t)).select("case_id", "probability")


def _stream(t, name: str):
    """The events as files of a stream, and the folders that a run needs."""
    source = files.scratch(t.spark, f"{name}-in")
    t.txn.select("txn_id", "card_id", "customer_id", "ts", "amt", "channel").repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(source)
    return source, files.scratch(t.spark, f"{name}-state"), files.scratch(t.spark, f"{name}-out")


STREAM_SCHEMA = "txn_id STRING, card_id STRING, customer_id STRING, ts TIMESTAMP_NTZ, amt DOUBLE, channel STRING"


@query("stream_ingest", "SELECT txn_id, card_id, amt FROM txn")
def stream_ingest(t):
    """The events in four batches, of which the second run finds none left."""
    source, state, out = _stream(t, "ingest")
    streams.open_table(t.spark, out, STREAM_SCHEMA)
    for _ in range(2):
        streams.ingest_batches(t.spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), out, state)
    return t.spark.read.schema(STREAM_SCHEMA).parquet(out).select("txn_id", "card_id", "amt")


@query(
    "stream_velocity",
    f"""pn AS (SELECT card_id, date_trunc('hour', ts) AS pane, count(*) AS n, sum({DEC}) AS amount FROM txn GROUP BY 1, 2),
    pw AS (SELECT card_id, 24 AS hours, unnest(list_transform(range(24), lambda i: pane - to_hours(CAST(i AS INTEGER)))) AS start, n, amount FROM pn UNION ALL SELECT card_id, 48, unnest(list_transform(range(48), lambda i: pane - to_hours(CAST(i AS INTEGER)))), n, amount FROM pn)
    SELECT card_id, hours, CAST(start AS TIMESTAMP) AS start, CAST(sum(n) AS BIGINT) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM pw GROUP BY 1, 2, 3""",
)
def stream_velocity(t):
    """The batch twin, of 24 and 48 hours."""
    txn = t.txn.withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.velocity_batch(txn, (24, 48)).withColumn("start", F.col("start").cast("timestamp_ntz"))


ROWS_A_RUN = 2_000_000  # that a stream takes up at once


def in_order(t, rows_a_run: int = ROWS_A_RUN) -> list:
    """The events with a time, parted by it into runs of about as many rows: what a stream is given one after the other."""
    cols = ("txn_id", "card_id", "customer_id", "ts", "amt", "channel")
    txn, us = t.txn.select(*cols).where("ts IS NOT NULL"), F.unix_micros(F.col("ts").cast("timestamp"))
    n = -(-txn.count() // rows_a_run)
    limits = sorted(set(txn.select(F.percentile_approx(us, [i / n for i in range(1, n)])).first()[0])) if n > 1 else []
    ends = [None, *limits, None]
    return [txn.where(F.lit(True) if a is None else us > a).where(F.lit(True) if b is None else us <= b) for a, b in zip(ends, ends[1:])]


@query("stream_velocity_run")
def stream_velocity_run(t, rows_a_run: int = ROWS_A_RUN):
    """The windows of 24 and 48 hours that the watermark has closed, of the events as one stream of hourly panes; it takes them up run by run, so its state is that of two days and a run."""
    session = t.spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKS)
    source, state, out = (files.scratch(t.spark, f"velocity-{n}") for n in ("in", "state", "out"))
    for rows in in_order(t, rows_a_run):
        rows.write.mode("append").parquet(source)
        streams.run_once(streams.panes(streams.ingest(session, source, STREAM_SCHEMA, "txn_id", files=1_000_000)), state, out)
    seen = F.date_trunc("millisecond", F.max(F.col("ts").cast("timestamp")))
    watermark = t.spark.read.schema(STREAM_SCHEMA).parquet(source).select((seen - F.expr(f"interval '{LATE_DAYS}' day")).alias("w")).first().w
    return streams.velocity_closed(t.spark.read.schema("card_id STRING, pane TIMESTAMP, n BIGINT, paid BIGINT, amount DECIMAL(28,2)").parquet(out), (24, 48), watermark)


@query(
    "stream_sessions",
    f"""g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + interval '6' hour THEN 0 ELSE 1 END AS fresh FROM txn WHERE channel = 'online' WINDOW w AS (PARTITION BY card_id ORDER BY ts, txn_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY card_id ORDER BY ts, txn_id) AS k FROM g)
    SELECT card_id, min(ts) AS start, max(ts) + interval '6' hour AS "end", count(*) AS n, CAST(sum({DEC}) AS DOUBLE) AS amount FROM s GROUP BY card_id, k""",
)
def stream_sessions(t):
    """The batch twin of the session window."""
    found = streams.sessions(t.txn.withColumn("ts", F.col("ts").cast("timestamp")))
    return found.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


@query("stream_sessions_run")
def stream_sessions_run(t):
    """The sessions that the watermark has closed, of the events as a stream."""
    source, state, out = _stream(t, "sessions")
    streams.run_once(streams.sessions(streams.ingest(t.spark, source, STREAM_SCHEMA, "txn_id")), state, out)
    return t.spark.read.parquet(out)


@query("stream_no_reply_run")
def stream_no_reply_run(t):
    """Requests and responses as two streams; a request counts as unanswered once the watermark has passed its time."""
    folders = [files.scratch(t.spark, f"reply-{n}") for n in ("requests", "responses", "state", "out")]
    sides = []
    for path, df, time in zip(folders, no_reply_inputs(t), ("asked_at", "answered_at")):
        df = df.withColumn(time, F.col(time).cast("timestamp"))
        df.write.parquet(path)
        sides.append(t.spark.readStream.schema(df.schema).parquet(path).withWatermark(time, "2 days"))
    streams.run_once(streams.no_reply(*sides), folders[2], folders[3])
    return t.spark.read.parquet(folders[3])


LATE_DAYS = 2
TESTING = f"""tr AS (SELECT card_id, txn_id, ts, CAST(amt AS DECIMAL(18,2)) AS amt, channel = 'online' AND amt <= 20 AS probe FROM txn WHERE (channel = 'online' AND amt <= 20) OR amt >= 50),
    tn AS (SELECT *, coalesce(sum((NOT probe)::INT) OVER (PARTITION BY card_id ORDER BY ts, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM tr)
    SELECT l.card_id, l.txn_id AS large_txn_id, count(*)::INT AS probes, CAST(sum(p.amt) + l.amt AS DOUBLE) AS exposure FROM tn l JOIN tn p ON p.card_id = l.card_id AND p.run = l.run AND p.probe AND p.ts >= l.ts - interval '2880' minute
    WHERE NOT l.probe"""


@query("stream_card_testing_batch", f"{TESTING} GROUP BY l.card_id, l.txn_id, l.amt HAVING count(*) >= 3")
def stream_card_testing_batch(t):
    """The batch twin, over all rows."""
    return streams.card_testing_batch(t.txn, 2880, 20.0, 50.0)


@query("stream_card_testing", f"{TESTING} AND l.ts <= date_trunc('millisecond', (SELECT max(ts) FROM txn)) - interval '{LATE_DAYS}' day GROUP BY l.card_id, l.txn_id, l.amt HAVING count(*) >= 3")
def stream_card_testing(t):
    """The alarms whose time the watermark has passed, of the events as a stream. A session of its own has the state store that timers need."""
    session = t.spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKS)
    source, state, out = _stream(t, "testing")
    stream = session.readStream.schema(STREAM_SCHEMA).parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{LATE_DAYS} days")
    streams.run_once(streams.card_testing(stream, 2880, 20.0, 50.0), state, out)
    return t.spark.read.schema("card_id string, large_txn_id string, probes int, exposure double").parquet(out)


@query(
    "stream_no_reply",
    """SELECT case_id, opened_at AS asked_at, CASE WHEN t.amt * 3 > 500 THEN 'MONITOR_CARD,DECLINE_TRANSACTION,ESCALATE_TO_ANALYST' ELSE 'MONITOR_CARD,DECLINE_TRANSACTION' END AS actions FROM alert a JOIN txn t ON t.txn_id = a.flagged_txn_id
    WHERE customer_response IN ('no_reply', 'none') OR CAST(flagged_txn_id AS BIGINT) % 40 > 24""",
)
def stream_no_reply(t):
    """The batch twin."""
    return streams.no_reply(*no_reply_inputs(t))


def no_reply_inputs(t):
    """Requests and responses; answers come so many hours after the request as the id says."""
    asked = t.alert.join(t.txn.select(F.col("txn_id").alias("flagged_txn_id"), "amt"), "flagged_txn_id").select("case_id", F.col("opened_at").alias("asked_at"), (F.col("amt") * 3).alias("exposure"))
    answered = t.alert.where("customer_response IN ('confirms', 'denies')").select("case_id", F.expr("opened_at + make_dt_interval(0, cast(cast(flagged_txn_id as bigint) % 40 as int), 0, 0)").alias("answered_at"))
    return asked, answered


