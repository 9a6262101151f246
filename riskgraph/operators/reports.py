"""Profiling of the inputs, case documents and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.operators.quantiles import HOT, with_quantiles
from riskgraph.functions.expressions import joined, money, r4, total
from riskgraph.operators import policy


def null_profile(df: DataFrame, counted: tuple[str, ...] | None = None) -> DataFrame:
    """Per column: nulls, their share and distinct values, from one aggregate.

    Each exact distinct count copies the rows once, so ``counted`` names the columns that get one (all by default); the others have null.
    """
    distinct = lambda c: F.count_distinct(c) if counted is None or c in counted else F.lit(None).cast("long")
    sums = df.agg(F.count("*").alias("rows"), *(F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), distinct(c).alias("distinct")).alias(c) for c in df.columns))
    long = sums.select("rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in df.columns))).alias("x"))
    return long.select(F.col("x.column").alias("column"), F.col("x.v.nulls").alias("nulls"), r4(F.col("x.v.nulls") / F.col("rows")).alias("null_share"), F.col("x.v.distinct").alias("n_distinct"))


def file_dimensions(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.groupBy().agg(F.lit(n).alias("name"), F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def category_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts and shares of each column's values, nulls as ``(null)``."""
    long = df.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.coalesce(c, F.lit("(null)")) for c in columns)))).alias("category", "value"))
    n = long.groupBy("category", "value").agg(F.count("*").alias("n"))
    return n.withColumn("share", r4(F.col("n") / F.sum("n").over(Window.partitionBy("category"))))


def score_histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts of [0, 1] in left-closed bins, the last one closed; empty bins have 0."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    all_ = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_.join(n, "bin", "left").fillna(0, ["n"])


def distribution_stats(df: DataFrame, column: str, hot: int = HOT) -> DataFrame:
    """One row; of more than ``hot`` values the median comes by counts of value ranges, so that no task gets all values."""
    others = [F.count(column).alias("n"), r4(F.avg(column)).alias("mean"), r4(F.stddev_samp(column)).alias("std"), F.min(column).alias("min"), F.max(column).alias("max")]
    found = with_quantiles(df.select(column, F.lit(0).alias("__all")), "__all", column, {"median": 0.5}, others, hot)
    return found.select("n", "mean", r4(F.col("median")).alias("median"), "std", "min", "max")


def score_precision_proxy(txn: DataFrame, involves: DataFrame, cases: DataFrame, threshold: float) -> DataFrame:
    """High-scored transactions that belong to fraud or to cleared cases."""
    outcome = involves.select(F.col("from_id").alias("case_id"), F.col("to_id").alias("txn_id")).join(cases.select("case_id", "outcome"), "case_id").select("txn_id", "outcome").distinct()
    met = txn.where(F.col("risk_score") > threshold).select("txn_id").join(outcome, "txn_id")
    return met.agg(F.count_if(F.col("outcome") == "confirmed_fraud").alias("fraud"), F.count_if(F.col("outcome") == "cleared").alias("cleared"))


def identity_coverage(txn: DataFrame, identity: DataFrame) -> DataFrame:
    met = txn.where("channel = 'online'").select("txn_id").join(identity.select("txn_id", F.lit(1).alias("seen")), "txn_id", "left")
    return met.agg(F.count("*").alias("online"), F.count("seen").alias("with_identity"), F.count_if(F.col("seen").isNull()).alias("without"))


def outcome_pattern_matrix(cases: DataFrame, pairs=(("pattern", "outcome"), ("outcome", "report_filed"), ("pattern", "report_filed"))) -> DataFrame:
    """Cases per pair of columns with totals, in long form: ``matrix`` names the pair; a total's value is ``(all)``."""
    out = None
    for a, b in pairs:
        n = cases.cube(a, b).agg(F.count("*").alias("n"))
        part = n.select(F.lit(f"{a} x {b}").alias("matrix"), F.coalesce(a, F.lit("(all)")).alias("row"), F.coalesce(b, F.lit("(all)")).alias("column"), "n")
        out = part if out is None else out.union(part)
    return out


def exposure_quantiles(cases: DataFrame, by: tuple[str, ...] = ("outcome", "pattern", "report_filed"), hot: int = HOT) -> DataFrame:
    """Quantiles of exposure per value of each column of ``by``, from one expanded pass. A value may hold any share of the cases."""
    long = cases.select("exposure_usd", F.explode(F.array(*(F.struct(F.lit(c).alias("by"), F.col(c).alias("value")) for c in by))).alias("g"))
    others = [F.min("exposure_usd").alias("min"), F.max("exposure_usd").alias("max"), r4(F.avg("exposure_usd")).alias("mean")]
    found = with_quantiles(long, "g", "exposure_usd", {"p25": 0.25, "median": 0.5, "p75": 0.75}, others, hot)
    return found.select("g.by", "g.value", "min", *(r4(F.col(c)).alias(c) for c in ("p25", "median", "p75")), "max", "mean")


def action_vocabulary(cases: DataFrame) -> DataFrame:
    return cases.select(F.explode(F.split("actions_taken", "\\|")).alias("action")).groupBy("action").agg(F.count("*").alias("n"))


def action_combos(cases: DataFrame, k: int = 10) -> DataFrame:
    return cases.groupBy("actions_taken").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "actions_taken").limit(k)


def connected_card_stats(cases: DataFrame) -> DataFrame:
    n = F.size(F.split("connected_card_ids", "\\|"))
    listed = F.when(F.col("connected_card_ids").isNotNull(), n)
    return cases.agg(F.count("*").alias("n"), F.count("connected_card_ids").alias("with_list"), r4(F.percentile(listed, F.lit(0.5))).alias("median"), F.max(listed).alias("longest"))


def date_ranges(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    parts = [df.groupBy().agg(F.lit(n).alias("name"), F.min(c).alias("first"), F.max(c).alias("last")) for n, (df, c) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def sentence_count(text: Column) -> Column:
    """Sentences of more than three characters."""
    return F.size(F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 3))


def audit_ledger(cases: DataFrame, bins: int = 10) -> DataFrame:
    """One line per case of (case_id, trigger_type, risk_score, verdict, probability, exposure, actions): its bin of the probability's
    histogram with the bin's cases, and its verdict's cases, mean and deviation of the probability and exposure.

    Bins and verdicts are a bounded few rows and are broadcast to the cases.
    """
    marked = cases.withColumn("bin", F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int"))
    held = marked.groupBy("bin").agg(F.count("*").alias("bin_cases"))
    by = cases.groupBy("verdict").agg(F.count("*").alias("verdict_cases"), r4(F.avg("probability")).alias("mean_p"), r4(F.coalesce(F.stddev_samp("probability"), F.lit(0.0))).alias("std_p"), total("exposure").alias("verdict_exposure"))
    return marked.join(F.broadcast(held), "bin").join(F.broadcast(by), "verdict")


#: Rules of ``contributing_signals`` in order: name, condition on the features, query, impact, whether the card is named too. The thresholds are fixed values.
SIGNALS = (
    ("testing", "conf_testing >= 0.50D", "detect_card_testing", "high_fraud", True),
    ("new_device", "is_new_device = 1", "detect_new_device", "high_fraud", False),
    ("proxy", "is_proxy = 1", "detect_new_device", "high_fraud", False),
    ("new_region", "is_new_region = 1", "detect_region_anomaly", "high_fraud", True),
    ("takeover", "conf_ato >= 0.60D", "detect_account_takeover", "high_fraud", True),
    ("mismatch", "conf_ato < 0.60D AND mismatch_count >= 1", "card_baseline", "moderate_fraud", False),
    ("burst", "conf_burst >= 0.60D OR online_48h >= 2", "detect_cnp_burst", "moderate_fraud", True),
    ("amount_ratio", "amount_to_mean_ratio >= 2.0D", "card_baseline", "moderate_fraud", True),
    ("prior_fraud", "prior_fraud_rate > 0.60D AND prior_cases_count >= 1", "similar_prior_cases", "high_fraud", None),
    ("lone_risk", "lone_risk_score > 0.50D", "card_baseline", "unsupported_alert", False),
)


def contributing_signals(cases: DataFrame, low: float = 0.30) -> DataFrame:
    """Per case of (case_id, flagged_txn_id, card_id, probability and the features) one row per signal: ``signal``, ``source``, ``ref``, ``impact``, ``entity_ids``.

    A case below ``low`` without any signal has the one that it fits its card's baseline.
    """
    ids = lambda card: F.col("card_id") if card is None else F.concat_ws(",", "flagged_txn_id", "card_id") if card else F.col("flagged_txn_id")
    row = lambda name, ref, impact, card: F.struct(F.lit(name).alias("signal"), F.lit("graph").alias("source"), F.lit(f"query:{ref}").alias("ref"), F.lit(impact).alias("impact"), ids(card).alias("entity_ids"))
    found = F.filter(F.array(*(F.when(F.expr(rule), row(name, ref, impact, card)) for name, rule, ref, impact, card in SIGNALS)), lambda s: s.isNotNull())
    usual = F.when(F.col("probability") < low, F.array(row("baseline", "card_baseline", "legitimate_activity", True)))
    return cases.select("case_id", found.alias("found"), usual.alias("usual")).select("case_id", F.explode(F.when(F.size("found") > 0, F.col("found")).otherwise(F.col("usual"))).alias("s")).select("case_id", "s.*")


def batch_summary(cases: DataFrame) -> DataFrame:
    """One row over a batch of (verdict, file, exposure, probability)."""
    return cases.agg(F.count("*").alias("n"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("fraud", "legitimate", "uncertain")), F.count_if("file").alias("filings"), total("exposure").alias("exposure"), r4(F.avg("probability")).alias("mean_p"))


def case_filter_counts(cases: DataFrame) -> DataFrame:
    """Cases by trigger and verdict."""
    return cases.groupBy("trigger_type", "verdict").agg(F.count("*").alias("n"))


def sar_report(cases: DataFrame, affected: DataFrame, txn: DataFrame) -> DataFrame:
    """Per filed case its report: subjects, total, first and last date of its transactions and a narrative of eight sentences.

    ``cases`` has case_id, card_id, customer_id, trigger_type, pattern, verdict, probability, file and reason.
    """
    met = affected.join(txn.select("txn_id", "amt", "ts"), "txn_id")
    facts = met.groupBy("case_id").agg(F.sum(money("amt")).alias("sum"), F.min(F.to_date("ts")).alias("first_date"), F.max(F.to_date("ts")).alias("last_date"), F.count("*").alias("n"))
    out = cases.where("file").join(facts, "case_id")
    spaced = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    text = F.concat_ws(
        " ",
        F.concat(F.lit("This report concerns card "), "card_id", F.lit(" of customer "), "customer_id", F.lit(".")),
        F.concat(F.lit("The alert came from a "), spaced("trigger_type"), F.lit(".")),
        F.concat(F.lit("It covers "), F.col("n").cast("string"), F.when(F.col("n") == 1, " transaction").otherwise(" transactions"), F.lit(" with a total of "), F.col("sum").cast("decimal(18,2)").cast("string"), F.lit(" dollars.")),
        F.concat(F.lit("They took place between "), F.col("first_date").cast("string"), F.lit(" and "), F.col("last_date").cast("string"), F.lit(".")),
        F.when(F.col("pattern") == "none", "The activity fits no documented pattern.").when(F.col("pattern") == "undocumented", "The activity fits a pattern that is not documented yet.").otherwise(F.concat(F.lit("The activity fits the pattern "), spaced("pattern"), F.lit("."))),
        F.when(F.col("verdict") == "fraud", "The customer denied the transactions.").when(F.col("verdict") == "legitimate", "The customer confirmed the transactions.").otherwise("The customer has not settled the question."),
        F.concat(F.lit("The probability of fraud is put at "), F.col("probability").cast("decimal(4,2)").cast("string"), F.lit(".")),
        F.concat(F.lit("The filing reason is: "), F.col("reason"), F.lit(".")),
    )
    return out.select("case_id", F.concat_ws(",", "customer_id", "card_id").alias("subjects"), F.col("sum").cast("double").alias("total"), "first_date", "last_date", text.alias("narrative"))


# What a case document may hold.
STATUSES = ("open", "closed_fraud", "closed_legitimate")
VERDICTS = ("fraud", "legitimate", "uncertain")
PATTERNS = ("none", "card_testing", "card_not_present_fraud", "card_not_present_new_device", "out_of_region_use", "account_takeover", "undocumented")


SOURCES = ("graph", "customer", "analyst", "vector_store")
REF = r"^(query:[a-zA-Z0-9_]+(\(.*\))?|doc:[a-zA-Z0-9_.-]+|evidence_request:[0-9]+)$"
RULE = r"(?i)\b(R[0-9]+|Policy\s*[0-9]+[a-z]?)\b"
CITATION = r"(?i)(\b(R[0-9]+|Policy\s*[0-9]+[a-z]?)\b|standard\s+procedure|device\s+profile|customer\s+reported|recurring|baseline|unauthorized)"
DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def validate_cases(cases: DataFrame, txn: DataFrame, closed: DataFrame, written: DataFrame, statuses=STATUSES, verdicts=VERDICTS, patterns=PATTERNS, tolerance: float = 0.05) -> DataFrame:
    """One row per broken rule: ``case_id``, ``code``. A rule that a null keeps from being checked is broken.

    ``cases`` has case_id, status, verdict, probability, pattern, pattern_description, exposure, txn_ids (array), first_txn_id, similar
    (array of closed cases), evidence (array of claim, source, ref, entity_ids), summary, initial and final (arrays of action, route,
    reason), n_requests, what_changed, file, narrative, subjects (array), total, dates (array of text), stop_reason, graph_case_id
    (null where nothing was written), opened_at, closed_at. Transactions are checked against ``txn``, exposure against their sum,
    similar cases against ``closed`` and written ones against ``written`` (both case_id).
    """
    empty = F.array().cast("array<string>")
    listed = cases.select("case_id", F.explode(F.array_distinct("txn_ids")).alias("txn_id"))
    known = listed.join(txn.select("txn_id", "amt"), "txn_id", "left").groupBy("case_id").agg(F.count_if(F.col("amt").isNull()).alias("unknown"), F.coalesce(F.sum(F.abs(money("amt"))).cast("double"), F.lit(0.0)).alias("sum"))
    alike = cases.select("case_id", F.explode(F.array_distinct("similar")).alias("similar_id")).join(closed.select(F.col("case_id").alias("similar_id")).distinct(), "similar_id", "left_anti").groupBy("case_id").agg(F.count("*").alias("strange"))
    stored = written.select(F.col("case_id").alias("graph_case_id"), F.lit(True).alias("stored")).distinct()
    met = cases.join(known, "case_id", "left").join(alike, "case_id", "left").join(stored, "graph_case_id", "left")
    c = F.col
    n, legit, fraud, filed = F.size(F.coalesce("txn_ids", empty)), c("verdict") == "legitimate", c("verdict") == "fraud", c("file")
    said, actions = F.coalesce(c("narrative"), F.lit("")), F.concat("initial", "final")
    reports_ = F.exists("final", lambda a: a["action"] == "FILE_REPORT")
    asked, nothing = c("n_requests") > 0, F.lower(F.trim("what_changed")) == "nothing"
    rules = {
        "case_id": F.length(F.trim("case_id")) > 0,
        "stop_reason": F.length(F.trim("stop_reason")) > 0,
        "status": c("status").isin(*statuses),
        "verdict": c("verdict").isin(*verdicts),
        "probability_range": c("probability").between(0, 1),
        "pattern": c("pattern").isin(*patterns),
        "only_undocumented_is_described": (c("pattern") == "undocumented") == (F.length(F.trim(F.coalesce("pattern_description", F.lit("")))) > 0),
        "summary_sentences": sentence_count(c("summary")).between(2, 6),
        "legitimate_has_none": ~legit | ((n == 0) & (c("exposure") == 0) & (c("first_txn_id") == "")),
        "legitimate_files_nothing": ~(legit & filed),
        "fraud_needs_transactions": ~fraud | (n > 0),
        "first_is_affected": ~fraud | F.array_contains("txn_ids", c("first_txn_id")),
        "transaction_exists": F.coalesce("unknown", F.lit(0)) == 0,
        "exposure_matches": F.abs(c("exposure") - F.coalesce("sum", F.lit(0.0))) <= tolerance,
        "exposure_sign": c("exposure") >= 0,
        "status_fits_verdict": (fraud == (c("status") == "closed_fraud")) & (legit == (c("status") == "closed_legitimate")),
        "similar_case_exists": F.coalesce("strange", F.lit(0)) == 0,
        "evidence_source": F.forall("evidence", lambda e: e["source"].isin(*SOURCES)),
        "evidence_ref": F.forall("evidence", lambda e: F.trim(e["ref"]).rlike(REF)),
        "evidence_whole": F.forall("evidence", lambda e: e["claim"].isNotNull() & e["entity_ids"].isNotNull()),
        "has_initial": F.size("initial") > 0,
        "has_final": F.size("final") > 0,
        "unasked_is_unchanged": asked | ((c("initial") == c("final")) & nothing),
        "asked_is_explained": ~asked | ~nothing,
        "action_known": F.forall(actions, lambda a: a["action"].isin(*policy.ORDER)),
        "action_route": F.forall(actions, lambda a: ~a["action"].isin(*policy.ORDER) | (a["route"] == policy.action_route(a["action"], c("exposure")))),
        "action_cites_rule": F.forall(actions, lambda a: a["reason"].rlike(CITATION)),
        "file_agrees_with_final": filed == reports_,
        "filed_has_narrative": ~filed | sentence_count(said).between(6, 12),
        "filed_has_subjects": ~filed | (F.size("subjects") > 0),
        "subjects_are_named": ~filed | F.forall("subjects", lambda s: F.instr(said, s) > 0),
        "filed_dates": ~filed | ((F.size("dates") == 2) & F.forall("dates", lambda d: d.rlike(DATE)) & (F.get("dates", F.lit(0)) <= F.get("dates", F.lit(1)))),
        "unfiled_is_empty": filed | ((said == "") & (F.size("subjects") == 0) & (c("total") == 0) & (F.size("dates") == 0)),
        "written_is_found": c("graph_case_id").isNull() | F.coalesce("stored", F.lit(False)),
        "date_order": F.coalesce(c("closed_at") >= c("opened_at"), F.lit(True)),
    }
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules.items())), lambda c: c.isNotNull())
    return met.select("case_id", F.explode(broken).alias("code"))


def normalize_case(cases: DataFrame, txn: DataFrame, closed: DataFrame) -> DataFrame:
    """Case answers (columns as for ``validate_cases``) in normal form.

    An unknown verdict counts as fraud, the status follows the verdict, probability is held within [0, 1], an unknown pattern is
    undocumented from 0.70 and else none. Legitimate cases have no pattern, transactions or exposure. The first transaction is among
    the affected ones; exposure is their sum in ``txn``, or as stated if none is known. Unknown sources become ``graph``, refs get their
    prefix, unknown similar cases go, unknown actions go, routes follow the policy, reasons cite a rule, and without a request the first
    actions stand. A report is filed where the last actions say so and the case isn't legitimate; its dates are put in order.
    """
    c = F.col
    verdict = F.lower(F.trim("verdict"))
    df = cases.withColumn("verdict", F.when(verdict.isin(*VERDICTS), verdict).otherwise("fraud"))
    legit, none = c("verdict") == "legitimate", F.array().cast("array<string>")
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("probability", F.lit(0.5))))
    pattern = F.lower(F.trim("pattern"))
    first = F.nullif(F.trim(F.coalesce("first_txn_id", F.lit(""))), F.lit(""))
    ids = F.filter(F.coalesce("txn_ids", none), lambda t: F.trim(t) != "")
    df = df.withColumns({"probability": p, "pattern": F.when(legit, "none").when(pattern.isin(*PATTERNS), pattern).when(p >= 0.70, "undocumented").otherwise("none")})
    df = df.withColumn("txn_ids", F.when(legit, none).when(first.isNotNull() & ~F.array_contains(ids, first), F.concat(F.array(first), ids)).otherwise(ids))
    df = df.withColumn("first_txn_id", F.when(legit, "").otherwise(F.coalesce(first, F.get("txn_ids", F.lit(0)), F.lit(""))))
    sums = df.select("case_id", F.explode(F.array_distinct("txn_ids")).alias("txn_id")).join(txn.select("txn_id", "amt"), "txn_id").groupBy("case_id").agg(F.sum(F.abs(money("amt"))).cast("double").alias("sum"))
    alike = df.select("case_id", F.explode(F.array_distinct("similar")).alias("similar_id")).join(closed.select(F.col("case_id").alias("similar_id")).distinct(), "similar_id", "left_semi").groupBy("case_id").agg(F.collect_list("similar_id").alias("found"))
    df = df.join(sums, "case_id", "left").join(alike, "case_id", "left")
    df = df.withColumn("exposure", F.when(legit, 0.0).when(c("sum") > 0, c("sum")).otherwise(F.coalesce("exposure", F.lit(0.0))))
    ref = lambda e: F.trim(F.coalesce(e["ref"], F.lit("")))
    mended = F.transform("evidence", lambda e: F.concat_ws(" ", F.when(F.lower(F.trim(e["source"])).isin(*SOURCES), F.lower(F.trim(e["source"]))).otherwise("graph"), F.when(ref(e).rlike("^(query|doc|evidence_request):"), ref(e)).otherwise(F.concat(F.lit("query:"), ref(e)))))

    def actions(column: str) -> Column:
        reason = lambda a: F.trim(F.coalesce(a["reason"], F.lit("")))
        cited = lambda a: F.when(reason(a).rlike(RULE), reason(a)).when(reason(a) == "", "Policy 3a").otherwise(F.concat(F.lit("R1: "), reason(a)))
        known = F.filter(column, lambda a: a["action"].isin(*policy.ORDER))
        return F.transform(known, lambda a: F.concat_ws(" ", a["action"], policy.action_route(a["action"], c("exposure")), cited(a)))

    df = df.withColumns({"initial": actions("initial"), "final": actions("final")})
    asked = c("n_requests") > 0
    df = df.withColumn("final", F.when(asked, c("final")).otherwise(c("initial")))
    file = ~legit & F.exists("final", lambda a: a.startswith("FILE_REPORT "))
    unsaid = F.lower(F.trim(F.coalesce("what_changed", F.lit("")))).isin("", "nothing")
    changed = F.when(~asked, "nothing").when(unsaid, F.when(legit, "R3: the customer confirmed").otherwise("R2: the customer denied")).otherwise(F.trim("what_changed"))
    status = F.when(c("verdict") == "fraud", "closed_fraud").when(legit, "closed_legitimate").otherwise("open")
    text = lambda column: F.array_join(column, "; ")
    return df.select(
        "case_id", "verdict", status.alias("status"), "probability", "pattern", joined(F.array_distinct("txn_ids")).alias("txn_ids"), "first_txn_id", "exposure", joined(F.coalesce("found", none)).alias("similar"), text(mended).alias("evidence"),
        text("initial").alias("initial"), text("final").alias("final"), changed.alias("what_changed"), file.alias("file"), F.when(file, c("exposure")).otherwise(0.0).alias("total"), F.when(file, joined(c("dates"))).otherwise("").alias("dates"), F.when(file, joined(F.filter("subjects", lambda s: F.instr("narrative", s) > 0))).otherwise("").alias("subjects"),
    )
