"""The fraud policy as column expressions: actions, routes, filing and verdicts of all cases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The policy's actions in order of execution, and their approval route.
ORDER = {
    "DECLINE_TRANSACTION": 10, "ALLOW_TRANSACTION": 15, "STEP_UP_AUTH": 20, "VERIFY_WITH_CUSTOMER": 25, "WARN_CUSTOMER": 30, "CREATE_CASE": 40, "BLOCK_CARD": 50,
    "BLOCK_ALL_CARDS": 60, "MONITOR_CARD": 70, "MONITOR_CONNECTED_CARDS": 80, "FILE_REPORT": 90, "ESCALATE_TO_ANALYST": 100, "GENERATE_REPORT": 110, "CLOSE_NO_FRAUD": 120,
}
ROUTE = {"DECLINE_TRANSACTION": "L1", "BLOCK_ALL_CARDS": "L2", "FILE_REPORT": "L2"}
BLOCK_LIMIT = 2500.0
SAR_LIMIT = 1000.0


def action_route(action: Column, exposure: Column) -> Column:
    """auto, L1 or L2; null for an unknown action."""
    route = F.when(action == "BLOCK_CARD", F.when(exposure <= BLOCK_LIMIT, "L1").otherwise("L2"))
    for name in ORDER:
        if name != "BLOCK_CARD":
            route = route.when(action == name, ROUTE.get(name, "auto"))
    return route


def normalize_response(response: Column) -> Column:
    r = F.lower(F.trim(response))
    return F.when(r.isin("confirms", "confirmed"), "confirms").when(r.isin("denies", "denied"), "denies").when(r.isin("no_reply", "no-reply", "noreply"), "no_reply").otherwise("none")


def normalize_origin(origin: Column) -> Column:
    o = F.lower(F.trim(origin))
    return F.when(~o.isin("none", "null", ""), o)


#: An assessment's columns and what they are where missing.
DEFAULTS = {
    "pattern": "none", "exposure_usd": 0.0, "customer_response": "none", "shared_origin": None, "evidence_conflict": False, "recurring_match": False, "cards_confirmed_fraud_count": 0,
    "credentials_compromised": False, "pending_auths": False, "single_signal": False, "has_cleared_over_100": False, "requesting_evidence": False, "is_dispute": False, "connected_cards_count": 0,
}


def complete(assessments: DataFrame) -> DataFrame:
    """Assessments with every column, nulls as by DEFAULTS, response and origin normalised."""
    columns = {}
    for name, default in DEFAULTS.items():
        given = F.col(name) if name in assessments.columns else F.lit(None)
        columns[name] = given.cast("string") if default is None else F.coalesce(given.cast({str: "string", float: "double", bool: "boolean", int: "int"}[type(default)]), F.lit(default))
    columns["customer_response"] = normalize_response(columns["customer_response"])
    columns["shared_origin"] = normalize_origin(columns["shared_origin"])
    columns["pattern"] = F.trim(columns["pattern"])
    return assessments.withColumns(columns)


def files_report(exposure: Column, origin: Column, connected: Column, pattern: Column) -> Column:
    return (exposure >= SAR_LIMIT) | F.coalesce(origin.isin("device", "region", "email"), F.lit(False)) | (connected >= 2) | (pattern == "undocumented")


def evaluate(assessments: DataFrame) -> DataFrame:
    """``assessments`` with ``actions``: an array of (order, action, route, rule) in order of execution, an action once, by the first rule that gives it.

    Rules that stop come first (R7, R3, R4); escalation (R8) and card testing (R5) add and go on; weak signals
    (R1) stop; then containment (R2, R6, R9, R10, 3a); what is left gets the fallback.
    """
    df = complete(assessments)
    p, x, resp, pattern, origin = (F.col(c) for c in ("probability", "exposure_usd", "customer_response", "pattern", "shared_origin"))
    flag = F.col
    testing, undocumented, asked = pattern == "card_testing", pattern == "undocumented", resp == "none"
    linked = origin.isNotNull() | (flag("connected_cards_count") >= 2)
    # stages are columns of their own, so that their conditions are evaluated once
    stop = F.when(flag("recurring_match") & ((resp == "denies") | flag("is_dispute")), "r7").when(resp == "confirms", "r3").when(resp == "no_reply", "r4")
    stop = stop.when((flag("single_signal") | (p < 0.70)) & asked & ~testing, "r1").otherwise("go")
    df = df.withColumns({"_stop": stop, "_hard": flag("has_cleared_over_100") | (x > 100) | (resp == "denies")})
    at = F.col("_stop")
    r7, r3, r4, r1, go, hard = at == "r7", at == "r3", at == "r4", at == "r1", at == "go", F.col("_hard")
    escalated = at.isin("r1", "go") & (flag("evidence_conflict") | ((p > 0.15) & (p < 0.70) & (x > 500) & asked))
    df = df.withColumns({"_r8": escalated, "_r5": go & testing, "_block": go & ((resp == "denies") | (p >= 0.70) | undocumented | testing)})
    r8, r5, block = F.col("_r8"), F.col("_r5"), F.col("_block")
    weak_case = (p >= 0.30) | flag("requesting_evidence") | flag("is_dispute")
    has_case = r8 & (p >= 0.30)
    fallback = go & ~block & ~r8 & ~r5
    given = [
        (r7, "CREATE_CASE", "R7"), (r7, "VERIFY_WITH_CUSTOMER", "R7"), (r7, "WARN_CUSTOMER", "R7"),
        (r3, "CLOSE_NO_FRAUD", "R3"),
        (r4 & ((p >= 0.30) | (x > 500) | flag("requesting_evidence")), "CREATE_CASE", "R4"), (r4, "MONITOR_CARD", "R4"), (r4, "DECLINE_TRANSACTION", "R4"), (r4 & ((x > 500) | flag("evidence_conflict")), "ESCALATE_TO_ANALYST", "R4"),
        (has_case, "CREATE_CASE", "R8"), (r8, "ESCALATE_TO_ANALYST", "R8"),
        (r5, "DECLINE_TRANSACTION", "R5"), (r5, "CREATE_CASE", "R5"), (r5 & hard, "BLOCK_CARD", "R5"), (r5 & ~hard, "STEP_UP_AUTH", "R5"),
        (r1 & weak_case, "CREATE_CASE", "R1"), (r1, "STEP_UP_AUTH", "R1"), (r1, "VERIFY_WITH_CUSTOMER", "R1"), (r1 & (p < 0.15) & ~weak_case & ~has_case, "ALLOW_TRANSACTION", "R1"),
        (block, "CREATE_CASE", "3a"), (block & flag("pending_auths"), "DECLINE_TRANSACTION", "R2"), (block & ~(testing & ~hard), "BLOCK_CARD", "R2"),
        (block & ((flag("cards_confirmed_fraud_count") >= 2) | flag("credentials_compromised")), "BLOCK_ALL_CARDS", "R10"),
        (block & files_report(x, origin, flag("connected_cards_count"), pattern), "FILE_REPORT", "3a"), (block & linked, "MONITOR_CONNECTED_CARDS", "R6"), (block & undocumented, "ESCALATE_TO_ANALYST", "R9"),
        (fallback & (p >= 0.30), "CREATE_CASE", "R1"), (fallback & (p >= 0.30), "VERIFY_WITH_CUSTOMER", "R1"), (fallback & (p < 0.30), "ALLOW_TRANSACTION", "R1"),
    ]
    entries = [F.when(c, F.struct(F.lit(ORDER[a]).alias("order"), F.lit(i).alias("at"), F.lit(a).alias("action"), action_route(F.lit(a), x).alias("route"), F.lit(rule).alias("rule"))) for i, (c, a, rule) in enumerate(given)]
    df = df.withColumn("_given", F.array_sort(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    given_ = F.col("_given")
    once = F.filter(given_, lambda e, i: (i == 0) | (F.try_element_at(given_, F.greatest(i, F.lit(1)))["action"] != e["action"]))
    df = df.withColumn("actions", F.transform(once, lambda e: F.struct(e["order"].alias("order"), e["action"].alias("action"), e["route"].alias("route"), e["rule"].alias("rule"))))
    return df.drop("_stop", "_hard", "_r8", "_r5", "_block", "_given")


def action_names(actions: str | Column = "actions") -> Column:
    return F.array_join(F.transform(actions, lambda a: a["action"]), ",")


def initial_and_final(assessments: DataFrame) -> DataFrame:
    """Actions before and after the customer's response, and what changed between them."""
    keep = [c for c in assessments.columns]
    first = evaluate(assessments.withColumn("customer_response", F.lit("none"))).select(F.col("case_id"), F.transform("actions", lambda a: a["action"]).alias("initial"))
    last = evaluate(assessments).select(*keep, F.transform("actions", lambda a: a["action"]).alias("final"))
    met = last.join(first, "case_id")
    added, dropped = F.array_except("final", "initial"), F.array_except("initial", "final")
    change = F.concat_ws("; ", F.when(F.size(added) > 0, F.concat(F.lit("added "), F.array_join(added, ","))), F.when(F.size(dropped) > 0, F.concat(F.lit("dropped "), F.array_join(dropped, ","))))
    return met.select("case_id", F.array_join("initial", ",").alias("initial"), F.array_join("final", ",").alias("final"), F.when(change == "", "no change").otherwise(change).alias("what_changed"))


def sar_decision(assessments: DataFrame) -> DataFrame:
    """Whether a report is filed, and why."""
    df = complete(assessments)
    x, origin, n, pattern = (F.col(c) for c in ("exposure_usd", "shared_origin", "connected_cards_count", "pattern"))
    reasons = F.concat_ws("; and ", F.when(x >= SAR_LIMIT, "exposure reaches the filing limit"), F.when(origin.isNotNull() | (n >= 2), "origin shared with other cards"), F.when(pattern == "undocumented", "undocumented pattern"))
    return df.select("case_id", files_report(x, origin, n, pattern).alias("file"), reasons.alias("reason"))


def posterior(risk: Column, response: Column) -> Column:
    """Probability after the response: lowered by a confirmation, raised by a denial, middling without reply. Hundredths, ties up."""
    hundredths = lambda c: F.floor(c * 100 + F.lit(0.5)) / 100
    yes = hundredths(F.greatest(F.lit(0.18), F.least(F.lit(0.32), F.coalesce(risk, F.lit(0.5)) * 0.25 + 0.12)))
    no = hundredths(F.least(F.lit(0.95), F.greatest(F.lit(0.78), F.coalesce(risk, F.lit(0.7)) * 0.20 + 0.72)))
    return F.when(response == "confirms", yes).when(response == "denies", no).otherwise(0.58)


def verdict(response: Column) -> Column:
    return F.when(response == "confirms", "legitimate").when(response == "denies", "fraud").otherwise("uncertain")


def status(response: Column) -> Column:
    return F.when(response == "confirms", "closed_legitimate").when(response == "denies", "closed_fraud").otherwise("open")


def evidence_request_type(trigger: Column, pattern: Column) -> Column:
    return F.when(trigger == "analyst_request", "analyst_info").when(pattern == "card_testing", "step_up_auth").otherwise("customer_validation")


def needs_evidence(p: Column, asked: Column, recurring: Column, rounds: Column, most: int = 2) -> Column:
    return (rounds < most) & (asked | recurring | ((p > 0.15) & (p < 0.85)))


def stop_reason(p: Column, evidence: Column, response: Column) -> Column:
    return (
        F.when(response.isin("confirms", "denies"), "response settled the question")
        .when(((p >= 0.85) | (p <= 0.15)) & (evidence >= 2), "evidence is decisive")
        .when(response == "no_reply", "no reply within the window")
        .otherwise("open")
    )


def approval_queue(evaluated: DataFrame) -> DataFrame:
    """Actions that wait for a person: one row per case and action with route L1 or L2."""
    waiting = F.filter("actions", lambda a: a["route"] != "auto")
    return evaluated.select("case_id", F.explode(waiting).alias("a")).select("case_id", F.col("a.action").alias("action"), F.col("a.route").alias("route"))


def disagreements(evaluated: DataFrame, closed: DataFrame) -> DataFrame:
    """Cases whose recorded actions (bar-separated) or filing differ from the recommended ones, with what either has alone. A case without recorded actions has none."""
    took = F.filter(F.split(F.coalesce("actions_taken", F.lit("")), "\\|"), lambda a: a != "")
    met = evaluated.select("case_id", "probability", F.transform("actions", lambda a: a["action"]).alias("names")).join(closed.select("case_id", "outcome", took.alias("took"), "report_filed"), "case_id")
    only = {"not_recommended": F.array_except("took", "names"), "not_recorded": F.array_except("names", "took")}
    filing = F.array_contains("names", "FILE_REPORT") != F.coalesce(F.col("report_filed") == "Yes", F.lit(False))
    met = met.withColumns(only | {"filing_differs": filing}).where((F.size("not_recommended") > 0) | (F.size("not_recorded") > 0) | F.col("filing_differs"))
    return met.select("case_id", "outcome", "probability", *(F.array_join(c, ",").alias(c) for c in only), "filing_differs")


def policy_agreement(evaluated: DataFrame, closed: DataFrame) -> DataFrame:
    """Recommended against recorded actions (bar-separated) and filing, per outcome."""
    took = F.split("actions_taken", "\\|")
    names = F.transform("actions", lambda a: a["action"])
    met = evaluated.select("case_id", names.alias("names")).join(closed.select("case_id", "outcome", "actions_taken", "report_filed"), "case_id")
    same = F.size(F.array_except(took, "names")) == 0
    filing = F.array_contains("names", "FILE_REPORT") == (F.col("report_filed") == "Yes")
    return met.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(same).alias("actions_agree"), F.count_if(filing).alias("filing_agrees"))
