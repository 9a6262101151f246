"""The investigation of all alerts at once: evidence with its claims, assessment, actions before and after the customer's response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgraph.functions.expressions import money, total
from riskgraph.functions.params import CardTesting, Ring
from riskgraph.operators import cards, evaluate, graph, memory, network, policy

#: Patterns in order of preference, and the feature that scores each.
PATTERN_SCORES = {"card_testing": "conf_testing", "card_not_present_new_device": "conf_new_device", "out_of_region_use": "conf_region", "account_takeover": "conf_ato", "card_not_present_fraud": "conf_burst"}


def _text(*parts: str | Column) -> Column:
    """Text put together from literals and columns."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def evidence_items(alerts: DataFrame, txn: DataFrame, identity: DataFrame, closed: DataFrame, connected: DataFrame, testing: CardTesting = CardTesting(), ring: Ring = Ring(), least: float = 0.70, listed: int = 5) -> DataFrame:
    """One row per alert and claim: ``case_id``, ``detector``, ``confidence``, ``n`` (what the claim counts), ``claim``, ``source``, ``ref``, ``entity_ids``.

    The card's baseline comes with every alert (no confidence). Each detector that reaches ``least`` makes a claim, so do
    other cards on the flagged device and prior cases. A ring's claim names its device and their number, as a device may have
    any number of cards (``network.connected_cards`` lists them all); of prior cases the first ``listed`` by id are named.
    """
    alerts = network.checkpointed(alerts.select("case_id", "card_id", "flagged_txn_id", "customer_id"))  # every claim reads it, as it does the devices and a card's profile
    identity = network.checkpointed(graph.keyed(identity.select("txn_id", *graph.DEVICE_PARTS, "id_15", "id_23")).select("txn_id", "device", "id_15", "id_23"))
    # windows only over cards that have an alert, and kept only where an alert can ask for them: at flagged transactions, or in person where none is flagged
    asked = alerts.groupBy("card_id").agg(F.bool_or(F.col("flagged_txn_id").isNull()).alias("open"))
    flags = alerts.where("flagged_txn_id IS NOT NULL").select(F.col("flagged_txn_id").alias("txn_id")).distinct().withColumn("flag", F.lit(True))
    marked = txn.join(flags, "txn_id", "left").join(asked, "card_id", "left")
    anchor = F.coalesce("flag", F.lit(False)) | (F.col("open") & (F.col("channel") == "in_person"))
    marked = network.checkpointed(marked.where("open IS NOT NULL OR flag").withColumn("anchor", anchor).drop("flag"))
    own = marked.where("open IS NOT NULL").drop("open")
    profiles = network.checkpointed(cards.profile(own))
    key = alerts.select("case_id", "card_id", "flagged_txn_id", "customer_id")
    card, flagged, customer = F.col("card_id"), F.col("flagged_txn_id"), F.col("customer_id")
    n = F.col
    two = lambda c: money(F.floor(F.col(c) * 100 + F.lit(0.5)) / 100)

    def claims(df: DataFrame, detector: str, query: str, count: Column, ids: list, claim: Column, confidence: Column | None = None) -> DataFrame:
        c = n("confidence") if confidence is None else confidence
        argument = ("txn_id=", flagged) if detector == "new_device" else ("device=", n("device")) if detector == "ring" else ("card_id=", card)
        return df.select("case_id", F.lit(detector).alias("detector"), c.cast("double").alias("confidence"), count.cast("bigint").alias("n"), claim.alias("claim"), F.lit("graph").alias("source"), _text(f"query:{query}(", *argument, ")").alias("ref"), F.concat_ws(",", *ids).alias("entity_ids"))

    usual = key.join(cards.rounded_profile(profiles), "card_id")
    probes = key.join(cards.card_testing(own, testing), "card_id").where(n("confidence") >= least)
    burst = key.drop("card_id").join(cards.cnp_burst(own, alerts, profiles=profiles), "case_id").where(n("confidence") >= least)
    devices = network.checkpointed(key.join(cards.new_device(marked.where("anchor"), identity).withColumnRenamed("txn_id", "flagged_txn_id"), "flagged_txn_id"))  # read by two claims
    fresh = devices.where(n("confidence") >= least)
    region = key.join(cards.region_anomaly(own, alerts), "case_id").where(n("confidence") >= least)
    takeover = key.join(cards.account_takeover(own, alerts, profiles=profiles), "case_id").where(n("confidence") >= least)
    uses = network.device_uses(txn, identity).join(devices.where("device <> 'unknown'").select("device").distinct(), "device", "left_semi")
    owners = uses.select("device", "card_id").distinct().groupBy("device").agg((F.count("*") - 1).alias("others"))
    rings = devices.join(owners, "device").where("others > 0")
    closed = network.checkpointed(closed.select("case_id", "card_id", "outcome"))
    prior = key.join(memory.case_memory_lookup(alerts, closed, connected, txn), "case_id").where("prior_cases IS NOT NULL AND prior_cases <> ''")
    named = F.slice(F.split("prior_cases", ","), 1, listed)
    parts = [
        claims(usual, "baseline", "card_baseline", n("n"), [card, customer], _text("Card ", card, " has ", n("n"), " transactions with a median of ", two("median"), " and a mean of ", two("mean"), "."), F.lit(None)),
        claims(probes, "testing", "detect_card_testing", n("probe_count"), [card, n("large_txn_id")], _text(n("probe_count"), " small authorisations on card ", card, " came before purchase ", n("large_txn_id"), ", ", two("exposure"), " in all.")),
        claims(burst, "burst", "detect_cnp_burst", n("burst_count"), [flagged, card], _text(n("burst_count"), " online transactions of card ", card, " stand around the flagged one, ", two("exposure"), " in all.")),
        claims(fresh, "new_device", "detect_new_device", F.lit(1), [flagged], _text("Transaction ", flagged, " came from a device new to the account", F.when(n("is_proxy"), ", behind a proxy.").otherwise("."))),
        claims(region, "region", "detect_region_anomaly", n("concurrent_home"), [flagged, card], _text("The purchase in region ", n("region"), " is the card's first there, with ", n("concurrent_home"), " in its home region ", n("home_region"), " at that time.")),
        claims(takeover, "takeover", "detect_account_takeover", n("mismatches"), [flagged, card], _text(n("mismatches"), " match flags of transaction ", flagged, " disagree; the card has ", n("in_person"), " purchases in person and ", n("online"), " online.")),
        claims(rings, "ring", "device_neighbors", n("others"), [n("device")], _text("Device ", n("device"), " is shared with ", n("others"), " other cards."), F.when(n("others") >= 2, ring.three).otherwise(ring.two)),
        claims(prior, "memory", "case_memory_lookup", F.size(F.split("prior_cases", ",")), [named], _text("The account has ", F.size(F.split("prior_cases", ",")), " prior cases, ", n("confirmed"), " of them confirmed fraud.")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assess(alerts: DataFrame, txn: DataFrame, evidence: DataFrame, scored: DataFrame) -> DataFrame:
    """What is known of each alert before anyone is asked.

    ``scored`` has the features of each case and its ``probability``. Exposure is the flagged amount, or, where probability
    and burst are both at 0.70 or more, the amount of the burst if it is larger. Other cards count for alerts that an analyst
    raised, whose origin is their shared device. A recurring charge is told by the alert's ``trigger_text``, if there is one.
    """
    pattern = evaluate.classify_pattern(F.col("probability"), {k: F.col(c) for k, c in PATTERN_SCORES.items()}, least=0.60)
    known = alerts.join(scored.select("case_id", "probability", "flagged_amount", pattern.alias("pattern"), (F.col("has_corroborated_pattern") == 0).alias("single_signal"), (F.col("flagged_amount") > 100).alias("has_cleared_over_100")), "case_id")
    bursts = evidence.where("detector = 'burst'").select("case_id", "confidence").join(scored.select("case_id", "probability"), "case_id")
    affected = memory.affected_transactions(alerts, txn, bursts).join(txn.select("txn_id", "amt"), "txn_id").groupBy("case_id").agg(F.count("*").cast("int").alias("n_affected"), total("amt").alias("sum"))
    found = evidence.groupBy("case_id").agg(F.count("*").alias("n_evidence"), F.array_join(F.array_sort(F.collect_list("detector")), ",").alias("detectors"), F.max("confidence").alias("top_confidence"), F.max(F.when(F.col("detector") == "ring", F.col("n"))).cast("int").alias("others"))
    recurring = cards.mentions_recurring(F.col("trigger_text")) if "trigger_text" in alerts.columns else F.lit(False)
    raised = F.col("trigger_type") == "analyst_request"
    met = known.join(affected, "case_id", "left").join(found, "case_id", "left")
    return met.withColumns({
        "exposure_usd": F.greatest("flagged_amount", F.coalesce("sum", F.lit(0.0))), "shared_origin": F.when(raised, "device"), "connected_cards_count": F.when(raised, F.coalesce("others", F.lit(0))).otherwise(0),
        "recurring_match": recurring, "n_evidence": F.coalesce("n_evidence", F.lit(0)), "detectors": F.coalesce("detectors", F.lit("")),
    }).drop("sum", "others", "flagged_amount")


def decide(assessed: DataFrame) -> DataFrame:
    """Actions before the response, whether and how the customer is asked, and what follows the response.

    ``assessed`` has case_id, trigger_type, customer_response, risk_score, probability, pattern, exposure_usd, single_signal,
    has_cleared_over_100, shared_origin, connected_cards_count, recurring_match and n_evidence. Where nobody needs to be asked,
    the first actions stand, and the verdict is fraud from 0.70, legitimate below 0.30 and else uncertain.
    """
    names = lambda c: F.transform(c, lambda a: a["action"])
    given = assessed.withColumnRenamed("customer_response", "__reply")
    first = policy.evaluate(given.withColumn("customer_response", F.lit("none"))).withColumnsRenamed({"actions": "initial", "probability": "prior", "pattern": "first_pattern", "exposure_usd": "first_exposure"})
    p = F.col("prior")
    asked = F.array_contains(names("initial"), "VERIFY_WITH_CUSTOMER") | F.array_contains(names("initial"), "STEP_UP_AUTH") | F.col("recurring_match") | ((p > 0.15) & (p < 0.85))
    first = first.withColumn("asked", asked)
    reply = F.when(F.col("asked"), policy.normalize_response(F.col("__reply"))).otherwise("none")
    yes = F.col("customer_response") == "confirms"
    second = first.withColumn("customer_response", reply).withColumns({
        "probability": F.when(F.col("asked"), policy.posterior(F.col("risk_score"), F.col("customer_response"))).otherwise(p), "pattern": F.when(yes, "none").otherwise(F.col("first_pattern")),
        "exposure_usd": F.when(yes, 0.0).otherwise(F.col("first_exposure")), "single_signal": F.lit(False), "has_cleared_over_100": F.lit(False), "cards_confirmed_fraud_count": (F.col("customer_response") == "denies").cast("int"),
    })
    last = policy.evaluate(second)
    order = policy.ORDER["MONITOR_CONNECTED_CARDS"]
    watch = F.struct(F.lit(order).alias("order"), F.lit("MONITOR_CONNECTED_CARDS").alias("action"), F.lit("auto").alias("route"), F.lit("R6").alias("rule"))
    watched = F.when(F.col("shared_origin").isNotNull() & ~F.array_contains(names("actions"), "MONITOR_CONNECTED_CARDS"), F.array_sort(F.concat("actions", F.array(watch)))).otherwise(F.col("actions"))
    last = last.withColumn("final", F.when(F.col("asked"), watched).otherwise(F.col("initial")))
    alone = F.when(p >= 0.70, "fraud").when(p < 0.30, "legitimate").otherwise("uncertain")
    verdict = F.when(F.col("asked"), policy.verdict(F.col("customer_response"))).otherwise(alone)
    out = last.withColumns({"verdict": verdict, "changed": names("initial") != names("final")})
    status = F.when(F.col("verdict") == "fraud", "closed_fraud").when(F.col("verdict") == "legitimate", "closed_legitimate").otherwise("open")
    request = F.when(F.col("asked"), policy.evidence_request_type(F.col("trigger_type"), F.col("first_pattern")))
    return out.withColumns({
        "status": status, "request": request, "initial_actions": policy.action_names("initial"), "final_actions": policy.action_names("final"), "file": F.array_contains(names("final"), "FILE_REPORT"),
        "stop_reason": policy.stop_reason(p, F.col("n_evidence"), F.col("customer_response")),
    })


#: What ``investigate`` returns of each alert.
COLUMNS = "case_id n_evidence detectors top_confidence prior first_pattern first_exposure n_affected initial_actions request probability pattern exposure_usd verdict status final_actions changed file stop_reason".split()


def investigate(alerts: DataFrame, txn: DataFrame, evidence: DataFrame, scored: DataFrame) -> DataFrame:
    """Every alert in one pass, a row each: ``COLUMNS``."""
    return decide(assess(alerts, txn, evidence, scored)).select(*COLUMNS)
