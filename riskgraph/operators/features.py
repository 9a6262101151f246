"""Point-in-time features of a case, without looking past its opening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.functions.expressions import money, r4, seconds
from riskgraph.operators.cards import mismatches


def _hours(h: int) -> Column:
    return F.col("ts") >= F.expr(f"opened_at - interval '{h}' hour")


TARGET = ("txn_id", "ts", "amt", "risk_score", "channel", "addr1", "m1", "m4", "m6")


def _met(cases: DataFrame, txn: DataFrame) -> DataFrame:
    """Each case (case_id, card_id, flagged_txn_id, opened_at) with its card's transactions up to its opening, its flagged one and its card's first ones; ``known``: by the opening."""
    first = txn.groupBy("card_id").agg(F.min("ts").alias("first_ts"))
    asked = cases.select("case_id", "card_id", "flagged_txn_id", "opened_at").join(first, "card_id")
    met = asked.join(txn.select("card_id", *TARGET), "card_id").withColumn("flagged", F.coalesce(F.col("txn_id") == F.col("flagged_txn_id"), F.lit(False)))
    met = met.where((F.col("ts") <= F.greatest("opened_at", "first_ts")) | F.col("flagged"))
    return met.withColumn("known", F.coalesce(F.col("ts") <= F.col("opened_at"), F.lit(False)))


def _aimed(met: DataFrame) -> DataFrame:
    w = Window.partitionBy("case_id")
    last = F.max(F.when(F.col("known"), F.struct(F.col("flagged").alias("f"), *(F.col(c) for c in ("ts", "txn_id", *TARGET[2:])))))
    early = F.min(F.when(~F.col("known"), F.struct((~F.col("flagged")).alias("f"), *(F.col(c) for c in ("ts", "txn_id", *TARGET[2:])))))
    met = met.withColumns({"last": last.over(w), "early": early.over(w)})
    met = met.where(F.col("known") | (F.col("last").isNull() & (F.col("txn_id") == F.col("early.txn_id"))))
    met = met.withColumn("t", F.coalesce("last", "early")).drop("last", "early", "flagged")
    return met.select("*", *(F.col(f"t.{c}").alias(f"t_{c}") for c in TARGET), (F.col("ts") < F.col("t.ts")).alias("prior")).drop("t")


def history(cases: DataFrame, txn: DataFrame) -> DataFrame:
    """Each case with every transaction of its card up to its opening, the target's values (t_*) and ``prior``: strictly before the target.

    The target is the flagged transaction, where it is known by then, else the last known one. A case whose card has none by
    then gets the flagged transaction, else the card's first one. Cases whose card has no transaction with a time have no row.
    """
    return _aimed(_met(cases, txn))


def _stats(home: Column) -> dict[str, Column]:
    prior, n = F.col("prior"), F.count_if(F.col("prior"))
    q = F.percentile(F.when(prior, F.col("amt")), F.array(F.lit(0.75), F.lit(0.95)))
    share = lambda c: F.coalesce(F.try_divide(F.count_if(prior & (F.col("channel") == c)), n), F.max((F.col("t_channel") == c).cast("double")))
    return {
        "prior_txns_count": n,
        "prior_mean": F.coalesce(F.try_divide(F.sum(F.when(prior, money("amt"))).cast("double"), n), F.max("t_amt")),
        "prior_p75": F.coalesce(q[0], F.max("t_amt")),
        "prior_p95": F.coalesce(q[1], F.max("t_amt")),
        "prior_in_person_pct": share("in_person"),
        "prior_online_pct": share("online"),
        "prior_in_region": F.count_if(prior & (F.col("addr1") == F.col("t_addr1"))),
        "home_region": F.when(n == 0, F.max("t_addr1")).otherwise(home),
    }


def _home() -> Column:
    """The prior rows' most frequent region, the smallest of equals."""
    return F.mode(F.when(F.col("prior"), F.col("addr1")), True)


def _speed() -> dict[str, Column]:
    online = _hours(48) & (F.col("channel") == "online")
    return {
        "txns_24h": F.count_if(_hours(24)),
        "txns_48h": F.count_if(_hours(48)),
        "online_48h": F.count_if(online),
        "exposure_48h": F.coalesce(F.sum(F.when(_hours(48), money("amt"))).cast("double"), F.lit(0.0)),
        "channels_48h": F.size(F.collect_set(F.when(_hours(48), F.col("channel")))),
        "largest_online_48h": F.max(F.when(online, F.col("amt"))),
    }


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def history_stats(rows: DataFrame) -> DataFrame:
    """Per case over the prior rows: number, mean, p75, p95, channel shares, home region and visits of the target's region."""
    return rows.groupBy("case_id").agg(*_named(_stats(_home())))


def velocity(rows: DataFrame) -> DataFrame:
    """Per case: transactions of the last 24 and 48 hours before it opened, online ones and the amount."""
    return rows.groupBy("case_id").agg(*_named(_speed()))


def _testing(met: DataFrame, max_auth: float = 5.0, large: float = 50.0, minutes: int = 60) -> DataFrame:
    """``score``: the confidence of card testing at each probe that a large purchase follows, null elsewhere; of a case's several runs the last one counts.

    One sort from the last transaction to the first: probes are counted from the end, and the next large purchase is the one seen last.
    """
    back = Window.partitionBy("case_id").orderBy(F.desc("ts"), F.desc("txn_id"))
    online = F.col("known") & (F.col("channel") == "online")
    probe = online & (F.col("amt") <= max_auth)
    met = met.withColumn("later", F.sum(probe.cast("long")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    big = F.when(online & (F.col("amt") > max_auth) & (F.col("amt") >= large), F.struct("ts", "amt", "later"))
    met = met.withColumn("next", F.last(big, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    run = F.col("later") - F.col("next.later")
    hit = probe & (F.col("next.ts") <= F.expr(f"ts + interval '{minutes}' minute")) & (run >= 2)
    score = F.when(run >= 3, F.when(F.col("next.amt") > 100, 0.94).otherwise(0.86)).otherwise(0.72)
    return met.withColumn("score", F.when(hit, score)).drop("later", "next")


def prior_case_rate(cases: DataFrame, closed: DataFrame) -> DataFrame:
    """Per case the closed cases of its card that opened strictly earlier, and the share of fraud among them (0.50 without any)."""
    met = cases.select("case_id", "card_id", "opened_at").join(closed.select("card_id", F.col("opened_at").alias("earlier"), "outcome"), "card_id").where("earlier < opened_at")
    n = met.groupBy("case_id").agg(F.count("*").alias("prior_cases_count"), (F.count_if(F.col("outcome") == "confirmed_fraud") / F.count("*")).alias("prior_fraud_rate"))
    return cases.select("case_id").join(n, "case_id", "left").fillna(0, ["prior_cases_count"]).fillna(0.5, ["prior_fraud_rate"])


def case_features(cases: DataFrame, txn: DataFrame, identity: DataFrame, closed: DataFrame, max_auth: float = 5.0, large: float = 50.0, minutes: int = 60) -> DataFrame:
    """The 29 features per case. Cases whose card has no transaction at all have the defaults of an empty history.

    One join by card and one exchange by case, over which all frames and sums are taken.
    """
    rows = _aimed(_testing(_met(cases, txn), max_auth, large, minutes)).withColumn("home", _home().over(Window.partitionBy("case_id")))
    close = F.col("ts").between(F.expr("t_ts - interval '48' hour"), F.expr("t_ts + interval '48' hour"))
    around = lambda home: F.count_if((F.col("addr1") == F.col(home)) & (F.col("txn_id") != F.col("flagged_txn_id")) & close)
    target = {c: F.any_value(f"t_{c}") for c in TARGET[2:]}
    known = rows.groupBy("case_id").agg(
        *_named(_stats(F.max("home"))),
        *_named(_speed()),
        *_named({"flagged_risk_score": target["risk_score"], "flagged_amount": target["amt"], "channel": target["channel"], "addr1": target["addr1"], "m1": target["m1"], "m4": target["m4"], "m6": target["m6"]}),
        F.when(F.count_if("prior") == 0, around("t_addr1")).otherwise(around("home")).alias("concurrent_home_count"),
        F.max_by("score", F.when(F.col("score").isNotNull(), F.struct("ts", "txn_id"))).alias("conf_testing"),
    )
    known = known.withColumn("mismatch_count", mismatches(("M0", "M2", "F"))).drop("m1", "m4", "m6")
    seen = identity.select(F.col("txn_id").alias("flagged_txn_id"), "id_15", "id_23", F.lit(1).alias("has_device"))
    out = cases.select("case_id", "flagged_txn_id").join(known, "case_id", "left").join(seen, "flagged_txn_id", "left").join(prior_case_rate(cases, closed), "case_id", "left")
    out = out.fillna({"flagged_risk_score": 0.5, "flagged_amount": 50.0, "channel": "in_person", "has_device": 0, "mismatch_count": 0, "prior_txns_count": 0, "concurrent_home_count": 0, "conf_testing": 0.05, "txns_24h": 0, "txns_48h": 0, "online_48h": 0, "exposure_48h": 0.0, "channels_48h": 0, "prior_in_region": 0})
    online, flag = F.col("channel") == "online", lambda c: F.coalesce(c, F.lit(False)).cast("int")
    amount = F.col("flagged_amount")
    out = out.withColumns({
        "flagged_is_online": flag(online),
        "flagged_is_in_person": flag(F.col("channel") == "in_person"),
        "is_new_device": flag(F.col("id_15") == "New"),
        "is_proxy": flag(F.lower("id_23").contains("proxy")),
        "is_new_region": flag((F.col("prior_in_region") == 0) & F.col("addr1").isNotNull() & (F.col("channel") == "in_person")),
        "amount_to_mean_ratio": amount / (F.coalesce("prior_mean", amount) + F.lit(0.001)),
        "amount_to_p75_ratio": amount / (F.coalesce("prior_p75", amount) + F.lit(0.001)),
        "prior_in_person_pct": F.coalesce("prior_in_person_pct", (~online).cast("double")),
        "prior_online_pct": F.coalesce("prior_online_pct", online.cast("double")),
    })
    n, many, off = F.col("online_48h"), F.col("channels_48h") > 1, F.col("mismatch_count")
    out = out.withColumns({
        "conf_burst": F.when((n >= 2) & (n <= 6), F.when(F.col("largest_online_48h") > F.coalesce("prior_p75", amount), 0.85).otherwise(0.72)).when(n == 1, 0.45).otherwise(0.20),
        "conf_new_device": F.when(F.col("is_new_device") == 1, F.when(F.col("is_proxy") == 1, 0.90).otherwise(0.82)).when(F.col("id_15") == "Found", 0.25).otherwise(0.10),
        "conf_region": F.when((F.col("is_new_region") == 1) & (F.col("concurrent_home_count") > 0), 0.88).when(F.col("is_new_region") == 1, 0.38).otherwise(0.10),
        "conf_ato": F.when(many & (off >= 1), 0.88).when(many, 0.72).when(off >= 2, 0.75).otherwise(0.15),
    })
    out = out.withColumn("max_graph_pattern", F.greatest("conf_testing", "conf_burst", "conf_new_device", "conf_region", "conf_ato"))
    out = out.withColumn("has_corroborated_pattern", (F.col("max_graph_pattern") >= 0.70).cast("int"))
    out = out.withColumn("lone_risk_score", F.col("flagged_risk_score") * (1 - F.col("has_corroborated_pattern")))
    return out.select("case_id", *FEATURES)


# The names of the model's inputs, in order.
FEATURES = (
    "flagged_risk_score flagged_amount flagged_is_online flagged_is_in_person is_new_device is_proxy has_device mismatch_count is_new_region concurrent_home_count "
    "amount_to_mean_ratio amount_to_p75_ratio prior_txns_count prior_in_person_pct prior_online_pct txns_24h txns_48h online_48h exposure_48h "
    "conf_testing conf_burst conf_new_device conf_region conf_ato max_graph_pattern has_corroborated_pattern lone_risk_score prior_cases_count prior_fraud_rate"
).split()


def rounded(df: DataFrame, columns) -> DataFrame:
    """Doubles to four decimals, for reports."""
    return df.withColumns({c: r4(F.col(c)) for c in columns})


__all__ = ["FEATURES", "case_features", "history", "history_stats", "prior_case_rate", "rounded", "seconds", "velocity"]
