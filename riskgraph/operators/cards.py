"""Per-card baselines, windows and behavioural detectors, for all cards or alerts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.functions.expressions import by_card, joined, money, r4, seconds, total
from riskgraph.functions.params import Burst, CardTesting, NewDevice, Region, Takeover
from riskgraph.operators.graph import device_key, keyed
from riskgraph.operators.quantiles import HOT, with_quantiles

CATEGORIES = {"channel": "channel", "product": "product_cd", "region": "addr1", "email": "p_email"}


def card_window(txn: DataFrame, centers: DataFrame, hours: int = 24) -> DataFrame:
    """Per (card_id, center_ts) of ``centers``: the card's transactions within ``hours`` of the center.

    A null center takes the whole history. The join is by card; the band is a condition within it.
    """
    met = centers.join(txn.select("card_id", "txn_id", "ts", "amt"), "card_id", "left")
    inside = F.col("center_ts").isNull() | F.col("ts").between(F.expr(f"center_ts - interval '{hours}' hour"), F.expr(f"center_ts + interval '{hours}' hour"))
    found = met.groupBy("card_id", "center_ts").agg(
        F.count("txn_id").alias("history"),
        F.count_if(inside & F.col("txn_id").isNotNull()).alias("n_txns"),
        F.coalesce(F.sum(F.when(inside, money("amt"))), F.lit(0)).cast("double").alias("total"),
        joined(F.collect_list(F.when(inside, F.col("txn_id")))).alias("txn_ids"),
    )
    confidence = F.when(F.col("history") == 0, 0.0).when(F.col("n_txns") > 1, 0.50).otherwise(0.10)
    return found.withColumn("confidence", confidence).drop("history")


def profile(txn: DataFrame, key: str = "card_id", hot: int = HOT) -> DataFrame:
    """Per card what several detectors ask of its history, in one pass and unrounded: ``n``, ``mean``, ``median``, quartiles, ``p95`` (linear interpolation), extremes, ``std`` (0 for one), ``in_person`` and ``online`` counts and its ``last`` online transaction (txn_id, amt)."""
    online = F.col("channel") == "online"
    others = [
        F.count("*").alias("n"), (total("amt") / F.count("*")).alias("mean"), F.min("amt").alias("min"), F.max("amt").alias("max"), F.coalesce(F.stddev_samp("amt"), F.lit(0.0)).alias("std"),
        F.count_if(F.col("channel") == "in_person").alias("in_person"), F.count_if(online).alias("online"), F.max_by(F.struct("txn_id", "amt"), F.when(online, F.struct("ts", "txn_id"))).alias("last"),
    ]
    return with_quantiles(txn, key, "amt", WANTED, others, hot)


WANTED = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p95": 0.95}


def rounded_profile(found: DataFrame, key: str = "card_id") -> DataFrame:
    """``profile``'s amounts as ``baseline`` gives them."""
    return found.select(key, "n", r4(F.col("mean")).alias("mean"), *(r4(F.col(c)).alias(c) for c in WANTED), "min", "max", r4(F.col("std")).alias("std"))


def baseline(txn: DataFrame, key: str = "card_id", hot: int = HOT) -> DataFrame:
    """Per card: number, mean, median, quartiles, p95 (linear interpolation), extremes and sample deviation of its amounts (0 for one)."""
    others = [F.count("*").alias("n"), (total("amt") / F.count("*")).alias("mean"), F.min("amt").alias("min"), F.max("amt").alias("max"), F.coalesce(F.stddev_samp("amt"), F.lit(0.0)).alias("std")]
    return rounded_profile(with_quantiles(txn, key, "amt", WANTED, others, hot), key)


def category_counts(txn: DataFrame) -> DataFrame:
    """``card_id``, ``category``, ``value``, ``n``: one scan, with categories unpivoted; empty values are left out."""
    long = txn.select("card_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, CATEGORIES)), F.array(*CATEGORIES.values()))).alias("category", "value"))
    return long.where("value IS NOT NULL").groupBy("card_id", "category", "value").agg(F.count("*").alias("n"))


def category_maps(txn: DataFrame) -> DataFrame:
    """``category_counts`` as a map per card and category."""
    pairs = F.array_sort(F.collect_list(F.struct("value", "n")))
    return category_counts(txn).groupBy("card_id", "category").agg(F.map_from_entries(pairs).alias("counts"))


def home_region(txn: DataFrame) -> DataFrame:
    """A card's most frequent region; of equal ones the first by name."""
    n = txn.where("addr1 IS NOT NULL").groupBy("card_id", "addr1").agg(F.count("*").alias("n"))
    return n.groupBy("card_id").agg(F.min_by("addr1", F.struct(-F.col("n"), F.col("addr1"))).alias("home_region"))


def card_testing(txn: DataFrame, p: CardTesting = CardTesting()) -> DataFrame:
    """Per card: the first run of three or more small online authorisations that a large purchase follows within the window; else a weak hit or none.

    A running count of probes and the next large purchase of each row, both over one sort by
    card, give each probe's run without looking forward: no self join.
    """
    w, back = by_card(), Window.partitionBy("card_id").orderBy(F.desc("ts"), F.desc("txn_id"))
    probe = (F.col("channel") == "online") & (F.col("amt") <= p.max_auth)
    rows = txn.select("card_id", "txn_id", "ts", "amt", probe.alias("probe"), F.row_number().over(w).alias("place"))
    rows = rows.withColumn("large", ~F.col("probe") & (F.col("amt") >= p.large))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"cp": F.sum(F.col("probe").cast("long")).over(running), "spent": F.sum(F.when(F.col("probe"), money("amt")).otherwise(0)).over(running)})
    large = F.when(F.col("large"), F.struct("ts", "txn_id", "amt", "cp", "place", "spent"))
    rows = rows.withColumn("nl", F.last(large, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    within = F.col("nl.ts") <= F.expr(f"ts + interval '{p.window_minutes}' minute")
    run = F.col("probe") & within & (F.col("nl.cp") - F.col("cp") + 1 >= 3)
    start = F.min_by(F.struct("cp", "nl", (F.col("nl.spent") - F.col("spent") + money("amt")).alias("probes_amt")), F.when(run, F.col("place")))
    by = rows.groupBy("card_id").agg(F.count("*").alias("n_txns"), F.sum(F.col("probe").cast("long")).alias("probes"), F.sum(F.when(F.col("probe"), money("amt"))).alias("all_amt"), start.alias("run"))
    hit, weak = F.col("run.nl").isNotNull(), F.col("probes") >= 3
    cleared = F.coalesce(F.col("run.nl.amt") > p.cleared, F.lit(False))
    return by.select(
        "card_id",
        F.when(F.col("n_txns") < 2, 0.0).when(hit & cleared, p.confirmed).when(hit, p.uncleared).when(weak, p.probes_only).otherwise(p.none).alias("confidence"),
        F.when((F.col("n_txns") >= 2) & (hit | weak), "card_testing").otherwise("none").alias("pattern"),
        cleared.alias("cleared_over_100"),
        F.when(hit, F.col("run.nl.cp") - F.col("run.cp") + 1).when(weak, F.col("probes")).otherwise(0).alias("probe_count"),
        F.col("run.nl.txn_id").alias("large_txn_id"),
        F.when(hit, F.col("run.probes_amt") + money(F.col("run.nl.amt"))).when(weak, F.col("all_amt")).otherwise(0).cast("double").alias("exposure"),
    )


HOUR = 3_600_000_000
#: A time bucket's length, in lengths of the window that is computed in it.
WIDE = 8


def spread(df: DataFrame, before: int, after: int) -> DataFrame:
    """``df`` (with ``us``, microseconds) in time buckets: ``bucket``, ``own`` and copies that a window of ``before`` and ``after`` reaches from a neighbouring bucket.

    Windows over (key, bucket) then equal those over the key, and a hot key is worked by as many tasks as it has buckets.
    """
    size = WIDE * max(before, after, 1)
    b = F.floor(F.col("us") / size).cast("long")
    entry = lambda bucket, own: F.struct(bucket.alias("bucket"), F.lit(own).alias("own"))
    reached = lambda other: F.array(entry(b, True), entry(other, False))
    # a bucket is longer than both reaches, so that no row has a copy on either side
    places = F.when(F.col("us") <= b * size + after, reached(b - 1)).when(F.col("us") >= (b + 1) * size - before, reached(b + 1)).otherwise(F.array(entry(b, True)))
    return df.withColumn("__b", F.explode(places)).select("*", "__b.*").drop("__b")


def around(df: DataFrame, before: int, after: int, made: dict[str, Column], key: str = "card_id") -> DataFrame:
    """``df`` (with ``us``) with aggregates over the rows of its key from ``before`` to ``after`` microseconds of each row; equal times are inside."""
    w = Window.partitionBy(key, "bucket").orderBy("us").rangeBetween(-before, after)
    return spread(df, before, after).withColumns({c: e.over(w) for c, e in made.items()}).where("own").drop("bucket", "own")


def _micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")).alias("us")


def online_bursts(txn: DataFrame, p: Burst = Burst()) -> DataFrame:
    """For every online transaction as anchor: the card's online transactions around it. Where ``txn`` has a column ``anchor``, only for those it holds for."""
    kept = [c for c in ("anchor",) if c in txn.columns]
    online = txn.where("channel = 'online'").select("card_id", "txn_id", "ts", "amt", *kept, _micros())
    made = {"burst_count": F.count("*"), "exposure": F.sum(money("amt")), "largest": F.max("amt")}
    found = around(online, p.window_hours * HOUR, p.window_hours * HOUR, made)
    found = found.where("anchor") if kept else found
    return found.withColumn("exposure", F.col("exposure").cast("double")).drop("us", *kept)


def cnp_burst(txn: DataFrame, alerts: DataFrame, p: Burst = Burst(), profiles: DataFrame | None = None) -> DataFrame:
    """Per alert (case_id, card_id, flagged_txn_id): the online burst around the flagged transaction, or the card's last online one if it isn't online. ``profiles`` is ``profile(txn)``, where it is at hand."""
    bursts = online_bursts(txn, p)
    if profiles is None:
        lastly = txn.where("channel = 'online'").groupBy("card_id").agg(F.max_by(F.struct("txn_id", "amt"), F.struct("ts", "txn_id")).alias("last"))
        stats = with_quantiles(txn, "card_id", "amt", {"p75": 0.75}, [(total("amt") / F.count("*")).alias("mean")])
        profiles = stats.join(lastly, "card_id", "left")
    met = alerts.select("case_id", "card_id", "flagged_txn_id").join(bursts.drop("card_id", "ts", "amt").withColumnRenamed("txn_id", "flagged_txn_id"), "flagged_txn_id", "left")
    met = met.join(profiles.select("card_id", "last", "p75", "mean"), "card_id", "left")
    n = F.coalesce("burst_count", F.when(F.col("last").isNotNull(), 1), F.lit(0))
    largest = F.coalesce("largest", F.col("last.amt"))
    odd = (largest > F.col("p75")) | (largest > F.col("mean") * 1.5)
    confidence = F.when(n == 0, 0.0).when((n >= 2) & (n <= 6), F.when(odd, p.anomalous).otherwise(p.usual)).when(n == 1, p.single).otherwise(p.many)
    exposure = F.coalesce("exposure", F.col("last.amt"), F.lit(0.0))
    return met.select("case_id", "card_id", n.alias("burst_count"), exposure.alias("exposure"), F.coalesce(odd, F.lit(False)).alias("anomalous"), confidence.alias("confidence"))


def densest_window(txn: DataFrame, hours: int = 48) -> DataFrame:
    """Per card the earliest online transaction that starts the window with most online transactions."""
    online = txn.where("channel = 'online'").select("card_id", "txn_id", "ts", "amt", _micros())
    n = around(online, 0, hours * HOUR, {"n": F.count("*"), "exposure": F.sum(money("amt"))}).withColumn("exposure", F.col("exposure").cast("double"))
    best = F.min_by(F.struct("txn_id", "ts", "n", "exposure"), F.struct(-F.col("n"), F.col("ts"), F.col("txn_id")))
    return n.groupBy("card_id").agg(best.alias("b")).select("card_id", F.col("b.txn_id").alias("start_txn_id"), F.col("b.ts").alias("start_ts"), F.col("b.n").alias("n"), F.col("b.exposure").alias("exposure"))


def new_device(txn: DataFrame, identity: DataFrame, p: NewDevice = NewDevice()) -> DataFrame:
    """Per transaction: device, whether it is new or behind a proxy, and the confidence."""
    met = txn.select("txn_id", "channel").join(keyed(identity).select("txn_id", "device", "id_15", "id_23"), "txn_id", "left")
    online = F.col("channel") == "online"
    is_new = F.coalesce(F.col("id_15") == "New", F.lit(False))
    proxy = F.coalesce(F.lower("id_23").contains("proxy"), F.lit(False))
    confidence = F.when(~online, 0.0).when(is_new & proxy, p.proxy).when(is_new, p.new).when(F.col("id_15") == "Found", p.found).otherwise(p.other)
    pattern = F.when(online & is_new, "card_not_present_new_device").otherwise("none")
    return met.select("txn_id", F.coalesce("device", F.lit("unknown")).alias("device"), is_new.alias("is_new"), proxy.alias("is_proxy"), confidence.alias("confidence"), pattern.alias("pattern"))


def region_anomaly(txn: DataFrame, targets: DataFrame, p: Region = Region()) -> DataFrame:
    """Per target (case_id, card_id, flagged_txn_id): prior visits of its region and purchases at home around it.

    A target without a flagged transaction takes its card's last in-person one; one whose card has none has no row.
    Where ``txn`` has a column ``anchor``, only the transactions it holds for, and the last in-person ones, can be targets.
    """
    open_ = targets.where("flagged_txn_id IS NULL").select("case_id", "card_id").join(last_in_person(txn), "card_id")
    asked = targets.where("flagged_txn_id IS NOT NULL").select("case_id", "flagged_txn_id").union(open_.select("case_id", "flagged_txn_id"))
    kept = [c for c in ("anchor",) if c in txn.columns]
    placed = txn.select("card_id", "txn_id", "channel", "addr1", *kept, _micros()).join(home_region(txn), "card_id", "left")
    home = F.when(F.col("addr1") == F.col("home_region"), 1).otherwise(0)
    placed = around(placed, p.window_hours * HOUR, p.window_hours * HOUR, {"near": F.sum(home)})
    placed = placed.where("anchor").drop("anchor") if kept else placed
    visits = txn.where("addr1 IS NOT NULL").groupBy("card_id", "addr1").agg(F.count("*").alias("visits"))
    met = asked.withColumnRenamed("flagged_txn_id", "txn_id").join(placed, "txn_id").join(visits, ["card_id", "addr1"], "left")
    met = met.withColumns({"concurrent_home": F.col("near") - home, "prior": F.greatest(F.coalesce("visits", F.lit(0)) - 1, F.lit(0))})
    fresh = (F.col("prior") == 0) & (F.col("channel") == "in_person") & F.col("addr1").isNotNull()
    confidence = F.when(fresh & (F.col("concurrent_home") > 0), p.concurrent).when(fresh, p.travel).when(F.col("prior") >= p.established, p.home).otherwise(p.visited)
    pattern = F.when(fresh & (F.col("concurrent_home") > 0), "out_of_region_use").otherwise("none")
    return met.select("case_id", "txn_id", F.col("addr1").alias("region"), "home_region", "prior", "concurrent_home", confidence.alias("confidence"), pattern.alias("pattern"))


def last_in_person(txn: DataFrame) -> DataFrame:
    """Each card's latest in-person transaction, the target where an alert names none."""
    return txn.where("channel = 'in_person'").groupBy("card_id").agg(F.max_by("txn_id", F.struct("ts", "txn_id")).alias("flagged_txn_id"))


def mismatches(m4=("M2", "F")) -> Column:
    """How many match flags disagree."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return flag(F.col("m1") == "F") + flag(F.col("m4").isin(*m4)) + flag(F.col("m6") == "F")


def account_takeover(txn: DataFrame, targets: DataFrame, p: Takeover = Takeover(), profiles: DataFrame | None = None) -> DataFrame:
    """Per target: match flags that disagree, and whether an online purchase breaks an in-person history. ``profiles`` is ``profile(txn)``, where it is at hand."""
    history = txn.groupBy("card_id").agg(F.count_if(F.col("channel") == "in_person").alias("in_person"), F.count_if(F.col("channel") == "online").alias("online")) if profiles is None else profiles.select("card_id", "in_person", "online")
    asked = txn.where("anchor") if "anchor" in txn.columns else txn
    met = targets.select("case_id", F.col("flagged_txn_id").alias("txn_id")).join(asked.select("txn_id", "card_id", "channel", mismatches().alias("mismatches")), "txn_id").join(history, "card_id")
    sudden = (F.col("channel") == "online") & (F.col("online") <= p.online_at_most) & (F.col("in_person") >= p.in_person_at_least) & (F.col("mismatches") >= 1)
    confidence = F.when(sudden, p.sudden).when(F.col("mismatches") >= 2, p.mismatched).otherwise(p.none)
    pattern = F.when(sudden | (F.col("mismatches") >= 2), "account_takeover").otherwise("none")
    return met.select("case_id", "txn_id", "mismatches", "in_person", "online", confidence.alias("confidence"), pattern.alias("pattern"))


def flag_rarity(txn: DataFrame, flags=("m1", "m4", "m6"), rare: float = 0.10) -> DataFrame:
    """Per transaction and match flag: the share of the customer's transactions with its value."""
    long = txn.select("txn_id", "customer_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, flags)), F.array(*flags))).alias("flag", "value")).where("value IS NOT NULL")
    share = F.count("*").over(Window.partitionBy("customer_id", "flag", "value")) / F.count("*").over(Window.partitionBy("customer_id", "flag"))
    return long.withColumn("share", r4(share)).withColumn("rare", F.col("share") < rare)


def outliers(txn: DataFrame, columns: tuple[str, ...], deviations: float = 3.0) -> DataFrame:
    """Values further than ``deviations`` sample deviations from the customer's mean, one row per transaction and column."""
    long = txn.select("txn_id", "customer_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(F.col(c).cast("double") for c in columns)))).alias("feature", "value"))
    w = Window.partitionBy("customer_id", "feature")
    long = long.where("value IS NOT NULL").withColumns({"mean": F.avg("value").over(w), "std": F.stddev_samp("value").over(w)})
    return long.where(F.abs(F.col("value") - F.col("mean")) > deviations * F.col("std")).select("txn_id", "customer_id", "feature", "value")


def amount_percentile(txn: DataFrame) -> DataFrame:
    """Per transaction the share of its card's amounts that are at most its own."""
    return txn.select("txn_id", "card_id", r4(F.cume_dist().over(Window.partitionBy("card_id").orderBy("amt"))).alias("share"))


#: Groups that a customer's transactions of a stretch of time are dealt to, and tasks that share all groups.
DEALT, SHARES = 4, 192


def activity_window(txn: DataFrame, alerts: DataFrame, days: int = 7) -> DataFrame:
    """The customer's transactions within ``days`` of each alert's flagged one, which is marked.

    There may be far more pairs than rows, so a few customers must not be a few tasks: transactions are dealt to stretches of ``days`` and to DEALT groups,
    and a flagged one goes to the groups of the three stretches that it can reach, with the first and last time that it asks for. The number of tasks is stated, as that of small inputs would be lowered.
    """
    flagged = alerts.select("case_id", F.col("flagged_txn_id").alias("txn_id")).join(txn.select("txn_id", "customer_id", F.col("ts").alias("at")), "txn_id").withColumnRenamed("txn_id", "flagged")
    first, last = F.expr(f"at - interval '{days}' day").alias("first"), F.expr(f"at + interval '{days}' day").alias("last")
    stretch = lambda time: F.floor(F.datediff(time, F.lit("1970-01-01").cast("date")) / max(days, 1)).cast("int")
    reached = F.explode(F.sequence(stretch(first), stretch(last))).alias("stretch")
    flagged = flagged.select("case_id", "flagged", "customer_id", first, last, reached).select("*", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("part"))
    known = txn.select("customer_id", "txn_id", "ts", "amt", stretch(F.col("ts")).alias("stretch"), F.pmod(F.hash("txn_id"), F.lit(DEALT)).alias("part"))
    key = ["customer_id", "stretch", "part"]
    met = known.repartition(SHARES, *key).hint("merge").join(flagged, key).where(F.col("ts").between(F.col("first"), F.col("last")))
    return met.select("case_id", "txn_id", "ts", "amt", (F.col("txn_id") == F.col("flagged")).alias("is_flagged"))


def probe_cluster(txn: DataFrame, most: float = 5.0, minutes: int = 60) -> DataFrame:
    """Starts of three small online transactions of a card within the window."""
    small = txn.where((F.col("channel") == "online") & (F.col("amt") < most))
    third = small.select("card_id", "txn_id", "ts", F.lead("ts", 2).over(by_card()).alias("third_ts"), F.lead("txn_id", 2).over(by_card()).alias("third_txn_id"))
    return third.where(F.col("third_ts") <= F.expr(f"ts + interval '{minutes}' minute")).select("card_id", "txn_id", "third_txn_id")


def device_first_seen(txn: DataFrame, identity: DataFrame) -> DataFrame:
    """Per customer and device: transactions and first time; ``is_new`` where the device has been seen once."""
    met = txn.select("txn_id", "customer_id", "ts").join(identity.select("txn_id", device_key().alias("device")), "txn_id").where("device <> 'unknown'")
    found = met.groupBy("customer_id", "device").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))
    return found.withColumn("is_new", F.col("n") == 1)


def recurring_charges(txn: DataFrame, low: int = 25, high: int = 35, repeats: int = 2) -> DataFrame:
    """Card, product and amount charged about monthly ``repeats`` times or more."""
    w = Window.partitionBy("card_id", "product_cd", "amt").orderBy("ts", "txn_id")
    gap = txn.select("card_id", "product_cd", "amt", (seconds(F.col("ts"), F.lag("ts").over(w)) / 86400).alias("days")).where(F.col("days").between(low, high))
    return gap.groupBy("card_id", "product_cd", "amt").agg(F.count("*").alias("repeats")).where(F.col("repeats") >= repeats)


def mentions_recurring(text: Column) -> Column:
    """Whether an alert's text speaks of a recurring charge."""
    lower = F.lower(text)
    return lower.contains("recurring") | lower.contains("subscription") | lower.contains("gym")
