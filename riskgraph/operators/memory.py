"""Case memory: lookups, exposure, write-back and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskgraph.functions.expressions import joined, money, total
from riskgraph.operators import graph


def case_memory_lookup(alerts: DataFrame, cases: DataFrame, connected: DataFrame, txn: DataFrame, uses: DataFrame | None = None) -> DataFrame:
    """Per alert its prior cases: those of its card, directly or as a connected card; without any, those of the customer's other cards; without any, where ``uses`` is given, those of cards on its device."""
    base = alerts.select("case_id", "card_id", "customer_id", "flagged_txn_id")
    on_card = cases.select(F.col("case_id").alias("prior"), "card_id")
    linked = connected.select(F.col("from_id").alias("prior"), F.col("to_id").alias("card_id"))
    found = base.join(on_card.union(linked), "card_id").select("case_id", "prior").distinct()
    owners = txn.select("customer_id", "card_id").distinct()
    rest = base.join(found, "case_id", "left_anti")
    found = found.union(rest.drop("card_id").join(owners, "customer_id").join(on_card, "card_id").select("case_id", "prior").distinct())
    if uses is not None:
        rest = base.join(found, "case_id", "left_anti")
        devices = rest.select("case_id", F.col("flagged_txn_id").alias("txn_id")).join(uses.select("txn_id", "device"), "txn_id")
        found = found.union(devices.join(uses.select("device", "card_id").distinct(), "device").join(on_card, "card_id").select("case_id", "prior").distinct())
    met = found.join(cases.select(F.col("case_id").alias("prior"), "outcome"), "prior")
    sums = met.groupBy("case_id").agg(joined(F.collect_set("prior")).alias("prior_cases"), F.count_if(F.col("outcome") == "confirmed_fraud").alias("confirmed"), F.count_if(F.col("outcome") == "cleared").alias("cleared"))
    out = base.select("case_id").join(sums, "case_id", "left").fillna(0, ["confirmed", "cleared"])
    return out.withColumn("confidence", F.when(F.col("confirmed") > 0, 0.85).when(F.col("cleared") > 0, 0.20).otherwise(0.50))


def cases_by_shared_device(txn: DataFrame, identity: DataFrame, cases: DataFrame) -> DataFrame:
    """Pairs of a customer and the cases of other customers that use the same device (by its name)."""
    users = txn.select("txn_id", "customer_id").join(identity.where("device_info IS NOT NULL").select("txn_id", "device_info"), "txn_id").select("customer_id", "device_info").distinct()
    known = users.withColumnRenamed("customer_id", "other").join(cases.select(F.col("customer_id").alias("other"), "case_id"), "other")  # only customers with cases meet the device's others
    return users.join(known, "device_info").where("customer_id <> other").select("customer_id", "case_id").distinct()


def case_exposure(involves: DataFrame, txn: DataFrame) -> DataFrame:
    """Per case the sum of its transactions' absolute amounts."""
    met = involves.select(F.col("from_id").alias("case_id"), F.col("to_id").alias("txn_id")).join(txn.select("txn_id", "amt"), "txn_id")
    return met.groupBy("case_id").agg(F.sum(F.abs(money("amt"))).cast("double").alias("exposure"), F.count("*").alias("n_txns"))


def affected_transactions(alerts: DataFrame, txn: DataFrame, bursts: DataFrame, hours: int = 48, least: float = 0.70) -> DataFrame:
    """Each alert's flagged transaction, and the online transactions around it where ``bursts`` (case_id, confidence, probability) reaches ``least`` in both."""
    flagged = alerts.select("case_id", F.col("flagged_txn_id").alias("txn_id"))
    strong = bursts.where((F.col("confidence") >= least) & (F.col("probability") >= least)).select("case_id")
    anchors = alerts.join(strong, "case_id", "left_semi").select("case_id", F.col("flagged_txn_id").alias("txn_id")).join(txn.select("txn_id", "card_id", F.col("ts").alias("at"), "channel"), "txn_id").where("channel = 'online'")
    near = anchors.select("case_id", "card_id", "at").join(txn.where("channel = 'online'").select("card_id", "txn_id", "ts"), "card_id")
    near = near.where(F.col("ts").between(F.expr(f"at - interval '{hours}' hour"), F.expr(f"at + interval '{hours}' hour")))
    return flagged.union(near.select("case_id", "txn_id")).distinct()


def case_write_back(cases: DataFrame, new: DataFrame) -> DataFrame:
    """Cases with the new ones put in; the newer version of a case stays."""
    return graph.upsert(cases, new, ["case_id"], "version")


def write_unit(path: str, n: int, tables: dict[str, DataFrame]) -> None:
    """The tables of write-back ``n`` (case, evidence, raised, similar_to), each to its own folder, and then the note that they are all there.

    ``read_unit`` sees a write-back once it is noted, so a failed one is not seen in part; one that is written again replaces itself.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/unit={n}")
    spark = next(iter(tables.values())).sparkSession
    spark.range(1).select(F.lit(",".join(sorted(tables))).alias("tables")).write.mode("overwrite").parquet(f"{path}/noted/unit={n}")


def read_unit(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table's rows of all noted write-backs, with ``unit``. ``graph.upsert`` takes the last unit of rows with one id."""
    noted = spark.read.parquet(f"{path}/noted").select("unit")
    return spark.read.parquet(f"{path}/{name}").join(F.broadcast(noted), "unit", "left_semi")  # a row for each write-back


def unit_of(cases: DataFrame, evidence: DataFrame, affected: DataFrame, similar: DataFrame) -> dict[str, DataFrame]:
    """What is written for cases (case_id, outcome): themselves, their claims as ``EV-<case>-<n>``, RAISED edges to affected transactions (case_id, txn_id) and SIMILAR_TO edges (from_id, to_id).

    Claims (case_id, claim, source, ref) are numbered in the order of claim, source and ref.
    """
    order = Window.partitionBy("case_id").orderBy("claim", "source", "ref")
    rows = evidence.join(cases.select("case_id"), "case_id", "left_semi").withColumn("n", F.row_number().over(order))
    rows = rows.select(F.concat_ws("-", F.lit("EV"), "case_id", F.col("n").cast("string")).alias("evidence_id"), "case_id", "claim", "source", "ref")
    return {"case": cases, "evidence": rows, "raised": graph.edges(affected, "case_id", "txn_id"), "similar_to": similar}


def evidence_rows(cases: DataFrame) -> DataFrame:
    """One row per evidence claim of a case (case_id, evidence array), numbered ``EV-<case>-<n>`` from 1."""
    out = cases.select("case_id", F.posexplode("evidence").alias("n", "claim"))
    return out.select(F.concat_ws("-", F.lit("EV"), "case_id", (F.col("n") + 1).cast("string")).alias("evidence_id"), "case_id", "claim")


def similar_edges(lookup: DataFrame) -> DataFrame:
    """Edges from each case to the prior cases found for it."""
    return graph.edges(lookup.select("case_id", F.explode(F.split("prior_cases", ",")).alias("prior")), "case_id", "prior")


def case_memory_audit(stored: DataFrame, documents: DataFrame, evidence: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Per case: whether it lacks evidence, and which of its fields differ between store and document (both: case_id, outcome, pattern, exposure_usd)."""
    b = documents.select("case_id", *(F.col(c).alias(f"d_{c}") for c in ("outcome", "pattern", "exposure_usd")))
    seen = evidence.select("case_id").distinct().withColumn("seen", F.lit(True))
    met = stored.select("case_id", "outcome", "pattern", "exposure_usd").join(b, "case_id", "left").join(seen, "case_id", "left")
    off = F.array(
        F.when(~F.col("outcome").eqNullSafe(F.col("d_outcome")), "outcome"),
        F.when(~F.col("pattern").eqNullSafe(F.col("d_pattern")), "pattern"),
        F.when(~F.coalesce(F.abs(F.col("exposure_usd") - F.col("d_exposure_usd")) <= tolerance, F.lit(False)), "exposure_usd"),
    )
    return met.select("case_id", F.col("seen").isNull().alias("no_evidence"), joined(F.filter(off, lambda x: x.isNotNull())).alias("differs"))


def monitor_expiry(monitors: DataFrame, txn: DataFrame, hours: int = 72) -> DataFrame:
    """Transactions of a monitored card (card_id, started_at) while the monitoring lasts: per monitoring their number and amount."""
    met = monitors.join(txn.select("card_id", "ts", "amt"), "card_id").where((F.col("ts") > F.col("started_at")) & (F.col("ts") <= F.expr(f"started_at + interval '{hours}' hour")))
    sums = met.groupBy("card_id", "started_at").agg(F.count("*").alias("n_txns"), total("amt").alias("amount"))
    return monitors.select("card_id", "started_at").distinct().join(sums, ["card_id", "started_at"], "left").fillna(0, ["n_txns", "amount"])
