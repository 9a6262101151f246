"""Vertices and edges of the card graph as tables.

A reverse edge is the same table with its columns swapped; nothing is stored twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskgraph.functions.expressions import by_card, present, seconds

UNKNOWN = "unknown"
ABSENT = ("nan", "null", "none", UNKNOWN)
DEVICE_PARTS = ("device_info", "id_30", "id_31", "id_33")


def vertices(df: DataFrame, key: str, name: str = "id") -> DataFrame:
    """Distinct non-empty keys."""
    return df.select(present(key).alias(name)).where(F.col(name).isNotNull()).distinct()


def cards(txn: DataFrame) -> DataFrame:
    """One row per card with the customer and product of its first transaction."""
    first = F.struct("ts", "txn_id")
    return txn.groupBy(F.col("card_id").alias("id")).agg(F.min_by("customer_id", first).alias("customer_id"), F.min_by("product_cd", first).alias("product_cd"))


def resolve_card_id(txn: DataFrame, mapping: DataFrame) -> DataFrame:
    """``txn_id``, ``customer_id`` and its card: as mapped; else the customer's only mapped card; else ``<customer>-K1``.

    ``mapping`` has (txn_id, customer_id, card_id).
    """
    only = mapping.groupBy("customer_id").agg(F.collect_set("card_id").alias("cards"))
    met = txn.select("txn_id", "customer_id").join(mapping.select("txn_id", F.col("card_id").alias("mapped")), "txn_id", "left").join(only, "customer_id", "left")
    return met.select("txn_id", "customer_id", F.coalesce("mapped", F.when(F.size("cards") == 1, F.col("cards")[0]), F.concat("customer_id", F.lit("-K1"))).alias("card_id"))


def device_key(parts=DEVICE_PARTS) -> Column:
    """The device's known parts joined by a spaced bar; ``unknown`` without any."""
    known = []
    for p in parts:
        text = present(F.col(p).cast("string"))
        known.append(F.when(~F.lower(text).isin(*ABSENT), text))
    return F.coalesce(F.nullif(F.concat_ws(" | ", *known), F.lit("")), F.lit(UNKNOWN))


def keyed(identity: DataFrame) -> DataFrame:
    """``identity`` with ``device``, unless it has one."""
    return identity if "device" in identity.columns else identity.withColumn("device", device_key())


def devices(identity: DataFrame) -> DataFrame:
    """Device profiles other than unknown, with the parts and type of their first transaction by id."""
    keyed = identity.withColumn("id", device_key()).where(F.col("id") != UNKNOWN)
    return keyed.groupBy("id").agg(*(F.min_by(c, "txn_id").alias(c) for c in (*DEVICE_PARTS, "device_type")))


def edges(df: DataFrame, a: str | Column, b: str | Column) -> DataFrame:
    """Distinct pairs (from_id, to_id) with both ends present."""
    return df.select(present(a).alias("from_id"), present(b).alias("to_id")).where("from_id IS NOT NULL AND to_id IS NOT NULL").distinct()


def from_device(identity: DataFrame) -> DataFrame:
    return edges(identity.withColumn("device", device_key()).where(F.col("device") != UNKNOWN), "txn_id", "device")


def next_edges(txn: DataFrame) -> DataFrame:
    """From each transaction of a card to its next one, with the seconds between."""
    w = by_card()
    following = txn.select("card_id", F.col("txn_id").alias("from_id"), F.lead("txn_id").over(w).alias("to_id"), seconds(F.lead("ts").over(w), F.col("ts")).alias("delta_sec"))
    return following.where("to_id IS NOT NULL")


def listed(df: DataFrame, key: str, column: str) -> DataFrame:
    """Edges from ``key`` to each member of a bar-separated list."""
    return edges(df.select(key, F.explode(F.split(column, "\\|")).alias("member")), key, "member")


def next_chain_integrity(txn: DataFrame, next_: DataFrame) -> DataFrame:
    """Per card: its transactions and edges, and whether the edges form one forward chain.

    Each edge must lead between two of the card's transactions and rise strictly in (time, id), which rules out every cycle; with in- and
    out-degrees of at most one and one edge fewer than transactions only one chain through all of them is left.
    """
    nodes = txn.groupBy("card_id").agg(F.count("*").alias("n_txns"))
    place = txn.select("card_id", F.struct("ts", "txn_id").alias("at"), "txn_id")
    known = next_.select("card_id", "from_id", "to_id", "delta_sec").join(place.select("card_id", F.col("txn_id").alias("from_id"), F.col("at").alias("a")), ["card_id", "from_id"], "left").join(place.select("card_id", F.col("txn_id").alias("to_id"), F.col("at").alias("b")), ["card_id", "to_id"], "left")
    spans = known.groupBy("card_id").agg(F.count("*").alias("n_edges"), F.min("delta_sec").alias("min_delta"), F.bool_and(F.coalesce(F.col("a") < F.col("b"), F.lit(False))).alias("rises"))
    outs = next_.groupBy("card_id", "from_id").count().groupBy("card_id").agg(F.max("count").alias("max_out"))
    ins = next_.groupBy("card_id", "to_id").count().groupBy("card_id").agg(F.max("count").alias("max_in"))
    met = nodes.join(spans, "card_id", "left").join(outs, "card_id", "left").join(ins, "card_id", "left")
    n = F.coalesce("n_edges", F.lit(0))
    chain = (n == F.col("n_txns") - 1) & ((n == 0) | (F.col("rises") & (F.col("max_out") == 1) & (F.col("max_in") == 1)))
    return met.select("card_id", "n_txns", n.alias("n_edges"), "min_delta", chain.alias("is_chain"))


def upsert(base: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """``base`` with ``new`` put in; of rows with one key the highest ``version`` stays, of equal versions the one whose other columns, in their order, are greatest (nulls last).

    The greatest is kept before anything is shuffled, so a key with many rows is no load. Columns must be orderable.
    """
    rest = [c for c in base.columns if c not in keys and c != version]
    found = base.unionByName(new).groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("__best"))
    return found.select(*(F.col(c) if c in keys else F.col(f"__best.`{c}`").alias(c) for c in base.columns))


def insert_or_ignore(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and the rows of ``new`` whose key it lacks."""
    return base.unionByName(new.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each named table."""
    parts = [df.groupBy().agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def case_edge_coverage(cases: DataFrame, on_card: DataFrame, involves: DataFrame, connected: DataFrame) -> DataFrame:
    """Per case the number of its edges of each type, and whether it can be reached."""
    out = cases.select("case_id")
    for name, e in (("on_card", on_card), ("involves", involves), ("connected_to", connected)):
        n = e.groupBy(F.col("from_id").alias("case_id")).agg(F.count("*").alias(name))
        out = out.join(n, "case_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("reachable", (F.col("on_card") > 0) & (F.col("involves") > 0))
