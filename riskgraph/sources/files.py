"""Readers of the reference inputs (CSV, JSON) and writers of results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgraph.functions.expressions import present

TRANSACTIONS = "TransactionID STRING, TransactionAmt DOUBLE, ts TIMESTAMP_NTZ, channel STRING, risk_score DOUBLE, ProductCD STRING, addr1 STRING, P_emaildomain STRING, customer_id STRING, M1 STRING, M4 STRING, M6 STRING"
IDENTITY = "TransactionID STRING, id_15 STRING, id_23 STRING, id_30 STRING, id_31 STRING, id_33 STRING, DeviceType STRING, DeviceInfo STRING"
CASES = (
    "case_id STRING, customer_id STRING, card_id STRING, opened_at TIMESTAMP_NTZ, closed_at TIMESTAMP_NTZ, outcome STRING, pattern STRING, first_fraud_txn_id STRING, "
    "txn_ids STRING, n_txns INT, exposure_usd DOUBLE, connected_card_ids STRING, actions_taken STRING, report_filed STRING"
)
ALERTS = "case_id STRING, opened_at TIMESTAMP_NTZ, trigger_type STRING, flagged_txn_id STRING, card_id STRING, customer_id STRING, risk_score DOUBLE, customer_response STRING"
ANSWER = (
    "case_id STRING, stop_reason STRING, tool_calls INT, tokens INT, latency_s DOUBLE, `case` STRUCT<status: STRING, verdict: STRING, fraud_probability: DOUBLE, pattern: STRING, "
    "affected_txn_ids: ARRAY<STRING>, exposure_usd: DOUBLE, evidence: ARRAY<STRUCT<claim: STRING, source: STRING, ref: STRING, entity_ids: ARRAY<STRING>>>, summary: STRING>"
)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the session's shared checkpoint folder. Where none is set, a temporary one on this machine, if it is the only one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scan_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Typed scan of the needed columns of a CSV; empty strings become null, a missing amount or score 0."""
    df = spark.read.schema(TRANSACTIONS).csv(path, header=True, enforceSchema=False)
    names = {"TransactionID": "txn_id", "ProductCD": "product_cd", "addr1": "addr1", "P_emaildomain": "p_email", "customer_id": "customer_id", "channel": "channel", "M1": "m1", "M4": "m4", "M6": "m6"}
    return df.select(*(present(a).alias(b) for a, b in names.items()), "ts", F.coalesce("TransactionAmt", F.lit(0.0)).alias("amt"), F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"))


def scan_identity(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(IDENTITY).csv(path, header=True, enforceSchema=False)
    names = {"TransactionID": "txn_id", "DeviceInfo": "device_info", "DeviceType": "device_type"}
    return df.select(*(present(c).alias(names.get(c, c)) for c in df.columns))


def scan_closed_cases(spark: SparkSession, path: str) -> DataFrame:
    """Closed cases; ids like ``123.0`` become ``123``, counts and exposure 0 where missing, ``report_filed`` a boolean."""
    df = spark.read.schema(CASES).csv(path, header=True, enforceSchema=False)
    number = F.col("first_fraud_txn_id").try_cast("double").cast("long").cast("string")
    return df.withColumns({"first_fraud_txn_id": F.coalesce(number, present("first_fraud_txn_id")), "n_txns": F.coalesce("n_txns", F.lit(0)), "exposure_usd": F.coalesce("exposure_usd", F.lit(0.0)), "report_filed": F.coalesce(F.lower(F.trim("report_filed")).isin("yes", "true", "1"), F.lit(False))})


def scan_case_pack(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALERTS).csv(path, header=True, enforceSchema=False)


def scan_case_answers(spark: SparkSession, path: str, alerts: DataFrame) -> DataFrame:
    """Case documents with their alert's opening, newest first."""
    df = spark.read.schema(ANSWER).json(path, multiLine=False)
    flat = df.select("case_id", "stop_reason", F.col("case.verdict").alias("verdict"), F.col("case.fraud_probability").alias("probability"), F.col("case.exposure_usd").alias("exposure"), F.size("case.affected_txn_ids").alias("n_txns"))
    return flat.join(alerts.select("case_id", "opened_at", "trigger_type"), "case_id", "left").orderBy(F.desc("opened_at"), "case_id")


def write_case_answers(answers: DataFrame, path: str) -> None:
    """One JSON document per case and line."""
    answers.write.mode("error").json(path)


def write_next_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.col("from_id").alias("from_txn_id"), F.col("to_id").alias("to_txn_id"), "card_id", "delta_sec").write.csv(path, header=True)


def buckets_for(rows: int, per_bucket: int = 1_000_000) -> int:
    """The power of two that leaves a bucket so many rows at most, if its keys are even."""
    return 1 << max(0, -(-rows // per_bucket) - 1).bit_length()


def publish_tables(df: DataFrame, name: str, path: str | None = None, key: str = "card_id", at: str = "ts", buckets: int | None = None) -> None:
    """A table partitioned by month (``month``, yyyy-MM, of ``at``), bucketed by ``key`` and sorted by time; at ``path`` if given.

    Work per key and joins of two such tables with as many buckets need no exchange, and filters on the month read only its files.
    ``buckets`` follows the number of rows unless it is given. Rows of a month and bucket are written by one task, as one file; rows without a time are in the null month.
    """
    n = buckets or buckets_for(df.count())
    monthly = df.withColumn("month", F.date_format(at, "yyyy-MM")).repartition("month", F.pmod(F.hash(key), F.lit(n)))
    writer = monthly.write.mode("overwrite").format("parquet").partitionBy("month").bucketBy(n, key).sortBy(at)
    (writer.option("path", path) if path else writer).saveAsTable(name)


