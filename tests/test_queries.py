"""Every registered query of the card graph against its SQL, and against its stream or plain-Python twin."""

import math

import duckdb
import pandas as pd
import pytest

from riskgraph.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (bool, str)):
        return value
    if isinstance(value, pd.Timestamp):
        return str(value)
    return float(f"{float(value):.9g}") if hasattr(value, "__float__") else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    got = registry.QUERIES[name](spark, sf_dir)
    cursor = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, cursor.fetchall())


@pytest.fixture(scope="module")
def without_sql(spark, sf_dir):
    """The rows of each query that has no SQL, computed once."""
    held = {}

    def rows_of(name):
        if name not in held:
            held[name] = registry.QUERIES[name](spark, sf_dir).collect()
        return held[name]

    return rows_of


def count(con, name, table):
    """Rows of a view of the adapter, by the oracle's SQL."""
    return con.execute(registry.ORACLES["date_ranges"].rsplit("SELECT 'txn'", 1)[0] + f"SELECT count(*) FROM {table}").fetchone()[0]


def test_written_answers_come_back(without_sql, con):
    got = without_sql("write_case_answers")
    assert len(got) == len({r.case_id for r in got}) == count(con, "", "alert") and all(r.status in ("open", "closed_fraud", "closed_legitimate") for r in got)


def test_written_next_edges_chain_each_card(without_sql, con):
    got = without_sql("write_next_edges")
    assert len(got) == count(con, "", "txn") - count(con, "", "(SELECT DISTINCT card_id FROM txn)")
    assert len({r.from_txn_id for r in got}) == len({r.to_txn_id for r in got}) == len(got) and all(r.delta_sec >= 0 for r in got)


def test_split_keeps_the_share_of_each_class(without_sql):
    got = without_sql("stratified_split")
    for outcome in {r.outcome for r in got}:
        part = [r.train for r in got if r.outcome == outcome]
        assert abs(sum(part) - 0.8 * len(part)) <= 1


def test_split_equals_percent_rank(spark, sf_dir):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from riskgraph.operators.model import stratified_split

    df = spark.range(3000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("y"))
    rank = F.percent_rank().over(Window.partitionBy("y").orderBy(F.xxhash64(F.lit(42), F.col("k")), "k"))
    want = df.withColumn("train", rank < 0.8)
    assert stratified_split(df, "k", "y").exceptAll(want).count() == 0


def test_model_queries(without_sql, con, monkeypatch):
    """With a smaller model than the registered one, to stay quick."""
    from riskgraph.functions.params import Model
    from riskgraph.plans import investigation_queries, report_queries

    for module in (report_queries, investigation_queries):
        monkeypatch.setattr(module, "FULL", Model(depth=3, rounds=8, folds=2))
    metrics = without_sql("train_fraud_model")[0]
    assert 0 <= metrics.precision <= 1 and 0 <= metrics.recall <= 1
    predicted = without_sql("predict_probability")
    assert len(predicted) == count(con, "", "alert") and all(0 <= r.probability <= 1 for r in predicted)
    scored = {r.case_id: r for r in without_sql("score_case")}
    assert len(scored) == len(predicted) and all(scored[r.case_id].prior == r.probability for r in predicted)
    assert all(r.actions for r in scored.values())


def test_velocity_stream_equals_its_batch_twin(spark, sf_dir, without_sql):
    batch = {(r.card_id, r.hours, r.start): (r.n, r.amount) for r in registry.QUERIES["stream_velocity"](spark, sf_dir).collect()}
    got = without_sql("stream_velocity_run")
    assert {r.hours for r in got} == {24, 48} and all(batch[r.card_id, r.hours, r.start] == (r.n, r.amount) for r in got)  # windows that the watermark has closed
    last = max(start for _, _, start in batch)
    assert {(r.card_id, r.hours, r.start) for r in got} >= {k for k in batch if k[2] < last - pd.Timedelta(days=6)}


def test_session_stream_equals_its_batch_twin(spark, sf_dir, without_sql):
    batch = {(r.card_id, r.start): (r.end, r.n, r.amount) for r in registry.QUERIES["stream_sessions"](spark, sf_dir).collect()}
    got = without_sql("stream_sessions_run")
    assert got and all(batch[r.card_id, r.start] == (r.end, r.n, r.amount) for r in got)


def test_no_reply_stream_equals_its_batch_twin(spark, sf_dir, without_sql):
    batch = {(r.case_id, r.asked_at, r.actions) for r in registry.QUERIES["stream_no_reply"](spark, sf_dir).collect()}
    got = {(r.case_id, r.asked_at, r.actions) for r in without_sql("stream_no_reply_run")}
    assert got and got <= batch
    last = max(a for _, a, _ in batch)
    assert got >= {r for r in batch if r[1] < last - pd.Timedelta(days=5)}


def test_similar_cases_are_other_cases(without_sql):
    got = without_sql("similar_cases")
    assert got and all(r.query_id != r.doc_id and 0 < r.score <= 1.000001 and 1 <= r.rank <= 3 for r in got)


def test_reports_and_narratives_have_enough_sentences(spark, sf_dir):
    from pyspark.sql import functions as F

    from riskgraph.operators import reports

    got = registry.QUERIES["sar_report"](spark, sf_dir).select(reports.sentence_count(F.col("narrative")).alias("n")).collect()
    assert got and all(6 <= r.n <= 12 for r in got)


def test_greedy_exploration_equals_the_sequential_choice(spark):
    import random

    from riskgraph.operators import network

    rng = random.Random(1)
    txn = [(str(i), f"K{rng.randint(0, 9)}", "2024-01-05 00:00:00", rng.randint(1, 9) / 10, float(i)) for i in range(60)]
    txns = spark.createDataFrame(txn, "txn_id string, card_id string, ts string, risk_score double, amt double").selectExpr("*", "'r' AS addr1").withColumn("ts", __import__("pyspark").sql.functions.expr("cast(ts as timestamp_ntz)"))
    device = {str(i): f"D{rng.randint(0, 6)}" for i in range(60)}
    uses = spark.createDataFrame(list(device.items()), "txn_id string, device string")
    alerts = spark.createDataFrame([("0", "K99")], "flagged_txn_id string, card_id string")
    cards, devices, want = set(), set(), []
    for i, card, _, risk, amt in sorted(txn, key=lambda r: (-r[3], -r[4], r[0])):
        if i != "0" and risk >= 0.2 and card not in cards and device[i] not in devices:
            cards.add(card)
            devices.add(device[i])
            want.append(i)
    assert [r.txn_id for r in network.exploration_greedy(txns, uses, alerts, "2024-01-03", 0.2).collect()] == want


def test_memory_by_devices_only_adds(spark, sf_dir, without_sql):
    plain_ = {r.case_id: r.prior_cases for r in registry.QUERIES["case_memory_lookup"](spark, sf_dir).collect()}
    got = {r.case_id: r.prior_cases for r in without_sql("case_memory_lookup_devices")}
    assert set(got) == set(plain_) and all(got[c] == p for c, p in plain_.items() if p)


def test_every_query_without_sql_is_tested_here():
    tested = {"write_case_answers", "write_next_edges", "stratified_split", "train_fraud_model", "predict_probability", "score_case", "stream_velocity_run", "stream_sessions_run", "stream_no_reply_run", "similar_cases", "exploration_greedy", "case_memory_lookup_devices"}
    assert set(registry.QUERIES) - set(registry.ORACLES) == tested
