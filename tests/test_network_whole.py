"""Link analysis: whole lists, and joins that hold no more than their results need."""

import re

import pytest

import __spark_entry__ as contract

DATA = "/root/testdata/sf0.01"


def plan(spark, name):
    return contract.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_case_subgraph_limits_cards_and_devices_before_alerts_meet_them(spark):
    limits = re.findall(r"WindowGroupLimit \[(\w+)#", plan(spark, "case_subgraph"))
    assert {"card_id", "device"} <= set(limits)


def test_connected_cards_shuffles_no_pairs(spark):
    before_pairs = plan(spark, "connected_cards").split("Generate explode(others")
    assert len(before_pairs) == 2 and "Exchange" not in before_pairs[0]


def test_connected_cards_copies_alerts_and_not_the_cards_of_devices(spark):
    lines = plan(spark, "connected_cards").splitlines()
    copied = [x for x in lines if "Generate explode" in x and "explode(others" not in x]
    assert len(copied) == 1 and "case_id#" in copied[0] and "others#" not in copied[0]
    assert any("REPARTITION_BY_NUM" in x for x in lines)


@pytest.mark.parametrize("name", ["device_neighbors", "region_cluster", "email_cluster"])
def test_every_card_is_listed(spark, name):
    rows = contract.queries()[name](spark, DATA).collect()
    assert max(r.n_cards for r in rows) > 20 and all(len(r.cards.split(",")) == r.n_cards for r in rows)
