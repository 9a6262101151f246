"""Steps that the investigation's claims share equal those of each claim alone."""

import pytest

from riskgraph.operators import cards
from riskgraph.plans.investigation_queries import investigate_alerts
from riskgraph.sources.adapter import Tables


@pytest.fixture
def t(spark, sf_dir):
    return Tables(spark, sf_dir)


def rows(df):
    return sorted(map(str, df.collect()))


def test_detectors_over_a_shared_profile_and_marked_anchors(t):
    flagged = t.alert.selectExpr("flagged_txn_id AS txn_id", "true AS anchor")
    marked = t.txn.join(flagged, "txn_id", "left").fillna(False, ["anchor"])
    profiles = cards.profile(t.txn)
    assert rows(cards.rounded_profile(profiles)) == rows(cards.baseline(t.txn))
    assert rows(cards.cnp_burst(marked, t.alert, profiles=profiles)) == rows(cards.cnp_burst(t.txn, t.alert))
    assert rows(cards.account_takeover(marked, t.alert, profiles=profiles)) == rows(cards.account_takeover(t.txn, t.alert))
    assert rows(cards.region_anomaly(marked, t.alert)) == rows(cards.region_anomaly(t.txn, t.alert))


def test_the_investigation_takes_numbers_out_of_the_events_once(t):
    assert "regexp_extract" not in investigate_alerts(t)._jdf.queryExecution().toString()
