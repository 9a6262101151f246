"""All queries over the driver tables, by operator key, with their oracle SQL."""

from __future__ import annotations

from riskgraph.plans import card_queries, feature_queries, graph_queries, investigation_queries, network_queries, policy_queries, report_queries  # noqa: F401
from riskgraph.plans.base import ORACLES, QUERIES

FLAGSHIP = "investigate_alerts"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
