"""All registered queries."""

from __future__ import annotations

from tidewire.plans import graph_queries, intake_queries, score_queries, traffic_queries  # noqa: F401
from tidewire.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
