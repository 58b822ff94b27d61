"""All registered queries of the engine; importing the modules registers them."""

from __future__ import annotations

from lorebank.plans import client_queries, entity_queries, evidence_queries, graph_queries, lifecycle_queries, recall_queries, signal_queries, stream_queries  # noqa: F401
from lorebank.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
