"""All registered queries. Importing this module fills the registry."""

from __future__ import annotations

from shopfloor.plans import q_decisions, q_edges, q_imaging, q_learning, q_scalars, q_sources, q_streaming, q_retrieval, q_rules, q_scenarios, q_telemetry  # noqa: F401
from shopfloor.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
