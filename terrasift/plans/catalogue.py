"""All named queries."""

from terrasift.plans import audit_queries, chip_queries, enrich_queries, event_queries, scene_queries, screening, serving_queries  # noqa: F401
from terrasift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
