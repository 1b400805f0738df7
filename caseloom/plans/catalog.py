"""All registered queries."""

from . import catalog_analytics, catalog_graph, catalog_rules, catalog_runs, catalog_sources  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
