"""Every registered query; importing the modules below fills the registry."""

from __future__ import annotations

from haulmark.plans import analytics_queries, cdc_queries, ledger_queries, reconcile_queries, store_queries
from haulmark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analytics_queries", "cdc_queries", "ledger_queries", "reconcile_queries", "store_queries"]
