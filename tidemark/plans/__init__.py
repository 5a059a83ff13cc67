"""Registered queries: one module per part of the engine."""

from __future__ import annotations

import importlib

MODULES = ["table_queries", "aggregate_queries", "window_queries", "shift_queries", "detector_queries", "change_queries", "stream_queries"]


def all_queries():
    """(queries, oracle texts) of all parts."""
    from tidemark.plans import catalog

    for m in MODULES:
        importlib.import_module(f"tidemark.plans.{m}")
    return catalog.QUERIES, catalog.ORACLES
