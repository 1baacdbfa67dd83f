"""Named queries over the input tables. Importing the modules fills the registry."""

from __future__ import annotations

import importlib

MODULES = (
    "evaluation_queries",
    "row_queries",
    "table_queries",
    "order_queries",
    "dedup_queries",
    "file_queries",
    "gate_queries",
    "model_queries",
)


def all_queries():
    from labelproof.plans.registry import QUERIES

    for module in MODULES:
        importlib.import_module(f"labelproof.plans.{module}")
    return dict(QUERIES)
