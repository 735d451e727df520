"""Registered queries and, side by side, the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ("text_queries", "kb_queries", "retrieval_queries", "usage_queries", "ticket_queries", "model_queries",
           "stream_queries")


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"kbspark.catalog.{name}")
        found.update(getattr(module, attribute))
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
