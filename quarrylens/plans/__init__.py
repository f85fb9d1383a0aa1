"""Registered queries over the test tables, each with the SQL that must give the same rows."""

from quarrylens.plans import columns, outputs, shapes, tables
from quarrylens.plans.registry import Query

QUERIES: dict[str, Query] = {**tables.QUERIES, **shapes.QUERIES, **columns.QUERIES, **outputs.QUERIES}

__all__ = ["QUERIES", "Query"]
