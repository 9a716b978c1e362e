"""Named queries over the benchmark tables and the SQL they are checked against."""

from __future__ import annotations

import importlib

MODULES = ("traversal", "audits", "duplicates", "documents")


def load():
    """(queries, oracle) with every workload module registered."""
    for m in MODULES:
        importlib.import_module(f"refloom.workload.{m}")
    from refloom.workload.base import ORACLE, QUERIES

    return QUERIES, ORACLE
