"""Every runnable query, with its SQL counterpart where SQL can state it."""

from __future__ import annotations

import importlib

MODULES = ["filters_and_totals", "chains_and_checks", "matching_and_values", "imports_and_edits", "raw_sheets"]


def load():
    """(queries, oracle SQL, operator ids)"""
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    from .registry import OPERATOR, ORACLE, QUERIES
    return QUERIES, ORACLE, OPERATOR
