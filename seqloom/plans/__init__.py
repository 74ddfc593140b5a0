"""Registered queries and their SQL, by module."""

from __future__ import annotations

import importlib

MODULES = ["targets", "data_problems", "sequences", "similarity", "relations", "records", "streams"]


def registry() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        m = importlib.import_module(f"seqloom.plans.{name}")
        queries |= m.QUERIES
        sql |= m.ORACLE
    return queries, sql
