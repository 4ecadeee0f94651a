"""The registered queries and, where SQL can say it, the same result as DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("scans", "merging", "drift", "mapping", "quarantine", "drift_events", "runs", "outbox", "store_runs", "feed_runs", "status")


def all_queries() -> dict:
    return {name: query for group in GROUPS for name, query in import_module(f"{__name__}.{group}").QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for group in GROUPS for name, sql in import_module(f"{__name__}.{group}").ORACLES.items()}
