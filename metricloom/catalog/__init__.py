"""Every registered query: a Spark job over the test tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations


def all_queries() -> dict:
    """Name to query, after loading every module that registers some."""
    from metricloom.catalog import alerting, plumbing  # noqa: F401
    from metricloom.catalog.registry import QUERIES

    return QUERIES
