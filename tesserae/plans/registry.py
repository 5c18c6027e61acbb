"""Named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import SQL as VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Views that a view is made from.
NEEDS = {"v_tracks": ["v_reports"]}


def with_views(views: list[str], sql: str, recursive: bool = False) -> str:
    """sql (a SELECT, or further common tables that begin with a comma and then a SELECT) behind the views it reads."""
    wanted = [n for v in views for n in (*NEEDS.get(v, []), v)]
    lead = ",\n".join(VIEWS[v] for v in dict.fromkeys(wanted))
    if not lead:
        return sql
    return f"WITH {'RECURSIVE ' if recursive else ''}{lead}\n{sql}"


def query(sql: str | None = None, views: list[str] | None = None, recursive: bool = False):
    """Registers a function of (spark, sf_dir) under its name, and the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(views or [], sql, recursive)
        return f

    return add
