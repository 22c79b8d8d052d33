"""Names of the registered queries, each with its check in SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import PAPERS_SQL, papers

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir). ``{papers}`` in the SQL stands for
    the common table expressions of the papers view."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = build
        if sql is not None:
            CHECKS[name] = sql
        return build

    return add


def over_papers(name: str, sql: str | None = None, ctes: str = ""):
    """Register a function of the papers table; the SQL sees ``papers`` and
    ``counted`` and any further expressions given."""
    full = None if sql is None else f"WITH {PAPERS_SQL}{', ' + ctes if ctes else ''}\n{sql}"

    def add(build: Callable[[DataFrame], DataFrame]):
        query(name, full)(lambda spark, sf_dir: build(papers(spark, sf_dir)))
        return build

    return add
