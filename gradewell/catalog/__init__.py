"""Queries over the test tables, each with the same question in plain SQL."""

from gradewell.catalog import plans, tables, text  # noqa: F401  (registers the queries)
from gradewell.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
