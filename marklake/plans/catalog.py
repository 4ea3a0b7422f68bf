"""All queries of the engine and their SQL."""

from __future__ import annotations

from marklake.plans import frontmatter_queries, model_queries, structure_queries  # noqa: F401
from marklake.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
