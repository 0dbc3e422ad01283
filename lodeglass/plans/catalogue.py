"""All queries outside the subpackage llm, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeglass.plans import file_queries, log_queries, pipeline, rank_queries, state_queries, text_queries
from lodeglass.session import shipped

MODULES = [text_queries, file_queries, log_queries, rank_queries, state_queries, pipeline]
FLAGSHIP = "bulk_search_context"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: shipped(query) for m in MODULES for name, query in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
