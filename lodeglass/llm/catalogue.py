"""The queries of this subpackage, for the driver's entry module."""

from __future__ import annotations

from lodeglass.llm.queries import ORACLES, QUERIES
from lodeglass.session import shipped


def queries() -> dict:
    return {name: shipped(query) for name, query in QUERIES.items()}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
