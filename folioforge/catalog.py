"""All queries by name, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .plans import catalogue, chunks, exchange, lifecycle, retrieval, streams, structure, upkeep  # noqa: F401  they register themselves
from .plans.registry import ORACLES, QUERIES

FLAGSHIP = "ret3_hybrid_search"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
