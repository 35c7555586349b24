"""Imports every query module, so that the registry is complete."""

from __future__ import annotations

from shelfspark.plans import (
    audit_queries,
    directory_queries,
    guard_queries,
    ingest_queries,
    prompt_queries,
    rate_queries,
    search_queries,
    text_queries,
    vector_queries,
    webindex_queries,
)  # noqa: F401
from shelfspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
