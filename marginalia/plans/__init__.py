"""Registered queries with their oracles, and multi-step plans (index build, weekly report)."""

from .registry import ORACLES, QUERIES
from . import catalog_corpus, catalog_jobs, catalog_sections, catalog_signals, catalog_streams  # noqa: F401  (they register their queries)

__all__ = ["ORACLES", "QUERIES"]
