"""All queries of the reference's own operators, by name, with their SQL."""

from __future__ import annotations

from . import extraction_queries, flow_queries, legal_queries, page_queries, paper_queries, predicate_queries, report_queries, scalar_queries  # noqa: F401  each registers its queries
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "ext1_personal_data"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
