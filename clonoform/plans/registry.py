"""All registered queries and their SQL."""

from __future__ import annotations

from clonoform.plans import cohort_queries, receptor_queries, workflow_queries
from clonoform.plans.base import ORACLE_SQL, QUERIES

flagship = receptor_queries.flagship

__all__ = ["ORACLE_SQL", "QUERIES", "cohort_queries", "flagship", "receptor_queries", "workflow_queries"]
