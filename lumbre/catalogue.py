"""All queries of the core, and SQL for those that have it."""

from __future__ import annotations

from lumbre import problems
from lumbre.plans import retrieval

QUERIES = {**retrieval.QUERIES, **problems.QUERIES}
ORACLE = dict(retrieval.ORACLE)
