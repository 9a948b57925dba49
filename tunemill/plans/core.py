"""All queries of the core, and their SQL."""

from __future__ import annotations

from tunemill.plans import calibration, corpus, evaluation, problems, proposals, retrieval, telemetry
from tunemill.plans.registry import Query

PARTS = [corpus.query, telemetry.query, evaluation.query, retrieval.query, calibration.query, proposals.query]
QUERIES: dict[str, Query] = dict(problems.QUERIES)
SQL: dict[str, str] = {}
for part in PARTS:
    QUERIES |= part.queries
    SQL |= part.sql
