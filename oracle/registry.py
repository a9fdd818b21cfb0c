"""All check queries by name, each with the views it needs."""

from __future__ import annotations

from oracle import analysis_sql, derive_sql, insight_sql, metric_sql, quality_sql, retrieval_sql
from oracle.views import over_views

GROUPS = [metric_sql, analysis_sql, quality_sql, derive_sql, insight_sql, retrieval_sql]


def sql() -> dict[str, str]:
    return {name: over_views(text) for group in GROUPS for name, text in group.sql().items()}
