"""All runnable queries by name."""

from __future__ import annotations

from ledgerloom.workload import (
    analysis_queries, derive_queries, insight_queries, metric_queries, quality_queries, retrieval_queries,
)
from ledgerloom.workload.common import Query

GROUPS = [metric_queries, analysis_queries, quality_queries, derive_queries, insight_queries, retrieval_queries]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for group in GROUPS:
        for name, query in group.queries().items():
            if name in found:
                raise ValueError(f"query {name} is defined twice")
            found[name] = query
    return found
