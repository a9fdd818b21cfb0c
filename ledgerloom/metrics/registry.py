"""All governed metrics, and the job that checks every one against an expected range."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.catalog import Catalog, unique_ids
from ledgerloom.metrics import distributor, sales
from ledgerloom.metrics.spec import Metric
from ledgerloom.metrics.together import together
from ledgerloom.sources.schemas import CATALOG

ALL_METRICS: dict[tuple[str, str], Metric] = {
    (m.tenant, m.name): m for group in (sales.METRICS, distributor.METRICS) for m in group.values()
}


def check_reachable(metrics: Mapping[Any, Metric], catalog: Catalog) -> None:
    """A metric may promise only dimensions that each of its legs reaches by the declared keys."""
    broken = {m.id: found for m in metrics.values() if (found := m.unreachable(catalog))}
    if broken:
        raise ValueError(f"declared dimensions without a join path: {broken}")


check_reachable(ALL_METRICS, CATALOG)


def metric(name: str, tenant: str = "distributor") -> Metric:
    found = ALL_METRICS.get((tenant, name))
    if found is None:
        raise ValueError(f"unknown metric {tenant}:{name}")
    return found


def metric_ids() -> list[str]:
    return unique_ids(m.id for m in ALL_METRICS.values())


def validate_metrics(
    wh: Any,
    ranges: Mapping[str, tuple[float, float]],
    arguments: Mapping[str, Mapping[str, Any]] | None = None,
) -> DataFrame:
    """Run each named metric and check it: a single value must lie in the range, a grouped
    metric must return a number of rows in the range.

    Metrics of one grain and period are computed together, so that a fact is read once for all
    of them; those with code of their own run by themselves.
    """
    arguments = arguments or {}
    shared: dict[tuple[Any, ...], list[Metric]] = {}
    checks = []
    for name in ranges:
        spec, given = metric(name, wh.tenant), arguments.get(name, {})
        if not spec.custom and set(given) <= {"period"}:
            shared.setdefault((spec.default_by, given.get("period")), []).append(spec)
            continue
        result = spec.compute(wh, **given)
        value = F.count(F.lit(1)) if spec.default_by else F.max(spec.value)
        checks.append(_range_checks(result.agg(value.alias(name)), [spec], ranges))
    for (by, period), specs in shared.items():
        values = together(wh, specs, by, period)
        if by:
            values = values.agg(*[F.count(F.when(F.col(f"has_{m.name}"), 1)).alias(m.name) for m in specs])
        checks.append(_range_checks(values, specs, ranges))
    return reduce(DataFrame.unionByName, checks)


def _range_checks(one_row: DataFrame, specs: Sequence[Metric], ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """A check for each metric from one row that holds what they gave."""
    rows = []
    for spec in specs:
        low, high = ranges[spec.name]
        actual = F.col(spec.name).cast("double")
        rows.append(
            F.struct(
                F.lit(spec.id).alias("check_id"),
                F.lit("rows" if spec.default_by else spec.format).alias("label"),
                F.lit(f"{low:g}..{high:g}").alias("expected"),
                actual.alias("actual"),
                F.coalesce(actual.between(float(low), float(high)), F.lit(False)).alias("passed"),
            )
        )
    return one_row.select(F.inline(F.array(*rows)))
