"""Contribution, trend, drivers, breaks, constants and shape of analysis results."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import one_row
from ledgerloom.metrics.registry import metric
from ledgerloom.operators import insights as i
from ledgerloom.plans import analyses as a
from ledgerloom.workload.common import Query, on_distributor

DRIVERS = ["dim_customer.segment", "dim_item.category", "dim_customer.region", "dim_location.region"]


def _signed_segments(wh: Any) -> DataFrame:
    """Revenue against the year before per segment: some changes are negative."""
    from ledgerloom.periods import Period

    changed = metric("total_revenue").compare(wh, Period.year(2000), Period.year(1999), by=["dim_customer.segment"])
    return i.contribution(changed, "segment", "delta")


def _shapes(wh: Any) -> DataFrame:
    frames = {
        "total": metric("total_revenue").compute(wh),
        "segments": a.revenue_by_segment(wh),
        "months": a.revenue_by_month(wh),
        "nothing": a.revenue_by_segment(wh).where("revenue < 0"),
    }
    rows = [
        i.result_shape(frame).withColumn("v", one_row(i.applicable_views(frame))).select(F.lit(name).alias("result"), "shape", "v.*")
        for name, frame in frames.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def customer_revenue(wh: Any) -> DataFrame:
    return wh["o2c_sales_order_line"].groupBy("customer_key").agg(F.round(F.sum("ext_amount"), 2).alias("revenue"))


def late_days(wh: Any) -> DataFrame:
    return wh["p2p_purchase_order_line"].groupBy("supplier_key").agg(F.round(F.avg("late_days"), 4).alias("avg_late_days"))


def queries() -> dict[str, Query]:
    return {
        "insight_contribution": on_distributor(lambda wh: i.contribution(a.revenue_by_segment(wh), "segment", "revenue")),
        "insight_contribution_signed": on_distributor(_signed_segments),
        "insight_trend": on_distributor(lambda wh: i.trend(a.revenue_by_month(wh))),
        "insight_trend_summary": on_distributor(lambda wh: i.trend_summary(i.trend(a.revenue_by_month(wh))), 2),
        "insight_drivers_of_revenue": on_distributor(lambda wh: i.driver_breakdown(metric("total_revenue"), wh, DRIVERS[:3])),
        "insight_drivers_of_margin": on_distributor(
            lambda wh: i.driver_breakdown(metric("gross_margin_pct"), wh, [DRIVERS[0], DRIVERS[1], DRIVERS[3]])
        ),
        "insight_break_in_customer_revenue": on_distributor(lambda wh: i.natural_break(customer_revenue(wh), "revenue")),
        "insight_break_in_supplier_lateness": on_distributor(lambda wh: i.natural_break(late_days(wh), "avg_late_days")),
        "insight_first_break_in_supplier_lateness": on_distributor(
            lambda wh: i.natural_break(late_days(wh), "avg_late_days", pick="first")
        ),
        "insight_constant_columns": on_distributor(lambda wh: i.constant_columns(wh["inv_balance_snapshot"])),
        "insight_result_shapes": on_distributor(_shapes),
    }
