"""Metrics of the furniture tenant: orders, margins, customers and payments."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.metrics.spec import (
    Leg, Metric, Where, aggregate_leg, count, highest, lowest, output_names, total,
)
from ledgerloom.operators.ranking import top_n_per_group
from ledgerloom.periods import Period
from ledgerloom.session import computed_once

ACTIVE = "order_status not in ('Cancelled', 'Pending')"
CATEGORY_ON_ORDER = {"dim_item.category": "primary_item_category"}


def orders_leg(parts: dict, keep: str | None = ACTIVE, **more: Any) -> Leg:
    return Leg("fact_sales_order", parts, keep=keep, day="order_date", local=CATEGORY_ON_ORDER, **more)


REVENUE = orders_leg({"revenue": total("total_amount")})
COST = total("effective_unit_cost * line_count")


def growth_yoy(wh: Any, by: Sequence[str], period: Period | None, where: Where | None) -> DataFrame:
    """Growth on the same period a year earlier; NULL without a prior year."""
    if period is None:
        raise ValueError("revenue_growth_yoy needs a period")
    compared = METRICS["total_revenue"].compare(wh, period, period.prior_year(), by, where)
    return compared.select(*output_names(by), F.col("pct_change").alias("revenue_growth_yoy"))


def customer_concentration(
    wh: Any, by: Sequence[str], period: Period | None, where: Where | None, n: int = 5
) -> DataFrame:
    """Share of revenue that the n largest customers hold."""
    names = output_names(by)
    customers = computed_once(aggregate_leg(wh, REVENUE, by, period, where, {"customer_id": F.col("customer_id")}))
    order = [F.col("revenue").desc_nulls_last(), F.col("customer_id")]
    largest = (
        top_n_per_group(customers, names, n, *order) if names else customers.orderBy(*order).limit(n)
    )
    # the n rows are marked by union, so the customers are not joined with themselves
    sums = (
        customers.select(*names, F.col("revenue").alias("everyone"))
        .unionByName(largest.select(*names, F.col("revenue").alias("largest")), allowMissingColumns=True)
        .groupBy(*names)
        .agg(F.sum("largest").alias("largest"), F.sum("everyone").alias("everyone"))
    )
    share = F.try_divide(F.col("largest") * 100.0, F.col("everyone"))
    return sums.select(*names, share.alias("top_customer_concentration"))


def churned_customers(
    wh: Any,
    by: Sequence[str],
    period: Period | None,
    where: Where | None,
    start: date | None = None,
    quiet_days: int = 90,
) -> DataFrame:
    """Customers with no order since the start, and one more than ``quiet_days`` before it.

    First and last order day per customer decide both conditions in one pass.
    """
    start = start or (period.start if period else None)
    if start is None:
        raise ValueError("customer_churn_count needs a start day or a period")
    leg = orders_leg({"first_day": lowest("order_date"), "last_day": highest("order_date")})
    spans = aggregate_leg(wh, leg, by, None, where, {"customer_id": F.col("customer_id")})
    customers = wh["dim_customer"]
    if "status" in customers.columns:
        customers = customers.where(F.col("status").isin("Active", "Churned"))
    spans = spans.join(customers.select("customer_id"), "customer_id", "left_semi")
    gone = (F.col("last_day") < F.lit(start)) & (F.col("first_day") < F.lit(start - timedelta(days=quiet_days)))
    names = output_names(by)
    return spans.groupBy(*names).agg(F.count(F.when(gone, 1)).alias("customer_churn_count"))


def repeat_customers(
    wh: Any,
    by: Sequence[str],
    period: Period | None,
    where: Where | None,
    prior: Period | None = None,
) -> DataFrame:
    """Share of the period's customers who also ordered in the prior quarter (or ``prior``)."""
    if period is None:
        raise ValueError("repeat_customer_rate needs a period")
    prior = prior or period.prior_quarter()
    span = Period(min(period.start, prior.start), max(period.end, prior.end))
    inside = lambda p: f"order_date >= date'{p.start}' and order_date < date'{p.end}'"
    leg = orders_leg({"now": highest(inside(period)), "before": highest(inside(prior))})
    seen = aggregate_leg(wh, leg, by, span, where, {"customer_id": F.col("customer_id")})
    names = output_names(by)
    both = F.count(F.when(F.col("now") & F.col("before"), 1))
    return seen.groupBy(*names).agg(
        F.try_divide(both * 100.0, F.count(F.when(F.col("now"), 1))).alias("repeat_customer_rate")
    )


def _settled(wh: Any) -> DataFrame:
    """Payments with their invoice's dates and status."""
    invoices = wh["fact_invoice"].select("invoice_id", "invoice_date", "due_date", "status")
    return wh["fact_payment"].join(invoices, "invoice_id")


def _settled_on_calendar(wh: Any) -> DataFrame:
    """As above, keeping rows whose invoice and payment day are both in the calendar."""
    # one row per day of history: small whatever the facts hold
    calendar = F.broadcast(wh["dim_date"].select("full_date"))
    invoiced = calendar.withColumnRenamed("full_date", "invoice_date")
    paid = calendar.withColumnRenamed("full_date", "payment_date")
    return _settled(wh).join(invoiced, "invoice_date").join(paid, "payment_date")


_CUSTOMER = ("dim_customer.region", "dim_customer.customer_segment")
_YEAR_QUARTER = ("dim_date.year", "dim_date.quarter")
_YQM = (*_YEAR_QUARTER, "dim_date.month")


def _metric(name: str, domain: str, sentiment: str, owner: str, fmt: str, description: str, dims: tuple, **more: Any) -> Metric:
    return Metric(name, "furniture", domain, sentiment, owner, fmt, description, dims, **more)


_ALL = [
    _metric(
        "total_revenue", "Revenue", "positive", "Finance", "currency",
        "Value of orders that are neither cancelled nor pending.",
        (*_CUSTOMER, "dim_customer.industry", *_YQM, "dim_item.category", "dim_location.region"),
        legs=(REVENUE,), values={"total_revenue": "revenue"},
        synonyms=("revenue", "sales", "bookings"), questions=("How much did we book last quarter?",),
        formula=f"SUM(total_amount) FROM fact_sales_order WHERE {ACTIVE}",
    ),
    _metric(
        "revenue_growth_yoy", "Revenue", "none", "Finance", "percentage",
        "Revenue of a period against the same period a year earlier.",
        (*_CUSTOMER, "dim_item.category", "dim_date.year"),
        custom=growth_yoy, synonyms=("yearly growth", "growth rate"), questions=("How fast did we grow in 2024?",),
        formula="(current - prior) / prior * 100 FROM fact_sales_order JOIN dim_date",
    ),
    _metric(
        "average_order_value", "Revenue", "positive", "Sales", "currency",
        "Mean value of active orders.",
        (*_CUSTOMER, "dim_customer.industry", *_YEAR_QUARTER, "dim_item.category"),
        legs=(orders_leg({"revenue": total("total_amount"), "orders": count("total_amount")}),),
        values={"average_order_value": "try_divide(revenue, orders)"},
        synonyms=("aov", "order size"), questions=("What is a typical order worth?",),
        formula=f"AVG(total_amount) FROM fact_sales_order WHERE {ACTIVE}",
    ),
    _metric(
        "revenue_by_segment", "Revenue", "none", "Finance", "currency",
        "Revenue and share of the total per customer segment.",
        (*_CUSTOMER, *_YEAR_QUARTER),
        legs=(REVENUE,), values={"segment_revenue": "revenue"}, share="segment_revenue",
        default_by=("dim_customer.customer_segment",),
        synonyms=("segment mix",), questions=("Which segment brings in most revenue?",),
        formula="SUM(total_amount) FROM fact_sales_order JOIN dim_customer GROUP BY customer_segment",
    ),
    _metric(
        "gross_margin_pct", "Profitability", "positive", "Finance", "percentage",
        "Revenue less cost, as a percentage of revenue.",
        ("dim_item.category", *_CUSTOMER, *_YQM),
        legs=(orders_leg({"revenue": total("total_amount"), "cost": COST}),),
        values={"gross_margin_pct": "try_divide((revenue - cost) * 100D, revenue)"},
        synonyms=("margin", "profitability"), questions=("How profitable is each category?",),
        formula="(SUM(total_amount) - SUM(effective_unit_cost * line_count)) / SUM(total_amount) FROM fact_sales_order",
    ),
    _metric(
        "gross_profit", "Profitability", "positive", "Finance", "currency",
        "Revenue less cost in money.",
        ("dim_item.category", *_CUSTOMER, *_YQM),
        legs=(orders_leg({"profit": total("total_amount - effective_unit_cost * line_count")}),),
        values={"gross_profit": "profit"},
        synonyms=("profit",), questions=("How much profit did we make?",),
        formula="SUM(total_amount - effective_unit_cost * line_count) FROM fact_sales_order",
    ),
    _metric(
        "cogs", "Profitability", "negative", "Finance", "currency",
        "Cost of the goods in active orders.",
        ("dim_item.category", "dim_customer.region", *_YQM),
        legs=(orders_leg({"cost": COST}),), values={"cogs": "cost"},
        synonyms=("cost of goods sold",), questions=("What did our products cost us?",),
        formula="SUM(effective_unit_cost * line_count) FROM fact_sales_order",
    ),
    _metric(
        "active_customer_count", "Customer", "positive", "Sales", "integer",
        "Distinct customers with an active order.",
        (*_YQM, *_CUSTOMER, "dim_customer.industry"),
        legs=(orders_leg({}, per=("customer_id",), outer={"customers": count("customer_id")}),),
        values={"active_customer_count": "customers"},
        synonyms=("buying customers",), questions=("How many customers are buying?",),
        formula="COUNT(DISTINCT customer_id) FROM fact_sales_order",
    ),
    _metric(
        "top_customer_concentration", "Customer", "negative", "Sales", "percentage",
        "Share of revenue held by the largest customers.",
        (*_YEAR_QUARTER, "dim_customer.region"),
        custom=customer_concentration, synonyms=("customer concentration",),
        questions=("How dependent are we on a few customers?",),
        formula="SUM(top 5 customers) / SUM(all) FROM fact_sales_order",
    ),
    _metric(
        "customer_churn_count", "Customer", "negative", "Sales", "integer",
        "Former customers without an order since the start of the period.",
        (*_YEAR_QUARTER, *_CUSTOMER),
        custom=churned_customers, synonyms=("lost customers", "churn"), questions=("Which accounts went quiet?",),
        formula="COUNT(customers with no order since the start) FROM dim_customer, fact_sales_order",
    ),
    _metric(
        "repeat_customer_rate", "Customer", "positive", "Sales", "percentage",
        "Share of a quarter's customers who also bought in the quarter before.",
        (*_YEAR_QUARTER, *_CUSTOMER),
        custom=repeat_customers, synonyms=("retention",), questions=("How many customers came back?",),
        formula="COUNT(current and prior) / COUNT(current) FROM fact_sales_order",
    ),
    _metric(
        "cancellation_rate", "Operational", "negative", "Operations", "percentage",
        "Share of all orders that were cancelled.",
        (*_YQM, "dim_item.category", *_CUSTOMER),
        legs=(orders_leg({"cancelled": count("case when order_status = 'Cancelled' then 1 end"), "orders": count()}, keep=None),),
        values={"cancellation_rate": "try_divide(cancelled * 100D, orders)"},
        synonyms=("cancel rate",), questions=("How many orders get cancelled?",),
        formula="COUNT(cancelled) * 100 / COUNT(*) FROM fact_sales_order",
    ),
    _metric(
        "on_time_payment_rate", "Operational", "positive", "Finance", "percentage",
        "Share of payments on paid invoices made by the due date; counted per payment.",
        (*_YEAR_QUARTER, *_CUSTOMER, "dim_customer.industry"),
        legs=(
            Leg(
                "fact_payment",
                {"on_time": count("case when payment_date <= due_date then 1 end"), "paid": count("invoice_id")},
                keep="status = 'Paid'", day="invoice_date", source=_settled,
            ),
        ),
        values={"on_time_payment_rate": "try_divide(on_time * 100D, paid)"},
        synonyms=("payment timeliness",), questions=("Do customers pay on time?",),
        formula="COUNT(payment_date <= due_date) * 100 / COUNT(*) FROM fact_invoice JOIN fact_payment",
    ),
    _metric(
        "order_volume", "Operational", "positive", "Sales", "integer",
        "Number of orders in any status.",
        (*_YQM, *_CUSTOMER, "dim_item.category", "dim_employee.region", "dim_employee.employee_id"),
        legs=(orders_leg({"orders": count("order_id")}, keep=None),), values={"order_volume": "orders"},
        synonyms=("order count",), questions=("How many orders came in?",),
        formula="COUNT(order_id) FROM fact_sales_order",
    ),
    _metric(
        "average_days_to_pay", "Operational", "negative", "Finance", "days",
        "Mean days from invoice to payment.",
        (*_YEAR_QUARTER, *_CUSTOMER, "dim_customer.industry"),
        legs=(
            Leg(
                "fact_payment",
                {"days": total("datediff(payment_date, invoice_date)"), "payments": count("datediff(payment_date, invoice_date)")},
                day="invoice_date", source=_settled_on_calendar,
            ),
        ),
        values={"average_days_to_pay": "try_divide(days, payments)"},
        synonyms=("days sales outstanding",), questions=("How long until customers pay?",),
        formula="AVG(payment date - invoice date) FROM fact_payment JOIN fact_invoice JOIN dim_date",
    ),
]

METRICS: dict[str, Metric] = {m.name: m for m in _ALL}
