"""Every governed metric, plus slices, filters and period comparisons."""

from __future__ import annotations

from datetime import date
from typing import Any

from ledgerloom.metrics.registry import ALL_METRICS, metric, validate_metrics
from ledgerloom.metrics.together import together
from ledgerloom.periods import Period
from ledgerloom.workload.common import Query, on_distributor, on_furniture, with_steps_kept

ARGUMENTS: dict[tuple[str, str], dict[str, Any]] = {
    ("furniture", "revenue_growth_yoy"): {"period": Period.year(2000)},
    ("furniture", "customer_churn_count"): {"start": date(2001, 1, 1)},
    ("furniture", "repeat_customer_rate"): {"period": Period.quarter(2000, 3)},
}

# sums over all rows: a double holds no more than cents of them at larger scales
LARGE_TOTALS = {"total_revenue", "cogs", "gross_profit"}

# accepted range of each furniture metric: value, or number of rows when grouped
FURNITURE_RANGES = {
    "total_revenue": (1e5, 1e15), "revenue_growth_yoy": (-50, 200), "average_order_value": (100, 1e6),
    "revenue_by_segment": (1, 10), "gross_margin_pct": (0, 100), "gross_profit": (0, 1e15), "cogs": (0, 1e15),
    "active_customer_count": (1, 1e12), "top_customer_concentration": (0, 100), "customer_churn_count": (0, 1e12),
    "repeat_customer_rate": (0, 100), "cancellation_rate": (0, 100), "on_time_payment_rate": (0, 100),
    "order_volume": (1, 1e12), "average_days_to_pay": (0, 365),
}


DISTRIBUTOR_RANGES = {
    "total_revenue": (1e5, 1e15), "gross_margin_pct": (0, 100), "avg_order_value": (100, 1e6), "order_count": (1, 1e12),
    "avg_order_to_ship_days": (0, 30), "return_rate_pct": (0, 1000), "dso_days": (0, 120), "ar_open_balance": (0, 1e15),
    "overdue_invoice_pct": (0, 100), "avg_days_to_pay_vs_terms": (-30, 60), "collection_days_by_segment": (1, 10),
    "dpo_days": (0, 120), "supplier_on_time_delivery_pct": (0, 100), "avg_po_late_days_by_supplier": (1, 1e9),
    "open_payables": (0, 1e15), "spend_by_supplier": (1, 1e9), "dio_days": (0, 365), "inventory_value_on_hand": (0, 1e15),
    "stockout_rate_pct": (0, 100), "inventory_turns": (0, 1000), "slow_moving_inventory_value": (0, 1e15),
    "gl_revenue_by_period": (1, 1200), "gl_cogs_trend": (1, 1200), "cash_conversion_cycle_days": (-100, 365),
    "supplier_lateness_cash_impact": (4, 4), "otif_pct": (0, 100),
}


def _plain(tenant: str, name: str) -> Query:
    on = on_furniture if tenant == "furniture" else on_distributor
    digits = 2 if name in LARGE_TOTALS else 4
    return on(lambda wh: metric(name, tenant).compute(wh, **ARGUMENTS.get((tenant, name), {})), digits)


def _sliced(name: str, tenant: str = "distributor", **arguments: Any) -> Query:
    on = on_furniture if tenant == "furniture" else on_distributor
    return on(lambda wh: metric(name, tenant).compute(wh, **arguments))


def _compared(name: str, current: Period, prior: Period, tenant: str = "distributor", **arguments: Any) -> Query:
    on = on_furniture if tenant == "furniture" else on_distributor
    return on(lambda wh: metric(name, tenant).compare(wh, current, prior, **arguments))


def _board(names: str, by: list[str], tenant: str = "distributor", **arguments: Any) -> Query:
    """The named metrics side by side."""
    listed = names.split()
    shown = [a.split(".")[1] for a in by] + listed
    on = on_furniture if tenant == "furniture" else on_distributor
    return on(lambda wh: together(wh, [metric(n, tenant) for n in listed], by, **arguments).select(*shown), 2)


def queries() -> dict[str, Query]:
    found = {f"{tenant}_{name}": _plain(tenant, name) for tenant, name in ALL_METRICS}
    found |= {
        "revenue_by_segment_region_year": _sliced(
            "total_revenue", by=["dim_customer.segment", "dim_customer.region", "dim_date.year_num"]
        ),
        "revenue_by_category_and_company": _sliced(
            "total_revenue", by=["dim_item.category", "dim_subsidiary.subsidiary_name"], period=Period.year(2000)
        ),
        "revenue_of_two_segments_by_quarter": _sliced(
            "total_revenue", by=["dim_date.year_num", "dim_date.quarter_num"],
            where={"dim_customer.segment": ["BUILDING", "MACHINERY"], "dim_customer.region": "ASIA"},
        ),
        "revenue_in_date_range_by_month": _sliced(
            "total_revenue", by=["dim_date.month_num"], period=Period.between(date(1999, 2, 10), date(1999, 6, 20))
        ),
        "order_value_by_segment": _sliced("avg_order_value", by=["dim_customer.segment"]),
        "stockout_by_supplier_tier": _sliced("stockout_rate_pct", by=["dim_supplier.reliability_tier"]),
        "otif_by_supplier_tier": _sliced("otif_pct", by=["dim_supplier.reliability_tier"]),
        "otif_by_segment_and_year": _sliced("otif_pct", by=["dim_customer.segment", "dim_date.year_num"]),
        "return_rate_by_segment": _sliced("return_rate_pct", by=["dim_customer.segment"]),
        "dio_by_category": _sliced("dio_days", by=["dim_item.category"]),
        "dpo_by_payment_terms": _sliced("dpo_days", by=["dim_supplier.payment_terms"]),
        "open_receivables_by_terms": _sliced("ar_open_balance", by=["dim_customer.credit_terms"]),
        "stock_value_as_of_quarter": _sliced("inventory_value_on_hand", period=Period.quarter(2000, 3)),
        "slow_stock_as_of_quarter": _sliced("slow_moving_inventory_value", period=Period.quarter(2000, 3)),
        "slow_stock_by_category": _sliced("slow_moving_inventory_value", by=["dim_item.category"]),
        "cash_cycle_by_year": _sliced("cash_conversion_cycle_days", by=["dim_date.year_num"]),
        "lateness_impact_customer_date": _sliced("supplier_lateness_cash_impact", method="customer_date"),
        "revenue_by_warehouse_region": _sliced("total_revenue", by=["dim_warehouse.region"]),
        "return_rate_by_quarter": _sliced("return_rate_pct", by=["dim_date.year_num", "dim_date.quarter_num"]),
        "return_rate_of_category_in_quarter": _sliced(
            "return_rate_pct", by=["dim_item.category"], period=Period.quarter(1999, 3), where={"dim_date.year_num": 1999}
        ),
        "return_rate_yoy": _compared(
            "return_rate_pct", Period.year(2000), Period.year(1999), by=["dim_customer.segment"]
        ),
        "gl_revenue_by_fiscal_period": _sliced("gl_revenue_by_period", by=["dim_date.fiscal_period"]),
        "gl_revenue_by_company": _sliced(
            "gl_revenue_by_period", by=["dim_subsidiary.subsidiary_name", "dim_date.year_num"], period=Period.year(2000)
        ),
        "gl_cogs_by_fiscal_period": _sliced("gl_cogs_trend", by=["dim_date.fiscal_period"]),
        "gl_cogs_by_company": _sliced("gl_cogs_trend", by=["dim_subsidiary.subsidiary_name", "dim_date.fiscal_period"]),
        "lateness_impact_by_warehouse": _sliced("supplier_lateness_cash_impact", by=["dim_warehouse.warehouse_name"]),
        **{
            f"furniture_{short}_by_industry": _sliced(name, "furniture", by=["dim_customer.industry"])
            for short, name in {
                "revenue": "total_revenue", "order_value": "average_order_value", "customers": "active_customer_count",
                "on_time_payment": "on_time_payment_rate", "days_to_pay": "average_days_to_pay",
            }.items()
        },
        "furniture_revenue_by_place": _sliced("total_revenue", "furniture", by=["dim_location.region", "dim_date.year"]),
        "furniture_orders_by_employee": _sliced("order_volume", "furniture", by=["dim_employee.employee_id", "dim_employee.region"]),
        "furniture_revenue_by_category_2000": _sliced(
            "total_revenue", "furniture", by=["dim_item.category"], period=Period.year(2000)
        ),
        "furniture_concentration_by_region": _sliced("top_customer_concentration", "furniture", by=["dim_customer.region"]),
        "furniture_churn_by_segment": _sliced(
            "customer_churn_count", "furniture", by=["dim_customer.customer_segment"], start=date(2001, 1, 1)
        ),
        "furniture_repeat_rate_by_region": _sliced(
            "repeat_customer_rate", "furniture", by=["dim_customer.region"], period=Period.quarter(1999, 2)
        ),
        "furniture_customers_by_quarter": _sliced(
            "active_customer_count", "furniture", by=["dim_date.year", "dim_date.quarter"]
        ),
        "revenue_yoy_by_segment": _compared(
            "total_revenue", Period.year(2000), Period.year(1999), by=["dim_customer.segment"]
        ),
        "margin_qoq_by_category": _compared(
            "gross_margin_pct", Period.quarter(2000, 3), Period.quarter(2000, 2), by=["dim_item.category"]
        ),
        "revenue_without_prior_year": _compared("total_revenue", Period.year(1995), Period.year(1994)),
        "cancellation_qoq": _compared(
            "cancellation_rate", Period.quarter(2000, 3), Period.quarter(2000, 2), "furniture",
            by=["dim_customer.customer_segment"],
        ),
        "board_by_segment": _board(
            "total_revenue gross_margin_pct avg_order_value order_count return_rate_pct dso_days otif_pct", ["dim_customer.segment"]
        ),
        "board_by_year": _board(
            "total_revenue gross_margin_pct order_count dso_days dpo_days dio_days stockout_rate_pct inventory_turns",
            ["dim_date.year_num"], period=Period.between(date(1996, 7, 1), date(2000, 6, 30)),
        ),
        "furniture_board_by_region_and_quarter": _board(
            "total_revenue order_volume cancellation_rate active_customer_count average_days_to_pay",
            ["dim_customer.region", "dim_date.quarter"], "furniture",
        ),
        "validate_distributor_metrics": on_distributor(
            lambda wh: validate_metrics(with_steps_kept(wh), DISTRIBUTOR_RANGES), 2
        ),
        "validate_furniture_metrics": on_furniture(
            lambda wh: validate_metrics(
                wh, FURNITURE_RANGES, {n: a for (t, n), a in ARGUMENTS.items() if t == wh.tenant}
            ),
            2,
        ),
    }
    return found
