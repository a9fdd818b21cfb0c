"""The business analyses."""

from __future__ import annotations

from datetime import date

from ledgerloom.metrics.distributor import METRICS
from ledgerloom.periods import Period
from ledgerloom.plans import analyses as a
from ledgerloom.workload.common import Query, on_distributor, on_furniture


def queries() -> dict[str, Query]:
    plain = [
        a.revenue_by_month, a.margin_by_category, a.worst_suppliers, a.on_time_delivery_by_tier, a.revenue_by_segment,
        a.stock_value_by_warehouse, a.overdue_by_segment, a.top_suppliers_by_spend, a.ledger_cost_of_year, a.slow_movers,
        a.days_beyond_terms_by_segment, a.otif_by_warehouse, a.late_suppliers_and_revenue, a.cash_cycle_components,
        a.late_but_paid_fast, a.category_stock_pressure, a.segment_revenue_and_collection, a.subsidiary_cash_cycle,
        a.suppliers_delaying_shipments, a.tier_swap_saving, a.dual_source_priority,
        a.fast_and_slow_movers, a.stockouts_in_last_quarter, a.customers_hit_twice, a.otif_misses, a.pareto_shares,
        a.slow_payers, a.unpaid_invoices, a.annual_figures, a.margin_spread,
    ]
    found = {f"analysis_{fn.__name__}": on_distributor(fn) for fn in plain}
    found |= {
        "analysis_worst_supplier_items": on_distributor(a.worst_supplier_items),
        "analysis_customer_order_trace": on_furniture(lambda wh: a.customer_order_trace(wh, [1, 2], date(2000, 10, 1))),
        "analysis_cancellations_of_category": on_furniture(lambda wh: a.cancellations_of_category(wh, "STANDARD")),
        "analysis_margin_of_category": on_furniture(lambda wh: a.margin_of_category(wh, "STANDARD", 2000)),
        "analysis_customers_last_seen": on_furniture(
            lambda wh: a.customers_last_seen(wh, Period.between(date(2000, 1, 1), date(2000, 6, 30)))
        ),
        "analysis_top_customers": on_furniture(lambda wh: a.top_customers(wh, Period.quarter(2000, 3))),
        "analysis_warehouse_overview": on_distributor(lambda wh: a.warehouse_overview(wh, len(METRICS))),
    }
    return found
