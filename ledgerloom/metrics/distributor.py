"""Metrics of the distributor tenant across sales, receivables, purchasing, stock and ledger."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.metrics.spec import Leg, Metric, Where, count, total
from ledgerloom.operators.ranking import exact_quantile
from ledgerloom.periods import Period
from ledgerloom.session import computed_once

OTIF_HIT = "ship_date is not null and ship_date <= promised_ship_date and qty_shipped >= qty_ordered"


def sales(parts: dict, **more: Any) -> Leg:
    return Leg("o2c_sales_order_line", parts, day="order_date", **more)


def stock(parts: dict, **more: Any) -> Leg:
    return Leg("inv_balance_snapshot", parts, day="snapshot_date", **more)


def purchases(parts: dict) -> Leg:
    return Leg("p2p_purchase_order_line", parts, day="po_date")


def shipments(parts: dict) -> Leg:
    return Leg("o2c_fulfillment_line", parts, day="ship_date")


COLLECTED = Leg(
    "ar_payment_application",
    {"collect_weight": total("days_to_pay * amount_applied"), "collected": total("amount_applied")},
    day="payment_date",
)
PAID = Leg(
    "p2p_bill_payment",
    {"pay_weight": total("days_to_pay * amount_paid"), "paid": total("amount_paid")},
    day="payment_date",
)
DAILY_STOCK = stock(
    {"daily": total("value_on_hand")},
    per=("snapshot_date",), outer={"stock": total("daily"), "stock_days": count("daily")},
)
DAILY_COST = sales(
    {"cost": total("ext_cost")},
    per=("order_date",), outer={"cogs": total("cost"), "cogs_days": count("order_date")},
)
STOCKOUT = stock({"out": total("case when is_stockout then 100D else 0D end"), "snapshots": count()})
# goods are bought for an order: its shipment knows the site
LATENESS = replace(
    purchases({"late": total("late_days"), "po_lines": count("late_days")}),
    borrow={"dim_warehouse": ("po_number", "o2c_fulfillment_line", "so_line_key")},
)
SHIP_DAYS = shipments({"ship_days": total("order_to_ship_days"), "shipments": count("order_to_ship_days")})

DSO = "try_divide(collect_weight, collected)"
DPO = "try_divide(pay_weight, paid)"
DIO = "try_divide(try_divide(stock, stock_days), try_divide(cogs, cogs_days))"


def ledger(account: str) -> Leg:
    """Monthly balances of an account; companies and periods come from the journal they sum up."""
    keep = f"account_name = '{account}'"
    return Leg(
        "gl_account_balance", {"balance": total("period_balance")}, keep=keep,
        local={
            "dim_date.year_num": "year_num", "dim_date.month_num": "month_num",
            "dim_date.fiscal_period": "concat('FY', lpad(year_num % 100, 2, '0'), '-Q', cast(ceil(month_num / 3) as int))",
        },
        detail=Leg("gl_journal_line", {"balance": total("net_amount")}, keep=keep, day="posting_date"),
    )


def latest_snapshot(wh: Any, period: Period | None = None) -> DataFrame:
    """Stock on the last snapshot day, of the period if one is given.

    The day is a scalar subquery, so it prunes the scan.
    """
    snapshots = wh["inv_balance_snapshot"]
    if period is not None:
        snapshots = snapshots.where(period.on(F.col("snapshot_date")))
    return snapshots.where(F.col("snapshot_date") == snapshots.agg(F.max("snapshot_date")).scalar())


def item_velocity(wh: Any) -> DataFrame:
    return computed_once(wh["o2c_fulfillment_line"].groupBy("item_key").agg(F.sum("qty_shipped").alias("units")))


def slow_items(wh: Any, quantile: float = 0.2) -> DataFrame:
    velocity = item_velocity(wh)
    cutoff = exact_quantile(velocity, "units", quantile)
    return velocity.where(F.col("units") <= cutoff.scalar()).select("item_key")


def slow_stock_value(
    wh: Any, by: Sequence[str], period: Period | None, where: Where | None, quantile: float = 0.2
) -> DataFrame:
    """Latest stock value of the items in the lowest quantile of units shipped."""
    leg = stock(
        {"value": total("value_on_hand")},
        as_of=lambda w, period: latest_snapshot(w, period).join(slow_items(w, quantile), "item_key", "left_semi"),
    )
    metric = replace(
        METRICS["slow_moving_inventory_value"], custom=None, legs=(leg,), values={"slow_moving_inventory_value": "value"}
    )
    return metric.compute(wh, by=by, period=period, where=where)


def _slack(wh: Any) -> DataFrame:
    """Days beyond terms, summed per customer and day before the customer is joined."""
    paid = wh["ar_payment_application"].groupBy("customer_key", "payment_date").agg(
        F.sum("days_to_pay").alias("days"), F.count("days_to_pay").alias("payments")
    )
    terms = wh["dim_customer"].select(F.col("customer_key"), "credit_days")
    return paid.join(terms, "customer_key").withColumn("slack", F.col("days") - F.col("credit_days") * F.col("payments"))


def paid_invoices(wh: Any) -> DataFrame:
    return wh["ar_payment_application"].join(wh["ar_invoice"].select("invoice_key", "due_date"), "invoice_key")


def promised_and_shipped(wh: Any) -> DataFrame:
    """Every sales line with its shipment, if any."""
    shipped = wh["o2c_fulfillment_line"].select("so_line_key", "ship_date", "qty_shipped")
    return wh["o2c_sales_order_line"].join(shipped, "so_line_key", "left")


def collections_of_shipments(method: str) -> Leg:
    """Collection days of invoices, weighted by amount, at shipment-line keys.

    ``customer_date`` pairs invoices with shipments of the same customer and day, so an
    invoice weighs once per such shipment. Both sides are summed to that pair of keys
    first, which gives the same weights without building the pairs. ``line_key`` uses the
    one-to-one line key.
    """

    def by_customer_and_day(wh: Any) -> DataFrame:
        invoices = wh["ar_invoice"].select("invoice_key", F.col("invoice_date").alias("ship_date"))
        paid = (
            wh["ar_payment_application"].select("invoice_key", "customer_key", "days_to_pay", "amount_applied")
            .join(invoices, "invoice_key")
            .groupBy("customer_key", "ship_date")
            .agg(F.sum(F.col("days_to_pay") * F.col("amount_applied")).alias("weight"), F.sum("amount_applied").alias("amount"))
        )
        lines = wh["o2c_fulfillment_line"].groupBy("customer_key", "ship_date", "item_key", "warehouse_key").agg(
            F.count(F.lit(1)).alias("lines")
        )
        return lines.join(paid, ["customer_key", "ship_date"])

    def by_line(wh: Any) -> DataFrame:
        paid = wh["ar_payment_application"].select(
            F.col("invoice_key").alias("so_line_key"),
            (F.col("days_to_pay") * F.col("amount_applied")).alias("weight"),
            F.col("amount_applied").alias("amount"),
        )
        return wh["o2c_fulfillment_line"].join(paid, "so_line_key").withColumn("lines", F.lit(1))

    sources = {"customer_date": by_customer_and_day, "line_key": by_line}
    return Leg(
        "o2c_fulfillment_line",
        {"collect_weight": total("weight * lines"), "collected": total("amount * lines")},
        day="ship_date", source=sources[method],
    )


def lateness_impact(
    wh: Any, by: Sequence[str], period: Period | None, where: Where | None, method: str = "line_key"
) -> DataFrame:
    """Lateness, stockouts, shipping and collection days side by side."""
    base = METRICS["supplier_lateness_cash_impact"]
    legs = (LATENESS, STOCKOUT, SHIP_DAYS, collections_of_shipments(method))
    return replace(base, custom=None, legs=legs, complete=True).compute(wh, by=by, period=period, where=where)


_YQ = ("dim_date.year_num", "dim_date.quarter_num")
_YQM = (*_YQ, "dim_date.month_num")
_CUSTOMER = ("dim_customer.segment", "dim_customer.region")
_TERMS = (*_CUSTOMER, "dim_customer.credit_terms")
_SUPPLIER = ("dim_supplier.supplier_name", "dim_supplier.reliability_tier", "dim_supplier.region")
_COMPANY = "dim_subsidiary.subsidiary_name"
_SITE = "dim_warehouse.warehouse_name"
_CATEGORY = "dim_item.category"
_TIER = "dim_supplier.reliability_tier"


def _metric(name: str, domain: str, sentiment: str, owner: str, fmt: str, description: str, dims: tuple, **more: Any) -> Metric:
    return Metric(name, "distributor", domain, sentiment, owner, fmt, description, dims, **more)


_ALL = [
    _metric(
        "total_revenue", "Order to Cash", "positive", "Finance", "currency", "Value of all sales lines.",
        (*_CUSTOMER, _CATEGORY, "dim_warehouse.region", _COMPANY, *_YQM),
        legs=(sales({"revenue": total("ext_amount")}),), values={"total_revenue": "revenue"},
        grain="company", synonyms=("revenue", "sales"), questions=("How much did we sell?",),
        formula="SUM(ext_amount) FROM o2c_sales_order_line",
    ),
    _metric(
        "gross_margin_pct", "Order to Cash", "positive", "Finance", "percentage", "Margin as a percentage of revenue.",
        (_CATEGORY, *_CUSTOMER, *_YQ),
        legs=(sales({"revenue": total("ext_amount"), "margin": total("ext_amount - ext_cost")}),),
        values={"gross_margin_pct": "try_divide(margin, revenue) * 100D"},
        grain="company", synonyms=("margin",), questions=("What is our margin?",),
        formula="SUM(margin_amount) / SUM(ext_amount) FROM o2c_sales_order_line",
    ),
    _metric(
        "avg_order_value", "Order to Cash", "positive", "Sales", "currency", "Mean total of an order.",
        (*_CUSTOMER, _CATEGORY, *_YQ),
        legs=(
            sales(
                {"order_total": total("ext_amount")},
                per=("so_line_key",), outer={"revenue": total("order_total"), "orders": count("order_total")},
            ),
        ),
        values={"avg_order_value": "try_divide(revenue, orders)"},
        grain="order", synonyms=("aov",), questions=("How large is an order?",),
        formula="AVG(order total) FROM o2c_sales_order_line",
    ),
    _metric(
        "order_count", "Order to Cash", "positive", "Sales", "integer", "Distinct orders.",
        (*_CUSTOMER, _SITE, *_YQM),
        legs=(sales({}, per=("so_line_key",), outer={"orders": count("so_line_key")}),), values={"order_count": "orders"},
        grain="company", synonyms=("orders",), questions=("How many orders do we have?",),
        formula="COUNT(DISTINCT so_number) FROM o2c_sales_order_line",
    ),
    _metric(
        "avg_order_to_ship_days", "Order to Cash", "negative", "Operations", "days", "Mean days from order to shipment.",
        (_SITE, _CATEGORY, "dim_customer.segment", *_YQ),
        legs=(SHIP_DAYS,), values={"avg_order_to_ship_days": "try_divide(ship_days, shipments)"},
        grain="shipment", synonyms=("shipping speed",), questions=("How fast do we ship?",),
        formula="AVG(order_to_ship_days) FROM o2c_fulfillment_line",
    ),
    _metric(
        "return_rate_pct", "Order to Cash", "negative", "Operations", "percentage", "Returned lines per hundred sales lines, by the day of the order.",
        (_CATEGORY, "dim_customer.segment", *_YQ),
        legs=(
            Leg(
                "o2c_return_line", {"returns": count()},
                borrow={"dim_date": ("so_line_key", "o2c_sales_order_line", "so_line_key")}, borrowed_day="order_date",
            ),
            sales({"lines": count()}),
        ),
        values={"return_rate_pct": "try_divide(returns * 100D, lines)"},
        grain="company", synonyms=("returns",), questions=("How much comes back?",),
        formula="COUNT(o2c_return_line) * 100 / COUNT(o2c_sales_order_line)",
    ),
    _metric(
        "dso_days", "Receivables", "negative", "Finance", "days",
        "Collection days weighted by amount. Only paid invoices are in it, so slow unpaid ones are not seen.",
        (*_TERMS, *_YQ), legs=(COLLECTED,), values={"dso_days": DSO},
        grain="company", synonyms=("dso",), questions=("How long until we collect?",),
        formula="SUM(days_to_pay * amount_applied) / SUM(amount_applied) FROM ar_payment_application",
    ),
    _metric(
        "ar_open_balance", "Receivables", "negative", "Finance", "currency", "Receivables still open.",
        (*_TERMS, _COMPANY),
        legs=(Leg("ar_invoice", {"open": total("open_balance")}, day="invoice_date"),), values={"ar_open_balance": "open"},
        grain="company", synonyms=("open receivables",), questions=("How much are we owed?",),
        formula="SUM(open_balance) FROM ar_invoice",
    ),
    _metric(
        "overdue_invoice_pct", "Receivables", "negative", "Finance", "percentage", "Share of payments made after the due date.",
        (*_TERMS, *_YQ),
        legs=(
            Leg(
                "ar_payment_application",
                {"overdue": count("case when payment_date > due_date then 1 end"), "payments": count()},
                day="payment_date", source=paid_invoices,
            ),
        ),
        values={"overdue_invoice_pct": "try_divide(overdue * 100D, payments)"},
        grain="paid invoice", synonyms=("late payments",), questions=("How many invoices are paid late?",),
        formula="COUNT(payment_date > due_date) * 100 / COUNT(*) FROM ar_invoice JOIN ar_payment_application",
    ),
    _metric(
        "avg_days_to_pay_vs_terms", "Receivables", "negative", "Finance", "days", "Mean days beyond the agreed terms.",
        (*_TERMS, "dim_date.year_num"),
        legs=(
            Leg(
                "ar_payment_application", {"slack": total("slack"), "payments": total("payments")},
                day="payment_date", source=_slack,
            ),
        ),
        values={"avg_days_to_pay_vs_terms": "try_divide(slack, payments)"},
        grain="payment", synonyms=("days beyond terms",), questions=("How late against terms do they pay?",),
        formula="AVG(days_to_pay - credit_days) FROM ar_payment_application JOIN dim_customer",
    ),
    _metric(
        "collection_days_by_segment", "Receivables", "none", "Finance", "days", "Weighted collection days per segment.",
        (*_CUSTOMER, *_YQ), legs=(COLLECTED,), values={"collection_days": DSO}, default_by=("dim_customer.segment",),
        grain="segment", synonyms=("dso by segment",), questions=("Which segment pays slowest?",),
        formula="SUM(days_to_pay * amount_applied) / SUM(amount_applied) FROM ar_payment_application JOIN dim_customer",
    ),
    _metric(
        "dpo_days", "Procurement", "positive", "Finance", "days", "Days to pay suppliers weighted by amount; paid bills only.",
        ("dim_supplier.payment_terms", _TIER, _COMPANY, *_YQ), legs=(PAID,), values={"dpo_days": DPO},
        grain="company", synonyms=("dpo",), questions=("How fast do we pay suppliers?",),
        formula="SUM(days_to_pay * amount_paid) / SUM(amount_paid) FROM p2p_bill_payment",
    ),
    _metric(
        "supplier_on_time_delivery_pct", "Procurement", "positive", "Operations", "percentage",
        "Share of purchase lines received without delay.",
        (*_SUPPLIER, _CATEGORY, *_YQ),
        legs=(purchases({"on_time": count("case when late_days = 0 then 1 end"), "po_lines": count()}),),
        values={"supplier_on_time_delivery_pct": "try_divide(on_time * 100D, po_lines)"},
        grain="purchase line", synonyms=("on-time delivery",), questions=("Who delivers on time?",),
        formula="COUNT(late_days = 0) * 100 / COUNT(*) FROM p2p_purchase_order_line",
    ),
    _metric(
        "avg_po_late_days_by_supplier", "Procurement", "negative", "Operations", "days", "Mean days late per supplier.",
        (*_SUPPLIER, *_YQ),
        legs=(purchases({"late": total("late_days"), "known": count("late_days"), "po_lines": count()}),),
        values={"avg_late_days": "try_divide(late, known)", "po_lines": "po_lines"},
        default_by=("dim_supplier.supplier_name", _TIER),
        grain="supplier", synonyms=("late suppliers",), questions=("Which suppliers are latest?",),
        formula="AVG(late_days), COUNT(*) FROM p2p_purchase_order_line JOIN dim_supplier",
    ),
    _metric(
        "open_payables", "Procurement", "none", "Finance", "currency", "Supplier bills still open.",
        ("dim_supplier.supplier_name", "dim_supplier.payment_terms", _COMPANY),
        legs=(Leg("p2p_vendor_bill", {"open": total("open_balance")}),), values={"open_payables": "open"},
        grain="company", synonyms=("accounts payable",), questions=("What do we owe suppliers?",),
        formula="SUM(open_balance) FROM p2p_vendor_bill",
    ),
    _metric(
        "spend_by_supplier", "Procurement", "none", "Operations", "currency", "Purchasing per supplier and its share.",
        (*_SUPPLIER, _CATEGORY, "dim_date.year_num"),
        legs=(purchases({"spend": total("ext_cost")}),), values={"spend": "spend"}, share="spend",
        default_by=("dim_supplier.supplier_name", _TIER),
        grain="supplier", synonyms=("supplier spend",), questions=("Where does the purchasing money go?",),
        formula="SUM(ext_cost) FROM p2p_purchase_order_line JOIN dim_supplier",
    ),
    _metric(
        "dio_days", "Inventory", "negative", "Operations", "days", "Mean daily stock value over mean daily cost of sales.",
        (_SITE, _CATEGORY, *_YQ), legs=(DAILY_STOCK, DAILY_COST), values={"dio_days": DIO},
        grain="company", synonyms=("inventory days",), questions=("How long does stock sit?",),
        formula="AVG(daily value_on_hand) / (SUM(ext_cost) / days) FROM inv_balance_snapshot, o2c_sales_order_line",
    ),
    _metric(
        "inventory_value_on_hand", "Inventory", "none", "Operations", "currency", "Stock value on the last snapshot day.",
        (_SITE, _CATEGORY, _COMPANY),
        legs=(stock({"value": total("value_on_hand")}, as_of=latest_snapshot),), values={"inventory_value_on_hand": "value"},
        grain="company", synonyms=("stock value",), questions=("What is our stock worth?",),
        formula="SUM(value_on_hand) FROM inv_balance_snapshot ON the last day",
    ),
    _metric(
        "stockout_rate_pct", "Inventory", "negative", "Operations", "percentage", "Share of snapshot rows without stock.",
        (_SITE, _CATEGORY, _TIER, *_YQ), legs=(STOCKOUT,), values={"stockout_rate_pct": "try_divide(out, snapshots)"},
        grain="item, site and day", synonyms=("stockouts",), questions=("How often do we run out?",),
        formula="AVG(is_stockout) * 100 FROM inv_balance_snapshot",
    ),
    _metric(
        "inventory_turns", "Inventory", "positive", "Operations", "integer", "Yearly cost of sales over mean stock value.",
        (_SITE, _CATEGORY, "dim_date.year_num"), legs=(DAILY_STOCK, DAILY_COST),
        values={"inventory_turns": "try_divide(try_divide(cogs, cogs_days) * 365D, try_divide(stock, stock_days))"},
        grain="company", synonyms=("turnover",), questions=("How often does stock turn?",),
        formula="SUM(ext_cost) / days * 365 / AVG(daily value_on_hand) FROM o2c_sales_order_line, inv_balance_snapshot",
    ),
    _metric(
        "slow_moving_inventory_value", "Inventory", "negative", "Operations", "currency",
        "Latest stock value of the slowest fifth of the items.", (_SITE, _CATEGORY),
        custom=slow_stock_value, grain="company", synonyms=("dead stock",), questions=("How much sits in slow movers?",),
        formula="SUM(value_on_hand) of items in the lowest fifth FROM inv_balance_snapshot, o2c_fulfillment_line",
    ),
    _metric(
        "gl_revenue_by_period", "General Ledger", "positive", "Finance", "currency", "Revenue account movement per month.",
        ("dim_date.year_num", "dim_date.month_num", "dim_date.fiscal_period", _COMPANY),
        legs=(ledger("Revenue"),),
        values={"gl_revenue": "-balance"}, default_by=("dim_date.year_num", "dim_date.month_num"),
        grain="month", synonyms=("ledger revenue",), questions=("What revenue do the books show?",),
        formula="-SUM(period_balance) FROM gl_account_balance JOIN dim_gl_account JOIN dim_date",
    ),
    _metric(
        "gl_cogs_trend", "General Ledger", "negative", "Finance", "currency", "Cost account movement per month.",
        ("dim_date.year_num", "dim_date.month_num", "dim_date.fiscal_period", _COMPANY),
        legs=(ledger("COGS"),),
        values={"gl_cogs": "balance"}, default_by=("dim_date.year_num", "dim_date.month_num"),
        grain="month", synonyms=("ledger cost",), questions=("How does cost develop in the books?",),
        formula="SUM(period_balance) FROM gl_account_balance JOIN dim_gl_account JOIN dim_date",
    ),
    _metric(
        "cash_conversion_cycle_days", "Working Capital", "negative", "Finance", "days", "DSO plus DIO less DPO.",
        _YQ, legs=(COLLECTED, DAILY_STOCK, DAILY_COST, PAID),
        values={"cash_conversion_cycle_days": f"{DSO} + {DIO} - {DPO}"},
        grain="company", synonyms=("ccc",), questions=("How long is cash tied up?",),
        formula="DSO + DIO - DPO FROM ar_payment_application, inv_balance_snapshot, o2c_sales_order_line, p2p_bill_payment",
    ),
    _metric(
        "supplier_lateness_cash_impact", "Working Capital", "negative", "Finance", "days",
        "Lateness, stockouts, shipping and collection days per supplier tier.",
        (_TIER, "dim_supplier.supplier_name", _CATEGORY, _SITE),
        custom=lateness_impact, default_by=(_TIER,),
        values={
            "avg_late_days": "try_divide(late, po_lines)",
            "stockout_pct": "try_divide(out, snapshots)",
            "avg_order_to_ship_days": "try_divide(ship_days, shipments)",
            "days_to_collect": DSO,
        },
        grain="tier", synonyms=("supplier cash impact",), questions=("Do late suppliers slow our cash?",),
        formula="late_days, stockouts, order_to_ship_days, days_to_pay FROM p2p_purchase_order_line, inv_balance_snapshot, "
        "o2c_fulfillment_line, ar_invoice, ar_payment_application JOIN dim_supplier",
    ),
    _metric(
        "otif_pct", "Order to Cash", "positive", "Operations", "percentage",
        "Share of sales lines shipped on time and in full; a line never shipped is a miss.",
        (_SITE, _CATEGORY, "dim_customer.segment", _TIER, *_YQ),
        legs=(sales({"hits": count(f"case when {OTIF_HIT} then 1 end"), "lines": count()}, source=promised_and_shipped),),
        values={"otif_pct": "try_divide(hits * 100D, lines)"},
        grain="sales line", synonyms=("otif", "perfect orders"), questions=("How often do we keep our promise?",),
        formula="COUNT(on time and in full) * 100 / COUNT(*) FROM o2c_sales_order_line LEFT JOIN o2c_fulfillment_line",
    ),
]

METRICS: dict[str, Metric] = {m.name: m for m in _ALL}
