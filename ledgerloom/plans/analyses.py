"""Business analyses that put several facts side by side.

Each fact is aggregated to the shared grain before anything is joined, so joins between
facts see one row per key and a hot key costs no more than any other. Every ranking ends
with a unique key.
"""

from __future__ import annotations

from datetime import date
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import measures as ms
from ledgerloom.functions.scalars import one_row
from ledgerloom.metrics.distributor import (
    OTIF_HIT, item_velocity, latest_snapshot, paid_invoices, promised_and_shipped, slow_items,
)
from ledgerloom.metrics.registry import metric
from ledgerloom.operators.ranking import exact_quantile, top_fraction_share, top_n, with_total
from ledgerloom.periods import Period
from ledgerloom.session import computed_once

LATE_TIERS = ("C", "D")


def _avg(total_: str, n: str) -> Column:
    return ms.ratio(F.col(total_), F.col(n))


def _supplier_names(wh: Any) -> DataFrame:
    return wh["dim_supplier"].select("supplier_key", "supplier_name", "reliability_tier")


def supplier_lateness(wh: Any) -> DataFrame:
    return wh["p2p_purchase_order_line"].groupBy("supplier_key").agg(F.avg("late_days").alias("late"))


def item_stockouts(wh: Any) -> DataFrame:
    """Per item, summed so that any coarser grain can be made from it."""
    return wh["inv_balance_snapshot"].groupBy("item_key").agg(
        F.sum(F.when(F.col("is_stockout"), 100.0).otherwise(0.0)).alias("out"), F.count(F.lit(1)).alias("snapshots")
    )


def item_shipping(wh: Any) -> DataFrame:
    return wh["o2c_fulfillment_line"].groupBy("item_key").agg(
        F.sum("order_to_ship_days").alias("ship_days"), F.count("order_to_ship_days").alias("shipments")
    )


def item_lateness(wh: Any) -> DataFrame:
    return wh["p2p_purchase_order_line"].groupBy("item_key").agg(
        F.sum("late_days").alias("late"), F.count("late_days").alias("po_lines")
    )


def item_revenue(wh: Any) -> DataFrame:
    return wh["o2c_sales_order_line"].groupBy("item_key").agg(F.sum("ext_amount").alias("revenue"))


# --- one fact, one or two dimensions -------------------------------------------------


def revenue_by_month(wh: Any) -> DataFrame:
    return metric("total_revenue").compute(wh, by=["dim_date.year_num", "dim_date.month_num"]).withColumnRenamed(
        "total_revenue", "revenue"
    )


def margin_by_category(wh: Any) -> DataFrame:
    return metric("gross_margin_pct").compute(wh, by=["dim_item.category"]).withColumnRenamed("gross_margin_pct", "gm_pct")


def worst_suppliers(wh: Any, n: int = 5) -> DataFrame:
    """Latest suppliers by mean days; the limit is taken before names are joined."""
    worst = top_n(supplier_lateness(wh), n, F.col("late").desc_nulls_last(), F.col("supplier_key"))
    return worst.join(_supplier_names(wh), "supplier_key").select("supplier_name", F.col("late").alias("avg_late_days"))


def on_time_delivery_by_tier(wh: Any) -> DataFrame:
    return metric("supplier_on_time_delivery_pct").compute(wh, by=["dim_supplier.reliability_tier"]).withColumnRenamed(
        "supplier_on_time_delivery_pct", "otd_pct"
    )


def revenue_by_segment(wh: Any) -> DataFrame:
    return metric("total_revenue").compute(wh, by=["dim_customer.segment"]).withColumnRenamed("total_revenue", "revenue")


def stock_value_by_warehouse(wh: Any) -> DataFrame:
    return metric("inventory_value_on_hand").compute(wh, by=["dim_warehouse.warehouse_name"]).withColumnRenamed(
        "inventory_value_on_hand", "inv_value"
    )


def overdue_by_segment(wh: Any) -> DataFrame:
    return metric("overdue_invoice_pct").compute(wh, by=["dim_customer.segment"]).withColumnRenamed(
        "overdue_invoice_pct", "overdue_pct"
    )


def top_suppliers_by_spend(wh: Any, n: int = 10) -> DataFrame:
    spend = wh["p2p_purchase_order_line"].groupBy("supplier_key").agg(F.sum("ext_cost").alias("spend"))
    largest = top_n(spend, n, F.col("spend").desc_nulls_last(), F.col("supplier_key"))
    return largest.join(_supplier_names(wh), "supplier_key").select("supplier_name", "spend")


def ledger_cost_of_year(wh: Any, year: int = 2000) -> DataFrame:
    return metric("gl_cogs_trend").compute(wh).where(F.col("year_num") == year)


def slow_movers(wh: Any, quantile: float = 0.2) -> DataFrame:
    stock = latest_snapshot(wh).join(slow_items(wh, quantile), "item_key", "left_semi")
    per_item = stock.groupBy("item_key").agg(F.sum("value_on_hand").alias("value"))
    return per_item.agg(F.count(F.lit(1)).alias("slow_mover_items"), F.sum("value").alias("tied_up_value"))


def days_beyond_terms_by_segment(wh: Any) -> DataFrame:
    return metric("avg_days_to_pay_vs_terms").compute(wh, by=["dim_customer.segment"]).withColumnRenamed(
        "avg_days_to_pay_vs_terms", "days_beyond_terms"
    )


def otif_by_warehouse(wh: Any) -> DataFrame:
    return metric("otif_pct").compute(wh, by=["dim_warehouse.warehouse_name"])


# --- several facts ---------------------------------------------------------------------


def late_suppliers_and_revenue(wh: Any, late_gt: float = 5, n: int = 5) -> DataFrame:
    """Late suppliers ranked by the revenue of the items they supply."""
    revenue = (
        item_revenue(wh).join(wh["item_supplier"], "item_key").groupBy("supplier_key")
        .agg(F.sum("revenue").alias("affected_revenue"))
    )
    late = supplier_lateness(wh).where(F.col("late") > late_gt).join(revenue, "supplier_key")
    ranked = top_n(late, n, F.col("affected_revenue").desc(), F.col("supplier_key"))
    return ranked.join(_supplier_names(wh), "supplier_key").select(
        "supplier_name", "reliability_tier", F.round("late", 1).alias("avg_late_days"), "affected_revenue"
    )


def cash_cycle_components(wh: Any) -> DataFrame:
    parts = [("DSO", "dso_days"), ("DIO", "dio_days"), ("DPO", "dpo_days")]
    rows = [
        metric(name).compute(wh).select(F.lit(label).alias("component"), F.col(name).alias("days"))
        for label, name in parts
    ]
    return reduce(DataFrame.unionByName, rows)


def late_but_paid_fast(wh: Any) -> DataFrame:
    """Suppliers later than average yet paid faster than average.

    The company averages come from the per-supplier sums, so each fact is read once.
    """
    late = wh["p2p_purchase_order_line"].groupBy("supplier_key").agg(
        F.sum("late_days").alias("late_sum"), F.count("late_days").alias("late_n")
    )
    late = with_total(late, ms.ratio(F.sum("late_sum"), F.sum("late_n")), "late_all")
    paid = wh["p2p_bill_payment"].groupBy("supplier_key").agg(
        F.sum(F.col("days_to_pay") * F.col("amount_paid")).alias("weight"), F.sum("amount_paid").alias("amount")
    )
    paid = with_total(paid, ms.ratio(F.sum("weight"), F.sum("amount")), "pay_all")
    both = late.where(_avg("late_sum", "late_n") > F.col("late_all")).join(
        paid.where(_avg("weight", "amount") < F.col("pay_all")), "supplier_key"
    )
    return both.join(_supplier_names(wh), "supplier_key").select(
        "supplier_name", "reliability_tier",
        F.round(_avg("late_sum", "late_n"), 1).alias("avg_late_days"),
        F.round(_avg("weight", "amount"), 1).alias("days_to_pay"),
    )


def category_stock_pressure(wh: Any) -> DataFrame:
    """Stock days and stockouts per category, worst product of the two first."""
    days = metric("dio_days").compute(wh, by=["dim_item.category"])
    stockouts = metric("stockout_rate_pct").compute(wh, by=["dim_item.category"])
    both = days.where("dio_days is not null").join(stockouts, "category")
    return both.orderBy((F.col("dio_days") * F.col("stockout_rate_pct")).desc(), "category").select(
        "category", F.round("dio_days", 1).alias("dio_days"), F.col("stockout_rate_pct").alias("stockout_pct")
    )


def segment_revenue_and_collection(wh: Any) -> DataFrame:
    revenue = metric("total_revenue").compute(wh, by=["dim_customer.segment"])
    days = metric("collection_days_by_segment").compute(wh)
    return revenue.join(days, "segment").select(
        "segment", F.col("total_revenue").alias("revenue"), F.round("collection_days", 1).alias("collection_days")
    )


def subsidiary_cash_cycle(wh: Any) -> DataFrame:
    """Cash cycle per subsidiary; one that holds no stock has zero stock days."""
    key = "subsidiary_key"
    collected = wh["ar_payment_application"].groupBy(key).agg(
        ms.weighted_avg(F.col("days_to_pay"), F.col("amount_applied")).alias("dso")
    )
    paid = wh["p2p_bill_payment"].groupBy(key).agg(ms.weighted_avg(F.col("days_to_pay"), F.col("amount_paid")).alias("dpo"))
    stock = (
        wh["inv_balance_snapshot"].groupBy(F.col(key).cast("bigint").alias(key), "snapshot_date")
        .agg(F.sum("value_on_hand").alias("daily"))
        .groupBy(key).agg(F.avg("daily").alias("daily_inv"))
    )
    cost = (
        wh["o2c_sales_order_line"].groupBy(key, "order_date").agg(F.sum("ext_cost").alias("cost"))
        .groupBy(key).agg(ms.ratio(F.sum("cost"), F.count("order_date")).alias("daily_cogs"))
    )
    joined = wh["dim_subsidiary"].join(collected, key).join(paid, key).join(cost, key).join(stock, key, "left")
    dio = F.coalesce(ms.ratio(F.col("daily_inv"), F.col("daily_cogs")), F.lit(0.0))
    return joined.select(
        "subsidiary_name",
        F.round("dso", 1).alias("dso_days"),
        F.round(dio, 1).alias("dio_days"),
        F.round("dpo", 1).alias("dpo_days"),
        F.round(F.col("dso") + dio - F.col("dpo"), 1).alias("ccc_days"),
    )


def suppliers_delaying_shipments(wh: Any, late_gt: float = 5, n: int = 10) -> DataFrame:
    shipping = (
        item_shipping(wh).join(wh["item_supplier"], "item_key").groupBy("supplier_key")
        .agg(F.sum("ship_days").alias("ship_days"), F.sum("shipments").alias("shipments"))
    )
    late = supplier_lateness(wh).where(F.col("late") > late_gt)
    ranked = top_n(late.join(shipping, "supplier_key"), n, _avg("ship_days", "shipments").desc(), F.col("supplier_key"))
    return ranked.join(_supplier_names(wh), "supplier_key").select(
        "supplier_name", "reliability_tier", F.round("late", 1).alias("avg_late_days"),
        _avg("ship_days", "shipments").alias("avg_order_to_ship_days"),
    )


def worst_supplier_items(wh: Any, late_gt: float = 5, otif_lt: float = 50, n: int = 10) -> DataFrame:
    """Supplier and item pairs that are late, out of stock and miss the promise."""
    pairs = wh["p2p_purchase_order_line"].groupBy("supplier_key", "item_key").agg(F.avg("late_days").alias("late"))
    otif = promised_and_shipped(wh).groupBy("item_key").agg(ms.rate_pct(F.expr(OTIF_HIT)).alias("otif"))
    pressed = (
        pairs.where(F.col("late") > late_gt)
        .join(otif.where(F.col("otif") < otif_lt), "item_key")
        .join(item_stockouts(wh), "item_key")
    )
    stockout = _avg("out", "snapshots")
    ranked = top_n(pressed, n, stockout.desc(), F.col("supplier_key"), F.col("item_key"))
    return (
        ranked.join(_supplier_names(wh), "supplier_key")
        .join(wh["dim_item"].select("item_key", "item_name"), "item_key")
        .select(
            "supplier_name", "reliability_tier", "item_key", "item_name", F.round("late", 1).alias("avg_late_days"),
            F.round(stockout, 1).alias("stockout_pct"), F.round("otif", 1).alias("otif_pct"),
        )
    )


def tier_swap_saving(wh: Any, worse: str = "D", better: str = "A") -> DataFrame:
    """Days per line saved if the worse tier shipped like the better one. One pass over shipments.

    No row when either tier has no shipments.
    """
    shipping = (
        item_shipping(wh).join(wh["item_supplier"], "item_key").groupBy("supplier_key")
        .agg(F.sum("ship_days").alias("ship_days"), F.sum("shipments").alias("shipments"))
        .join(_supplier_names(wh), "supplier_key")
        .where(F.col("reliability_tier").isin(worse, better))
    )
    mean = lambda tier: ms.ratio(
        F.sum(F.when(F.col("reliability_tier") == tier, F.col("ship_days"))),
        F.sum(F.when(F.col("reliability_tier") == tier, F.col("shipments"))),
    )
    return shipping.agg(
        (mean(worse) - mean(better)).alias("delay_days_eliminated_per_line"),
        F.sum(F.when(F.col("reliability_tier") == worse, F.col("shipments"))).alias("affected_shipments"),
    ).where("delay_days_eliminated_per_line is not null")


def dual_source_priority(wh: Any, n: int = 10) -> DataFrame:
    """Items to source twice first: lateness times revenue times stockout rate."""
    late, stockout = _avg("late", "po_lines"), _avg("out", "snapshots")
    items = (
        item_lateness(wh).join(item_revenue(wh), "item_key").join(item_stockouts(wh), "item_key")
        .join(wh["item_supplier"], "item_key")
    )
    score = F.round(late * F.col("revenue") * stockout, 4)
    ranked = top_n(items, n, score.desc(), F.col("item_key"))
    return (
        ranked.join(_supplier_names(wh), "supplier_key")
        .select(
            "item_key", "supplier_name", "reliability_tier", F.round(late, 1).alias("avg_late_days"),
            "revenue", F.round(stockout, 1).alias("stockout_pct"),
        )
    )


def fast_and_slow_movers(wh: Any, high: float = 0.8, low: float = 0.2) -> DataFrame:
    """Lateness, shipping and stockouts of the fastest and slowest items."""
    velocity = item_velocity(wh)
    hi, lo = (exact_quantile(velocity, "units", p).scalar() for p in (high, low))
    group = F.when(F.col("units") >= hi, "fast").when(F.col("units") <= lo, "slow")
    classed = velocity.select("item_key", group.alias("mover_group")).where("mover_group is not null")
    facts = (
        item_lateness(wh).unionByName(item_shipping(wh), allowMissingColumns=True)
        .unionByName(item_stockouts(wh), allowMissingColumns=True)
    )
    sums = ["late", "po_lines", "ship_days", "shipments", "out", "snapshots"]
    grouped = classed.join(facts, "item_key").groupBy("mover_group").agg(*[F.sum(c).alias(c) for c in sums])
    return grouped.select(
        "mover_group",
        _avg("late", "po_lines").alias("avg_supplier_late_days"),
        _avg("ship_days", "shipments").alias("avg_order_to_ship_days"),
        _avg("out", "snapshots").alias("stockout_pct"),
    )


def stockouts_in_last_quarter(wh: Any) -> DataFrame:
    season = F.when(F.month("snapshot_date").isin(10, 11, 12), "Q4").otherwise("non-Q4")
    return wh["inv_balance_snapshot"].groupBy(season.alias("period")).agg(
        ms.flag_rate_pct(F.col("is_stockout")).alias("stockout_pct")
    )


def customers_hit_twice(wh: Any, n: int = 10) -> DataFrame:
    """Customers above average both in late-tier share of revenue and in shipping days."""
    tiers = wh["item_supplier"].join(_supplier_names(wh), "supplier_key").select("item_key", "reliability_tier")
    late_amount = F.when(F.col("reliability_tier").isin(*LATE_TIERS), F.col("ext_amount")).otherwise(0.0)
    bought = (
        wh["o2c_sales_order_line"].join(tiers, "item_key").groupBy("customer_key")
        .agg(F.sum(late_amount).alias("late_revenue"), F.sum("ext_amount").alias("revenue"))
    )
    bought = with_total(bought, ms.pct(F.sum("late_revenue"), F.sum("revenue")), "share_all")
    shipped = wh["o2c_fulfillment_line"].groupBy("customer_key").agg(
        F.sum("order_to_ship_days").alias("ship_days"), F.count("order_to_ship_days").alias("shipments")
    )
    shipped = with_total(shipped, ms.ratio(F.sum("ship_days"), F.sum("shipments")), "days_all")
    share = ms.pct(F.col("late_revenue"), F.col("revenue"))
    hit = bought.where(share > F.col("share_all")).join(
        shipped.where(_avg("ship_days", "shipments") > F.col("days_all")), "customer_key"
    )
    ranked = top_n(hit, n, F.col("revenue").desc(), F.col("customer_key"))
    return ranked.join(wh["dim_customer"].select("customer_key", "customer_name"), "customer_key").select(
        "customer_name", F.round(share, 1).alias("pct_revenue_from_cd_suppliers"),
        F.round(_avg("ship_days", "shipments"), 2).alias("avg_fulfillment_days"), "revenue",
    )


def otif_misses(wh: Any) -> DataFrame:
    """Why lines missed the promise, with each cause's share of the misses."""
    late = F.col("ship_date") > F.col("promised_ship_date")
    short = F.col("qty_shipped") < F.col("qty_ordered")
    cause = (
        F.when(F.col("ship_date").isNull(), "never_shipped")
        .when(late & ~short, "late_only")
        .when(~late & short, "short_only")
        .when(late & short, "late_and_short")
    )
    misses = promised_and_shipped(wh).groupBy(cause.alias("miss_type")).agg(F.count(F.lit(1)).alias("lines"))
    misses = with_total(misses.where("miss_type is not null"), F.sum("lines"), "misses")
    return misses.select("miss_type", "lines", F.round(ms.pct(F.col("lines"), F.col("misses")), 1).alias("pct_of_misses"))


# --- concentration, payers, traces -----------------------------------------------------


def pareto_shares(wh: Any, fraction: float = 0.2) -> DataFrame:
    """Share of spend and of revenue held by the top fraction of suppliers and customers."""
    spend = wh["p2p_purchase_order_line"].groupBy("supplier_key").agg(F.sum("ext_cost").alias("v"))
    revenue = wh["o2c_sales_order_line"].groupBy("customer_key").agg(F.sum("ext_amount").alias("v"))
    sides = [("supplier", computed_once(spend)), ("customer", computed_once(revenue))]
    return reduce(
        DataFrame.unionByName,
        [top_fraction_share(f, "v", fraction).select(F.lit(who).alias("side"), "share") for who, f in sides],
    )


def slow_payers(wh: Any, slack_days: float = 12) -> DataFrame:
    """Customers whose weighted days exceed their terms by more than the slack, against the rest."""
    paid = wh["ar_payment_application"].groupBy("customer_key").agg(
        ms.weighted_avg(F.col("days_to_pay"), F.col("amount_applied")).alias("days")
    )
    terms = wh["dim_customer"].select("customer_key", "credit_days")
    group = F.when(F.col("days") - F.col("credit_days") > slack_days, "slow").otherwise("on-time")
    return paid.join(terms, "customer_key").groupBy(group.alias("payer_group")).agg(
        F.avg("days").alias("avg_days"), F.count(F.lit(1)).alias("customers")
    )


def customer_order_trace(wh: Any, customers: list[int], cutoff: date) -> DataFrame:
    """Orders per quarter of some customers, and how many came on or after a day."""
    orders = wh["fact_sales_order"].where(F.col("customer_id").isin(customers))
    counted = orders.groupBy(
        "customer_id", F.year("order_date").alias("year"), F.quarter("order_date").alias("quarter")
    ).agg(
        F.count(F.lit(1)).alias("order_count"),
        F.count(F.when(F.col("order_date") >= F.lit(cutoff), 1)).alias("orders_since_cutoff"),
    )
    return counted.join(wh["dim_customer"].select("customer_id", "customer_name"), "customer_id")


def cancellations_of_category(wh: Any, category: str) -> DataFrame:
    orders = wh["fact_sales_order"].where(F.col("primary_item_category") == category)
    cancelled = F.col("order_status") == "Cancelled"
    return orders.groupBy(F.year("order_date").alias("year"), F.quarter("order_date").alias("quarter")).agg(
        ms.count_if(cancelled).alias("cancelled"),
        F.count(F.lit(1)).alias("total"),
        F.round(ms.rate_pct(cancelled), 2).alias("cancel_pct"),
    )


def margin_of_category(wh: Any, category: str, year: int) -> DataFrame:
    """Margin per quarter of a year, with the fall from the first to the last quarter."""
    quarters = metric("gross_margin_pct", "furniture").compute(
        wh, by=["dim_date.quarter"], period=Period.year(year), where={"dim_item.category": category}
    )
    fall = F.min_by("gross_margin_pct", "quarter") - F.max_by("gross_margin_pct", "quarter")
    return with_total(quarters, fall, "first_to_last_fall")


def customers_last_seen(wh: Any, period: Period) -> DataFrame:
    """Customers whose last active order falls in the period."""
    last = wh["fact_sales_order"].where(~F.col("order_status").isin("Cancelled", "Pending")).groupBy("customer_id").agg(
        F.max("order_date").alias("last_order"), F.count(F.lit(1)).alias("orders")
    )
    seen = last.where(period.on(F.col("last_order")))
    return seen.join(wh["dim_customer"].select("customer_id", "customer_name"), "customer_id")


def top_customers(wh: Any, period: Period, n: int = 5) -> DataFrame:
    """Largest customers of a period by revenue, with their order count."""
    orders = wh["fact_sales_order"].where(
        ~F.col("order_status").isin("Cancelled", "Pending") & period.on(F.col("order_date"))
    )
    sums = orders.groupBy("customer_id").agg(F.sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("order_count"))
    ranked = top_n(sums, n, F.col("revenue").desc_nulls_last(), F.col("customer_id"))
    return ranked.join(wh["dim_customer"].select("customer_id", "customer_name"), "customer_id")


def annual_figures(wh: Any) -> DataFrame:
    """One row: yearly revenue and cost of sales, and stock and cash-cycle days on that basis.

    A year is twelve times the mean month with sales. Stock days here divide by yearly cost,
    unlike the ``dio_days`` metric, which divides by cost per day with orders.
    """
    months = wh["o2c_sales_order_line"].groupBy(F.year("order_date").alias("y"), F.month("order_date").alias("m")).agg(
        F.sum("ext_amount").alias("revenue"), F.sum("ext_cost").alias("cost")
    )
    stock = wh["inv_balance_snapshot"].groupBy("snapshot_date").agg(F.sum("value_on_hand").alias("value"))
    year = months.agg(F.avg("revenue").alias("revenue"), F.avg("cost").alias("cost")).select(
        (F.col("revenue") * 12).alias("annual_revenue"), (F.col("cost") * 12).alias("annual_cogs"),
        stock.agg(F.avg("value")).scalar().alias("average_stock"),
        metric("dso_days").compute(wh).scalar().alias("dso_days"), metric("dpo_days").compute(wh).scalar().alias("dpo_days"),
    )
    return year.withColumn("dio_days", ms.ratio(F.col("average_stock") * 365, F.col("annual_cogs"))).withColumn(
        "ccc_days", F.col("dso_days") + F.col("dio_days") - F.col("dpo_days")
    )


def margin_spread(wh: Any) -> DataFrame:
    """One row: the best and the worst category margin and the points between them."""
    margins = metric("gross_margin_pct").compute(wh, by=["dim_item.category"])
    ends = margins.agg(
        F.min("gross_margin_pct").alias("lowest"), F.max("gross_margin_pct").alias("highest"),
        F.min_by("category", "gross_margin_pct").alias("lowest_category"), F.max_by("category", "gross_margin_pct").alias("highest_category"),
    )
    return ends.withColumn("spread", F.col("highest") - F.col("lowest"))


def warehouse_overview(wh: Any, metric_count: int) -> DataFrame:
    """Customers, orders, tables, metrics and the span of the calendar, as one row."""
    customers = wh["dim_customer"].agg(F.count(F.lit(1)).alias("customer_count"))
    orders = wh["o2c_sales_order_line"].agg(F.count(F.lit(1)).alias("order_count"))
    span = wh["dim_date"].agg(F.min("full_date").alias("first"), F.max("full_date").alias("last"))
    return (
        customers.withColumn("order_count", orders.scalar()).withColumn("span", one_row(span)).select("*", "span.*").select(
            "customer_count", "order_count",
            F.lit(len(wh)).alias("table_count"), F.lit(metric_count).alias("metric_count"),
            F.date_format("first", "yyyy-MM").alias("range_start"),
            F.date_format("last", "yyyy-MM").alias("range_end"),
            F.date_format("last", "yyyy-MM-dd").alias("last_refreshed"),
        )
    )


def unpaid_invoices(wh: Any) -> DataFrame:
    """Invoices without a payment, per customer segment."""
    open_ = wh["ar_invoice"].join(paid_invoices(wh).select("invoice_key"), "invoice_key", "left_anti")
    per_customer = open_.groupBy("customer_key").agg(F.count(F.lit(1)).alias("invoices"), F.sum("invoice_amount").alias("amount"))
    return per_customer.join(wh["dim_customer"].select("customer_key", "segment"), "customer_key").groupBy("segment").agg(
        F.sum("invoices").alias("invoices"), F.sum("amount").alias("amount")
    )
