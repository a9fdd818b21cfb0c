"""Data-quality and acceptance reports over both warehouses."""

from __future__ import annotations

from datetime import date
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.measures import count_if, rate_pct
from ledgerloom.metrics.registry import metric
from ledgerloom.operators import quality as q
from ledgerloom.periods import Period
from ledgerloom.plans import analyses as a
from ledgerloom.retrieval.ranking import retrieve
from ledgerloom.workload.common import Query, on_distributor, on_furniture, on_raw, with_steps_kept
from ledgerloom.workload.retrieval_queries import documents, text_queries

BANDS = {
    "dso_days": (40, 60), "dpo_days": (35, 50), "dio_days": (10, 90), "cash_conversion_cycle_days": (10, 91),
    "gross_margin_pct": (22, 43),
}


def expected_rows(wh: Any) -> dict[str, Any]:
    """What the raw tables let each table hold, as scalar subqueries: right at every size."""
    rows = lambda df: df.agg(F.count(F.lit(1))).scalar()
    day = F.to_date("o_orderdate")
    months = wh["orders"].agg(F.countDistinct(F.trunc(day, "MM"))).scalar()
    return {
        "dim_customer": rows(wh["customer"]), "dim_supplier": rows(wh["supplier"]), "dim_item": rows(wh["part"]),
        "o2c_sales_order_line": rows(wh["orders"]),
        "o2c_fulfillment_line": rows(wh["lineitem"].select("l_orderkey").distinct()),
        "p2p_purchase_order_line": rows(wh["lineitem"]), "inv_balance_snapshot": rows(wh["part"]) * months,
    }


def quarter_cancellations(wh: Any) -> DataFrame:
    cancelled = F.col("order_status") == "Cancelled"
    return (
        wh["fact_sales_order"].where(F.col("primary_item_category") == "STANDARD")
        .groupBy(F.year("order_date").alias("year"), F.quarter("order_date").alias("quarter"))
        .agg(rate_pct(cancelled).alias("rate"), count_if(cancelled).alias("cancelled"))
    )


def furniture_anomalies(wh: Any) -> DataFrame:
    orders, customers = wh["fact_sales_order"], wh["dim_customer"]
    target = (F.col("year") == 2000) & (F.col("quarter") == 3)
    rates = quarter_cancellations(wh)
    margins = metric("gross_margin_pct", "furniture").compute(
        wh, by=["dim_date.quarter"], period=Period.year(2000), where={"dim_item.category": "STANDARD"}
    )
    invoiced = wh["fact_invoice"].groupBy(F.year("invoice_date").alias("year")).agg(F.sum("invoice_amount").alias("amount"))
    per_customer = orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"))
    top = per_customer.join(customers, "customer_id").orderBy(F.col("orders").desc(), "customer_id").limit(5)
    return q.report(
        [
            q.spike(rates, target, "rate", 10.0, others_at_most=5.0, check_id="spike:level"),
            q.spike(rates, target, "rate", 10.0, times_others=2.0, check_id="spike:multiple"),
            q.dark_since(orders, F.col("customer_id") == 1, "order_date", date(2001, 6, 1), "dark:1"),
            q.dark_since(orders, F.col("customer_id") == 2, "order_date", date(2001, 7, 31), "dark:2"),
            q.compression(margins, "quarter", "gross_margin_pct", 8.0, "compression:margin"),
            q.share_at_least(customers, F.col("region") == "ASIA", 15.0, "share:ASIA"),
            q.category_counts(customers, "customer_segment", {"BUILDING": 300, "MACHINERY": 300}),
            q.grows(invoiced, "year", "amount", "growth:invoiced"),
            q.top_n_sane(top, "customer_name", "orders", 5, "top:customers"),
        ]
    )


def distributor_acceptance(wh: Any) -> DataFrame:
    bands = [q.in_band(metric(n).compute(wh), n, lo, hi, f"band:{n}") for n, (lo, hi) in BANDS.items()]
    pareto = a.pareto_shares(wh)
    bands += [
        q.in_band(pareto.where(F.col("side") == side), "share", lo, hi, f"band:pareto_{side}")
        for side, lo, hi in (("supplier", 0.7, 0.8), ("customer", 0.2, 0.65))
    ]
    year = a.annual_figures(wh)
    bands += [
        q.in_band(year, "annual_revenue", 250e6, 1e9, "band:annual_revenue"),
        q.in_band(year, "dio_days", 10, 90, "band:annual_dio"),
        q.in_band(year, "ccc_days", 10, 91, "band:annual_ccc"),
        q.in_band(a.margin_spread(wh), "spread", 10, 100, "band:margin_spread"),
    ]
    tiers = metric("supplier_lateness_cash_impact").compute(wh)
    payers = a.slow_payers(wh)
    return q.report(
        [
            *bands,
            q.gradient(tiers, "reliability_tier", ["avg_late_days", "stockout_pct", "avg_order_to_ship_days"], 4),
            q.separated(payers, "payer_group", "avg_days", "slow", "on-time", 15.0, "separation:payers"),
        ]
    )


def answer_sanity(wh: Any) -> DataFrame:
    """Do the analyses show what is known of the data?"""
    return q.report(
        [
            q.only_values(a.late_suppliers_and_revenue(wh), "reliability_tier", ["C", "D"], "tiers:late_suppliers"),
            q.only_values(a.suppliers_delaying_shipments(wh), "reliability_tier", ["C", "D"], "tiers:delaying_suppliers"),
            q.largest_is(a.cash_cycle_components(wh), "component", "days", "DIO", "largest:cash_cycle"),
            q.in_band(a.tier_swap_saving(wh), "delay_days_eliminated_per_line", 4, 6, "band:tier_swap"),
            q.flat(a.stockouts_in_last_quarter(wh), "stockout_pct", 0.5, "flat:stockouts"),
        ]
    )


def isolation(wh: Any) -> DataFrame:
    """Result ids carry the tenant; ids of the other tenant would be counted."""
    ids = wh["dim_customer"].select(F.concat(F.lit("distributor:"), F.col("customer_key").cast("string")).alias("id"))
    return q.report(
        [q.isolated(ids, "id", "distributor", "isolation:own"), q.isolated(ids, "id", "furniture", "isolation:other")]
    )


def planted_twins(spark: Any, t: Any) -> DataFrame:
    """Every document twice, under two tenants: each asks its questions and must find its own copies only."""
    tenants = F.explode(F.array(F.col("tenant"), F.concat(F.lit("twin-"), "tenant")))
    docs = documents(t).where("tenant is not null").select("id", "text", tenants.alias("tenant"))
    docs = docs.withColumn("id", F.concat_ws(":", "tenant", F.col("id").cast("string")))
    asked = text_queries(t).select(F.split_part("query_id", F.lit(":"), F.lit(2)).alias("item"), "text", tenants.alias("tenant"))
    asked = asked.select(F.concat_ws(":", "tenant", "item").alias("query_id"), "tenant", "text")
    return q.tenant_probe(retrieve(docs, asked, 5, "bm25"), asked, docs.select("id", "tenant"))


def copies(wh: Any) -> DataFrame:
    """Invoices against the sales lines they were made from."""
    shipped = wh["o2c_sales_order_line"].join(wh["o2c_fulfillment_line"].select("so_line_key"), "so_line_key", "left_semi")
    left = wh["ar_invoice"].select(F.col("invoice_amount").alias("amount"))
    return q.parity(left, shipped.select(F.col("ext_amount").alias("amount")), {"amount": F.col("amount")}, "parity:invoices")


def copied_contents(wh: Any) -> DataFrame:
    """Every invoice against the shipped line it was made from; and against lines with one customer's amounts changed."""
    shipped = wh["o2c_sales_order_line"].join(wh["o2c_fulfillment_line"].select("so_line_key", "ship_date"), "so_line_key")
    lines = shipped.select(
        F.col("so_line_key").alias("invoice_key"), F.col("ship_date").alias("invoice_date"), "customer_key",
        F.col("ext_amount").alias("invoice_amount"), F.year("ship_date").alias("year"),
    )
    invoices = wh["ar_invoice"].withColumn("year", F.year("invoice_date")).select(*lines.columns)
    changed = lines.withColumn(
        "invoice_amount", F.when(F.col("customer_key") == 1, F.col("invoice_amount") + 1).otherwise(F.col("invoice_amount"))
    )
    return q.report(
        [
            q.content_parity(invoices, lines, ["year"], "contents:invoices"),
            q.content_parity(invoices, changed, ["year"], "contents:changed"),
        ]
    )


def queries() -> dict[str, Query]:
    return {
        "quality_row_counts": on_distributor(lambda wh: q.row_counts(wh, expected_rows(wh))),
        "quality_foreign_keys_distributor": on_distributor(lambda wh: q.orphans(with_steps_kept(wh))),
        "quality_foreign_keys_furniture": on_furniture(q.orphans),
        "quality_primary_keys_distributor": on_distributor(q.primary_keys),
        "quality_primary_keys_furniture": on_furniture(q.primary_keys),
        "quality_accepted_values_distributor": on_distributor(q.accepted_values),
        "quality_accepted_values_furniture": on_furniture(q.accepted_values),
        "quality_calendar": on_distributor(lambda wh: q.date_spine(wh["dim_date"], date(1995, 1, 1), date(2001, 11, 29))),
        "quality_furniture_anomalies": on_furniture(furniture_anomalies),
        "quality_distributor_acceptance": on_distributor(distributor_acceptance),
        "quality_answer_sanity": on_distributor(answer_sanity),
        "quality_tenant_isolation": on_distributor(isolation),
        "quality_tenant_probe": on_raw(planted_twins),
        "quality_copy_parity": on_distributor(copies),
        "quality_copy_contents": on_distributor(copied_contents),
    }
