"""Derived facts, loading and patch jobs, labels and scalar functions."""

from __future__ import annotations

from datetime import date
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates, labels, text
from ledgerloom.operators import derive, maintenance, quality
from ledgerloom.plans import analyses
from ledgerloom.sources import files
from ledgerloom.sources.schemas import CATALOG
from ledgerloom.workload.common import Query, on_distributor, on_furniture, on_raw

CALENDAR_SHOWN = [
    "date_key", "full_date", "day_of_week", "day_of_month", "week_of_year", "month_num", "month_name", "quarter_num",
    "fiscal_period", "year_num", "is_month_end", "is_weekend",
]
FURNITURE_TABLES = ["dim_date", "dim_customer", "dim_employee", "dim_location", "fact_sales_order", "fact_invoice", "fact_payment"]


def promise_dates(wh: Any) -> DataFrame:
    bounds = wh["dim_date"].agg(F.min("full_date").alias("first_day"), F.max("full_date").alias("last_day"))
    orders = wh["o2c_sales_order_line"].drop("promised_ship_date")
    return derive.derive_promise_date(orders, wh["dim_item"], bounds).select("so_line_key", "order_date", "promised_ship_date")


def journal_by_month(wh: Any) -> DataFrame:
    entries = derive.post_journal(wh["ar_invoice"], "invoice_date", "invoice_amount", "invoice_cost")
    return entries.groupBy(
        F.year("posting_date").alias("year_num"), F.month("posting_date").alias("month_num"), "account_name"
    ).agg(*[F.sum(c).alias(c) for c in ("debit_amount", "credit_amount", "net_amount")], F.count(F.lit(1)).alias("entries"))


def csv_round_trip(wh: Any) -> DataFrame:
    """The calendar through CSV: dates, numbers and ``True`` / ``False`` come back typed."""
    folder = files.shared_folder(wh.spark, "calendar-csv")
    files.write_csv(wh["dim_date"].withColumn("is_weekend", F.initcap(F.col("is_weekend").cast("string"))), folder)
    return files.load_csv_table(wh.spark, folder, CATALOG.struct("distributor", "dim_date")).select(*CALENDAR_SHOWN)


def refreshed_counts(wh: Any) -> DataFrame:
    """Publish the furniture tables, reopen them and count."""
    folder = files.shared_folder(wh.spark, "furniture")
    files.full_refresh(wh, folder, FURNITURE_TABLES, audit=f"{folder}/_audit")
    current = files.open_current(wh.spark, wh.tenant, folder)
    stored = files.catalog_counts(current, FURNITURE_TABLES)
    audited = wh.spark.read.parquet(f"{folder}/_audit").select("table_name", F.col("row_count").alias("audited_rows"))
    return stored.join(audited, "table_name")


def patched_orders(wh: Any) -> DataFrame:
    """Take the promise date away and add it again as a patch."""
    target = wh["o2c_sales_order_line"].drop("promised_ship_date")
    return maintenance.patch_column(target, promise_dates(wh), "so_line_key", "promised_ship_date").select(
        "so_line_key", "promised_ship_date"
    )


def _new_labels(wh: Any) -> DataFrame:
    building = wh["dim_customer"].where(F.col("segment") == "BUILDING")
    return building.select("customer_key", F.concat(F.lit("Builder "), F.col("customer_key").cast("string")).alias("new_label"))


def relabelled(wh: Any) -> DataFrame:
    return maintenance.relabel(wh["dim_customer"], _new_labels(wh), "customer_key", "customer_name").select(
        "customer_key", "customer_name", "segment"
    )


def synced_parity(wh: Any) -> DataFrame:
    source = wh["dim_supplier"]
    copy = files.sync_table(source, files.shared_folder(wh.spark, "supplier-copy"))
    return quality.parity(source, copy, {"payment_days": F.col("payment_days")}, "parity:suppliers")


def synced_parts(wh: Any) -> DataFrame:
    """A copy of the sales lines that went stale in two years: only those are written again, then nothing is."""
    source = wh["o2c_sales_order_line"].withColumn("order_year", F.year("order_date"))
    day, year = F.col("order_date"), F.col("order_year")
    stale = source.where(year != 1999).withColumn(
        "ext_amount", F.when(day == F.lit(date(1997, 3, 3)), F.col("ext_amount") + 1).otherwise(F.col("ext_amount"))
    )
    folder = files.shared_folder(wh.spark, "sales-parts")
    files.write_parts(stale, folder, "order_year")
    first = files.sync_parts(source, folder, "order_year").withColumn("pass", F.lit(1))
    return first.unionByName(files.sync_parts(source, folder, "order_year").withColumn("pass", F.lit(2)))


def guarded_revenue(wh: Any) -> DataFrame:
    """A SQL question over registered views, held to its tables and columns."""
    files.register_views(wh, ["o2c_sales_order_line", "dim_customer"], prefix="guarded_")
    asked = wh.spark.sql(
        "SELECT c.segment, SUM(s.ext_amount) AS revenue FROM guarded_o2c_sales_order_line s "
        "JOIN guarded_dim_customer c USING (customer_key) GROUP BY c.segment"
    )
    return files.guard_plan(
        asked, ["segment", "revenue"], ["guarded_o2c_sales_order_line", "guarded_dim_customer"]
    )


def date_arithmetic(wh: Any) -> DataFrame:
    day = F.col("order_date")
    key = dates.date_to_key(day)
    first, last = F.lit(date(1996, 1, 1)), F.lit(date(2000, 12, 31))
    return wh["o2c_sales_order_line"].select(
        "so_line_key", key.alias("date_key"), dates.key_to_date(key).alias("back"),
        dates.clamp_date(day, first, last).alias("clamped"),
        dates.days_between(day, F.col("promised_ship_date")).alias("days_promised"),
        dates.days_before(day, 90).alias("ninety_before"),
        dates.fiscal_label(day).alias("fiscal_period"),
    )


def period_labels(wh: Any) -> DataFrame:
    day = F.col("order_date")
    return wh["o2c_sales_order_line"].groupBy(
        labels.quarter_label(F.year(day), F.quarter(day)).alias("quarter"), labels.month_label(F.year(day), F.month(day)).alias("month")
    ).agg(F.count(F.lit(1)).alias("orders"))


def queries() -> dict[str, Query]:
    return {
        "derive_calendar": on_distributor(lambda wh: wh["dim_date"].select(*CALENDAR_SHOWN)),
        "derive_invoices": on_furniture(lambda wh: wh["fact_invoice"]),
        "derive_promise_dates": on_distributor(promise_dates),
        "derive_inventory_ledger": on_distributor(
            lambda wh: wh["inv_transaction"].withColumn("supplier_key", F.coalesce("supplier_key", F.lit(-1)))
        ),
        "derive_journal_by_month": on_distributor(journal_by_month),
        "derive_balances_yearly": on_distributor(lambda wh: derive.roll_gl_balances(wh["gl_journal_line"], "year")),
        "derive_balances_running": on_distributor(lambda wh: derive.roll_gl_balances(wh["gl_journal_line"], "never")),
        "derive_monthly_postings": on_furniture(lambda wh: wh["fact_gl_entry"], 1),
        "derive_item_supplier_bridge": on_distributor(lambda wh: derive.item_supplier_bridge(wh["p2p_purchase_order_line"])),
        "derive_multi_sourced_items": on_distributor(
            lambda wh: derive.multi_sourced_items(derive.item_supplier_bridge(wh["p2p_purchase_order_line"]))
        ),
        "derive_open_balances": on_distributor(
            lambda wh: derive.open_balance(wh["ar_invoice"], wh["ar_payment_application"], date(2000, 6, 30)).select(
                "invoice_key", "open_balance"
            )
        ),
        "load_csv_round_trip": on_distributor(csv_round_trip),
        "load_full_refresh": on_furniture(refreshed_counts),
        "load_patch_column": on_distributor(patched_orders),
        "load_relabel_dimension": on_distributor(relabelled),
        "load_relabel_audit": on_distributor(
            lambda wh: maintenance.relabel_audit(relabelled(wh), "customer_name", "Customer#%")
        ),
        "load_rescale_measures": on_furniture(
            lambda wh: maintenance.yearly_range(
                maintenance.rescale(wh["fact_sales_order"], ["total_amount"], 20.0), "order_date", "total_amount", 25e6, 30e6
            )
        ),
        "load_sync_parity": on_distributor(synced_parity),
        "load_sync_parts": on_distributor(synced_parts),
        "load_catalog_counts": on_distributor(files.catalog_counts),
        "load_bounded_result": on_distributor(
            lambda wh: files.bounded_result(analyses.item_revenue(wh), 100)[1]
        ),
        "load_normalized_types": on_furniture(
            lambda wh: files.normalize_types(
                wh["fact_invoice"].select(
                    "invoice_id", F.col("invoice_amount").cast("decimal(18,2)").alias("invoice_amount"), "due_date",
                    F.month("invoice_date").alias("month"),
                )
            )
        ),
        "load_guarded_result": on_distributor(guarded_revenue),
        "date_arithmetic": on_distributor(date_arithmetic),
        "label_periods": on_distributor(period_labels),
        "label_titles": on_raw(
            lambda spark, t: t("part").select(
                "p_partkey", labels.title_case(F.concat(F.lit("dso_by_"), F.translate("p_name", " ", "_"), F.lit("_vs_po"))).alias("title")
            )
        ),
        "label_durations": on_raw(
            lambda spark, t: t("events").select("event_id", labels.duration_label(F.col("event_id") * 37.0).alias("duration"))
        ),
        "label_amounts": on_raw(
            lambda spark, t: t("lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("amount")).select(
                "l_orderkey", labels.amount_label(F.col("amount")).alias("cell"), labels.axis_label(F.col("amount")).alias("axis"),
                labels.amount_label(F.col("l_orderkey") / 30011.0).alias("small"),
            )
        ),
        "label_metric_sentiment": on_raw(
            lambda spark, t: t("labels").select(
                "doc_id",
                labels.sentiment_label(
                    F.when(F.col("quality") == 1, "positive").when(F.col("toxic") == 1, "negative").otherwise("none")
                ).alias("label"),
            )
        ),
        "text_token_estimates": on_raw(
            lambda spark, t: t("documents").select(
                "doc_id", F.size(text.tokens(F.col("text"))).alias("tokens"), text.token_estimate(F.col("text")).alias("estimate"),
                text.run_cost(text.token_estimate(F.col("text")), F.lit(200), 1.0, 5.0).alias("cost"),
            )
        ),
        "text_fences_and_truncation": on_raw(
            lambda spark, t: t("conversations").select(
                "conv_id", "turn",
                text.strip_code_fences(F.concat(F.lit("```sql\n"), "text", F.lit("\n```"))).alias("unfenced"),
                text.truncate_text(F.col("text"), 80).alias("shown"),
            )
        ),
        "text_referenced_names": on_raw(
            lambda spark, t: t("documents").select(
                "doc_id", F.array_join(text.referenced_names(F.col("text"), r"re\w+|th\w+"), ",").alias("names")
            )
        ),
        "text_sigmoid": on_raw(
            lambda spark, t: t("events").select("event_id", text.sigmoid(F.col("value") / 100.0 - 1.0).alias("probability"))
        ),
    }
