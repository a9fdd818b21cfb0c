"""Facts and bridges that follow from other facts by fixed rules."""

from __future__ import annotations

from datetime import date
from functools import reduce

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import clamp_date
from ledgerloom.functions.scalars import one_row

# Promise offset in days per lead class, tax rate, monthly ledger accounts.
LEAD_OFFSETS = {"Short": 2, "Medium": 3, "Long": 4}
TAX_RATE = 0.08
MONTHLY_ACCOUNTS = [
    # account code, account type, debit, credit
    ("4000-Revenue", "Revenue", None, "revenue"),
    ("5000-COGS", "COGS", "cogs", None),
    ("1200-AR", "Asset", "ar_net", None),
    ("4500-Refunds", "Revenue", "refunds", None),
]


def derive_invoices(orders: DataFrame, terms: DataFrame, ship_lag: Column, last_day: Column | None = None) -> DataFrame:
    """One invoice per order that was not cancelled, due after the customer's terms.

    The invoice date is held inside the calendar when ``last_day`` is given; the due date
    never is. ``terms`` is ``(customer_id, terms_days)``; 30 days when unknown.
    """
    invoice_date = F.date_add("order_date", ship_lag)
    if last_day is not None:
        invoice_date = F.least(invoice_date, last_day)
    return (
        orders.where(F.col("order_status") != "Cancelled")
        .withColumn("invoice_date", invoice_date)
        .join(terms, "customer_id", "left")
        .select(
            F.col("order_id").alias("invoice_id"),
            "order_id",
            "invoice_date",
            F.date_add("invoice_date", F.coalesce("terms_days", F.lit(30)).cast("int")).alias("due_date"),
            "customer_id",
            F.col("total_amount").alias("invoice_amount"),
            F.round(F.col("total_amount") * TAX_RATE, 2).alias("tax_amount"),
        )
    )


def derive_promise_date(orders: DataFrame, items: DataFrame, bounds: DataFrame) -> DataFrame:
    """Order date plus the item's lead-class offset, held inside the calendar.

    ``bounds`` is one row ``(first_day, last_day)``.
    """
    offset = F.lit(None).cast("int")
    for lead_class, days in LEAD_OFFSETS.items():
        offset = F.when(F.col("lead_time_class") == lead_class, days).otherwise(offset)
    return (
        orders.join(items.select("item_key", "lead_time_class"), "item_key")
        .withColumn("bounds", one_row(bounds))
        .withColumn(
            "promised_ship_date",
            clamp_date(F.date_add("order_date", offset), F.col("bounds.first_day"), F.col("bounds.last_day")),
        )
        .drop("lead_time_class", "bounds")
    )


def inventory_ledger(purchases: DataFrame, shipments: DataFrame, items: DataFrame) -> DataFrame:
    """Receipts add stock and cost; issues take out both and have no supplier."""
    receipts = purchases.select(
        F.col("po_date").alias("txn_date"), "item_key", "supplier_key", "subsidiary_key",
        F.lit("Receipt").alias("txn_type"),
        F.col("qty_ordered").alias("qty_delta"),
        F.col("ext_cost").alias("value_delta"),
    )
    issues = shipments.join(items.select("item_key", "unit_cost"), "item_key").select(
        F.col("ship_date").alias("txn_date"), "item_key",
        F.lit(None).cast("bigint").alias("supplier_key"),
        "subsidiary_key",
        F.lit("Issue").alias("txn_type"),
        (-F.col("qty_shipped")).alias("qty_delta"),
        (-F.col("qty_shipped") * F.col("unit_cost")).alias("value_delta"),
    )
    return receipts.unionByName(issues)


def post_journal(billed: DataFrame, day: str, amount: str, cost: str, carry: Sequence[str] = ()) -> DataFrame:
    """Two balanced entries per billed line: receivable against revenue, cost against stock.

    The columns of ``carry``, such as the company, go with each entry.
    """
    none = F.lit(0.0)

    def entry(account: str, debit: Column, credit: Column) -> Column:
        return F.struct(
            F.lit(account).alias("account_name"),
            debit.alias("debit_amount"),
            credit.alias("credit_amount"),
            (debit - credit).alias("net_amount"),
        )

    sale, goods = F.col(amount), F.col(cost)
    entries = F.array(
        entry("Accounts Receivable", sale, none),
        entry("Revenue", none, sale),
        entry("COGS", goods, none),
        entry("Inventory", none, goods),
    )
    return billed.select(F.col(day).alias("posting_date"), *carry, F.inline(entries))


def roll_gl_balances(journal: DataFrame, reset: str = "year") -> DataFrame:
    """Month by account net movement and running balance.

    ``reset="year"`` starts the running balance again each January, ``"never"`` carries it
    on. The window sees one row per month and account, whatever the journal's size.
    """
    if reset not in ("year", "never"):
        raise ValueError("reset must be 'year' or 'never'")
    months = journal.groupBy(
        F.year("posting_date").alias("year_num"), F.month("posting_date").alias("month_num"), "account_name"
    ).agg(F.sum("net_amount").alias("period_balance"))
    keys = ["account_name"] + (["year_num"] if reset == "year" else [])
    running = Window.partitionBy(*keys).orderBy("year_num", "month_num").rowsBetween(Window.unboundedPreceding, 0)
    return months.withColumn("ytd_balance", F.sum("period_balance").over(running))


def monthly_gl_postings(orders: DataFrame, invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Revenue, cost, net receivable and refunds per month as ledger rows; all-zero rows are left out."""

    def by_month(frame: DataFrame, day: str, **sums: Column) -> DataFrame:
        return frame.groupBy(F.year(day).alias("year_num"), F.month(day).alias("month_num")).agg(
            *[F.sum(c).alias(n) for n, c in sums.items()]
        )

    amount, cancelled = F.col("total_amount"), F.col("order_status") == "Cancelled"
    legs = [
        by_month(invoices, "invoice_date", revenue=F.col("invoice_amount")),
        by_month(payments, "payment_date", paid=F.col("payment_amount")),
        by_month(
            orders,
            "order_date",
            cogs=F.when(~cancelled, amount * (1 - F.col("effective_gross_margin_pct") / 100)),
            refunds=F.when(cancelled, amount),
        ),
    ]
    months = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), legs)
    total = lambda n: F.coalesce(F.sum(n), F.lit(0.0)).alias(n)
    months = months.groupBy("year_num", "month_num").agg(*[total(n) for n in ("revenue", "paid", "cogs", "refunds")])
    months = months.withColumn("ar_net", F.greatest(F.lit(0.0), F.col("revenue") - F.col("paid")))

    def side(name: str | None) -> Column:
        return F.round(F.col(name), 2) if name else F.lit(0.0)

    rows = F.array(
        *[
            F.struct(
                F.lit(code).alias("account_code"),
                F.lit(kind).alias("account_type"),
                side(debit).alias("debit_amount"),
                side(credit).alias("credit_amount"),
            )
            for code, kind, debit, credit in MONTHLY_ACCOUNTS
        ]
    )
    posted = months.select("year_num", "month_num", F.inline(rows))
    return posted.where((F.col("debit_amount") != 0) | (F.col("credit_amount") != 0))


def item_supplier_bridge(purchases: DataFrame) -> DataFrame:
    return purchases.select("item_key", "supplier_key").distinct()


def multi_sourced_items(bridge: DataFrame) -> DataFrame:
    """Items that break the one-supplier rule; empty when it holds."""
    return bridge.groupBy("item_key").agg(F.countDistinct("supplier_key").alias("suppliers")).where("suppliers > 1")


def open_balance(invoices: DataFrame, payments: DataFrame, horizon: date | None = None) -> DataFrame:
    """Invoices with the amount still unpaid on the horizon day (all payments when NULL)."""
    counted = payments.where(F.col("payment_date") <= F.lit(horizon)) if horizon else payments
    paid = counted.groupBy("invoice_key").agg(F.sum("amount_applied").alias("paid"))
    unpaid = F.greatest(F.col("invoice_amount") - F.coalesce("paid", F.lit(0.0)), F.lit(0.0))
    return invoices.drop("open_balance").join(paid, "invoice_key", "left").withColumn("open_balance", unpaid).drop("paid")
