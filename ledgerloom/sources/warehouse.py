"""Star-schema warehouses over a folder of raw order tables.

``Warehouse`` maps a table name to a lazy DataFrame. ``distributor`` (order to cash,
procure to pay, inventory, ledger) and ``furniture`` (orders, invoices, payments) are
defined here over the raw tables; ``published`` opens a warehouse that was written out.

Plans are built so that a query pays only for the columns it reads:

* ``order_lines`` is aggregated once per order and left-joined on a unique key, so Spark
  drops that join when no quantity is needed;
* what a purchase or shipment needs about an item (supplier, tier, cost) is put together
  first, and the large fact is joined with it once;
* stock levels are one row per item and month: what is asked of the item is joined with the
  items before the months multiply them (``Spread``);
* dimensions that grow with the data carry no broadcast hint. Hints are used only for
  ``region``, ``nation``, one-row aggregates and the calendar (one row per day).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.catalog import Catalog
from ledgerloom.functions.dates import build_calendar
from ledgerloom.functions.scalars import one_row
from ledgerloom.operators import derive
from ledgerloom.sources.schemas import CATALOG

# inline rows: Catalyst knows how small they are
WAREHOUSES = (
    "SELECT CAST(k AS BIGINT) AS warehouse_key, concat('Warehouse ', k) AS warehouse_name, region "
    "FROM VALUES (1, 'North'), (2, 'East'), (3, 'South'), (4, 'West') AS t(k, region)"
)
SUBSIDIARIES = "SELECT CAST(k AS BIGINT) AS subsidiary_key, concat('Subsidiary ', k) AS subsidiary_name FROM VALUES (1), (2), (3) AS t(k)"
EMPLOYEES = (
    "SELECT CAST(id AS INT) AS employee_id, concat('Employee ', id) AS employee_name, CAST(id % 5 AS INT) AS place, "
    "CASE WHEN id > 3 THEN CAST(1 + id % 3 AS INT) END AS manager_id FROM range(1, 31)"
)
INDUSTRIES = ("Retail", "Hospitality", "Healthcare", "Education", "Offices")

# declared, so that opening a table reads no file footer
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


@dataclass(frozen=True)
class Spread:
    """How a fact of many rows per key is made from a step of few.

    Dimensions that are reached by ``key`` can be joined with the step; ``rows`` makes the
    fact of the joined step and carries the named columns along.
    """

    step: str
    key: str
    rows: Callable[[Warehouse, DataFrame, Sequence[str]], DataFrame]


class Warehouse(Mapping[str, DataFrame]):
    def __init__(
        self,
        spark: SparkSession,
        tenant: str,
        builders: Mapping[str, Callable[[Warehouse], DataFrame]],
        catalog: Catalog = CATALOG,
        spreads: Mapping[str, Spread] | None = None,
    ) -> None:
        self.spark = spark
        self.tenant = tenant
        self.catalog = catalog
        self.spreads = dict(spreads or {})
        self._builders = dict(builders)
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name not in self._builders:
                raise KeyError(f"{self.tenant} has no table {name!r}")
            self._frames[name] = self._builders[name](self)
        return self._frames[name]

    def __iter__(self) -> Iterator[str]:
        return (t.name for t in self.catalog.of_tenant(self.tenant) if t.name in self._builders)

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def has(self, name: str) -> bool:
        """Also true for the intermediate steps that are not tables of the catalogue."""
        return name in self._builders

    def replaced(self, **frames: DataFrame) -> Warehouse:
        """The same warehouse with some tables swapped."""
        swapped = {name: (lambda _wh, frame=frame: frame) for name, frame in frames.items()}
        spreads = {name: spread for name, spread in self.spreads.items() if name not in frames}
        return Warehouse(self.spark, self.tenant, {**self._builders, **swapped}, self.catalog, spreads)


def _raw(folder: str, name: str) -> Callable[[Warehouse], DataFrame]:
    return lambda wh: wh.spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _with_region(wh: Warehouse, table: str, nation_key: str) -> DataFrame:
    places = wh["nation"].join(F.broadcast(wh["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
    return wh[table].join(F.broadcast(places), F.col(nation_key) == F.col("n_nationkey"))


def _dim_customer(wh: Warehouse) -> DataFrame:
    return _with_region(wh, "customer", "c_nationkey").select(
        F.col("c_custkey").alias("customer_key"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("region"),
        (30 + 15 * (F.col("c_custkey") % 3)).alias("credit_days"),
        F.concat(F.lit("Net "), (30 + 15 * (F.col("c_custkey") % 3)).cast("string")).alias("credit_terms"),
    )


def _tier(supplier_key: Column) -> Column:
    slot = supplier_key % 20
    return F.when(slot == 0, "D").when(slot.isin(1, 2), "C").when(slot <= 10, "B").otherwise("A")


def _dim_supplier(wh: Warehouse) -> DataFrame:
    return _with_region(wh, "supplier", "s_nationkey").select(
        F.col("s_suppkey").alias("supplier_key"),
        F.col("s_name").alias("supplier_name"),
        F.col("r_name").alias("region"),
        (30 + 15 * (F.col("s_suppkey") % 3)).alias("payment_days"),
        F.concat(F.lit("Net "), (30 + 15 * (F.col("s_suppkey") % 3)).cast("string")).alias("payment_terms"),
        _tier(F.col("s_suppkey")).alias("reliability_tier"),
    )


def _dim_item(wh: Warehouse) -> DataFrame:
    return wh["part"].select(
        F.col("p_partkey").alias("item_key"),
        F.col("p_name").alias("item_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.col("p_retailprice").alias("list_price"),
        (F.col("p_retailprice") * 0.6).alias("unit_cost"),
        F.when(F.col("p_partkey") % 3 == 0, "Short")
        .when(F.col("p_partkey") % 3 == 1, "Medium")
        .otherwise("Long")
        .alias("lead_time_class"),
    )


def _item_supplier(wh: Warehouse) -> DataFrame:
    span = wh["supplier"].agg(F.min("s_suppkey").alias("first_key"), F.count(F.lit(1)).alias("n"))
    return wh["part"].withColumn("span", one_row(span)).select(
        F.col("p_partkey").alias("item_key"),
        (F.col("span.first_key") + F.col("p_partkey") % F.col("span.n")).alias("supplier_key"),
    )


def _item_tier(wh: Warehouse) -> DataFrame:
    """Per item: its supplier with tier and terms."""
    terms = wh["dim_supplier"].select("supplier_key", "reliability_tier", "payment_days")
    return wh["item_supplier"].join(terms, "supplier_key")


def _item_sourcing(wh: Warehouse) -> DataFrame:
    """The same with the unit cost.

    The supplier is joined last. The result then lies by supplier and is shuffled again when
    a fact joins it by item: AQE splits a hot item only between two fresh shuffles.
    """
    terms = wh["dim_supplier"].select("supplier_key", "reliability_tier", "payment_days")
    costs = wh["dim_item"].select("item_key", "unit_cost")
    return wh["item_supplier"].join(costs, "item_key").join(terms, "supplier_key")


def _order_lines(wh: Warehouse) -> DataFrame:
    return wh["lineitem"].groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("line_item_key"),
        F.sum("l_quantity").alias("line_qty"),
        F.count(F.lit(1)).alias("line_count"),
    )


def _orders_with_lines(wh: Warehouse) -> DataFrame:
    return wh["orders"].join(wh["order_lines"], F.col("o_orderkey") == F.col("l_orderkey"), "left")


def _sales_columns(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    return orders.select(
        key.alias("so_line_key"),
        day.alias("order_date"),
        F.col("o_custkey").alias("customer_key"),
        F.coalesce("line_item_key", F.lit(1)).alias("item_key"),
        (1 + key % 4).alias("warehouse_key"),
        (1 + key % 3).alias("subsidiary_key"),
        F.coalesce("line_qty", F.lit(1.0)).alias("qty_ordered"),
        F.col("o_totalprice").alias("ext_amount"),
        (F.col("o_totalprice") * (0.55 + (key % 5) / 20.0)).alias("ext_cost"),
        F.date_add(day, (2 + key % 4).cast("int")).alias("promised_ship_date"),
        F.col("line_qty"),
    )


def _sales_order_line(wh: Warehouse) -> DataFrame:
    return _sales_columns(wh["orders_with_lines"]).drop("line_qty")


def _fulfillment_line(wh: Warehouse) -> DataFrame:
    shipped = _sales_columns(wh["orders_with_lines"]).where(F.col("line_qty").isNotNull())
    delay = F.when(F.col("reliability_tier") == "D", 5).when(F.col("reliability_tier") == "C", 3)
    delay = delay.when(F.col("reliability_tier") == "B", 1).otherwise(0)
    days = (1 + F.col("line_qty") % 3 + delay).cast("int")
    return shipped.join(wh["item_tier"].select("item_key", "reliability_tier"), "item_key").select(
        "so_line_key", "customer_key", "item_key", "warehouse_key", "subsidiary_key", "order_date",
        days.alias("order_to_ship_days"),
        F.date_add("order_date", days).alias("ship_date"),
        F.when(F.col("so_line_key") % 17 == 0, F.col("line_qty") - 1).otherwise(F.col("line_qty")).alias("qty_shipped"),
        "ext_amount", "ext_cost",
    )


def _fulfillment_public(wh: Warehouse) -> DataFrame:
    return wh["shipped_orders"].drop("ext_amount", "ext_cost")


def _return_line(wh: Warehouse) -> DataFrame:
    reason = F.col("l_linenumber") % 4
    return wh["lineitem"].where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("so_line_key"),
        F.col("l_partkey").alias("item_key"),
        F.col("l_quantity").alias("qty_returned"),
        F.col("l_extendedprice").alias("credit_amount"),
        F.when(reason == 0, "Damaged").when(reason == 1, "Wrong Item").when(reason == 2, "Overordered")
        .otherwise("Quality").alias("reason"),
    )


def _ar_invoice_terms(wh: Warehouse) -> DataFrame:
    """Invoices with the customer's terms still attached."""
    terms = wh["dim_customer"].select("customer_key", "credit_days")
    key = F.col("so_line_key")
    return wh["shipped_orders"].join(terms, "customer_key").select(
        key.alias("invoice_key"),
        F.col("ship_date").alias("invoice_date"),
        F.date_add("ship_date", F.col("credit_days").cast("int")).alias("due_date"),
        "customer_key", "subsidiary_key",
        F.col("ext_amount").alias("invoice_amount"),
        F.col("ext_cost").alias("invoice_cost"),
        F.when(key % 10 == 0, F.col("ext_amount")).otherwise(F.lit(0.0)).alias("open_balance"),
        "credit_days",
    )


def _ar_payment(wh: Warehouse) -> DataFrame:
    slack = F.when(F.col("customer_key") % 7 == 0, 20).otherwise(4)
    days = (F.col("credit_days") + slack + F.col("invoice_key") % 13 - 6).cast("int")
    return wh["invoice_terms"].where(F.col("open_balance") == 0).select(
        "invoice_key", "customer_key", "subsidiary_key",
        F.col("invoice_amount").alias("amount_applied"),
        days.alias("days_to_pay"),
        F.date_add("invoice_date", days).alias("payment_date"),
    )


def _purchases(wh: Warehouse) -> DataFrame:
    order = F.col("l_orderkey")
    tier = F.col("reliability_tier")
    late = (
        F.when(tier == "D", 12 + order % 7)
        .when(tier == "C", 5 + order % 5)
        .when(tier == "B", order % 5)
        .otherwise(F.when(order % 8 == 0, 1).otherwise(0))
    )
    return wh["lineitem"].join(wh["item_sourcing"], F.col("l_partkey") == F.col("item_key")).select(
        order.alias("po_number"),
        F.to_date("l_shipdate").alias("po_date"),
        "supplier_key", "item_key",
        (1 + order % 3).alias("subsidiary_key"),
        F.col("l_quantity").alias("qty_ordered"),
        (F.col("l_quantity") * F.col("unit_cost")).alias("ext_cost"),
        late.cast("int").alias("late_days"),
        "payment_days",
    )


def _vendor_bill(wh: Warehouse) -> DataFrame:
    unpaid = F.col("po_number") % 12 == 0
    return wh["purchases"].select(
        "po_number", "supplier_key", "subsidiary_key",
        F.col("ext_cost").alias("bill_amount"),
        F.when(unpaid, F.col("ext_cost")).otherwise(F.lit(0.0)).alias("open_balance"),
    )


def _bill_payment(wh: Warehouse) -> DataFrame:
    days = (F.col("payment_days") - 2 + F.col("po_number") % 9).cast("int")
    return wh["purchases"].where(F.col("po_number") % 12 != 0).select(
        "po_number", "supplier_key", "subsidiary_key",
        F.col("ext_cost").alias("amount_paid"),
        days.alias("days_to_pay"),
        F.date_add("po_date", days).alias("payment_date"),
    )


def _stock_levels(wh: Warehouse, items: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Month-end stock per item: the months are at most twelve per year of history."""
    day = F.to_date("o_orderdate")
    month = (F.year(day) * 12 + F.month(day)).alias("m")
    months = wh["orders"].groupBy(month).agg(F.max(day).alias("snapshot_date"))
    listed = months.agg(F.collect_list(F.struct("m", "snapshot_date"))).scalar()
    level = (F.col("item_key") * 7 + F.col("m") * 13) % 29
    return items.select("item_key", "unit_cost", *carry, F.inline(listed)).select(
        "snapshot_date", "item_key",
        (1 + F.col("item_key") % 4).alias("warehouse_key"),
        F.lit(1).alias("subsidiary_key"),
        level.cast("int").alias("qty_on_hand"),
        (level * F.col("unit_cost")).alias("value_on_hand"),
        (level == 0).alias("is_stockout"),
        *carry,
    )


def _calendar(wh: Warehouse) -> DataFrame:
    day = F.to_date("o_orderdate")
    return build_calendar(wh["orders"].agg(F.min(day).alias("first_day"), F.date_add(F.max(day), 120).alias("last_day")))


def _journal(wh: Warehouse) -> DataFrame:
    posted = derive.post_journal(wh["invoice_terms"], "invoice_date", "invoice_amount", "invoice_cost", ["subsidiary_key"])
    return posted.select("posting_date", "account_name", "subsidiary_key", "net_amount")


def distributor(spark: SparkSession, folder: str) -> Warehouse:
    """Twenty-table style distributor warehouse."""
    return Warehouse(
        spark,
        "distributor",
        {
            **{name: _raw(folder, name) for name in RAW_SCHEMAS},
            "dim_date": _calendar,
            "dim_customer": _dim_customer,
            "dim_supplier": _dim_supplier,
            "dim_item": _dim_item,
            "dim_warehouse": lambda wh: wh.spark.sql(WAREHOUSES),
            "dim_subsidiary": lambda wh: wh.spark.sql(SUBSIDIARIES),
            "item_supplier": _item_supplier,
            "item_tier": _item_tier,
            "item_sourcing": _item_sourcing,
            "order_lines": _order_lines,
            "orders_with_lines": _orders_with_lines,
            "shipped_orders": _fulfillment_line,
            "o2c_sales_order_line": _sales_order_line,
            "o2c_fulfillment_line": _fulfillment_public,
            "o2c_return_line": _return_line,
            "invoice_terms": _ar_invoice_terms,
            "ar_invoice": lambda wh: wh["invoice_terms"].drop("credit_days"),
            "ar_payment_application": _ar_payment,
            "purchases": _purchases,
            "p2p_purchase_order_line": lambda wh: wh["purchases"].drop("payment_days"),
            "p2p_vendor_bill": _vendor_bill,
            "p2p_bill_payment": _bill_payment,
            "inv_balance_snapshot": lambda wh: _stock_levels(wh, wh["dim_item"]),
            "inv_transaction": lambda wh: derive.inventory_ledger(
                wh["p2p_purchase_order_line"], wh["o2c_fulfillment_line"], wh["dim_item"]
            ),
            "gl_journal_line": _journal,
            "gl_account_balance": lambda wh: derive.roll_gl_balances(wh["gl_journal_line"], reset="never"),
        },
        spreads={"inv_balance_snapshot": Spread("dim_item", "item_key", _stock_levels)},
    )


def _sales_order(wh: Warehouse) -> DataFrame:
    status = (
        F.when(F.col("o_orderstatus") == "F", "Delivered")
        .when(F.col("o_orderstatus") == "O", "Confirmed")
        .when(F.col("o_orderkey") % 3 == 0, "Cancelled")
        .otherwise("Pending")
    )
    orders = wh["orders_with_lines"].withColumn("primary_item", F.coalesce("line_item_key", F.lit(1)))
    # one row per item by construction: Catalyst drops the join where no category is asked for
    items = wh["part"].groupBy(F.col("p_partkey").alias("primary_item")).agg(F.max("p_type").alias("primary_item_category"))
    return orders.join(items, "primary_item", "left").select(
        F.col("o_orderkey").alias("order_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("o_custkey").alias("customer_id"),
        status.alias("order_status"),
        F.col("o_totalprice").alias("total_amount"),
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
        "primary_item_category",
        (F.col("o_totalprice") * 0.55 / F.coalesce("line_count", F.lit(1))).alias("effective_unit_cost"),
        (45.0 + F.col("o_orderkey") % 5).alias("effective_gross_margin_pct"),
        (1 + F.col("o_orderkey") % 30).cast("int").alias("employee_id"),
        (F.col("o_orderkey") % 25).cast("int").alias("location_id"),
    )


def _dim_employee(wh: Warehouse) -> DataFrame:
    """Thirty people over the regions; the first three lead the others."""
    people = wh.spark.sql(EMPLOYEES)
    place = wh["region"].select(F.col("r_regionkey").alias("place"), F.col("r_name").alias("region"))
    return people.join(F.broadcast(place), "place").select("employee_id", "employee_name", "region", "manager_id")


def _dim_location(wh: Warehouse) -> DataFrame:
    return wh["nation"].join(F.broadcast(wh["region"]), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("location_id"), F.col("n_name").alias("location_name"), F.col("r_name").alias("region")
    )


def _industry(customer_key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, INDUSTRIES)), (1 + customer_key % len(INDUSTRIES)).cast("int"))


def _fact_invoice(wh: Warehouse) -> DataFrame:
    terms = wh["dim_customer"].select("customer_id", "terms_days")
    lag = (1 + F.col("order_id") % 7).cast("int")
    invoices = derive.derive_invoices(wh["fact_sales_order"], terms, lag)
    return invoices.withColumn("status", F.when(F.col("order_id") % 10 == 0, "Overdue").otherwise("Paid"))


def _fact_payment(wh: Warehouse) -> DataFrame:
    """One payment per invoice; every eleventh order pays in two parts."""
    parts = F.when(F.col("order_id") % 11 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    days = (20 + F.col("order_id") % 37 + 5 * F.col("part")).cast("int")
    return wh["fact_invoice"].withColumn("part", F.explode(parts)).select(
        (F.col("invoice_id") * 2 + F.col("part")).alias("payment_id"),
        "invoice_id", "customer_id",
        F.date_add("invoice_date", days).alias("payment_date"),
        (F.col("invoice_amount") / F.size(parts)).alias("payment_amount"),
    )


def furniture(spark: SparkSession, folder: str) -> Warehouse:
    """Orders, invoices and payments of the furniture tenant."""
    return Warehouse(
        spark,
        "furniture",
        {
            **{name: _raw(folder, name) for name in RAW_SCHEMAS},
            "order_lines": _order_lines,
            "orders_with_lines": _orders_with_lines,
            "dim_date": _calendar,
            "dim_customer": lambda wh: _dim_customer(wh).select(
                F.col("customer_key").alias("customer_id"),
                "customer_name",
                F.col("segment").alias("customer_segment"),
                "region",
                F.col("credit_days").cast("int").alias("terms_days"),
                _industry(F.col("customer_key")).alias("industry"),
            ),
            "dim_employee": _dim_employee,
            "dim_location": _dim_location,
            "fact_sales_order": _sales_order,
            "fact_invoice": _fact_invoice,
            "fact_payment": _fact_payment,
            "fact_gl_entry": lambda wh: derive.monthly_gl_postings(
                wh["fact_sales_order"], wh["fact_invoice"], wh["fact_payment"]
            ),
        },
    )


def published(spark: SparkSession, tenant: str, folder: str, catalog: Catalog = CATALOG) -> Warehouse:
    """A warehouse written by ``files.full_refresh``: one Parquet folder per table."""
    return Warehouse(
        spark,
        tenant,
        {t.name: _raw_folder(folder, t.name) for t in catalog.of_tenant(tenant)},
        catalog,
    )


def _raw_folder(folder: str, name: str) -> Callable[[Warehouse], DataFrame]:
    return lambda wh: wh.spark.read.parquet(f"{folder}/{name}")
