"""The catalogue of the two built-in warehouses."""

from __future__ import annotations

from ledgerloom.catalog import Catalog, Column, Table

# Accepted values of the enumerated columns.
TIERS = ("A", "B", "C", "D")
LEAD_CLASSES = ("Short", "Medium", "Long")
ORDER_STATUSES = ("Confirmed", "Delivered", "Cancelled", "Pending")
INVOICE_STATUSES = ("Paid", "Open", "Overdue", "Voided")
RETURN_REASONS = ("Damaged", "Wrong Item", "Overordered", "Quality")
MOVEMENTS = ("Receipt", "Issue")


def _table(tenant: str, kind: str, name: str, description: str, *columns: Column) -> Table:
    return Table(tenant, name, columns, kind, description)


def pk(name: str, type_: str = "BIGINT") -> Column:
    return Column(name, type_, primary_key=True)


def fk(name: str, target: str, type_: str = "BIGINT") -> Column:
    return Column(name, type_, foreign_key=target)


def day(name: str, calendar: str = "dim_date.full_date") -> Column:
    return Column(name, "DATE", foreign_key=calendar)


def num(name: str) -> Column:
    return Column(name, "DOUBLE")


def whole(name: str) -> Column:
    return Column(name, "INTEGER")


def one_of(name: str, values: tuple[str, ...]) -> Column:
    return Column(name, "VARCHAR", values=values)


def _calendar(tenant: str) -> Table:
    return _table(
        tenant, "dimension", "dim_date", "One row per calendar day.",
        pk("date_key", "INTEGER"), Column("full_date", "DATE", nullable=False), Column("day_of_week"),
        whole("day_of_month"), whole("week_of_year"), whole("month_num"), Column("month_name"),
        whole("quarter_num"), Column("fiscal_period"), whole("year_num"),
        Column("is_month_end", "BOOLEAN"), Column("is_weekend", "BOOLEAN"), Column("is_holiday", "BOOLEAN"),
    )


CUSTOMER = fk("customer_key", "dim_customer.customer_key")
ITEM = fk("item_key", "dim_item.item_key")
SUPPLIER = fk("supplier_key", "dim_supplier.supplier_key")
SITE = fk("warehouse_key", "dim_warehouse.warehouse_key")
COMPANY = fk("subsidiary_key", "dim_subsidiary.subsidiary_key")

_D = "distributor"
_F = "furniture"

CATALOG = Catalog.of(
    [
        _calendar(_D),
        _table(_D, "dimension", "dim_subsidiary", "Legal entities.", pk("subsidiary_key"), Column("subsidiary_name")),
        _table(
            _D, "dimension", "dim_warehouse", "Stocking sites.",
            pk("warehouse_key"), Column("warehouse_name"),
            Column("region"),
        ),
        _table(
            _D, "dimension", "dim_item", "Stocked items with category and cost.",
            pk("item_key"), Column("item_name"), Column("category"), Column("subcategory"),
            num("list_price"), num("unit_cost"), one_of("lead_time_class", LEAD_CLASSES),
        ),
        _table(
            _D, "dimension", "dim_customer", "Customers with segment, region and credit terms.",
            pk("customer_key"), Column("customer_name"), Column("segment"), Column("region"), Column("credit_days", "BIGINT"),
            Column("credit_terms"),
        ),
        _table(
            _D, "dimension", "dim_supplier", "Suppliers with terms and reliability tier.",
            pk("supplier_key"), Column("supplier_name"), Column("region"), Column("payment_days", "BIGINT"),
            Column("payment_terms"), one_of("reliability_tier", TIERS),
        ),
        _table(_D, "bridge", "item_supplier", "The single supplier of each item.", ITEM, SUPPLIER),
        _table(
            _D, "fact", "o2c_sales_order_line", "Sales order lines.",
            pk("so_line_key"), day("order_date"), CUSTOMER, ITEM, SITE, COMPANY, num("qty_ordered"),
            num("ext_amount"), num("ext_cost"), day("promised_ship_date"),
        ),
        _table(
            _D, "fact", "o2c_fulfillment_line", "Shipped order lines; unshipped orders have no row.",
            fk("so_line_key", "o2c_sales_order_line.so_line_key"), CUSTOMER, ITEM, SITE, COMPANY, day("order_date"),
            whole("order_to_ship_days"), day("ship_date"), num("qty_shipped"),
        ),
        _table(
            _D, "fact", "o2c_return_line", "Returned lines with credit and reason.",
            fk("so_line_key", "o2c_sales_order_line.so_line_key"), ITEM, num("qty_returned"), num("credit_amount"),
            one_of("reason", RETURN_REASONS),
        ),
        _table(
            _D, "fact", "ar_invoice", "Customer invoices, one per shipped line.",
            pk("invoice_key"), day("invoice_date"), day("due_date"), CUSTOMER, COMPANY, num("invoice_amount"),
            num("invoice_cost"), num("open_balance"),
        ),
        _table(
            _D, "fact", "ar_payment_application", "Customer payments; unpaid invoices have no row.",
            fk("invoice_key", "ar_invoice.invoice_key"), CUSTOMER, COMPANY, num("amount_applied"),
            whole("days_to_pay"), day("payment_date"),
        ),
        _table(
            _D, "fact", "p2p_purchase_order_line", "Purchase order lines with days late.",
            Column("po_number", "BIGINT"), day("po_date"), SUPPLIER, ITEM, COMPANY, num("qty_ordered"), num("ext_cost"),
            whole("late_days"),
        ),
        _table(
            _D, "fact", "p2p_vendor_bill", "Supplier bills.",
            Column("po_number", "BIGINT"), SUPPLIER, COMPANY, num("bill_amount"), num("open_balance"),
        ),
        _table(
            _D, "fact", "p2p_bill_payment", "Payments to suppliers.",
            Column("po_number", "BIGINT"), SUPPLIER, COMPANY, num("amount_paid"), whole("days_to_pay"), day("payment_date"),
        ),
        _table(
            _D, "fact", "inv_balance_snapshot", "Stock per item and site on each snapshot day.",
            day("snapshot_date"), ITEM, SITE, fk("subsidiary_key", "dim_subsidiary.subsidiary_key", "INTEGER"),
            whole("qty_on_hand"), num("value_on_hand"), Column("is_stockout", "BOOLEAN"),
        ),
        _table(
            _D, "fact", "inv_transaction", "Stock movements; issues have no supplier.",
            Column("txn_date", "DATE"), ITEM, SUPPLIER, COMPANY, one_of("txn_type", MOVEMENTS),
            num("qty_delta"), num("value_delta"),
        ),
        _table(
            _D, "fact", "gl_journal_line", "Ledger entries.",
            day("posting_date"), Column("account_name"), COMPANY, num("net_amount"),
        ),
        _table(
            _D, "fact", "gl_account_balance", "Monthly balance per account.",
            whole("year_num"), whole("month_num"), Column("account_name"), num("period_balance"), num("ytd_balance"),
        ),
        _calendar(_F),
        _table(
            _F, "dimension", "dim_customer", "Customers with segment, region and terms.",
            pk("customer_id"), Column("customer_name"), Column("customer_segment"), Column("region"), whole("terms_days"),
            Column("industry"),
        ),
        _table(
            _F, "dimension", "dim_employee", "Sales staff; leaders have no manager.",
            pk("employee_id", "INTEGER"), Column("employee_name"), Column("region"),
            fk("manager_id", "dim_employee.employee_id", "INTEGER"),
        ),
        _table(
            _F, "dimension", "dim_location", "Places of sale.",
            pk("location_id", "INTEGER"), Column("location_name"), Column("region"),
        ),
        _table(
            _F, "fact", "fact_sales_order", "Sales orders.",
            pk("order_id"), day("order_date"), fk("customer_id", "dim_customer.customer_id"),
            one_of("order_status", ORDER_STATUSES), num("total_amount"), Column("line_count", "BIGINT"),
            Column("primary_item_category"), num("effective_unit_cost"),
            num("effective_gross_margin_pct"), fk("employee_id", "dim_employee.employee_id", "INTEGER"),
            fk("location_id", "dim_location.location_id", "INTEGER"),
        ),
        _table(
            _F, "fact", "fact_invoice", "Customer invoices.",
            pk("invoice_id"), fk("order_id", "fact_sales_order.order_id"), day("invoice_date"), day("due_date"),
            fk("customer_id", "dim_customer.customer_id"), num("invoice_amount"), num("tax_amount"),
            one_of("status", INVOICE_STATUSES),
        ),
        _table(
            _F, "fact", "fact_payment", "Customer payments.",
            pk("payment_id"), fk("invoice_id", "fact_invoice.invoice_id"), fk("customer_id", "dim_customer.customer_id"),
            day("payment_date"), num("payment_amount"),
        ),
        _table(
            _F, "fact", "fact_gl_entry", "Monthly ledger postings.",
            whole("year_num"), whole("month_num"), Column("account_code"), Column("account_type"),
            num("debit_amount"), num("credit_amount"),
        ),
    ]
)
