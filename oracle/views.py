"""Warehouse views as SQL over the raw tables, for the independent check of every query."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["dim_customer"] = """
SELECT c.c_custkey AS customer_key, c.c_name AS customer_name, c.c_mktsegment AS segment, r.r_name AS region,
  30 + 15 * (c.c_custkey % 3) AS credit_days, 'Net ' || CAST(30 + 15 * (c.c_custkey % 3) AS VARCHAR) AS credit_terms
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""
VIEWS["dim_supplier"] = """
SELECT s.s_suppkey AS supplier_key, s.s_name AS supplier_name, r.r_name AS region, 30 + 15 * (s.s_suppkey % 3) AS payment_days,
  'Net ' || CAST(30 + 15 * (s.s_suppkey % 3) AS VARCHAR) AS payment_terms,
  CASE WHEN s.s_suppkey % 20 = 0 THEN 'D' WHEN s.s_suppkey % 20 IN (1, 2) THEN 'C' WHEN s.s_suppkey % 20 <= 10 THEN 'B' ELSE 'A' END AS reliability_tier
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""
VIEWS["dim_item"] = """
SELECT p_partkey AS item_key, p_name AS item_name, p_type AS category, p_brand AS subcategory, p_retailprice AS list_price,
  p_retailprice * 0.6E0 AS unit_cost,
  CASE p_partkey % 3 WHEN 0 THEN 'Short' WHEN 1 THEN 'Medium' ELSE 'Long' END AS lead_time_class
FROM part"""
VIEWS["dim_warehouse"] = """
SELECT * FROM (VALUES (1, 'Warehouse 1', 'North'), (2, 'Warehouse 2', 'East'), (3, 'Warehouse 3', 'South'), (4, 'Warehouse 4', 'West'))
  v(warehouse_key, warehouse_name, region)"""
VIEWS["dim_subsidiary"] = """
SELECT * FROM (VALUES (1, 'Subsidiary 1'), (2, 'Subsidiary 2'), (3, 'Subsidiary 3')) v(subsidiary_key, subsidiary_name)"""
VIEWS["dim_date"] = """
SELECT year(d) * 10000 + month(d) * 100 + day(d) AS date_key, CAST(d AS DATE) AS full_date, dayname(d) AS day_of_week,
  day(d) AS day_of_month, weekofyear(d) AS week_of_year, month(d) AS month_num, monthname(d) AS month_name,
  quarter(d) AS quarter_num, 'FY' || strftime(d, '%y') || '-Q' || quarter(d) AS fiscal_period, year(d) AS year_num,
  month(d + INTERVAL 1 DAY) <> month(d) AS is_month_end, isodow(d) >= 6 AS is_weekend
FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM (
  SELECT CAST(MIN(CAST(o_orderdate AS DATE)) AS TIMESTAMP) AS lo, CAST(MAX(CAST(o_orderdate AS DATE)) + 120 AS TIMESTAMP) AS hi FROM orders))"""
VIEWS["item_supplier"] = """
SELECT p.p_partkey AS item_key, s.min_key + p.p_partkey % s.n AS supplier_key
FROM part p CROSS JOIN (SELECT MIN(s_suppkey) AS min_key, COUNT(*) AS n FROM supplier) s"""
VIEWS["order_lines"] = """
SELECT l_orderkey, MIN(l_partkey) AS item_key, SUM(l_quantity) AS qty, COUNT(*) AS line_count FROM lineitem GROUP BY l_orderkey"""
VIEWS["o2c_sales_order_line"] = """
SELECT o.o_orderkey AS so_line_key, CAST(o.o_orderdate AS DATE) AS order_date, o.o_custkey AS customer_key, COALESCE(x.item_key, 1) AS item_key,
  1 + o.o_orderkey % 4 AS warehouse_key, 1 + o.o_orderkey % 3 AS subsidiary_key,
  COALESCE(x.qty, 1E0) AS qty_ordered, o.o_totalprice AS ext_amount,
  o.o_totalprice * (0.55E0 + (o.o_orderkey % 5) / 20E0) AS ext_cost,
  CAST(o.o_orderdate AS DATE) + CAST(2 + o.o_orderkey % 4 AS INT) AS promised_ship_date
FROM orders o LEFT JOIN order_lines x ON o.o_orderkey = x.l_orderkey"""
VIEWS["o2c_fulfillment_line"] = """
SELECT s.so_line_key, s.customer_key, s.item_key, s.warehouse_key, s.subsidiary_key, s.order_date,
  CAST(1 + x.qty % 3 + CASE sup.reliability_tier WHEN 'D' THEN 5 WHEN 'C' THEN 3 WHEN 'B' THEN 1 ELSE 0 END AS INT) AS order_to_ship_days,
  s.order_date + CAST(1 + x.qty % 3 + CASE sup.reliability_tier WHEN 'D' THEN 5 WHEN 'C' THEN 3 WHEN 'B' THEN 1 ELSE 0 END AS INT) AS ship_date,
  CASE WHEN s.so_line_key % 17 = 0 THEN x.qty - 1 ELSE x.qty END AS qty_shipped
FROM o2c_sales_order_line s JOIN order_lines x ON s.so_line_key = x.l_orderkey
JOIN item_supplier m ON s.item_key = m.item_key JOIN dim_supplier sup ON m.supplier_key = sup.supplier_key"""
VIEWS["o2c_return_line"] = """
SELECT l_orderkey AS so_line_key, l_partkey AS item_key, l_quantity AS qty_returned, l_extendedprice AS credit_amount,
  CASE l_linenumber % 4 WHEN 0 THEN 'Damaged' WHEN 1 THEN 'Wrong Item' WHEN 2 THEN 'Overordered' ELSE 'Quality' END AS reason
FROM lineitem WHERE l_returnflag = 'R'"""
VIEWS["ar_invoice"] = """
SELECT f.so_line_key AS invoice_key, f.ship_date AS invoice_date, f.ship_date + CAST(c.credit_days AS INT) AS due_date,
  f.customer_key, f.subsidiary_key, s.ext_amount AS invoice_amount, s.ext_cost AS invoice_cost,
  CASE WHEN f.so_line_key % 10 = 0 THEN s.ext_amount ELSE 0E0 END AS open_balance
FROM o2c_fulfillment_line f JOIN o2c_sales_order_line s ON f.so_line_key = s.so_line_key JOIN dim_customer c ON f.customer_key = c.customer_key"""
VIEWS["ar_payment_application"] = """
SELECT i.invoice_key, i.customer_key, i.subsidiary_key, i.invoice_amount AS amount_applied,
  CAST(c.credit_days + CASE WHEN c.customer_key % 7 = 0 THEN 20 ELSE 4 END + i.invoice_key % 13 - 6 AS INT) AS days_to_pay,
  i.invoice_date + CAST(c.credit_days + CASE WHEN c.customer_key % 7 = 0 THEN 20 ELSE 4 END + i.invoice_key % 13 - 6 AS INT) AS payment_date
FROM ar_invoice i JOIN dim_customer c ON i.customer_key = c.customer_key WHERE i.open_balance = 0"""
VIEWS["p2p_purchase_order_line"] = """
SELECT l.l_orderkey AS po_number, CAST(l.l_shipdate AS DATE) AS po_date, m.supplier_key, l.l_partkey AS item_key,
  1 + l.l_orderkey % 3 AS subsidiary_key, l.l_quantity AS qty_ordered, l.l_quantity * i.unit_cost AS ext_cost,
  CAST(CASE sup.reliability_tier WHEN 'D' THEN 12 + l.l_orderkey % 7 WHEN 'C' THEN 5 + l.l_orderkey % 5 WHEN 'B' THEN l.l_orderkey % 5
       ELSE CASE WHEN l.l_orderkey % 8 = 0 THEN 1 ELSE 0 END END AS INT) AS late_days
FROM lineitem l JOIN item_supplier m ON l.l_partkey = m.item_key JOIN dim_supplier sup ON m.supplier_key = sup.supplier_key
JOIN dim_item i ON l.l_partkey = i.item_key"""
VIEWS["p2p_vendor_bill"] = """
SELECT p.po_number, p.supplier_key, p.subsidiary_key, p.ext_cost AS bill_amount,
  CASE WHEN p.po_number % 12 = 0 THEN p.ext_cost ELSE 0E0 END AS open_balance
FROM p2p_purchase_order_line p"""
VIEWS["p2p_bill_payment"] = """
SELECT p.po_number, p.supplier_key, p.subsidiary_key, p.ext_cost AS amount_paid, CAST(s.payment_days - 2 + p.po_number % 9 AS INT) AS days_to_pay,
  p.po_date + CAST(s.payment_days - 2 + p.po_number % 9 AS INT) AS payment_date
FROM p2p_purchase_order_line p JOIN dim_supplier s ON p.supplier_key = s.supplier_key WHERE p.po_number % 12 <> 0"""
VIEWS["inv_balance_snapshot"] = """
SELECT k.snapshot_date, i.item_key, 1 + i.item_key % 4 AS warehouse_key, 1 AS subsidiary_key,
  CAST((i.item_key * 7 + k.m * 13) % 29 AS INT) AS qty_on_hand,
  (i.item_key * 7 + k.m * 13) % 29 * i.unit_cost AS value_on_hand, (i.item_key * 7 + k.m * 13) % 29 = 0 AS is_stockout
FROM dim_item i CROSS JOIN (
  SELECT MAX(CAST(o_orderdate AS DATE)) AS snapshot_date, YEAR(o_orderdate) * 12 + MONTH(o_orderdate) AS m
  FROM orders GROUP BY YEAR(o_orderdate) * 12 + MONTH(o_orderdate)) k"""
VIEWS["inv_transaction"] = """
SELECT po_date AS txn_date, item_key, supplier_key, subsidiary_key, 'Receipt' AS txn_type, qty_ordered AS qty_delta, ext_cost AS value_delta
FROM p2p_purchase_order_line
UNION ALL SELECT f.ship_date, f.item_key, NULL, f.subsidiary_key, 'Issue', -f.qty_shipped, -f.qty_shipped * i.unit_cost
FROM o2c_fulfillment_line f JOIN dim_item i ON f.item_key = i.item_key"""
VIEWS["gl_journal_line"] = """
SELECT invoice_date AS posting_date, 'Accounts Receivable' AS account_name, subsidiary_key, invoice_amount AS net_amount FROM ar_invoice
UNION ALL SELECT invoice_date, 'Revenue', subsidiary_key, -invoice_amount FROM ar_invoice
UNION ALL SELECT invoice_date, 'COGS', subsidiary_key, invoice_cost FROM ar_invoice
UNION ALL SELECT invoice_date, 'Inventory', subsidiary_key, -invoice_cost FROM ar_invoice"""
VIEWS["gl_account_balance"] = """
SELECT year_num, month_num, account_name, period_balance,
  SUM(period_balance) OVER (PARTITION BY account_name ORDER BY year_num, month_num ROWS UNBOUNDED PRECEDING) AS ytd_balance
FROM (SELECT YEAR(posting_date) AS year_num, MONTH(posting_date) AS month_num, account_name, SUM(net_amount) AS period_balance
  FROM gl_journal_line GROUP BY 1, 2, 3)"""
VIEWS["fact_sales_order"] = """
SELECT o.o_orderkey AS order_id, CAST(o.o_orderdate AS DATE) AS order_date, o.o_custkey AS customer_id,
  CASE WHEN o.o_orderstatus = 'F' THEN 'Delivered' WHEN o.o_orderstatus = 'O' THEN 'Confirmed'
       WHEN o.o_orderkey % 3 = 0 THEN 'Cancelled' ELSE 'Pending' END AS order_status,
  o.o_totalprice AS total_amount, COALESCE(x.line_count, 0) AS line_count, i.category AS primary_item_category,
  o.o_totalprice * 0.55E0 / COALESCE(x.line_count, 1) AS effective_unit_cost,
  45E0 + o.o_orderkey % 5 AS effective_gross_margin_pct, 1 + o.o_orderkey % 30 AS employee_id, o.o_orderkey % 25 AS location_id
FROM orders o LEFT JOIN order_lines x ON o.o_orderkey = x.l_orderkey LEFT JOIN dim_item i ON COALESCE(x.item_key, 1) = i.item_key"""
VIEWS["furniture_customer"] = """
SELECT customer_key AS customer_id, customer_name, segment AS customer_segment, region, credit_days AS terms_days,
  CASE customer_key % 5 WHEN 0 THEN 'Retail' WHEN 1 THEN 'Hospitality' WHEN 2 THEN 'Healthcare' WHEN 3 THEN 'Education' ELSE 'Offices' END AS industry
FROM dim_customer"""
VIEWS["dim_employee"] = """
SELECT k AS employee_id, 'Employee ' || k AS employee_name, r_name AS region, CASE WHEN k > 3 THEN 1 + k % 3 END AS manager_id
FROM generate_series(1, 30) g(k) JOIN region ON r_regionkey = k % 5"""
VIEWS["dim_location"] = """
SELECT n_nationkey AS location_id, n_name AS location_name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"""
VIEWS["fact_invoice"] = """
SELECT o.order_id AS invoice_id, o.order_id, o.order_date + CAST(1 + o.order_id % 7 AS INT) AS invoice_date,
  o.order_date + CAST(1 + o.order_id % 7 AS INT) + CAST(COALESCE(c.terms_days, 30) AS INT) AS due_date,
  o.customer_id, o.total_amount AS invoice_amount, ROUND(o.total_amount * 0.08E0, 2) AS tax_amount,
  CASE WHEN o.order_id % 10 = 0 THEN 'Overdue' ELSE 'Paid' END AS status
FROM fact_sales_order o LEFT JOIN furniture_customer c ON o.customer_id = c.customer_id WHERE o.order_status <> 'Cancelled'"""
VIEWS["fact_payment"] = """
SELECT i.invoice_id * 2 + p.part AS payment_id, i.invoice_id, i.customer_id,
  i.invoice_date + CAST(20 + i.order_id % 37 + 5 * p.part AS INT) AS payment_date,
  i.invoice_amount / CASE WHEN i.order_id % 11 = 0 THEN 2 ELSE 1 END AS payment_amount
FROM fact_invoice i JOIN (VALUES (1), (2)) p(part) ON p.part = 1 OR i.order_id % 11 = 0"""


def _needed(sql: str) -> list[str]:
    """Views a query reads, in definition order, with the views those read."""
    wanted: set[str] = set()
    frontier = [sql]
    while frontier:
        text = frontier.pop()
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                frontier.append(VIEWS[name])
    return [name for name in VIEWS if name in wanted]


def over_views(sql: str) -> str:
    """The query with the views it needs in front."""
    sql = sql.strip()
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in _needed(sql))
    if not views:
        return sql
    if sql.upper().startswith("WITH "):
        return f"WITH {views},\n{sql[5:]}"
    return f"WITH {views}\n{sql}"
