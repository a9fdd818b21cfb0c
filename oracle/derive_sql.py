"""SQL for derived facts, loading jobs, labels and scalar functions."""

from __future__ import annotations

CALENDAR = """SELECT date_key, strftime(full_date, '%Y-%m-%d') AS full_date, day_of_week, day_of_month, week_of_year, month_num, month_name,
  quarter_num, fiscal_period, year_num, is_month_end, is_weekend FROM dim_date"""
PROMISE = """SELECT s.so_line_key, s.order_date, LEAST(GREATEST(s.order_date + CAST(CASE i.lead_time_class WHEN 'Short' THEN 2 WHEN 'Medium' THEN 3 ELSE 4 END AS INT),
  (SELECT MIN(full_date) FROM dim_date)), (SELECT MAX(full_date) FROM dim_date)) AS promised FROM o2c_sales_order_line s JOIN dim_item i USING (item_key)"""
RELABELLED = """SELECT customer_key, CASE WHEN segment = 'BUILDING' THEN 'Builder ' || customer_key ELSE customer_name END AS customer_name, segment FROM dim_customer"""
AMOUNT = """CASE WHEN ABS({v}) >= 1000000 THEN '$' || CAST(CAST(ROUND({v} / 1000000, 2) AS DECIMAL(18, 2)) AS VARCHAR) || 'M'
  WHEN ABS({v}) >= 1000 THEN '$' || CAST(CAST(ROUND({v} / 1000, 1) AS DECIMAL(18, 1)) AS VARCHAR) || 'K'
  WHEN {v} > 0 AND {v} < 1 THEN CAST(CAST(ROUND({v} * 100, 1) AS DECIMAL(18, 1)) AS VARCHAR) || '%'
  ELSE regexp_replace(regexp_replace(CAST(CAST(ROUND({v}, 2) AS DECIMAL(18, 2)) AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') END"""


def _balances(keys: str) -> str:
    return f"""SELECT year_num, month_num, account_name, ROUND(v, 4) + 0.0 AS period_balance,
      ROUND(SUM(v) OVER (PARTITION BY {keys} ORDER BY year_num, month_num ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS ytd_balance
      FROM (SELECT YEAR(posting_date) AS year_num, MONTH(posting_date) AS month_num, account_name, SUM(net_amount) v FROM gl_journal_line GROUP BY 1, 2, 3)"""


def sql() -> dict[str, str]:
    count = lambda t, shown="": f"SELECT '{shown or t}' AS table_name, COUNT(*) AS row_count FROM {t}"
    furniture = [count("dim_date"), count("furniture_customer", "dim_customer"), *[count(t) for t in ("dim_employee", "dim_location", "fact_sales_order", "fact_invoice", "fact_payment")]]
    distributor = [
        count(t) for t in (
            "dim_date", "dim_subsidiary", "dim_warehouse", "dim_item", "dim_customer", "dim_supplier", "item_supplier", "o2c_sales_order_line",
            "o2c_fulfillment_line", "o2c_return_line", "ar_invoice", "ar_payment_application", "p2p_purchase_order_line", "p2p_vendor_bill",
            "p2p_bill_payment", "inv_balance_snapshot", "inv_transaction", "gl_journal_line", "gl_account_balance",
        )
    ]
    f, d = " UNION ALL ".join(furniture), " UNION ALL ".join(distributor)
    return {
        "derive_calendar": CALENDAR,
        "derive_invoices": """SELECT invoice_id, order_id, strftime(invoice_date, '%Y-%m-%d') AS invoice_date, strftime(due_date, '%Y-%m-%d') AS due_date,
          customer_id, ROUND(invoice_amount, 4) AS invoice_amount, ROUND(tax_amount, 4) AS tax_amount, status FROM fact_invoice""",
        "derive_promise_dates": f"""SELECT so_line_key, strftime(order_date, '%Y-%m-%d') AS order_date, strftime(promised, '%Y-%m-%d') AS promised_ship_date
          FROM ({PROMISE})""",
        "derive_inventory_ledger": """SELECT strftime(txn_date, '%Y-%m-%d') AS txn_date, item_key, COALESCE(supplier_key, -1) AS supplier_key, subsidiary_key, txn_type,
          ROUND(qty_delta, 4) + 0.0 AS qty_delta, ROUND(value_delta, 4) + 0.0 AS value_delta FROM inv_transaction""",
        "derive_journal_by_month": """SELECT YEAR(d) AS year_num, MONTH(d) AS month_num, account_name, ROUND(SUM(dr), 4) AS debit_amount, ROUND(SUM(cr), 4) AS credit_amount,
          ROUND(SUM(dr - cr), 4) AS net_amount, COUNT(*) AS entries FROM (
            SELECT invoice_date d, 'Accounts Receivable' AS account_name, invoice_amount dr, 0E0 cr FROM ar_invoice
            UNION ALL SELECT invoice_date, 'Revenue', 0E0, invoice_amount FROM ar_invoice
            UNION ALL SELECT invoice_date, 'COGS', invoice_cost, 0E0 FROM ar_invoice
            UNION ALL SELECT invoice_date, 'Inventory', 0E0, invoice_cost FROM ar_invoice) GROUP BY 1, 2, 3""",
        "derive_balances_yearly": _balances("account_name, year_num"),
        "derive_balances_running": _balances("account_name"),
        "derive_monthly_postings": """WITH a AS (SELECT YEAR(invoice_date) y, MONTH(invoice_date) m, SUM(invoice_amount) rev FROM fact_invoice GROUP BY 1, 2),
          b AS (SELECT YEAR(payment_date) y, MONTH(payment_date) m, SUM(payment_amount) paid FROM fact_payment GROUP BY 1, 2),
          c AS (SELECT YEAR(order_date) y, MONTH(order_date) m, SUM(CASE WHEN order_status <> 'Cancelled' THEN total_amount * (1 - effective_gross_margin_pct / 100) END) cogs,
            SUM(CASE WHEN order_status = 'Cancelled' THEN total_amount END) refunds FROM fact_sales_order GROUP BY 1, 2),
          k AS (SELECT y, m FROM a UNION SELECT y, m FROM b UNION SELECT y, m FROM c),
          s AS (SELECT k.y, k.m, COALESCE(rev, 0) rev, COALESCE(cogs, 0) cogs, GREATEST(0, COALESCE(rev, 0) - COALESCE(paid, 0)) ar, COALESCE(refunds, 0) ref
            FROM k LEFT JOIN a ON a.y = k.y AND a.m = k.m LEFT JOIN b ON b.y = k.y AND b.m = k.m LEFT JOIN c ON c.y = k.y AND c.m = k.m)
          SELECT y AS year_num, m AS month_num, account_code, account_type, ROUND(dr, 1) AS debit_amount, ROUND(cr, 1) AS credit_amount FROM (
            SELECT y, m, '4000-Revenue' AS account_code, 'Revenue' AS account_type, 0E0 dr, ROUND(rev, 2) cr FROM s
            UNION ALL SELECT y, m, '5000-COGS', 'COGS', ROUND(cogs, 2), 0E0 FROM s
            UNION ALL SELECT y, m, '1200-AR', 'Asset', ROUND(ar, 2), 0E0 FROM s
            UNION ALL SELECT y, m, '4500-Refunds', 'Revenue', ROUND(ref, 2), 0E0 FROM s) WHERE dr <> 0 OR cr <> 0""",
        "derive_item_supplier_bridge": "SELECT DISTINCT item_key, supplier_key FROM p2p_purchase_order_line",
        "derive_multi_sourced_items": """SELECT item_key, COUNT(DISTINCT supplier_key) AS suppliers FROM p2p_purchase_order_line
          GROUP BY 1 HAVING COUNT(DISTINCT supplier_key) > 1""",
        "derive_open_balances": """SELECT i.invoice_key, ROUND(CASE WHEN p.invoice_key IS NULL THEN i.invoice_amount ELSE 0 END, 4) AS open_balance
          FROM ar_invoice i LEFT JOIN ar_payment_application p ON p.invoice_key = i.invoice_key AND p.payment_date <= DATE '2000-06-30'""",
        "load_csv_round_trip": CALENDAR,
        "load_full_refresh": f"WITH t AS ({f}) SELECT table_name, row_count, row_count AS audited_rows FROM t",
        "load_patch_column": f"SELECT so_line_key, strftime(promised, '%Y-%m-%d') AS promised_ship_date FROM ({PROMISE})",
        "load_relabel_dimension": RELABELLED,
        "load_relabel_audit": f"""SELECT COUNT(*) AS labels, COUNT(DISTINCT customer_name) AS distinct_labels,
          COUNT(CASE WHEN customer_name LIKE 'Customer#%' THEN 1 END) AS old_style_left, COUNT(*) = COUNT(DISTINCT customer_name) AS one_to_one FROM ({RELABELLED})""",
        "load_rescale_measures": """SELECT YEAR(order_date) AS year_num, ROUND(SUM(total_amount / 20), 4) AS total,
          SUM(total_amount / 20) BETWEEN 25000000 AND 30000000 AS in_range FROM fact_sales_order GROUP BY 1""",
        "load_sync_parity": """SELECT 'parity:suppliers:rows' AS check_id, 'difference between the copies' AS label, '0' AS expected, 0E0 AS actual,
            COUNT(*) = COUNT(supplier_key) AS passed FROM dim_supplier
          UNION ALL SELECT 'parity:suppliers:payment_days', 'difference between the copies', '0', SUM(payment_days) * 0E0, TRUE FROM dim_supplier""",
        "load_sync_parts": """SELECT YEAR(order_date) AS order_year, COUNT(*) AS source_rows, COUNT(CASE WHEN YEAR(order_date) <> 1999 THEN 1 END) AS copy_rows,
            1 AS pass FROM o2c_sales_order_line GROUP BY 1 HAVING YEAR(order_date) = 1999 OR bool_or(order_date = DATE '1997-03-03')""",
        "load_catalog_counts": f"WITH t AS ({d}) SELECT * FROM t UNION ALL SELECT 'total', SUM(row_count)::BIGINT FROM t",
        "load_bounded_result": """SELECT COUNT(*) AS row_count, COUNT(*) > 100 AS truncated FROM (SELECT DISTINCT item_key FROM o2c_sales_order_line)""",
        "load_normalized_types": """SELECT invoice_id, CAST(CAST(invoice_amount AS DECIMAL(18, 2)) AS DOUBLE) AS invoice_amount,
          strftime(due_date, '%Y-%m-%d') AS due_date, MONTH(invoice_date) AS month FROM fact_invoice""",
        "load_guarded_result": """SELECT c.segment, ROUND(SUM(s.ext_amount), 4) AS revenue FROM o2c_sales_order_line s JOIN dim_customer c USING (customer_key) GROUP BY 1""",
        "date_arithmetic": """SELECT so_line_key, YEAR(order_date) * 10000 + MONTH(order_date) * 100 + DAY(order_date) AS date_key,
          strftime(order_date, '%Y-%m-%d') AS back, strftime(LEAST(GREATEST(order_date, DATE '1996-01-01'), DATE '2000-12-31'), '%Y-%m-%d') AS clamped,
          DATEDIFF('day', order_date, promised_ship_date) AS days_promised, strftime(order_date - 90, '%Y-%m-%d') AS ninety_before,
          'FY' || strftime(order_date, '%y') || '-Q' || QUARTER(order_date) AS fiscal_period FROM o2c_sales_order_line""",
        "label_periods": """SELECT 'Q' || QUARTER(order_date) || ' ' || YEAR(order_date) AS quarter, strftime(order_date, '%b %Y') AS month, COUNT(*) AS orders
          FROM o2c_sales_order_line GROUP BY 1, 2""",
        "label_titles": """SELECT p_partkey, 'DSO by ' || list_aggregate(list_transform(string_split(p_name, ' '),
          lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') || ' vs PO' AS title FROM part""",
        "label_durations": """SELECT event_id, CASE WHEN ms < 1000 THEN CAST(CAST(ROUND(ms) AS BIGINT) AS VARCHAR) || 'ms'
          WHEN ms < 10000 THEN CAST(CAST(ROUND(ms / 1000, 1) AS DECIMAL(18, 1)) AS VARCHAR) || 's'
          WHEN ms < 60000 THEN CAST(CAST(ROUND(ms / 1000) AS BIGINT) AS VARCHAR) || 's'
          ELSE CAST(CAST(FLOOR(ms / 60000) AS BIGINT) AS VARCHAR) || 'm ' || CAST(CAST(ROUND((ms / 1000) % 60) AS BIGINT) AS VARCHAR) || 's' END AS duration
          FROM (SELECT event_id, event_id * 37E0 AS ms FROM events)""",
        "label_amounts": f"""SELECT l_orderkey, {AMOUNT.format(v='amount')} AS cell,
          CASE WHEN ABS(amount) >= 1000000 THEN '$' || CAST(CAST(ROUND(amount / 1000000, 1) AS DECIMAL(18, 1)) AS VARCHAR) || 'M'
            WHEN ABS(amount) >= 1000 THEN '$' || CAST(CAST(ROUND(amount / 1000) AS BIGINT) AS VARCHAR) || 'K'
            ELSE regexp_replace(CAST(CAST(ROUND(amount, 1) AS DECIMAL(18, 1)) AS VARCHAR), '\\.0$', '') END AS axis,
          {AMOUNT.format(v='(l_orderkey / 30011E0)')} AS small
          FROM (SELECT l_orderkey, ROUND(SUM(l_extendedprice), 2) AS amount FROM lineitem GROUP BY 1)""",
        "label_metric_sentiment": """SELECT doc_id, CASE WHEN quality = 1 THEN 'Favorable' WHEN toxic = 1 THEN 'Unfavorable' ELSE 'Neutral' END AS label FROM labels""",
        "text_token_estimates": """SELECT doc_id, LEN(regexp_extract_all(lower(text), '\\w+')) AS tokens, CAST(CEIL(LENGTH(text) / 4E0) AS BIGINT) AS estimate,
          ROUND((CEIL(LENGTH(text) / 4E0) + 1000) / 1000000, 6) AS cost FROM documents""",
        "text_fences_and_truncation": """SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS unfenced, LEFT(text, 80) AS shown FROM conversations""",
        "text_referenced_names": """SELECT doc_id, COALESCE(list_aggregate(list_sort(list_distinct(regexp_extract_all(text, '\\b(re\\w+|th\\w+)\\b', 1))), 'string_agg', ','), '') AS names
          FROM documents""",
        "text_sigmoid": "SELECT event_id, ROUND(1 / (1 + EXP(-(value / 100E0 - 1))), 6) AS probability FROM events",
    }
