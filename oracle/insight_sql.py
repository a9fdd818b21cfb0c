"""SQL for the insight operators."""

from __future__ import annotations

from oracle.metric_sql import sql as metric_sql

SEGMENTS = "SELECT c.segment AS label, SUM(s.ext_amount) AS value FROM o2c_sales_order_line s JOIN dim_customer c USING (customer_key) GROUP BY 1"
SHARE = "ROUND(CASE WHEN SUM(GREATEST(value, 0)) OVER ({w}) > 0 THEN value / SUM(GREATEST(value, 0)) OVER ({w}) * 100 ELSE 0 END, 4) + 0.0"
MONTHS = """SELECT YEAR(order_date) * 100 + MONTH(order_date) AS sort_key, strftime(MIN(order_date), '%b %Y') AS period, SUM(ext_amount) AS value
  FROM o2c_sales_order_line GROUP BY 1"""


def _drivers(measure: str, dims: list[tuple[str, str]]) -> str:
    source = "o2c_sales_order_line s JOIN dim_customer c USING (customer_key) JOIN dim_item i USING (item_key)"
    sides = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {col} AS label, {measure} AS value FROM {source} GROUP BY 2" for d, col in dims)
    return f"""WITH v AS ({sides}), k AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY value DESC, label) AS rank FROM v)
      SELECT dimension, rank, label, ROUND(value, 4) AS value, {SHARE.format(w='PARTITION BY dimension')} AS share FROM k WHERE rank <= 8"""


def _first_break(source: str) -> str:
    return f"""WITH x AS ({source}), g AS (SELECT v, v - LAG(v) OVER (ORDER BY v) AS gap FROM (SELECT DISTINCT v FROM x)),
      t AS (SELECT quantile_cont(gap, 0.5) AS typical FROM g), e AS (SELECT MAX(v) AS edge FROM g, t WHERE gap >= 2 * typical)
      SELECT COUNT(*) AS row_count, COUNT(*) > 15 AND MAX(edge) IS NOT NULL AS has_break,
        CASE WHEN COUNT(*) > 15 AND MAX(edge) IS NOT NULL THEN COUNT(CASE WHEN v >= edge THEN 1 END) ELSE COUNT(*) END AS prefix_rows,
        CASE WHEN COUNT(*) > 15 THEN ROUND(MAX(edge), 4) END AS threshold FROM x, e"""


def _break(source: str) -> str:
    return f"""WITH x AS ({source}), g AS (SELECT v, v - LAG(v) OVER (ORDER BY v) AS gap FROM (SELECT DISTINCT v FROM x)),
      t AS (SELECT quantile_cont(gap, 0.5) AS typical, MAX(gap) AS widest FROM g),
      e AS (SELECT MAX(v) AS edge FROM g, t WHERE gap = widest),
      r AS (SELECT COUNT(*) AS n, COUNT(CASE WHEN v >= edge THEN 1 END) AS above, MAX(edge) AS edge FROM x, e)
      SELECT n AS row_count, n > 15 AND widest >= 2 * typical AS has_break, CASE WHEN n > 15 AND widest >= 2 * typical THEN above ELSE n END AS prefix_rows,
        CASE WHEN n > 15 AND widest >= 2 * typical THEN ROUND(edge, 4) END AS threshold FROM r, t"""


def sql() -> dict[str, str]:
    yoy = metric_sql()["revenue_yoy_by_segment"]
    segment, category, region = ("dim_customer.segment", "c.segment"), ("dim_item.category", "i.category"), ("dim_customer.region", "c.region")
    return {
        "insight_contribution": f"SELECT label, ROUND(value, 4) AS value, {SHARE.format(w='')} AS share FROM ({SEGMENTS})",
        "insight_contribution_signed": f"SELECT label, value, {SHARE.format(w='')} AS share FROM (SELECT segment AS label, delta AS value FROM ({yoy}))",
        "insight_trend": f"SELECT period, ROUND(value, 4) AS value, 'revenue' AS column_name, sort_key FROM ({MONTHS})",
        "insight_trend_summary": f"""WITH m AS ({MONTHS}) SELECT (SELECT COUNT(*) FROM m) AS periods,
          (SELECT period FROM m ORDER BY value DESC, sort_key LIMIT 1) AS peak_period, (SELECT ROUND(MAX(value), 2) FROM m) AS peak,
          (SELECT period FROM m ORDER BY value, sort_key LIMIT 1) AS low_period, (SELECT ROUND(MIN(value), 2) FROM m) AS low,
          (SELECT ROUND(AVG(value), 2) FROM m) AS average""",
        "insight_drivers_of_revenue": _drivers("SUM(s.ext_amount)", [segment, category, region]),
        "insight_drivers_of_margin": _drivers("SUM(s.ext_amount - s.ext_cost) / SUM(s.ext_amount) * 100", [segment, category]),
        "insight_break_in_customer_revenue": _break("SELECT ROUND(SUM(ext_amount), 2) AS v FROM o2c_sales_order_line GROUP BY customer_key"),
        "insight_break_in_supplier_lateness": _break("SELECT ROUND(AVG(late_days), 4) AS v FROM p2p_purchase_order_line GROUP BY supplier_key"),
        "insight_first_break_in_supplier_lateness": _first_break("SELECT ROUND(AVG(late_days), 4) AS v FROM p2p_purchase_order_line GROUP BY supplier_key"),
        "insight_constant_columns": " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CAST(MIN({c}) AS VARCHAR) AS constant_value FROM inv_balance_snapshot HAVING COUNT(DISTINCT {c}) = 1"
            for c in ("snapshot_date", "item_key", "warehouse_key", "subsidiary_key", "qty_on_hand", "value_on_hand", "is_stockout")
        ),
        "insight_result_shapes": """SELECT 'total' AS result, CASE WHEN COUNT(*) = 1 THEN 'single_stat' END AS shape, FALSE AS contribution, FALSE AS trend
            FROM (SELECT SUM(ext_amount) FROM o2c_sales_order_line)
          UNION ALL SELECT 'segments', CASE WHEN COUNT(*) > 0 THEN 'table' END, COUNT(*) > 1, FALSE FROM (SELECT DISTINCT segment FROM dim_customer)
          UNION ALL SELECT 'months', CASE WHEN COUNT(*) > 0 THEN 'table' END, FALSE, COUNT(*) > 1 FROM (SELECT DISTINCT strftime(order_date, '%Y-%m') FROM o2c_sales_order_line)
          UNION ALL SELECT 'nothing', 'empty', FALSE, FALSE""",
    }
