from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.metrics.registry import ALL_METRICS, metric, validate_metrics
from ledgerloom.metrics.together import merged, together
from ledgerloom.periods import Period
from ledgerloom.sources.schemas import CATALOG
from ledgerloom.sources.warehouse import Warehouse


def warehouse(spark, tenant, **rows):
    """A warehouse over hand-made rows."""
    made = {}
    for name, (ddl, data) in rows.items():
        made[name] = lambda _wh, ddl=ddl, data=data: spark.createDataFrame(data, ddl)
    return Warehouse(spark, tenant, made, CATALOG)


ORDERS = (
    "order_id bigint, order_date date, customer_id bigint, order_status string, total_amount double, line_count bigint, "
    "primary_item_category string, effective_unit_cost double, effective_gross_margin_pct double"
)


def order(i, day, customer, status, amount):
    return (i, day, customer, status, amount, 1, "Chairs", amount * 0.5, 50.0)


@pytest.fixture()
def furniture(spark):
    orders = [
        order(1, date(2023, 5, 1), 1, "Delivered", 100.0),
        order(2, date(2024, 1, 31), 1, "Confirmed", 300.0),
        order(3, date(2024, 2, 1), 2, "Delivered", 100.0),
        order(4, date(2024, 2, 2), 2, "Cancelled", 900.0),
        order(5, date(2024, 2, 3), None, "Delivered", 50.0),
        order(6, date(2024, 2, 4), 3, "Pending", 70.0),
    ]
    customers = [(1, "One", "SMB", "West", 30), (2, "Two", "SMB", "East", 30), (3, "Three", "Enterprise", "East", 30)]
    return warehouse(
        spark,
        "furniture",
        fact_sales_order=(ORDERS, orders),
        dim_customer=("customer_id bigint, customer_name string, customer_segment string, region string, terms_days int", customers),
    )


def one(df):
    return df.collect()[0]


def test_active_orders_only(furniture):
    assert one(metric("total_revenue", "furniture").compute(furniture))[0] == 550.0


def test_null_key_drops_out_of_a_slice_only(furniture):
    rows = metric("total_revenue", "furniture").compute(furniture, by=["dim_customer.region"]).collect()
    assert {r["region"]: r["total_revenue"] for r in rows} == {"West": 400.0, "East": 100.0}


def test_filter_on_a_dimension(furniture):
    rows = metric("total_revenue", "furniture").compute(
        furniture, by=["dim_date.year"], where={"dim_customer.region": ["West", "South"]}
    )
    assert {r["year"]: r["total_revenue"] for r in rows.collect()} == {2023: 100.0, 2024: 300.0}


def test_empty_period_has_no_ratio(furniture):
    row = one(metric("gross_margin_pct", "furniture").compute(furniture, period=Period.year(1990)))
    assert row["gross_margin_pct"] is None
    assert one(metric("order_volume", "furniture").compute(furniture, period=Period.year(1990)))["order_volume"] == 0


def test_growth_without_prior_year_is_null(furniture):
    growth = metric("revenue_growth_yoy", "furniture")
    assert one(growth.compute(furniture, period=Period.year(2023)))["revenue_growth_yoy"] is None
    assert one(growth.compute(furniture, period=Period.year(2024)))["revenue_growth_yoy"] == pytest.approx(350.0)


def test_concentration_breaks_ties_by_key(furniture):
    share = metric("top_customer_concentration", "furniture").compute(furniture, n=1)
    assert one(share)[0] == pytest.approx(400 / 550 * 100)


def test_churn(furniture):
    churn = metric("customer_churn_count", "furniture")
    assert one(churn.compute(furniture, start=date(2024, 1, 1)))[0] == 0
    assert one(churn.compute(furniture, start=date(2025, 1, 1)))[0] == 2
    # customer 2's only order is not more than 90 days before the start
    assert one(churn.compute(furniture, start=date(2024, 4, 1)))[0] == 1


def test_repeat_rate(furniture):
    rate = metric("repeat_customer_rate", "furniture").compute(
        furniture, period=Period.quarter(2024, 1), prior=Period.quarter(2023, 2)
    )
    # customers 1, 2 and the unknown one bought; only customer 1 had bought before
    assert one(rate)[0] == pytest.approx(100 / 3)


def test_undeclared_dimension_is_refused(furniture):
    with pytest.raises(ValueError, match="may not be sliced"):
        metric("cogs", "furniture").compute(furniture, by=["dim_customer.customer_segment"])
    with pytest.raises(ValueError, match="cannot run on tenant"):
        metric("total_revenue").compute(furniture)


def test_overlapping_periods_are_compared_apart(furniture):
    compared = metric("total_revenue", "furniture").compare(
        furniture, Period.between(date(2023, 1, 1), date(2024, 12, 31)), Period.year(2024)
    )
    row = one(compared)
    assert (row["current_value"], row["prior_value"], row["sentiment"]) == (550.0, 450.0, "Favorable")


def test_metrics_computed_together_are_as_alone(furniture):
    names = ["total_revenue", "cogs", "cancellation_rate", "order_volume", "active_customer_count", "average_order_value"]
    for by, period in (((), None), (("dim_customer.region",), Period.year(2024)), (("dim_date.year", "dim_customer.region"), None)):
        wide = together(furniture, [metric(n, "furniture") for n in names], by, period)
        keys = [a.split(".")[1] for a in by]
        for name in names:
            alone = metric(name, "furniture").compute(furniture, by=by, period=period).select(*keys, F.col(name).cast("double"))
            shared = wide.where(f"has_{name}").select(*keys, F.col(name).cast("double"))
            assert sorted(map(tuple, shared.collect())) == sorted(map(tuple, alone.collect())), (name, by)
    with pytest.raises(ValueError, match="together"):
        together(furniture, [metric("customer_churn_count", "furniture")])


def test_metrics_of_one_fact_share_a_scan(distributor):
    names = ["total_revenue", "gross_margin_pct", "return_rate_pct", "order_count", "avg_order_value"]
    legs = [leg for n in names for leg in metric(n).legs if leg.fact == "o2c_sales_order_line"]
    plain, per_order = [leg for leg in legs if not leg.per], [leg for leg in legs if leg.per]
    one, places = merged(plain, "x")
    # revenue, margin, the count of lines and of rows: equal parts are computed once
    assert len(plain) == 3 and len(one.parts) == 3
    assert places[0]["revenue"] == places[1]["revenue"]
    two, _ = merged(per_order, "x")
    assert len(per_order) == 2 and len(two.outer) == 4
    text = together(distributor, [metric(n) for n in names])._jdf.queryExecution().optimizedPlan().toString()
    alone = sum(metric(n).compute(distributor)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") for n in names)
    assert text.count("LogicalRDD") < alone


def test_filters_that_differ_move_into_the_parts():
    ledger = [metric(n).legs[0] for n in ("gl_revenue_by_period", "gl_cogs_trend")]
    one, places = merged(ledger, "x")
    assert one.keep == "(account_name = 'Revenue') or (account_name = 'COGS')"
    assert places[0]["balance"] != places[1]["balance"]
    assert "account_name = 'COGS'" in one.parts[places[1]["balance"]].expr


def test_validation_flags_a_value_out_of_range(furniture):
    rows = validate_metrics(furniture, {"total_revenue": (0, 500), "order_volume": (1, 10)}).collect()
    assert {r["check_id"]: r["passed"] for r in rows} == {"furniture:total_revenue": False, "furniture:order_volume": True}


@pytest.fixture()
def distributor(spark):
    sales = [
        (1, date(2024, 1, 1), 1, 1, 1, 1, 5.0, 100.0, 60.0, date(2024, 1, 4)),
        (2, date(2024, 1, 1), 1, 1, 2, 1, 5.0, 100.0, 60.0, date(2024, 1, 4)),
        (3, date(2024, 1, 2), 2, 2, 1, 2, 5.0, 100.0, 60.0, date(2024, 1, 4)),
        (4, date(2024, 1, 3), 2, 2, 1, 2, 5.0, 100.0, 60.0, date(2024, 1, 4)),
    ]
    shipped = [
        (1, 1, 1, 1, 1, date(2024, 1, 1), 2, date(2024, 1, 3), 5.0),
        (2, 1, 1, 2, 1, date(2024, 1, 1), 9, date(2024, 1, 10), 5.0),
        (3, 2, 2, 1, 2, date(2024, 1, 2), 1, date(2024, 1, 3), 4.0),
    ]
    stock = [(date(2024, 1, d), i, 1, 1, q, q * 10.0, q == 0) for d in (1, 2) for i, q in ((1, 0), (2, 4))]
    return warehouse(
        spark,
        "distributor",
        o2c_sales_order_line=(
            "so_line_key bigint, order_date date, customer_key bigint, item_key bigint, warehouse_key bigint, subsidiary_key bigint, "
            "qty_ordered double, ext_amount double, ext_cost double, promised_ship_date date", sales),
        o2c_fulfillment_line=(
            "so_line_key bigint, customer_key bigint, item_key bigint, warehouse_key bigint, subsidiary_key bigint, order_date date, "
            "order_to_ship_days int, ship_date date, qty_shipped double", shipped),
        o2c_return_line=("so_line_key bigint, item_key bigint, qty_returned double, credit_amount double, reason string", []),
        inv_balance_snapshot=(
            "snapshot_date date, item_key bigint, warehouse_key bigint, subsidiary_key int, qty_on_hand int, value_on_hand double, "
            "is_stockout boolean", stock),
        item_supplier=("item_key bigint, supplier_key bigint", [(1, 7), (2, 8)]),
        dim_supplier=(
            "supplier_key bigint, supplier_name string, region string, payment_days bigint, payment_terms string, reliability_tier string",
            [(7, "S7", "West", 30, "Net 30", "A"), (8, "S8", "West", 30, "Net 30", "D")]),
    )


def test_never_shipped_short_and_late_are_misses(distributor):
    assert one(metric("otif_pct").compute(distributor))[0] == 25.0


def test_bridge_reaches_the_supplier_of_a_stock_row(distributor):
    rows = metric("stockout_rate_pct").compute(distributor, by=["dim_supplier.reliability_tier"]).collect()
    assert {r[0]: r[1] for r in rows} == {"A": 100.0, "D": 0.0}


def test_no_returns_is_a_rate_of_zero(distributor):
    assert one(metric("return_rate_pct").compute(distributor))[0] == 0.0


def test_semi_additive_stock(distributor):
    assert one(metric("inventory_value_on_hand").compute(distributor))[0] == 40.0
    # 40 a day on stock; cost 120, 60 and 60 on three days
    assert one(metric("dio_days").compute(distributor))[0] == pytest.approx(40 / 80)


def test_period_arithmetic():
    assert Period.quarter(2024, 1).prior_quarter() == Period.quarter(2023, 4)
    assert Period.month(2024, 3).shift_months(-1) == Period.month(2024, 2)
    assert Period.year(2024).prior_year() == Period.year(2023)
    assert not Period.year(2024).overlaps(Period.year(2025))


def test_period_on_integer_keys(spark):
    keys = spark.createDataFrame([(20231231,), (20240101,), (20240331,), (20240401,)], "k int")
    assert [r[0] for r in keys.where(Period.quarter(2024, 1).on_key(F.col("k"))).collect()] == [20240101, 20240331]


@pytest.mark.parametrize("tenant", ["distributor", "furniture"])
def test_every_declared_dimension_is_planned(tenant, spark, sf_dir):
    from ledgerloom.sources import warehouse
    from ledgerloom.workload.metric_queries import ARGUMENTS

    wh = getattr(warehouse, tenant)(spark, sf_dir)
    for (owner, name), spec in ALL_METRICS.items():
        if owner == tenant:
            for attribute in spec.dimensions:
                assert spec.compute(wh, by=(attribute,), **ARGUMENTS.get((owner, name), {})).columns


def test_a_promise_without_a_path_is_refused():
    from dataclasses import replace

    from ledgerloom.metrics.registry import check_reachable
    from ledgerloom.sources.schemas import CATALOG

    spec = replace(metric("order_count"), dimensions=("dim_supplier.supplier_name", "dim_customer.nothing"))
    with pytest.raises(ValueError, match="dim_customer.nothing"):
        check_reachable({1: spec}, CATALOG)


def test_a_borrowed_period_reaches_the_scan_of_the_parent(spark, sf_dir):
    from ledgerloom.periods import Period
    from ledgerloom.sources.warehouse import distributor

    plan = metric("return_rate_pct").compute(distributor(spark, sf_dir), period=Period.year(1999))
    text = plan._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in text.splitlines() if "orders.parquet" in line]
    assert len(scans) == 2 and all("1999" in line.split("PushedFilters")[1] for line in scans)


def test_stock_levels_joined_with_items_first_keep_every_row(spark):
    """Repeated and missing item keys count as they do when the finished fact is joined."""
    from ledgerloom.sources.warehouse import distributor

    part = [
        (1, "a", "b1", "LARGE", 1, 10.0), (1, "a", "b1", "SMALL", 1, 20.0), (2, "c", "b2", "SMALL", 1, 5.0),
        (2, "c", "b2", "SMALL", 1, 5.0), (None, "d", "b2", "LARGE", 1, 7.0), (3, "e", "b1", None, 1, 9.0), (29, "f", "b1", "LARGE", 1, None),
    ]
    days = ["2000-01-05", "2000-01-31", "2000-02-10", "2001-03-01"]
    rows = {
        "part": spark.createDataFrame(part, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": spark.createDataFrame(
            [(i, 1, "F", 100.0, d, "1") for i, d in enumerate(days)],
            "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string",
        ).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")),
        "supplier": spark.createDataFrame([(s, f"s{s}", 0, 1.0) for s in (0, 1, 4)], "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    }
    wh = distributor(spark, "/root/testdata/sf0.001").replaced(**rows)
    whole = wh.replaced(inv_balance_snapshot=wh["inv_balance_snapshot"])
    assert wh.spreads and not whole.spreads
    item, tier, site = "dim_item.category", "dim_supplier.reliability_tier", "dim_warehouse.warehouse_name"
    for by, where, period in [
        ([item], None, None), ([tier], None, None), ([item, site], None, Period.year(2000)), ([], {item: "SMALL"}, None),
        ([site], {item: ["SMALL", "LARGE"]}, None), ([item, "dim_date.year_num"], {site: "Warehouse 2"}, None), ([], {tier: "D"}, None),
    ]:
        names = ["stockout_rate_pct"] + (["inventory_turns"] if tier not in [*by, *(where or {})] and "dim_date.year_num" not in by else [])
        for name in names:
            found, expected = (
                sorted(map(repr, metric(name).compute(w, by=by, where=where, period=period).collect())) for w in (wh, whole)
            )
            assert found == expected and found, (name, by, where)
