import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates, labels, text
from ledgerloom.operators import derive, insights, maintenance, quality, ranking


def values(spark, numbers, name="x"):
    return spark.createDataFrame([(float(n),) for n in numbers], f"{name} double").repartition(3)


@pytest.mark.parametrize("n", [1, 2, 5, 20, 101, 1000])
def test_exact_quantile_and_top_share(spark, n):
    rng = random.Random(n)
    numbers = [rng.choice([rng.random(), float(rng.randint(1, 3)), 1e9 * rng.random()]) for _ in range(n)]
    df = values(spark, numbers)
    for p in (0.2, 0.5, 0.8):
        ours = ranking.exact_quantile(df, "x", p).collect()[0][0]
        assert ours == pytest.approx(df.agg(F.expr(f"percentile(x, {p})")).collect()[0][0])
    largest = sorted(numbers, reverse=True)[: -(-n * 2 // 10)]
    assert ranking.top_fraction_share(df, "x", 0.2).collect()[0][0] == pytest.approx(sum(largest) / sum(numbers))


def test_order_statistics_of_nothing_and_of_one_hot_value(spark):
    assert ranking.exact_quantile(values(spark, []), "x", 0.2).collect()[0][0] is None
    hot = values(spark, [5.0] * 900 + list(range(100)))
    assert ranking.exact_quantile(hot, "x", 0.2).collect()[0][0] == 5.0


@pytest.mark.parametrize("n", [2_000, 200_000])
@pytest.mark.parametrize("fraction", [0.0, 0.31, 1.0])
def test_a_rank_bracket_holds_a_bounded_number_of_values(spark, n, fraction):
    df = spark.range(n).select((F.xxhash64("id") / 1e6).alias("x")).union(spark.range(n).select(F.lit(0.5).alias("x")))
    wanted = F.floor(F.lit(fraction) * (F.col("n") - 1))
    held = []
    for narrowings in (0, 1, 2):
        row = ranking.rank_bracket(df, "x", fraction, wanted, 100, 20, narrowings).collect()[0]
        assert df.where(F.col("x") < row["low"]).count() <= row["rank"] < df.where(F.col("x") <= row["high"]).count()
        held.append(df.where(F.col("x").between(row["low"], row["high"])).distinct().count())
    # the sketch holds six parts of 100 and its error; a narrowing keeps four of 20 parts and their edges
    assert held[0] <= 2 * n * 0.08 + 2
    assert held[1] <= held[0] * 0.22 + 5 and held[2] <= held[1] * 0.22 + 5


def test_selection_runs_nothing_while_planned(spark):
    context, df = spark.sparkContext, values(spark, range(500))
    context.setJobGroup("planned", "no job")
    try:
        ranking.exact_quantile(df, "x", 0.4)
        assert context.statusTracker().getJobIdsForGroup("planned") == []
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_neighbour_gaps(spark):
    rng = random.Random(3)
    numbers = [rng.choice([rng.random(), 1e6 * rng.random(), 7.0]) for _ in range(3000)]
    found = {r["value"]: r["lower"] for r in ranking.neighbour_gaps(values(spark, numbers), "x").collect()}
    ordered = sorted(set(numbers))
    assert found == {b: a for a, b in zip([None, *ordered], ordered)}


def test_top_n_tie_is_settled_by_key(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0), (4, 1.0)], "k int, v double")
    assert [r["k"] for r in ranking.top_n(df, 2, F.col("v").desc(), F.col("k")).collect()] == [1, 2]


def test_labels(spark):
    rows = [
        (None, None, None), ("avg_po_late_days_by_supplier", 580.0, 0.125), ("THE dso of__x", 1449.0, 1234567.0),
        ("a_b", 28000.0, -2500.0), ("", 65000.0, 12.5), ("ccc", -1.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "t string, ms double, v double").select(
        labels.title_case(F.col("t")), labels.duration_label(F.col("ms")), labels.amount_label(F.col("v"))
    )
    assert [tuple(r) for r in df.collect()] == [
        ("", "—", "—"), ("Avg PO Late Days by Supplier", "580ms", "12.5%"), ("The DSO of X", "1.4s", "$1.23M"),
        ("A B", "28s", "$-2.5K"), ("", "1m 5s", "12.5"), ("CCC", "—", "0"),
    ]


def test_month_label_outside_the_year(spark):
    df = spark.createDataFrame([(2024, 2), (2024, 13)], "y int, m int")
    assert [r[0] for r in df.select(labels.month_label(F.col("y"), F.col("m"))).collect()] == ["Feb 2024", "13 2024"]


def test_cosine_of_an_empty_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([2.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(text.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_date_keys(spark):
    df = spark.createDataFrame([(date(2024, 2, 29),)], "d date")
    row = df.select(dates.date_to_key(F.col("d")).alias("k")).select("k", dates.key_to_date(F.col("k"))).collect()[0]
    assert tuple(row) == (20240229, date(2024, 2, 29))


def test_calendar(spark):
    bounds = spark.createDataFrame([(date(2023, 12, 30), date(2024, 1, 2))], "first_day date, last_day date")
    rows = {r["date_key"]: r for r in dates.build_calendar(bounds, [date(2024, 1, 1)]).collect()}
    assert len(rows) == 4
    assert rows[20231231]["is_month_end"] and rows[20231231]["is_weekend"] and rows[20231231]["fiscal_period"] == "FY23-Q4"
    assert rows[20240101]["is_holiday"] and rows[20240101]["week_of_year"] == 1 and rows[20240101]["day_of_week"] == "Monday"


def test_journal_balances(spark):
    billed = spark.createDataFrame([(date(2024, 1, 1), 100.0, 60.0)], "d date, amount double, cost double")
    rows = derive.post_journal(billed, "d", "amount", "cost").collect()
    assert len(rows) == 4
    assert sum(r["debit_amount"] for r in rows) == sum(r["credit_amount"] for r in rows) == 160.0


def test_running_balance_reset(spark):
    journal = spark.createDataFrame(
        [(date(2023, 12, 1), "Revenue", 10.0), (date(2024, 1, 5), "Revenue", 1.0), (date(2024, 2, 5), "Revenue", 2.0)],
        "posting_date date, account_name string, net_amount double",
    )
    by_month = lambda reset: [
        r["ytd_balance"] for r in derive.roll_gl_balances(journal, reset).orderBy("year_num", "month_num").collect()
    ]
    assert by_month("year") == [10.0, 1.0, 3.0]
    assert by_month("never") == [10.0, 11.0, 13.0]


def test_open_balance_counts_payments_up_to_the_horizon(spark):
    invoices = spark.createDataFrame([(1, 100.0), (2, 50.0), (3, 10.0)], "invoice_key bigint, invoice_amount double")
    payments = spark.createDataFrame(
        [(1, date(2024, 1, 1), 60.0), (1, date(2024, 3, 1), 40.0), (2, date(2024, 3, 1), 50.0)],
        "invoice_key bigint, payment_date date, amount_applied double",
    )
    found = derive.open_balance(invoices, payments, date(2024, 2, 1))
    assert {r["invoice_key"]: r["open_balance"] for r in found.collect()} == {1: 40.0, 2: 50.0, 3: 10.0}


def test_multi_sourced_item_is_reported(spark):
    bridge = spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "item_key bigint, supplier_key bigint")
    assert [tuple(r) for r in derive.multi_sourced_items(bridge).collect()] == [(1, 2)]


def test_patch_column(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    patch = spark.createDataFrame([(1, 10), (2, 20)], "k int, p int")
    done = maintenance.patch_column(target, patch, "k", "p")
    assert {r["k"]: r["p"] for r in done.collect()} == {1: 10, 2: 20}
    with pytest.raises(ValueError, match="already present"):
        maintenance.patch_column(done, patch, "k", "p")
    with pytest.raises(Exception, match="no p for k 2"):
        maintenance.patch_column(target, patch.where("k = 1"), "k", "p").collect()


def test_relabel(spark):
    dim = spark.createDataFrame([(1, "Old 1"), (2, "Old 2")], "k int, name string")
    new = spark.createDataFrame([(1, "Fresh")], "k int, new_label string")
    done = maintenance.relabel(dim, new, "k", "name")
    assert {r["k"]: r["name"] for r in done.collect()} == {1: "Fresh", 2: "Old 2"}
    assert tuple(maintenance.relabel_audit(done, "name", "Old %").collect()[0]) == (2, 2, 1, True)


def test_contribution_keeps_a_negative_share(spark):
    df = spark.createDataFrame([("a", 30.0), ("b", 10.0), ("c", -4.0)], "l string, v double")
    assert {r["label"]: r["share"] for r in insights.contribution(df, "l", "v").collect()} == {"a": 75.0, "b": 25.0, "c": -10.0}
    none = spark.createDataFrame([("a", 0.0), ("b", -1.0)], "l string, v double")
    assert [r["share"] for r in insights.contribution(none, "l", "v").collect()] == [0.0, 0.0]


def test_trend_names(spark):
    by_month = spark.createDataFrame([(2024, 1, 5.0), (2024, 2, 7.0), (2024, 3, 5.0)], "year_num int, month_num int, days_to_pay double")
    rows = insights.trend(by_month)
    assert [(r["period"], r["value"], r["column_name"]) for r in rows.collect()][0] == ("Jan 2024", 5.0, "days_to_pay")
    summary = insights.trend_summary(rows).collect()[0]
    assert (summary["peak_period"], summary["low_period"]) == ("Feb 2024", "Jan 2024")
    assert insights.trend_summary(rows.limit(2)).count() == 0
    with pytest.raises(ValueError, match="no time column"):
        insights.trend(spark.createDataFrame([(1.0,)], "days_to_pay double"))


BREAK = [16.3, 15.3, 15.2, 14.9, 14.7, 14.3, 13.9, 7.9, 7.8, 7.8, 7.5, 7.4, 7.2, 7.0, 6.9, 6.7]


def test_natural_break(spark):
    row = insights.natural_break(values(spark, BREAK), "x").collect()[0]
    assert (row["row_count"], row["has_break"], row["prefix_rows"], row["threshold"]) == (16, True, 7, 13.9)
    first = insights.natural_break(values(spark, BREAK), "x", pick="first").collect()[0]
    assert (first["prefix_rows"], first["threshold"]) == (1, 16.3)
    even = insights.natural_break(values(spark, range(16)), "x").collect()[0]
    assert (even["has_break"], even["prefix_rows"], even["threshold"]) == (False, 16, None)
    few = insights.natural_break(values(spark, BREAK[:15]), "x").collect()[0]
    assert not few["has_break"]
    same = insights.natural_break(values(spark, [3] * 20), "x").collect()[0]
    assert (same["has_break"], same["prefix_rows"]) == (False, 20)


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 5, None, None), (2, 5, None, 1)], "a int, b int, c int, d int")
    assert {r[0]: r[1] for r in insights.constant_columns(df).collect()} == {"b": "5", "c": None}
    assert insights.constant_columns(df.where("a > 9")).count() == 0


def test_shapes(spark):
    one = spark.createDataFrame([(1,)], "v int")
    shape = lambda df: insights.result_shape(df).collect()[0][0]
    assert (shape(one), shape(one.union(one)), shape(one.where("v > 1"))) == ("single_stat", "table", "empty")
    table = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "month string, v double")
    assert tuple(insights.applicable_views(table).collect()[0]) == (True, True)
    assert tuple(insights.applicable_views(table.limit(1)).collect()[0]) == (False, False)


def test_quality_checks_fail_when_they_should(spark):
    ids = spark.createDataFrame([("furniture:1",), ("distributor:2",), (None,)], "id string")
    row = quality.isolated(ids, "id", "distributor").collect()[0]
    assert (row["actual"], row["passed"]) == (1.0, False)
    years = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 6.0)], "y int, v double")
    assert not quality.grows(years, "y", "v").collect()[0]["passed"]
    days = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 3),), (date(2024, 1, 3),)], "full_date date")
    assert {r["check_id"]: r["passed"] for r in quality.date_spine(days, date(2024, 1, 1)).collect()} == {
        "spine:gaps": False, "spine:repeats": False, "spine:lo": True
    }
    tiers = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("C", 1.5)], "t string, v double")
    assert not quality.gradient(tiers, "t", ["v"], 3).collect()[0]["passed"]
    assert quality.only_values(tiers, "t", ["A", "B", "C"], "c").collect()[0]["passed"]
    assert not quality.in_band(years.agg(F.max("v").alias("v")), "v", 7, 8, "b").collect()[0]["passed"]
    empty = years.where("y > 9")
    assert not quality.compression(empty, "y", "v", 1.0).collect()[0]["passed"]
    assert not quality.parity(years, years.limit(2), {"v": F.col("v")}, "p").collect()[0]["passed"]
