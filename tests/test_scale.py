"""Plan shapes that decide whether a query survives large and skewed tables."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from ledgerloom.metrics.registry import metric
from ledgerloom.operators import ranking
from ledgerloom.periods import Period
from ledgerloom.plans import analyses
from ledgerloom.retrieval.lexical import bm25
from ledgerloom.sources import files
from ledgerloom.sources.warehouse import distributor

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_period_and_columns_reach_the_scan(spark):
    wh = distributor(spark, SMALL)
    text = plan(metric("total_revenue").compute(wh, by=["dim_customer.segment"], period=Period.year(2000)))
    assert "GreaterThanOrEqual(o_orderdate,2000-01-01" in text
    assert "lineitem" not in text, "the order-line join is not needed for revenue"
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in text


def test_facts_are_combined_before_dimensions_are_joined(no_broadcast):
    wh = distributor(no_broadcast, SMALL)
    text = plan(metric("total_revenue").compute(wh, by=["dim_customer.segment"]))
    join = text.index("SortMergeJoin")
    assert "partial_sum" in text[join:], "partial sums run below the join"


@pytest.mark.parametrize(
    "name",
    [
        "revenue_by_segment_region_year", "distributor_supplier_lateness_cash_impact", "lateness_impact_customer_date",
        "distributor_slow_moving_inventory_value", "analysis_customers_hit_twice", "analysis_pareto_shares",
        "quality_foreign_keys_distributor", "insight_drivers_of_revenue", "retrieval_bm25", "distributor_cash_conversion_cycle_days",
    ],
)
def test_no_cartesian_product_without_broadcasts(no_broadcast, name):
    text = plan(entry_point.queries()[name](no_broadcast, SMALL))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text, "no row-at-a-time Python"


def test_only_tiny_tables_are_broadcast_by_hint(no_broadcast):
    wh = distributor(no_broadcast, SMALL)
    text = plan(metric("otif_pct").compute(wh, by=["dim_customer.segment"]))
    built = re.findall(r"BroadcastExchange.*?\n(.*?)(?=BroadcastHashJoin|SortMergeJoin|\Z)", text, re.S)
    scans = {t for b in built for t in re.findall(r"/(\w+)\.parquet", b)[:1]}
    assert scans <= {"nation", "region"}


def test_hot_item_join_is_split(no_broadcast):
    spark = no_broadcast
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        hot = spark.range(300_000).select(
            "id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000).alias("item_key"), F.rand(1).alias("x")
        )
        tiers = spark.range(1000).select(F.col("id").alias("item_key"), (F.col("id") % 4).alias("tier"))
        joined = hot.repartition(8, "id").join(tiers.repartition(4, "tier"), "item_key").select("tier", "x", "id")
        assert joined.write.format("noop").mode("overwrite").save() is None
        assert joined.count() == 300_000
        joined.collect()
        assert "skew" in plan(joined)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_top_n_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    text = plan(ranking.top_n_per_group(df, ["g"], 3, F.col("v").desc()))
    assert re.search(r"WindowGroupLimit.*Final.*WindowGroupLimit.*Partial", text, re.S)
    assert text.index("Exchange") < text.index("Partial")


def test_bm25_tokenises_the_corpus_once_per_pass(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("lang").alias("tenant"), "text")
    asked = spark.read.parquet(f"{SMALL}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.lit("en").alias("tenant"), "text")
    text = plan(bm25(docs, asked))
    assert not re.search(r"Filter .*regexp_extract_all", text)


def test_bucketed_lines_join_without_a_shuffle(no_broadcast, tmp_path):
    spark = no_broadcast
    spark.sql(f"CREATE DATABASE bucketed LOCATION '{tmp_path}/db'")
    try:
        raw = distributor(spark, SMALL)
        wh = files.bucket_by_line(raw, "bucketed", 4)
        otif = metric("otif_pct").compute(wh)
        text = plan(otif)
        assert "SortMergeJoin" in text and "hashpartitioning(so_line_key" not in text
        assert otif.collect() == metric("otif_pct").compute(raw).collect()
    finally:
        spark.sql("DROP DATABASE bucketed CASCADE")


def test_shared_frames_are_checkpointed_where_the_cluster_names_a_folder(spark, tmp_path):
    wh = distributor(spark, SMALL)
    plain = sorted(map(tuple, analyses.customers_hit_twice(wh).collect()))
    share = [r[0] for r in analyses.pareto_shares(wh).select(F.round("share", 9)).collect()]
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        hit = analyses.customers_hit_twice(wh)
        assert "Scan ExistingRDD" in plan(hit) and "lineitem" not in plan(hit)
        assert sorted(map(tuple, hit.collect())) == plain
        assert [r[0] for r in analyses.pareto_shares(wh).select(F.round("share", 9)).collect()] == share
        assert metric("slow_moving_inventory_value").compute(wh).count() == 1
    finally:
        spark.sparkContext._jsc.sc().setCheckpointDir(None)
    assert spark.sparkContext.getCheckpointDir() is None


def test_fact_and_item_side_are_both_freshly_shuffled(no_broadcast):
    """AQE splits a hot key only when both inputs of the join are shuffles of their own."""
    wh = distributor(no_broadcast, SMALL)
    for fact, key in (("purchases", "item_key"), ("shipped_orders", "item_key"), ("invoice_terms", "customer_key")):
        joins = re.split(r"\n", plan(wh[fact]))
        top = next(i for i, line in enumerate(joins) if "SortMergeJoin" in line and key in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        sorts = [i for i in range(top + 1, len(joins)) if depth(joins[i]) == depth(joins[top]) + 3]
        assert len(sorts) == 2
        assert all("Sort" in joins[i] and "Exchange hashpartitioning" in joins[i + 1] for i in sorts), fact


def test_stock_levels_take_the_category_before_the_months(no_broadcast):
    """A group for each item and day would be as large as the fact: no task may hold such groups."""
    wh = distributor(no_broadcast, SMALL)
    item, tier, site = "dim_item.category", "dim_supplier.reliability_tier", "dim_warehouse.warehouse_name"
    for name, by in (("dio_days", [item]), ("inventory_turns", [item]), ("stockout_rate_pct", [tier]), ("stockout_rate_pct", [item, site])):
        text = plan(metric(name).compute(wh, by=by))
        months = text.index("Generate")
        assert "SortMergeJoin" in text[months:], "the items are joined below the months"
        grouped = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", text[:months])
        assert grouped and not any("__k_item_key" in keys and "snapshot_date" in keys for keys in grouped)


def test_metric_validation_makes_shared_joins_once(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        text = plan(entry_point.queries()["validate_distributor_metrics"](spark, SMALL))
        scans = re.findall(r"FileScan parquet.*?/(\w+)\.parquet", text)
        assert "Scan ExistingRDD" in text
        assert scans.count("lineitem") < 8, "19 where each metric joins the lines for itself"
        assert scans.count("part") < 16, "32 where purchases meet their items anew"
    finally:
        spark.sparkContext._jsc.sc().setCheckpointDir(None)


def test_stock_pressure_groups_no_item_by_day(no_broadcast):
    text = plan(entry_point.queries()["analysis_category_stock_pressure"](no_broadcast, SMALL))
    grouped = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", text)
    assert grouped and not any("__k_item_key" in keys and "snapshot_date" in keys for keys in grouped)


def test_stock_pressure_reads_stock_by_category_and_day(no_broadcast):
    """Plans name the item's key as the step does: ``__k_item_key`` is never seen in them."""
    text = plan(entry_point.queries()["analysis_category_stock_pressure"](no_broadcast, SMALL))
    grouped = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", text)
    daily = [keys for keys in grouped if "snapshot_date" in keys]
    assert daily and not any("item_key" in keys for keys in grouped if "order_date" not in keys)
