import json
import re
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.metrics.registry import metric
from ledgerloom.operators import quality
from ledgerloom.sources import files
from ledgerloom.sources.schemas import CATALOG
from ledgerloom.sources.warehouse import Warehouse, distributor

SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("amount", T.DecimalType(18, 2)),
        T.StructField("day", T.DateType()), T.StructField("flag", T.BooleanType()),
    ]
)


def test_csv_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,name,amount,day,flag\n1,Ann,10.50,2024-02-29,True\n2,,,,False\n3,Bo,1.00,2024-01-01,\n")
    rows = files.load_csv_table(spark, str(path), SCHEMA).orderBy("id").collect()
    assert tuple(rows[0])[3:] == (date(2024, 2, 29), True)
    assert tuple(rows[1]) == (2, None, None, None, False)
    assert rows[2]["flag"] is None


def test_csv_bad_value_raises(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,name,amount,day,flag\nx,Ann,1.0,2024-01-01,True\n")
    with pytest.raises(Exception):
        files.load_csv_table(spark, str(path), SCHEMA).collect()


CUSTOMER = "customer_key bigint, customer_name string, segment string, region string, credit_days bigint, credit_terms string"


def tiny(spark, key):
    customer = [(key, "One", "Building", "West", 30, "Net 30")]
    return Warehouse(spark, "distributor", {"dim_customer": lambda wh: spark.createDataFrame(customer, CUSTOMER)}, CATALOG)


def test_refresh_publishes_all_or_nothing(spark, tmp_path):
    folder = str(tmp_path / "wh")
    first = files.full_refresh(tiny(spark, 1), folder, ["dim_customer"], audit=f"{folder}/_audit")
    assert files.open_current(spark, "distributor", folder)["dim_customer"].first()["customer_key"] == 1
    with pytest.raises(ValueError, match="NULLs"):
        files.full_refresh(tiny(spark, None), folder, ["dim_customer"])
    assert files.open_current(spark, "distributor", folder)["dim_customer"].first()["customer_key"] == 1
    second = files.full_refresh(tiny(spark, 2), folder, ["dim_customer"], audit=f"{folder}/_audit")
    assert files.open_current(spark, "distributor", folder)["dim_customer"].first()["customer_key"] == 2
    audit = spark.read.parquet(f"{folder}/_audit").collect()
    assert {r["version"] for r in audit} == {first, second} and all(r["row_count"] == 1 for r in audit)


def test_published_warehouse_gives_the_same_metrics(spark, tmp_path):
    raw = distributor(spark, "/root/testdata/sf0.001")
    folder = str(tmp_path / "wh")
    files.full_refresh(raw, folder)
    stored = files.open_current(spark, "distributor", folder)
    assert set(stored) == set(raw)
    for name, by in (("otif_pct", ["dim_customer.segment"]), ("cash_conversion_cycle_days", []), ("stockout_rate_pct", ["dim_supplier.reliability_tier"])):
        rows = lambda wh: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in metric(name).compute(wh, by=by).collect())  # noqa: B023, E731
        assert rows(raw) == rows(stored)


def test_commits_are_only_added(spark, tmp_path):
    folder = str(tmp_path / "wh")
    with pytest.raises(ValueError, match="no published version"):
        files.current_version(spark, folder)
    assert [files.commit(spark, folder, v) for v in ("a", "b")] == [1, 2]
    # a commit that is still being written, and a stray file
    (tmp_path / "wh" / "_commits" / "000000000003").write_text("c\n")
    (tmp_path / "wh" / "_commits" / "note").write_text("x")
    assert files.current_version(spark, folder) == "b"
    assert files.commit(spark, folder, "d") == 4 and files.current_version(spark, folder) == "d"


def test_a_repeated_key_stops_the_refresh(spark, tmp_path):
    folder = str(tmp_path / "wh")
    files.full_refresh(tiny(spark, 1), folder, ["dim_customer"])
    twice = tiny(spark, 2)
    twice = twice.replaced(dim_customer=twice["dim_customer"].union(twice["dim_customer"]))
    with pytest.raises(ValueError, match="dim_customer.customer_key repeats"):
        files.full_refresh(twice, folder, ["dim_customer"])
    assert files.open_current(spark, "distributor", folder)["dim_customer"].first()["customer_key"] == 1


def test_a_period_opens_its_months_only(spark, tmp_path):
    from ledgerloom.periods import Period

    raw = distributor(spark, "/root/testdata/sf0.001")
    folder = str(tmp_path / "wh")
    files.full_refresh(raw, folder, ["o2c_sales_order_line"])
    stored = files.open_current(spark, "distributor", folder)
    period = Period.between(date(1999, 2, 10), date(1999, 3, 20))
    found = metric("total_revenue").compute(stored, period=period)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"order_date_month#\d+ >= 1999-02-01", text.split("PartitionFilters")[1].split("PushedFilters")[0])
    assert found.first()[0] == pytest.approx(metric("total_revenue").compute(raw, period=period).first()[0])
    days = stored["o2c_sales_order_line"].groupBy("order_date_month").agg(F.min("order_date").alias("a"), F.max("order_date").alias("b"))
    assert all(r.order_date_month == r.a.replace(day=1) == r.b.replace(day=1) for r in days.collect())


def test_only_parts_that_differ_are_written_again(spark, tmp_path):
    folder = str(tmp_path / "copy")
    rows = spark.range(400).select("id", F.concat(F.lit("00"), (F.col("id") % 4).cast("string")).alias("part"), (F.col("id") * 0.5).alias("amount"))
    # a repeated row, NULLs in different places, a part that is NULL, and a value folders must escape
    extra = "id bigint, part string, amount double"
    rows = rows.union(spark.createDataFrame([(1, "001", 0.5), (None, "002", 7.0), (7, "002", None), (5, None, 1.0), (6, "a/b c", 1.0)], extra))
    files.write_parts(rows, folder, "part")
    names = lambda: {p.parent.name: p.name for p in sorted((tmp_path / "copy").rglob("*.parquet"))}
    shown = lambda df: sorted(map(str, df.collect()))
    assert files.sync_parts(rows, folder, "part").collect() == [] and shown(files.read_parts(rows, folder)) == shown(rows)
    before = names()
    changed = rows.withColumn("amount", F.when(F.col("id") == 42, -1.0).otherwise(F.col("amount")))
    assert list(map(tuple, files.sync_parts(changed, folder, "part").collect())) == [("002", 102, 102)]
    after = names()
    assert {p for p in before if before[p] != after[p]} == {"part=002"}
    assert shown(files.read_parts(rows, folder)) == shown(changed)
    # one copy of a repeated row is gone, values have changed places, parts have vanished and come
    moved = changed.where("part is null or part not in ('001', 'a/b c')").union(
        spark.createDataFrame([(1, "001", 0.5), (1, "new", 0.5)], extra)
    ).withColumn("part", F.coalesce("part", F.lit("000")))
    found = {r.part: (r.source_rows, r.copy_rows) for r in files.sync_parts(moved, folder, "part").collect()}
    assert found == {"001": (1, 101), "a/b c": (0, 1), "new": (1, 0), "000": (101, 100), None: (0, 1)}
    assert shown(files.read_parts(rows, folder)) == shown(moved)


def test_content_digests_see_nulls_and_repeats(spark):
    kind = "k int, a string, b string"
    digest = lambda *rows: quality.content_digests(spark.createDataFrame(list(rows), kind)).first()
    assert digest((1, "x", None)) != digest((1, None, "x"))
    assert digest((1, "x", "y"), (1, "x", "y"), (2, "p", "q")) != digest((1, "x", "y"), (2, "p", "q"), (2, "p", "q"))
    assert digest((1, "x", "y"), (2, "p", "q")) == digest((2, "p", "q"), (1, "x", "y"))
    assert digest()["rows"] == 0


def test_bounded_result(spark):
    shown, size = files.bounded_result(spark.range(250), 100)
    assert shown.count() == 100
    assert tuple(size.collect()[0]) == (250, True)
    assert tuple(files.bounded_result(spark.range(3), 100)[1].collect()[0]) == (3, False)


def test_guard(spark):
    spark.range(5).withColumn("amount", F.col("id") * 1.0).createOrReplaceTempView("guard_a")
    spark.range(5).createOrReplaceTempView("guard_b")
    asked = spark.sql("SELECT id, amount FROM guard_a JOIN guard_b USING (id)")
    assert files.guard_plan(asked, ["id", "amount"], ["guard_a", "guard_b"], 2).count() == 2
    with pytest.raises(ValueError, match="tables not allowed"):
        files.guard_plan(asked, ["id", "amount"], ["guard_a"])
    with pytest.raises(ValueError, match="columns not allowed"):
        files.guard_plan(asked, ["id"], ["guard_a", "guard_b"])


def test_guard_refuses_data_without_a_name(spark, tmp_path):
    spark.range(5).createOrReplaceTempView("guard_b")
    path = f"{tmp_path}/bare"
    spark.range(3).write.parquet(path)
    for hidden in (
        spark.read.parquet(path), spark.read.parquet(path).alias("guard_b"),
        spark.sql(f"SELECT id FROM parquet.`{path}`"), spark.sql(f"WITH c AS (SELECT id FROM parquet.`{path}`) SELECT id FROM c"),
        spark.sql(f"SELECT id FROM guard_b WHERE id IN (SELECT id FROM parquet.`{path}`)"),
    ):
        with pytest.raises(ValueError, match="tables not allowed"):
            files.guard_plan(hidden, ["id"], ["guard_b"])
    named = spark.sql("WITH c AS (SELECT id FROM guard_b) SELECT id FROM c WHERE id < (SELECT MAX(id) FROM guard_b)")
    assert [x.id for x in files.guard_plan(named, ["id"], ["guard_b"], 2).collect()] == [0, 1]


def test_guard_knows_stored_tables(spark, tmp_path):
    spark.sql(f"CREATE TABLE guard_stored (k BIGINT) USING parquet LOCATION '{tmp_path}/t'")
    try:
        assert files.guard_plan(spark.table("guard_stored"), ["k"], ["guard_stored"]).count() == 0
        with pytest.raises(ValueError, match="guard_stored"):
            files.guard_plan(spark.table("guard_stored"), ["k"], ["guard_b"])
    finally:
        spark.sql("DROP TABLE guard_stored")


def test_guard_tells_databases_apart(spark, tmp_path):
    spark.sql(f"CREATE DATABASE secret LOCATION '{tmp_path}/secret'")
    try:
        spark.sql("CREATE TABLE secret.ok USING parquet AS SELECT 1 AS id")
        spark.range(3).createOrReplaceTempView("ok")
        assert files.guard_plan(spark.table("ok"), ["id"], ["ok"]).count() == 3
        with pytest.raises(ValueError, match="secret.ok"):
            files.guard_plan(spark.table("secret.ok"), ["id"], ["ok"])
        assert files.guard_plan(spark.table("secret.ok"), ["id"], ["secret.ok"]).count() == 1
        spark.sql(f"CREATE TABLE ok USING parquet LOCATION '{tmp_path}/ok' AS SELECT 7L AS id")
        with pytest.raises(ValueError, match="hides default.ok"):
            files.guard_plan(spark.table("ok"), ["id"], ["ok"])
    finally:
        spark.catalog.dropTempView("ok")
        spark.sql("DROP TABLE IF EXISTS ok")
        spark.sql("DROP DATABASE secret CASCADE")


def test_lineage_follows_columns_through_the_plan(spark):
    spark.createDataFrame([(1, "x", 2.0)], "id long, code string, pay double").createOrReplaceTempView("line_a")
    spark.createDataFrame([(1, "y")], "id long, note string").createOrReplaceTempView("line_b")
    shown = {
        "SELECT pay AS id FROM line_a": {"id": {"line_a.pay"}},
        "SELECT sum(pay) AS n, code FROM line_a GROUP BY code": {"n": {"line_a.pay"}, "code": {"line_a.code"}},
        "SELECT x.id, upper(note) AS n FROM line_a x JOIN line_b y ON x.id = y.id": {"id": {"line_a.id"}, "n": {"line_b.note"}},
        "SELECT id FROM line_a UNION ALL SELECT length(note) FROM line_b": {"id": {"line_a.id", "line_b.note"}},
        "WITH c AS (SELECT id, pay AS p FROM line_a) SELECT p + id AS q FROM c": {"q": {"line_a.pay", "line_a.id"}},
        "SELECT (SELECT max(pay) FROM line_a) AS top FROM line_b": {"top": {"line_a.pay"}},
        "SELECT rank() OVER (ORDER BY pay) AS r FROM line_a": {"r": {"line_a.pay"}},
        "SELECT e FROM line_a LATERAL VIEW explode(array(code, 'k')) t AS e": {"e": {"line_a.code"}},
    }
    for query, expected in shown.items():
        assert files.column_lineage(spark.sql(query)) == expected, query
    allowed = ["line_a.id", "line_a.code"]
    assert files.guard_plan(spark.sql("SELECT id FROM line_a"), ["id"], ["line_a"], sources=allowed).count() == 1
    for renamed in ("SELECT pay AS id FROM line_a", "SELECT CAST(sum(pay) AS BIGINT) AS id FROM line_a"):
        with pytest.raises(ValueError, match="line_a.pay"):
            files.guard_plan(spark.sql(renamed), ["id"], ["line_a"], sources=allowed)


def test_insert_by_position(spark, tmp_path):
    spark.sql(f"CREATE TABLE inserted_rows (k BIGINT, v STRING) USING parquet LOCATION '{tmp_path}/t'")
    try:
        files.insert_by_position(spark.createDataFrame([(1, "a")], "other bigint, names string"), "inserted_rows")
        assert [tuple(r) for r in spark.table("inserted_rows").collect()] == [(1, "a")]
    finally:
        spark.sql("DROP TABLE inserted_rows")


def test_run_log_round_trip(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    run = {
        "id": "S01", "tier": "S", "mode": "rrf", "retrieved_chunk_ids": ["t:a"], "refused": False, "sql_valid": True,
        "result_rows": [{"texts": ["x"], "numbers": [1.5, None]}], "tokens_in": 10, "tokens_out": 2, "cost_usd": 0.1,
        "latency_ms": {"retrieval": 1.0, "llm": 2.0},
    }
    (path / "a.jsonl").write_text(json.dumps(run) + "\n")
    log = files.read_run_log(spark, str(path))
    files.append_run_log(log, str(path))
    again = files.read_run_log(spark, str(path)).collect()
    assert len(again) == 2 and again[0]["result_rows"][0]["numbers"] == [1.5, None]


def test_normalized_types(spark):
    df = spark.sql("SELECT CAST(1 AS INT) i, CAST(1.5 AS DECIMAL(9,2)) d, DATE'2024-02-29' t, 'x' s")
    assert files.normalize_types(df).dtypes == [("i", "bigint"), ("d", "double"), ("t", "string"), ("s", "string")]
    assert tuple(files.normalize_types(df).first()) == (1, 1.5, "2024-02-29", "x")
