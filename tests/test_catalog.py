import json

import pytest
from pyspark.sql import types as T

from ledgerloom.catalog import Catalog, Column, Table, spark_type, unique_ids
from ledgerloom.metrics.registry import ALL_METRICS, metric, metric_ids
from ledgerloom.retrieval.documents import search_documents
from ledgerloom.sources.files import load_order
from ledgerloom.sources.schemas import CATALOG


def test_types():
    assert spark_type("BIGINT") == T.LongType()
    assert spark_type("DECIMAL") == T.DecimalType(18, 2)
    assert spark_type("decimal(14,2)") == T.DecimalType(14, 2)
    assert spark_type("GEOMETRY") == T.StringType()


def test_primary_key_is_not_nullable():
    struct = CATALOG.struct("distributor", "dim_item")
    assert not struct["item_key"].nullable
    assert struct["category"].nullable


def test_same_name_in_two_tenants():
    assert CATALOG.table("furniture", "dim_customer").primary_key == "customer_id"
    assert CATALOG.table("distributor", "dim_customer").primary_key == "customer_key"
    with pytest.raises(ValueError, match="unknown tenant"):
        CATALOG.of_tenant("nobody")


def test_paths():
    hop = lambda f, d: [h.right for h in CATALOG.path("distributor", f, d)]
    assert hop("o2c_sales_order_line", "dim_customer") == ["dim_customer"]
    assert hop("inv_balance_snapshot", "dim_supplier") == ["item_supplier", "dim_supplier"]
    assert hop("o2c_return_line", "dim_customer") == ["o2c_sales_order_line", "dim_customer"]
    assert hop("p2p_purchase_order_line", "dim_supplier") == ["dim_supplier"]
    with pytest.raises(ValueError, match="no join path"):
        CATALOG.path("distributor", "gl_journal_line", "dim_customer")


def test_load_order_puts_targets_first():
    order = load_order(CATALOG, "distributor")
    for hop in CATALOG.foreign_keys("distributor"):
        assert order.index(hop.right) < order.index(hop.left)


def test_duplicate_table_and_id():
    table = Table("t", "a", (Column("k"),))
    with pytest.raises(ValueError, match="duplicate table"):
        Catalog.of([table, table])
    with pytest.raises(ValueError, match="duplicate catalogue id"):
        unique_ids(["t:a"], ["t:a"])


def test_from_json(tmp_path):
    path = tmp_path / "catalog.json"
    columns = [
        {"name": "k", "type": "BIGINT", "primary_key": True},
        {"name": "s", "type": "VARCHAR", "values": ["a", "b"]},
    ]
    path.write_text(json.dumps({"tables": [{"tenant": "t", "name": "x", "type": "dimension", "columns": columns}]}))
    table = Catalog.from_json(str(path)).table("t", "x")
    assert (table.kind, table.primary_key, table.columns[1].values) == ("dimension", "k", ("a", "b"))


def test_metric_ids_are_unique():
    assert len(metric_ids()) == 41
    assert sum(t == "furniture" for t, _ in ALL_METRICS) == 15
    with pytest.raises(ValueError, match="unknown metric"):
        metric("nothing")


def test_search_documents(spark):
    docs = {r["id"]: r for r in search_documents(spark, CATALOG, ALL_METRICS.values()).collect()}
    assert len(docs) == len(CATALOG.tables) + 41
    table = docs["distributor:o2c_return_line"]["text"]
    assert "so_line_key (BIGINT) [FK → o2c_sales_order_line.so_line_key]" in table
    assert table.endswith("item_key → dim_item.item_key")
    text = docs["distributor:otif_pct"]["text"]
    assert text.index("Known as:") < text.index("Common questions users ask:") < text.index("In other words:")
    assert text.endswith("Reads: o2c_fulfillment_line, o2c_sales_order_line")
    assert "replace {placeholders}" in docs["furniture:customer_churn_count"]["text"]
