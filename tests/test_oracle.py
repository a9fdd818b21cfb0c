"""Every query against its SQL on the same tables."""

import pytest
from comparing import duck, rows_by_name

import __spark_entry__ as entry_point

QUERIES = entry_point.queries()
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_every_query_of_the_warehouses_has_sql():
    from ledgerloom.workload import registry
    from oracle import registry as sql

    assert set(registry.queries()) == set(sql.sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(name, spark, sf_dir, con):
    result = QUERIES[name](spark, sf_dir)
    ours = rows_by_name(result.columns, [tuple(r) for r in result.collect()])
    if name not in SQL:
        return
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    theirs = rows_by_name(columns, found.fetchall())
    assert sorted(result.columns) == sorted(columns)
    assert len(ours) == len(theirs)
    for mine, other in zip(ours, theirs):
        assert mine == other
