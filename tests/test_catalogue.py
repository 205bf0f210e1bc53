"""Every query with SQL equals DuckDB's rows on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if k.startswith("q")}
MAY_BE_EMPTY = {"q43b_same_queries"}


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    why = compare(spark, con, name, entry.queries()[name], SQL[name], SF)
    assert why is None or (why == "no rows" and name in MAY_BE_EMPTY), why


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_query_has_sql_or_is_iterative():
    assert {k for k in entry.queries() if k.startswith("q")} - set(SQL) == {"q42_round_loop"}


def test_round_loop(spark):
    rows = entry.queries()["q42_round_loop"](spark, SF).collect()
    assert rows and all(0 <= r.n_accepted <= r.n <= 5 for r in rows)
