"""Every query that has an SQL twin, against DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from docspark import catalog_queries
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted([tuple(plain(r[k]) for k in order) for r in rows])


@pytest.mark.parametrize("name", sorted(catalog_queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    out = catalog_queries.queries()[name](spark, DATA)
    sql = duck.execute(catalog_queries.oracle_sql()[name])
    columns = [c[0] for c in sql.description]
    assert sorted(out.columns) == sorted(columns)
    assert comparable(out.collect(), out.columns) == comparable(sql.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_index_explain(spark):
    rows = catalog_queries.queries()["index_explain"](spark, DATA).collect()
    assert sum(r.chosen for r in rows) == 1 and rows[0].path == "by_cust"
