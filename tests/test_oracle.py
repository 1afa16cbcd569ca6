"""Every engine query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lakeweave.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(table, names):
    return sorted(repr([None if v != v else v for v in (r[n] for n in names)]) for r in table)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    theirs = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(names)
    expected = [dict(zip(names, r)) for r in theirs.fetchall()]
    assert rows([r.asDict() for r in ours.collect()], sorted(names)) == rows(expected, sorted(names))
