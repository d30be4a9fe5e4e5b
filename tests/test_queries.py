"""Every registered query with SQL gives DuckDB's rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for f in os.listdir(SF_DIR):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF_DIR}/{f}'")
    return c


def plain(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op")])
def test_oracle(spark, views, name):
    got = entry.queries()[name](spark, SF_DIR)
    columns = sorted(got.columns)
    wanted = views.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({entry.oracle_sql()[name]})")
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(wanted.fetchall())


def test_entry(spark):
    if os.path.isdir(SF_DIR):
        assert entry.entry(spark).count() == 5


def test_case_table_has_all_columns_of_its_sql(spark, views):
    wanted = views.execute(entry.oracle_sql()["case_table"])
    columns = [d[0] for d in wanted.description]
    got = entry.queries()["case_table"](spark, SF_DIR)
    assert sorted(got.columns) == sorted(columns)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(wanted.fetchall())
