"""Every registered query of the engine's own operators, against its SQL."""

import os

import duckdb
import pytest

from tidelog.plans import delivery, queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries.QUERIES | delivery.QUERIES, queries.ORACLES | delivery.ORACLES


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_names_are_registered_once():
    assert not set(queries.QUERIES) & set(delivery.QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, tables, name):
    got, wanted = QUERIES[name](spark, SF), tables.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    rows = lambda found: sorted((tuple(map(str, r)) for r in found))
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows(got.select(*columns).collect()) == rows(tables.sql(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall())
