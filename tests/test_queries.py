"""Every query against its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from sampledeck import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = ["events", "embeddings", "orders", "supplier"]


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 5) + 0.0 if isinstance(value, float) else value


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, FOLDER)
    got = rows(found.columns, found.collect())
    if name in queries.ORACLES:
        result = duck.execute(queries.ORACLES[name])
        expected = rows([c[0] for c in result.description], result.fetchall())
        assert sorted(found.columns) == sorted(c[0] for c in result.description)
        assert got == expected
        assert got  # an empty table proves nothing
    else:
        assert got or name == "birdie_channels"
