"""Every registered query of the engine against its SQL twin on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from vacantia import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in frame.select(*columns).collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    relation = duck.sql(sql)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in relation.fetchall())
