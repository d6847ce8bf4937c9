"""Every registered query of the library runs on the smallest tables, and agrees with its SQL where it has one."""

import os

import duckdb
import pytest

from veilspan.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if type(value).__name__ == "Decimal":
        return int(value) if value == int(value) else float(value)
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    found = sorted((tuple(plain(row[c]) for c in columns) for row in frame.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return
    cursor = duck.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert found == sorted((tuple(plain(row[i]) for i in places) for row in cursor.fetchall()), key=repr)
