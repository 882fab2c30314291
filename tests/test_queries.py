"""Every core query runs on the smallest tables, and equals its SQL where it has one."""

import glob
import os

import duckdb
import pytest

from quillspark.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    rows = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*names).collect())
    if name in catalog.SQL:
        want = db.execute(f"select {', '.join(names)} from ({catalog.SQL[name]})").fetchall()
        assert rows == sorted(repr(tuple(plain(v) for v in r)) for r in want)
