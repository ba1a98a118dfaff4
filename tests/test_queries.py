"""Each query against the same in DuckDB, on the driver's small tables."""

import glob
import math
import os

import pytest

from lodestone.plans.catalog import ORACLE_SQL, QUERIES

DATA = os.environ.get("QUERY_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda x: round(x, 6) + 0.0 if isinstance(x, float) and not math.isnan(x) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, DATA)
    rows = plain(out.columns, out.collect())
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        assert sorted(out.columns) == sorted(want.columns)
        assert rows == plain(want.columns, want.fetchall())
