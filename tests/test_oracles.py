"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import glob
import math
import os

import duckdb
import pytest

from quire.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(frame):
    cell = lambda v: "" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else str(v)
    cols = sorted(frame.columns)
    return cols, sorted(tuple(cell(v) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())
