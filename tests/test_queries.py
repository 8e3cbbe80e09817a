"""Every registered query with SQL gives the rows of its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from siftlake import plans

DATA = "/root/testdata/sf0.001"


def _rows(frame):
    def plain(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, float):
            return round(v, 5) + 0.0
        return list(v) if hasattr(v, "tolist") else str(v) if not isinstance(v, (bool, int, str)) else v

    names = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in row) for row in frame[names].astype(object).itertuples(index=False)), key=repr), names


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, names = _rows(plans.QUERIES[name](spark, DATA).toPandas())
    want, columns = _rows(duck.execute(plans.ORACLE_SQL[name]).df())
    assert names == columns
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 2e-5 or str(x) == str(y) for x, y in zip(a, b)), (a, b)
