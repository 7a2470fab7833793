"""Every query of the workload against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tarn import workload

FOLDER = "/root/testdata/sf0.001"


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


def show(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_equals_sql(spark, oracle, name):
    df = workload.QUERIES[name](spark, FOLDER)
    want = oracle.execute(workload.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert normal(df.collect(), df.columns) == normal(want.fetchall(), names)
