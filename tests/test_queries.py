import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cellwise.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-6)
    return a == b


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, tables, name):
    df = QUERIES[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = tables.execute(f"select {columns} from ({ORACLES[name]})").fetchall()
    key = lambda r: tuple((x is None, float("inf") if x is None else round(x, 3) if isinstance(x, float) else x) for x in r)
    rows, want = sorted(rows, key=key), sorted(want, key=key)
    assert len(rows) == len(want)
    assert all(close(a, b) for r, w in zip(rows, want) for a, b in zip(r, w))


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
