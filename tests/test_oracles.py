"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

from tessera.plans import ORACLES, QUERIES


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x + 0.0:.9g}" if x else "0"
    if isinstance(x, int) and not isinstance(x, bool):
        return f"{float(x):.9g}" if x else "0"
    if hasattr(x, "as_tuple"):
        return cell(float(x))
    return x if x is None else str(x)


def rows(table, names):
    return sorted((tuple(cell(v) for v in r) for r in table), key=str), sorted(names)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    order = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == order
    want = want.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall()
    assert rows(got.select(*order).collect(), order) == rows(want, order)
