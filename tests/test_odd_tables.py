"""Queries against their SQL over small tables that hold what the given ones don't."""

import duckdb
import pytest
from test_oracles import rows

from tessera.plans import ORACLES, QUERIES

NAN, INF = float("nan"), float("inf")


def same(spark, folder, name, table, schema, made):
    df = spark.createDataFrame(made, schema)
    df.write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    order = sorted(got.columns)
    want = con.sql(ORACLES[name])
    want = want.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall()
    assert rows(got.select(*order).collect(), order) == rows(want, order) and len(want) > 0
    return {tuple(r) for r in want}


def test_gate_of_groups_without_a_correlation(spark, tmp_path):
    """One row, a constant side, nothing known, and what is not a number."""
    odd = [(1, 0.03, 0.02), *((2, 0.03, x) for x in (0.02, 0.05, 0.01)), (3, None, 0.02), (4, NAN, 0.02), (4, 0.01, 0.02), *((5, x, x - 0.01) for x in (0.01, 0.02, 0.09)), (6, 0.01, 0.02), (6, None, 0.03), (7, 0.06, 0.03), (8, 0.03, INF), (8, 0.02, 0.01), (9, 0.3, None), *((10, x, 0.1) for x in (0.1, 0.2, 0.3))]
    made = [(g, 1, i, d, x, 1.0) for i, (g, d, x) in enumerate(odd)]
    want = same(spark, tmp_path, "deployment_gate", "lineitem", "l_suppkey long, l_linenumber int, l_orderkey long, l_discount double, l_tax double, l_quantity double", made)
    assert {r[0] for r in want} == {True, False, None}


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_phase_deltas_from_and_to_zero(spark, tmp_path, ansi):
    pairs = [(0.0, 5.0), (5.0, 0.0), (0.0, 0.0), (2.0, 3.0), (0.0, -5.0), (-5.0, 2.0), (-2.0, -4.0), (1e-13, 2.0), (1.0, 1e-13), (4.0, 4.0), (None, 1.0), (NAN, 1.0)]
    made = [(8 * i + 4 * j + i % 4, i // 4, kind, v) for i, p in enumerate(pairs) for j, (kind, v) in enumerate(zip(("view", "click"), p, strict=True))]
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        want = same(spark, tmp_path, "phase_delta", "events", "event_id long, user_id long, event_type string, value double", made)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert {INF, -INF} <= {v for r in want for v in r if isinstance(v, float)}
