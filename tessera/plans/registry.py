"""Registered queries: each applies operators to the given tables, most with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes, read lazily; times without a zone are UTC."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of ``Tables`` as query ``name``."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def draw_sql(*parts: str) -> str:
    """The draw of ``tessera.operators.resample`` as a DuckDB expression."""
    e = "12345::BIGINT"
    for p in parts:
        e = f"((({e}) + ({p})::BIGINT) * 1103515245 + 12345) % 2147483648"
        e = f"list_transform([{e}], lambda z: (z * 69069 + z // 65536) % 2147483648)[1]"
    return f"(({e}) / 2147483648.0)"
