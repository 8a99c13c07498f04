"""Choices, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.ranges import running


def group_optimum(df: DataFrame, keys: list[str], option: str, score: str, tie: str) -> DataFrame:
    """Per group the option of the highest score, then of the lowest ``tie``, then by name; and all of the highest score."""
    r = df.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(score)))).filter("_r = 1")
    return r.groupBy(*keys).agg(F.min(F.struct(tie, option)).getField(option).alias("best"), F.array_join(F.array_sort(F.collect_set(option)), ",").alias("tied"), F.max(score).alias("score"))


def pareto(df: DataFrame, key: str, better_high: str, better_low: str) -> DataFrame:
    """Rows that no other row beats in both measures, or in one with the other equal.

    No self-join: going down the first measure, a row stays if its second is below all of the higher ones and
    no worse than those of its own level.
    """
    level = df.groupBy(better_high).agg(F.min(better_low).alias("_m"))
    level = running(level, better_high, {"_b": ("min", "_m")}, descending=True, own=False)
    front = level.filter("_b is null or _m < _b").select(better_high, F.col("_m").alias(better_low))
    return df.join(front, [better_high, better_low])


def topk_hit_regret(df: DataFrame, keys: list[str], option: str, truth: str, pred: str, k: int) -> DataFrame:
    """Is the truly best among the k best predicted, and how much truth is lost by the best of these."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(F.desc(pred), option))).withColumn("_t", F.max(truth).over(w))
    return d.filter(F.col("_r") <= k).groupBy(*keys).agg(F.max((F.col(truth) == F.col("_t")).cast("int")).alias("hit"), (F.max("_t") - F.max(truth)).alias("regret"))


def rank_by_correlation(df: DataFrame, columns: list[str], target: str, k: int) -> DataFrame:
    """The k columns of the highest absolute correlation with the target, by name among equals."""
    c = df.agg(*[F.struct(F.lit(x).alias("feature"), F.abs(F.corr(x, target)).alias("r")).alias(x) for x in columns]).select(F.inline(F.array(*columns)))
    return c.filter("r is not null").orderBy(F.desc("r"), "feature").limit(k)


def budget_flags(df: DataFrame, score: str, truth: Column, order: str) -> DataFrame:
    """Flags as many of the highest scores as there are positives: (flagged, hits, recall, precision)."""
    n = df.agg(F.count_if(truth).alias("n")).first()["n"]
    top = df.orderBy(F.desc(score), order).limit(n)
    return top.agg(F.count("*").alias("flagged"), F.count_if(truth).alias("hits")).withColumn("recall", F.col("hits") / F.nullif(F.lit(n), F.lit(0))).withColumn("precision", F.col("hits") / F.nullif(F.col("flagged"), F.lit(0)))


def first_by(df: DataFrame, order: list[Column], n: int = 1) -> DataFrame:
    return df.orderBy(*order).limit(n)


def nearest_condition(df: DataFrame, grid: DataFrame, key: str, intensity: str, frequency: str) -> DataFrame:
    """The grid condition nearest in both steps; then least load, then number. The grid is nine broadcast rows."""
    d = (F.col(intensity) - F.col("g_i")) ** 2 + (F.col(frequency) - F.col("g_f")) ** 2
    j = df.join(F.broadcast(grid.select("number", F.col("i").alias("g_i"), F.col("f").alias("g_f"))))
    return j.groupBy(key).agg(F.min(F.struct(F.round(d, 9).alias("d"), (F.col("g_i") + F.col("g_f")).alias("load"), "number")).getField("number").alias("number"))


def union_tables(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def power_set(spark, names: list[str]) -> DataFrame:
    """All non-empty combinations of names, joined by +."""
    bits = F.transform(F.array(*[F.lit(n) for n in names]), lambda x, i: F.when(F.col("id").bitwiseAND(F.pow(F.lit(2), i).cast("bigint")) != 0, x))
    return spark.range(1, 1 << len(names)).select(F.col("id").alias("mask"), F.array_join(F.array_compact(bits), "+").alias("combination"))
