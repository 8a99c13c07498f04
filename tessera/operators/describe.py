"""Descriptive statistics of labels, orders and factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def target_distribution(df: DataFrame, columns: list[str], floor: float, ceiling: float) -> DataFrame:
    """One row per column: mean, std (sample), quartiles, rows at the floor and the ceiling."""
    aggs = []
    for c in columns:
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        aggs.append(F.struct(F.lit(c).alias("target"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), *[F.get(q, F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], F.count_if(F.col(c) <= floor).alias("n_floor"), F.count_if(F.col(c) >= ceiling).alias("n_ceiling")).alias(f"s_{c}"))
    return df.agg(*aggs).select(F.inline(F.array(*[f"s_{c}" for c in columns])))


def order_balance(df: DataFrame, axes: list[str], position: str) -> DataFrame:
    """(axis, level, position, n) for every axis, from one pass with grouping sets."""
    stacked = df.select(F.col(position).alias("position"), F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("level")) for a in axes])))
    return stacked.groupBy("axis", "level", "position").agg(F.count("*").alias("n"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square of a x b over the full grid of seen levels, with the degrees of freedom; grids are small."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows, cols = n.groupBy(a).agg(F.sum("n").alias("r")), n.groupBy(b).agg(F.sum("n").alias("c"))
    grid = rows.crossJoin(cols).join(n, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    e = grid.withColumn("e", F.col("r") * F.col("c") / total)
    return e.agg(F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")).alias("chi2"), ((F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)).alias("df"))


def status_split(df: DataFrame, status: str, key: str, value: str) -> DataFrame:
    """Per status: distinct keys, their sorted list, mean and std. The list is for small key sets."""
    return df.groupBy(status).agg(F.count_distinct(key).alias("n_keys"), F.array_join(F.transform(F.sort_array(F.collect_set(key)), lambda x: x.cast("string")), ",").alias("keys"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def grid_descriptives(df: DataFrame, grid: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Statistics of every cell of a grid; empty cells stay with n = 0."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.percentile(value, 0.5).alias("median"))
    return grid.join(g, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def reason_counts(df: DataFrame, reasons: str) -> DataFrame:
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def variance_share(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Per column: total sum of squares, and the share between and within groups."""
    long = df.select(F.col(group).alias("_g"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]))).filter("x is not null")
    g = long.groupBy("column", "_g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("w"))
    grand = g.groupBy("column").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    s = g.join(F.broadcast(grand), "column").groupBy("column").agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("between"), F.sum("w").alias("within"))
    total = F.col("between") + F.col("within")
    return s.select("column", total.alias("total"), (F.col("between") / total).alias("between_share"), (F.col("within") / total).alias("within_share"))


def between_spread(df: DataFrame, key: str, statistic: Column) -> DataFrame:
    """Sample SD across keys of a statistic of each."""
    return df.groupBy(key).agg(statistic.alias("s")).agg(F.stddev_samp("s").alias("spread"), F.count("s").alias("n"))


def cronbach_alpha(df: DataFrame, items: list[str]) -> DataFrame:
    k = len(items)
    full = df.dropna(subset=items)
    a = full.agg(*[F.var_samp(c).alias(c) for c in items], F.var_samp(sum((F.col(c) for c in items), F.lit(0.0))).alias("_t"))
    return a.select((k / (k - 1) * (1 - sum((F.col(c) for c in items), F.lit(0.0)) / F.col("_t"))).alias("alpha"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of every pair of columns, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")).alias(f"{a}_{b}") for a, b in pairs]).select(F.inline(F.array(*[f"{a}_{b}" for a, b in pairs])))


def composite_score(df: DataFrame, items: dict[str, int]) -> DataFrame:
    """Mean of items turned to one direction (1 or -1) and z-scored over the table; one aggregation, joined back as a single row."""
    s = df.agg(*[x for c in items for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    z = sum((sign * (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c, sign in items.items()), F.lit(0.0))
    return df.join(F.broadcast(s)).withColumn("composite", z / len(items)).select(*df.columns, "composite")


def class_weights(df: DataFrame, label: str, classes: list[int]) -> DataFrame:
    """n / (classes x count); a class without rows counts as one."""
    grid = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias(label))
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    g = grid.join(n, label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return g.select(label, (total / (len(classes) * F.greatest("n", F.lit(1)))).alias("weight"))


def presence_effect(df: DataFrame, combination: str, metric: str, names: list[str]) -> DataFrame:
    """Mean metric of the combinations with and without each modality."""
    stacked = df.select(metric, combination, F.explode(F.array(*[F.lit(n) for n in names])).alias("modality"))
    has = F.array_contains(F.split(combination, r"\+"), F.col("modality"))
    g = stacked.groupBy("modality").agg(F.avg(F.when(has, F.col(metric))).alias("with_it"), F.avg(F.when(~has, F.col(metric))).alias("without_it"))
    return g.withColumn("effect", F.col("with_it") - F.col("without_it"))


def addition_effect(df: DataFrame, combination: str, metric: str) -> DataFrame:
    """Change of the metric where one modality joins a combination: mean, least and greatest over the base sets."""
    parts = F.array_sort(F.split(combination, r"\+"))
    a = df.select(F.array_join(parts, "+").alias("base"), F.col(metric).alias("m"))
    b = df.select(parts.alias("p"), F.col(metric).alias("m2")).select("p", "m2", F.explode("p").alias("modality"))
    b = b.withColumn("base", F.array_join(F.array_remove("p", F.col("modality")), "+"))
    d = b.join(a, "base").withColumn("d", F.col("m2") - F.col("m"))
    return d.groupBy("modality").agg(F.avg("d").alias("mean"), F.min("d").alias("least"), F.max("d").alias("greatest"), F.count("*").alias("n"))


def selection_stability(audit: DataFrame, feature: str, rank: str, fold: str) -> DataFrame:
    return audit.groupBy(feature).agg(F.count_distinct(fold).alias("folds"), F.avg(rank).alias("mean_rank"), F.min(rank).alias("best_rank"))


def floor_strata(df: DataFrame, keys: list[str], truth: str, pred: str) -> DataFrame:
    """Mean absolute error for zero and other truths, after averaging the predictions of a key."""
    g = df.groupBy(*keys).agg(F.avg(truth).alias("t"), F.avg(pred).alias("p"))
    return g.groupBy(F.when(F.col("t") == 0, "zero").otherwise("other").alias("stratum")).agg(F.avg(F.abs(F.col("p") - F.col("t"))).alias("mae"), F.count("*").alias("n"))
