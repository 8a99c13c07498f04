"""Operators over ordered rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _w(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def history(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The previous value, and the mean of all earlier ones; the table's mean where there is none."""
    w = _w(keys, order)
    mean = df.agg(F.avg(value).alias("_g"))
    out = df.join(F.broadcast(mean))
    prev = F.coalesce(F.lag(value).over(w), F.col("_g"))
    return out.withColumn("previous", prev).withColumn("mean_before", F.coalesce(F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_g"))).drop("_g")


def leave_one_out(keys: list[str], value: str) -> Column:
    w = Window.partitionBy(*keys)
    n = F.count(value).over(w)
    return F.when(n > 1, (F.sum(value).over(w) - F.col(value)) / (n - 1))


def carryover(keys: list[str], order: str, value: str) -> Column:
    return F.lag(value).over(_w(keys, order))


def center(keys: list[str], value: str) -> Column:
    return F.col(value) - F.avg(value).over(Window.partitionBy(*keys))


def zscore(keys: list[str], value: str, clip: float | None = None) -> Column:
    w = Window.partitionBy(*keys)
    z = (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_pop(value).over(w), F.lit(0.0))
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), z)) if clip else z


def interpolate(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Missing values from the straight line between their neighbours; the edges hold the nearest."""
    w = _w(keys, ts)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(ts).cast("double").alias("t"), F.col(value).alias("v")))
    p, n = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = df.withColumns({"_p": p, "_n": n})
    at = (F.col(ts).cast("double") - F.col("_p.t")) / (F.col("_n.t") - F.col("_p.t"))
    line = F.when(F.col("_n.t") > F.col("_p.t"), F.col("_p.v") + at * (F.col("_n.v") - F.col("_p.v")))
    return d.withColumn(value, F.coalesce(value, line, "_p.v", "_n.v")).drop("_p", "_n")


def rereference(df: DataFrame, channels: list[str], references: list[str]) -> DataFrame:
    """Channels less the mean of the reference channels."""
    if not references:
        return df
    mean = sum((F.col(c) for c in references), F.lit(0.0)) / len(references)
    return df.withColumns({c: F.col(c) - mean for c in channels})


def gap_flag(keys: list[str], start: str, end: str, most: float) -> Column:
    return F.coalesce(F.col(start) - F.lag(end).over(_w(keys, start)) > most, F.lit(False))


def epochs(df: DataFrame, keys: list[str], order: str, flag: str, name: str = "epoch") -> DataFrame:
    """Numbers the stretches that begin where ``flag`` is true."""
    return df.withColumn(name, F.sum(F.col(flag).cast("int")).over(_w(keys, order).rowsBetween(Window.unboundedPreceding, 0)))


def trailing_median(keys: list[str], order: str, value: str, n: int = 3) -> Column:
    """Median of the last n values, the own one included."""
    last = F.array_sort(F.filter(F.collect_list(value).over(_w(keys, order).rowsBetween(1 - n, 0)), lambda x: x.isNotNull()))
    k = F.size(last)
    return F.when(k > 0, (F.get(last, F.floor((k - 1) / 2).cast("int")) + F.get(last, F.floor(k / 2).cast("int"))) / 2)


def smoothed(df: DataFrame, keys: list[str], order: str, value: str, gap: str, n: int = 3) -> DataFrame:
    """``df`` with ``smooth``, the trailing median; it starts anew where ``gap`` is true."""
    return epochs(df, keys, order, gap, "_e").withColumn("smooth", trailing_median([*keys, "_e"], order, value, n)).drop("_e")


def rising(keys: list[str], order: str, value: str, least: float) -> Column:
    w = _w(keys, order)
    a, b, c = F.lag(value, 2).over(w), F.lag(value, 1).over(w), F.col(value)
    return F.coalesce((a < b) & (b < c) & (c - a > least), F.lit(False))


def transition_reveal(df: DataFrame, ratings: DataFrame, key: str, order: str, condition: str, rating: str) -> DataFrame:
    """At a change of condition, the finished condition's rating; never the current one's."""
    before = F.lag(condition).over(_w([key], order))
    d = df.withColumn("_f", F.when(before != F.col(condition), before))
    return d.join(ratings.select(key, F.col(condition).alias("_f"), F.col(rating).alias("revealed")), [key, "_f"], "left").withColumnRenamed("_f", "finished")


def dwell_runs(df: DataFrame, keys: list[str], order: str, value: str, gap: Column | None = None) -> DataFrame:
    """Runs of an equal value, cut at gaps: (keys, run, value, length)."""
    change = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(_w(keys, order))), F.lit(True))
    change = change | F.coalesce(gap, F.lit(False)) if gap is not None else change
    d = epochs(df.withColumn("_c", change), keys, order, "_c", "run")
    return d.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))


def next_match(keys: list[str], order: str, recommended: str, actual: str) -> Column:
    return F.lead(actual).over(_w(keys, order)) == F.col(recommended)


def ewma(df: DataFrame, keys: list[str], order: str, residual: str, alpha: float) -> DataFrame:
    """Exponentially weighted mean of a group's residuals in order; a group is one participant's conditions."""
    g = df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, residual))), lambda s: s[residual]).alias("_r"))
    return g.select(*keys, F.aggregate("_r", F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise((1 - alpha) * s + alpha * x)).alias("correction"))


def downsample(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """At most n rows of a group, evenly spread over its places."""
    d = df.withColumn("_i", F.row_number().over(_w(keys, order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    slot = F.floor(F.col("_i") * n / F.col("_n"))
    before = F.floor((F.col("_i") - 1) * n / F.col("_n"))
    return d.filter((F.col("_n") <= n) | (F.col("_i") == 0) | (slot != before)).drop("_i", "_n")
