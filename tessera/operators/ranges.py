"""Running totals over a whole table without one task for all rows: ranges of a column, and what is carried over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def range_of(df: DataFrame, column: str) -> Column:
    """The number of the range, from 0 upwards, that a number of ``column`` lies in.

    The bounds are approximate quantiles, as many as shuffle partitions; equal values are in one range. They are literals
    of the plan, so a task that runs again deals alike.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    value = F.col(column).cast("double")
    bounds = sorted(set(df.agg(F.percentile_approx(value, shares)).head()[0] or []))
    cuts = F.array(*[F.lit(float(b)) for b in bounds]) if bounds else F.array().cast("array<double>")
    return F.size(F.filter(cuts, lambda b: b <= value))


def running(df: DataFrame, column: str, totals: dict[str, tuple[str, str]], descending: bool = False, own: bool = True) -> DataFrame:
    """``df`` with running aggregates in the order of ``column``, a number that no two rows share.

    ``totals``: new name -> ("sum", "min" or "max", column). Each range runs its own rows and takes over the aggregate of the
    ranges before it, a row for each range. Without ``own`` a row's own value is left out; NULL where nothing is before.
    """
    f = {"sum": F.sum, "min": F.min, "max": F.max}
    join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}
    order = F.desc(column) if descending else F.asc(column)
    d = df.withColumn("_part", range_of(df, column))
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    ends = d.groupBy("_part").agg(*[f[kind](c).alias(f"_e_{n}") for n, (kind, c) in totals.items()])
    before = Window.partitionBy(F.lit(1)).orderBy(F.desc("_part") if descending else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_part", *[f[kind](f"_e_{n}").over(before).alias(f"_e_{n}") for n, (kind, _) in totals.items()])
    out = d.withColumns({f"_o_{n}": f[kind](c).over(w) for n, (kind, c) in totals.items()}).join(F.broadcast(carried), "_part")
    return out.select(*df.columns, *[join[kind](F.col(f"_o_{n}"), F.col(f"_e_{n}")).alias(n) for n, (kind, _) in totals.items()])


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, n, names): exact quantiles of each group's non-null values, linear between neighbours, by new name -> share.

    By counting: equal values of a group are one row with their number, each range of values counts its own, and only the ranges that a
    wanted rank falls into are looked at again, value by value. No task has a group's values, however large one group is: they are
    dealt by value, and a range holds of each group what a share of all values holds.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_part", range_of(counts, "_v"))
    per = counts.groupBy(*keys, "_part").agg(F.sum("_c").alias("_m"))
    order = Window.partitionBy(*keys).orderBy("_part")
    per = per.withColumns({"_before": F.sum("_m").over(order) - F.col("_m"), "n": F.sum("_m").over(Window.partitionBy(*keys))})
    low = {q: F.floor((F.col("n") - 1) * share) for q, share in shares.items()}
    high = {q: F.ceil((F.col("n") - 1) * share) for q, share in shares.items()}
    within = lambda rank, first, count: (rank >= first) & (rank < first + count)
    asked = F.lit(False)
    for q in shares:
        asked = asked | within(low[q], F.col("_before"), F.col("_m")) | within(high[q], F.col("_before"), F.col("_m"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_part"]]
    rows = counts.alias("a").join(per.filter(asked).alias("b"), same).select(*[F.col(f"a.{k}").alias(k) for k in [*keys, "_part"]], "_v", "_c", "_before", "n")
    running_ = F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    rows = rows.withColumn("_first", F.col("_before") + running_ - F.col("_c"))
    at = lambda rank: F.max(F.when(within(rank, F.col("_first"), F.col("_c")), F.col("_v")))
    picked = rows.groupBy(*keys, "n").agg(*[at(low[q]).alias(f"_l_{q}") for q in shares], *[at(high[q]).alias(f"_h_{q}") for q in shares])
    part = lambda q, share: (F.col("n") - 1) * share - F.floor((F.col("n") - 1) * share)
    return picked.select(*keys, "n", *[(F.col(f"_l_{q}") + (F.col(f"_h_{q}") - F.col(f"_l_{q}")) * part(q, share)).alias(q) for q, share in shares.items()])


def numbered(df: DataFrame, key: str, name: str = "i") -> DataFrame:
    """``df`` with its rows' places, from 0, in the order of a unique ``key``; text keys, of small tables, in one task."""
    if dict(df.dtypes)[key] == "string":
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(key)) - 1).cast("bigint"))
    return running(df.withColumn("_one", F.lit(1).cast("bigint")), key, {name: ("sum", "_one")}).withColumn(name, F.col(name) - 1).drop("_one")
