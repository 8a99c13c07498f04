"""Folds, bootstraps, sign flips, permutations, adjusted p-values. Draws are hashes of (seed, replicate, key), so results
do not depend on partitioning or on a task that runs again."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.ranges import numbered


def modular_folds(members: DataFrame, key: str, folds: int) -> DataFrame:
    """(key, fold, role) for integer keys: key mod folds is the test fold, the next one validation, the rest train."""
    f = members.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    at = F.pmod(F.col(key), F.lit(folds))
    role = F.when(at == F.col("fold"), "test").when(at == F.pmod(F.col("fold") + 1, F.lit(folds)), "validation").otherwise("train")
    return members.select(key).join(F.broadcast(f)).withColumn("role", role)


def draw(*parts: Column) -> Column:
    """A uniform number in [0, 1) from whole numbers, by modular arithmetic alone, so that SQL can draw the same."""
    x = F.lit(12345).cast("bigint")
    for p in parts:
        x = F.pmod((x + p.cast("bigint")) * 1103515245 + 12345, F.lit(2147483648))
        x = F.pmod(x * 69069 + F.floor(x / 65536), F.lit(2147483648))
    return x / 2147483648.0


def replicates(df: DataFrame, n: int) -> DataFrame:
    """Every row once per replicate b; for small summaries (participants), not for samples."""
    return df.join(F.broadcast(df.sparkSession.range(n).withColumnRenamed("id", "b")))


DRAWS = 1_000_000
"""Draws of a resampling that one task holds."""


def _picks(spark: SparkSession, size: int, n: int, seed: int) -> DataFrame:
    """(b, i): the numbers drawn, ``size`` in each of n resamples, a number's in one task of about DRAWS draws."""
    tasks = max(1, -(-size * n // DRAWS))
    d = spark.range(0, size, 1, tasks).join(F.broadcast(spark.range(n).withColumnRenamed("id", "b")))
    return d.select("b", F.floor(draw(F.lit(seed), F.col("b"), F.col("id")) * size).alias("i")).repartition(tasks, "i")


def bootstrap_clusters(clusters: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """(b, key, times): how often each cluster is drawn in each of n resamples of as many clusters.

    ``clusters`` has one row per cluster. The i-th draw of a replicate picks a cluster by number. More clusters make more tasks,
    not larger ones.
    """
    members = clusters.select(key)
    times = _picks(clusters.sparkSession, members.count(), n, seed).groupBy("b", "i").agg(F.count("*").alias("times"))
    return times.join(numbered(members, key), "i").select("b", key, "times")


def bootstrap_mean(clusters: DataFrame, key: str, total: str, count: str, n: int, seed: int) -> DataFrame:
    """(b, estimate): mean of each resample from the clusters' sums and counts, which the draws meet by number."""
    c = clusters.select(key, F.col(total).alias("_total"), F.col(count).alias("_count"))
    t = _picks(clusters.sparkSession, c.select(key).count(), n, seed).join(numbered(c, key), "i")
    return t.groupBy("b").agg((F.sum("_total") / F.sum("_count")).alias("estimate"))


def interval(estimates: DataFrame, level: float = 0.95) -> DataFrame:
    lo, hi = (1 - level) / 2, (1 + level) / 2
    return estimates.agg(F.percentile("estimate", lo).alias("low"), F.percentile("estimate", hi).alias("high"), F.count("*").alias("replicates"))


def sign_p_value(estimates: DataFrame) -> DataFrame:
    """Twice the smaller share of replicates on one side of zero, at most 1."""
    below, above = F.avg((F.col("estimate") <= 0).cast("int")), F.avg((F.col("estimate") >= 0).cast("int"))
    return estimates.agg(F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p_value"))


def exact_sign_flip(deltas: DataFrame, order: str, delta: str, most: int = 20) -> DataFrame:
    """Two-sided p of the mean over all 2^n signs; raises beyond ``most`` rows."""
    n = deltas.limit(most + 1).count()
    if n > most:
        raise ValueError(f"over {most} deltas: use monte_carlo_sign_flip")
    d = deltas.select(delta, (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order)) - 1).alias("i"))
    observed = d.agg(F.abs(F.sum(delta)).alias("observed"))
    sign = F.when(F.col("m").bitwiseAND(F.pow(F.lit(2), F.col("i")).cast("bigint")) != 0, -1).otherwise(1)
    s = d.sparkSession.range(1 << n).withColumnRenamed("id", "m").join(F.broadcast(d)).groupBy("m").agg(F.abs(F.sum(sign * F.col(delta))).alias("s"))
    return s.join(F.broadcast(observed)).agg(F.avg((F.col("s") >= F.col("observed") - 1e-9).cast("int")).alias("p_value"), F.count("*").alias("patterns"))


def monte_carlo_sign_flip(deltas: DataFrame, key: str, delta: str, n: int, seed: int) -> DataFrame:
    """One- and two-sided p of the mean under random signs, with one added to both counts."""
    sign = F.when(draw(F.lit(seed), F.col("b"), F.col(key)) < 0.5, -1).otherwise(1)
    s = replicates(deltas.select(key, delta), n).groupBy("b").agg(F.avg(sign * F.col(delta)).alias("s"))
    o = deltas.agg(F.avg(delta).alias("o"))
    hit = lambda c: (F.count_if(c) + 1) / (n + 1)
    return s.join(F.broadcast(o)).agg(hit(F.col("s") >= F.col("o") - 1e-12).alias("p_greater"), hit(F.abs("s") >= F.abs("o") - 1e-12).alias("p_two_sided"))


def holm(df: DataFrame, family: list[str], p: str, order: str) -> DataFrame:
    """Holm's step-down adjusted p in each family."""
    w = Window.partitionBy(*family).orderBy(p, order)
    n = F.count("*").over(Window.partitionBy(*family))
    raw = F.least(F.lit(1.0), F.col(p) * (n - F.row_number().over(w) + 1))
    return df.withColumn("_h", raw).withColumn("p_holm", F.max("_h").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_h")


def benjamini_hochberg(df: DataFrame, family: list[str], p: str, order: str) -> DataFrame:
    """Benjamini and Hochberg's step-up adjusted p in each family; the least of what follows runs from the greatest p down, once."""
    w = Window.partitionBy(*family).orderBy(p, order)
    down = Window.partitionBy(*family).orderBy(F.desc(p), F.desc(order))
    n = F.count("*").over(Window.partitionBy(*family))
    raw = F.least(F.lit(1.0), F.col(p) * n / F.row_number().over(w))
    return df.withColumn("_q", raw).withColumn("q_value", F.min("_q").over(down.rowsBetween(Window.unboundedPreceding, 0))).drop("_q")


def rank_biserial(deltas: DataFrame, keys: list[str], delta: str) -> DataFrame:
    """Signed-rank sums of the non-zero deltas and their effect size (w+ - w-) / (w+ + w-)."""
    from tessera.operators.metrics import average_rank

    d = deltas.filter(F.col(delta) != 0).withColumn("_a", F.abs(delta))
    d = d.withColumn("_r", average_rank(keys, "_a"))
    plus, minus = F.sum(F.when(F.col(delta) > 0, F.col("_r")).otherwise(0.0)), F.sum(F.when(F.col(delta) < 0, F.col("_r")).otherwise(0.0))
    return d.groupBy(*keys).agg(plus.alias("w_plus"), minus.alias("w_minus"), ((plus - minus) / (plus + minus)).alias("rank_biserial"))


def paired_contrasts(df: DataFrame, key: str, level: str, value: str, effect: str | None = None) -> DataFrame:
    """Mean difference, paired t, p and Holm's p of every two levels, over the keys that have both; the pairs of an
    ``effect`` (a column; else of the whole table) are one family. The keys' level means are few; the table of pairs fewer."""
    from tessera.functions.special import student_p

    by = [effect] if effect else []
    g = df.groupBy(*by, key, level).agg(F.avg(value).alias("v"))
    a, b = g.select(*by, key, F.col(level).alias("left"), F.col("v").alias("a")), g.select(*by, key, F.col(level).alias("right"), F.col("v").alias("b"))
    d = a.join(b, [*by, key]).filter("left < right").withColumn("d", F.col("a") - F.col("b"))
    t = F.avg("d") / F.nullif(F.stddev_samp("d") / F.sqrt(F.count("d").cast("double")), F.lit(0.0))
    out = d.groupBy(*by, "left", "right").agg(F.avg("d").alias("difference"), t.alias("t"), F.count("d").alias("n"))
    out = out.withColumn("p", student_p(F.col("t"), F.col("n") - 1)).withColumn("_pair", F.struct("left", "right"))
    return holm(out, by or [F.lit(1)], "p", "_pair").drop("_pair")


def _epsilon(effects: DataFrame, subject: str, level: list[str], value: str, p: Column) -> DataFrame:
    """One row ``epsilon``: Greenhouse and Geisser's, from the covariances over the subjects of an effect's values at each
    level, which sum to zero for each subject: (trace)^2 / (p times the sum of squares)."""
    e = effects.select(F.col(subject).alias("_s"), F.struct(*level).alias("_l"), F.col(value).alias("_v"))
    both = e.join(e.select("_s", F.col("_l").alias("_m"), F.col("_v").alias("_u")), "_s")
    c = both.groupBy("_l", "_m").agg(F.covar_samp("_v", "_u").alias("c"))
    trace = F.sum(F.when(F.col("_l") == F.col("_m"), F.col("c")))
    return c.agg((trace * trace / F.nullif(F.sum(F.col("c") ** 2), F.lit(0.0))).alias("_e")).select((F.col("_e") / p).alias("epsilon"))


def rm_anova(df: DataFrame, subject: str, a: str, b: str, value: str) -> DataFrame:
    """Two-way repeated measures of a, b and a x b: sums of squares, degrees of freedom, F, p, partial eta squared, the
    Greenhouse-Geisser epsilon and the p with it; for full designs of one value per cell. The cells' means are what
    everything after the first aggregation works on."""
    from tessera.functions.special import fisher_p

    cell = df.groupBy(subject, a, b).agg(F.avg(value).alias("y"))
    m = lambda *k: F.avg("y").over(Window.partitionBy(*[F.col(x) for x in k])) if k else F.avg("y").over(Window.partitionBy(F.lit(1)))
    c = cell.withColumns({"g": m(), "ma": m(a), "mb": m(b), "ms": m(subject), "mab": m(a, b), "mas": m(a, subject), "mbs": m(b, subject)})
    g, ma, mb, ms, mab, mas, mbs, y = (F.col(x) for x in ("g", "ma", "mb", "ms", "mab", "mas", "mbs", "y"))
    sq = lambda x: F.sum(x**2)
    s = c.agg(
        sq(ma - g).alias("a"), sq(mb - g).alias("b"), sq(mab - ma - mb + g).alias("ab"), sq(mas - ma - ms + g).alias("ea"), sq(mbs - mb - ms + g).alias("eb"), sq(y - mab - mas - mbs + ma + mb + ms - g).alias("eab"),
        (F.count_distinct(a) - 1).alias("na"), (F.count_distinct(b) - 1).alias("nb"), (F.count_distinct(subject) - 1).alias("n"),
    )
    row = lambda name, ss, e, d: F.struct(F.lit(name).alias("effect"), F.col(ss).alias("ss"), d.cast("double").alias("df1"), (d * F.col("n")).cast("double").alias("df2"), (F.col(ss) / d / F.nullif(F.col(e) / (d * F.col("n")), F.lit(0.0))).alias("f"), (F.col(ss) / F.nullif(F.col(ss) + F.col(e), F.lit(0.0))).alias("partial_eta2"))
    out = s.select(F.inline(F.array(row("a", "a", "ea", F.col("na")), row("b", "b", "eb", F.col("nb")), row("ab", "ab", "eab", F.col("na") * F.col("nb")))))
    parts = {
        "a": (c.select(subject, a, (mas - ms).alias("v")).distinct(), [a]),
        "b": (c.select(subject, b, (mbs - ms).alias("v")).distinct(), [b]),
        "ab": (c.select(subject, a, b, (y - mas - mbs + ms).alias("v")), [a, b]),
    }
    eps = None
    for name, (effects, level) in parts.items():
        one = _epsilon(effects, subject, level, "v", F.lit(1.0)).withColumn("effect", F.lit(name))
        eps = one if eps is None else eps.union(one)
    out = out.join(F.broadcast(eps), "effect").withColumn("epsilon", F.col("epsilon") / F.col("df1"))
    return out.withColumns({"p": fisher_p(F.col("f"), F.col("df1"), F.col("df2")), "p_gg": fisher_p(F.col("f"), F.col("df1") * F.col("epsilon"), F.col("df2") * F.col("epsilon"))})


def normal_draw(*parts: Column) -> Column:
    """A standard normal number from whole numbers, by two uniform draws."""
    u, v = 1 - draw(*parts, F.lit(1)), draw(*parts, F.lit(2))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def random_option_baseline(test: DataFrame, anchors: DataFrame, keys: list[str], key: str, option: str, anchor: str, truth: str, n: int, seed: int) -> DataFrame:
    """(keys, b, mae): error of predicting each test row by the training anchor of an option drawn at random, in each of n
    replicates. ``anchors`` (keys, option, anchor) are few and broadcast; ``key`` is a whole number of the row."""
    a = anchors.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(option, anchor))), lambda s: s[anchor]).alias("_a"))
    r = replicates(test.select(*keys, key, truth), n).join(F.broadcast(a), keys)
    pick = F.floor(draw(F.lit(seed), F.col("b"), F.col(key)) * F.size("_a")).cast("int")
    return r.groupBy(*keys, "b").agg(F.avg(F.abs(F.get("_a", pick) - F.col(truth))).alias("mae"))


def modal_share_null(cells: DataFrame, key: str, option: str, value: str, n: int, seed: int) -> DataFrame:
    """One row: the share of the keys whose best option is the most frequent one, and the same under a shared surface.

    Under the null every key has the options' means plus normal noise of the residuals' standard deviation, n times over.
    ``p_value``: share of replicates whose modal share is no greater than the observed one. Keys are whole numbers.
    """
    means = cells.groupBy(option).agg(F.avg(value).alias("_m")).withColumn("_o", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(option)) - 1)
    sd = cells.join(F.broadcast(means), option).agg(F.stddev_samp(F.col(value) - F.col("_m")).alias("residual_sd"))
    share = lambda df, *by: df.groupBy(*by, "best").agg(F.count("*").alias("c")).groupBy(*by).agg((F.max("c") / F.sum("c")).alias("share"))
    best = cells.groupBy(key).agg(F.max_by(option, F.struct(value, option)).alias("best"))
    observed = share(best).select(F.col("share").alias("modal_share"))
    noise = F.col("residual_sd") * normal_draw(F.lit(seed), F.col("b"), F.col(key), F.col("_o"))
    drawn = replicates(cells.select(key).distinct(), n).join(F.broadcast(means)).join(F.broadcast(sd)).withColumn("_v", F.round(F.col("_m") + noise, 9))
    null = share(drawn.groupBy("b", key).agg(F.max_by(option, F.struct("_v", option)).alias("best")), "b")
    out = null.join(F.broadcast(observed)).groupBy("modal_share").agg(F.avg("share").alias("null_mean"), F.percentile("share", 0.025).alias("null_low"), F.percentile("share", 0.975).alias("null_high"), F.avg((F.col("share") <= F.col("modal_share")).cast("int")).alias("p_value"))
    return out.join(F.broadcast(sd))


def permute_within(df: DataFrame, keys: list[str], order: str, value: str, seed: int) -> DataFrame:
    """``value`` shuffled inside each group, in an order that depends on the seed and ``order`` alone."""
    a = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    b = df.select(*keys, F.col(value).alias("shuffled"), F.row_number().over(Window.partitionBy(*keys).orderBy(draw(F.lit(seed), F.col(order)), order)).alias("_n"))
    return a.join(b, [*keys, "_n"]).drop("_n")


def uniform_baseline(df: DataFrame, key: str, truth: str, n: int, seed: int) -> DataFrame:
    """MAE of uniform predictions in each of n replicates; the rows are participants' conditions, few."""
    p = draw(F.lit(seed), F.col("b"), F.col(key))
    return replicates(df.select(key, truth), n).groupBy("b").agg(F.avg(F.abs(p - F.col(truth))).alias("estimate"))


def argmax_stability(cells: DataFrame, key: str, option: str, value: str, n: int, seed: int) -> DataFrame:
    """Share of resamples of keys in which each option has the highest mean."""
    members = cells.select(key).distinct()
    own = numbered(members, key).join(cells, key).select("i", option, F.col(value).alias("_v"))
    t = _picks(cells.sparkSession, members.count(), n, seed).join(own, "i")
    m = t.groupBy("b", option).agg(F.avg("_v").alias("m"))
    best = m.groupBy("b").agg(F.max_by(option, F.struct("m", option)).alias(option))
    return best.groupBy(option).agg((F.count("*") / n).alias("share"))


MADE = 2_000_000
"""Rows of a manifest that one task makes."""

BESIDE = 256
"""Members whose rows of one fold stand side by side."""


def lopo_manifest(members: DataFrame, key: str) -> DataFrame:
    """(fold_index, key, role): in fold i the i-th key is the test, the one after it (cyclic) validation, the rest train.

    The result has the square of the members' number of rows, in as many tasks as rows ask for. A task has a block of members and a range of
    folds, and no list of all members travels. Its rows go fold by fold, each with the same members in order, which files of columns
    store as runs and repetitions.
    """
    m = numbered(members.select(key).distinct(), key)
    n = members.select(key).distinct().count()
    wide = max(1, min(BESIDE, n))
    long = max(1, MADE // wide)
    blocks = m.groupBy(F.floor(F.col("i") / wide).alias("_b")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", key))), lambda s: s[key]).alias("_k"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.lit(max(n - 1, 0)).cast("bigint"), F.lit(long).cast("bigint"))
    tiles = blocks.withColumn("_from", F.explode(starts))
    across = -(-n // long)
    spread = tiles.repartitionById(max(1, -(-n // wide) * across), (F.col("_b") * across + F.floor(F.col("_from") / long)).cast("int"))
    f = spread.withColumn("fold_index", F.explode(F.sequence("_from", F.least(F.col("_from") + long, F.lit(n).cast("bigint")) - 1)))
    f = f.sortWithinPartitions("fold_index")  # between the generators, as otherwise a task's rows wait in memory until the last is made
    f = f.select("_b", "fold_index", F.posexplode("_k").alias("_p", key)).withColumn("i", F.col("_b") * wide + F.col("_p"))
    role = F.when(F.col("i") == F.col("fold_index"), "test").when(F.col("i") == F.pmod(F.col("fold_index") + 1, F.lit(n)), "validation").otherwise("train")
    return f.select("fold_index", key, role.alias("role"))
