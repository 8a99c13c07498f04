"""Quality checks and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.ranges import quantiles

# Thresholds of the cohorts, and the outlier limit of a clock residual in ms.
COHORT = {"window": 0.95, "ecg": 0.80, "eeg": 0.70, "gaze": 0.80, "head": 0.90, "video": 0.90}
OUTLIER_MS = 50.0


def clock_offset(pairs: DataFrame, keys: list[str], a: Column, b: Column, outlier: float = OUTLIER_MS) -> DataFrame:
    """Median of a - b, largest residual and number of outliers per key; ``clock_outliers`` lists them."""
    d, r = _residuals(pairs, keys, a, b)
    return d.groupBy(*keys, "offset").agg(F.max(r).alias("max_residual"), F.count_if(r >= outlier).alias("outliers"))


def clock_outliers(pairs: DataFrame, keys: list[str], a: Column, b: Column, outlier: float = OUTLIER_MS) -> DataFrame:
    """The rows whose a - b is ``outlier`` or more from their key's median, with ``offset`` and the signed ``residual``; a row each, as
    a clock that jumped may give most of a session's."""
    d, r = _residuals(pairs, keys, a, b)
    return d.filter(r >= outlier).withColumn("residual", F.col("_d") - F.col("offset")).drop("_d")


def _residuals(pairs: DataFrame, keys: list[str], a: Column, b: Column) -> tuple[DataFrame, Column]:
    d = pairs.withColumn("_d", (a - b).cast("double"))
    d = d.join(quantiles(d, keys, "_d", {"offset": 0.5}).drop("n"), keys)
    return d, F.abs(F.col("_d") - F.col("offset"))


def counter_gaps(samples: DataFrame, keys: list[str], order: str, counter: str) -> DataFrame:
    """Share of counter steps that differ from the median positive step."""
    s = samples.withColumn("_d", F.col(counter) - F.lag(counter).over(Window.partitionBy(*keys).orderBy(order)))
    s = s.join(s.groupBy(*keys).agg(F.percentile(F.when(F.col("_d") > 0, F.col("_d")), 0.5).alias("_m")), keys)
    return s.groupBy(*keys).agg(F.avg(F.when(F.col("_d").isNotNull(), (F.col("_d") != F.col("_m")).cast("int"))).alias("gap_fraction"))


def block_coverage(samples: DataFrame, keys: list[str], ts: str, channels: list[str], block: int, low: float, high: float, share: float = 0.75) -> DataFrame:
    """Share of blocks in which enough channels are in range and not flat."""
    good = [((F.min(c) >= low) & (F.max(c) <= high) & (F.stddev_pop(c) > 1e-9)).cast("int") for c in channels]
    b = samples.groupBy(*keys, F.floor(F.col(ts) / block).alias("_b")).agg(sum((F.coalesce(g, F.lit(0)) for g in good), F.lit(0)).alias("_g"))
    return b.groupBy(*keys).agg(F.avg((F.col("_g") >= share * len(channels)).cast("int")).alias("coverage"), F.count("*").alias("blocks"))


def segment_quality(samples: DataFrame, keys: list[str], segment: Column, value: str, least: float) -> DataFrame:
    """A segment is good if nothing is missing and it varies enough."""
    g = samples.groupBy(*keys, segment.alias("segment")).agg(F.count_if(F.col(value).isNull()).alias("_n"), F.stddev_pop(value).alias("_s"))
    return g.select(*keys, "segment", ((F.col("_n") == 0) & (F.coalesce("_s", F.lit(0.0)) >= least)).alias("good"))


def window_quality(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Range of the middle 90 %, variance and excess kurtosis."""
    q = quantiles(samples, keys, value, {"_low": 0.05, "_high": 0.95})
    m = samples.groupBy(*keys).agg(F.var_pop(value).alias("variance"), F.kurtosis(value).alias("kurtosis"))
    return m.join(q, keys, "left").select(*keys, (F.col("_high") - F.col("_low")).alias("robust_range"), "variance", "kurtosis")


def participant_manifest(labels: DataFrame, windows: DataFrame, usable: DataFrame, key: str, conditions: int, modalities: list[str], expected: DataFrame | None = None) -> DataFrame:
    """One row per participant: label completeness, windows seen, usable share of each modality, their mean as score.

    With ``expected`` (key, expected_windows) also the expected windows, the share of them that was seen, and that share in the
    score; a participant of whom none is expected has no share, and one that is expected but has no label is listed too.
    """
    a = labels.groupBy(key).agg((F.count_distinct("condition") / conditions).alias("label_ratio"))
    b = windows.groupBy(key).agg(F.count("*").alias("windows"))
    c = usable.groupBy(key).agg(*[F.avg(F.col(f"{m}_usable").cast("int")).alias(f"{m}_ratio") for m in modalities])
    out = a.join(b, key, "left").join(c, key, "left").withColumn("windows", F.coalesce("windows", F.lit(0)))
    if expected is None:
        return out.withColumn("score", sum((F.coalesce(f"{m}_ratio", F.lit(0.0)) for m in modalities), F.col("label_ratio")) / (len(modalities) + 1))
    out = out.join(expected, key, "full_outer").withColumns({"windows": F.coalesce("windows", F.lit(0)), "label_ratio": F.coalesce("label_ratio", F.lit(0.0))})
    out = out.withColumn("window_ratio", F.least(F.lit(1.0), F.col("windows") / F.nullif(F.col("expected_windows"), F.lit(0))))
    return out.withColumn("score", sum((F.coalesce(f"{m}_ratio", F.lit(0.0)) for m in ["window", *modalities]), F.col("label_ratio")) / (len(modalities) + 2))


def cohorts(manifest: DataFrame, key: str, limits: dict[str, float], pilot: int) -> DataFrame:
    """Members of "usable" (all limits met) and of "pilot" (its best ``pilot`` by score, then key)."""
    ok = F.lit(True)
    for c, v in limits.items():
        ok = ok & (F.col(c) >= v)
    usable = manifest.filter(ok)
    best = usable.orderBy(F.desc("score"), key).limit(pilot)
    return usable.select(key, F.lit("usable").alias("cohort")).union(best.select(key, F.lit("pilot").alias("cohort")))


def common_valid(masks: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Windows where all masks are true per group, and whether there is none."""
    both = F.lit(True)
    for c in columns:
        both = both & F.coalesce(F.col(c), F.lit(False))
    return masks.groupBy(*keys).agg(F.count_if(both).alias("valid"), F.count("*").alias("windows")).withColumn("none_valid", F.col("valid") == 0).withColumn("ratio", F.col("valid") / F.col("windows"))


def completeness(df: DataFrame, key: str, item: str, expected: list[str]) -> DataFrame:
    """(key, missing, duplicated) lists against the expected items, for keys with a fault."""
    n = df.groupBy(key, item).count()
    g = n.groupBy(key).agg(F.collect_set(item).alias("_h"), F.collect_set(F.when(F.col("count") > 1, F.col(item))).alias("duplicated"))
    out = g.select(key, F.array_sort(F.array_except(F.array(*[F.lit(x) for x in expected]), "_h")).alias("missing"), F.array_sort("duplicated").alias("duplicated"))
    return out.filter((F.size("missing") > 0) | (F.size("duplicated") > 0))


def shape_audit(tables: dict[str, tuple[DataFrame, int | None]]) -> DataFrame:
    """Rows and columns of each table against the expected number of rows."""
    out = None
    for name, (df, expected) in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(expected).cast("bigint").alias("expected")).withColumn("ok", F.coalesce(F.col("n_rows") == F.col("expected"), F.lit(True)))
        out = one if out is None else out.union(one)
    return out


def vector_variance(df: DataFrame, vector: str, dead: float = 1e-6) -> DataFrame:
    """(place, variance, dead) over all vectors."""
    v = df.select(F.posexplode(vector).alias("place", "x")).groupBy("place").agg(F.var_pop(F.col("x").cast("double")).alias("variance"))
    return v.withColumn("dead", F.col("variance") < dead)


def embedding_sanity(df: DataFrame, key: str, vector: str, dead: float = 1e-6, degenerate: float = 0.99, seed: int = 9, buckets: int = 64) -> DataFrame:
    """One row: variance over the places, dead places, cosine of sampled pairs, and a verdict.

    Each vector is paired with the next in an order drawn by hash, within hash buckets, so the pairs are as many as
    the vectors and no task has all. ``key``: a whole number.
    """
    from tessera.operators.resample import draw

    v = vector_variance(df, vector, dead)
    s = v.agg(F.avg("variance").alias("variance_mean"), F.min("variance").alias("variance_min"), F.max("variance").alias("variance_max"), F.count_if("dead").alias("dead_places"), F.count("*").alias("places"))
    e = df.select(key, F.transform(vector, lambda x: x.cast("double")).alias("_a"), draw(F.lit(seed), F.col(key)).alias("_d"))
    w = Window.partitionBy(F.floor(F.col("_d") * buckets)).orderBy("_d", key)
    p = e.withColumn("_b", F.lead("_a").over(w)).filter("_b is not null")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda t, z: t + z)
    c = p.select((dot("_a", "_b") / F.sqrt(dot("_a", "_a") * dot("_b", "_b"))).alias("c"))
    k = c.agg(F.avg("c").alias("cosine_mean"), F.stddev_pop("c").alias("cosine_std"), F.min("c").alias("cosine_min"), F.max("c").alias("cosine_max"), F.count("*").alias("pairs"))
    bad = (F.col("cosine_mean") > degenerate) | (F.col("variance_min") < dead)
    return s.join(F.broadcast(k)).withColumn("verdict", F.when(bad, "DEGENERATE").otherwise("USABLE"))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    g = df.select(key, F.posexplode(vector).alias("place", "x")).groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return g.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("centroid"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def centroid_distances(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Distances between the classes' centroids; as many rows as pairs of classes, a small number."""
    c = centroids(df, key, vector)
    a, b = c.select(F.col(key).alias("left"), F.col("centroid").alias("_a"), F.lit(1).alias("_k")), c.select(F.col(key).alias("right"), F.col("centroid").alias("_b"), F.lit(1).alias("_k"))
    return a.join(b, "_k").filter("left < right").select("left", "right", distance(F.col("_a"), F.col("_b")).alias("distance"))


def cadence(log: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Statistics of the positive steps between entries."""
    from tessera.operators.features import robust_stats

    d = log.withColumn("step", (F.col(ts) - F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts))).cast("double"))
    return d.filter("step > 0").groupBy(*keys).agg(F.count("*").alias("n"), *robust_stats("step"))


def latency(df: DataFrame, key: str, delay: Column) -> DataFrame:
    """Delays per session and over all (key NULL); the quantiles of all are counted in ranges, as one session's are."""
    d = df.withColumn("_d", delay.cast("double"))
    m = d.rollup(key).agg(F.avg("_d").alias("mean"), F.min("_d").alias("min"), F.max("_d").alias("max"), F.count("*").alias("n"), F.grouping(key).alias("_all"))
    shares = {"median": 0.5, "p95": 0.95}
    q = quantiles(d, [key], "_d", shares).withColumn("_all", F.lit(0)).unionByName(quantiles(d, [], "_d", shares).withColumns({key: F.lit(None).cast(d.schema[key].dataType), "_all": F.lit(1)}), allowMissingColumns=True)
    q = q.select(F.col(key).alias("_k"), F.col("_all").alias("_a"), *shares)
    return m.join(q, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_all") == F.col("_a")), "left").select(key, "mean", "median", "p95", "min", "max", "n")


def modality_ages(df: DataFrame, keys: list[str], ages: str) -> DataFrame:
    """A map of ages to rows; ages below 0 are left out."""
    return df.select(*keys, F.explode(ages).alias("modality", "age")).filter("age >= 0")
