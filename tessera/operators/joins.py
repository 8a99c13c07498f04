"""Joins: labels, one-to-one, reconciling, intervals, as-of, pairs, folds and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def require_unique(df: DataFrame, keys: list[str], what: str = "table") -> None:
    """Raise if two rows share a key. One count with map-side combine; a single row comes to the driver."""
    again = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"{what}: key {[again[0][k] for k in keys]} is not unique")


def join_labels(windows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Windows with their condition's labels; where names clash the window's column stays."""
    new = [c for c in labels.columns if c not in windows.columns]
    return windows.join(labels.select(*keys, *new), keys, "left")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    require_unique(left, keys, "left")
    require_unique(right, keys, "right")
    return left.join(right, keys, how)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on keys with ``side``: both, left or right."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    side = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    return a.join(b, keys, "full_outer").withColumn("side", side).drop("_l", "_r")


def apply_masks(df: DataFrame, masks: DataFrame, keys: list[str], columns: dict[str, list[str]]) -> DataFrame:
    """NULL in a modality's columns where its mask isn't true; the masks stay as columns."""
    out = df.join(masks.select(*keys, *columns), keys, "left")
    return out.withColumns({c: F.when(F.col(m), F.col(c)) for m, cs in columns.items() for c in cs})


def samples_to_windows(samples: DataFrame, windows: DataFrame, keys: list[str], ts: str, start: str, end: str, width: int) -> DataFrame:
    """Samples in half-open windows [start, end) of the same key.

    An equi-join on (key, time bucket of ``width``): a long session is many buckets and so many tasks. A window
    is repeated for each bucket it touches; pick a width near the windows' length.
    """
    w = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    s = samples.withColumn("_b", F.floor(F.col(ts) / width))
    return s.join(w, [*keys, "_b"]).filter((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("_b")


def overlapping(windows: DataFrame, intervals: DataFrame, keys: list[str], width: int, how: str = "left_semi", start: str = "start", end: str = "end") -> DataFrame:
    """Windows that meet an interval of their key (left_semi), or that meet none (left_anti).

    Both sides are spread over time buckets; the windows that meet are found there and come back by key.
    """
    spread = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    i = spread(intervals.select(*keys, start, end)).select(*keys, "_b", F.col(start).alias("_s"), F.col(end).alias("_e"))
    met = spread(windows).join(i, [*keys, "_b"]).filter((F.col(start) < F.col("_e")) & (F.col("_s") < F.col(end)))
    return windows.join(met.select(*keys, start, end).distinct(), [*keys, start, end], how)


def _merged(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, columns: list[str], names: list[str], bucket: int | None) -> DataFrame:
    """Both sides as rows (keys, _t, _l, _r) of one time column, with ``_b``, the stretch of ``bucket`` units of time."""
    payload = F.struct(F.col(right_ts), *columns)
    a = left.select(*keys, F.col(left_ts).alias("_t"), F.struct(*names).alias("_l"), F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType).alias("_r"))
    b = right.select(*keys, F.col(right_ts).alias("_t"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), payload.alias("_r"))
    return a.unionByName(b).withColumn("_b", F.floor(F.col("_t") / bucket) if bucket else F.lit(0))


def _beside(both: DataFrame, keys: list[str], sides: dict[str, bool], bucket: int | None) -> DataFrame:
    """The left rows with a column for each of ``sides``, name -> forward: the last right row before or the first after, in its stretch
    or carried over from the nearest that has one. Right rows of the same time count on either side."""
    part = [*keys, "_b"] if bucket else list(keys)
    order = lambda forward: Window.partitionBy(*part).orderBy(F.desc("_t") if forward else F.asc("_t"), F.col("_l").isNotNull().cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({n: F.last("_r", True).over(order(forward)) for n, forward in sides.items()}).filter("_l is not null")
    if not bucket:
        return out
    edge = {n: F.min_by("_r", "_t") if forward else F.max_by("_r", "_t") for n, forward in sides.items()}
    ends = both.filter("_r is not null").groupBy(*part).agg(*[e.alias(f"_e{n}") for n, e in edge.items()]).join(both.select(*part).distinct(), part, "right")
    far = lambda forward: Window.partitionBy(*keys).orderBy(F.desc("_b") if forward else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*part, *[F.last(f"_e{n}", True).over(far(forward)).alias(f"_c{n}") for n, forward in sides.items()])
    return out.join(ends, part).withColumns({n: F.coalesce(n, f"_c{n}") for n in sides})


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, columns: list[str], forward: bool = False, bucket: int | None = None) -> DataFrame:
    """``left`` with ``columns`` and ``right_ts`` of the last right row at or before it, or the first at or after it.

    Both sides go through one sort by time, in one shuffle. With ``bucket`` (units of time) each sort is over
    one stretch of a key, and only each stretch's last right row is carried on; so a key can be many tasks.
    """
    names = [c for c in left.columns if c not in columns]
    both = _merged(left, right, keys, left_ts, right_ts, columns, names, bucket)
    out = _beside(both, keys, {"_m": forward}, bucket)
    return out.select(*[F.col(f"_l.{c}").alias(c) for c in names], *[F.col(f"_m.{c}").alias(c) for c in (right_ts, *columns)])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, columns: list[str], tolerance: float, bucket: int | None = None) -> DataFrame:
    """``left`` with the nearest right row in time, the earlier of two as near; NULL beyond ``tolerance``.

    Both neighbours come from one shuffle; ``bucket`` as in ``asof``.
    """
    both = [right_ts, *columns]
    names = [c for c in left.columns if c not in both]
    out = _beside(_merged(left, right, keys, left_ts, right_ts, columns, names, bucket), keys, {"_back": False, "_on": True}, bucket)
    lag_back, lag_on = F.col("_t") - F.col(f"_back.{right_ts}"), F.col(f"_on.{right_ts}") - F.col("_t")
    use_back = lag_back.isNotNull() & (lag_on.isNull() | (lag_back <= lag_on))
    lag = F.when(use_back, lag_back).otherwise(lag_on)
    chosen = [F.when(lag <= tolerance, F.when(use_back, F.col(f"_back.{c}")).otherwise(F.col(f"_on.{c}"))).alias(c) for c in both]
    return out.select(*[F.col(f"_l.{c}").alias(c) for c in names], *chosen, F.when(lag <= tolerance, lag).alias("lag"))


def pair_by_key(events: DataFrame, keys: list[str], kind: str, ts: str) -> DataFrame:
    """(keys, start, end, problem) of 'start' and 'end' markers: duplicate, incomplete and non-positive pairs are named."""
    at = lambda k: F.when(F.col(kind) == k, F.col(ts))
    g = events.groupBy(*keys).agg(F.min(at("start")).alias("start"), F.min(at("end")).alias("end"), F.count(at("start")).alias("_n"), F.count(at("end")).alias("_m"))
    problem = F.when((F.col("_n") > 1) | (F.col("_m") > 1), "duplicate").when((F.col("_n") == 0) | (F.col("_m") == 0), "incomplete").when(F.col("end") <= F.col("start"), "not_positive")
    return g.withColumn("problem", problem).drop("_n", "_m")


def pair_by_order(events: DataFrame, keys: list[str], kind: str, ts: str) -> DataFrame:
    """(keys, start, end): each start with the next end after it that no earlier start took; starts without one go.

    With open = starts so far less ends used so far, an end closes the earliest open start, so the n-th used end
    belongs to the n-th start. Ends while nothing is open are passed over. Running sums, no loop: an end is used
    unless the balance of starts and ends is at a new low.
    """
    w = Window.partitionBy(*keys).orderBy(ts, F.when(F.col(kind) == "end", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col(kind) == "start", 1).otherwise(-1)
    e = events.filter(F.col(kind).isin("start", "end")).withColumn("_s", F.sum(step).over(w))
    e = e.withColumn("_low", F.least(F.lit(0), F.min("_s").over(w)))
    before = Window.partitionBy(*keys).orderBy(ts, F.when(F.col(kind) == "end", 0).otherwise(1))
    e = e.withColumn("_spare", (F.col(kind) == "end") & (F.col("_low") < F.coalesce(F.lag("_low").over(before), F.lit(0)))).filter(~F.col("_spare"))
    n = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(ts))
    e = e.select(*keys, kind, ts, n.alias("_n"))
    a = e.filter(F.col(kind) == "start").select(*keys, "_n", F.col(ts).alias("start"))
    b = e.filter(F.col(kind) == "end").select(*keys, "_n", F.col(ts).alias("end"))
    return a.join(b, [*keys, "_n"]).drop("_n")


def pairs(df: DataFrame, keys: list[str], position: str, columns: list[str]) -> DataFrame:
    """Ordered pairs of rows of a group, left before right; groups are meant to be small and bounded (conditions of one
    participant)."""
    a = df.select(*keys, *[F.col(c).alias(f"left_{c}") for c in (position, *columns)])
    b = df.select(*keys, *[F.col(c).alias(f"right_{c}") for c in (position, *columns)])
    return a.join(b, keys).filter(F.col(f"left_{position}") < F.col(f"right_{position}"))


def expand_folds(df: DataFrame, manifest: DataFrame, participant: str) -> DataFrame:
    """Every row once per fold, with its role there."""
    return df.join(manifest, participant)


def cohort(df: DataFrame, members: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the members, members without rows)."""
    return df.join(members, key, "left_semi"), members.join(df, key, "left_anti")


def grid_neighbours(spark, itself: bool = True) -> DataFrame:
    """(number, neighbour) of the 3 x 3 grid: one step on one axis."""
    g = spark.range(1, 10).select(F.col("id").cast("int").alias("number"))
    i, f = (lambda c: F.floor((c - 1) / 3)), (lambda c: (c - 1) % 3)
    h = g.withColumnRenamed("number", "neighbour")
    steps = F.abs(i(F.col("number")) - i(F.col("neighbour"))) + F.abs(f(F.col("number")) - f(F.col("neighbour")))
    return g.join(h, (steps <= 1) if itself else (steps == 1))


def label_by_substring(segments: DataFrame, labels: DataFrame, key: str, path: str, name: str, columns: list[str]) -> DataFrame:
    """Segments with the first label, by name, of their subject whose name is part of the path."""
    m = segments.join(labels.select(key, name, *columns), key).filter(F.contains(F.lower(path), F.lower(name)))
    best = m.groupBy(*segments.columns).agg(F.min(F.struct(name, *columns)).alias("_b"))
    return best.select(*segments.columns, *[F.col(f"_b.{c}").alias(c) for c in (name, *columns)])


def normal_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", " ")


def session_labels(sessions: DataFrame, labels: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """Sessions with the mean label over its rounds; names meet without regard to case, spaces and underscores."""
    mean = labels.groupBy(key, normal_name(F.col(name)).alias("_n")).agg(F.avg(value).alias(value), F.count(value).alias("rounds"))
    return sessions.withColumn("_n", normal_name(F.col(name))).join(mean, [key, "_n"], "left").drop("_n")


def missing_artifacts(manifest: DataFrame, artifacts: DataFrame, key: str, encoder: str, encoders: list[str]) -> DataFrame:
    """Manifest rows with the encoders they have no artifact of; rows that lack none are left out."""
    have = artifacts.groupBy(key).agg(F.collect_set(encoder).alias("_h"))
    lack = F.array_except(F.array(*[F.lit(e) for e in encoders]), F.coalesce("_h", F.array().cast("array<string>")))
    return manifest.join(have, key, "left").withColumn("missing", lack).drop("_h").filter(F.size("missing") > 0)


def metadata_mismatch(manifest: DataFrame, artifacts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, mismatches): fields in which an artifact differs from its manifest row, NULLs equal to each other."""
    a = artifacts.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields])
    wrong = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_a_{f}")), f) for f in fields]))
    return manifest.join(a, key).select(key, wrong.alias("mismatches")).filter(F.size("mismatches") > 0)
