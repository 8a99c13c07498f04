"""Queries of windows, segments and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import features as X
from tessera.operators import segments as G
from tessera.plans.join_queries import HOUR, SAMPLES, samples
from tessera.plans.registry import Tables, query

DAY = 24 * HOUR
BOUNDS = f"""b AS (SELECT participant, condition, min(ms) AS start, max(ms) AS "end" FROM s GROUP BY ALL)"""
CELLS = f"""WITH {SAMPLES}, f AS (SELECT participant, condition, min(ms) AS start FROM s GROUP BY ALL), w AS (SELECT s.*, (ms - start) // {DAY} AS k FROM s JOIN f USING (participant, condition)),
c AS (SELECT participant, condition, k, avg(value) AS v FROM w GROUP BY ALL)"""


def bounds(t: Tables) -> DataFrame:
    return samples(t).groupBy("participant", "condition").agg(F.min("ms").alias("start"), F.max("ms").alias("end"))


def cells(t: Tables) -> DataFrame:
    """(participant, condition, k, v): mean value per day-long window from the condition's start."""
    s = samples(t)
    first = s.groupBy("participant", "condition").agg(F.min("ms").alias("start"))
    w = s.join(first, ["participant", "condition"]).withColumn("k", F.floor((F.col("ms") - F.col("start")) / DAY))
    return w.groupBy("participant", "condition", "k").agg(F.avg("value").alias("v"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded as SQL does: scaled, to the nearest whole number, halves away from zero, with the sign of what becomes zero."""
    return df.select(*[_round(c, digits).alias(c) if kind == "double" else c for c, kind in df.dtypes])


def _round(name: str, digits: int) -> Column:
    c, scale = F.col(name), float(10**digits)
    whole = F.round(c * scale, 0)
    return F.when(whole == 0, c * 0.0).when(F.abs(c) * scale < 2.0**53, whole / scale).otherwise(c)


@query("tumbling_windows_from_boundary", f"""WITH {SAMPLES}, {BOUNDS}, n AS (SELECT *, ("end" - start) // {DAY} AS n FROM b) SELECT participant, condition, CAST(i AS INTEGER) AS "index", start + i * {DAY} AS window_start, start + (i + 1) * {DAY} AS window_end, round(1.0 / n, 9) AS sample_weight FROM (SELECT *, unnest(range(n)) AS i FROM n)""")
def _(t: Tables) -> DataFrame:
    w = G.tumbling(bounds(t), "start", "end", DAY)
    return rounded(w.select("participant", "condition", "index", "window_start", "window_end", "sample_weight"), 9)


@query("sliding_windows_from_boundary", f"""WITH {SAMPLES}, {BOUNDS} SELECT participant, condition, unnest(range(start, "end" - {DAY} + 1, {DAY // 2})) AS window_start FROM b""")
def _(t: Tables) -> DataFrame:
    return G.sliding(bounds(t), "start", "end", DAY, DAY // 2).select("participant", "condition", "window_start")


@query(
    "task_chunks",
    f"""WITH {SAMPLES}, {BOUNDS}, o AS (SELECT participant, min(ms) AS origin FROM s GROUP BY 1), i AS (SELECT b.participant, condition, CAST(floor((start - origin) * 0.001) AS BIGINT) AS f, CAST(floor(("end" - origin) * 0.001) AS BIGINT) AS l FROM b JOIN o USING (participant)),
        c AS (SELECT participant, condition, f, unnest(range((l - f) // 86400)) AS chunk FROM i)
        SELECT participant, condition, CAST(chunk AS INTEGER) AS chunk, f + chunk * 86400 AS start_index, f + (chunk + 1) * 86400 AS end_index, CAST(row_number() OVER (PARTITION BY participant ORDER BY f + chunk * 86400, condition) - 1 AS INTEGER) AS global_seq FROM c""",
)
def _(t: Tables) -> DataFrame:
    origin = samples(t).groupBy("participant").agg(F.min("ms").alias("origin"))
    return G.task_chunks(bounds(t), origin, "participant", "condition", "start", "end", 0.001, 86_400_000.0).drop("origin")


@query(
    "validate_chunks",
    """WITH c AS (SELECT l_orderkey, l_partkey, CAST(l_partkey % 50 AS INTEGER) - 2 AS s, CAST(l_partkey % 50 - 2 + CASE WHEN l_suppkey % 4 = 0 THEN 9 ELSE 10 END AS INTEGER) AS e FROM lineitem),
       p AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c)
       SELECT l_orderkey, s, e, concat_ws(',', CASE WHEN s < prev THEN 'overlap' END, CASE WHEN s < 0 THEN 'negative_start' END, CASE WHEN e > 50 THEN 'past_end' END, CASE WHEN e - s <> 10 THEN 'wrong_size' END) AS problems FROM p
       WHERE s < prev OR s < 0 OR e > 50 OR e - s <> 10""",
)
def _(t: Tables) -> DataFrame:
    s = (F.col("l_partkey") % 50 - 2).cast("int")
    c = t.lineitem.select("l_orderkey", s.alias("s"), (s + F.when(F.col("l_suppkey") % 4 == 0, 9).otherwise(10)).alias("e"), F.lit(50).alias("total"))
    return G.chunk_problems(c, "l_orderkey", "s", "e", 10, "total").select("l_orderkey", "s", "e", F.array_join("problems", ",").alias("problems"))


@query(
    "baseline_windows",
    f"""WITH {SAMPLES}, o AS (SELECT participant, quantile_cont(value * 3, 0.5) AS shift FROM s GROUP BY 1), f AS (SELECT participant, min(ms) AS start FROM s GROUP BY 1)
        SELECT participant, CAST(i AS INTEGER) AS "index", start + CAST(round_even(shift, 0) AS BIGINT) + i * 10000 AS window_start, start + CAST(round_even(shift, 0) AS BIGINT) + (i + 1) * 10000 AS window_end FROM (SELECT *, unnest(range(4)) AS i FROM f JOIN o USING (participant))""",
)
def _(t: Tables) -> DataFrame:
    s = samples(t)
    return G.baseline_windows(s.select("participant", (F.col("value") * 3).alias("offset")), s.groupBy("participant").agg(F.min("ms").alias("start")), "participant", "start")


@query("analysis_tail_interval", f"""WITH {SAMPLES}, {BOUNDS} SELECT participant, condition, least(CASE WHEN participant % 2 = 0 THEN CAST(participant + 60 AS DOUBLE) ELSE 90.0 END, CAST("end" - start AS DOUBLE)) AS tail_seconds FROM b""")
def _(t: Tables) -> DataFrame:
    notes = F.when(F.col("participant") % 2 == 0, F.concat(F.lit("use LAST "), (F.col("participant") + 60).cast("string"), F.lit(" s only"))).otherwise("none")
    b = bounds(t).withColumn("notes", notes)
    return G.tail_interval(b, "start", "end", "notes", 90.0).select("participant", "condition", "tail_seconds")


@query("uniform_frame_sample")
def _(t: Tables) -> DataFrame:
    frames = samples(t).select("participant", "condition", "ms", "event_id")
    return G.uniform_frames(frames, bounds(t), ["participant", "condition"], "ms", "event_id", "start", "end", 5).select("participant", "condition", "ms", "event_id")


@query(
    "fps_frame_sample",
    f"""WITH {SAMPLES}, {BOUNDS}, g AS (SELECT participant, condition, start + ("end" - start) / 4.0 * (unnest(range(4)) + 0.5) AS target FROM b),
        j AS (SELECT g.*, ms, event_id, row_number() OVER (PARTITION BY g.participant, g.condition, target ORDER BY abs(ms - target), ms, event_id) AS r FROM g JOIN s USING (participant, condition)) SELECT DISTINCT participant, condition, ms, event_id FROM j WHERE r = 1""",
)
def _(t: Tables) -> DataFrame:
    w = G.bin_centres(bounds(t), "start", "end", 4).select("participant", "condition", "target")
    return G.frames_at(samples(t).select("participant", "condition", "ms", "event_id"), w, ["participant", "condition"], "ms", "target", "event_id", 7 * DAY)


@query(
    "choose_timestamp_source",
    """WITH f AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem),
       d AS (SELECT *, CASE WHEN l_suppkey % 3 = 0 AND i = 2 THEN NULL WHEN l_suppkey % 3 = 1 THEN i * 5 ELSE i * 100 END AS direct FROM f),
       e AS (SELECT *, direct - lag(direct) OVER (PARTITION BY l_suppkey ORDER BY i) AS step FROM d)
       SELECT l_suppkey, CASE WHEN l_suppkey % 3 = 2 THEN 'direct' ELSE 'iso' END AS source, CASE WHEN l_suppkey % 3 = 2 THEN 'direct' WHEN count(direct) < count(*) THEN 'direct_incomplete' ELSE 'direct_implausible' END AS reason FROM e GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    i = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    f = t.lineitem.withColumn("i", i)
    direct = F.when((F.col("l_suppkey") % 3 == 0) & (F.col("i") == 2), None).when(F.col("l_suppkey") % 3 == 1, F.col("i") * 5).otherwise(F.col("i") * 100)
    return G.timestamp_source(f.select("l_suppkey", "i", direct.alias("direct"), (F.col("i") * 100).alias("iso")), "l_suppkey", "direct", "iso", "i")


@query("rate_convert_bounds", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_partkey / 90.0 * 500) AS BIGINT) AS a, CAST(ceil((l_partkey + 90) / 90.0 * 500) AS BIGINT) AS b FROM lineitem")
def _(t: Tables) -> DataFrame:
    a, b = G.convert_bounds(F.col("l_partkey"), F.col("l_partkey") + 90, 90.0, 500.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", a.alias("a"), b.alias("b"))


@query(
    "context_padded_crop",
    f"""WITH {SAMPLES}, w AS (SELECT participant, min(ms) + {DAY} AS start, min(ms) + 2 * {DAY} AS "end" FROM s GROUP BY 1)
        SELECT s.participant, event_id, ms >= start AND ms < "end" AS is_inner FROM s JOIN w ON s.participant = w.participant AND ms >= start - {DAY // 2} AND ms < "end" + {DAY // 2}""",
)
def _(t: Tables) -> DataFrame:
    s = samples(t)
    w = s.groupBy("participant").agg((F.min("ms") + DAY).alias("start"), (F.min("ms") + 2 * DAY).alias("end"))
    return G.padded_crop(s, w, ["participant"], "ms", "start", "end", DAY // 2, 2 * DAY).select("participant", "event_id", "is_inner")


@query("formal_timeline", f"""WITH {SAMPLES}, {BOUNDS}, d AS (SELECT participant, condition, "end" - start AS duration FROM b) SELECT *, sum(duration) OVER w::BIGINT AS "end", (sum(duration) OVER w - duration)::BIGINT AS start FROM d WINDOW w AS (PARTITION BY participant ORDER BY condition ROWS UNBOUNDED PRECEDING)""")
def _(t: Tables) -> DataFrame:
    d = bounds(t).select("participant", "condition", (F.col("end") - F.col("start")).alias("duration"))
    return G.timeline(d, "participant", "condition", "duration")


@query("align_trials", f"""WITH {SAMPLES}, {BOUNDS}, x AS (SELECT participant, condition, start / 1000.0 AS a, "end" / 1000.0 AS z FROM b) SELECT participant, condition, CAST(i AS INTEGER) AS "index", round(a + i * 200000.0, 3) AS window_start FROM (SELECT *, unnest(range(CAST(floor((z - a) / 200000.0) AS BIGINT))) AS i FROM x)""")
def _(t: Tables) -> DataFrame:
    x = bounds(t).select("participant", "condition", (F.col("start") / 1000).alias("a"), (F.col("end") / 1000).alias("z"))
    return G.trial_windows(x, "a", "z", 200_000.0).select("participant", "condition", "index", F.round("window_start", 3).alias("window_start"))


@query("robust_stats", "SELECT user_id, event_type, round(avg(value), 6) AS value__mean, round(stddev_pop(value), 6) AS value__std, round(quantile_cont(value, 0.5), 6) AS value__median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS value__iqr, round(max(value) - min(value), 6) AS value__range FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return rounded(t.events.groupBy("user_id", "event_type").agg(*X.robust_stats("value")))


@query("robust_stats_by_type", "SELECT event_type, round(avg(value), 6) AS value__mean, round(stddev_pop(value), 6) AS value__std, round(quantile_cont(value, 0.5), 6) AS value__median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS value__iqr, round(max(value) - min(value), 6) AS value__range FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    """Few groups, each a share of the table."""
    return rounded(X.robust_table(t.events, ["event_type"], "value"))


@query(
    "condition_summary_stats",
    CELLS + """ SELECT participant, condition, count(*) AS window_count, round(avg(CASE WHEN x IS NULL THEN 1 ELSE 0 END), 9) AS v__missing_ratio, round(avg(x), 9) AS v__mean, round(stddev_pop(x), 9) AS v__std, round(min(x), 9) AS v__min, round(max(x), 9) AS v__max, round(quantile_cont(x, 0.5), 9) AS v__median,
    round(arg_min(x, k) FILTER (x IS NOT NULL), 9) AS v__first, round(arg_max(x, k) FILTER (x IS NOT NULL), 9) AS v__last, round(coalesce(CASE WHEN count(x) > 1 THEN regr_slope(x, k) END, CASE WHEN count(x) > 0 THEN 0.0 END), 6) AS v__slope FROM (SELECT *, CASE WHEN k % 5 <> 0 THEN v END AS x FROM c) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    c = cells(t).withColumn("v", F.when(F.col("k") % 5 != 0, F.col("v")))
    s = X.condition_summary(c, ["participant", "condition"], "k", ["v"])
    return rounded(s.withColumn("v__slope", F.round("v__slope", 6)), 9)


@query("causal_prefix_stats", CELLS + " SELECT participant, condition, k, round(avg(v) OVER w, 9) AS v__so_far_mean, round(stddev_pop(v) OVER w, 6) AS v__so_far_std, round(min(v) OVER w, 9) AS v__so_far_min, round(max(v) OVER w, 9) AS v__so_far_max, round(first_value(v) OVER w, 9) AS v__so_far_first, round(last_value(v IGNORE NULLS) OVER w, 9) AS v__so_far_last, count(v) OVER w AS v__so_far_count FROM c WINDOW w AS (PARTITION BY participant, condition ORDER BY k ROWS UNBOUNDED PRECEDING)")
def _(t: Tables) -> DataFrame:
    p = X.prefix_stats(cells(t), ["participant", "condition"], "k", "v")
    p = p.select("participant", "condition", "k", *[f"v__so_far_{n}" for n in ("mean", "std", "min", "max", "first", "last", "count")])
    return rounded(p.withColumn("v__so_far_std", F.round("v__so_far_std", 6)), 9)


@query("condition_mean_features", "SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return rounded(X.mean_features(t.lineitem, ["l_returnflag", "l_linestatus"], ("l_discount", "l_tax")))


@query("first_k_composite", CELLS + ", r AS (SELECT *, row_number() OVER (PARTITION BY participant, condition ORDER BY k) AS n FROM c) SELECT participant, condition, round(avg((v + k) / 2), 9) AS composite FROM r WHERE n <= 3 GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    c = cells(t).withColumn("kd", F.col("k").cast("double"))
    return rounded(X.first_k_composite(c, ["participant", "condition"], "k", ["v", "kd"], 3), 9)


@query("cell_composite", CELLS + " SELECT participant, condition, round(avg((v + k) / 2), 9) AS composite FROM c GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    c = cells(t).withColumn("kd", F.col("k").cast("double"))
    return rounded(X.first_k_composite(c, ["participant", "condition"], "k", ["v", "kd"]), 9)


def stats_sql(c: str, name: str, digits: int = 6) -> str:
    """The robust statistics of an expression as SQL aggregates."""
    q = lambda p: f"quantile_cont({c}, {p})"
    parts = {"mean": f"avg({c})", "std": f"stddev_pop({c})", "median": q(0.5), "iqr": f"{q(0.75)} - {q(0.25)}", "range": f"max({c}) - min({c})"}
    return ", ".join(f"round({e}, {digits}) AS {name}__{k}" for k, e in parts.items())


POS = f"WITH {SAMPLES}, p AS (SELECT participant, ms // {5 * DAY} AS win, event_id, ms / {HOUR}.0 AS t, value AS x, value * 2 AS y, 100 - value AS z, value * 3 AS turn FROM s)"


def positions(t: Tables) -> DataFrame:
    """Samples as positions in windows of five days, the time in hours."""
    v = F.col("value")
    return samples(t).select("participant", F.floor(F.col("ms") / (5 * DAY)).alias("win"), "event_id", (F.col("ms") / HOUR).alias("t"), v.alias("x"), (v * 2).alias("y"), (100 - v).alias("z"), (v * 3).alias("turn"))


@query(
    "head_motion_features",
    POS + f""", a AS (SELECT *, t - lag(t) OVER w AS d, sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2 + (z - lag(z) OVER w)**2) AS m FROM p WINDOW w AS (PARTITION BY participant, win ORDER BY t)),
    n AS (SELECT participant, win, count(*) AS k, round(sqrt((max(x) - min(x))**2 + (max(y) - min(y))**2 + (max(z) - min(z))**2), 6) AS head_position_range, round(least(1, (max(t) - min(t)) / 120.0), 6) AS head_coverage, least(1, (max(t) - min(t)) / 120.0) >= 0.6 AS head_usable, {stats_sql("turn", "head_angular_speed")} FROM p GROUP BY ALL),
    b AS (SELECT participant, win, t, d, m / d AS v FROM a WHERE d > 1e-4), c AS (SELECT *, (v - lag(v) OVER w) / d AS acc FROM b WINDOW w AS (PARTITION BY participant, win ORDER BY t)), j AS (SELECT *, (acc - lag(acc) OVER w) / d AS jerk FROM c WINDOW w AS (PARTITION BY participant, win ORDER BY t)),
    g AS (SELECT participant, win, {stats_sql("v", "head_speed")}, {stats_sql("jerk", "head_jerk", 3)}, round(avg(CASE WHEN v < 0.01 THEN 1 ELSE 0 END), 6) AS head_stationary_fraction FROM j GROUP BY ALL)
    SELECT participant, win, {", ".join(f"CASE WHEN k >= 3 THEN {c} END AS {c}" for c in ["head_position_range", *[f"head_{x}__{y}" for x in ("angular_speed", "speed", "jerk") for y in ("mean", "std", "median", "iqr", "range")], "head_stationary_fraction"])}, CASE WHEN k >= 3 THEN head_coverage ELSE 0 END AS head_coverage, k >= 3 AND head_usable AS head_usable FROM n LEFT JOIN g USING (participant, win)""",
)
def _(t: Tables) -> DataFrame:
    h = X.head_motion(positions(t), ["participant", "win"], "t", "x", "y", "z", "turn", 120.0)
    return rounded(h.withColumns({c: F.round(c, 3) for c in h.columns if c.startswith("head_jerk")}))


@query(
    "gaze_motion_features",
    POS + f""", r AS (SELECT participant, win, t, CASE WHEN value_ok THEN x END AS x, y, z FROM (SELECT *, x <= 100 AS value_ok FROM p)), u AS (SELECT participant, win, t, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(x*x + y*y + z*z) AS n FROM r WHERE x IS NOT NULL)),
    k AS (SELECT *, avg(x) OVER g AS mx, avg(y) OVER g AS my, avg(z) OVER g AS mz, min(x) OVER g AS lx, max(x) OVER g AS hx, min(y) OVER g AS ly, max(y) OVER g AS hy FROM u WINDOW g AS (PARTITION BY participant, win)),
    a AS (SELECT *, t - lag(t) OVER w AS d, degrees(acos(greatest(-1, least(1, x * lag(x) OVER w + y * lag(y) OVER w + z * lag(z) OVER w)))) AS ang, degrees(acos(greatest(-1, least(1, (x * mx + y * my + z * mz) / sqrt(mx*mx + my*my + mz*mz))))) AS away,
      CASE WHEN hx > lx THEN least(7, floor((x - lx) / (hx - lx) * 8)) ELSE 4 END AS bx, CASE WHEN hy > ly THEN least(7, floor((y - ly) / (hy - ly) * 8)) ELSE 4 END AS b2 FROM k WINDOW w AS (PARTITION BY participant, win ORDER BY t)),
    v AS (SELECT *, CASE WHEN d > 1e-4 THEN ang / d END AS v, CASE WHEN d > 1e-4 THEN ang END AS step FROM a),
    f AS (SELECT participant, win, count(*) AS n, min(t) AS t0, max(t) AS t1, {stats_sql("v", "eye_velocity", 4)}, round(avg(CASE WHEN v < 10 THEN 1 WHEN v >= 10 THEN 0 END), 6) AS eye_fixation_fraction, round(avg(CASE WHEN v >= 10 THEN 1 WHEN v < 10 THEN 0 END), 6) AS eye_saccade_fraction, round(sum(step), 3) AS eye_scanpath, round(avg(away), 4) AS eye_dispersion FROM v GROUP BY ALL),
    h AS (SELECT participant, win, bx, b2, count(*) AS c FROM v GROUP BY ALL), e AS (SELECT participant, win, CASE WHEN count(*) > 1 THEN round(-sum(q * log2(q)) / log2(count(*)), 6) END AS eye_spatial_entropy FROM (SELECT *, c / sum(c) OVER (PARTITION BY participant, win) AS q FROM h) GROUP BY ALL),
    o AS (SELECT participant, win, count(*) AS total FROM r GROUP BY ALL)
    SELECT participant, win, {", ".join(f"CASE WHEN n >= 3 THEN {c} END AS {c}" for c in [*[f"eye_velocity__{y}" for y in ("mean", "std", "median", "iqr", "range")], "eye_fixation_fraction", "eye_saccade_fraction", "eye_scanpath", "eye_dispersion", "eye_spatial_entropy"])},
    round(coalesce(n, 0) / total, 6) AS eye_valid_fraction, round(CASE WHEN n >= 3 THEN least(n / total, (t1 - t0) / 120.0) ELSE coalesce(n, 0) / total END, 6) AS eye_coverage, coalesce(n >= 3 AND least(n / total, (t1 - t0) / 120.0) >= 0.6, FALSE) AS eye_usable FROM o LEFT JOIN f USING (participant, win) LEFT JOIN e USING (participant, win)""",
)
def _(t: Tables) -> DataFrame:
    p = positions(t).withColumn("x", F.when(F.col("x") <= 100, F.col("x")))
    g = X.gaze_motion(p, ["participant", "win"], "t", "x", "y", "z", 120.0, 10.0)
    digits = {"eye_scanpath": 3, "eye_dispersion": 4} | {c: 4 for c in g.columns if c.startswith("eye_velocity")}
    return rounded(g.withColumns({c: F.round(c, n) for c, n in digits.items()}))


@query(
    "time_weight_samples",
    f"""WITH {SAMPLES}, a AS (SELECT *, lead(ms) OVER (PARTITION BY participant ORDER BY ms) - ms AS d FROM s), b AS (SELECT *, CASE WHEN d > 0 THEN least(d, {HOUR})::DOUBLE END AS w FROM a), m AS (SELECT participant, quantile_cont(w, 0.5) AS m FROM b GROUP BY 1)
        SELECT participant, round(sum(coalesce(w, m)), 3) AS total FROM b JOIN m USING (participant) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    s = samples(t).withColumn("ms", F.col("ms").cast("double"))
    return X.time_weights(s, ["participant"], "ms", float(HOUR)).groupBy("participant").agg(F.round(F.sum("weight"), 3).alias("total"))


UNIT = """WITH m AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id)), u AS (SELECT event_id, user_id, event_type, (value - lo) / (hi - lo) AS x, (event_id % 97) / 97.0 AS y, 1 + event_id % 3 AS w, ts FROM m WHERE hi > lo)"""


def unit(t: Tables) -> DataFrame:
    m = X.minmax(t.events.withColumn("x", F.col("value")), ["user_id"], ["x"]).filter("x is not null")
    return m.select("event_id", "user_id", "event_type", "x", ((F.col("event_id") % 97) / 97.0).alias("y"), (1 + F.col("event_id") % 3).alias("w"), "ts")


@query("minmax_normalize", UNIT + " SELECT event_id, round(x, 9) AS x FROM u")
def _(t: Tables) -> DataFrame:
    return rounded(unit(t).select("event_id", "x"), 9)


@query(
    "weighted_gaze_summary",
    UNIT + """ SELECT event_type, round(sum(w * x) / sum(w), 6) AS mean, round(sqrt(greatest(0, sum(w * x * x) / sum(w) - (sum(w * x) / sum(w))**2)), 6) AS sd, round(sum(CASE WHEN x < 1/3.0 THEN w ELSE 0 END) / sum(w), 6) AS low_third,
    round(sum(CASE WHEN x >= 1/3.0 AND x < 2/3.0 THEN w ELSE 0 END) / sum(w), 6) AS mid_third, round(sum(CASE WHEN x >= 2/3.0 THEN w ELSE 0 END) / sum(w), 6) AS high_third, CAST(grouping(event_type) AS INTEGER) AS level,
    (SELECT round(-sum(q * log2(q)), 6) FROM (SELECT sum(w) / sum(sum(w)) OVER () AS q FROM u v WHERE v.event_type = u.event_type OR u.event_type IS NULL GROUP BY least(floor(v.x * 8), 7), least(floor(v.y * 8), 7))) AS entropy FROM u GROUP BY ROLLUP (event_type)""",
)
def _(t: Tables) -> DataFrame:
    return rounded(X.weighted_summary(unit(t), ["event_type"], "x", "w", "y"))


@query("heatmap_2d", UNIT + " SELECT event_type, CAST(least(floor(x * 4), 3) AS INTEGER) AS bx, CAST(least(floor(y * 4), 3) AS INTEGER) AS by, sum(w)::BIGINT AS weight FROM u GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return X.heatmap(unit(t), ["event_type"], "x", "y", F.col("w"), 4)


@query(
    "rolling_heatmap_2d",
    UNIT + f""", s AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM u), r AS (SELECT *, unnest(range(ms // {DAY * 5} + 1, (ms + {DAY * 10}) // {DAY * 5} + 1)) * {DAY * 5} AS step FROM s)
    SELECT step, CAST(least(floor(x * 3), 2) AS INTEGER) AS bx, CAST(least(floor(y * 3), 2) AS INTEGER) AS by, sum(w)::BIGINT AS weight FROM r GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    u = unit(t).withColumn("ms", F.unix_millis("ts"))
    return X.rolling_heatmap(u, [], "ms", "x", "y", F.col("w"), 3, DAY * 5, DAY * 10)


PEAKS = "WITH k AS (SELECT l_suppkey, l_orderkey * 1000 + l_linenumber * 137 + l_partkey % 97 AS raw FROM lineitem), p AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY raw) * 700 + raw % 400 AS ms FROM (SELECT DISTINCT l_suppkey, raw FROM k))"


def peaks(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    raw = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 137 + F.col("l_partkey") % 97
    k = t.lineitem.select("l_suppkey", raw.alias("raw")).distinct()
    return k.select("l_suppkey", (F.row_number().over(Window.partitionBy("l_suppkey").orderBy("raw")) * 700 + F.col("raw") % 400).alias("ms"))


@query(
    "rr_interval_features",
    PEAKS + """, r AS (SELECT *, ms - lag(ms) OVER (PARTITION BY l_suppkey ORDER BY ms) AS rr FROM p), g AS (SELECT *, CASE WHEN rr BETWEEN 60000/220.0 AND 60000/35.0 THEN rr END AS good FROM r)
    SELECT l_suppkey, count(*) AS peaks, round(avg(good), 6) AS rr_mean, quantile_cont(good::DOUBLE, 0.5) AS rr_median, round(60000 / avg(good), 6) AS hr_bpm, round(avg(CASE WHEN rr IS NOT NULL THEN CASE WHEN good IS NOT NULL THEN 1 ELSE 0 END END), 6) AS plausible_fraction FROM g GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return rounded(X.rr_features(peaks(t), ["l_suppkey"], "ms"))


@query(
    "hrv_horizon",
    PEAKS + """, f AS (SELECT *, lag(ms) OVER w AS before, min(ms) OVER w AS first, count(*) OVER w AS k FROM p WINDOW w AS (PARTITION BY l_suppkey ORDER BY ms)), r AS (SELECT a.l_suppkey, a.ms, a.first, a.k, b.ms AS peak, b.ms - b.before AS rr FROM f a LEFT JOIN f b ON a.l_suppkey = b.l_suppkey AND b.ms <= a.ms AND b.before >= a.ms - 30000),
    d AS (SELECT *, rr - lag(rr) OVER (PARTITION BY l_suppkey, ms ORDER BY peak) AS df FROM r), g AS (SELECT l_suppkey, ms, first, k, count(rr) AS n_rr, sqrt(avg(df * df)) AS rmssd, stddev_samp(rr) AS sdnn, avg(CASE WHEN df IS NOT NULL THEN CASE WHEN abs(df) > 50 THEN 1 ELSE 0 END END) AS pnn50 FROM d GROUP BY ALL)
    SELECT l_suppkey, ms, CASE WHEN ok THEN round(rmssd, 6) END AS rmssd, CASE WHEN ok THEN round(sdnn, 6) END AS sdnn, CASE WHEN ok THEN round(pnn50, 6) END AS pnn50, n_rr FROM (SELECT *, ms - first >= 24000 AND k >= 3 AND n_rr >= 2 AS ok FROM g)""",
)
def _(t: Tables) -> DataFrame:
    return rounded(X.hrv(peaks(t), ["l_suppkey"], "ms", 30_000))


def spectra(t: Tables) -> DataFrame:
    """Spectra of each user's values by event type, the types standing for channels."""
    s = samples(t).select("participant", "condition", "ms", "value")
    return X.spectrum(s, ["participant", "condition"], "ms", "value", 100.0, 200)


@query("spectral_band_power")
def _(t: Tables) -> DataFrame:
    b = X.band_power(spectra(t), ["participant", "condition"])
    return b.join(X.hemispheric(b.select("participant", "condition", *X.BANDS), ["participant"], "condition", ["click", "error"], ["view", "signup"]).select("participant", "alpha_asymmetry"), "participant")


@query("differential_entropy")
def _(t: Tables) -> DataFrame:
    p = X.band_power(spectra(t), ["participant", "condition"])
    return p.select("participant", "condition", *[X.differential_entropy(F.col(b)).alias(f"de_{b}") for b in X.BANDS])


@query("aperiodic_slope")
def _(t: Tables) -> DataFrame:
    return X.aperiodic_slope(spectra(t), ["participant", "condition"])


@query(
    "hjorth_parameters",
    f"""WITH {SAMPLES}, a AS (SELECT *, value - lag(value) OVER w AS d1 FROM s WINDOW w AS (PARTITION BY participant ORDER BY ms, event_id)), b AS (SELECT *, d1 - lag(d1) OVER w AS d2 FROM a WINDOW w AS (PARTITION BY participant ORDER BY ms, event_id)),
        g AS (SELECT participant, var_pop(value) AS a, var_pop(d1) AS v1, var_pop(d2) AS v2 FROM b GROUP BY 1) SELECT participant, round(a, 4) AS activity, round(sqrt(v1 / a), 6) AS mobility, round(sqrt(v2 / v1) / sqrt(v1 / a), 6) AS complexity FROM g""",
)
def _(t: Tables) -> DataFrame:
    s = samples(t).withColumn("at", F.struct("ms", "event_id"))
    h = X.hjorth(s, ["participant"], "at", "value")
    return h.select("participant", F.round("activity", 4).alias("activity"), F.round("mobility", 6).alias("mobility"), F.round("complexity", 6).alias("complexity"))


@query("mean_pool_embeddings", "SELECT label, CAST(place AS INTEGER) AS place, round(avg(v), 6) AS value FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS place FROM embeddings WHERE embedding[1] > -0.1) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return rounded(X.mean_pool(t.embeddings, ["label"], "embedding", F.get("embedding", F.lit(0)) > -0.1))


@query("pack_sequences", "SELECT label, CAST(count(*) AS INTEGER) AS n, string_agg(CASE WHEN vec_id % 5 <> 0 THEN '1' ELSE '0' END, '' ORDER BY vec_id) AS mask, round(arg_min(embedding, vec_id)[1]::DOUBLE, 6) AS first_value FROM embeddings GROUP BY label")
def _(t: Tables) -> DataFrame:
    e = t.embeddings.withColumn("valid", F.col("vec_id") % 5 != 0)
    p = X.pack_sequences(e, ["label"], "vec_id", "embedding", "valid")
    mask = F.array_join(F.transform("mask", lambda v: v.cast("int").cast("string")), "")
    return p.select("label", F.size("sequence").alias("n"), mask.alias("mask"), F.round(F.get(F.get("sequence", F.lit(0)), F.lit(0)).cast("double"), 6).alias("first_value"))


@query(
    "phase_delta",
    """WITH g AS (SELECT user_id, event_id % 4 AS block, avg(value) FILTER (event_type = 'view') AS before, avg(value) FILTER (event_type = 'click') AS after FROM events GROUP BY ALL), d AS (SELECT *, after - before AS delta FROM g WHERE before IS NOT NULL AND after IS NOT NULL)
       SELECT user_id, block, round(delta, 6) AS delta, round(delta / abs(before), 6) AS relative, round(ln(after / before), 6) AS log_ratio, round((delta - avg(delta) OVER w) / nullif(stddev_pop(delta) OVER w, 0), 6) AS delta_z FROM d WINDOW w AS (PARTITION BY user_id)""",
)
def _(t: Tables) -> DataFrame:
    e = t.events.withColumn("block", F.col("event_id") % 4)
    p = X.phase_delta(e, ["user_id", "block"], "user_id", "event_type", "value", "view", "click")
    return rounded(p.select("user_id", "block", "delta", "relative", "log_ratio", "delta_z"))


@query("eeg_channel_composites", "SELECT l_orderkey, l_linenumber, l_partkey, round((l_discount + l_tax) / 2, 9) AS composite FROM lineitem")
def _(t: Tables) -> DataFrame:
    return rounded(X.channel_composite(t.lineitem, r"^l_(discount|tax)$", "composite").select("l_orderkey", "l_linenumber", "l_partkey", "composite"), 9)
