"""Queries that replay the events table as a stream, with SQL for the same rows; the controller's has a batch twin."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.registry import Tables, query
from tessera.plans.window_queries import rounded
from tessera.streaming import sessions as S

HOUR = 3_600_000
FILES = 64
TYPES = ["click", "error", "purchase", "signup", "view"]
ROWS = "r AS (SELECT user_id AS session, epoch_us(ts) // 1000 AS ms, event_type AS condition, value, event_id FROM events)"


def folder(t: Tables) -> str:
    return t.spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-streams-")


def source(t: Tables) -> DataFrame:
    """The events table as a file stream of at most FILES files a micro-batch; a path pattern, as a stream's path is else a folder."""
    schema = t.spark.read.parquet(f"{t.folder}/events.parquet").schema
    e = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{t.folder}/events.parque[t]")
    return e.withColumns({c: F.col(c).cast("timestamp") for c, kind in e.dtypes if kind == "timestamp_ntz"})


def rows(e: DataFrame) -> DataFrame:
    return e.select(F.col("user_id").alias("session"), F.unix_millis("ts").alias("ms"), F.col("event_type").alias("condition"), "value", "event_id")


@query("stream_sensor_frames", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS session, CASE WHEN event_id % 5 = 0 THEN 'malformed' WHEN event_type <> 'view' THEN 'unknown_source' END AS reject FROM events")
def _(t: Tables) -> DataFrame:
    good = F.to_json(F.struct(F.col("user_id").alias("session"), F.when(F.col("event_type") == "view", "eye").otherwise("nose").alias("source"), F.unix_millis("ts").alias("ms"), F.col("value").alias("x")))
    raw = source(t).select("event_id", F.when(F.col("event_id") % 5 == 0, "{not json").otherwise(good).alias("value"))
    return S.run_to_table(S.decode_frames(raw, keep=["event_id"]), folder(t)).select("event_id", "session", "reject")


# Closed windows by gaps and islands: stretches of one condition, their origins, and as many cycles as the next row allows.
WINDOWS = f"""WITH {ROWS}, f AS (SELECT *, CASE WHEN condition = lag(condition) OVER w THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY session ORDER BY ms, condition, value)),
i AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ms, condition, value ROWS UNBOUNDED PRECEDING) AS seg FROM f),
g AS (SELECT session, seg, any_value(condition) AS condition, min(ms) AS origin, max(ms) AS final FROM i GROUP BY ALL), n AS (SELECT *, lead(origin) OVER (PARTITION BY session ORDER BY seg) AS next FROM g),
k AS (SELECT *, (coalesce(next, final) - origin) // {HOUR} AS closed FROM n), c AS (SELECT *, unnest(range(closed)) AS cycle FROM k),
w AS (SELECT c.session, c.seg, c.condition, cycle, origin + cycle * {HOUR} AS start, origin + (cycle + 1) * {HOUR} AS stop FROM c),
m AS (SELECT w.*, count(*) FILTER (i.ms >= start) AS n, avg(value) FILTER (i.ms >= start) AS mean, max(ms) AS seen FROM w JOIN i ON i.session = w.session AND i.seg = w.seg AND i.ms < stop GROUP BY ALL),
v AS (SELECT a.session, a.seg, count(*) AS visits FROM g a JOIN g b ON a.session = b.session AND b.seg BETWEEN a.seg - 15 AND a.seg AND a.condition = b.condition GROUP BY ALL),
o AS (SELECT m.*, visits, cycle + 1 AS dwell, row_number() OVER (PARTITION BY m.session ORDER BY m.seg, cycle) AS command FROM m JOIN v USING (session, seg))"""


def windows(t: Tables) -> DataFrame:
    return S.stream(rows(source(t)), S.Windows(HOUR, 2 * HOUR), folder(t))


@query("stream_condition_windows", WINDOWS + " SELECT session, cycle, start, stop, condition FROM o")
def _(t: Tables) -> DataFrame:
    return windows(t).filter("kind = 'window'").select("session", "cycle", "start", "stop", "condition")


@query("stream_window_features", WINDOWS + " SELECT session, start, n, round(mean, 6) AS mean FROM o")
def _(t: Tables) -> DataFrame:
    return rounded(windows(t).filter("kind = 'window'").select("session", "start", "n", "mean"))


@query("stream_commands", WINDOWS + f" SELECT session, command, start, stop + {S.EXPIRY_MS} AS expires FROM o")
def _(t: Tables) -> DataFrame:
    return windows(t).filter("kind = 'window'").select("session", "command", "start", "expires")


@query("stream_buffer_evict", WINDOWS + f" SELECT i.session, i.condition, origin + closed * {HOUR} AS start, next AS stop, count(*) AS n FROM i JOIN k USING (session, seg) WHERE next IS NOT NULL AND ms >= origin + closed * {HOUR} GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return windows(t).filter("kind = 'evict'").select("session", "condition", "start", "stop", "n")


@query("replay_chronological", WINDOWS + f" SELECT session, cycle, start, stop, condition, n, round(mean, 6) AS mean, stop - seen > {2 * HOUR} AS silent, dwell, visits, command FROM o")
def _(t: Tables) -> DataFrame:
    r = S.replay(rows(t.events), S.Windows(HOUR, 2 * HOUR)).filter("kind = 'window'")
    return rounded(r.select("session", "cycle", "start", "stop", "condition", "n", "mean", "silent", "dwell", "visits", "command"))


@query("stream_out_of_order_drop", f"WITH {ROWS}, a AS (SELECT *, event_id + CASE condition WHEN 'view' THEN 400 ELSE 0 END AS arrival FROM r), b AS (SELECT *, max(ms) OVER (PARTITION BY session ORDER BY arrival, ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM a) SELECT session, ms AS start, condition, value FROM b WHERE ms < last")
def _(t: Tables) -> DataFrame:
    """Views arrive four hundred events late, so rows that came before them in time are there already."""
    late = rows(source(t)).withColumn("arrival", F.col("event_id") + F.when(F.col("condition") == "view", 400).otherwise(0))
    out = S.stream(late, S.Windows(HOUR, 2 * HOUR, ("arrival", "ms")), folder(t))
    return out.filter("kind = 'late'").select("session", "start", "condition", F.col("mean").alias("value"))


DAY = 24 * HOUR


@query("stream_source_timeout", f"""WITH {ROWS}, n AS (SELECT *, lead(ms) OVER (PARTITION BY session, condition ORDER BY ms) AS next FROM r), m AS (SELECT max(ms) - 60000 AS watermark FROM r)
SELECT session, condition AS source, 'silent' AS kind, ms + {2 * DAY} AS at FROM n, m WHERE next - ms > {2 * DAY} OR next IS NULL AND ms + {2 * DAY} < watermark UNION ALL SELECT session, condition, 'back', next FROM n WHERE next - ms > {2 * DAY}""")
def _(t: Tables) -> DataFrame:
    e = source(t).select(F.col("user_id").alias("session"), F.col("event_type").alias("source"), "ts")
    return S.silences_to_table(e, 2 * DAY, 60_000, folder(t)).drop("batch")


@query("stream_session_begin", f"""WITH {ROWS}, a AS (SELECT *, count(*) FILTER (condition = 'error') OVER (PARTITION BY session ORDER BY ms, condition ROWS UNBOUNDED PRECEDING) AS part FROM r),
b AS (SELECT *, first_value(condition) OVER w AS active, row_number() OVER w AS n FROM a WHERE condition <> 'error' WINDOW w AS (PARTITION BY session, part ORDER BY ms, condition))
SELECT session, ms AS at, CASE WHEN n = 1 THEN 'begin' ELSE 'refused' END AS kind, condition AS name, active FROM b WHERE n = 1 OR condition <> active""")
def _(t: Tables) -> DataFrame:
    """Users as devices, types as session names, errors as stops."""
    e = source(t).select(F.col("user_id").alias("session"), F.unix_millis("ts").alias("ms"), F.col("event_type").alias("name"), (F.col("event_type") == "error").alias("stop"))
    return S.stream(e, S.Sessions(), folder(t)).filter("kind <> 'end'").select("session", "at", "kind", "name", "active")


def coverage(e: DataFrame) -> DataFrame:
    """Each event as a window: coverage of four modalities from its value; a signup has the headset off."""
    c = F.array(*[F.least(F.lit(1.0), F.col("value") / n) for n in (40, 60, 30, 25)])
    return e.select(F.col("user_id").alias("session"), F.unix_millis("ts").alias("ms"), c.alias("coverage"), (F.col("event_type") != "signup").alias("worn"))


@query("stream_low_coverage_failsafe", f"""WITH {ROWS}, a AS (SELECT *, (value >= 20)::INT + (value >= 30)::INT + (value >= 15)::INT + (value >= 12.5)::INT AS n_active FROM r), b AS (SELECT *, condition <> 'signup' AND n_active < 2 AS low FROM a),
c AS (SELECT *, count(*) FILTER (NOT low) OVER (PARTITION BY session ORDER BY ms) AS part FROM b), d AS (SELECT *, CASE WHEN low THEN row_number() OVER (PARTITION BY session, part, low ORDER BY ms) ELSE 0 END AS run FROM c),
e AS (SELECT *, coalesce(max(run) OVER (PARTITION BY session ORDER BY ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 3, FALSE) AS locked FROM d)
SELECT session, ms AS at, n_active, CASE WHEN locked OR run >= 3 THEN 'Failsafe' WHEN condition = 'signup' OR low THEN 'Degraded' ELSE 'Running' END AS state, CASE WHEN locked THEN 'failsafe_locked' WHEN run >= 3 THEN 'low_modality_coverage_timeout' WHEN condition = 'signup' THEN 'headset_not_worn' WHEN low THEN 'insufficient_active_modalities' ELSE '' END AS reason FROM e""")
def _(t: Tables) -> DataFrame:
    return S.stream(coverage(source(t)), S.Coverage(), folder(t)).select("session", "at", "n_active", "state", "reason")


@query("stream_condition_memory", f"""WITH {ROWS}, a AS (SELECT *, 1 + CAST(floor(value) AS BIGINT) % 9 AS target, condition IN ('click', 'purchase', 'view') AS applied, row_number() OVER (PARTITION BY session ORDER BY ms) AS i FROM r),
b AS (SELECT *, coalesce(last_value(CASE WHEN applied THEN target END IGNORE NULLS) OVER (PARTITION BY session ORDER BY i), 5) AS now FROM a), c AS (SELECT *, sum(CASE WHEN now = p THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY i) AS part FROM (SELECT *, lag(now, 1, 5) OVER (PARTITION BY session ORDER BY i) AS p FROM b)),
d AS (SELECT *, row_number() OVER (PARTITION BY session, part ORDER BY i) AS dwell, list(now) OVER (PARTITION BY session ORDER BY i ROWS 15 PRECEDING) AS past, {", ".join(f"i - max(CASE WHEN applied AND target = {c} THEN i END) OVER (PARTITION BY session ORDER BY i) AS c{c}" for c in S.HIGH_LOAD)} FROM c)
SELECT session, ms AS at, now AS condition, dwell, len(list_filter(past, lambda x: x = now)) AS visits, concat_ws(',', {", ".join(f"CASE WHEN c{c} < {S.COOLDOWN} THEN '{c}:' || ({S.COOLDOWN} - c{c}) END" for c in S.HIGH_LOAD)}) AS cooling FROM d""")
def _(t: Tables) -> DataFrame:
    e = source(t).select(F.col("user_id").alias("session"), F.unix_millis("ts").alias("ms"), (1 + F.floor("value") % 9).alias("target"), F.col("event_type").isin("click", "purchase", "view").alias("applied"))
    return S.stream(e, S.Memory(), folder(t)).drop("batch")


def rating(condition: Column) -> Column:
    """What a user would say of a condition, by a rule."""
    at = lambda a, b: ((F.col("user_id") * a + condition * b) % 10) / 10.0
    direction = F.when(at(3, 7) > 0.7, "too_strong").when(at(3, 7) > 0.1, "balanced")
    return F.struct(at(7, 3).alias("discomfort"), at(1, 9).alias("relaxation"), at(9, 1).alias("pleasantness"), at(3, 1).alias("monotony"), (at(7, 3) < 0.4).alias("fits"), direction.alias("direction"))


def persons(e: DataFrame) -> DataFrame:
    """(session, own): each user's baseline and variability, from all of its events."""
    tense = F.least(F.lit(1.0), F.col("value") / 150)
    own = F.struct(F.round(1 - F.avg(tense), 9).alias("baseline"), F.round(F.stddev_pop(tense) / 4, 9).alias("eps_relaxation"), F.round(F.stddev_pop(tense) / 3, 9).alias("eps_discomfort"))
    return e.groupBy(F.col("user_id").alias("session")).agg(own.alias("own"))


def predictions(e: DataFrame, own: DataFrame) -> DataFrame:
    """Each event as a window of two predictions, with its user's own numbers; the shown condition changes every three days."""
    condition = (1 + (F.floor(F.unix_millis("ts") / (3 * DAY)) + F.col("user_id")) % 9).cast("long")
    tense = F.least(F.lit(1.0), F.col("value") / 150)
    return e.select(F.col("user_id").alias("session"), F.unix_millis("ts").alias("ms"), condition.alias("condition"), (1 - tense).alias("relaxation"), tense.alias("discomfort"), (F.col("value") > 5).alias("valid"), rating(condition).alias("rating")).join(own, "session", "left")


@query("stream_shadow_controller")
def _(t: Tables) -> DataFrame:
    return S.stream(predictions(source(t), persons(t.events)), S.Controller(DAY), folder(t)).drop("batch")


@query("shadow_controller_replay")
def _(t: Tables) -> DataFrame:
    return S.replay(predictions(t.events, persons(t.events)), S.Controller(DAY))


AGES = ", ".join(f"max(epoch_us(ts) // 1000) - max(epoch_us(ts) // 1000) FILTER (event_type = '{k}') AS age_{k}" for k in TYPES)


@query("stream_status_snapshot", f"SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n_rows, {AGES} FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    e = source(t).withColumn("at", F.struct("ts", "event_id"))
    s = S.latest(e, "user_id", "at", ["event_type"], "event_type", TYPES, F.unix_millis("ts"))
    out = S.run_to_table(s, folder(t), "update")
    names = [c for c in out.columns if c not in ("user_id", "batch")]
    return out.groupBy("user_id").agg(*[F.max_by(c, "batch").alias(c) for c in names])


@query("stream_signal_snapshot", """WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts - INTERVAL 12 HOUR) + INTERVAL 12 HOUR]) AS start, value, ts FROM events), p AS (SELECT *, (epoch_us(ts) - epoch_us(start)) * 4 // 86400000000 AS part FROM w)
SELECT event_type, epoch_us(start) // 1000 AS start, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS greatest, round(sqrt(avg(value * value)), 6) AS rms, round(max(value) - min(value), 6) AS peak_to_peak,
concat_ws(',', """ + ", ".join(f"coalesce(round(arg_max(value, ts) FILTER (part = {i}) * 100)::BIGINT::VARCHAR, '-')" for i in range(4)) + """) AS series FROM p GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    w = S.watermarked(source(t), "ts", ["event_type"], "value", "2 days", "1 day", "12 hours", 4)
    out = _last(S.run_to_table(w, folder(t), "complete"))
    series = F.array_join(F.transform("series", lambda x: F.coalesce(F.round(x * 100).cast("bigint").cast("string"), F.lit("-"))), ",")
    return rounded(out.select("event_type", F.unix_millis("w.start").alias("start"), "n", "mean", "std", "least", "greatest", "rms", "peak_to_peak", series.alias("series")))


def _last(out: DataFrame) -> DataFrame:
    """Of a complete-mode result the last batch's rows."""
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(F.broadcast(last), "batch").drop("batch")


@query("stream_watermarked_windows", "SELECT user_id, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000 AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    w = S.watermarked(source(t), "ts", ["user_id"], "value", "2 days", "1 day")
    out = S.run_to_table(w, folder(t), "complete")
    return rounded(_last(out).select("user_id", F.unix_millis("w.start").alias("start"), "n", "mean"))
