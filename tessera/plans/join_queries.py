"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.plans.registry import Tables, query

HOUR = 3_600_000
MS = "epoch_us(ts) // 1000"


def samples(t: Tables) -> DataFrame:
    """events as samples: participant, condition, milliseconds, value."""
    return t.events.select("event_id", F.col("user_id").alias("participant"), F.col("event_type").alias("condition"), F.unix_millis("ts").alias("ms"), "value")


def user_day() -> Column:
    """One key for each user and day."""
    return F.concat_ws(":", F.col("user_id").cast("string"), F.floor(F.unix_millis("ts") / (24 * HOUR)).cast("string"))


SAMPLES = "s AS (SELECT event_id, user_id AS participant, event_type AS condition, epoch_us(ts) // 1000 AS ms, value FROM events)"


@query("join_window_labels", "SELECT e.event_id, e.value, u.total FROM events e LEFT JOIN (SELECT user_id, event_type, count(*) AS total FROM events GROUP BY ALL) u USING (user_id, event_type)")
def _(t: Tables) -> DataFrame:
    labels = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("total"), F.max("value").alias("value"))
    return J.join_labels(t.events, labels, ["user_id", "event_type"]).select("event_id", "value", "total")


@query("join_one_to_one", "SELECT c_custkey, c_nationkey, n_name FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT min(c_custkey) FROM customer GROUP BY c_nationkey)) JOIN nation ON c_nationkey = n_nationkey")
def _(t: Tables) -> DataFrame:
    first = t.customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))
    return J.join_one_to_one(first, t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), ["c_nationkey"]).select("c_custkey", "c_nationkey", "n_name")


@query(
    "join_reconcile_outer",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side, x, y
       FROM (SELECT o_custkey AS k, count(*) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS y FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) b ON a.k = b.k""",
)
def _(t: Tables) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    part = lambda rows, c: t.orders.filter(rows).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(c))
    return J.reconcile(part(done, "x"), part(~done, "y"), ["k"]).select("k", "side", "x", "y")


@query(
    "join_samples_to_windows",
    f"""WITH {SAMPLES}, w AS (SELECT participant, condition, min(ms) AS start, min(ms) + 48 * {HOUR} AS "end" FROM s GROUP BY ALL)
        SELECT w.participant, w.condition, count(*) AS n, round(sum(value), 4) AS total FROM w JOIN s ON s.participant = w.participant AND ms >= start AND ms < "end" GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    s = samples(t)
    w = s.groupBy("participant", "condition").agg(F.min("ms").alias("start"), (F.min("ms") + 48 * HOUR).alias("end"))
    j = J.samples_to_windows(s.drop("condition"), w, ["participant"], "ms", "start", "end", 48 * HOUR)
    return j.groupBy("participant", "condition").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


ASOF = """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts AS rts, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT l.event_id, epoch_us(rts) // 1000 AS rms, v FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts {} r.rts"""


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.events.withColumn("us", F.unix_micros("ts"))
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("us").alias("lus"))
    return left, e.filter("event_type = 'click'").groupBy("user_id", F.col("us").alias("rus")).agg(F.max("value").alias("v"))


def _rms() -> list:
    return ["event_id", F.floor(F.col("rus") / 1000).alias("rms"), "v"]


@query("join_asof_backward", ASOF.format(">="))
def _(t: Tables) -> DataFrame:
    return J.asof(*_sides(t), ["user_id"], "lus", "rus", ["v"], bucket=24 * HOUR * 1000).select(*_rms())


@query("join_asof_forward", ASOF.format("<="))
def _(t: Tables) -> DataFrame:
    return J.asof(*_sides(t), ["user_id"], "lus", "rus", ["v"], forward=True, bucket=24 * HOUR * 1000).select(*_rms())


@query(
    "join_nearest_tolerance",
    f"""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts AS rts, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY ALL),
        b AS (SELECT l.*, rts AS brts, v AS bv FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.rts), f AS (SELECT b.*, rts AS frts, v AS fv FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.ts <= r.rts),
        d AS (SELECT *, epoch_us(ts) - epoch_us(brts) AS bl, epoch_us(frts) - epoch_us(ts) AS fl FROM f)
        SELECT event_id, CASE WHEN bl IS NOT NULL AND (fl IS NULL OR bl <= fl) THEN CASE WHEN bl <= {HOUR * 24}000 THEN bv END WHEN fl <= {HOUR * 24}000 THEN fv END AS v FROM d""",
)
def _(t: Tables) -> DataFrame:
    return J.nearest(*_sides(t), ["user_id"], "lus", "rus", ["v"], HOUR * 24 * 1000, bucket=24 * HOUR * 1000).select("event_id", "v")


@query(
    "pair_start_end_by_key",
    f"""WITH {SAMPLES} SELECT participant, ms // {24 * HOUR} AS day, min(ms) FILTER (condition = 'view') AS start, min(ms) FILTER (condition = 'click') AS "end",
        CASE WHEN count(*) FILTER (condition = 'view') > 1 OR count(*) FILTER (condition = 'click') > 1 THEN 'duplicate' WHEN count(*) FILTER (condition = 'view') = 0 OR count(*) FILTER (condition = 'click') = 0 THEN 'incomplete'
        WHEN min(ms) FILTER (condition = 'click') <= min(ms) FILTER (condition = 'view') THEN 'not_positive' END AS problem FROM s GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("condition") == "view", "start").when(F.col("condition") == "click", "end")
    days = samples(t).withColumns({"kind": kind, "day": F.floor(F.col("ms") / (24 * HOUR))})
    return J.pair_by_key(days, ["participant", "day"], "kind", "ms")


@query(
    "pair_start_end_by_order",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS us, CASE event_type WHEN 'view' THEN 1 ELSE -1 END AS step FROM events WHERE event_type IN ('view', 'click')),
       a AS (SELECT *, sum(step) OVER w AS s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, step ROWS UNBOUNDED PRECEDING)),
       b AS (SELECT *, least(0, min(s) OVER w) AS low FROM a WINDOW w AS (PARTITION BY user_id ORDER BY us, step ROWS UNBOUNDED PRECEDING)),
       c AS (SELECT *, step = -1 AND low < coalesce(lag(low) OVER w, 0) AS spare FROM b WINDOW w AS (PARTITION BY user_id ORDER BY us, step)),
       d AS (SELECT *, row_number() OVER (PARTITION BY user_id, step ORDER BY us) AS n FROM c WHERE NOT spare)
       SELECT x.user_id, x.us AS start, y.us AS "end" FROM d x JOIN d y ON x.user_id = y.user_id AND x.n = y.n AND x.step = 1 AND y.step = -1""",
)
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "end")
    e = t.events.select("user_id", F.unix_micros("ts").alias("us"), kind.alias("kind")).filter("kind is not null")
    return J.pair_by_order(e, ["user_id"], "kind", "us")


@query(
    "join_interval_overlap",
    f"""WITH {SAMPLES}, w AS (SELECT DISTINCT participant, ms - ms % {6 * HOUR} AS start, ms - ms % {6 * HOUR} + {6 * HOUR} AS "end" FROM s), o AS (SELECT participant, ms AS start, ms + {HOUR} AS "end" FROM s WHERE condition = 'error')
        SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.participant = w.participant AND w.start < o."end" AND o.start < w."end")""",
)
def _(t: Tables) -> DataFrame:
    s = samples(t)
    w = s.select("participant", (F.col("ms") - F.col("ms") % (6 * HOUR)).alias("start")).distinct().withColumn("end", F.col("start") + 6 * HOUR)
    off = s.filter("condition = 'error'").select("participant", F.col("ms").alias("start"), (F.col("ms") + HOUR).alias("end"))
    return J.overlapping(w, off, ["participant"], 6 * HOUR, "left_anti").select("participant", "start", "end")


@query("join_label_substring", "SELECT p_partkey, p_name, min(word) AS word FROM part JOIN (SELECT unnest(['ring', 'red', 'widget', 'bolt']) AS word) ON contains(p_name, word) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    words = t.spark.range(1).select(F.lit("x").alias("k"), F.explode(F.array(*[F.lit(w) for w in ("ring", "red", "widget", "bolt")])).alias("word"))
    return J.label_by_substring(t.part.select(F.lit("x").alias("k"), "p_partkey", "p_name"), words, "k", "p_name", "word", []).select("p_partkey", "p_name", "word")


@query("join_session_labels", "SELECT s_suppkey, s_name, round(avg(l_quantity), 6) AS l_quantity, count(l_quantity) AS rounds FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    labels = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.upper("s_name").alias("s_name")), "l_suppkey").select(F.col("l_suppkey").alias("s_suppkey"), "s_name", "l_quantity")
    out = J.session_labels(t.supplier.select("s_suppkey", "s_name"), labels, "s_suppkey", "s_name", "l_quantity")
    return out.select("s_suppkey", "s_name", F.round("l_quantity", 6).alias("l_quantity"), F.coalesce("rounds", F.lit(0)).alias("rounds"))


@query(
    "expand_grid_neighbors",
    """WITH g AS (SELECT unnest(range(1, 10)) AS n), p AS (SELECT a.n, b.n AS m, abs((a.n - 1) // 3 - (b.n - 1) // 3) + abs((a.n - 1) % 3 - (b.n - 1) % 3) AS d FROM g a, g b)
       SELECT s_suppkey, CAST(m AS INTEGER) AS neighbour FROM supplier JOIN p ON s_suppkey % 9 + 1 = n AND d <= 1""",
)
def _(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 9 + 1).cast("int").alias("number"))
    return s.join(F.broadcast(J.grid_neighbours(t.spark)), "number").select("s_suppkey", "neighbour")


PER_CELL = "c AS (SELECT user_id, event_type, round(avg(value), 6) AS v FROM events GROUP BY ALL)"


@query("pairs_within_group", f"WITH {PER_CELL} SELECT a.user_id, a.event_type AS left_event_type, b.event_type AS right_event_type, a.v AS left_v, b.v AS right_v FROM c a JOIN c b ON a.user_id = b.user_id AND a.event_type < b.event_type")
def _(t: Tables) -> DataFrame:
    c = t.events.groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("v"))
    return J.pairs(c, ["user_id"], "event_type", ["v"])


@query(
    "expand_folds",
    """WITH f AS (SELECT unnest(range(5)) AS fold), u AS (SELECT DISTINCT user_id FROM events)
       SELECT fold, role, count(*) AS n FROM (SELECT fold, e.user_id, CASE WHEN e.user_id % 5 = fold THEN 'test' WHEN e.user_id % 5 = (fold + 1) % 5 THEN 'validation' ELSE 'train' END AS role FROM events e, f) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    from tessera.operators.resample import modular_folds

    return J.expand_folds(t.events, modular_folds(t.events.select("user_id").distinct(), "user_id", 5), "user_id").groupBy("fold", "role").agg(F.count("*").alias("n"))


@query("select_cohort", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(t: Tables) -> DataFrame:
    members = t.nation.filter("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return J.cohort(t.customer, members, "c_nationkey")[0].select("c_custkey", "c_nationkey")


@query(
    "join_missing_modalities",
    f"""WITH d AS (SELECT user_id || ':' || (epoch_us(ts) // {24 * HOUR}000) AS user_day, event_type FROM events), h AS (SELECT user_day, list_distinct(list(event_type)) AS have FROM d GROUP BY 1)
       SELECT user_day, array_to_string(list_filter(['view', 'click', 'error'], lambda x: NOT list_contains(coalesce(have, []), x)), ',') AS missing FROM h
       WHERE len(list_filter(['view', 'click', 'error'], lambda x: NOT list_contains(coalesce(have, []), x))) > 0""",
)
def _(t: Tables) -> DataFrame:
    d = t.events.select(user_day().alias("user_day"), "event_type")
    m = J.missing_artifacts(d.select("user_day").distinct(), d, "user_day", "event_type", ["view", "click", "error"])
    return m.select("user_day", F.array_join("missing", ",").alias("missing"))


@query("check_artifact_metadata", "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 4 = 0 THEN 'o_custkey' END, CASE WHEN o_orderkey % 6 = 0 THEN 'o_totalprice' END) AS mismatches FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 6 = 0")
def _(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    k = F.col("o_orderkey")
    other = o.select("o_orderkey", F.when(k % 4 == 0, -1).otherwise(F.col("o_custkey")).alias("o_custkey"), F.when(k % 6 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    return J.metadata_mismatch(o, other, "o_orderkey", ["o_custkey", "o_totalprice"]).select("o_orderkey", F.array_join("mismatches", ",").alias("mismatches"))
