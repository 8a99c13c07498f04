"""Queries of sources, decisions and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import decide as C
from tessera.plans.registry import Tables, query
from tessera.plans.summary_queries import CELL, cell
from tessera.plans.window_queries import rounded
from tessera.sources import tables as R


@query("scan_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t: Tables) -> DataFrame:
    return R.read_table(t.spark, f"{t.folder}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")


def _shared(t: Tables, name: str) -> str:
    """A fresh folder that the executors share, for a round trip."""
    import tempfile
    import uuid

    base = t.spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-tables-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


@query("write_table", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _(t: Tables) -> DataFrame:
    path, df = _shared(t, "part.csv"), t.part.select("p_partkey", "p_name", "p_retailprice")
    R.write_table(df, path, "csv")
    return t.spark.read.schema(df.schema).csv(path, header=True)


@query("scan_dialect_csv", "SELECT p_partkey::VARCHAR AS \"Part Key\", p_name AS \"Name\", p_retailprice AS \"Retail Price\" FROM part")
def _(t: Tables) -> DataFrame:
    """The part table, half of it by brand as ; files with decimal commas and half as , files after a "sep=" line, the
    headers quoted and with spaces; Spark writes the parts in parallel, each with its header."""
    path = _shared(t, "dialect")
    price = F.col("p_retailprice").cast("string")
    rows = t.part.select(F.col("p_partkey").cast("string").alias("Part Key"), F.col("p_name").alias("Name"), price.alias("Retail Price"), (F.col("p_brand") < "Brand#2").alias("comma"))
    semi = rows.filter("not comma").drop("comma").withColumn("Retail Price", F.translate("Retail Price", ".", ","))
    semi.write.option("header", True).option("sep", ";").csv(f"{path}/semicolon")
    comma = rows.filter("comma").drop("comma").write.option("header", True).option("quoteAll", True)
    comma.csv(f"{path}/comma")
    return R.read_dialect_csv(t.spark, [f"{path}/semicolon", f"{path}/comma"], ["Retail Price"])


@query("scan_jsonl", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 50 = 0 AS bad FROM (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN props END AS props FROM events)")
def _(t: Tables) -> DataFrame:
    path = _shared(t, "jsonl")
    t.events.select(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.when(F.col("event_id") % 50 == 0, F.lit(', "k": }')).otherwise(F.concat(F.lit(', "k": '), F.get_json_object("props", "$.k"), F.lit("}")))).alias("value")).write.text(path)
    j = R.read_jsonl(t.spark, path, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("k", T.LongType())]))
    bad = F.col("_corrupt_record").isNotNull()
    known = F.coalesce("event_id", F.regexp_extract("_corrupt_record", r'"event_id": (\d+)', 1).try_cast("bigint"))
    return j.select(known.alias("event_id"), F.when(~bad, F.col("k")).alias("k"), bad.alias("bad"))


@query("write_messages", "SELECT event_id, event_type FROM events")
def _(t: Tables) -> DataFrame:
    path, df = _shared(t, "messages"), t.events.select("event_id", "event_type")
    R.write_messages(df, path)
    return t.spark.read.schema(df.schema).json(f"{path}/jsonl").intersectAll(t.spark.read.parquet(f"{path}/parquet"))


@query("decode_marker_event", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'raw ' || event_type ELSE event_type END AS event_type, CASE WHEN event_id % 3 <> 0 THEN 'C1' END AS condition, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS marker_index FROM events")
def _(t: Tables) -> DataFrame:
    payload = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("raw "), "event_type")).otherwise(F.to_json(F.struct("event_type", F.lit("C1").alias("condition"))))
    return R.decode_markers(t.events.withColumn("payload", payload), "user_id", "event_id", "payload").select("event_id", "event_type", "condition", "marker_index")


@query("session_index", """WITH f AS (SELECT user_id AS participant, event_type AS session, 'f' || event_id || CASE WHEN event_id % 3 = 0 THEN '_backup' ELSE '' END AS path, event_id % 3 = 0 AS backup, CAST(value * 100 AS BIGINT) AS size FROM events),
g AS (SELECT participant, session, sum(size)::BIGINT AS ss, arg_max(path, (NOT backup, size, path)) AS path FROM f GROUP BY ALL) SELECT participant, arg_max(session, (ss, session)) AS session, max(ss) AS session_size, arg_max(path, (ss, session)) AS path FROM g GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    path = F.concat(F.lit("f"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "_backup").otherwise(""))
    f = t.events.select(F.col("user_id").alias("participant"), F.col("event_type").alias("session"), path.alias("path"), F.round(F.col("value") * 100).cast("bigint").alias("size"))
    return R.session_index(f).select("participant", "session", "session_size", "path")


@query("checksum_manifest")
def _(t: Tables) -> DataFrame:
    return R.checksums(t.spark, f"{t.folder}/orders.parquet")


@query("table_content_hash")
def _(t: Tables) -> DataFrame:
    return R.content_hash(t.orders)


@query("select_model_variant", """WITH c AS (SELECT event_id, event_id % 4 <> 0 AS eeg, event_id % 3 <> 0 AS ecg, event_id % 5 <> 0 AS head, event_id % 7 <> 0 AS eye FROM events)
SELECT event_id, CASE WHEN eeg THEN 'full' WHEN ecg AND head AND eye THEN 'no_eeg' WHEN head OR eye THEN 'behavior_only' END AS variant, concat_ws(',', CASE WHEN NOT eeg THEN 'eeg' END, CASE WHEN NOT ecg THEN 'ecg' END, CASE WHEN NOT head THEN 'head' END, CASE WHEN NOT eye THEN 'eye' END) AS missing FROM c""")
def _(t: Tables) -> DataFrame:
    c = {m: (F.col("event_id") % n != 0).cast("double") for m, n in (("eeg", 4), ("ecg", 3), ("head", 5), ("eye", 7))}
    v, missing = C.variant(c)
    return t.events.select("event_id", v.alias("variant"), F.array_join(missing, ",").alias("missing"))


@query("recommend_condition", f"""WITH {CELL}, s AS (SELECT user_id, avg(value) / 100 AS r, stddev_pop(value) / 100 AS w, user_id % 6 <> 0 AS dep FROM events GROUP BY 1),
k AS (SELECT c.user_id, event_type, least(1.0, v / 80) AS cr, least(1.0, 1 / (1 + n)) AS rh, least(1.0, m / 400) AS cd, 0.05 AS dh FROM c), o AS (SELECT k.*, greatest(0, cr - rh) - r AS cons, cr - r AS gain, least(1.0, cd + dh) AS hd, r, dep FROM k JOIN s USING (user_id)),
b AS (SELECT user_id, any_value(dep) AS dep, max((cons, gain, event_type)) FILTER (2 * greatest(rh, dh) <= 0.5 AND hd < 0.6) AS b, count(*) FILTER (2 * greatest(rh, dh) > 0.5) AS u FROM o GROUP BY 1)
SELECT user_id, CASE WHEN dep AND b IS NOT NULL AND b[3] <> 'view' AND b[1] >= 0.02 THEN 'recommend' ELSE 'hold' END AS action, CASE WHEN dep AND b IS NOT NULL AND b[3] <> 'view' AND b[1] >= 0.02 THEN b[3] END AS candidate,
CASE WHEN NOT dep THEN 'state_model_not_better_than_baselines' WHEN b IS NULL THEN CASE WHEN u > 0 THEN 'candidate_uncertainty_too_high' ELSE 'no_safe_candidate' END WHEN b[3] = 'view' OR b[1] < 0.02 THEN 'no_positive_conservative_gain' ELSE 'highest_safe_conservative_relaxation_gain' END AS reasons FROM b""")
def _(t: Tables) -> DataFrame:
    s = t.events.groupBy("user_id").agg((F.avg("value") / 100).alias("relaxation"))
    s = s.select("user_id", F.lit("view").alias("condition"), "relaxation", F.col("relaxation").alias("relaxation_high"), F.lit(0.1).alias("width"), F.lit(1.0).alias("coverage"), (F.col("user_id") % 6 != 0).alias("deployable"))
    c = cell(t).select("user_id", F.col("event_type").alias("candidate"), F.least(F.lit(1.0), F.col("v") / 80).alias("relaxation"), F.least(F.lit(1.0), 1 / (1 + F.col("n"))).alias("relaxation_half"), F.least(F.lit(1.0), F.col("m") / 400).alias("discomfort"), F.lit(0.05).alias("discomfort_half"))
    r = C.recommend(s, "user_id", c, 0.5, 0.6, 0.02, 0.5)
    return r.select("user_id", "action", "candidate", F.array_join("reasons", ",").alias("reasons"))


@query("candidate_utility", f"WITH {CELL} SELECT user_id, event_type, round(0.85 * v / 100 - 0.15 * m / 500 - n * 0.01 - CASE WHEN event_type = 'error' THEN 0.05 ELSE 0 END, 11) AS utility FROM c")
def _(t: Tables) -> DataFrame:
    u = C.utility(F.col("v") / 100, F.col("m") / 500, F.col("n"), 0.01, F.col("event_type") == "error", 0.05)
    return rounded(cell(t).select("user_id", "event_type", u.alias("utility")), 11)


@query("reactive_candidate_estimate", """WITH e AS (SELECT event_id, least(1.0, value / 100) AS r, 1 - least(1.0, value / 120) AS d, (event_id % 9) / 8.0 - 0.5 AS l FROM events), m AS (SELECT *, CASE WHEN d >= 0.5 OR r <= 0.35 THEN 'stress_recovery' WHEN r >= 0.55 AND d <= 0.4 THEN 'calm_exploration' WHEN r >= 0.45 AND d <= 0.5 THEN 'stable_probe' ELSE 'conservative_stay' END AS mode FROM e),
w AS (SELECT *, CASE mode WHEN 'stress_recovery' THEN -l WHEN 'calm_exploration' THEN l WHEN 'stable_probe' THEN CASE WHEN l >= 0 THEN 0.35 * l ELSE 0.1 * l END ELSE -abs(l) END AS w FROM m) SELECT event_id, mode, round(greatest(0, least(1, r + 0.1 * w)), 9) AS relaxation, round(greatest(0, least(1, d - 0.08 * w)), 9) AS discomfort FROM w""")
def _(t: Tables) -> DataFrame:
    mode, r, d = C.reactive_estimate(F.least(F.lit(1.0), F.col("value") / 100), 1 - F.least(F.lit(1.0), F.col("value") / 120), (F.col("event_id") % 9) / 8.0 - 0.5)
    return rounded(t.events.select("event_id", mode.alias("mode"), r.alias("relaxation"), d.alias("discomfort")), 9)


CONTROL = """WITH e AS (SELECT event_id, 1 + event_id % 9 AS c, least(1.0, value / 140) AS d, 1 - least(1.0, value / 110) AS r, event_id % 4 AS dwell, (event_id * 31 % 100) / 100.0 AS ar, (event_id * 57 % 100) / 100.0 AS bo, (event_id * 7919 % 1000) / 1000.0 AS u, (event_id * 104729 % 1000) / 1000.0 AS k FROM events),
g AS (SELECT unnest(range(1, 10)) AS n), o AS (SELECT e.*, n, greatest(0, least(1, r + ((n * 7 + event_id) % 11 - 5) / 60.0)) AS cr, greatest(0, least(1, d + ((n * 5 + event_id) % 7 - 3) / 60.0)) AS cd, (n + event_id) % 3 AS cool, (n * event_id) % 4 AS recent FROM e, g WHERE n <> c),
s AS (SELECT *, 0.85 * cr - 0.15 * cd AS plain, 0.85 * cr - 0.15 * cd - recent * 0.12 - CASE WHEN n = 9 THEN 0.1 ELSE 0 END AS score, cool <= 0 AS free, n IN (1, 2, 4, 5) AS safe, abs((n - 1) // 3 - (c - 1) // 3) + abs((n - 1) % 3 - (c - 1) % 3) = 1 AS near FROM o),
f AS (SELECT event_id, n, k, 0.08 + exp(greatest(-60, (score - max(score) OVER (PARTITION BY event_id)) / 0.18)) AS w FROM s WHERE free), fp AS (SELECT event_id, min(n) FILTER (cum >= k * total) AS pick FROM (SELECT *, sum(w) OVER (PARTITION BY event_id ORDER BY n) AS cum, sum(w) OVER (PARTITION BY event_id) AS total FROM f) GROUP BY 1),
h AS (SELECT event_id, n, k, 0.08 + exp(greatest(-60, (score - max(score) OVER (PARTITION BY event_id)) / 0.18)) AS w FROM s WHERE free AND safe), hp AS (SELECT event_id, min(n) FILTER (cum >= k * total) AS pick FROM (SELECT *, sum(w) OVER (PARTITION BY event_id ORDER BY n) AS cum, sum(w) OVER (PARTITION BY event_id) AS total FROM h) GROUP BY 1),
b AS (SELECT event_id, max(plain) AS top, arg_max(n, (plain, n)) AS best, ['stable_probe', 'calm_exploration', 'stress_recovery', 'conservative_stay'][1 + (arg_max(n, (plain, n)) + event_id) % 4] AS mode FROM s WHERE near GROUP BY 1),
z AS (SELECT e.*, fp.pick AS fpick, hp.pick AS hpick, top - (0.85 * r - 0.15 * d) AS gain, best, mode, r >= 0.55 AND d <= 0.4 AS calm, dwell >= 2 AS forced, (r >= 0.55 AND d <= 0.4) OR (r >= 0.45 AND d <= 0.5) AS steady, CASE WHEN dwell >= 2 THEN 1.0 ELSE greatest(0, least(1, [0.10, 0.45, 0.85][dwell + 1] + 0.25 * bo + 0.2 * ar + 0.3 * greatest(0, least(1, (d - 0.25) / 0.25)) - 0.15 * CASE WHEN r >= 0.55 AND d <= 0.4 THEN least(1 - greatest(0, least(1, (ar - 0.2) / 0.4)), 1 - greatest(0, least(1, (bo - 0.2) / 0.45))) ELSE 0 END)) END AS p FROM e LEFT JOIN fp USING (event_id) LEFT JOIN hp USING (event_id) LEFT JOIN b USING (event_id))"""
SAFETY = "CASE WHEN d >= 0.95 THEN 'extreme_predicted_discomfort' WHEN d >= 0.5 AND c IN (1, 2, 4, 5) AND dwell < 1 THEN 'safety_min_condition_dwell' WHEN d >= 0.5 AND hpick IS NOT NULL THEN 'safety_recovery_stochastic' WHEN d >= 0.5 THEN 'safety_no_available_condition'"
STEP = "CASE mode WHEN 'stress_recovery' THEN 'stress_recovery_step' WHEN 'conservative_stay' THEN 'adaptive_utility_step' ELSE mode END"
STEPS = "('adaptive_utility_step', 'stable_probe', 'calm_exploration', 'stress_recovery_step', 'calm_dwell_exploration')"
DECIDED = f"""SELECT event_id, reason, CASE WHEN reason = 'extreme_predicted_discomfort' THEN 'failsafe' WHEN reason = 'safety_recovery_stochastic' OR reason LIKE 'stochastic%' OR reason IN {STEPS} THEN 'apply' ELSE 'hold' END AS action,
CAST(CASE WHEN reason = 'safety_recovery_stochastic' THEN hpick WHEN reason LIKE 'stochastic%' THEN fpick WHEN reason IN {STEPS} THEN best ELSE c END AS INTEGER) AS target, CASE WHEN reason IN {STEPS} OR reason LIKE '%no_better_neighbor' THEN round(greatest(0, gain), 9) END AS delta FROM t"""


def control(t: Tables, mode: str) -> DataFrame:
    i, unit = F.col("event_id"), lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    state = t.events.select(
        "event_id", (1 + i % 9).cast("int").alias("condition"), (1 - F.least(F.lit(1.0), F.col("value") / 110)).alias("relaxation"), F.least(F.lit(1.0), F.col("value") / 140).alias("discomfort"), (i % 4).alias("dwell"),
        (i * 31 % 100 / 100.0).alias("arousal"), (i * 57 % 100 / 100.0).alias("boredom"), (i * 7919 % 1000 / 1000.0).alias("switch_draw"), (i * 104729 % 1000 / 1000.0).alias("pick_draw"),
    )
    n = F.col("candidate")
    c = state.select("event_id", "relaxation", "discomfort", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("candidate"))
    c = c.select("event_id", "candidate", unit(F.col("relaxation") + ((n * 7 + i) % 11 - 5) / 60.0).alias("relaxation"), unit(F.col("discomfort") + ((n * 5 + i) % 7 - 3) / 60.0).alias("discomfort"), ((n + i) % 3).alias("cooldown"), ((n * i) % 4).alias("recent"), *([] if mode == "probability" else [F.get(F.array(*[F.lit(m) for m in ("stable_probe", "calm_exploration", "stress_recovery", "conservative_stay")]), ((n + i) % 4).cast("int")).alias("mode")]))
    return rounded(C.control_step(state, "event_id", c, 1, mode), 9)


@query("control_decision", CONTROL + """,
y AS (SELECT *, forced OR steady OR ar >= 0.35 OR bo >= 0.35 AS ready FROM z), q AS (SELECT *, ready AND (forced OR u <= p) AS go FROM y),
t AS (SELECT event_id, c, fpick, hpick, best, gain, CASE WHEN d >= 0.95 THEN 'extreme_predicted_discomfort' WHEN d >= 0.5 AND c IN (1, 2, 4, 5) AND dwell < 1 THEN 'safety_min_condition_dwell' WHEN d >= 0.5 AND hpick IS NOT NULL THEN 'safety_recovery_stochastic' WHEN d >= 0.5 THEN 'safety_no_available_condition' WHEN go AND fpick IS NOT NULL THEN CASE WHEN forced THEN 'sensor_probability_force_exploration' ELSE 'sensor_probability_exploration' END
WHEN go THEN 'sensor_probability_no_available_condition' WHEN ready THEN 'sensor_probability_hold' WHEN gain >= 0.002 THEN 'adaptive_utility_step' ELSE 'stable_no_better_neighbor' END AS reason FROM q)
SELECT event_id, reason, CASE WHEN reason = 'extreme_predicted_discomfort' THEN 'failsafe' WHEN reason IN ('safety_recovery_stochastic', 'sensor_probability_force_exploration', 'sensor_probability_exploration', 'adaptive_utility_step') THEN 'apply' ELSE 'hold' END AS action,
CAST(CASE reason WHEN 'safety_recovery_stochastic' THEN hpick WHEN 'sensor_probability_force_exploration' THEN fpick WHEN 'sensor_probability_exploration' THEN fpick WHEN 'adaptive_utility_step' THEN best ELSE c END AS INTEGER) AS target, CASE WHEN reason IN ('adaptive_utility_step', 'stable_no_better_neighbor') THEN round(greatest(0, gain), 9) END AS delta FROM t""")
def _(t: Tables) -> DataFrame:
    return control(t, "probability")


@query("control_decision_dwell", CONTROL + f""", t AS (SELECT event_id, c, fpick, hpick, best, gain, {SAFETY} WHEN (dwell >= 2 AND d < 0.5 OR calm AND dwell >= 3) AND fpick IS NOT NULL THEN CASE WHEN dwell >= 2 AND d < 0.5 THEN 'stochastic_max_dwell_exploration' ELSE 'stochastic_calm_exploration' END
WHEN calm THEN 'calm_wait_for_stochastic_exploration' WHEN steady THEN 'steady_wait_for_stochastic_exploration' WHEN gain >= 0.002 THEN {STEP} ELSE 'stable_no_better_neighbor' END AS reason FROM z) {DECIDED}""")
def _(t: Tables) -> DataFrame:
    """Explores when a condition has been shown long enough."""
    return control(t, "dwell")


@query("control_decision_utility", CONTROL + f""", q AS (SELECT *, CASE WHEN calm AND dwell >= 3 THEN least(0.12, (dwell - 2) * 0.025) ELSE 0 END AS pen FROM z), t AS (SELECT event_id, c, fpick, hpick, best, gain + pen AS gain, {SAFETY} WHEN gain + pen >= 0.002 THEN CASE WHEN pen > 0 AND gain <= 0 THEN 'calm_dwell_exploration' ELSE {STEP} END
WHEN pen > 0 THEN 'dwell_exploration_no_better_neighbor' ELSE 'stable_no_better_neighbor' END AS reason FROM q) {DECIDED}""")
def _(t: Tables) -> DataFrame:
    """Explores by utility alone, a calm condition losing some with every window."""
    return control(t, "utility")


@query("validate_message", "SELECT event_id, concat_ws(',', CASE WHEN event_id % 9 = 0 THEN 'participant_missing' END, CASE WHEN event_id % 4 = 0 THEN 'length' END, CASE WHEN event_id % 5 = 0 THEN 'not_shadow' END, CASE WHEN event_type = 'error' THEN 'action' END) AS violations FROM events")
def _(t: Tables) -> DataFrame:
    i, start = F.col("event_id"), F.unix_millis("ts")
    v = C.message_violations(start, start + F.when(i % 4 == 0, 9_000).otherwise(10_000), i % 5 != 0, F.when(F.col("event_type") == "error", "go").otherwise("hold"), F.when(i % 9 != 0, F.col("user_id")))
    return t.events.select("event_id", F.array_join(v, ",").alias("violations"))


@query("validate_predictions", "SELECT doc_id, CASE WHEN quality = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'truth_differs' WHEN doc_id % 11 = 0 THEN 'not_finite' WHEN doc_id % 13 = 0 THEN 'out_of_range' END AS problem FROM labels WHERE quality = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0")
def _(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    found = t.labels.filter("quality = 1").select("doc_id", F.when(i % 7 == 0, F.col("toxic") + 1).otherwise(F.col("toxic")).alias("toxic"), F.when(i % 11 != 0, F.when(i % 13 == 0, 2.0).otherwise(0.5)).alias("pred"))
    return C.prediction_problems(t.labels, found, ["doc_id"], "toxic", "pred")


@query("validate_prediction_folds", """SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'fold_differs' WHEN doc_id % 10 = 7 THEN 'validation_differs' WHEN doc_id % 1000 < 100 THEN 'seed_differs' END AS problem FROM labels WHERE doc_id % 10 IN (3, 7) OR doc_id % 1000 < 100""")
def _(t: Tables) -> DataFrame:
    """Predictions that carry another fold, validation member or seed than the manifest."""
    i = F.col("doc_id")
    expected = t.labels.select("doc_id", "toxic", (i % 5).alias("fold"), F.concat(F.lit("v"), (i + 1) % 5).alias("validation"), F.lit(7).alias("seed"))
    found = expected.withColumns({"pred": F.lit(0.5), "fold": F.when(i % 10 == 3, 0 - F.col("fold") - 1).otherwise(F.col("fold")), "validation": F.when(i % 10 != 7, F.col("validation")), "seed": F.when(i % 1000 < 100, 8).otherwise(7)})
    return C.prediction_problems(expected, found, ["doc_id"], "toxic", "pred", meta=["fold", "validation", "seed"])


@query("compare_saved_metrics", f"WITH {CELL} SELECT user_id, event_type FROM c WHERE user_id % 4 = 0")
def _(t: Tables) -> DataFrame:
    c = cell(t)
    saved = c.withColumn("v", F.when(F.col("user_id") % 4 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return C.metric_differences(saved, c, ["user_id", "event_type"], "v", 1e-6).select("user_id", "event_type")


@query("estimate_table_contract", """WITH e AS (SELECT user_id, event_type, avg(value) AS estimate, CASE WHEN count(*) > 2 THEN avg(value) - stddev_samp(value) END AS ci_low, CASE WHEN max(value) > 5 THEN max(value) / 2 END AS ci_high, CASE WHEN count(*) > 12 THEN 'window' WHEN count(*) > 1 THEN 'participant' END AS unit FROM events GROUP BY ALL)
SELECT user_id, event_type, concat_ws(',', CASE WHEN ci_low IS NULL THEN 'ci_low' END, CASE WHEN ci_high IS NULL THEN 'ci_high' END, CASE WHEN unit IS NULL THEN 'inference_unit' END, CASE WHEN unit = 'window' THEN 'window_as_unit' END, CASE WHEN ci_low > estimate OR ci_high < estimate THEN 'interval_off_estimate' END) AS violations FROM e
WHERE ci_low IS NULL OR ci_high IS NULL OR unit IS NULL OR unit = 'window' OR ci_low > estimate OR ci_high < estimate""")
def _(t: Tables) -> DataFrame:
    n = F.count("*")
    e = t.events.groupBy("user_id", "event_type").agg(
        F.avg("value").alias("estimate"), F.when(n > 2, F.avg("value") - F.stddev_samp("value")).alias("ci_low"), F.when(F.max("value") > 5, F.max("value") / 2).alias("ci_high"),
        F.when(n > 12, "window").when(n > 1, "participant").alias("inference_unit"),
    )
    return C.estimate_problems(e).select("user_id", "event_type", F.array_join("violations", ",").alias("violations"))
