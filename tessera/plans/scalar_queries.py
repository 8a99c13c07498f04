"""Queries of the column functions and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.plans.registry import Tables, query


@query("normalize_participant", "SELECT user_id, CASE WHEN user_id BETWEEN 1 AND 999 THEN 'P' || lpad(CAST(user_id AS VARCHAR), 3, '0') END AS participant, count(*) AS n FROM events GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("n "), F.col("user_id").cast("string"))
    return t.events.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", S.normalize_participant(raw).alias("participant"), "n")


@query("normalize_condition", "SELECT o_orderkey, CASE WHEN o_orderkey % 12 BETWEEN 1 AND 9 THEN 'C' || CAST(o_orderkey % 12 AS VARCHAR) END AS condition FROM orders")
def _(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("c0"), (F.col("o_orderkey") % 12).cast("string"))
    return t.orders.select("o_orderkey", S.normalize_condition(raw).alias("condition"))


@query("normalize_subject", "SELECT s_suppkey, lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS subject FROM supplier")
def _(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", S.normalize_subject((F.col("s_suppkey") % 1000).cast("double").cast("string")).alias("subject"))


@query("parse_decimal", "SELECT p_partkey, p_retailprice AS price, CAST(p_partkey || '.' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '007' AS DOUBLE) AS grouped FROM part")
def _(t: Tables) -> DataFrame:
    comma = F.regexp_replace(F.col("p_retailprice").cast("string"), r"\.", ",")
    grouped = F.concat_ws(".", F.col("p_partkey").cast("string"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("007"))
    return t.part.select("p_partkey", S.parse_decimal(comma).alias("price"), S.parse_decimal(grouped).alias("grouped"))


@query("coerce_boolean", "SELECT event_id, CASE WHEN event_type = 'view' THEN TRUE WHEN event_type = 'click' THEN FALSE END AS flag FROM events")
def _(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_type") == "view", " Yes").when(F.col("event_type") == "click", "FALSE").otherwise("maybe")
    return t.events.select("event_id", S.coerce_boolean(raw).alias("flag"))


@query(
    "grid_parameters",
    """SELECT o_orderkey, CAST((n - 1) // 3 AS INTEGER) AS intensity_index, CAST((n - 1) % 3 AS INTEGER) AS frequency_index,
       [0.08, 0.16, 0.25][(n - 1) // 3 + 1]::DOUBLE AS intensity, [0.12, 0.26, 0.41][(n - 1) % 3 + 1]::DOUBLE AS frequency
       FROM (SELECT o_orderkey, o_orderkey % 9 + 1 AS n FROM orders)""",
)
def _(t: Tables) -> DataFrame:
    n = (F.col("o_orderkey") % 9 + 1).cast("int")
    i, f = S.grid_intensity_index(n), S.grid_frequency_index(n)
    return t.orders.select("o_orderkey", i.alias("intensity_index"), f.alias("frequency_index"), S.pick(S.INTENSITY, i).alias("intensity"), S.pick(S.FREQUENCY, f).alias("frequency"))


@query("normalize_rating", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity BETWEEN 1 AND 7 THEN round((l_quantity - 1) / 6, 9) END AS relaxation, CASE WHEN l_quantity BETWEEN 1 AND 7 THEN round(1 - (l_quantity - 1) / 6, 9) END AS discomfort FROM lineitem")
def _(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.normalize_rating(q), 9).alias("relaxation"), F.round(S.normalize_rating(q, reverse=True), 9).alias("discomfort"))


@query("categorize_fit", "SELECT p_partkey, CASE WHEN p_name LIKE '%red%' AND p_name LIKE '%ring%' THEN 0.5 WHEN p_name LIKE '%red%' THEN 1.0 WHEN p_name LIKE '%ring%' THEN 0.0 END::DOUBLE AS fit FROM part")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.categorize_fit(F.col("p_name"), ["red"], ["ring"]).cast("double").alias("fit"))


@query("clip_unit", "SELECT event_id, round(least(1.0, greatest(0.0, value / 100 - 0.1)), 9) AS clipped FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(S.clip(F.col("value") / 100 - 0.1), 9).alias("clipped"))


@query("iso_to_epoch_ms", "SELECT event_id, epoch_us(date_trunc('second', ts)) // 1000 AS ms, epoch_us(date_trunc('second', ts)) // 1000 AS ms_zoned, CAST(NULL AS BIGINT) AS bad FROM events")
def _(t: Tables) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return t.events.select("event_id", S.iso_to_epoch_ms(iso).alias("ms"), S.iso_to_epoch_ms(F.concat(iso, F.lit("Z"))).alias("ms_zoned"), S.iso_to_epoch_ms(F.concat(F.lit("x"), iso)).alias("bad"))


@query("build_keys", "SELECT event_id, 'P' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') || '_' || event_type || '_W' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS window_id FROM events")
def _(t: Tables) -> DataFrame:
    p = F.concat(F.lit("P"), F.lpad((F.col("user_id") % 1000).cast("string"), 3, "0"))
    return t.events.select("event_id", S.window_key(p, F.col("event_type"), F.col("event_id") % 100).alias("window_id"))


@query("safe_divide", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(l_discount) > 1e-12 THEN round(l_tax / l_discount, 9) END AS ratio FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.safe_divide(F.col("l_tax"), F.col("l_discount")), 9).alias("ratio"))


@query(
    "normalized_entropy",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT vec_id, v, sum(v) OVER (PARTITION BY vec_id) AS s, count(*) OVER (PARTITION BY vec_id) AS n FROM x WHERE v > 0)
       SELECT vec_id, round(-sum(v / s * log2(v / s)) / log2(max(n)), 6) AS entropy FROM p GROUP BY vec_id""",
)
def _(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(S.normalized_entropy(F.col("embedding").cast("array<double>")), 6).alias("entropy"))


@query("ramp_score", "SELECT event_id, round(least(1.0, greatest(0.0, (value - 20) / 60)), 9) AS up, round(1 - least(1.0, greatest(0.0, (value - 20) / 60)), 9) AS down FROM events")
def _(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select("event_id", F.round(S.ramp(v, 20.0, 80.0), 9).alias("up"), F.round(S.ramp(v, 20.0, 80.0, True), 9).alias("down"))


@query("gaze_yaw_pitch", "SELECT vec_id, round(degrees(atan2(x, z)), 6) AS yaw, round(degrees(asin(y / sqrt(x*x + y*y + z*z))), 6) AS pitch FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)")
def _(t: Tables) -> DataFrame:
    x, y, z = (F.get("embedding", F.lit(i)).cast("double") for i in range(3))
    return t.embeddings.select("vec_id", F.round(S.yaw(x, z), 6).alias("yaw"), F.round(S.pitch(x, y, z), 6).alias("pitch"))


@query(
    "project_gaze",
    """SELECT vec_id, CASE WHEN z > 0 THEN round(640 + 640 * x / z, 4) END AS px, CASE WHEN z > 0 THEN round(360 - 640 * y / z, 4) END AS py
       FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE + 0.5 AS z FROM embeddings)""",
)
def _(t: Tables) -> DataFrame:
    x, y, z = (F.get("embedding", F.lit(i)).cast("double") for i in range(3))
    zero, one = F.lit(0.0), F.lit(1.0)
    px, py = S.project_gaze((x, y, z + 0.5), (zero, zero, one), (zero, one, zero), 1280, 720, 90.0)
    return t.embeddings.select("vec_id", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"))


@query(
    "quaternion_to_euler",
    """SELECT vec_id, round(degrees(atan2(2*(w*x + y*z), 1 - 2*(x*x + y*y))), 6) AS rx, round(degrees(asin(greatest(-1, least(1, 2*(w*y - z*x))))), 6) AS ry, round(degrees(atan2(2*(w*z + x*y), 1 - 2*(y*y + z*z))), 6) AS rz
       FROM (SELECT vec_id, a/n AS w, b/n AS x, c/n AS y, d/n AS z FROM (SELECT vec_id, a, b, c, d, sqrt(a*a + b*b + c*c + d*d) AS n FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings)))""",
)
def _(t: Tables) -> DataFrame:
    q = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    n = F.sqrt(sum((x * x for x in q[1:]), q[0] * q[0]))
    rx, ry, rz = S.euler(*[x / n for x in q])
    return t.embeddings.select("vec_id", F.round(rx, 6).alias("rx"), F.round(ry, 6).alias("ry"), F.round(rz, 6).alias("rz"))


@query("json_detail_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("safe_relative_path", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_brand || '/' || p_type || '/f.csv' END AS path FROM part")
def _(t: Tables) -> DataFrame:
    raw = F.concat_ws("\\", F.when(F.col("p_size") % 3 == 0, F.lit("..")), F.col("p_brand"), F.col("p_type"), F.lit("f.csv"))
    return t.part.select("p_partkey", S.safe_relative_path(raw).alias("path"))


@query(
    "grid_action_name",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 9 + 1 AS a, l_suppkey % 9 + 1 AS b FROM lineitem),
       d AS (SELECT *, (b - 1) // 3 - (a - 1) // 3 AS di, (b - 1) % 3 - (a - 1) % 3 AS df FROM p)
       SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN di = 0 AND df = 0 THEN 'hold' WHEN abs(di) + abs(df) <> 1 THEN 'illegal' WHEN di = 1 THEN 'intensity_up' WHEN di = -1 THEN 'intensity_down' WHEN df = 1 THEN 'frequency_up' ELSE 'frequency_down' END AS action,
       CAST(CASE WHEN a > 3 THEN a - 3 WHEN a > 1 THEN a - 1 ELSE a END AS INTEGER) AS safer FROM d""",
)
def _(t: Tables) -> DataFrame:
    a, b = (F.col("l_partkey") % 9 + 1).cast("int"), (F.col("l_suppkey") % 9 + 1).cast("int")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.grid_action(a, b).alias("action"), S.conservative_step(a).alias("safer"))


# One name of every family, and one that belongs to none in its modality.
NAMES = [
    ("H", "head_speed_mean"), ("H", "head_angular_speed_deg_s_iqr"), ("H", "head_jerk_std"), ("H", "head_stationary_fraction"), ("H", "head_position_range"), ("H", "head_motion_spectral_entropy"), ("P", "ecg_rr_std_ms_audit_only"), ("P", "ecg_hrv_60s_rmssd_ms"),
    ("P", "ecg_hr_bpm"), ("P", "eeg_tp9_alpha_relative"), ("P", "eeg_tp9_alpha_power"), ("P", "eeg_m1_robust_amplitude_uV"), ("P", "eeg_tp9_hjorth_mobility"), ("P", "eeg_tp9_spectral_entropy"), ("P", "eeg_alpha_beta_ratio"), ("H", "eeg_alpha_beta_ratio"),
]


@query(
    "feature_family",
    f"""WITH n AS (SELECT event_id, [{", ".join(f"'{m}'" for m, _ in NAMES)}][1 + event_id % {len(NAMES)}] AS m, [{", ".join(f"'{n}'" for _, n in NAMES)}][1 + event_id % {len(NAMES)}] AS f FROM events)
    SELECT event_id, CASE WHEN m = 'H' AND f LIKE 'head\\_speed\\_%' ESCAPE '\\' THEN 'head_translational_speed' WHEN m = 'H' AND starts_with(f, 'head_angular_speed_deg_s_') THEN 'head_angular_velocity' WHEN m = 'H' AND starts_with(f, 'head_jerk_') THEN 'head_jerk' WHEN m = 'H' AND f IN ('head_stationary_fraction', 'head_position_range', 'head_motion_spectral_entropy') THEN f
    WHEN m = 'P' AND f = 'ecg_rr_std_ms_audit_only' THEN f WHEN m = 'P' AND starts_with(f, 'ecg_hrv_') THEN 'ecg_hrv' WHEN m = 'P' AND starts_with(f, 'ecg_') THEN 'ecg_rate_signal_amplitude' WHEN m = 'P' AND ends_with(f, '_relative') THEN 'eeg_relative_band_power'
    WHEN m = 'P' AND (ends_with(f, '_power') OR ends_with(f, '_robust_amplitude_uV')) THEN 'eeg_absolute_power_amplitude' WHEN m = 'P' AND (contains(f, '_hjorth_') OR ends_with(f, '_spectral_entropy')) THEN 'eeg_hjorth_spectral_entropy' WHEN m = 'P' AND f IN ('eeg_alpha_beta_ratio', 'eeg_theta_beta_ratio', 'eeg_alpha_asymmetry_log_right_left') THEN 'eeg_ratios_asymmetry' END AS family FROM n""",
)
def _(t: Tables) -> DataFrame:
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (1 + F.col("event_id") % len(NAMES)).cast("int"))
    return t.events.select("event_id", S.feature_family(pick([m for m, _ in NAMES]), pick([n for _, n in NAMES])).alias("family"))


@query(
    "sensor_state",
    """WITH r AS (SELECT event_id, least(1.0, greatest(0.0, (value + 50 - 105) / 40)) AS hr, 1 - least(1.0, greatest(0.0, (value * 2 - 80) / 100)) AS rmssd, value / 400 AS discomfort, 1 - value / 400 AS relaxation,
       1 - least(1.0, greatest(0.0, (value / 1000 - 0.0035) / 0.0145)) AS still, least(1.0, greatest(0.0, (value / 1000 - 0.018) / 0.027)) AS motion FROM events),
       s AS (SELECT event_id, discomfort, relaxation, greatest(hr, rmssd * 0.5) AS cardio_arousal, motion AS motion_arousal FROM r)
       SELECT event_id, round(cardio_arousal, 9) AS cardio_arousal, round(motion_arousal, 9) AS motion_arousal, round(greatest(cardio_arousal, motion_arousal, least(1.0, greatest(0.0, (discomfort - 0.35) / 0.25))), 9) AS physiological_arousal,
       concat_ws(',', CASE WHEN cardio_arousal >= 0.65 THEN 'cardio_arousal' END, CASE WHEN motion_arousal >= 0.65 THEN 'motion_arousal' END) AS tags FROM s""",
)
def _(t: Tables) -> DataFrame:
    v = F.col("value")
    s = S.sensor_state({"hr": v + 50, "rmssd": v * 2, "head_speed": v / 1000}, 1 - v / 400, v / 400)
    r = t.events.select("event_id", s.alias("s"))
    return r.select("event_id", *[F.round(f"s.{n}", 9).alias(n) for n in ("cardio_arousal", "motion_arousal", "physiological_arousal")], F.array_join("s.tags", ",").alias("tags"))


@query(
    "soft_label_distribution",
    """WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, [l_quantity, l_partkey % 7 + 1, l_suppkey % 5] AS v FROM lineitem), s AS (SELECT *, list_sum(v) AS total FROM w)
       SELECT l_orderkey, l_linenumber, l_partkey, round(v[1] / total, 9) AS p0, round(v[2] / total, 9) AS p1, round(v[3] / total, 9) AS p2, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS dominant FROM s""",
)
def _(t: Tables) -> DataFrame:
    text = F.concat_ws(",", F.col("l_quantity").cast("string"), (F.col("l_partkey") % 7 + 1).cast("string"), (F.col("l_suppkey") % 5).cast("string"))
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", S.soft_label(text, 3).alias("p"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(F.get("p", F.lit(i)), 9).alias(f"p{i}") for i in range(3)], S.dominant(F.col("p")).alias("dominant"))


@query("flag_high_risk", "SELECT doc_id, toxic, toxic >= 0.5 AS high_risk, CASE WHEN quality = 1 THEN 'ok' ELSE 'warning' END AS status FROM labels")
def _(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", "toxic", (F.col("toxic") >= 0.5).alias("high_risk"), F.when(F.col("quality") == 1, "ok").otherwise("warning").alias("status"))


@query("filter_plausible_time", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events WHERE epoch_us(ts) // 1000 >= 100000000000 AND event_type <> 'error'")
def _(t: Tables) -> DataFrame:
    kind = F.col("event_type")  # errors have a rounded clock, views only an ISO time
    direct = F.when(kind == "error", F.lit(1780.0)).when(kind == "view", F.lit(None)).otherwise(F.unix_millis("ts").cast("double"))
    iso = F.when(kind == "view", F.unix_millis("ts"))
    ms = F.coalesce(iso, direct.cast("long"))
    return t.events.select("event_id", ms.alias("ms")).filter(ms.isNotNull() & (ms >= 100_000_000_000))


@query("filter_valid_gaze", "SELECT event_id, user_id, value FROM events WHERE event_type IN ('view', 'click') AND value > 1 AND value < 300")
def _(t: Tables) -> DataFrame:
    return t.events.filter(F.col("event_type").isin("view", "click") & (F.col("value") > 1) & (F.col("value") < 300)).select("event_id", "user_id", "value")


@query("select_feature_group", "SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax FROM lineitem")
def _(t: Tables) -> DataFrame:
    df = t.lineitem
    return df.select("l_orderkey", "l_linenumber", "l_partkey", *[c for c in df.columns if c.startswith(("l_disc", "l_tax"))])


@query("unpivot_rating_blocks", "SELECT p_partkey, unnest([0, 1, 2]) AS position, unnest([p_size::DOUBLE, p_retailprice, p_size * 2.0]) AS rating FROM part")
def _(t: Tables) -> DataFrame:
    blocks = F.array(F.col("p_size").cast("double"), F.col("p_retailprice"), F.col("p_size") * 2.0)
    return t.part.select("p_partkey", F.posexplode(blocks).alias("position", "rating"))


@query("apply_modality_masks", "SELECT e.event_id, CASE WHEN user_id % 3 <> 0 THEN value END AS value, user_id % 3 <> 0 AS value_valid FROM events e")
def _(t: Tables) -> DataFrame:
    from tessera.operators.joins import apply_masks

    masks = t.events.select("event_id", (F.col("user_id") % 3 != 0).alias("value_valid"))
    return apply_masks(t.events.select("event_id", "value"), masks, ["event_id"], {"value_valid": ["value"]})


@query("status_summary", "SELECT user_id, count(*) AS n_windows, CASE WHEN max(value) > 250 THEN 'error' WHEN max(value) > 150 THEN 'warning' ELSE 'ok' END AS status FROM events GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.count("*").alias("n_windows"), F.max("value").alias("m"))
    return g.select("user_id", "n_windows", F.when(F.col("m") > 250, "error").when(F.col("m") > 150, "warning").otherwise("ok").alias("status"))
