"""Queries of quality checks, descriptions, sequences and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import describe as D
from tessera.operators import quality as Q
from tessera.operators import rank as R
from tessera.operators import sequence as S
from tessera.plans.join_queries import HOUR, SAMPLES, samples, user_day
from tessera.plans.registry import Tables, draw_sql, query
from tessera.plans.window_queries import rounded

TYPES = ["click", "error", "purchase", "signup", "view"]
CELL = "c AS (SELECT user_id, event_type, count(*) AS n, avg(value) AS v, max(value) AS m FROM events GROUP BY ALL)"


def cell(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("v"), F.max("value").alias("m"))


@query("clock_offset_qc", """WITH d AS (SELECT user_id, value * 3 AS d FROM events), m AS (SELECT user_id, quantile_cont(d, 0.5) AS o FROM d GROUP BY 1) SELECT user_id, round(o, 6) AS "offset", round(max(abs(d - o)), 6) AS max_residual, count(*) FILTER (abs(d - o) >= 50) AS outliers FROM d JOIN m USING (user_id) GROUP BY user_id, o""")
def _(t: Tables) -> DataFrame:
    return rounded(Q.clock_offset(t.events, ["user_id"], F.col("value") * 4, F.col("value")))


@query("clock_offset_outliers", """WITH d AS (SELECT user_id, event_id, value * 3 AS d FROM events), m AS (SELECT user_id, quantile_cont(d, 0.5) AS o FROM d GROUP BY 1) SELECT user_id, event_id, round(o, 6) AS "offset", round(d - o, 6) AS residual FROM d JOIN m USING (user_id) WHERE abs(d - o) >= 50""")
def _(t: Tables) -> DataFrame:
    return rounded(Q.clock_outliers(t.events.select("user_id", "event_id", "value"), ["user_id"], F.col("value") * 4, F.col("value")).drop("value"))


@query("counter_gap_qc", """WITH d AS (SELECT l_suppkey, l_partkey - lag(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, l_partkey) AS d FROM lineitem), m AS (SELECT l_suppkey, quantile_cont(d, 0.5) FILTER (d > 0) AS m FROM d GROUP BY 1)
SELECT l_suppkey, round(avg(CASE WHEN d IS NOT NULL THEN CASE WHEN d <> m THEN 1 ELSE 0 END END), 6) AS gap_fraction FROM d JOIN m USING (l_suppkey) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    x = t.lineitem.withColumn("at", F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), "l_partkey"))
    return rounded(Q.counter_gaps(x, ["l_suppkey"], "at", "l_partkey"))


@query("block_coverage", f"""WITH {SAMPLES}, b AS (SELECT participant, ms // {24 * HOUR} AS b, CAST(min(value) >= 1 AND max(value) <= 200 AND stddev_pop(value) > 1e-9 AS INTEGER) AS g FROM s GROUP BY ALL) SELECT participant, round(avg(g), 6) AS coverage, count(*) AS blocks FROM b GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return rounded(Q.block_coverage(samples(t), ["participant"], "ms", ["value"], 24 * HOUR, 1.0, 200.0))


@query("segment_quality", "SELECT user_id, event_id % 5 AS segment, count(*) FILTER (value < 1) = 0 AND coalesce(stddev_pop(CASE WHEN value >= 1 THEN value END), 0) >= 20 AS good FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    e = t.events.withColumn("value", F.when(F.col("value") >= 1, F.col("value")))
    return Q.segment_quality(e, ["user_id"], F.col("event_id") % 5, "value", 20.0)


@query("window_quality", "SELECT user_id, round(quantile_cont(value, 0.95) - quantile_cont(value, 0.05), 6) AS robust_range, round(var_pop(value), 4) AS variance, round(kurtosis_pop(value), 6) AS kurtosis FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    q = Q.window_quality(t.events, ["user_id"], "value")
    return q.select("user_id", F.round("robust_range", 6).alias("robust_range"), F.round("variance", 4).alias("variance"), F.round("kurtosis", 6).alias("kurtosis"))


MANIFEST = "m AS (SELECT user_id, count(DISTINCT event_type) / 5.0 AS label_ratio, count(*) AS windows, avg(CASE WHEN value > 5 THEN 1 ELSE 0 END) AS eeg_ratio, (count(DISTINCT event_type) / 5.0 + avg(CASE WHEN value > 5 THEN 1 ELSE 0 END)) / 2 AS score FROM events GROUP BY 1)"


def manifest(t: Tables) -> DataFrame:
    e = t.events
    return Q.participant_manifest(e.select("user_id", F.col("event_type").alias("condition")), e, e.select("user_id", (F.col("value") > 5).alias("eeg_usable")), "user_id", 5, ["eeg"])


@query("participant_qc_manifest", f"WITH {MANIFEST} SELECT user_id, label_ratio, windows, round(eeg_ratio, 6) AS eeg_ratio, round(score, 6) AS score FROM m")
def _(t: Tables) -> DataFrame:
    return rounded(manifest(t))


@query("participant_expected_windows", """WITH m AS (SELECT user_id, count(DISTINCT event_type) / 5.0 AS label_ratio, count(*) AS windows, avg(CASE WHEN value > 5 THEN 1 ELSE 0 END) AS eeg_ratio FROM events GROUP BY 1), x AS (SELECT c_custkey AS user_id, c_custkey % 40 AS expected_windows FROM customer),
j AS (SELECT coalesce(m.user_id, x.user_id) AS user_id, coalesce(label_ratio, 0.0) AS label_ratio, coalesce(windows, 0) AS windows, eeg_ratio, expected_windows FROM m FULL JOIN x ON m.user_id = x.user_id), r AS (SELECT *, least(1.0, windows / nullif(expected_windows, 0)) AS window_ratio FROM j)
SELECT user_id, label_ratio, windows, round(eeg_ratio, 6) AS eeg_ratio, expected_windows, round(window_ratio, 6) AS window_ratio, round((label_ratio + coalesce(eeg_ratio, 0) + coalesce(window_ratio, 0)) / 3, 6) AS score FROM r""")
def _(t: Tables) -> DataFrame:
    e = t.events
    expected = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 40).alias("expected_windows"))
    return rounded(Q.participant_manifest(e.select("user_id", F.col("event_type").alias("condition")), e, e.select("user_id", (F.col("value") > 5).alias("eeg_usable")), "user_id", 5, ["eeg"], expected))


@query("build_cohorts", f"WITH {MANIFEST}, u AS (SELECT * FROM m WHERE label_ratio >= 1 AND eeg_ratio >= 0.9) SELECT user_id, 'usable' AS cohort FROM u UNION ALL (SELECT user_id, 'pilot' FROM u ORDER BY score DESC, user_id LIMIT 7)")
def _(t: Tables) -> DataFrame:
    return Q.cohorts(manifest(t), "user_id", {"label_ratio": 1.0, "eeg_ratio": 0.9}, 7)


@query("modality_masks", "SELECT e.event_id, CASE WHEN event_type = 'view' THEN TRUE WHEN event_type = 'click' THEN FALSE END AS eeg_valid, value > 10 AS ecg_valid FROM events e")
def _(t: Tables) -> DataFrame:
    from tessera.functions.scalars import coerce_boolean

    raw = t.events.select("event_id", F.when(F.col("event_type") == "view", "1").when(F.col("event_type") == "click", "no").alias("eeg"), (F.col("value") > 10).alias("ecg"))
    return raw.select("event_id", coerce_boolean(F.col("eeg")).alias("eeg_valid"), coerce_boolean(F.col("ecg")).alias("ecg_valid"))


VALID = "count(*) FILTER (value > 10 AND event_id % 3 <> 0)"


@query("common_valid_mask", f"SELECT user_id, event_type, {VALID} AS valid, count(*) AS windows, {VALID} = 0 AS none_valid, round({VALID} / count(*), 6) AS ratio FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    m = t.events.select("user_id", "event_type", (F.col("value") > 10).alias("a"), (F.col("event_id") % 3 != 0).alias("b"))
    return rounded(Q.common_valid(m, ["user_id", "event_type"], ["a", "b"]))


@query("condition_quality_ratio", "SELECT event_type, count(*) FILTER (value > 30) AS valid, count(*) AS windows, round(count(*) FILTER (value > 30) / count(*), 6) AS ratio FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return rounded(Q.common_valid(t.events.select("event_type", (F.col("value") > 30).alias("a")), ["event_type"], ["a"]).drop("none_valid"))


@query("completeness_audit", f"""WITH x AS (SELECT user_id || ':' || (epoch_us(ts) // {24 * HOUR}000) AS user_day, event_type FROM events), n AS (SELECT user_day, event_type, count(*) AS n FROM x GROUP BY ALL), g AS (SELECT user_day, list_sort(list_filter({TYPES}, lambda y: NOT list_contains(list(event_type), y))) AS missing, list_sort(list(event_type) FILTER (n > 1)) AS dup FROM n GROUP BY 1)
SELECT user_day, array_to_string(missing, ',') AS missing, coalesce(array_to_string(dup, ','), '') AS duplicated FROM g WHERE len(missing) > 0 OR len(dup) > 0""")
def _(t: Tables) -> DataFrame:
    c = Q.completeness(t.events.select(user_day().alias("user_day"), "event_type"), "user_day", "event_type", TYPES)
    return c.select("user_day", F.array_join("missing", ",").alias("missing"), F.array_join("duplicated", ",").alias("duplicated"))


@query("table_shape_audit", """SELECT 'nation' AS "table", count(*) AS n_rows, 3 AS n_columns, 25::BIGINT AS expected, count(*) = 25 AS ok FROM nation UNION ALL SELECT 'orders', count(*), 5, NULL, TRUE FROM orders""")
def _(t: Tables) -> DataFrame:
    return Q.shape_audit({"nation": (t.nation, 25), "orders": (t.orders.select(*t.orders.columns[:5]), None)})


@query("label_validation", "WITH l AS (SELECT CASE WHEN toxic = 1 THEN -1 - doc_id WHEN quality = 0 THEN doc_id // 10 ELSE doc_id END AS doc_id FROM labels) SELECT doc_id, 'unknown_document' AS problem FROM l WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'duplicate' FROM l GROUP BY doc_id HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    labels = t.labels.select(F.when(F.col("toxic") == 1, -1 - F.col("doc_id")).when(F.col("quality") == 0, F.floor(F.col("doc_id") / 10)).otherwise(F.col("doc_id")).alias("doc_id"))
    unknown = labels.join(t.documents.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("unknown_document").alias("problem"))
    return unknown.union(R.duplicate_keys(labels, ["doc_id"]).select("doc_id", F.lit("duplicate")))


@query("embedding_sanity", f"""WITH v AS (SELECT place, var_pop(x) AS v FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS place FROM embeddings) GROUP BY 1), s AS (SELECT round(avg(v), 8) AS variance_mean, round(min(v), 8) AS variance_min, round(max(v), 8) AS variance_max, count(*) FILTER (v < 1e-6) AS dead_places, count(*) AS places FROM v),
e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, {draw_sql("9", "vec_id")} AS d FROM embeddings), p AS (SELECT e AS a, lead(e) OVER (PARTITION BY floor(d * 64) ORDER BY d, vec_id) AS b FROM e),
c AS (SELECT list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b)) AS c FROM p WHERE b IS NOT NULL), k AS (SELECT round(avg(c), 6) AS cosine_mean, round(stddev_pop(c), 6) AS cosine_std, round(min(c), 6) AS cosine_min, round(max(c), 6) AS cosine_max, count(*) AS pairs, avg(c) AS m FROM c)
SELECT s.*, cosine_mean, cosine_std, cosine_min, cosine_max, pairs, CASE WHEN m > 0.99 OR variance_min < 1e-6 THEN 'DEGENERATE' ELSE 'USABLE' END AS verdict FROM s, k""")
def _(t: Tables) -> DataFrame:
    r = Q.embedding_sanity(t.embeddings, "vec_id", "embedding")
    return r.select(*[F.round(c, 8).alias(c) if c.startswith("variance") else F.round(c, 6).alias(c) if c.startswith("cosine") else c for c in r.columns])


@query("centroid_distances", """WITH c AS (SELECT label, place, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS place FROM embeddings) GROUP BY ALL)
SELECT a.label AS "left", b.label AS "right", round(sqrt(sum((a.x - b.x)**2)), 6) AS distance FROM c a JOIN c b ON a.place = b.place AND a.label < b.label GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return rounded(Q.centroid_distances(t.embeddings, "label", "embedding"))


@query("log_cadence", f"WITH {SAMPLES}, d AS (SELECT participant, (ms - lag(ms) OVER (PARTITION BY participant ORDER BY ms))::DOUBLE AS step FROM s) SELECT participant, count(*) AS n, round(avg(step), 3) AS mean, quantile_cont(step, 0.5) AS median FROM d WHERE step > 0 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    c = Q.cadence(samples(t), ["participant"], "ms")
    return c.select("participant", "n", F.round("step__mean", 3).alias("mean"), F.col("step__median").alias("median"))


@query("decision_latency", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS min, max(value) AS max, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def _(t: Tables) -> DataFrame:
    return rounded(Q.latency(t.events, "event_type", F.col("value")))


@query("modality_age", "SELECT event_id, 'k' AS modality, CAST(json_extract(props, '$.k') AS DOUBLE) - 20 AS age FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 20")
def _(t: Tables) -> DataFrame:
    e = t.events.select("event_id", F.transform_values(F.from_json("props", "map<string,double>"), lambda k, v: v - 20).alias("ages"))
    return Q.modality_ages(e, ["event_id"], "ages")


@query("target_distribution", " UNION ALL ".join(f"SELECT '{c}' AS target, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, count(*) FILTER ({c} <= 0.01) AS n_floor, count(*) FILTER ({c} >= 0.08) AS n_ceiling FROM lineitem" for c in ("l_discount", "l_tax")))
def _(t: Tables) -> DataFrame:
    return rounded(D.target_distribution(t.lineitem, ["l_discount", "l_tax"], 0.01, 0.08))


@query("order_balance", " UNION ALL ".join(f"SELECT '{a}' AS axis, {a} AS level, l_linenumber AS position, count(*) AS n FROM lineitem GROUP BY ALL" for a in ("l_returnflag", "l_linestatus")))
def _(t: Tables) -> DataFrame:
    return D.order_balance(t.lineitem, ["l_returnflag", "l_linestatus"], "l_linenumber")


@query("order_chi_square", """WITH n AS (SELECT l_returnflag AS a, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY ALL), g AS (SELECT r.a, c.b, r, c, coalesce(n, 0) AS n, (SELECT sum(n) FROM n) AS t FROM (SELECT a, sum(n) AS r FROM n GROUP BY 1) r CROSS JOIN (SELECT b, sum(n) AS c FROM n GROUP BY 1) c LEFT JOIN n ON n.a = r.a AND n.b = c.b)
SELECT round(sum((n - r * c / t)**2 / (r * c / t)), 6) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM g""")
def _(t: Tables) -> DataFrame:
    return rounded(D.chi_square(t.lineitem, "l_returnflag", "l_linenumber"))


@query("status_split_summary", "SELECT o_status AS status, count(DISTINCT n) AS n_keys, array_to_string(list_sort(list_distinct(list(n))), ',') AS keys, round(avg(p), 4) AS mean, round(stddev_samp(p), 4) AS std FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'ok' ELSE 'late' END AS o_status, o_orderkey % 10 AS n, o_totalprice / 1000 AS p FROM orders) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    o = t.orders.select(F.when(F.col("o_orderkey") % 3 == 0, "ok").otherwise("late").alias("status"), (F.col("o_orderkey") % 10).alias("n"), (F.col("o_totalprice") / 1000).alias("p"))
    return rounded(D.status_split(o, "status", "n", "p"), 4)


@query("grid_descriptives", "WITH g AS (SELECT unnest(range(12)) AS k), o AS (SELECT o_orderkey % 9 AS k, o_totalprice / 1000 AS p FROM orders) SELECT g.k, count(p) AS n, round(avg(p), 7) AS mean, round(stddev_samp(p), 7) AS std, round(quantile_cont(p, 0.5), 7) AS median FROM g LEFT JOIN o USING (k) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    o = t.orders.select((F.col("o_orderkey") % 9).alias("k"), (F.col("o_totalprice") / 1000).alias("p"))
    return rounded(D.grid_descriptives(o, t.spark.range(12).withColumnRenamed("id", "k"), ["k"], "p"), 7)


@query("reason_counts", "SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN value > 50 THEN [event_type, 'high'] ELSE [event_type] END) AS reason FROM events) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    e = t.events.select(F.array_compact(F.array("event_type", F.when(F.col("value") > 50, "high"))).alias("reasons"))
    return D.reason_counts(e, "reasons")


@query("replay_summary", "SELECT count(*) AS messages, count(*) FILTER (event_type = 'error') AS held, count(*) FILTER (value > 100) AS changed, bool_and(value < 1000) AS all_valid FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.agg(F.count("*").alias("messages"), F.count_if(F.col("event_type") == "error").alias("held"), F.count_if(F.col("value") > 100).alias("changed"), F.bool_and(F.col("value") < 1000).alias("all_valid"))


@query("variance_share", " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(sum(({c} - g)**2), 4) AS total, round(sum((m - g)**2) / sum(({c} - g)**2), 6) AS between_share, round(sum(({c} - m)**2) / sum(({c} - g)**2), 6) AS within_share FROM (SELECT {c}, avg({c}) OVER (PARTITION BY l_suppkey) AS m, avg({c}) OVER () AS g FROM lineitem)""" for c in ("l_discount", "l_tax")))
def _(t: Tables) -> DataFrame:
    v = D.variance_share(t.lineitem, "l_suppkey", ["l_discount", "l_tax"])
    return v.select("column", F.round("total", 4).alias("total"), F.round("between_share", 6).alias("between_share"), F.round("within_share", 6).alias("within_share"))


@query("between_group_spread", "SELECT round(stddev_samp(s), 6) AS spread, count(s) AS n FROM (SELECT avg(value) AS s FROM events GROUP BY user_id)")
def _(t: Tables) -> DataFrame:
    return rounded(D.between_spread(t.events, "user_id", F.avg("value")))


@query("cronbach_alpha", "SELECT round(1.5 * (1 - (var_samp(l_discount) + var_samp(l_tax) + var_samp(l_quantity / 100)) / var_samp(l_discount + l_tax + l_quantity / 100)), 6) AS alpha FROM lineitem")
def _(t: Tables) -> DataFrame:
    return rounded(D.cronbach_alpha(t.lineitem.withColumn("q", F.col("l_quantity") / 100), ["l_discount", "l_tax", "q"]))


@query("correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in (("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_tax"))))
def _(t: Tables) -> DataFrame:
    return rounded(D.correlation_matrix(t.lineitem, ["l_quantity", "l_discount", "l_tax"]))


@query("composite_latent_score", "SELECT l_orderkey, l_linenumber, l_partkey, round(((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () - (l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER ()) / 2, 6) AS composite FROM lineitem")
def _(t: Tables) -> DataFrame:
    return rounded(D.composite_score(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax"), {"l_quantity": 1, "l_tax": -1}).drop("l_quantity", "l_tax"))


@query("factor_r2", "SELECT 'l_quantity' AS \"column\", round(sum((m - g)**2) / sum((l_quantity - g)**2), 8) AS r2 FROM (SELECT l_quantity, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m, avg(l_quantity) OVER () AS g FROM lineitem)")
def _(t: Tables) -> DataFrame:
    return D.variance_share(t.lineitem, "l_returnflag", ["l_quantity"]).select("column", F.round("between_share", 8).alias("r2"))


@query("class_weights", "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), g AS (SELECT unnest(range(11))::INTEGER AS label) SELECT label, round((SELECT count(*) FROM embeddings) / (11 * greatest(coalesce(n, 0), 1)), 9) AS weight FROM g LEFT JOIN n USING (label)")
def _(t: Tables) -> DataFrame:
    return rounded(D.class_weights(t.embeddings, "label", list(range(11))), 9)


COMBOS = "k AS (SELECT array_to_string(list_filter(['eeg', 'ecg', 'eye'], lambda x, i: (1 + o_orderkey % 7) & (1 << (i - 1)) <> 0), '+') AS combination, avg(o_totalprice) / 1000 AS metric FROM orders GROUP BY 1)"


def combos(t: Tables) -> DataFrame:
    p = R.power_set(t.spark, ["eeg", "ecg", "eye"])
    o = t.orders.withColumn("mask", 1 + F.col("o_orderkey") % 7)
    return o.join(F.broadcast(p), "mask").groupBy("combination").agg((F.avg("o_totalprice") / 1000).alias("metric"))


@query("modality_presence_effect", f"WITH {COMBOS}, s AS (SELECT *, unnest(['eeg', 'ecg', 'eye']) AS modality FROM k) SELECT modality, round(avg(metric) FILTER (list_contains(string_split(combination, '+'), modality)), 6) AS with_it, round(avg(metric) FILTER (NOT list_contains(string_split(combination, '+'), modality)), 6) AS without_it, round(avg(metric) FILTER (list_contains(string_split(combination, '+'), modality)) - avg(metric) FILTER (NOT list_contains(string_split(combination, '+'), modality)), 6) AS effect FROM s GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return rounded(D.presence_effect(combos(t), "combination", "metric", ["eeg", "ecg", "eye"]))


@query("modality_addition_effect", f"""WITH {COMBOS}, a AS (SELECT array_to_string(list_sort(string_split(combination, '+')), '+') AS base, metric AS m FROM k), b AS (SELECT list_sort(string_split(combination, '+')) AS p, metric AS m2, unnest(string_split(combination, '+')) AS modality FROM k),
d AS (SELECT modality, m2 - m AS d FROM b JOIN a ON a.base = array_to_string(list_filter(p, lambda x: x <> modality), '+')) SELECT modality, round(avg(d), 6) AS mean, round(min(d), 6) AS least, round(max(d), 6) AS greatest, count(*) AS n FROM d GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return rounded(D.addition_effect(combos(t), "combination", "metric"))


@query("modality_power_set", f"WITH {COMBOS} SELECT combination, len(string_split(combination, '+')) AS size FROM k")
def _(t: Tables) -> DataFrame:
    return combos(t).select("combination", F.size(F.split("combination", r"\+")).cast("bigint").alias("size"))


@query("selection_stability", "SELECT l_suppkey AS feature, count(DISTINCT l_linenumber) AS folds, round(avg(l_quantity), 6) AS mean_rank, min(l_quantity) AS best_rank FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    a = t.lineitem.select(F.col("l_suppkey").alias("feature"), F.col("l_linenumber").alias("fold"), F.col("l_quantity").alias("rank"))
    return rounded(D.selection_stability(a, "feature", "rank", "fold"))


@query("floor_strata_error", "SELECT CASE WHEN tt = 0 THEN 'zero' ELSE 'other' END AS stratum, round(avg(abs(p - tt)), 6) AS mae, count(*) AS n FROM (SELECT l_partkey, l_suppkey % 3 AS g, avg(l_discount) AS tt, avg(l_tax) AS p FROM lineitem GROUP BY ALL) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    x = t.lineitem.withColumn("g", F.col("l_suppkey") % 3)
    return rounded(D.floor_strata(x, ["l_partkey", "g"], "l_discount", "l_tax"))


W = "WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"


@query("lag_and_expanding_mean", f"SELECT event_id, round(coalesce(lag(value) OVER w, g), 9) AS previous, round(coalesce(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g), 9) AS mean_before FROM events, (SELECT avg(value) AS g FROM events) {W}")
def _(t: Tables) -> DataFrame:
    return rounded(S.history(t.events, ["user_id"], "event_id", "value").select("event_id", "previous", "mean_before"), 9)


@query("history_baseline", f"SELECT event_id, round(coalesce(lag(value) OVER w, g), 6) AS prediction FROM events, (SELECT avg(value) AS g FROM events) {W}")
def _(t: Tables) -> DataFrame:
    return rounded(S.history(t.events, ["user_id"], "event_id", "value").select("event_id", F.col("previous").alias("prediction")))


@query("leave_one_out_mean", "SELECT event_id, round((sum(value) OVER (PARTITION BY user_id) - value) / (count(*) OVER (PARTITION BY user_id) - 1), 10) AS others FROM events")
def _(t: Tables) -> DataFrame:
    return rounded(t.events.select("event_id", S.leave_one_out(["user_id"], "value").alias("others")), 10)


@query("carryover_lag", f"SELECT event_id, lag(event_type) OVER w AS before FROM events {W}")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", S.carryover(["user_id"], "event_id", "event_type").alias("before"))


@query("within_group_center", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 10) AS centered FROM events")
def _(t: Tables) -> DataFrame:
    return rounded(t.events.select("event_id", S.center(["user_id"], "value").alias("centered")), 10)


Z = "(value - avg(value) OVER (PARTITION BY user_id)) / nullif(stddev_pop(value) OVER (PARTITION BY user_id), 0)"


@query("within_group_zscore", f"SELECT event_id, round({Z}, 6) AS z FROM events")
def _(t: Tables) -> DataFrame:
    return rounded(t.events.select("event_id", S.zscore(["user_id"], "value").alias("z")))


@query("session_zscore_clip", f"SELECT event_id, round(greatest(-1.5, least(1.5, {Z})), 6) AS z FROM events")
def _(t: Tables) -> DataFrame:
    return rounded(t.events.select("event_id", S.zscore(["user_id"], "value", 1.5).alias("z")))


@query(
    "interpolate_missing",
    """WITH x AS (SELECT event_id, user_id, CASE WHEN event_id % 4 <> 0 THEN value END AS v FROM events),
       y AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER p AS pi, last_value(v IGNORE NULLS) OVER p AS pv, first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER n AS ni, first_value(v IGNORE NULLS) OVER n AS nv FROM x
       WINDOW p AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
       SELECT event_id, round(coalesce(v, CASE WHEN ni > pi THEN pv + (event_id - pi) / (ni - pi) * (nv - pv) END, pv, nv), 6) AS value FROM y""",
)
def _(t: Tables) -> DataFrame:
    x = t.events.select("event_id", "user_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value"))
    return rounded(S.interpolate(x, ["user_id"], "event_id", "value").select("event_id", "value"))


@query("reference_channels", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity - (l_discount + l_tax) / 2, 9) AS l_quantity FROM lineitem")
def _(t: Tables) -> DataFrame:
    return rounded(S.rereference(t.lineitem, ["l_quantity"], ["l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), 9)


@query("trailing_median", f"WITH {SAMPLES}, g AS (SELECT *, coalesce(ms - lag(ms) OVER (PARTITION BY participant ORDER BY ms, event_id) > {10 * HOUR}, FALSE)::INT AS gap FROM s), e AS (SELECT *, sum(gap) OVER (PARTITION BY participant ORDER BY ms, event_id) AS epoch FROM g) SELECT event_id, round(median(value) OVER (PARTITION BY participant, epoch ORDER BY ms, event_id ROWS 2 PRECEDING), 6) AS smooth FROM e")
def _(t: Tables) -> DataFrame:
    s = samples(t).withColumn("at", F.struct("ms", "event_id"))
    s = s.withColumn("gap", S.gap_flag(["participant"], "ms", "ms", 10 * HOUR))
    return rounded(S.smoothed(s, ["participant"], "at", "value", "gap").select("event_id", F.col("smooth")))


@query("rising_trend_flag", f"SELECT event_id, coalesce(lag(value, 2) OVER w < lag(value) OVER w AND lag(value) OVER w < value AND value - lag(value, 2) OVER w > 20, FALSE) AS rising FROM events {W}")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", S.rising(["user_id"], "event_id", "value", 20.0).alias("rising"))


@query("gap_flag", f"WITH {SAMPLES} SELECT event_id, coalesce(ms - lag(ms + 10000) OVER (PARTITION BY participant ORDER BY ms) > {10 * HOUR}, FALSE) AS gap FROM s")
def _(t: Tables) -> DataFrame:
    s = samples(t).withColumn("end", F.col("ms") + 10_000)
    return s.select("event_id", S.gap_flag(["participant"], "ms", "end", 10 * HOUR).alias("gap"))


@query("transition_reveal", f"WITH {CELL}, d AS (SELECT event_id, user_id, event_type, lag(event_type) OVER w AS b FROM events {W}) SELECT event_id, CASE WHEN b <> d.event_type THEN b END AS finished, round(v, 6) AS revealed FROM d LEFT JOIN c ON c.user_id = d.user_id AND c.event_type = CASE WHEN b <> d.event_type THEN b END")
def _(t: Tables) -> DataFrame:
    r = S.transition_reveal(t.events, cell(t), "user_id", "event_id", "event_type", "v")
    return rounded(r.select("event_id", "finished", "revealed"))


@query("dwell_runs", f"WITH d AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS ch FROM events {W}), r AS (SELECT *, sum(ch) OVER w AS run FROM d {W}) SELECT user_id, run::BIGINT AS run, event_type, count(*) AS length FROM r GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return S.dwell_runs(t.events, ["user_id"], "event_id", "event_type").select("user_id", "run", "event_type", "length")


@query("next_match", f"SELECT event_id, lead(event_type) OVER w = event_type AS matched FROM events {W}")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", S.next_match(["user_id"], "event_id", "event_type", "event_type").alias("matched"))


@query("ewma_residual", f"WITH {CELL}, l AS (SELECT user_id, list(v ORDER BY event_type) AS l FROM c GROUP BY 1) SELECT user_id, round(list_reduce(l, lambda s, x: 0.7 * s + 0.3 * x), 6) AS correction FROM l")
def _(t: Tables) -> DataFrame:
    return rounded(S.ewma(cell(t), ["user_id"], "event_type", "v", 0.3))


@query("evenly_spaced_downsample", "WITH d AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT event_id FROM d WHERE n <= 10 OR i = 0 OR i * 10 // n <> (i - 1) * 10 // n")
def _(t: Tables) -> DataFrame:
    return S.downsample(t.events, ["user_id"], "event_id", 10).select("event_id")


@query("group_optimum", f"WITH {CELL}, r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS r FROM c) SELECT user_id, arg_min(event_type, (m, event_type)) AS best, string_agg(event_type, ',' ORDER BY event_type) AS tied, max(n) AS score FROM r WHERE r = 1 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return R.group_optimum(cell(t), ["user_id"], "event_type", "n", "m")


@query("rank_default_condition", "SELECT event_type, round(avg(value), 6) AS mean FROM events GROUP BY 1 ORDER BY avg(value) DESC, event_type LIMIT 1")
def _(t: Tables) -> DataFrame:
    g = t.events.groupBy("event_type").agg(F.avg("value").alias("mean"))
    return rounded(R.first_by(g, [F.desc("mean"), F.col("event_type")]))


@query("pareto_frontier", "SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))")
def _(t: Tables) -> DataFrame:
    return R.pareto(t.part, "p_partkey", "p_size", "p_retailprice").select("p_partkey")


@query("topk_hit_regret", f"WITH {CELL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r, max(v) OVER (PARTITION BY user_id) AS best FROM c) SELECT user_id, CAST(max(v) = max(best) AS INTEGER) AS hit, round(max(best) - max(v), 6) AS regret FROM r WHERE r <= 3 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return rounded(R.topk_hit_regret(cell(t), ["user_id"], "event_type", "v", "n", 3))


@query("rank_features_by_correlation", "SELECT feature, round(r, 8) AS r FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS r FROM lineitem" for c in ("l_quantity", "l_tax", "l_discount", "l_partkey")) + ") ORDER BY r DESC, feature LIMIT 2")
def _(t: Tables) -> DataFrame:
    return rounded(R.rank_by_correlation(t.lineitem, ["l_quantity", "l_tax", "l_discount", "l_partkey"], "l_extendedprice", 2), 8)


@query("budget_flags", "WITH x AS (SELECT doc_id, n_chars, toxic FROM labels JOIN documents USING (doc_id)), n AS (SELECT count(*) AS n FROM x WHERE toxic = 1), f AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM x) SELECT count(*) AS flagged, count(*) FILTER (toxic = 1) AS hits, round(count(*) FILTER (toxic = 1) / max(n), 9) AS recall, round(count(*) FILTER (toxic = 1) / count(*), 9) AS precision FROM f, n WHERE r <= n")
def _(t: Tables) -> DataFrame:
    x = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return rounded(R.budget_flags(x, "n_chars", F.col("toxic") == 1, "doc_id"), 9)


@query("rank_candidates_safety_first", "SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY min(l_discount) = 0 DESC, count(*) DESC, round(avg(l_tax), 9), l_suppkey LIMIT 5")
def _(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey").agg((F.min("l_discount") == 0).alias("ok"), F.count("*").alias("n"), F.round(F.avg("l_tax"), 9).alias("e"))
    return R.first_by(g, [F.desc("ok"), F.desc("n"), F.col("e"), F.col("l_suppkey")], 5).select("l_suppkey")


@query("nearest_grid_condition", """WITH g AS (SELECT n AS number, (n - 1) // 3 AS i, (n - 1) % 3 AS f FROM (SELECT unnest(range(1, 10)) AS n)), p AS (SELECT event_id, value / 100 AS a, (event_id % 31) / 10.0 AS b FROM events),
d AS (SELECT event_id, number, row_number() OVER (PARTITION BY event_id ORDER BY round((a - i)**2 + (b - f)**2, 9), i + f, number) AS r FROM p, g) SELECT event_id, CAST(number AS INTEGER) AS number FROM d WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    n = F.col("id").cast("int")
    grid = t.spark.range(1, 10).select(n.alias("number"), F.floor((n - 1) / 3).alias("i"), ((n - 1) % 3).alias("f"))
    p = t.events.select("event_id", (F.col("value") / 100).alias("a"), ((F.col("event_id") % 31) / 10.0).alias("b"))
    return R.nearest_condition(p, grid, "event_id", "a", "b")


@query("inner_cv_ranking", "SELECT l_suppkey, round(avg(s), 9) AS score FROM (SELECT l_suppkey, l_linenumber, avg(l_discount) AS s FROM lineitem GROUP BY ALL) GROUP BY 1 ORDER BY round(avg(s), 9), l_suppkey LIMIT 3")
def _(t: Tables) -> DataFrame:
    f = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.avg("l_discount").alias("s")).groupBy("l_suppkey").agg(F.round(F.avg("s"), 9).alias("score"))
    return R.first_by(f, [F.col("score"), F.col("l_suppkey")], 3)


@query("union_by_name", "SELECT s_suppkey AS k, s_acctbal AS x, NULL::VARCHAR AS name FROM supplier UNION ALL SELECT n_nationkey, NULL, n_name FROM nation")
def _(t: Tables) -> DataFrame:
    return R.union_tables(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("x")), t.nation.select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name")))


@query("except_keys", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("intersect_keys", "SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150")
def _(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'view'").select("user_id").intersect(t.events.filter("event_type = 'purchase' and value > 150").select("user_id"))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return R.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])
