"""Queries of metrics and resampling. Truth is l_discount, prediction l_tax + 0.01, group l_suppkey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import resample as B
from tessera.plans.registry import Tables, draw_sql, query
from tessera.plans.summary_queries import CELL, cell
from tessera.plans.window_queries import rounded

REG = """count(*) AS n, round(avg(abs(p - t)), 9) AS mae, round(sqrt(avg((p - t)**2)), 9) AS rmse, round(1 - avg((p - t)**2) / var_pop(t), 6) AS r2, round(2 * covar_pop(t, p) / (var_pop(t) + var_pop(p) + (avg(t) - avg(p))**2), 6) AS ccc, round(corr(t, p), 6) AS pearson"""
X = "x AS (SELECT l_suppkey AS g, l_linenumber AS seed, l_orderkey AS k, l_discount AS t, l_tax + 0.01 AS p, l_quantity AS w FROM lineitem)"


def x(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_suppkey").alias("g"), F.col("l_linenumber").alias("seed"), F.col("l_orderkey").alias("k"), F.col("l_discount").alias("t"), (F.col("l_tax") + 0.01).alias("p"), F.col("l_quantity").alias("w"))


def reg(df: DataFrame, *keys: str) -> DataFrame:
    g = df.groupBy(*keys).agg(*M.regression(F.col("t"), F.col("p")))
    return g.select(*keys, "n", *[F.round(c, d).alias(c) for c, d in (("mae", 9), ("rmse", 9), ("r2", 6), ("ccc", 6), ("pearson", 6))])


@query("regression_metrics", f"WITH {X} SELECT {REG} FROM x")
def _(t: Tables) -> DataFrame:
    return reg(x(t))


@query("participant_metrics", f"WITH {X} SELECT g, seed, {REG} FROM x GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return reg(x(t), "g", "seed")


@query("spearman", f"WITH {X}, r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY t) + (count(*) OVER (PARTITION BY g, t) - 1) / 2.0 AS a, rank() OVER (PARTITION BY g ORDER BY p) + (count(*) OVER (PARTITION BY g, p) - 1) / 2.0 AS b FROM x) SELECT g, round(corr(a, b), 6) AS spearman, count(*) AS n FROM r GROUP BY g")
def _(t: Tables) -> DataFrame:
    return rounded(M.spearman(x(t), ["g"], "t", "p"))


BIN = "b AS (SELECT doc_id, toxic = 1 AS y, n_chars AS s, lang FROM labels JOIN documents USING (doc_id))"


def binary(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "n_chars", "lang"), "doc_id").select("doc_id", (F.col("toxic") == 1).alias("y"), F.col("n_chars").alias("s"), "lang")


@query("confusion_metrics", f"WITH {BIN}, c AS (SELECT lang, count(*) FILTER (y AND s > 900) AS tp, count(*) FILTER (NOT y AND s > 900) AS fp, count(*) FILTER (y AND s <= 900) AS fn, count(*) FILTER (NOT y AND s <= 900) AS tn FROM b GROUP BY 1) SELECT *, round(tp / nullif(tp + fn, 0), 9) AS recall, round(tn / nullif(tn + fp, 0), 9) AS specificity, round(tp / nullif(tp + fp, 0), 9) AS precision, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 9) AS balanced_accuracy FROM c")
def _(t: Tables) -> DataFrame:
    return rounded(binary(t).groupBy("lang").agg(*M.confusion(F.col("y"), F.col("s") > 900)), 9)


BY = "d AS (SELECT s, count(*) AS n, count(*) FILTER (y) AS pos FROM b GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY s DESC) AS na, sum(pos) OVER (ORDER BY s DESC) AS pa FROM d)"


@query("average_precision", f"WITH {BIN}, {BY} SELECT round(sum(pos * pa / na) / sum(pos), 9) AS average_precision FROM c")
def _(t: Tables) -> DataFrame:
    return rounded(M.average_precision(binary(t), "s", F.col("y")), 9)


@query("roc_auc", f"WITH {BIN} SELECT round(avg(CASE WHEN a.s > c.s THEN 1.0 WHEN a.s = c.s THEN 0.5 ELSE 0 END), 9) AS auc FROM b a JOIN b c ON a.y AND NOT c.y")
def _(t: Tables) -> DataFrame:
    return rounded(M.roc_auc(binary(t), "s", F.col("y")), 9)


@query("multiclass_f1", """WITH n AS (SELECT l_linenumber % 3 AS a, l_partkey % 4 AS b FROM lineitem), c AS (SELECT unnest(range(3)) AS c), f AS (SELECT c, (SELECT count(*) FROM n WHERE a = c) AS sup, (SELECT count(*) FROM n WHERE b = c) AS pr, (SELECT count(*) FROM n WHERE a = c AND b = c) AS hit FROM c)
SELECT round(sum(2 * hit / (sup + pr) * sup) / sum(sup), 9) AS weighted_f1, round(avg(2 * hit / (sup + pr)), 9) AS macro_f1, round(avg(hit / sup), 9) AS balanced_accuracy FROM f""")
def _(t: Tables) -> DataFrame:
    n = t.lineitem.select((F.col("l_linenumber") % 3).cast("bigint").alias("a"), (F.col("l_partkey") % 4).alias("b"))
    return rounded(M.multiclass_f1(n, "a", "b"), 9)


PAIRS = f"WITH {CELL}, p AS (SELECT a.user_id, a.v > b.v AS o, a.n > b.n AS q, a.n = b.n AS tie FROM c a JOIN c b ON a.user_id = b.user_id AND a.event_type < b.event_type AND a.v <> b.v)"


@query("ranking_accuracy_pooled", PAIRS + " SELECT round(avg(CASE WHEN o = q AND NOT tie THEN 1 ELSE 0 END), 9) AS accuracy, count(*) AS pairs FROM p")
def _(t: Tables) -> DataFrame:
    return rounded(M.pair_accuracy(cell(t), ["user_id"], "event_type", "v", "n"), 9)


@query("ranking_accuracy_macro", PAIRS + " SELECT round(avg(x), 9) AS accuracy, count(*) AS groups FROM (SELECT avg(CASE WHEN tie THEN 0.5 WHEN o = q THEN 1.0 ELSE 0.0 END) AS x FROM p GROUP BY user_id)")
def _(t: Tables) -> DataFrame:
    return rounded(M.pair_accuracy(cell(t), ["user_id"], "event_type", "v", "n", macro=True), 9)


@query("weighted_mae", f"WITH {X} SELECT g, round(sum(w * abs(p - t)) / sum(w), 9) AS mae FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return rounded(x(t).groupBy("g").agg(M.weighted_mae(F.col("t"), F.col("p"), F.col("w")).alias("mae")), 9)


@query("seed_metrics", f"""WITH {X}, a AS (SELECT seed, g, avg(abs(p - t)) AS m, sqrt(avg((p - t)**2)) AS r FROM x GROUP BY ALL), b AS (SELECT seed, avg(m) AS macro_mae, avg(r) AS macro_rmse, count(*) AS members FROM a GROUP BY 1), k AS (SELECT seed, {REG} FROM x GROUP BY 1)
SELECT seed::VARCHAR AS seed, 'seed' AS kind, n, mae, rmse, r2, ccc, pearson, round(macro_mae, 6) AS macro_mae, round(macro_rmse, 6) AS macro_rmse, members FROM k JOIN b USING (seed)
UNION ALL SELECT 'all', 'mean', sum(n)::BIGINT, round(avg(mae), 6), round(avg(rmse), 6), round(avg(r2), 4), round(avg(ccc), 4), round(avg(pearson), 4), round(avg(macro_mae), 6), round(avg(macro_rmse), 6), max(members) FROM k JOIN b USING (seed)
UNION ALL SELECT 'all', 'std', sum(n)::BIGINT, round(stddev_pop(mae), 6), round(stddev_pop(rmse), 6), round(stddev_pop(r2), 4), round(stddev_pop(ccc), 4), round(stddev_pop(pearson), 4), round(stddev_pop(macro_mae), 6), round(stddev_pop(macro_rmse), 6), max(members) FROM k JOIN b USING (seed)""")
def _(t: Tables) -> DataFrame:
    s = M.seed_metrics(x(t), "seed", "g", "t", "p").withColumn("seed", F.coalesce(F.col("seed").cast("string"), F.lit("all")))
    own = F.col("kind") == "seed"
    digits = {"mae": (9, 6), "rmse": (9, 6), "r2": (6, 4), "ccc": (6, 4), "pearson": (6, 4), "macro_mae": (6, 6), "macro_rmse": (6, 6)}
    return s.withColumns({c: F.when(own, F.round(c, a)).otherwise(F.round(c, b)) for c, (a, b) in digits.items()})


@query("seed_averaged_metrics", f"WITH {X}, a AS (SELECT g, k % 5 AS k, avg(t) AS t, avg(p) AS p, count(DISTINCT seed) AS s FROM x GROUP BY ALL) SELECT {REG} FROM a WHERE s >= 3")
def _(t: Tables) -> DataFrame:
    a = x(t).groupBy("g", F.col("k") % 5).agg(F.avg("t").alias("t"), F.avg("p").alias("p"), F.count_distinct("seed").alias("s")).filter("s >= 3")
    return reg(a)


@query("prefix_strata_metrics", f"WITH {X} SELECT CASE WHEN seed <= 2 THEN '1-2' WHEN seed <= 4 THEN '3-4' ELSE '5-7' END AS band, {REG} FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return reg(x(t).withColumn("band", F.when(F.col("seed") <= 2, "1-2").when(F.col("seed") <= 4, "3-4").otherwise("5-7")), "band")


@query("condition_level_metrics", f"WITH {X}, a AS (SELECT g, seed, avg(t) AS t, avg(p) AS p FROM x GROUP BY ALL) SELECT {REG} FROM a")
def _(t: Tables) -> DataFrame:
    return reg(x(t).groupBy("g", "seed").agg(F.avg("t").alias("t"), F.avg("p").alias("p")))


@query("baseline_comparison", f"WITH {X}, a AS (SELECT *, avg(t) OVER (PARTITION BY seed) AS c FROM x) SELECT 'model' AS model, round(avg(abs(p - t)), 9) AS mae FROM a UNION ALL SELECT 'condition_only', round(avg(abs(c - t)), 9) FROM a UNION ALL SELECT 'constant', round(avg(abs(0.05 - t)), 9) FROM a")
def _(t: Tables) -> DataFrame:
    c = x(t).groupBy("seed").agg(F.avg("t").alias("c"))
    j = x(t).join(F.broadcast(c), "seed")
    e = lambda name, p: F.struct(F.lit(name).alias("model"), F.avg(F.abs(p - F.col("t"))).alias("mae")).alias(name)
    a = j.agg(e("model", F.col("p")), e("condition_only", F.col("c")), e("constant", F.lit(0.05)))
    return rounded(a.select(F.inline(F.array("model", "condition_only", "constant"))), 9)


@query("threshold_sweep", f"WITH {BIN}, h AS (SELECT unnest([200.0, 900.0, 2000.0]) AS threshold), c AS (SELECT threshold, count(*) FILTER (y AND s >= threshold) AS tp, count(*) FILTER (NOT y AND s >= threshold) AS fp, count(*) FILTER (y AND s < threshold) AS fn FROM b, h GROUP BY 1) SELECT threshold::DOUBLE AS threshold, tp, fp, fn, row_number() OVER (ORDER BY fn, tp / nullif(tp + fn, 0) DESC NULLS LAST, tp / nullif(tp + fp, 0) DESC NULLS LAST, threshold) = 1 AS best FROM c")
def _(t: Tables) -> DataFrame:
    return M.threshold_sweep(binary(t), "s", F.col("y"), [200.0, 900.0, 2000.0]).select("threshold", "tp", "fp", "fn", "best")


@query("recall_constrained_threshold", f"WITH {BIN}, {BY}, r AS (SELECT s, pa / (SELECT sum(pos) FROM d) AS recall, pa / na AS precision FROM c) SELECT s, round(recall, 9) AS recall, round(precision, 9) AS precision FROM r WHERE recall >= 0.6 ORDER BY precision DESC, s DESC LIMIT 1")
def _(t: Tables) -> DataFrame:
    return rounded(M.recall_threshold(binary(t), "s", F.col("y"), 0.6), 9)


@query("interval_coverage", f"WITH {X}, r AS (SELECT seed, t - p AS r FROM x), q AS (SELECT f.seed, quantile_cont(r, 0.1) AS lo, quantile_cont(r, 0.9) AS hi FROM (SELECT DISTINCT seed FROM r) f JOIN r ON f.seed <> r.seed GROUP BY 1) SELECT seed, round(avg(CASE WHEN r BETWEEN lo - 1e-12 AND hi + 1e-12 THEN 1 ELSE 0 END), 3) AS coverage, round(avg(hi - lo), 6) AS width FROM r JOIN q USING (seed) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    d = x(t).withColumns({"t": F.round("t", 4), "p": F.round("p", 4)})
    c = M.interval_coverage(d, "seed", "t", "p", 0.8)
    return c.select("seed", F.round("coverage", 3).alias("coverage"), F.round("width", 6).alias("width"))


@query("controller_trace_metrics", f"""WITH s AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, 1 + CAST(floor(value) AS BIGINT) % 9 AS c, event_type, value FROM events), b AS (SELECT *, lag(c) OVER w AS b, coalesce(ms - lag(ms) OVER w > {36_000_000}, FALSE) AS gap FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
t AS (SELECT *, CASE WHEN c = b THEN 'hold' ELSE 'step' END AS action, CASE WHEN c = b THEN NULL WHEN abs((c - 1) // 3 - (b - 1) // 3) + abs((c - 1) % 3 - (b - 1) % 3) <> 1 THEN 'illegal' WHEN (c - 1) // 3 <> (b - 1) // 3 THEN 'i' ELSE 'f' END AS move FROM b WHERE b IS NOT NULL),
r AS (SELECT *, sum(CASE WHEN b = pb AND NOT gap THEN 0 ELSE 1 END) OVER w AS run FROM (SELECT *, lag(b) OVER w AS pb FROM t WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
l AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL), d AS (SELECT user_id, avg(n) AS m, max(n) AS x, count(*) FILTER (n > 2) AS k FROM l GROUP BY 1),
y AS (SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS reasons FROM (SELECT user_id, event_type, count(*) AS n FROM t WHERE action <> 'hold' GROUP BY ALL) GROUP BY 1)
SELECT t.user_id, count(*) FILTER (action <> 'hold') AS changes, count(DISTINCT c) AS conditions, count(*) FILTER (move = 'i') AS intensity_changes, count(*) FILTER (move = 'f') AS frequency_changes, count(*) FILTER (move = 'illegal') AS illegal, round(coalesce(1 - count(*) FILTER (move = 'illegal') / nullif(count(*) FILTER (action <> 'hold'), 0), 1), 6) AS legal_share,
count(*) FILTER (event_type = 'view' AND action = 'hold' AND value > 2) AS overstays, count(*) FILTER (action <> 'hold' AND c = 9 AND value > 50) AS locked_selections, count(*) FILTER (event_type = 'error' AND action <> 'hold') AS wrong_on_invalid, count(*) FILTER (action <> 'hold') >= 3 AND count(DISTINCT c) <= 2 AS bounce,
count(*) FILTER (action <> 'hold') >= 3 AND count(DISTINCT c) >= 3 AND count(*) FILTER (move = 'illegal') = 0 AS varied, round(any_value(m), 6) AS mean_dwell, any_value(x) AS longest_dwell, any_value(k) AS long_runs, any_value(reasons) AS reasons FROM t JOIN d USING (user_id) LEFT JOIN y USING (user_id) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    """A trace of conditions drawn from the values; types stand for state and reason."""
    from tessera.operators.sequence import carryover, gap_flag

    s = t.events.select("user_id", "event_id", F.unix_millis("ts").alias("ms"), (1 + F.floor("value") % 9).alias("after"), "event_type", "value")
    s = s.withColumns({"before": carryover(["user_id"], "event_id", "after"), "gap_reset": gap_flag(["user_id"], "ms", "ms", 36_000_000)}).filter("before is not null")
    trace = s.withColumns({
        "action": F.when(F.col("after") == F.col("before"), "hold").otherwise("step"), "reason": F.col("event_type"), "state": F.when(F.col("event_type") == "view", "active").otherwise("other"),
        "dwell": F.col("value"), "signal_valid": F.col("event_type") != "error", "c9_locked": F.col("value") > 50,
    })
    m = M.controller_trace(trace, ["user_id"], "event_id", 2)
    why = F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return rounded(m.withColumn("reasons", why))


@query("deployment_gate", f"WITH {X}, m AS (SELECT g, avg(abs(p - t)) AS mae, avg(abs(0.05 - t)) AS condition_only_mae, avg(abs(0.02 - t)) AS history_mae, corr(t, p) AS spearman FROM x GROUP BY 1) SELECT g, mae < condition_only_mae AND mae < history_mae AND spearman > 0 AS deployable, concat_ws(',', CASE WHEN NOT mae < condition_only_mae THEN 'not_better_than_condition_only' END, CASE WHEN NOT mae < history_mae THEN 'not_better_than_history' END, CASE WHEN NOT spearman > 0 THEN 'rank_correlation_not_positive' END) AS reasons FROM m")
def _(t: Tables) -> DataFrame:
    e = lambda p: F.avg(F.abs(p - F.col("t")))
    m = x(t).groupBy("g").agg(e(F.col("p")).alias("mae"), e(F.lit(0.05)).alias("condition_only_mae"), e(F.lit(0.02)).alias("history_mae"), M.correlation(F.col("t"), F.col("p")).alias("spearman"), F.lit(None).cast("double").alias("risk_recall"))
    return M.deployment_gate(m).select("g", "deployable", F.array_join("reasons", ",").alias("reasons"))


@query("win_tie_loss", f"WITH {CELL}, d AS (SELECT a.v - b.v AS d FROM c a JOIN c b USING (user_id) WHERE a.event_type = 'view' AND b.event_type = 'click') SELECT count(*) FILTER (d > 1) AS wins, count(*) FILTER (abs(d) <= 1) AS ties, count(*) FILTER (d < -1) AS losses FROM d")
def _(t: Tables) -> DataFrame:
    d = M.ablation_delta(cell(t), ["user_id"], "event_type", "click", "v").filter("event_type = 'view'")
    return d.agg(*M.win_tie_loss(F.col("delta"), 1.0))


@query("ablation_delta", f"WITH {CELL} SELECT a.user_id, a.event_type, round(a.v - b.v, 9) AS delta FROM c a JOIN c b USING (user_id) WHERE a.event_type <> 'click' AND b.event_type = 'click'")
def _(t: Tables) -> DataFrame:
    return rounded(M.ablation_delta(cell(t), ["user_id"], "event_type", "click", "v").select("user_id", "event_type", "delta"), 9)


@query("peak_match_f1")
def _(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_type", (F.unix_millis("ts") / 3_600_000).alias("t"))
    return M.peak_f1(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), ["user_id"], "t", 6.0)



U = "u AS (SELECT user_id, sum(value) AS s, count(*) AS n, avg(value) - 50 AS d FROM events GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS size FROM u), b AS (SELECT unnest(range(200)) AS b)"
BOOT = f"{U}, k AS (SELECT b, CAST(floor({draw_sql('7', 'b', 'i')} * size) AS BIGINT) AS i FROM i, b), e AS (SELECT b, sum({{0}}) / sum({{1}}) AS estimate FROM k JOIN i USING (i) GROUP BY 1)"


def clusters(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.sum("value").alias("s"), F.count("*").alias("n"), (F.avg("value") - 50).alias("d")).withColumn("one", F.lit(1))


@query("cluster_bootstrap", f"WITH {BOOT.format('s', 'n')} SELECT round(quantile_cont(estimate, 0.025), 6) AS low, round(quantile_cont(estimate, 0.975), 6) AS high, count(*) AS replicates FROM e")
def _(t: Tables) -> DataFrame:
    return rounded(B.interval(B.bootstrap_mean(clusters(t), "user_id", "s", "n", 200, 7)))


@query("paired_bootstrap", f"WITH {BOOT.format('d', '1')} SELECT round(quantile_cont(estimate, 0.025), 6) AS low, round(quantile_cont(estimate, 0.975), 6) AS high, count(*) AS replicates FROM e")
def _(t: Tables) -> DataFrame:
    return rounded(B.interval(B.bootstrap_mean(clusters(t), "user_id", "d", "one", 200, 7)))


@query("bootstrap_p_value", f"WITH {BOOT.format('d', '1')} SELECT least(1.0, 2 * least(avg(CASE WHEN estimate <= 0 THEN 1 ELSE 0 END), avg(CASE WHEN estimate >= 0 THEN 1 ELSE 0 END)))::DOUBLE AS p_value FROM e")
def _(t: Tables) -> DataFrame:
    return B.sign_p_value(B.bootstrap_mean(clusters(t), "user_id", "d", "one", 200, 7))


@query("argmax_stability", f"WITH {CELL}, {U}, k AS (SELECT b, CAST(floor({draw_sql('5', 'b', 'i')} * size) AS BIGINT) AS i FROM i, b), m AS (SELECT b, event_type, avg(v) AS m FROM k JOIN i USING (i) JOIN c USING (user_id) GROUP BY ALL), x AS (SELECT b, arg_max(event_type, (m, event_type)) AS event_type FROM m GROUP BY 1) SELECT event_type, count(*) / 200 AS share FROM x GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return B.argmax_stability(cell(t), "user_id", "event_type", "v", 200, 5)


FLIP = "a AS (SELECT n_regionkey AS k, avg(s_acctbal) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), b AS (SELECT n_regionkey AS k, avg(c_acctbal) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), f AS (SELECT k, (s - c) / 1000 AS d FROM a JOIN b USING (k)), j AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i FROM f)"


def flips(t: Tables) -> DataFrame:
    """Suppliers' mean balance less customers', by region."""
    region = F.broadcast(t.nation.select("n_nationkey", F.col("n_regionkey").alias("k")))
    mean = lambda df, nation, value: df.join(region, F.col(nation) == F.col("n_nationkey")).groupBy("k").agg(F.avg(value).alias(value))
    both = mean(t.supplier, "s_nationkey", "s_acctbal").join(mean(t.customer, "c_nationkey", "c_acctbal"), "k")
    return both.select("k", ((F.col("s_acctbal") - F.col("c_acctbal")) / 1000).alias("d"))


@query("exact_sign_flip", f"WITH {FLIP}, m AS (SELECT unnest(range((1 << (SELECT count(*) FROM j))::BIGINT)) AS m), s AS (SELECT m, abs(sum(CASE WHEN m & (1 << i)::BIGINT <> 0 THEN -d ELSE d END)) AS s FROM m, j GROUP BY 1) SELECT round(avg(CASE WHEN s >= (SELECT abs(sum(d)) FROM j) - 1e-9 THEN 1 ELSE 0 END), 9) AS p_value, count(*) AS patterns FROM s")
def _(t: Tables) -> DataFrame:
    return rounded(B.exact_sign_flip(flips(t), "k", "d"), 9)


@query("monte_carlo_sign_flip", f"WITH {U}, s AS (SELECT b, avg(CASE WHEN {draw_sql('3', 'b', 'user_id')} < 0.5 THEN -d ELSE d END) AS s FROM i, b GROUP BY 1), o AS (SELECT avg(d) AS o FROM u) SELECT round((count(*) FILTER (s >= o - 1e-12) + 1) / 201, 9) AS p_greater, round((count(*) FILTER (abs(s) >= abs(o) - 1e-12) + 1) / 201, 9) AS p_two_sided FROM s, o")
def _(t: Tables) -> DataFrame:
    return rounded(B.monte_carlo_sign_flip(clusters(t), "user_id", "d", 200, 3), 9)


P = "z AS (SELECT user_id AS k, event_type AS f, (avg(value) - 50) / (stddev_samp(value) / sqrt(count(*))) AS z FROM events GROUP BY ALL HAVING count(*) > 2 AND stddev_samp(value) > 0), p AS (SELECT k, f, 2 / (1 + exp(1.702 * abs(z))) AS p FROM z)"


def ps(t: Tables) -> DataFrame:
    """A test of every user and event type against a mean of 50; p by the logistic curve, which SQL can draw too."""
    z = (F.avg("value") - 50) / (F.stddev_samp("value") / F.sqrt(F.count("*").cast("double")))
    g = t.events.groupBy(F.col("user_id").alias("k"), F.col("event_type").alias("f")).agg(z.alias("z"), F.count("*").alias("n"), F.stddev_samp("value").alias("s")).filter("n > 2 and s > 0")
    return g.select("k", "f", (2 / (1 + F.exp(1.702 * F.abs("z")))).alias("p"))


@query("holm_adjust", f"WITH {P}, r AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY f) - row_number() OVER (PARTITION BY f ORDER BY p, k) + 1)) AS h FROM p) SELECT f, k, round(max(h) OVER (PARTITION BY f ORDER BY p, k), 6) AS p_holm FROM r")
def _(t: Tables) -> DataFrame:
    return rounded(B.holm(ps(t), ["f"], "p", "k").select("f", "k", "p_holm"), 6)


@query("bh_adjust", f"WITH {P}, r AS (SELECT *, least(1.0, p * count(*) OVER (PARTITION BY f) / row_number() OVER (PARTITION BY f ORDER BY p, k)) AS q FROM p) SELECT f, k, round(min(q) OVER (PARTITION BY f ORDER BY p, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS q_value FROM r")
def _(t: Tables) -> DataFrame:
    return rounded(B.benjamini_hochberg(ps(t), ["f"], "p", "k").select("f", "k", "q_value"), 6)


@query("rank_biserial", f"WITH {U}, r AS (SELECT user_id % 3 AS g, d, rank() OVER (PARTITION BY user_id % 3 ORDER BY abs(d)) + (count(*) OVER (PARTITION BY user_id % 3, abs(d)) - 1) / 2.0 AS r FROM u WHERE d <> 0), s AS (SELECT g, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM r GROUP BY 1) SELECT g, w_plus::DOUBLE AS w_plus, w_minus::DOUBLE AS w_minus, round((w_plus - w_minus) / (w_plus + w_minus), 9) AS rank_biserial FROM s")
def _(t: Tables) -> DataFrame:
    return rounded(B.rank_biserial(clusters(t).withColumn("g", F.col("user_id") % 3), ["g"], "d"), 9)


@query("paired_level_contrasts", f"""WITH {CELL}, d AS (SELECT a.event_type AS l, b.event_type AS r, a.v - b.v AS d FROM c a JOIN c b ON a.user_id = b.user_id AND a.event_type < b.event_type) SELECT l AS "left", r AS "right", round(avg(d), 6) AS difference, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, count(*) AS n FROM d GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return rounded(B.paired_contrasts(cell(t), "user_id", "event_type", "v").drop("p", "p_holm"))


@query("paired_level_contrasts_p")
def _(t: Tables) -> DataFrame:
    return B.paired_contrasts(cell(t), "user_id", "event_type", "v").select("left", "right", "t", "n", "p", "p_holm")


@query("rm_anova", """WITH c AS (SELECT l_suppkey % 10 AS s, l_linenumber % 2 AS a, l_partkey % 3 AS b, avg(l_quantity) AS y FROM lineitem GROUP BY ALL), m AS (SELECT *, avg(y) OVER () AS g, avg(y) OVER (PARTITION BY a) AS ma, avg(y) OVER (PARTITION BY s) AS ms, avg(y) OVER (PARTITION BY a, s) AS mas, avg(y) OVER (PARTITION BY b) AS mb, avg(y) OVER (PARTITION BY b, s) AS mbs, avg(y) OVER (PARTITION BY a, b) AS mab FROM c), d AS (SELECT DISTINCT s, b, mbs, ms FROM m), i AS (SELECT s, a || '-' || b AS l, y - mas - mbs + ms AS v FROM m)
SELECT 'a' AS effect, round(sum((ma - g)**2), 6) AS ss, 1.0::DOUBLE AS df1, 9.0::DOUBLE AS df2, round(sum((ma - g)**2) / (sum((mas - ma - ms + g)**2) / 9), 6) AS f, round(sum((ma - g)**2) / (sum((ma - g)**2) + sum((mas - ma - ms + g)**2)), 6) AS partial_eta2, 1.0::DOUBLE AS epsilon FROM m
UNION ALL SELECT 'b', round(sum((mb - g)**2), 6), 2.0, 18.0, round(sum((mb - g)**2) / 2 / (sum((mbs - mb - ms + g)**2) / 18), 6), round(sum((mb - g)**2) / (sum((mb - g)**2) + sum((mbs - mb - ms + g)**2)), 6), round((SELECT (sum(c) FILTER (l = r))**2 / (2 * sum(c * c)) FROM (SELECT x.b AS l, y.b AS r, covar_samp(x.mbs - x.ms, y.mbs - y.ms) AS c FROM d x JOIN d y USING (s) GROUP BY ALL)), 6) FROM m
UNION ALL SELECT 'ab', round(sum((mab - ma - mb + g)**2), 6), 2.0, 18.0, round(sum((mab - ma - mb + g)**2) / 2 / (sum((y - mab - mas - mbs + ma + mb + ms - g)**2) / 18), 6), round(sum((mab - ma - mb + g)**2) / (sum((mab - ma - mb + g)**2) + sum((y - mab - mas - mbs + ma + mb + ms - g)**2)), 6), round((SELECT (sum(c) FILTER (l = r))**2 / (2 * sum(c * c)) FROM (SELECT x.l, y.l AS r, covar_samp(x.v, y.v) AS c FROM i x JOIN i y USING (s) GROUP BY ALL)), 6) FROM m""")
def _(t: Tables) -> DataFrame:
    c = t.lineitem.select((F.col("l_suppkey") % 10).alias("s"), (F.col("l_linenumber") % 2).alias("a"), (F.col("l_partkey") % 3).alias("b"), F.col("l_quantity").alias("y0"))
    return rounded(B.rm_anova(c, "s", "a", "b", "y0").select("effect", "ss", "df1", "df2", "f", "partial_eta2", "epsilon"))


@query("rm_anova_p")
def _(t: Tables) -> DataFrame:
    c = t.lineitem.select((F.col("l_suppkey") % 10).alias("s"), (F.col("l_linenumber") % 2).alias("a"), (F.col("l_partkey") % 3).alias("b"), F.col("l_quantity").alias("y0"))
    return B.rm_anova(c, "s", "a", "b", "y0").select("effect", "f", "df1", "df2", "epsilon", "p", "p_gg")


@query("permute_within_condition", f"WITH a AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events), b AS (SELECT event_type, value AS shuffled, row_number() OVER (PARTITION BY event_type ORDER BY {draw_sql('11', 'event_id')}, event_id) AS n FROM events) SELECT event_id, shuffled FROM a JOIN b USING (event_type, n)")
def _(t: Tables) -> DataFrame:
    return B.permute_within(t.events.select("event_id", "event_type", "value"), ["event_type"], "event_id", "value", 11).select("event_id", "shuffled")


@query("random_uniform_baseline", f"WITH {U}, e AS (SELECT b, avg(abs({draw_sql('2', 'b', 'user_id')} - (d / 100 + 0.5))) AS estimate FROM i, b GROUP BY 1) SELECT round(quantile_cont(estimate, 0.025), 9) AS low, round(quantile_cont(estimate, 0.975), 9) AS high, count(*) AS replicates FROM e")
def _(t: Tables) -> DataFrame:
    return rounded(B.interval(B.uniform_baseline(clusters(t).withColumn("y", F.col("d") / 100 + 0.5), "user_id", "y", 200, 2)), 9)


@query("lopo_split_manifest", """WITH u AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier) SELECT CAST(f.i AS INTEGER) AS fold_index, u.k AS s_suppkey, CASE WHEN u.i = f.i THEN 'test' WHEN u.i = (f.i + 1) % u.n THEN 'validation' ELSE 'train' END AS role FROM u, u f""")
def _(t: Tables) -> DataFrame:
    return B.lopo_manifest(t.supplier, "s_suppkey")
