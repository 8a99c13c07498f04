"""Queries of anchors, calibration, models and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import models as L
from tessera.operators import resample as B
from tessera.operators.resample import modular_folds
from tessera.plans.metric_queries import X, x
from tessera.plans.registry import Tables, draw_sql, query
from tessera.plans.summary_queries import CELL, cell
from tessera.plans.window_queries import rounded

FOLDS = "f AS (SELECT fold, user_id, CASE WHEN user_id % 5 = fold THEN 'test' WHEN user_id % 5 = (fold + 1) % 5 THEN 'validation' ELSE 'train' END AS role FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(5)) AS fold))"


def folds(t: Tables) -> DataFrame:
    return modular_folds(t.events.select("user_id").distinct(), "user_id", 5)


@query("condition_anchor", f"WITH {FOLDS} SELECT fold, event_type, round(avg(value), 6) AS anchor FROM events JOIN f USING (user_id) WHERE role = 'train' GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return rounded(L.condition_anchor(t.events.select("user_id", "event_type", "value"), folds(t), "user_id", "event_type", "value"))


@query("cross_fitted_anchor", "SELECT event_id, round((sum(value) OVER (PARTITION BY event_type) - sum(value) OVER (PARTITION BY event_type, user_id)) / (count(*) OVER (PARTITION BY event_type) - count(*) OVER (PARTITION BY event_type, user_id)), 6) AS anchor FROM events")
def _(t: Tables) -> DataFrame:
    return rounded(t.events.select("event_id", L.peer_anchor(["event_type"], "user_id", "value").alias("anchor")))


@query("random_condition_baseline", f"""WITH {FOLDS}, a AS (SELECT fold, event_type, avg(value) AS a FROM events JOIN f USING (user_id) WHERE role = 'train' GROUP BY ALL), l AS (SELECT fold, list(a ORDER BY event_type) AS l FROM a GROUP BY 1), c AS (SELECT user_id, event_id, value FROM events), b AS (SELECT unnest(range(20)) AS b),
e AS (SELECT fold, b, avg(abs(l[1 + CAST(floor({draw_sql("13", "b", "event_id")} * len(l)) AS BIGINT)] - value)) AS mae FROM c JOIN f USING (user_id) JOIN l USING (fold), b WHERE role = 'test' GROUP BY ALL)
SELECT fold, round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_std, round(quantile_cont(mae, 0.025), 6) AS mae_low, round(quantile_cont(mae, 0.975), 6) AS mae_high, count(*) AS replicates FROM e GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    a = L.condition_anchor(t.events.select("user_id", "event_type", "value"), folds(t), "user_id", "event_type", "value")
    test = t.events.join(folds(t).filter("role = 'test'"), "user_id")
    e = B.random_option_baseline(test, a, ["fold"], "event_id", "event_type", "anchor", "value", 20, 13)
    q = lambda p: F.percentile("mae", p)
    return rounded(e.groupBy("fold").agg(F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"), q(0.025).alias("mae_low"), q(0.975).alias("mae_high"), F.count("*").alias("replicates")))


@query("modal_share_null", f"""WITH {CELL}, o AS (SELECT user_id, arg_max(event_type, (v, event_type)) AS best FROM c GROUP BY 1), w AS (SELECT max(n) / sum(n) AS modal_share FROM (SELECT count(*) AS n FROM o GROUP BY best)), m AS (SELECT event_type, avg(v) AS m, row_number() OVER (ORDER BY event_type) - 1 AS o FROM c GROUP BY 1), r AS (SELECT stddev_samp(v - m.m) AS residual_sd FROM c JOIN m USING (event_type)),
d AS (SELECT b, user_id, event_type, round(m.m + residual_sd * sqrt(-2 * ln(1 - {draw_sql('21', 'b', 'user_id', 'o', '1')})) * cos(2 * pi() * {draw_sql('21', 'b', 'user_id', 'o', '2')}), 9) AS v FROM (SELECT DISTINCT user_id FROM c), m, r, (SELECT unnest(range(40)) AS b)),
k AS (SELECT b, user_id, arg_max(event_type, (v, event_type)) AS best FROM d GROUP BY ALL), s AS (SELECT b, max(n) / sum(n) AS share FROM (SELECT b, count(*) AS n FROM k GROUP BY b, best) GROUP BY 1)
SELECT round(modal_share, 9) AS modal_share, round(avg(share), 9) AS null_mean, round(quantile_cont(share, 0.025), 9) AS null_low, round(quantile_cont(share, 0.975), 9) AS null_high, avg(CASE WHEN share <= modal_share THEN 1 ELSE 0 END)::DOUBLE AS p_value, round(any_value(residual_sd), 6) AS residual_sd FROM s, w, r GROUP BY modal_share""")
def _(t: Tables) -> DataFrame:
    r = B.modal_share_null(cell(t), "user_id", "event_type", "v", 40, 21)
    return rounded(r.withColumn("residual_sd", F.round("residual_sd", 6)), 9)


@query("residualize_by_condition", "WITH l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS place FROM embeddings), m AS (SELECT label, place, avg(x) AS m FROM l WHERE vec_id % 4 <> 0 GROUP BY ALL) SELECT vec_id, CAST(place AS INTEGER) AS place, round(x - m, 6) AS value FROM l JOIN m USING (label, place)")
def _(t: Tables) -> DataFrame:
    return rounded(L.residualize(t.embeddings, ["vec_id"], "label", "embedding", F.col("vec_id") % 4 != 0))


@query("fold_impute_scale", f"WITH {FOLDS}, j AS (SELECT fold, role, event_id, CASE WHEN event_id % 6 <> 0 THEN value END AS v FROM events JOIN f USING (user_id)), s AS (SELECT fold, quantile_cont(v, 0.5) FILTER (role = 'train') AS md FROM j GROUP BY 1), k AS (SELECT j.*, coalesce(v, md) AS w FROM j JOIN s USING (fold)), m AS (SELECT fold, avg(w) FILTER (role = 'train') AS m, stddev_pop(w) FILTER (role = 'train') AS sd FROM k GROUP BY 1) SELECT fold, event_id, round((w - m) / sd, 6) AS value FROM k JOIN m USING (fold)")
def _(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("value"))
    return rounded(L.impute_scale(e, folds(t), "user_id", "value").select("fold", "event_id", "value"))


@query("sparse_feature_filter", "WITH s AS (SELECT avg(CASE WHEN isfinite(l_quantity) THEN 1 ELSE 0 END) AS l_quantity, avg(CASE WHEN l_returnflag = 'R' AND isfinite(l_tax) THEN 1 ELSE 0 END) AS half, avg(CASE WHEN isfinite(l_tax) THEN 1 ELSE 0 END) AS l_tax FROM lineitem) SELECT feature FROM (UNPIVOT s ON l_quantity, half, l_tax INTO NAME feature VALUE share) WHERE share >= 0.8")
def _(t: Tables) -> DataFrame:
    d = t.lineitem.withColumn("half", F.when(F.col("l_returnflag") == "R", F.col("l_tax")))
    kept = L.dense_columns(d, ["l_quantity", "half", "l_tax"], 0.8)
    return t.spark.createDataFrame([(c,) for c in kept], "feature string")


@query("correlation_filter", """WITH d AS (SELECT *, l_quantity * 2 + l_tax * 0.01 AS twice FROM lineitem), r AS (SELECT abs(corr(l_quantity, twice)) < 0.95 AS ab, abs(corr(l_quantity, l_tax)) < 0.95 AS ac, abs(corr(twice, l_tax)) < 0.95 AS bc FROM d)
SELECT 'l_quantity' AS feature FROM r UNION ALL SELECT 'twice' FROM r WHERE ab UNION ALL SELECT 'l_tax' FROM r WHERE ac AND (NOT ab OR bc)""")
def _(t: Tables) -> DataFrame:
    d = t.lineitem.withColumn("twice", F.col("l_quantity") * 2 + F.col("l_tax") * 0.01)
    return t.spark.createDataFrame([(c,) for c in L.uncorrelated_columns(d, ["l_quantity", "twice", "l_tax"])], "feature string")


@query("lopo_residual_ridge", f"""WITH {X}, o AS (SELECT g, seed AS c, count(*)::DOUBLE AS n, sum(t) AS st, sum(p) AS sp, sum(w) AS sw FROM x GROUP BY ALL), z AS (SELECT c, sum(n) AS n, sum(st) AS st, sum(sp) AS sp, sum(sw) AS sw FROM o GROUP BY 1), u AS (SELECT DISTINCT g FROM x),
m AS (SELECT u.g, z.c, z.n - coalesce(o.n, 0) AS n, z.sp - coalesce(o.sp, 0) AS sp, z.sw - coalesce(o.sw, 0) AS sw, (z.st - coalesce(o.st, 0)) / (z.n - coalesce(o.n, 0)) AS m FROM u CROSS JOIN z LEFT JOIN o ON o.g = u.g AND o.c = z.c),
k AS (SELECT g, sum(n) AS n, sum(sp * m) AS pm, sum(sw * m) AS wm FROM m GROUP BY 1), a AS (SELECT g, sum(p) AS p, sum(w) AS w, sum(p * p) AS pp, sum(w * w) AS ww, sum(p * w) AS pw, sum(p * t) AS pt, sum(w * t) AS wt FROM x GROUP BY 1), tot AS (SELECT sum(p) AS p, sum(w) AS w, sum(pp) AS pp, sum(ww) AS ww, sum(pw) AS pw, sum(pt) AS pt, sum(wt) AS wt FROM a),
s AS (SELECT a.g, n, (tot.p - a.p) / n AS mp, (tot.w - a.w) / n AS mw, sqrt((tot.pp - a.pp) / n - ((tot.p - a.p) / n)**2) AS dp, sqrt((tot.ww - a.ww) / n - ((tot.w - a.w) / n)**2) AS dw, (tot.pw - a.pw) / n - (tot.p - a.p) / n * ((tot.w - a.w) / n) AS cov, tot.pt - a.pt - pm AS rp, tot.wt - a.wt - wm AS rw FROM a JOIN k USING (g), tot),
b AS (SELECT *, n * cov / (dp * dw) AS q, rp / dp AS b1, rw / dw AS b2 FROM s), f AS (SELECT *, ((n + 25) * b1 - q * b2) / ((n + 25)**2 - q * q) AS w1, ((n + 25) * b2 - q * b1) / ((n + 25)**2 - q * q) AS w2 FROM b)
SELECT x.g, round(avg(abs(t - greatest(0, least(1, m.m + (x.p - mp) / dp * w1 + (x.w - mw) / dw * w2)))), 6) AS mae FROM x JOIN f USING (g) JOIN m ON m.g = x.g AND m.c = x.seed GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    d, f, levels = x(t), [F.col("p"), F.col("w")], list(range(1, 8))
    p = L.predict_residual(d, L.lopo_residual_ridge(d, "g", "seed", levels, f, F.col("t"), 25.0), "g", "seed", levels, f)
    return rounded(p.groupBy("g").agg(F.avg(F.abs(F.col("t") - F.col("prediction"))).alias("mae")))


PENALTIES = [10.0, 300.0, 3000.0, 30000.0]
INNER = 4
RIDGE = f"""WITH {X}, o AS (SELECT g, seed AS c, count(*)::DOUBLE AS n, sum(t) AS st, sum(p) AS sp, sum(w) AS sw FROM x GROUP BY ALL), a AS (SELECT g, sum(p) AS p, sum(w) AS w, sum(p * p) AS pp, sum(w * w) AS ww, sum(p * w) AS pw, sum(p * t) AS pt, sum(w * t) AS wt FROM x GROUP BY 1),
u AS (SELECT DISTINCT x.g, i.k FROM x, (SELECT unnest(range({INNER + 1})) AS k) i), m AS (SELECT u.g, u.k, c, sum(n) AS n, sum(sp) AS sp, sum(sw) AS sw, sum(st) / sum(n) AS m FROM u JOIN o ON o.g <> u.g AND o.g % {INNER} <> u.k GROUP BY ALL),
z AS (SELECT g, k, sum(n) AS n, sum(sp * m) AS pm, sum(sw * m) AS wm FROM m GROUP BY ALL), tot AS (SELECT u.g, u.k, sum(p) AS p, sum(w) AS w, sum(pp) AS pp, sum(ww) AS ww, sum(pw) AS pw, sum(pt) AS pt, sum(wt) AS wt FROM u JOIN a ON a.g <> u.g AND a.g % {INNER} <> u.k GROUP BY ALL),
s AS (SELECT g, k, n, p / n AS mp, w / n AS mw, sqrt(pp / n - (p / n)**2) AS dp, sqrt(ww / n - (w / n)**2) AS dw, pw / n - p / n * (w / n) AS cov, pt - pm AS rp, wt - wm AS rw FROM tot JOIN z USING (g, k)),
b AS (SELECT *, n * cov / (dp * dw) AS q, rp / dp AS b1, rw / dw AS b2 FROM s), f AS (SELECT g, k, a, mp, mw, dp, dw, ((n + a) * b1 - q * b2) / ((n + a)**2 - q * q) AS w1, ((n + a) * b2 - q * b1) / ((n + a)**2 - q * q) AS w2 FROM b, (SELECT unnest({PENALTIES})::DOUBLE AS a)),
e AS (SELECT f.g, f.k, a, avg((x.t - m.m - (x.p - mp) / dp * w1 - (x.w - mw) / dw * w2)**2) AS mse FROM x JOIN f ON f.g <> x.g AND x.g % {INNER} = f.k JOIN m ON m.g = f.g AND m.k = f.k AND m.c = x.seed GROUP BY ALL),
r AS (SELECT g, a, avg(mse) AS mse, row_number() OVER (PARTITION BY g ORDER BY avg(mse), a) AS place FROM e GROUP BY g, a), v AS (SELECT f.g, any_value(mp) AS mp, any_value(mw) AS mw, any_value(dp) AS dp, any_value(dw) AS dw, avg(w1) AS w1, avg(w2) AS w2 FROM f JOIN r USING (g, a) WHERE k = {INNER} AND place <= 3 GROUP BY 1)"""


def ridge(t: Tables) -> DataFrame:
    return L.lopo_ridge_blend(x(t), "g", F.col("g") % INNER, "seed", list(range(1, 8)), [F.col("p"), F.col("w")], F.col("t"), PENALTIES)


@query("lopo_ridge", RIDGE + f" SELECT x.g, round(avg(abs(t - greatest(0, least(1, m.m + (x.p - mp) / dp * w1 + (x.w - mw) / dw * w2)))), 6) AS mae FROM x JOIN v USING (g) JOIN m ON m.g = x.g AND m.k = {INNER} AND m.c = x.seed GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Penalties ranked by inner folds, the best three averaged."""
    p = L.predict_residual(x(t), ridge(t), "g", "seed", list(range(1, 8)), [F.col("p"), F.col("w")])
    return rounded(p.groupBy("g").agg(F.avg(F.abs(F.col("t") - F.col("prediction"))).alias("mae")))


@query("lopo_ridge_ranking", RIDGE + " SELECT g, a AS penalty, CAST(place AS INTEGER) AS place, round(mse, 9) AS mse FROM r")
def _(t: Tables) -> DataFrame:
    r = ridge(t).select("g", F.posexplode(F.arrays_zip("ranked", "scores")).alias("place", "r"))
    return rounded(r.select("g", F.col("r.ranked").alias("penalty"), (F.col("place") + 1).alias("place"), F.col("r.scores").alias("mse")), 9)


@query("lopo_surface_ols", f"WITH {X}, m AS (SELECT g, (sum(sum(t)) OVER () - sum(t)) / (sum(count(*)) OVER () - count(*)) AS m FROM x GROUP BY g) SELECT round(avg(abs(t - m)), 9) AS grand_mean_mae FROM x JOIN m USING (g)")
def _(t: Tables) -> DataFrame:
    d = x(t)
    f = L.surface_terms(F.col("seed") % 3, F.col("k") % 3, "grand_mean")
    return rounded(L.predict_linear(d, L.lopo_linear(d, "g", f, F.col("t")), "g", f).agg(F.avg(F.abs(F.col("t") - F.col("prediction"))).alias("grand_mean_mae")), 9)


@query("lopo_surface_models")
def _(t: Tables) -> DataFrame:
    d, out = x(t), None
    for kind in ("bilinear", "quadratic", "cells"):
        f = L.surface_terms((F.col("seed") % 3).cast("double"), (F.col("k") % 3).cast("double"), kind)
        p = L.predict_linear(d, L.lopo_linear(d, "g", f, F.col("t")), "g", f).agg(F.lit(kind).alias("model"), F.avg(F.abs(F.col("t") - F.col("prediction"))).alias("mae"))
        out = p if out is None else out.union(p)
    return out


@query("within_ols", f"WITH {X}, c AS (SELECT p - avg(p) OVER (PARTITION BY g) AS a, t - avg(t) OVER (PARTITION BY g) AS b FROM x) SELECT round(sum(a * b) / sum(a * a), 9) AS slope, round(corr(a, b)**2, 9) AS r2, count(*) AS n FROM c")
def _(t: Tables) -> DataFrame:
    return rounded(L.within_ols(x(t), "g", "p", "t"), 9)


@query("lopo_risk_logistic")
def _(t: Tables) -> DataFrame:
    """Every supplier's rows by the model of all other suppliers."""
    d = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax", (F.col("l_extendedprice") > 30_000).cast("double").alias("risk"))
    p = L.risk_logistic(d, "l_suppkey", "risk", [F.col("l_discount"), F.col("l_tax"), F.col("l_partkey"), F.col("l_linenumber")])
    return rounded(p.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "risk", "probability"), 9)


def residual_rows(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_suppkey") % 3).alias("fold"), F.col("l_linenumber").alias("condition"), "l_quantity", "l_partkey", "l_tax", (F.col("l_extendedprice") / 110_000).alias("y"))


@query("residual_anchors", "WITH r AS (SELECT l_suppkey % 3 AS fold, l_linenumber AS condition, l_extendedprice / 110000 AS y FROM lineitem), f AS (SELECT DISTINCT fold FROM r) SELECT f.fold, condition, round(avg(y), 9) AS anchor FROM r JOIN f ON f.fold <> r.fold GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return rounded(L.residual_anchors(residual_rows(t), "fold", "condition", "y"), 9)


def residual_errors(t: Tables, kind: str, features: list[str]) -> DataFrame:
    p = L.residual_regressor(L.assemble(residual_rows(t), features), "fold", "condition", "y", kind)
    return p.groupBy("fold").agg(F.avg(F.abs(F.col("prediction") - F.col("y"))).alias("mae"), F.count("*").alias("n"))


@query("lopo_tree_regressor")
def _(t: Tables) -> DataFrame:
    return residual_errors(t, "forest", ["l_quantity", "l_partkey"])


@query("lopo_boosted_regressor")
def _(t: Tables) -> DataFrame:
    return residual_errors(t, "boosted", ["l_quantity", "l_partkey"])


@query("elastic_net_regressor")
def _(t: Tables) -> DataFrame:
    return residual_errors(t, "elastic_net", ["l_quantity", "l_partkey", "l_tax"])


@query("pairwise_ranker")
def _(t: Tables) -> DataFrame:
    return L.pairwise_ranker(cell(t).withColumn("n", F.col("n").cast("double")), ["user_id"], "event_type", "v", ["n", "m"])


@query("calibration_blend", f"""WITH {CELL}, z AS (SELECT user_id, event_type, v, coalesce((n - avg(n) OVER w) / nullif(stddev_pop(n) OVER w, 0), 0) AS a, coalesce((m - avg(m) OVER w) / nullif(stddev_pop(m) OVER w, 0), 0) AS b FROM c WINDOW w AS (PARTITION BY user_id)),
p AS (SELECT x.v > y.v AS up, x.a - y.a AS da, x.b - y.b AS db FROM z x JOIN z y ON x.user_id = y.user_id AND x.event_type < y.event_type AND x.v <> y.v), k AS (SELECT i / 10.0::DOUBLE AS weight FROM (SELECT unnest(range(11)) AS i)), s AS (SELECT weight, avg(CASE WHEN (weight * da + (1 - weight) * db > 0) = up THEN 1 ELSE 0 END) AS accuracy FROM p, k GROUP BY 1)
SELECT weight, round(accuracy, 9) AS accuracy, row_number() OVER (ORDER BY accuracy DESC, weight) = 1 AS best FROM s""")
def _(t: Tables) -> DataFrame:
    return rounded(L.blend(cell(t), ["user_id"], "event_type", "v", "n", "m"), 9)


@query("personal_bias_calibration", "WITH d AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), b AS (SELECT *, avg(CASE WHEN n <= 3 THEN value - 50 END) OVER (PARTITION BY user_id) AS bias FROM d) SELECT event_id, round(50 + bias, 6) AS calibrated FROM b WHERE n > 3")
def _(t: Tables) -> DataFrame:
    e = t.events.withColumn("pred", F.lit(50.0))
    return rounded(L.personal_bias(e, "user_id", "event_id", "value", "pred", 3).select("event_id", "calibrated"))


@query("empirical_bayes_bias", """WITH g AS (SELECT user_id, avg(value - 50) AS m, count(*) AS n, var_samp(value - 50) AS v FROM events GROUP BY 1), t AS (SELECT sum(m) AS sm, sum(m*m) AS smm, sum(n) AS sn, sum(v * (n - 1)) AS sv, count(*) AS k FROM g),
o AS (SELECT user_id, m, n, k - 1 AS k, sm - m AS sm, smm - m*m AS smm, sn - n AS sn, sv - v * (n - 1) AS sv FROM g, t), p AS (SELECT *, sv / (sn - k) AS sigma, (smm - sm*sm / k) / (k - 1) AS bt FROM o), q AS (SELECT *, greatest(0, bt - sigma / (sn / k)) AS tau FROM p)
SELECT user_id, round(m * tau / (tau + sigma / n), 6) AS bias FROM q""")
def _(t: Tables) -> DataFrame:
    return rounded(L.empirical_bayes(t.events.withColumn("pred", F.lit(50.0)), "user_id", "value", "pred").select("user_id", "bias"))


@query("simplex_late_fusion")
def _(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("t"), F.col("l_tax").alias("a"), F.lit(0.05).alias("b"), (F.col("l_quantity") / 500).alias("c"))
    w = L.late_fusion(d, ["a", "b", "c"], "t", 0.05)
    holed = d.withColumn("a", F.when(F.col("l_orderkey") % 4 != 0, F.col("a")))
    return holed.select("l_orderkey", "l_linenumber", "l_partkey", L.fuse(["a", "b", "c"], w).alias("prediction"))


@query("condition_balanced_weights", "SELECT event_id, round(1.0 / count(*) OVER (PARTITION BY user_id, event_type), 9) AS weight FROM events")
def _(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    return rounded(t.events.select("event_id", (1.0 / F.count("*").over(Window.partitionBy("user_id", "event_type"))).alias("weight")), 9)


@query("weighted_pca")
def _(t: Tables) -> DataFrame:
    mean, comp, _ = L.pca(t.embeddings, "embedding", 64, 3, F.lit(1.0) + F.col("label") / 10)
    return t.embeddings.select("vec_id", L.project("embedding", mean, comp).alias("components"))


@query("spectrum_effective_rank")
def _(t: Tables) -> DataFrame:
    import numpy as np

    values = np.linalg.eigvalsh(L.covariance(t.embeddings, "embedding", 64)[1])
    return t.embeddings.agg(F.count("*").alias("n")).withColumn("effective_rank", F.lit(L.effective_rank(values)))


@query("embedding_covariance", """WITH l AS (SELECT vec_id, 1.0 + label / 10 AS w, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), n AS (SELECT sum(1.0 + label / 10) AS n FROM embeddings), m AS (SELECT i, sum(w * x) / any_value(n) AS m FROM l, n GROUP BY 1), p AS (SELECT a.i, b.i AS j, sum(a.w * a.x * b.x) AS s FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL)
SELECT CAST(p.i AS INTEGER) AS i, CAST(p.j AS INTEGER) AS j, round(s / n - a.m * b.m, 9) AS cov FROM p, n JOIN m a ON a.i = p.i JOIN m b ON b.i = p.j""")
def _(t: Tables) -> DataFrame:
    _, c = L.covariance(t.embeddings, "embedding", 64, F.lit(1.0) + F.col("label") / 10)
    return t.spark.createDataFrame([(i, j, round(float(c[i, j]), 9)) for i in range(64) for j in range(i, 64)], "i int, j int, cov double")


CKA = "p AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS s FROM l a JOIN l b ON a.vec_id = b.vec_id GROUP BY ALL), c AS (SELECT p.i, p.j, s - n * a.m * b.m AS c FROM p, n JOIN m a ON a.i = p.i JOIN m b ON b.i = p.j) SELECT n, round(sum(c * c) FILTER (i < 32 AND j >= 32) / sqrt(sum(c * c) FILTER (i < 32 AND j < 32) * sum(c * c) FILTER (i >= 32 AND j >= 32)), 6) AS cka FROM c, n GROUP BY n"


@query("linear_cka", f"WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), n AS (SELECT count(*) AS n FROM embeddings), m AS (SELECT i, avg(x) AS m FROM l GROUP BY 1), {CKA}")
def _(t: Tables) -> DataFrame:
    return t.embeddings.agg(F.count("*").alias("n")).withColumn("cka", F.round(F.lit(L.linear_cka(t.embeddings, "embedding", 32, 64)), 6))


@query("linear_cka_residual", f"WITH r AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS y, unnest(range(len(embedding))) AS i FROM embeddings), l AS (SELECT vec_id, i, y - avg(y) OVER (PARTITION BY label, i) AS x FROM r), n AS (SELECT count(*) AS n FROM embeddings), m AS (SELECT i, avg(x) AS m FROM l GROUP BY 1), {CKA}")
def _(t: Tables) -> DataFrame:
    """After the fixed effects of the label."""
    return t.embeddings.agg(F.count("*").alias("n")).withColumn("cka", F.round(F.lit(L.linear_cka(t.embeddings, "embedding", 32, 64, ["label"])), 6))


def probe(t: Tables, fold: str) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    e = t.embeddings.select("vec_id", F.col("label").cast("double").alias("label"), (F.col("vec_id") % 3).alias("subject"), array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))

    def fit(train: DataFrame, held: object):
        return LogisticRegression(labelCol="label", regParam=0.05, maxIter=15).fit(train).transform

    return L.per_fold(e, fold, fit)


@query("leakage_audit")
def _(t: Tables) -> DataFrame:
    """One target, whether the label is in the upper half, under three hold-outs."""
    e = t.embeddings.select("vec_id", (F.col("vec_id") % 4).alias("subject"), (F.floor(F.col("vec_id") / 4) % 3).alias("task"), (F.col("label") >= 5).cast("double").alias("target"), "embedding")
    return L.leakage_audit(e, "subject", "task", "target", F.col("embedding"))


@query("stimulus_probe")
def _(t: Tables) -> DataFrame:
    return probe(t, "subject").groupBy("label", F.col("prediction").alias("predicted")).agg(F.count("*").alias("n"))


@query("knn_probe", """WITH v AS (SELECT vec_id, vec_id % 5 AS s, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, s, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM v),
p AS (SELECT a.vec_id AS q, b.vec_id, b.label, round(list_inner_product(a.v, b.v), 9) AS c FROM n a JOIN n b ON a.s <> b.s), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, vec_id) AS r FROM p), w AS (SELECT q, label, count(*) AS n, sum(c) AS s FROM r WHERE r <= 5 GROUP BY ALL)
SELECT e.vec_id, e.label, arg_max(w.label, (n, s)) AS predicted FROM w JOIN embeddings e ON e.vec_id = w.q GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    e = t.embeddings.withColumn("s", F.col("vec_id") % 5)
    return L.knn_probe(e, "vec_id", "s", "label", "embedding", 5)


@query("knn_probe_indexed")
def _(t: Tables) -> DataFrame:
    """The vote of the neighbours that an index of cells finds."""
    e = t.embeddings.withColumn("s", F.col("vec_id") % 5)
    return L.knn_indexed(e, "vec_id", "s", "label", "embedding", 5)
