"""Brute force for models, spectra, test tables and hashes."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions import special as P
from tessera.operators import decide as C
from tessera.operators import features as X
from tessera.operators import metrics as M
from tessera.operators import models as L
from tessera.operators import quality as Q
from tessera.operators import resample as B
from tessera.sources import tables as T


def area(f, a, b, n=200_001):
    x = np.linspace(a, b, n)
    y = f(x)
    return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())


def t_tail(t, df):
    c = math.gamma((df + 1) / 2) / math.sqrt(df * math.pi) / math.gamma(df / 2)
    return 1 - 2 * area(lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2), 0, abs(t))


def f_tail(f, a, b):
    c = math.exp(math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2)) * (a / b) ** (a / 2)
    # x = u ** 8, as the density of few degrees of freedom has no bound at 0
    return 1 - area(lambda u: 8 * u**7 * c * np.maximum(u, 1e-300) ** (8 * (a / 2 - 1)) * (1 + a * u**8 / b) ** (-(a + b) / 2), 1e-9, f ** (1 / 8))


def test_tails_same_as_integrals(spark):
    ts = [(0.0, 5.0), (1.3, 2.0), (-2.5, 9.0), (4.0, 40.0)]
    got = spark.createDataFrame(ts, "t double, d double").select("t", "d", P.student_p(F.col("t"), F.col("d")).alias("p")).collect()
    assert all(abs(r.p - t_tail(r.t, r.d)) < 1e-6 for r in got)
    fs = [(0.5, 2.0, 16.0), (3.1, 2.0, 8.0), (2.0, 4.0, 30.0), (9.0, 3.0, 12.0)]
    got = spark.createDataFrame(fs, "f double, a double, b double").select("*", P.fisher_p(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect()
    assert all(abs(r.p - f_tail(r.f, r.a, r.b)) < 1e-4 for r in got)
    assert spark.range(1).select(P.student_p(F.lit(None), F.lit(3))).first()[0] is None


def test_contrasts_have_p_and_holm(spark):
    rng = np.random.default_rng(4)
    rows = [(s, e, v, float(rng.normal() + 0.6 * v)) for s in range(12) for e in ("x", "y") for v in range(3)]
    got = B.paired_contrasts(spark.createDataFrame(rows, "s int, e string, l int, v double"), "s", "l", "v", "e").collect()
    assert len(got) == 6
    for e in ("x", "y"):
        own = {(r.left, r.right): r for r in got if r.e == e}
        ps = {}
        for a, b in own:
            d = np.array([[v for s_, e_, l, v in rows if s_ == s and e_ == e and l == k][0] for k in (a, b) for s in range(12)]).reshape(2, 12)
            d = d[0] - d[1]
            t = d.mean() / (d.std(ddof=1) / math.sqrt(12))
            ps[a, b] = t_tail(t, 11)
            assert abs(own[a, b].t - t) < 1e-9 and abs(own[a, b].p - ps[a, b]) < 1e-6
        most = 0
        for i, k in enumerate(sorted(ps, key=ps.get)):
            most = max(most, min(1, ps[k] * (3 - i)))
            assert abs(own[k].p_holm - most) < 1e-5


def test_anova_epsilon_same_as_contrasts(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=(11, 3, 4)) + rng.normal(size=(11, 1, 1)) + np.arange(3)[None, :, None] * rng.normal(size=(11, 1, 1))
    rows = [(s, a, b, float(y[s, a, b])) for s in range(11) for a in range(3) for b in range(4)]
    got = {r.effect: r for r in B.rm_anova(spark.createDataFrame(rows, "s int, a int, b int, y double"), "s", "a", "b", "y").collect()}

    def contrasts(k):
        q = np.linalg.qr(np.column_stack((np.ones(k), np.eye(k)[:, : k - 1])))[0]
        return q[:, 1:].T

    for name, t in {"a": y.mean(axis=2) @ contrasts(3).T, "b": y.mean(axis=1) @ contrasts(4).T, "ab": y.reshape(11, 12) @ np.kron(contrasts(3), contrasts(4)).T}.items():
        c = np.cov(t.T)
        eps = np.trace(c) ** 2 / (len(c) * np.trace(c @ c))
        r = got[name]
        assert abs(r.epsilon - eps) < 1e-9 and r.df1 == len(c) and r.df2 == len(c) * 10
        assert abs(r.p - f_tail(r.f, r.df1, r.df2)) < 1e-4 and abs(r.p_gg - f_tail(r.f, r.df1 * eps, r.df2 * eps)) < 1e-3


def welch(x, rate, n):
    h = np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / n) for i in range(n)])
    out = []
    for a in range(0, len(x) - n + 1, n - n // 2):
        seg = (x[a : a + n] - x[a : a + n].mean()) * h
        p = np.array([abs(sum(seg[j] * np.exp(-2j * math.pi * k * j / n) for j in range(n))) ** 2 for k in range(n // 2 + 1)]) / (rate * (h**2).sum())
        p[1 : -1 if n % 2 == 0 else None] *= 2
        out.append(p)
    return np.arange(n // 2 + 1) * rate / n, np.mean(out, axis=0)


def test_spectra_same_as_sums(spark):
    rng = np.random.default_rng(6)
    data = {c: rng.normal(size=300) + a * np.sin(2 * math.pi * 10 * np.arange(300) / 100) for c, a in (("l", 2.0), ("r", 0.5))}
    df = spark.createDataFrame([("w", c, i, float(v)) for c, x in data.items() for i, v in enumerate(x)], "k string, ch string, t long, v double")
    spec = X.spectrum(df, ["k", "ch"], "t", "v", 100.0, 100)
    bands = X.band_power(spec, ["k", "ch"])
    got = {r.ch: r for r in bands.collect()}
    slope = {r.ch: r.aperiodic_slope for r in X.aperiodic_slope(spec, ["k", "ch"]).collect()}
    de = {r.ch: r.d for r in bands.select("ch", X.differential_entropy(F.col("alpha")).alias("d")).collect()}
    for c, x in data.items():
        f, p = welch(x, 100.0, 100)
        trap = lambda m: float(((p[m][1:] + p[m][:-1]) / 2 * np.diff(f[m])).sum())  # noqa: B023, E731
        alpha, total = trap((f >= 8) & (f < 13)), trap((f >= 1) & (f <= 45))
        q = p[(f >= 1) & (f <= 45)]
        q = q / q.sum()
        assert abs(got[c].alpha - alpha) < 1e-9 and abs(got[c].alpha_share - alpha / total) < 1e-9
        assert abs(got[c].spectral_entropy + (q * np.log2(q)).sum() / np.log2(len(q))) < 1e-9
        m = (f >= 2) & (f <= 40) & ~((f >= 8) & (f < 13))
        assert abs(slope[c] - np.polyfit(np.log10(f[m]), np.log10(p[m]), 1)[0]) < 1e-9
        assert abs(de[c] - 0.5 * math.log(2 * math.pi * math.e * alpha)) < 1e-9
    h = X.hemispheric(bands, ["k"], "ch", ["l"], ["r"]).first()
    assert h.alpha_asymmetry < 0 and abs(h.alpha_asymmetry - math.log(got["r"].alpha / got["l"].alpha)) < 1e-6
    e = X.motion_entropy(df.filter("ch = 'l'"), ["k"], "t", "v", 100.0).first().spectral_entropy
    _, p = welch(data["l"], 100.0, 64)
    assert abs(e + (p / p.sum() * np.log2(p / p.sum())).sum() / np.log2(len(p))) < 1e-9


def test_short_and_broken_windows_have_no_motion(spark):
    rows = [("a", 0.0, 1.0, 1.0, 1.0), ("a", 1.0, 1.0, None, 1.0), ("a", 2.0, 1.0, 1.0, 2.0), ("b", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, t double, x double, y double, z double")
    h = {r.k: r for r in X.head_motion(df, ["k"], "t", "x", "y", "z").collect()}
    assert h["a"].head_speed__mean is None and h["a"].head_coverage == 0 and not h["b"].head_usable
    g = {r.k: r for r in X.gaze_motion(df, ["k"], "t", "x", "y", "z").collect()}
    assert abs(g["a"].eye_valid_fraction - 2 / 3) < 1e-12 and g["a"].eye_scanpath is None and g["b"].eye_valid_fraction == 0


def test_residual_ridge_same_as_two_steps(spark):
    rng = np.random.default_rng(7)
    n = 300
    g, c, x = rng.integers(0, 6, n), rng.integers(0, 4, n), rng.normal(size=(n, 2)) * [1, 20] + [0, 5]
    y = 0.4 + 0.05 * c + 0.03 * x[:, 0] - 0.002 * x[:, 1] + 0.01 * rng.normal(size=n)
    df = spark.createDataFrame([(int(a), int(b), float(u), float(v), float(t)) for a, b, (u, v), t in zip(g, c, x, y, strict=True)], "g int, c int, u double, v double, y double")
    f = [F.col("u"), F.col("v")]
    models = L.lopo_residual_ridge(df, "g", "c", [0, 1, 2, 3], f, F.col("y"), 10.0)
    got = L.predict_residual(df, models, "g", "c", [0, 1, 2, 3], f).collect()
    for h in range(6):
        t = g != h
        means = np.array([y[t & (c == k)].mean() for k in range(4)])
        mu, sd = x[t].mean(axis=0), x[t].std(axis=0)
        z = (x - mu) / sd
        w = np.linalg.solve(z[t].T @ z[t] + 10 * np.eye(2), z[t].T @ (y - means[c])[t])
        want = np.clip(means[c] + z @ w, 0, 1)
        own = sorted((r.u, r.prediction) for r in got if r.g == h)
        assert np.allclose(own, sorted(zip(x[~t, 0], want[~t], strict=True)), atol=1e-9)


def newton(x, y, reg):
    """Balanced logistic weights of one training set, a fit of its own."""
    a, sd = np.column_stack((np.ones(len(x)), x)), x.std(axis=0)
    share = np.where(y > 0.5, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    pen, w = np.diag(np.concatenate(([0.0], reg * sd**2))), np.zeros(a.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-a @ w))
        w = w + np.linalg.solve((a * (share * q * (1 - q))[:, None]).T @ a + pen, a.T @ (share * (y - q)) - pen @ w)
    return w


@pytest.mark.parametrize("keys", [["g"], ["g", "h"]])
def test_logistic_folds_equal_fits_of_their_own(spark, keys):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 25)), int(rng.integers(0, 4)), *(float(v) for v in (a, 40 + 9 * b, c)), float(a - b + e > 0.4)) for i, (a, b, c, e) in enumerate(rng.normal(size=(900, 4)))]
    rows += [(9001, None, 1, 0.0, 0.0, 0.0, 1.0), (9002, 1, 1, None, 0.0, 0.0, 1.0), (9003, 1, 1, float("nan"), 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, "i int, g int, h int, a double, b double, c double, y double").repartition(5)
    got = {r.i: r.probability for r in L.held_out_logistic(df, keys, "y", [F.col(c) for c in "abc"]).collect()}
    good = [r for r in rows if r[0] < 9000]
    x, y, at = np.array([r[3:6] for r in good]), np.array([r[6] for r in good]), np.array([[r[1], r[2]][: len(keys)] for r in good])
    models = {}
    for r, k in zip(good, map(tuple, at.tolist()), strict=True):
        train = (at != np.array(k)).all(axis=1)
        w = models[k] if k in models else models.setdefault(k, newton(x[train], y[train], 0.01))
        assert abs(got[r[0]] - 1 / (1 + np.exp(-(w[0] + w[1:] @ np.array(r[3:6]))))) < 1e-6
    assert len(models) == (25 if len(keys) == 1 else 100) and [got[i] for i in (9001, 9002, 9003)] == [None] * 3


def test_logistic_of_a_thousand_groups_and_of_one_class(spark):
    df = spark.range(4000).select((F.col("id") % 1000).alias("g"), F.col("id").alias("i"), F.sin("id").alias("x"), (F.sin("id") + 0.3 * F.cos(F.col("id") * 7) > 0).cast("double").alias("y"))
    p = L.risk_logistic(df, "g", "y", [F.col("x")])
    assert p.filter("(probability > 0.5) = (y > 0.5)").count() > 3600
    assert L.risk_logistic(df.withColumn("y", F.lit(1.0)), "g", "y", [F.col("x")]).filter("probability is not null").count() == 0
    assert L.risk_logistic(df.limit(0), "g", "y", [F.col("x")]).count() == 0


def test_logistic_of_many_groups_holds_rows_against_their_own_alone(spark, monkeypatch):
    """But for a group that is a third of the rows and the few whose weights lie far from all rows'; one group is of one class, one feature is constant."""
    from tessera.operators import folds as H

    rng = np.random.default_rng(5)
    g = np.where(rng.random(40_000) < 0.3, 7, rng.integers(0, 300, 40_000))
    x = np.column_stack((rng.normal(size=40_000), 5000 + 700 * rng.exponential(size=40_000), np.full(40_000, 0.1)))
    y = (x[:, 0] - x[:, 1] / 700 + rng.normal(size=40_000) > -8) & (g != 3)
    df = spark.createDataFrame([(int(a), *map(float, b), float(c), i) for i, (a, b, c) in enumerate(zip(g, x, y, strict=True))], "g int, a double, b double, c double, y double, i int").repartition(5)
    held, fit = [], H._fit
    monkeypatch.setattr(H, "_fit", lambda rows, folds, *rest: held.append(len(folds)) or fit(rows, folds, *rest))
    got = {r.i: r.probability for r in L.risk_logistic(df, "g", "y", [F.col("a"), F.col("b"), F.col("c")]).collect()}
    assert len(held) == 1 and 1 <= held[0] < 30 and len(got) == len(x)
    for k in (0, 3, 7, 299):
        t = g != k
        w = newton(x[t, :2], y[t].astype(float), 0.01)
        want = 1 / (1 + np.exp(-(w[0] + x[~t, :2] @ w[1:])))
        assert np.allclose([got[i] for i in np.flatnonzero(~t)], want, rtol=0, atol=1e-9)


def residual_frame(spark, n=500):
    """A condition's level plus what two features add, within 0 and 1."""
    rng = np.random.default_rng(8)
    rows = [(i, i % 3, int(c), float(a), float(b), float(np.clip(0.3 + 0.1 * c + 0.1 * a - 0.05 * b + 0.01 * e, 0, 1))) for i, (a, b, e, c) in enumerate(zip(*rng.normal(size=(3, n)), rng.integers(0, 4, n), strict=True))]
    return L.assemble(spark.createDataFrame(rows, "i int, fold int, c int, a double, b double, y double"), ["a", "b"]), rows


@pytest.mark.parametrize("kind", ["forest", "boosted", "elastic_net"])
def test_residual_models_learn_and_leave_the_fold_out(spark, kind):
    df, rows = residual_frame(spark)
    got = {r.i: r.prediction for r in L.residual_regressor(df, "fold", "c", "y", kind).collect()}
    anchor = {(f, c): np.mean([r[5] for r in rows if r[1] != f and r[2] == c]) for f in range(3) for c in range(4)}
    assert len(got) == len(rows) and all(0 <= v <= 1 for v in got.values())
    error, base = (np.mean([abs(p - r[5]) for p, r in zip(ps, rows, strict=True)]) for ps in ([got[r[0]] for r in rows], [anchor[r[1], r[2]] for r in rows]))
    assert error < (0.75 if kind != "elastic_net" else 0.5) * base
    other = df.withColumn("y", F.when(F.col("fold") == 1, 1 - F.col("y")).otherwise(F.col("y")))
    again = {r.i: r.prediction for r in L.residual_regressor(other, "fold", "c", "y", kind).filter("fold = 1").collect()}
    assert all(abs(got[i] - v) < 1e-9 for i, v in again.items())
    if kind == "forest":
        found = {(r.fold, r.c): r.anchor for r in L.residual_anchors(df, "fold", "c", "y").collect()}
        assert found.keys() == anchor.keys() and all(abs(found[k] - v) < 1e-12 for k, v in anchor.items())


def test_boosted_trees_of_cells_are_those_of_rows(spark, monkeypatch):
    """A feature of many values, one of 50 and one of three; a fit passes over cells that are fewer than the rows."""
    from pyspark.ml.regression import GBTRegressor

    rng = np.random.default_rng(11)
    rows = [(i, int(f), int(c), float(a), int(b), int(k), float(0.4 + 0.1 * np.tanh(a) + 0.002 * b - 0.05 * k + 0.02 * c + 0.02 * e)) for i, (f, c, a, b, k, e) in enumerate(zip(rng.integers(0, 3, 6000), rng.integers(0, 4, 6000), rng.normal(size=6000).round(1), rng.integers(0, 50, 6000), rng.integers(0, 3, 6000), rng.normal(size=6000), strict=True))]
    df = L.assemble(spark.createDataFrame(rows, "i int, fold int, c int, a double, b int, k int, y double"), ["a", "b", "k"])
    seen, fit = [], GBTRegressor.fit
    with monkeypatch.context() as m:
        m.setattr(GBTRegressor, "fit", lambda self, d: seen.append(d.count()) or fit(self, d))
        out = L.residual_regressor(df, "fold", "c", "y", "boosted")
    assert sorted(out.columns) == sorted([*df.columns, "prediction"]) and len(seen) == 3 and max(seen) < 2900
    got = {r.i: r.prediction for r in out.collect()}
    for f in (0, 1, 2):
        anchor = L.residual_anchors(df, "fold", "c", "y").filter(F.col("fold") == f).select("c", "anchor")
        train, test = (df.filter(which).join(anchor, "c").withColumn("r", F.col("y") - F.col("anchor")) for which in (F.col("fold") != f, F.col("fold") == f))
        model = GBTRegressor(labelCol="r", predictionCol="p", maxIter=10, maxDepth=3, seed=7).fit(train)
        want = {r.i: min(1.0, max(0.0, r.anchor + r.p)) for r in model.transform(test).collect()}
        assert want.keys() == {r[0] for r in rows if r[1] == f} and all(abs(got[i] - v) < 1e-9 for i, v in want.items())


def test_ridge_of_ranked_penalties_equals_nested_fits(spark):
    """Rows of every inner fold are scored by fits of their own; a condition that a fold lacks takes the mean."""
    rng = np.random.default_rng(4)
    rows = [(int(g), int(c), *(float(v) for v in x), float(0.4 + 0.1 * c + 0.05 * x[0] - 0.03 * x[2] + 0.05 * e)) for g, c, x, e in zip(rng.integers(0, 14, 400), rng.integers(0, 3, 400), rng.normal(size=(400, 3)), rng.normal(size=400), strict=True)]
    rows.append((3, 3, 0.0, 0.0, 0.0, 0.9))
    df = spark.createDataFrame(rows, "g int, c int, a double, b double, d double, y double")
    penalties = [0.1, 5.0, 50.0, 500.0, 5000.0]
    got = {r.g: r for r in L.lopo_ridge_blend(df, "g", F.col("g") % 4, "c", [0, 1, 2, 3], [F.col(k) for k in "abd"], F.col("y"), penalties).collect()}
    m = np.array(rows)

    def fit(train, alpha):
        means = {c: train[train[:, 1] == c, 5].mean() if (train[:, 1] == c).any() else train[:, 5].mean() for c in range(4)}
        x = train[:, 2:5]
        mu, sd = x.mean(axis=0), x.std(axis=0)
        left = train[:, 5] - np.array([means[c] for c in train[:, 1]])
        z = (x - mu) / sd
        return means, mu, sd, np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ left)

    for g in range(14):
        rest = m[m[:, 0] != g]
        score = []
        for alpha in penalties:
            errors = []
            for k in range(4):
                test, train = rest[rest[:, 0] % 4 == k], rest[rest[:, 0] % 4 != k]
                means, mu, sd, w = fit(train, alpha)
                errors.append(np.mean([(r[5] - means[r[1]] - (r[2:5] - mu) / sd @ w) ** 2 for r in test]))
            score.append(np.mean(errors))
        order = np.argsort(score, kind="stable")
        assert got[g].ranked == [penalties[i] for i in order] and np.allclose(got[g].scores, np.array(score)[order])
        w = np.mean([fit(rest, penalties[i])[3] for i in order[:3]], axis=0)
        assert np.allclose(np.array(got[g].coefficients[4:]).reshape(3, 3)[:, 2], w)


def test_too_many_folds_raise(spark):
    with pytest.raises(ValueError):
        L.per_fold(spark.range(10), "id", lambda d, f: lambda r: r, 5)


def test_ranker_and_blend(spark):
    rng = np.random.default_rng(9)
    rows = [(g, i, float(t), float(t + 0.1 * e), float(z)) for g in range(20) for i, (t, e, z) in enumerate(rng.normal(size=(5, 3)))]
    df = spark.createDataFrame(rows, "g int, i int, t double, a double, b double")
    score = {(r.g, r.i): r.score for r in L.pairwise_ranker(df, ["g"], "i", "t", ["a", "b"]).collect()}
    right = [(score[g, i] > score[g, j]) == (t > u) for g, i, t, _, _ in rows for h, j, u, _, _ in rows if g == h and i < j]
    assert np.mean(right) > 0.9
    got = {round(r.weight, 1): r for r in L.blend(df, ["g"], "i", "t", "a", "b").collect()}
    z = {}
    for g in range(20):
        own = np.array([(a, b) for h, _, _, a, b in rows if h == g])
        z |= {(g, i): v for i, v in enumerate((own - own.mean(axis=0)) / own.std(axis=0))}
    for w in range(11):
        mix = lambda k: w / 10 * z[k][0] + (1 - w / 10) * z[k][1]  # noqa: B023, E731
        want = np.mean([(mix((g, i)) > mix((g, j))) == (t > u) for g, i, t, _, _ in rows for h, j, u, _, _ in rows if g == h and i < j])
        assert abs(got[w / 10].accuracy - want) < 1e-9
    assert sum(r.best for r in got.values()) == 1


def test_neighbours_by_blocks_same_as_brute_force(spark):
    rng = np.random.default_rng(10)
    v = rng.integers(-2, 3, size=(90, 3)).astype(float) + 0.1
    rows = [(i, i % 4, int(x.sum() > 0), x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "k long, s int, l int, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for i in range(90):
        near = sorted((-round(float(unit[i] @ unit[j]), 9), j) for j in range(90) if j % 4 != i % 4)[:5]
        votes = {}
        for c, j in near:
            n, s = votes.get(rows[j][2], (0, 0.0))
            votes[rows[j][2]] = (n + 1, s - c)
        want[i] = max(votes, key=votes.get)
    for block in (1000, 16):
        assert {r.k: r.predicted for r in L.knn_probe(df, "k", "s", "l", "v", 5, block).collect()} == want


def test_scores_in_ranges_same_as_one_sort(spark):
    rng = np.random.default_rng(11)
    rows = [(float(round(s, 2)), bool(y)) for s, y in zip(rng.normal(size=800), rng.random(800) < 0.3, strict=True)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    got = {r.s: (r.n, r.pos, r.n_above, r.pos_above) for r in M.by_score(df, "s", F.col("y")).collect()}
    assert got == {s: (sum(a == s for a, _ in rows), sum(a == s and y for a, y in rows), sum(a >= s for a, _ in rows), sum(a >= s and y for a, y in rows)) for s in {a for a, _ in rows}}
    assert M.by_score(df.limit(0), "s", F.col("y")).count() == 0


def test_hashes_of_files_and_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"some bytes")
    declared = spark.createDataFrame([("a.txt", hashlib.sha256(b"some bytes").hexdigest()), ("b.txt", "0")], "name string, sha256 string")
    assert {r.name: r.ok for r in T.checksums(spark, str(tmp_path), declared).collect()} == {"a.txt": True, "b.txt": False}
    df = spark.createDataFrame([(i, None if i % 3 else f"t{i}") for i in range(50)], "a long, b string")
    h = lambda d: T.content_hash(d).first().content_hash
    assert h(df) == h(df.orderBy(F.desc("a")).select("b", "a").repartition(7)) and len({h(df), h(df.union(df.limit(1))), h(df.withColumn("a", F.col("a") + 1)), h(df.limit(49))}) == 4


def test_leakage_shows_by_what_is_held_out(spark):
    """A cue of the subject and one of the task, each enough to tell the target while its key is among the training rows."""
    rng = np.random.default_rng(12)
    rows = [(s, k, float(rng.permutation(2)[0] if (s + k) % 5 == 0 else s in (0, 3, 4)), *(1.0 if s == j else 0.0 for j in range(6))) for s in range(6) for k in range(4) for _ in range(15)]
    df = spark.createDataFrame(rows, "s int, task int, y double, " + ", ".join(f"f{j} double" for j in range(6)))
    got = {r.hold_out: r for r in L.leakage_audit(df, "s", "task", "y", [F.col(f"f{j}") for j in range(6)], 0.01).collect()}
    assert set(got) == {"subject", "task", "subject_task"} and all(r.n == len(rows) for r in got.values())
    assert got["task"].accuracy > 0.8 and got["subject"].accuracy < 0.6 and got["subject_task"].accuracy < 0.6


def test_moments_skip_vectors_of_another_length(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 6))
    df = spark.createDataFrame([(v.tolist(), float(i % 5)) for i, v in enumerate(x)] + [(None, 1.0), ([1.0], 1.0)], "v array<double>, w double").repartition(6)
    mean, c = L.covariance(df, "v", 6, F.col("w"))
    w = np.arange(700) % 5
    assert np.allclose(mean, np.average(x, axis=0, weights=w)) and np.allclose(c, np.cov(x.T, aweights=w, ddof=0))


def test_degenerate_embeddings_are_named(spark):
    rng = np.random.default_rng(13)
    good = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 4)))], "k long, v array<double>")
    flat = good.withColumn("v", F.transform("v", lambda x: F.lit(1.0) + x * 1e-6))
    a, b = Q.embedding_sanity(good, "k", "v").first(), Q.embedding_sanity(flat, "k", "v").first()
    assert a.verdict == "USABLE" and abs(a.cosine_mean) < 0.1 and a.pairs > 200 and b.verdict == "DEGENERATE" and b.dead_places == 4


def test_picks_follow_their_weights(spark):
    scores = [0.3, 0.1, 0.25]
    options = F.array(*[F.struct(F.lit(i + 1).alias("candidate"), F.lit(s).alias("score")) for i, s in enumerate(scores)])
    n = spark.range(3000).select(C.weighted_pick(options, (F.col("id") + 0.5) / 3000).alias("c")).groupBy("c").count().collect()
    w = np.array([C.FLOOR + math.exp((s - 0.3) / C.TEMPERATURE) for s in scores])
    assert all(abs(r["count"] / 3000 - w[r.c - 1] / w.sum()) < 1e-3 for r in n)
    empty = F.array().cast("array<struct<candidate:int,score:double>>")
    assert spark.range(1).select(C.weighted_pick(empty, F.lit(0.5))).first()[0] is None


def test_sketched_quartiles_are_near(spark):
    df = spark.range(10_000).withColumn("v", F.col("id").cast(DoubleType()))
    a, b = df.agg(*X.robust_stats("v")).first(), df.agg(*X.robust_stats("v", accuracy=1000)).first()
    assert abs(a.v__median - b.v__median) <= 20 and abs(a.v__iqr - b.v__iqr) <= 40 and a.v__mean == b.v__mean


def test_estimates_without_a_contract(spark):
    df = spark.createDataFrame([(1.0, 0.5, 1.5, "participant"), (1.0, 1.2, 1.5, "window"), (1.0, None, None, None)], "estimate double, ci_low double, ci_high double, inference_unit string")
    got = sorted(map(str, (r.violations for r in C.estimate_problems(df).collect())))
    assert got == sorted(map(str, [["window_as_unit", "interval_off_estimate"], ["ci_low", "ci_high", "inference_unit"]]))
    assert C.estimate_problems(df.drop("ci_low")).count() == 3


def test_every_pattern_counts_in_a_sign_flip(spark):
    d = [0.5, -0.2, 0.9, 0.4]
    got = B.exact_sign_flip(spark.createDataFrame(list(enumerate(d)), "k long, d double"), "k", "d").first()
    hits = [abs(sum(s * x for s, x in zip(signs, d, strict=True))) >= abs(sum(d)) - 1e-9 for signs in itertools.product((1, -1), repeat=4)]
    assert got.patterns == 16 and got.p_value == np.mean(hits)


def test_quantiles_by_counting(spark):
    """Ties, null keys, a group that holds most rows, groups of one value, nulls and an empty table."""
    from tessera.operators.ranges import quantiles

    rng = np.random.default_rng(21)
    rows = [(None if i % 50 == 0 else int(rng.integers(0, 4)) if i % 3 else 7, int(i % 2), None if i % 11 == 0 else float(np.round(rng.normal() * 3, 1))) for i in range(3000)] + [(9, 0, 2.5), (8, 1, None)]
    df = spark.createDataFrame(rows, "g int, h int, v double").repartition(6)
    shares = {"low": 0.05, "mid": 0.5, "high": 0.975, "least": 0.0, "most": 1.0}
    got = {(r.g, r.h): tuple(r[k] for k in ("n", *shares)) for r in quantiles(df, ["g", "h"], "v", shares).collect()}
    want = {}
    for k in {r[:2] for r in rows}:
        v = [r[2] for r in rows if r[:2] == k and r[2] is not None]
        if v:
            want[k] = (len(v), *np.quantile(v, list(shares.values())))
    assert got.keys() == want.keys() and all(np.allclose(got[k], w) for k, w in want.items())
    (one,) = quantiles(df, [], "v", {"q": 0.25}).collect()
    assert abs(one.q - np.quantile([r[2] for r in rows if r[2] is not None], 0.25)) < 1e-9
    assert quantiles(df.limit(0), ["g"], "v", {"q": 0.5}).count() == 0


def test_peaks_and_frames_of_one_long_group(spark):
    """A group that no frame would hold passes in order; equal times and rows without a time."""
    rng = np.random.default_rng(22)
    a, b = (np.round(np.sort(rng.uniform(0, 4000, 5000)), 2) for _ in range(2))
    make = lambda x: spark.createDataFrame([("k", float(v)) for v in x] + [("k", None)], "g string, t double").repartition(5)
    i = j = hit = 0
    while i < len(a) and j < len(b):
        if abs(a[i] - b[j]) <= 0.1:
            i, j, hit = i + 1, j + 1, hit + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    (r,) = M.peak_f1(make(a), make(b), ["g"], "t", 0.1).collect()
    assert r.matched == hit and abs(r.f1 - 2 * hit / 10_000) < 1e-12
    frames = [("k", float(v), n) for n, v in enumerate(np.round(rng.uniform(0, 100, 3000), 0))] + [("k", 50.0, 10_000 + n) for n in range(200)]
    (w0, w1), count = (0.0, 101.0), 7
    free, want = sorted((t, n) for _, t, n in frames), []
    for c in (w0 + (w1 - w0) / count * (i + 0.5) for i in range(count)):
        best = min(free, key=lambda x: (abs(x[0] - c), x))
        free.remove(best)
        want.append(best)
    from tessera.operators import segments as G

    windows = spark.createDataFrame([("k", w0, w1), ("none", 0.0, 1.0)], "g string, s double, e double")
    got = G.uniform_frames(spark.createDataFrame(frames, "g string, t double, f long").repartition(4), windows, ["g"], "t", "f", "s", "e", count).collect()
    assert sorted((r.t, r.f) for r in got) == sorted(want)
