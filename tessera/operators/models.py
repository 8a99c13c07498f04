"""Anchors, calibration, linear models by Gram matrices, Spark ML models per fold, embeddings.

Linear models over held-out groups come from one aggregation: the Gram matrices of each group, summed; a group's model
is the solution of the total less its own. The total is one broadcast row and the groups are solved where they are, so
nothing of theirs passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.operators.folds import held_out_logistic, moments
from tessera.operators.ranges import quantiles, running


def condition_anchor(df: DataFrame, folds: DataFrame, member: str, condition: str, value: str) -> DataFrame:
    """(fold, condition, anchor): mean of the training rows; a condition without any takes the fold's mean."""
    t = df.join(folds.filter("role = 'train'"), member)
    a = t.groupBy("fold", condition).agg(F.avg(value).alias("anchor"))
    every = folds.select("fold").distinct().join(df.select(condition).distinct())
    m = t.groupBy("fold").agg(F.avg(value).alias("_m"))
    return every.join(a, ["fold", condition], "left").join(m, "fold").select("fold", condition, F.coalesce("anchor", "_m").alias("anchor"))


def peer_anchor(keys: list[str], member: str, value: str) -> Column:
    """Mean of the same condition's rows of all other members: sums less the member's own."""
    w, own = Window.partitionBy(*keys), Window.partitionBy(*keys, member)
    n = F.count(value).over(w) - F.count(value).over(own)
    return F.when(n > 0, (F.sum(value).over(w) - F.sum(value).over(own)) / n)


def residualize(df: DataFrame, keys: list[str], condition: str, vector: str, train: Column) -> DataFrame:
    """(keys, place, value): vectors less the training mean of their condition, by place."""
    long = df.select(*keys, condition, train.alias("_t"), F.posexplode(vector).alias("place", "x"))
    m = long.filter("_t").groupBy(condition, "place").agg(F.avg(F.col("x").cast("double")).alias("_m"))
    return long.join(m, [condition, "place"]).select(*keys, "place", (F.col("x").cast("double") - F.col("_m")).alias("value"))


def impute_scale(df: DataFrame, folds: DataFrame, member: str, column: str) -> DataFrame:
    """Every row of every fold, missing values by the training median and scaled by the training mean and std."""
    j = df.join(folds, member)
    t = F.col("role") == "train"
    s = quantiles(j.filter(t), ["fold"], column, {"_md": 0.5}).drop("n")  # a row for each fold
    filled = j.join(F.broadcast(s), "fold", "left").withColumn(column, F.coalesce(column, "_md"))
    m = filled.groupBy("fold").agg(F.avg(F.when(t, F.col(column))).alias("_m"), F.stddev_pop(F.when(t, F.col(column))).alias("_s"))
    return filled.join(F.broadcast(m), "fold").withColumn(column, (F.col(column) - F.col("_m")) / F.coalesce(F.nullif("_s", F.lit(0.0)), F.lit(1.0))).drop("_md", "_m", "_s")


def dense_columns(df: DataFrame, columns: list[str], least: float) -> list[str]:
    """Columns with at least that share of finite values, from one aggregation."""
    from tessera.operators.features import finite

    r = df.agg(*[F.avg(finite(F.col(c)).isNotNull().cast("int")).alias(c) for c in columns]).first()
    return [c for c in columns if (r[c] or 0) >= least]


def uncorrelated_columns(df: DataFrame, columns: list[str], most: float = 0.95) -> list[str]:
    """Columns in order, each dropped that correlates too much with an earlier kept one; the matrix comes from Spark."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    r = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else []
    rho = {p: abs(r[i] or 0.0) for i, p in enumerate(pairs)}
    kept: list[str] = []
    for c in columns:
        if all(rho[k, c] < most for k in kept):
            kept.append(c)
    return kept


def gram(df: DataFrame, group: str, columns: list[Column]) -> DataFrame:
    """(group, own, total): the products' sums of every two columns, for each group and for all, as arrays by rows of the
    upper triangle. One aggregation by group, one more over the groups' sums, and a broadcast of one row."""
    ij = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    own = df.groupBy(group).agg(F.array(*[F.coalesce(F.sum(columns[i] * columns[j]), F.lit(0.0)) for i, j in ij]).alias("own"))
    total = own.agg(F.array(*[F.sum(F.get("own", F.lit(k))) for k in range(len(ij))]).alias("total"))
    return own.join(F.broadcast(total))


def _solve(grams: DataFrame, group: str, size: int, model: Callable[[np.ndarray], np.ndarray], name: str = "coefficients") -> DataFrame:
    """(group, name): ``model`` of the total less each group's own Gram matrix, solved on the executors."""
    schema = grams.select(group, F.lit(None).cast("array<double>").alias(name)).schema
    upper = np.triu_indices(size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for own, total in zip(f["own"], f["total"], strict=True):
                m = np.zeros((size, size))
                m[upper] = np.asarray(total) - np.asarray(own)
                out.append(model(m + np.triu(m, 1).T).tolist())
            yield pd.DataFrame({group: f[group], name: out})

    return grams.mapInPandas(run, schema)


def lopo_linear(df: DataFrame, group: str, features: list[Column], target: Column, ridge: float = 0.0) -> DataFrame:
    """(group, coefficients): for each group the least squares fit of all others, intercept first and not shrunk."""
    p = len(features) + 1

    def model(m: np.ndarray) -> np.ndarray:
        penalty = ridge * np.eye(p)
        penalty[0, 0] = 0
        return np.linalg.lstsq(m[:p, :p] + penalty, m[:p, p], rcond=None)[0]

    return _solve(gram(df, group, [F.lit(1.0), *features, target]), group, p + 1, model)


def lopo_residual_ridge(df: DataFrame, group: str, condition: str, levels: list, features: list[Column], target: Column, ridge: float) -> DataFrame:
    """(group, coefficients): a condition's mean over the other groups, and a ridge fit of what is left of the target on
    features that are standardised by the other groups.

    ``levels`` are the conditions, a fixed few. The coefficients: one mean for each level, then for each feature its mean,
    standard deviation and weight; ``predict_residual`` puts them together.
    """
    k, p = len(levels), len(features)
    dummies = [(F.col(condition) == v).cast("double") for v in levels]

    def model(m: np.ndarray) -> np.ndarray:
        n, x, z, t = m[0, 0], slice(1, 1 + p), slice(1 + p, 1 + p + k), 1 + p + k
        counts = np.maximum(np.diag(m)[z], 1e-12)
        means = m[z, t] / counts
        left = m[x, t] - m[x, z] @ means  # products of the features with what the conditions' means leave
        mu = m[0, x] / max(n, 1e-12)
        sd = np.sqrt(np.maximum(np.diag(m)[x] / max(n, 1e-12) - mu**2, 0))
        sd[sd < 1e-12] = 1.0
        rest = m[0, t] - m[0, z] @ means
        a = (m[x, x] - n * np.outer(mu, mu)) / np.outer(sd, sd)
        w = np.linalg.solve(a + ridge * np.eye(p), (left - mu * rest) / sd) if p else np.zeros(0)
        return np.concatenate((means, np.stack((mu, sd, w), axis=1).ravel()))

    columns = [F.lit(1.0), *features, *dummies, target]
    return _solve(gram(df, group, columns), group, len(columns), model)


def lopo_ridge_blend(df: DataFrame, group: str, inner: Column, condition: str, levels: list, features: list[Column], target: Column, penalties: list[float], keep: int = 3) -> DataFrame:
    """(group, coefficients, ranked, scores): as ``lopo_residual_ridge``, with the penalties ranked by held-out error among the
    other groups and the models of the best ``keep`` averaged.

    ``inner`` deals groups into a few inner folds. Everything comes from the groups' Gram matrices, in the one pass over the rows: an
    inner fold's training matrix is the total less the group's own less the fold's, all penalties share one eigendecomposition of
    it, and the squared error on the inner fold is a form of that fold's matrix. ``ranked`` are the penalties from the
    least mean squared error on, ``scores`` those errors in that order.
    """
    k, p = len(levels), len(features)
    columns = [F.lit(1.0), *features, *[(F.col(condition) == v).cast("double") for v in levels], target]
    size, ij = len(columns), [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    own = df.groupBy(group).agg(F.array(*[F.coalesce(F.sum(columns[i] * columns[j]), F.lit(0.0)) for i, j in ij]).alias("own")).withColumn("fold", inner.cast("int"))
    folds = own.groupBy("fold").agg(F.array(*[F.sum(F.get("own", F.lit(n))) for n in range(len(ij))]).alias("gram"))
    grams = own.join(F.broadcast(folds.agg(F.array_sort(F.collect_list(F.struct("fold", "gram"))).alias("folds"))))
    upper = np.triu_indices(size)
    x, z, t = slice(1, 1 + p), slice(1 + p, 1 + p + k), 1 + p + k

    def square(v: list[float]) -> np.ndarray:
        m = np.zeros((size, size))
        m[upper] = v
        return m + np.triu(m, 1).T

    def parts(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(means of the conditions, of the features, their standard deviations, a weight vector for each penalty)."""
        n, counts = max(m[0, 0], 1e-12), np.diag(m)[z]
        means = np.where(counts > 0, m[z, t] / np.maximum(counts, 1e-12), m[0, t] / n)
        mu = m[0, x] / n
        sd = np.sqrt(np.maximum(np.diag(m)[x] / n - mu**2, 0))
        sd[sd < 1e-12] = 1.0
        left, rest = m[x, t] - m[x, z] @ means, m[0, t] - m[0, z] @ means
        values, vectors = np.linalg.eigh((m[x, x] - n * np.outer(mu, mu)) / np.outer(sd, sd))
        along = vectors.T @ ((left - mu * rest) / sd)
        return means, mu, sd, [vectors @ (along / (np.maximum(values, 0) + a)) for a in penalties]

    def model(own: list[float], fold: int, folds: list[tuple[int, list[float]]]) -> tuple[list[float], list[float], list[float]]:
        mine = square(own)
        sums = {r["fold"]: square(r["gram"]) for r in folds}
        sums[fold] = sums[fold] - mine
        total, errors = sum(sums.values()), []
        for test in sums.values():
            if test[0, 0] < 0.5 or total[0, 0] - test[0, 0] < 0.5:
                continue
            means, mu, sd, weights = parts(total - test)
            u = [np.concatenate(([w / sd @ mu], -w / sd, -means, [1.0])) for w in weights]
            errors.append([max(0.0, v @ test @ v) / test[0, 0] for v in u])
        means, mu, sd, weights = parts(total)
        score = np.mean(errors, axis=0) if errors else np.zeros(len(penalties))
        order = np.argsort(score, kind="stable")
        w = np.mean([weights[i] for i in order[:keep]], axis=0)
        return np.concatenate((means, np.stack((mu, sd, w), axis=1).ravel())).tolist(), [penalties[i] for i in order], score[order].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model(*r) for r in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], lists) for i in range(3))], [group, "coefficients", "ranked", "scores"])

    lists = "array<double>"
    schema = grams.select(group, *[F.lit(None).cast(lists).alias(c) for c in ("coefficients", "ranked", "scores")]).schema
    return grams.select(group, "own", "fold", "folds").mapInArrow(run, schema)


def predict_residual(df: DataFrame, models: DataFrame, group: str, condition: str, levels: list, features: list[Column]) -> DataFrame:
    """``df`` with ``prediction``: the condition's mean plus the weighted standardised features, within 0 and 1."""
    at = lambda i: F.get("coefficients", F.lit(i))
    base = F.coalesce(*[F.when(F.col(condition) == v, at(i)) for i, v in enumerate(levels)])
    k = len(levels)
    p = sum(((f - at(k + 3 * i)) / at(k + 3 * i + 1) * at(k + 3 * i + 2) for i, f in enumerate(features)), base)
    return df.join(models, group).withColumn("prediction", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))).drop("coefficients", "ranked", "scores")


def predict_linear(df: DataFrame, models: DataFrame, group: str, features: list[Column], clip: bool = False) -> DataFrame:
    """``df`` with ``prediction`` of the group's model; a model is a few numbers, as many as there are groups."""
    p = sum((F.get("coefficients", F.lit(i + 1)) * f for i, f in enumerate(features)), F.get("coefficients", F.lit(0)))
    return df.join(models, group).withColumn("prediction", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) if clip else p).drop("coefficients")


def surface_terms(i: Column, f: Column, kind: str) -> list[Column]:
    """Terms of a response surface: grand_mean, bilinear, quadratic, or the nine cells."""
    if kind == "grand_mean":
        return []
    if kind == "bilinear":
        return [i, f, i * f]
    if kind == "quadratic":
        return [i, f, i * f, i * i, f * f]
    return [((i == a) & (f == b)).cast("double") for a in range(3) for b in range(3) if (a, b) != (0, 0)]


def within_ols(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Slope of y on x after both lose their group means, and its R2."""
    w = Window.partitionBy(group)
    d = df.withColumns({"_x": F.col(x) - F.avg(x).over(w), "_y": F.col(y) - F.avg(y).over(w)})
    return d.agg((F.sum(F.col("_x") * F.col("_y")) / F.sum(F.col("_x") ** 2)).alias("slope"), (F.corr("_x", "_y") ** 2).alias("r2"), F.count("*").alias("n"))


FOLDS = 64
"""Folds that get a Spark ML model each; the folds of more groups are hashes of them."""


def per_fold(df: DataFrame, fold: str, fit: Callable[[DataFrame, object], Callable[[DataFrame], DataFrame]], most: int = FOLDS) -> DataFrame:
    """Predictions of every fold by a Spark ML model fitted on the others; ``fit`` takes the training rows and the fold, and gives a
    function of the held-out rows. Folds are few: each is a distributed fit, and more than ``most`` raise."""
    found = sorted(x[fold] for x in df.select(fold).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"over {most} folds: deal the groups into fewer, by hash")
    out = None
    for r in found:
        p = fit(df.filter(F.col(fold) != r), r)(df.filter(F.col(fold) == r))
        out = p if out is None else out.unionByName(p)
    return out


def assemble(df: DataFrame, features: list[str], name: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol=name, handleInvalid="skip").transform(df)


def risk_logistic(df: DataFrame, group: str, label: str, features: list[Column], reg: float = 0.01) -> DataFrame:
    """``df`` with ``probability`` of label 1 by the balanced logistic model of all other groups, however many there are."""
    return held_out_logistic(df, [group], label, features, reg)


def leakage_audit(df: DataFrame, subject: str, task: str, target: str, features: list[Column] | Column, reg: float = 0.05) -> DataFrame:
    """(hold_out, accuracy, balanced, n): the same probe for one 0/1 ``target`` with subjects held out, with tasks held out, and with both,
    where a row is scored by rows of other subjects and other tasks alone. Accuracy that falls when a key is held out came from it."""
    out = None
    for name, keys in (("subject", [subject]), ("task", [task]), ("subject_task", [subject, task])):
        p = held_out_logistic(df, keys, target, features, reg).filter(F.col("probability").isNotNull())
        hit = ((F.col("probability") > 0.5) == (F.col(target) > 0.5)).cast("int")
        by_class = (F.avg(F.when(F.col(target) > 0.5, hit)) + F.avg(F.when(F.col(target) <= 0.5, hit))) / 2
        a = p.agg(F.lit(name).alias("hold_out"), F.avg(hit).alias("accuracy"), by_class.alias("balanced"), F.count("*").alias("n"))
        out = a if out is None else out.union(a)
    return out


def residual_anchors(df: DataFrame, fold: str, condition: str, target: str) -> DataFrame:
    """(fold, condition, anchor): the condition's mean over the rows of all other folds, or the mean of those rows where it has none."""
    own = df.groupBy(fold, condition).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    grid = own.select(fold).distinct().join(own.groupBy(condition).agg(F.sum("s").alias("cs"), F.sum("n").alias("cn")))
    rest = own.groupBy(fold).agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    both = grid.join(own, [fold, condition], "left").join(rest, fold).join(F.broadcast(own.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))))
    s, n = F.col("cs") - F.coalesce("s", F.lit(0.0)), F.col("cn") - F.coalesce("n", F.lit(0))
    return both.select(fold, condition, F.coalesce(s / F.nullif(n, F.lit(0)), (F.col("ts") - F.col("fs")) / F.nullif(F.col("tn") - F.col("fn"), F.lit(0))).alias("anchor"))


BINS = 32
"""Classes of a feature that boosted trees tell apart, about; Spark ML's own number."""

CELLS = 100_000
"""Cells of such classes that one task of a fit has."""


def training_cuts(df: DataFrame, fold: str, features: str) -> dict[object, list[list[float]]]:
    """Bounds of the classes of each feature, by fold, from its training rows, those of all other folds.

    They are those of Spark ML for up to 10 000 rows, of which it draws as many where there are more: halfway between neighbouring values, where
    the rows below come nearest to each ``BINS``-th part of all, or between all values where these are no more than ``BINS``. Parts that one
    value passes at once are caught up with at the values after it. Here all rows are counted, in ranges of values, so the bounds don't
    depend on partitions.
    """
    from pyspark.ml.functions import vector_to_array

    first, sizes = df.select(features).head(), {r[0]: r[1] for r in df.groupBy(fold).count().limit(FOLDS + 1).collect()}
    rest = {f: sum(sizes.values()) - n for f, n in sizes.items()}
    out: dict[object, list[list[float]]] = {f: [] for f in rest}
    for j in range(first[0].size if first else 0):
        x = F.get(vector_to_array(features), F.lit(j)).alias("_x")
        values = df.groupBy(x).agg(*[F.count_if(F.col(fold) != f).cast("double").alias(f"_n{i}") for i, f in enumerate(rest)])
        different = values.agg(*[F.count_if(F.col(f"_n{i}") > 0) for i in range(len(rest))]).head()
        there = {i: F.col(f"_n{i}") > 0 for i in range(len(rest))}
        values = values.withColumns({f"_v{i}": F.when(c, F.struct("_x", f"_n{i}")) for i, c in there.items()} | {f"_h{i}": c.cast("long") for i, c in there.items()})
        ran = running(values, "_x", {f"_{kind}_{c}{i}": (kind, f"_{c}{i}") for i in there for kind, c in (("sum", "n"), ("sum", "h"), ("max", "v"))}, own=False)
        steps = []
        for i, n in enumerate(rest.values()):
            below, own, last, at = F.col(f"_sum_n{i}"), F.col(f"_n{i}"), F.col(f"_max_v{i}"), F.col(f"_sum_h{i}")
            passed = lambda rows, n=n: F.greatest(F.lit(0), F.ceil(rows * BINS / max(n, 1)) - 1).cast("int")
            before = F.when(at > 1, passed(below - last[f"_n{i}"] / 2)).otherwise(0)
            step = F.struct(at.alias("at"), before.alias("before"), passed(below + own / 2).alias("parts"), ((last["_x"] + F.col("_x")) / 2).alias("cut"))
            steps.append(F.when(there[i] & last.isNotNull(), step))
        ran = ran.select(*[s.alias(f"_s{i}") for i, s in enumerate(steps)])
        s = [F.col(f"_s{i}") for i in range(len(rest))]
        wanted = [(s[i]["parts"] > s[i]["before"]) | F.lit(different[i] <= BINS) for i in range(len(rest))]
        pick = lambda wanted: ran.select(F.array(*[F.when(w, c) for w, c in zip(wanted, s, strict=True)]).alias("_s")).filter(F.exists("_s", lambda c: c.isNotNull())).collect()
        found = pick(wanted)
        late = [[r[0][i]["at"] for r in found if r[0][i] and r[0][i]["parts"] > r[0][i]["before"] + 1 and different[i] > BINS] for i in range(len(rest))]
        if any(late):
            for i, starts in enumerate(late):
                for a in starts:
                    wanted[i] = wanted[i] | s[i]["at"].between(a + 1, a + BINS)
            found = pick(wanted)
        for i, f in enumerate(rest):
            cuts: list[float] = []
            for _, _, parts, cut in sorted(r[0][i] for r in found if r[0][i]):
                if different[i] <= BINS or len(cuts) < parts:
                    cuts.append(cut)
            out[f].append(cuts)
    return out


def residual_regressor(df: DataFrame, fold: str, condition: str, target: str, kind: str) -> DataFrame:
    """``df`` (with ``features``) and ``prediction``: the training folds' mean of the condition plus a model of what it leaves, within
    0 and 1. ``kind``: "forest", "boosted" or "elastic_net". A fold's rows, training rows and held-out rows alike, take the anchors of its training folds.

    Boosted trees see of a row the classes of its features alone, and squared errors need of equal rows their number and mean alone: the
    training rows are counted by class once, and all passes of a fit go over these cells."""
    from pyspark.ml.feature import Bucketizer
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    make = {
        "forest": lambda: RandomForestRegressor(labelCol="_residual", predictionCol="_p", numTrees=20, maxDepth=4, seed=7),
        "boosted": lambda: GBTRegressor(featuresCol="_cell", weightCol="_n", labelCol="_residual", predictionCol="_p", maxIter=10, maxDepth=3, seed=7),
        "elastic_net": lambda: LinearRegression(labelCol="_residual", predictionCol="_p", regParam=0.01, elasticNetParam=0.5),
    }[kind]
    anchors = residual_anchors(df, fold, condition, target).persist()  # few rows; else each pass of each fit sums all rows again

    cuts = training_cuts(df, fold, "features") if kind == "boosted" else {}

    def celled(rows: DataFrame, held: object) -> DataFrame:
        """Rows with the class of each feature, ``_c0`` and so on."""
        x, size = vector_to_array("features"), len(cuts[held])
        ends = [[-float("inf"), *np.nextafter(c, np.inf).tolist(), float("inf")] for c in cuts[held]]  # a bound itself is below
        whole = rows.columns
        rows = rows.select("*", *[F.get(x, F.lit(j)).alias(f"_x{j}") for j in range(size)])
        rows = Bucketizer(splitsArray=ends, inputCols=[f"_x{j}" for j in range(size)], outputCols=[f"_b{j}" for j in range(size)]).transform(rows)
        return rows.select(*whole, *[(F.col(f"_b{j}") + 0.0).alias(f"_c{j}") for j in range(size)])  # plain numbers; the buckets say that they are categories

    def fit(train: DataFrame, held: object):
        own = F.broadcast(anchors.filter(F.col(fold) == held).select(condition, "anchor"))
        rows = train.join(own, condition).withColumn("_residual", F.col(target) - F.col("anchor"))
        unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("anchor") + F.col("_p")))
        if kind != "boosted":
            model = make().fit(rows)
            return lambda test: model.transform(test.join(own, condition)).withColumn("prediction", unit).drop("_p", "anchor")
        names = [f"_c{j}" for j in range(len(cuts[held]))]
        mean = F.avg(F.coalesce("_residual", F.lit(float("nan"))))  # a row without a target is an error, as for the other kinds
        cells = assemble(celled(rows, held).groupBy(*names).agg(F.count("*").cast("double").alias("_n"), mean.alias("_residual")), names, "_cell").persist()
        model = make().fit(cells.coalesce(1 + cells.count() // CELLS))
        cells.unpersist()
        return lambda test: model.transform(assemble(celled(test.join(own, condition), held), names, "_cell")).withColumn("prediction", unit).drop("_p", "anchor", "_cell", *names)

    return per_fold(df, fold, fit)


def pairwise_ranker(df: DataFrame, keys: list[str], order: str, truth: str, features: list[str]) -> DataFrame:
    """Score of each row: its mean chance to win over the others of its group, by a logistic model of feature differences."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    from tessera.operators.joins import pairs

    p = pairs(df, keys, order, [truth, *features])
    diff = lambda sign: [(sign * (F.col(f"left_{c}") - F.col(f"right_{c}"))).alias(c) for c in features]
    win = (F.col(f"left_{truth}") > F.col(f"right_{truth}")).cast("double")
    ids = lambda a, b: [*keys, F.col(f"{a}_{order}").alias(order), F.col(f"{b}_{order}").alias("_o")]
    both = p.select(*ids("left", "right"), *diff(1), win.alias("label"), (F.col(f"left_{truth}") != F.col(f"right_{truth}")).alias("_u"))
    both = both.union(p.select(*ids("right", "left"), *diff(-1), (1 - win).alias("label"), (F.col(f"left_{truth}") != F.col(f"right_{truth}")).alias("_u")))
    rows = assemble(both, features)
    model = LogisticRegression(fitIntercept=False, regParam=0.01, maxIter=25).fit(rows.filter("_u"))
    scored = model.transform(rows).withColumn("_p", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.groupBy(*keys, order).agg(F.avg("_p").alias("score"))


def blend(df: DataFrame, keys: list[str], order: str, truth: str, a: str, b: str) -> DataFrame:
    """Ranking accuracy of w z(a) + (1 - w) z(b) for eleven weights, and the best."""
    from tessera.operators.joins import pairs
    from tessera.operators.sequence import zscore

    z = df.withColumns({"_a": F.coalesce(zscore(keys, a), F.lit(0.0)), "_b": F.coalesce(zscore(keys, b), F.lit(0.0))})
    p = pairs(z, keys, order, [truth, "_a", "_b"]).filter(F.col(f"left_{truth}") != F.col(f"right_{truth}"))
    da, db = F.col("left__a") - F.col("right__a"), F.col("left__b") - F.col("right__b")
    up = F.col(f"left_{truth}") > F.col(f"right_{truth}")
    s = p.agg(*[F.struct(F.lit(i / 10).alias("weight"), F.avg(((((i / 10) * da + (1 - i / 10) * db) > 0) == up).cast("int")).alias("accuracy")).alias(f"w{i}") for i in range(11)])
    s = s.select(F.inline(F.array(*[f"w{i}" for i in range(11)])))
    return s.withColumn("best", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("accuracy"), "weight")) == 1)


def personal_bias(df: DataFrame, key: str, order: str, truth: str, pred: str, k: int) -> DataFrame:
    """Rows after a key's first k, with ``pred`` moved by the mean error of those k."""
    d = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    bias = F.avg(F.when(F.col("_n") <= k, F.col(truth) - F.col(pred))).over(Window.partitionBy(key))
    return d.withColumn("calibrated", F.col(pred) + bias).filter(F.col("_n") > k).drop("_n")


def empirical_bayes(df: DataFrame, key: str, truth: str, pred: str) -> DataFrame:
    """(key, bias): each key's mean error shrunk by the variances between and within all other keys."""
    e = F.col(truth) - F.col(pred)
    g = df.groupBy(key).agg(F.avg(e).alias("m"), F.count(e).alias("n"), F.coalesce(F.var_samp(e), F.lit(0.0)).alias("v"))
    t = g.agg(F.sum("m").alias("sm"), F.sum(F.col("m") ** 2).alias("smm"), F.sum("n").alias("sn"), F.sum(F.col("v") * (F.col("n") - 1)).alias("sv"), F.count("*").alias("k"))
    o = g.join(F.broadcast(t)).withColumns({"k": F.col("k") - 1, "sm": F.col("sm") - F.col("m"), "smm": F.col("smm") - F.col("m") ** 2, "sn": F.col("sn") - F.col("n"), "sv": F.col("sv") - F.col("v") * (F.col("n") - 1)})
    sigma = F.col("sv") / F.nullif(F.col("sn") - F.col("k"), F.lit(0))
    between = (F.col("smm") - F.col("sm") ** 2 / F.col("k")) / F.nullif(F.col("k") - 1, F.lit(0))
    tau = F.greatest(F.lit(0.0), between - sigma / (F.col("sn") / F.col("k")))
    return o.select(key, (F.col("m") * tau / F.nullif(tau + sigma / F.col("n"), F.lit(0.0))).alias("bias"), F.col("n"))


def late_fusion(df: DataFrame, experts: list[str], truth: str, floor: float = 0.0, steps: int = 2000) -> list[float]:
    """Weights of the experts, at least ``floor`` and of sum 1, with the least squared error; a small problem on their
    Gram matrix, which one aggregation gives."""
    k = len(experts)
    g = df.groupBy(F.lit(1).alias("_g"))
    x = [*experts, truth]
    r = g.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x)]).first()
    m = np.array([[r[f"{i}_{j}"] for j in range(k + 1)] for i in range(k + 1)])
    a, b = m[:k, :k], m[:k, k]
    w, rate = np.full(k, 1 / k), 1 / max(np.linalg.eigvalsh(a).max(), 1e-12)
    for _ in range(steps):
        w = w - rate * (a @ w - b)
        u = np.sort(w - floor)[::-1]  # nearest point of the shifted simplex
        c = (np.cumsum(u) - (1 - k * floor)) / np.arange(1, k + 1)
        w = np.maximum(w - floor - c[np.flatnonzero(u > c)[-1]], 0) + floor
    return w.tolist()


def fuse(experts: list[str], weights: list[float]) -> Column:
    """Weighted mean over the experts that are there."""
    n = sum((F.coalesce(F.col(e) * w, F.lit(0.0)) for e, w in zip(experts, weights, strict=True)), F.lit(0.0))
    d = sum((F.when(F.col(e).isNotNull(), w).otherwise(0.0) for e, w in zip(experts, weights, strict=True)), F.lit(0.0))
    return n / F.nullif(d, F.lit(0.0))


def covariance(df: DataFrame, vector: str, size: int, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mean, covariance) of vectors: each task sums the products of its rows as one matrix, and the matrices' sum comes to the driver."""
    m = moments(df, vector, size, weight)
    mean = m[0, 1:] / m[0, 0]
    return mean, m[1:, 1:] / m[0, 0] - np.outer(mean, mean)


def pca(df: DataFrame, vector: str, size: int, k: int, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, variances): standardised weighted PCA, the largest entry of each component positive."""
    mean, c = covariance(df, vector, size, weight)
    sd = np.sqrt(np.maximum(np.diag(c), 1e-12))
    values, vectors = np.linalg.eigh(c / np.outer(sd, sd))
    order = np.argsort(-values)[:k]
    comp = vectors[:, order].T
    comp *= np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(axis=1)])[:, None]
    return mean, comp / sd, values[order]


def project(vector: str, mean: np.ndarray, components: np.ndarray) -> Column:
    """The vector in the components, as an array, in column arithmetic."""
    centred = F.zip_with(F.col(vector), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x.cast("double") - m)
    one = lambda c: F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(v)) for v in c]), lambda x, v: x * v), F.lit(0.0), lambda s, x: s + x)
    return F.array(*[one(c) for c in components])


def effective_rank(values: np.ndarray) -> float:
    """exp of the entropy of a spectrum's shares."""
    p = np.maximum(values, 0) / np.maximum(values, 0).sum()
    return float(np.exp(-(p[p > 0] * np.log(p[p > 0])).sum()))


def without_effects(df: DataFrame, effects: list[str], vector: str) -> DataFrame:
    """``df`` with ``vector`` less its mean over the rows of the same ``effects``: residuals of their fixed effects."""
    long = df.groupBy(*effects).agg(F.count("*").alias("_n")).join(df.select(*effects, F.posexplode(vector).alias("_i", "_v")).groupBy(*effects, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m")), effects)
    means = long.groupBy(*effects).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_mean"))
    return df.join(means, effects).withColumn(vector, F.zip_with(vector, "_mean", lambda x, m: x.cast("double") - m)).drop("_mean")


def linear_cka(df: DataFrame, vector: str, split: int, size: int, effects: list[str] | None = None) -> float:
    """Similarity of two representations held side by side in one vector, places below ``split`` and from it on; with
    ``effects``, of what those fixed effects leave of them."""
    _, c = covariance(without_effects(df, effects, vector) if effects else df, vector, size)
    x, y, xy = c[:split, :split], c[split:, split:], c[:split, split:]
    return float((xy**2).sum() / np.sqrt((x**2).sum() * (y**2).sum()))


def _unit(df: DataFrame, key: str, subject: str, label: str, vector: str) -> DataFrame:
    """(k, s, l, v): vectors of length 1; a vector of zeros, or none, takes no part."""
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    d = df.withColumn("_norm", norm).filter("_norm > 0")
    return d.select(F.col(key).alias("k"), F.col(subject).alias("s"), F.col(label).alias("l"), F.transform(vector, lambda x: x.cast("double") / F.col("_norm")).alias("v"))


def _packed(rows: DataFrame, *keys: str, more: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(F.collect_list(F.struct("k", "s", "l", "v", *more)).alias("rows"))


def _best(c: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k greatest values over minus infinity, by row; equals in the order of ``place``.

    Only what reaches a row's k-th value is put in order.
    """
    least = np.partition(c, -k, axis=1)[:, -k] if k < c.shape[1] else np.full(len(c), -np.inf)
    row, at = np.nonzero((c >= least[:, None]) & (c > -np.inf))
    order = np.lexsort((place[at], -c[row, at], row))
    row, at = row[order], at[order]
    first = np.searchsorted(row, np.arange(len(c)))
    kept = np.arange(len(row)) - first[row] < k
    return row[kept], at[kept]


def _nearest(pairs: DataFrame, v: DataFrame, k: int, indexed: bool = False) -> DataFrame:
    """(q, ql, k, l, c) of pairs of blocks (q, rows): each query's k best of the block by cosine among other subjects, ties by key;
    ``indexed``, among those of its ``cells``, where the block's rows have a ``cell``."""
    schema = v.select(F.col("k").alias("q"), F.col("l").alias("ql"), "k", "l", F.lit(0.0).alias("c")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, d in zip(b.column(0), b.column(1), strict=True):
                q, d = q.values, d.values
                x, y = (np.stack(z.field("v").to_numpy(zero_copy_only=False)) for z in (q, d))
                qs, ds = (z.field("s").to_numpy(zero_copy_only=False) for z in (q, d))
                keys = d.field("k").to_numpy(zero_copy_only=False)
                place = np.argsort(np.argsort(keys, kind="stable"), kind="stable")
                step = max(64, min(1024, 4_194_304 // len(y)))
                if indexed:
                    cells, cell = np.unique(d.field("cell").to_numpy(zero_copy_only=False), return_inverse=True)
                    of = np.repeat(np.arange(len(q)), q.field("cells").value_lengths().to_numpy(zero_copy_only=False))
                    to = q.field("cells").flatten().to_numpy(zero_copy_only=False)
                    asked = np.zeros((len(q), len(cells)), bool)
                    there = np.isin(to, cells)
                    asked[of[there], np.searchsorted(cells, to[there])] = True
                for i in range(0, len(x), step):
                    c = np.round(x[i : i + step] @ y.T, 9)
                    c[qs[i : i + step, None] == ds[None, :]] = -np.inf
                    if indexed:
                        c[~asked[i : i + step][:, cell]] = -np.inf
                    row, at = _best(c, place, k)
                    yield pa.RecordBatch.from_arrays([q.field("k").take(pa.array(i + row)), q.field("l").take(pa.array(i + row)), d.field("k").take(pa.array(at)), d.field("l").take(pa.array(at)), pa.array(c[row, at])], ["q", "ql", "k", "l", "c"])

    return pairs.select("q", "rows").mapInArrow(run, schema)


def _voted(near: DataFrame, key: str, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("c"), "k"))
    votes = near.withColumn("_r", r).filter(F.col("_r") <= k).groupBy("q", "ql", "l").agg(F.count("*").alias("_n"), F.sum("c").alias("_s"))
    return votes.groupBy("q", "ql").agg(F.max_by("l", F.struct("_n", "_s")).alias("predicted")).select(F.col("q").alias(key), F.col("ql").alias("label"), "predicted")


def knn_probe(df: DataFrame, key: str, subject: str, label: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """(key, label, predicted): vote of the k nearest by cosine among other subjects' vectors; ties by key, then by the
    votes' count and sum of cosines.

    Exact, so every block of about ``block`` vectors meets every other: a pair of blocks is one matrix product, of which
    each query keeps its k best before anything is shuffled. More vectors make more blocks, not larger ones; beyond some
    millions, ``knn_indexed`` looks at a share of them.
    """
    n = max(1, -(-df.count() // block))
    v = _unit(df, key, subject, label, vector)
    packed = _packed(v.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")), "b")
    queries = packed.select(F.col("rows").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))
    return _voted(_nearest(queries.join(packed, "b"), v, k), key, k)


SAMPLE = 20_000
"""Vectors that the cells of an index are fitted on."""


def cell_centres(v: DataFrame, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of ``cells`` cells by spherical k-means on the SAMPLE vectors of the smallest hashes of their keys; on the driver."""
    x = np.array([r.v for r in v.orderBy(F.xxhash64("k"), "k").limit(SAMPLE).select("v").collect()])
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)] if len(x) else np.zeros((0, 1))
    for _ in range(rounds if len(x) else 0):
        of = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


SHELF = 16_384
"""Vectors of the cells that a query meets at a time."""


def nearest_indexed(df: DataFrame, key: str, subject: str, label: str, vector: str, k: int, share: float = 0.6, block: int = 4096) -> DataFrame:
    """(q, ql, k, l, c): for every vector its k nearest of other subjects, by an index of cells.

    Vectors are dealt to the nearest of about sqrt(n) centres, and each asks the ``share`` of the cells whose centres are nearest to it;
    what it meets there is scored exactly, block by block. Cells stand on shelves of about SHELF vectors, a larger one alone and in
    many blocks. Shuffled are the vectors once and a query once for each shelf that it asks, which are n / SHELF at most, not once
    for each cell.
    """
    v = _unit(df, key, subject, label, vector)
    n = v.count()
    centres = cell_centres(v, max(1, round(n**0.5)))
    probes = max(1, -(-len(centres) * share // 1)) if len(centres) else 1
    near = T.StructType([*v.schema, T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(3).flatten().to_numpy().reshape(b.num_rows, -1)
            order = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, : int(probes)].astype(np.int32) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(order), pa.list_(pa.int32()))], near.names)

    dealt = v.mapInArrow(run, near)
    own = dealt.withColumn("cell", F.get("cells", F.lit(0))).drop("cells")
    sizes = {r.cell: r.n for r in own.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # about sqrt(n) numbers
    shelves, rows = [0] * max(1, len(centres)), [0]
    for cell in range(len(centres)):
        if rows[-1] and rows[-1] + sizes.get(cell, 0) > SHELF:
            rows.append(0)
        rows[-1] += sizes.get(cell, 0)
        shelves[cell] = len(rows) - 1
    shelf = F.array(*[F.lit(i) for i in shelves])
    parts = F.array(*[F.lit(-(-max(n, 1) // SHELF)) for n in rows])
    data = own.withColumn("shelf", F.get(shelf, F.col("cell"))).withColumn("b", F.pmod(F.xxhash64("k"), F.get(parts, F.col("shelf"))))
    data = _packed(data, "shelf", "b", more=("cell",))
    asked = dealt.withColumn("shelf", F.explode(F.array_distinct(F.transform("cells", lambda c: F.get(shelf, c)))))
    asked = asked.withColumn("cells", F.filter("cells", lambda c: F.get(shelf, c) == F.col("shelf")))
    queries = _packed(asked.withColumn("qb", F.pmod(F.xxhash64("k"), F.lit(max(1, -(-n // block))))), "shelf", "qb", more=("cells",))
    met = queries.select("shelf", F.col("rows").alias("q")).join(data.select("shelf", "rows"), "shelf")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("c"), "k"))
    return _nearest(met, v, k, indexed=True).withColumn("_r", best).filter(F.col("_r") <= k).drop("_r")


def knn_indexed(df: DataFrame, key: str, subject: str, label: str, vector: str, k: int, share: float = 0.6, block: int = 4096) -> DataFrame:
    """(key, label, predicted): as ``knn_probe``, with the neighbours that ``nearest_indexed`` finds."""
    return _voted(nearest_indexed(df, key, subject, label, vector, k, share, block), key, k)
