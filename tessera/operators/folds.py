"""Models of many held-out folds at once: every pass over the rows serves all folds, and no fold is a fit of its own."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 2048
"""Rows that are held against all folds at a time, at most."""

HELD = 16_777_216
"""Numbers that such a matrix of rows x folds has, at most."""

FEW = 32
"""Folds up to which all rows are held against each."""

PRODUCTS = 2048
"""Products of four features that a series about the common weights has, at most."""

NEAR = 1e-9
"""How far weights of standardised features may be from where Newton's steps end."""


def summed(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray | tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum over all tasks of a matrix that each makes of its rows; the matrix alone comes to the driver.

    A task gives the matrix row by row, or (places, rows) of the rows that it has, and what tasks gave of one row is added up one at a time.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = partial(batches)
        places, m = made if isinstance(made, tuple) else (np.arange(len(np.atleast_2d(made))), np.atleast_2d(made))
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(list(m), pa.list_(pa.float64()))], ["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            flat = b.column(1).values.to_numpy().reshape(b.num_rows, -1) if b.num_rows else []
            for i, row in zip(b.column(0).to_pylist(), flat, strict=True):
                held[i] = held[i] + row if i in held else row.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["i", "row"])

    rows = df.mapInArrow(make, "i long, row array<double>").repartition("i").mapInArrow(add, "i long, row array<double>").collect()
    return np.array([r.row for r in sorted(rows, key=lambda r: r.i)])


def moments(df: DataFrame, vector: str, size: int, weight: Column | None = None) -> np.ndarray:
    """Sums of the products of (1, vector) with itself, [size + 1, size + 1]; vectors of another length take no part."""
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    rows = df.filter(F.size(vector) == size).select(w.alias("w"), F.transform(vector, lambda v: v.cast("double")).alias("x"))

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((size + 1, size + 1))
        for b in batches:
            a = np.concatenate((np.ones((b.num_rows, 1)), b.column(1).flatten().to_numpy().reshape(b.num_rows, size)), axis=1)
            out += (a * b.column(0).to_numpy()[:, None]).T @ a
        return out

    return summed(rows, partial)


class _Rows:
    """Batches of rows (codes of the keys, label, features) against folds: which fold's training rows they are, and products."""

    def __init__(self, folds: np.ndarray, features: int):
        self.folds, self.p = folds, features + 1
        self.ij = np.triu_indices(self.p)

    def slices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(train [row, fold], label, a): a row trains a fold if it differs from it in every key; a begins with 1."""
        for b in batches:
            n = b.num_rows
            codes = b.column(0).flatten().to_numpy().reshape(n, -1)
            x = b.column(2).flatten().to_numpy().reshape(n, -1)
            y = b.column(1).to_numpy().astype(float)
            step = max(1, min(ROWS, HELD // max(1, len(self.folds))))
            for i in range(0, n, step):
                train = (codes[i : i + step, None, :] != self.folds).all(axis=2)
                yield train, y[i : i + step], np.concatenate((np.ones((len(train), 1)), x[i : i + step]), axis=1)

    def square(self, upper: np.ndarray) -> np.ndarray:
        """Symmetric matrices [fold, p, p] of their upper triangles."""
        out = np.zeros((len(upper), self.p, self.p))
        out[:, self.ij[0], self.ij[1]] = upper
        out[:, self.ij[1], self.ij[0]] = upper
        return out


def held_out_logistic(df: DataFrame, keys: list[str], label: str, features: list[Column] | Column, reg: float = 0.01, rounds: int = 30, name: str = "probability") -> DataFrame:
    """``df`` with ``probability`` of label 1 by a balanced logistic model of all rows that share none of the row's ``keys``.

    One key is leave-one-out by it; two are a crossed hold-out, where a row of the fold (a, b) is scored by rows that have
    neither a nor b. A fold's classes weigh the same, and its penalty is ``reg`` / 2 times the squared weights of features that are
    standardised by its training rows; the intercept is free. Few folds, or crossed ones, take one pass a Newton step in which a task sums the
    gradients and Gram matrices of every fold, from products of matrices; many folds of one key take passes whose work follows the rows
    alone (``_fit_many``). Folds are the keys' combinations that occur; what the driver holds of each is its weights and sums. A fold without both classes among its training rows has no probability, nor has a row
    with a null label, key or feature.
    """
    p = len(features) if isinstance(features, list) else None
    vector = F.array(*[f.cast("double") for f in features]) if p is not None else F.transform(features, lambda v: v.cast("double"))
    levels = {k: sorted(r[0] for r in df.select(k).distinct().collect() if r[0] is not None) for k in keys}
    spark = df.sparkSession
    coded = df.withColumn("_x", vector).withColumn("_y", F.col(label).cast("double"))
    for k in keys:
        table = spark.createDataFrame([(v, i) for i, v in enumerate(levels[k])], T.StructType([df.schema[k], T.StructField(f"_c_{k}", T.IntegerType())]))
        coded = coded.join(F.broadcast(table), k, "left")
    coded = coded.withColumn("_codes", F.array(*[F.col(f"_c_{k}") for k in keys])).drop(*[f"_c_{k}" for k in keys])
    whole = F.col("_y").isNotNull() & ~F.exists("_codes", lambda c: c.isNull()) & F.col("_x").isNotNull() & ~F.exists("_x", lambda v: v.isNull() | F.isnan(v))
    coded = coded.withColumn("_whole", F.coalesce(whole, F.lit(False)))
    rows = coded.filter("_whole").select("_codes", "_y", "_x")
    if p is None:
        first = rows.select(F.size("_x")).head()
        p = first[0] if first else 0
    if len(keys) == 1:
        folds, weights = _fit_many(rows, p, reg, rounds)
    else:
        folds = np.array(sorted(tuple(r[0]) for r in rows.select("_codes").distinct().collect()), np.int32).reshape(-1, len(keys))
        weights = _fit(rows, folds, p, reg, rounds) if len(folds) else np.zeros((0, p + 1))
    strides = np.cumprod([1, *(len(levels[k]) for k in keys[:0:-1])])[::-1]
    number = folds.astype(np.int64) @ strides  # ascending, as the folds are in order
    schema = T.StructType([*df.schema, T.StructField(name, T.DoubleType())])
    at = [coded.columns.index(c) for c in ("_whole", "_codes", "_x")]
    kept = [coded.columns.index(c) for c in df.columns]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.array(b.column(at[0]).to_numpy(zero_copy_only=False), bool)
            out = np.full(b.num_rows, np.nan)
            if ok.any():
                codes, x = (b.column(i).filter(pa.array(ok)).flatten().to_numpy().reshape(ok.sum(), -1) for i in at[1:])
                w = weights[np.searchsorted(number, codes.astype(np.int64) @ strides)]
                with np.errstate(over="ignore"):
                    out[ok] = 1 / (1 + np.exp(-(w[:, 0] + (w[:, 1:] * x).sum(axis=1))))
                ok[ok] = ~np.isnan(w[:, 0])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(out, pa.float64(), mask=~ok)], schema.names)

    return coded.mapInArrow(score, schema)


def _spread(s: np.ndarray, p: int) -> np.ndarray:
    """Variances of features, from columns of their number, of the positives, sums and sums of squares."""
    n = np.maximum(s[:, :1], 1)
    return np.maximum(s[:, 2 + p : 2 + 2 * p] / n - (s[:, 2 : 2 + p] / n) ** 2, 1e-24)


def _fit_many(rows: DataFrame, p: int, reg: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes [fold, 1], weights [fold, 1 + feature]) of one key's folds; not a number where a fold lacks a class.

    Weights that a series doesn't give within ``NEAR`` are fitted with all rows held against each such fold.
    """
    x = [F.get("_x", F.lit(i)) for i in range(p)]
    per = rows.groupBy(F.get("_codes", F.lit(0)).alias("c")).agg(F.count("*"), F.sum("_y"), *[F.sum(v) for v in x], *[F.sum(v * v) for v in x])
    per = np.array(sorted(tuple(map(float, r)) for r in per.collect())).reshape(-1, 3 + 2 * p)
    folds, own = per[:, :1].astype(np.int32), per[:, 1:]
    total = own.sum(axis=0)
    s = total - own
    real = (s[:, 1] > 0) & (s[:, 1] < s[:, 0])
    w, found = np.full((len(folds), p + 1), np.nan), np.zeros(len(folds), bool)
    if len(folds) > FEW and real.any() and np.isfinite(own).all() and math.comb(p + 4, 4) <= PRODUCTS:
        w, found = _series(rows, folds[:, 0], total, s, real, p, reg, rounds)
    rest = real & ~found
    w[~found] = np.nan
    if rest.any():
        w[rest] = _fit(rows, folds[rest], p, reg, rounds)
    return folds, w


def _series(rows: DataFrame, folds: np.ndarray, total: np.ndarray, s: np.ndarray, real: np.ndarray, p: int, reg: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights [fold, 1 + feature], found [fold]) by passes that hold each row against one fold, its own.

    A fold's sums over its training rows are those of all rows less those of its own. The first are a Taylor series about the weights that
    fit all rows: sums of products of up to four features with the logistic function's derivatives, of each class, which serve all folds. A
    fold is found if what the series leaves out, which the fourth derivative bounds, moves no weight of a standardised feature by more than ``NEAR``.
    """
    size = p + 1
    mean, sd = total[2 : 2 + p] / total[0], np.sqrt(_spread(total[None], p)[0])
    sd[sd <= 1e-9 * np.abs(mean)] = np.inf  # a constant adds nothing to the intercept
    dead = np.diag(np.concatenate(([0.0], np.isinf(sd))))
    i2, j2 = np.triu_indices(size)
    pair = {(i, j): k for k, (i, j) in enumerate(zip(i2.tolist(), j2.tolist(), strict=True))}
    four = list(combinations_with_replacement(range(size), 4))
    left, right = [pair[c[:2]] for c in four], [pair[c[2:]] for c in four]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(code, label, a) of rows; a is 1 and the standardised features."""
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                c = b.slice(i, ROWS)
                x = c.column(2).flatten().to_numpy().reshape(c.num_rows, -1)
                yield c.column(0).flatten().to_numpy(), c.column(1).to_numpy().astype(float), np.concatenate((np.ones((len(x), 1)), (x - mean) / sd), axis=1)

    def logistic(eta: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(eta, -500, 500)))

    def slopes(y: np.ndarray, a: np.ndarray, q: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Gradient and upper triangle of the Gram matrix that each row adds."""
        return np.concatenate(((weight * (y - q))[:, None] * a, (weight * q * (1 - q))[:, None] * (a[:, i2] * a[:, j2])), axis=1)

    def square(upper: np.ndarray) -> np.ndarray:
        out = np.zeros((len(upper), size, size))
        out[:, i2, j2] = out[:, j2, i2] = upper
        return out

    def penalty(s: np.ndarray) -> np.ndarray:
        return np.concatenate((np.zeros((len(s), 1)), reg * _spread(s, p) / sd**2), axis=1)

    def shares(s: np.ndarray) -> np.ndarray:
        """A row's weight by fold, of either class."""
        return np.stack((0.5 / np.maximum(s[:, 0] - s[:, 1], 1), 0.5 / np.maximum(s[:, 1], 1)))

    share, fine, centre = shares(total[None])[:, 0], penalty(total[None])[0], np.zeros(size)
    for _ in range(rounds):

        def common(batches: Iterator[pa.RecordBatch], now: np.ndarray = centre) -> np.ndarray:
            out = np.zeros(size + len(i2))
            for _, y, a in read(batches):
                out += slopes(y, a, logistic(a @ now), share[y.astype(int)]).sum(axis=0)
            return out

        g = summed(rows, common)
        move = np.linalg.solve(square(g[:, size:])[0] + np.diag(fine) + dead + 1e-12 * np.eye(size), g[0, :size] - fine * centre)
        centre = centre + move
        if np.abs(move).max() < 1e-4:  # any place near it will do for the series
            break

    def derivatives(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((10, len(four) + 1))
        for _, y, a in read(batches):
            q = logistic(a @ centre)
            q1 = q * (1 - q)
            d = np.stack((q, q1, q1 * (1 - 2 * q), q1 * (1 - 6 * q1), np.ones_like(q)))
            products = a[:, i2] * a[:, j2]
            out += np.concatenate((d * (y < 0.5), d * (y >= 0.5))) @ np.concatenate((products[:, left] * products[:, right], ((a * a).sum(axis=1) ** 2.5)[:, None]), axis=1)
        return out

    t = summed(rows, derivatives)
    place = {c: k for k, c in enumerate(four)}
    at = np.array([place[tuple(sorted(c))] for c in np.ndindex(*[size] * 4)]).reshape([size] * 4)
    t1, t2, t3, t4 = ([t[5 * c + k][at[(..., *[0] * (3 - k))]] for c in (0, 1)] for k in range(4))
    label, fifth = t[9][at[:, 0, 0, 0]], t[[4, 9], -1]

    def of_all(d: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and Gram matrices of all rows, weighted as in each fold, at the centre plus d."""
        gradient, hessian = share[1][:, None] * label, np.zeros((len(d), size, size))
        for c in (0, 1):
            a3 = np.tensordot(d, t3[c], 1)
            b4 = np.einsum("fa,fabc->fbc", d, np.tensordot(d, t4[c], 1))
            gradient = gradient - share[c][:, None] * (t1[c] + np.einsum("fbc,fc->fb", t2[c] + a3 / 2 + b4 / 6, d))
            hessian += share[c][:, None, None] * (t2[c] + a3 + b4 / 2)
        return gradient, hessian

    share, fine, d = shares(s), penalty(s), np.zeros((len(folds), size))
    near, step = real.copy(), max(1, HELD // size**3)
    for _ in range(rounds):

        def own(batches: Iterator[pa.RecordBatch], now: np.ndarray = centre + d) -> tuple[np.ndarray, np.ndarray]:
            held = np.zeros((len(folds), size + len(i2)))
            for code, y, a in read(batches):
                i, at = np.unique(np.searchsorted(folds, code), return_inverse=True)
                v = slopes(y, a, logistic((a * now[i[at]]).sum(axis=1)), share[y.astype(int), i[at]])
                held[i] += np.stack([np.bincount(at, c, len(i)) for c in v.T], axis=1)
            seen = np.flatnonzero(held.any(axis=1))
            return seen, held[seen]

        g = summed(rows, own)
        moved = np.zeros(len(folds))
        for i in range(0, len(folds), step):
            j = slice(i, i + step)
            gradient, hessian = of_all(d[j], share[:, j])
            gradient = gradient - g[j, :size] - fine[j] * (centre + d[j])
            hessian = hessian - square(g[j, size:]) + fine[j][:, :, None] * np.eye(size) + dead + 1e-12 * np.eye(size)
            least = np.linalg.eigvalsh(np.where(np.isfinite(hessian).all(axis=(1, 2))[:, None, None], hessian, -np.eye(size)))[:, 0]
            good = near[j] & (least > 0)
            move = np.zeros_like(gradient)
            move[good] = np.linalg.solve(hessian[good], gradient[good][:, :, None])[:, :, 0]
            d[j] += move
            moved[j] = np.abs(move).max(axis=1)
            left_out = 0.25 / 24 * (d[j] ** 2).sum(axis=1) ** 2 * (share[:, j].T @ fifth)
            near[j] = good & (left_out <= NEAR * least)
        if not np.any(moved[near] > NEAR):
            break
    else:
        near &= moved <= NEAR
    w = (centre + d) / np.concatenate(([1.0], sd))
    w[:, 0] -= w[:, 1:] @ mean
    return w, near


def _fit(rows: DataFrame, folds: np.ndarray, p: int, reg: float, rounds: int) -> np.ndarray:
    """Weights [fold, 1 + feature] in the features' own units; not a number where a fold lacks a class."""
    held = _Rows(folds, p)

    def sizes(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((len(folds), 2 + 2 * p))
        for train, y, a in held.slices(batches):
            out += train.T.astype(float) @ np.concatenate((a[:, :1], y[:, None], a[:, 1:], a[:, 1:] ** 2), axis=1)
        return out

    s = summed(rows, sizes)
    n, positive = s[:, 0], s[:, 1]
    real = (positive > 0) & (positive < n)
    spread = _spread(s, p)
    penalty = np.concatenate((np.zeros((len(folds), 1)), reg * spread), axis=1)
    share = np.stack((0.5 / np.maximum(n - positive, 1), 0.5 / np.maximum(positive, 1)))  # a row's weight by fold, of either class
    w = np.zeros((len(folds), p + 1))
    for _ in range(rounds):
        now = w

        def step(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> np.ndarray:
            out = np.zeros((len(folds), p + 1 + len(held.ij[0])))
            for train, y, a in held.slices(batches):
                q = 1 / (1 + np.exp(-np.clip(a @ now.T, -500, 500)))
                weight = train * share[y.astype(int)]
                out[:, : p + 1] += (weight * (y[:, None] - q)).T @ a
                out[:, p + 1 :] += (weight * q * (1 - q)).T @ (a[:, held.ij[0]] * a[:, held.ij[1]])
            return out

        g = summed(rows, step)
        gradient = g[:, : p + 1] - penalty * w
        hessian = held.square(g[:, p + 1 :]) + penalty[:, :, None] * np.eye(p + 1)
        hessian += 1e-12 * np.eye(p + 1)
        move = np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
        w = w + np.where(real[:, None], move, 0.0)
        scale = np.concatenate((np.ones((len(folds), 1)), np.sqrt(spread)), axis=1)
        if not np.any(np.abs(move * scale)[real] > 1e-9):
            break
    w[~real] = np.nan
    return w
