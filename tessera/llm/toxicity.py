"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the hashed embeddings of the word and of two prefixes, so inflected forms share
what they have in common. Filters of several widths run over the words, each is max-pooled over the whole text,
and a logistic layer gives the score. Training takes a bounded sample of labelled rows on the driver; scoring is
row-wise on the executors. Thresholds are calibrated by language on rows kept out of the fit; the language, the
source and the id are no inputs of the score.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import small_batches

BUCKETS = 1 << 15
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5)
SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 2_000, 4_000
"""Labelled rows of each class that training takes, in the order of their ids' hashes: its bound at any corpus size."""
SAMPLE_CHARS = 64_000_000
"""Characters of the sample's texts; rows beyond them, in the same order, are not in the sample but in the calibration."""
EPOCHS = 6
THRESHOLD = 0.3
BINS = 1 << 12
"""Bins of the scores that thresholds are picked from."""
STRETCH = 1_000_000
CACHED = 100_000

WORDS = re.compile(r"\w+").findall


def _features(word: str) -> list[int]:
    """Buckets of the word and of its prefixes; a short word is its own prefix."""
    return [zlib.crc32(word.encode())] + [zlib.crc32(f"{n}^{word[:n]}".encode()) for n in PREFIXES]


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # per width: width x DIM x FILTERS
    bias: list[np.ndarray]
    weight: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = THRESHOLD


class Words:
    """Numbers words as they come; 0 is padding and 1 stands for a text without words."""

    def __init__(self) -> None:
        self.code: dict[str, int] = {"": 0, "\x00": 1}

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the texts, each followed by padding, and where each text starts."""
        code, out, starts = self.code, array("i"), []
        pad = array("i", [0] * (max(WIDTHS) - 1))
        for t in texts:
            starts.append(len(out))
            words = WORDS(t.lower()) or ["\x00"]
            try:
                out.extend(map(code.__getitem__, words))
            except KeyError:
                del out[starts[-1] :]
                for w in words:
                    if w not in code:
                        code[w] = len(code)
                out.extend(map(code.__getitem__, words))
            out += pad
        return np.frombuffer(out, np.int32), np.array(starts, np.int64)

    def buckets(self, since: int = 0) -> np.ndarray:
        """len x features: buckets of the words from number ``since``; the first two have none (bucket -1)."""
        f = [[-1] * (1 + len(PREFIXES)) if i < 2 else _features(w) for i, w in enumerate(list(self.code)[since:], since)]
        a = np.array(f, np.int64).reshape(-1, 1 + len(PREFIXES))
        return np.where(a >= 0, a % BUCKETS, -1)


def _vectors(embedding: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return np.where(buckets[:, :1] >= 0, embedding[buckets].sum(axis=1), np.float32(0))


def _pool(projected: list[list[np.ndarray]], bias: list[np.ndarray], words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Texts x pooled features, and the filters' outputs; windows that start in the padding do not count."""
    idle, pooled, outputs = words == 0, [], []
    for tables, b in zip(projected, bias, strict=True):
        n = len(words) - len(tables) + 1
        out = tables[0][words[:n]] + b
        for j in range(1, len(tables)):
            out += tables[j][words[j : j + n]]
        out[idle[:n]] = -np.inf
        pooled.append(np.maximum.reduceat(out, starts, axis=0))
        outputs.append(out)
    return np.concatenate(pooled, axis=1), outputs


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Train by Adagrad on whole texts. The first dimension starts as the features' log-odds, the rest at random.

    With no text, or one class alone, the score is constant: that class, or 0.
    """
    rng = np.random.default_rng(seed)
    n, y = len(texts), np.asarray(labels, np.float32)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    weight = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    if n == 0 or y.min() == y.max():
        return Model(emb, filters, bias, weight * 0, -6.0 if n == 0 or y[0] == 0 else 6.0)
    book = Words()
    coded = [book.number([t])[0] for t in texts]
    buckets = book.buckets()
    seen = np.zeros((2, BUCKETS))
    for c, label in zip(coded, y, strict=True):
        b = np.unique(buckets[np.unique(c)])
        seen[int(label), b[b >= 0]] += 1
    pos, neg = y.sum(), n - y.sum()
    emb[:, 0] = np.clip(np.log((seen[1] + 0.5) / (pos + 1)) - np.log((seen[0] + 0.5) / (neg + 1)), -3, 3) / 3
    emb[seen.sum(axis=0) < 3, 0] = 0
    for f in filters:
        f[:, 0, 0] = 0.5
    weight[::FILTERS] = 0.5
    params = [emb, *filters, *bias, weight]
    squares = [np.full_like(p, 1e-4) for p in params]
    offset, offset_square, rate = 0.0, 1e-4, 0.05

    def step(k: int, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        at = slice(None) if rows is None else rows
        squares[k][at] += grad**2
        params[k][at] -= rate * grad / np.sqrt(squares[k][at])

    order = np.argsort([len(c) for c in coded], kind="stable")
    batches = [order[i : i + 48] for i in range(0, n, 48)]
    for _ in range(epochs):
        for which in rng.permutation(len(batches)):
            rows = batches[which]
            words = np.concatenate([coded[i] for i in rows])
            size = np.array([len(coded[i]) for i in rows])
            starts = np.cumsum(size) - size
            kinds, words = np.unique(words, return_inverse=True)
            if kinds[0] != 0:
                raise AssertionError("every text ends in padding")
            x = _vectors(emb, buckets[kinds])
            h, outputs = _pool([[x @ f[j] for j in range(len(f))] for f in filters], bias, words, starts)
            z = h @ weight + offset
            g = (_sigmoid(z) - y[rows]) / len(rows)
            gh = g[:, None] * weight
            gx = np.zeros_like(x)
            text_of = np.repeat(np.arange(len(rows)), size)
            for k, (f, out) in enumerate(zip(filters, outputs, strict=True)):
                part = gh[:, k * FILTERS : (k + 1) * FILTERS]
                hit = out == h[:, k * FILTERS : (k + 1) * FILTERS][text_of[: len(out)]]
                place, filt = np.nonzero(hit)
                first = np.unique(text_of[place] * FILTERS + filt, return_index=True)[1]
                place, filt = place[first], filt[first]
                gp = part[text_of[place], filt]
                gf = np.zeros_like(f)
                for j in range(len(f)):
                    w = words[place + j]
                    np.add.at(gf[j].T, filt, gp[:, None] * x[w])
                    np.add.at(gx, w, gp[:, None] * f[j][:, filt].T)
                gb = np.bincount(filt, gp, FILTERS).astype(np.float32)
                step(1 + k, gf)
                step(1 + len(WIDTHS) + k, gb)
            step(1 + 2 * len(WIDTHS), h.T @ g + 1e-4 * weight)
            offset_square += float(g.sum()) ** 2
            offset -= rate * float(g.sum()) / offset_square**0.5
            live = np.flatnonzero(np.abs(gx).max(axis=1) > 0)
            live = live[kinds[live] > 1]
            b = buckets[kinds[live]]
            own, back = np.unique(b, return_inverse=True)
            ge = np.zeros((len(own), DIM), np.float32)
            np.add.at(ge, back.reshape(b.shape), gx[live][:, None, :])
            step(0, ge, own)
    return Model(emb, filters, bias, weight, offset)


class Scorer:
    """Scores whole texts; remembers the filter outputs of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.words, self.known = Words(), 0
        self.tables = [[np.zeros((0, FILTERS), np.float32) for _ in range(w)] for w in WIDTHS]

    def logits(self, texts: list[str]) -> np.ndarray:
        if self.known > CACHED:
            self.reset()
        words, starts = self.words.number(texts)
        if len(self.words.code) > self.known:
            x = _vectors(self.model.embedding, self.words.buckets(self.known))
            self.tables = [[np.concatenate((t, x @ f[j])) for j, t in enumerate(ts)] for ts, f in zip(self.tables, self.model.filters, strict=True)]
            self.known = len(self.words.code)
        h, _ = _pool(self.tables, self.model.bias, words, starts)
        return h.astype(np.float64) @ self.model.weight + self.model.offset

    def scores(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(self.logits(texts) * self.model.scale + self.model.shift) if texts else np.zeros(0)


def _stretches(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > STRETCH:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _all_logits(model: Model, texts: list[str]) -> np.ndarray:
    s = Scorer(model)
    return np.concatenate([np.zeros(0), *(s.logits(x) for x in _stretches(texts))])


def best_threshold(counts: np.ndarray, weights: np.ndarray, default: float = THRESHOLD) -> float:
    """The middle of the interval with the best F1; ``default`` where a class is missing.

    ``counts``: label x bin, how many rows have a score in each of the equal bins of 0 to 1; ``weights``: of a row of each label.
    """
    if not counts.sum(axis=1).all():
        return default
    bins = counts.shape[1]
    filled = np.flatnonzero(counts.sum(axis=0))[::-1]
    miss, hit = np.cumsum(counts[:, filled] * weights[:, None], axis=1)
    k = int(np.argmax(2 * hit / (miss + hit + hit[-1])))
    low = filled[k + 1] + 1 if k + 1 < len(filled) else 0
    return float((filled[k] + low) / (2 * bins))


def calibrate(model: Model, texts: list[str], labels: np.ndarray, share: float) -> Model:
    """Fit scale and shift of the logit on rows kept out of the fit, weighted to the share of label 1 among all
    labelled rows."""
    y = np.asarray(labels, float)
    if len(y) and y.min() < y.max():
        z = _all_logits(model, texts)
        w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        # a soft target keeps the fit finite where the classes are apart
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = _sigmoid(a * z + b)
            g = np.array([(w * (p - t) * z).sum() + 1e-3 * (a - 1), (w * (p - t)).sum()])
            v = w * np.maximum(p * (1 - p), 1e-6)
            m = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-9]])
            move = np.linalg.solve(m, g)
            move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
            a, b = a - move[0], b - move[1]
        if a > 0:
            model.scale, model.shift = float(a), float(b)
    return model


def set_thresholds(model: Model, counts: dict[str | None, np.ndarray], sizes: np.ndarray) -> Model:
    """The common threshold, and one for each language with at least 20 rows of either class.

    ``counts``: by language, label x bin of the scores of rows outside the fit; ``sizes``: how many labelled rows
    there are of each label. The fit takes more of one label than of the other, so rows are weighted back to ``sizes``.
    """
    total = sum(counts.values(), np.zeros((2, BINS)))
    weights = sizes / np.maximum(total.sum(axis=1), 1)
    model.default = best_threshold(total, weights)
    for lang in sorted(k for k in counts if k is not None):
        if counts[lang].sum(axis=1).min() >= 20:
            model.thresholds[lang] = best_threshold(counts[lang], weights, model.default)
    return model


def part(doc_id: str = "doc_id") -> Column:
    """The fold of a row: crc32 of its id as text, modulo 4; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(4)).cast("int")


def train(docs: DataFrame, labels: DataFrame, held_out: int = 2, positives: int = SAMPLE_POSITIVE, negatives: int = SAMPLE_NEGATIVE, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on labelled documents outside the fold ``held_out``; every fifth of the sample is for calibration.
    Thresholds come from all labelled documents outside that fold that the fit left out.

    Only ids and labels are sorted for the sample; their texts come by a broadcast of at most
    ``positives + negatives`` ids, one for each id (the greatest where rows share one), ``chars`` characters in all. For the
    thresholds the executors score the documents outside the fold, scores without texts meet the labels, and the
    driver gets counts by language, label and bin. Labels other than 0 and 1 and null ids are left out, null
    texts count as empty ones, and without a column ``lang`` there is the common threshold alone.
    """
    open_rows = labels.select("doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)").filter(part() != held_out)
    sizes = {r.toxic: r["count"] for r in open_rows.groupBy("toxic").count().collect()}
    pick = lambda label, n: open_rows.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(1, positives).union(pick(0, negatives)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    sizes_of = met.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(F.char_length("text")).alias("n")).collect()
    sizes_of.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    room, chosen = chars, []
    for r in sizes_of:
        if r.n <= room:
            room -= r.n
            chosen.append(r.doc_id)
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    fits = docs.sparkSession.createDataFrame([(i,) for i in chosen], kind)
    rows = met.join(F.broadcast(fits), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()[::-1]), r.doc_id, r.text))
    fitted, kept = [r for i, r in enumerate(rows) if i % 5 < 4], rows[4::5]
    model = fit([r.text for r in fitted], np.array([r.toxic for r in fitted]))
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    model = calibrate(model, [r.text for r in kept], np.array([r.toxic for r in kept]), share)
    used = docs.sparkSession.createDataFrame([(r.doc_id,) for r in fitted], kind)
    left = open_rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(F.broadcast(used), "doc_id", "left_anti")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = score(docs.select("doc_id", "text", lang.alias("lang")).filter(part() != held_out), model).drop("text")
    binned = scored.withColumn("bin", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1))).join(left, "doc_id")
    counts: dict[str | None, np.ndarray] = {}
    for r in binned.groupBy("lang", "toxic", "bin").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r.lang, np.zeros((2, BINS)))[int(r.toxic), r.bin] += r.n
    return set_thresholds(model, counts, np.array([sizes.get(0, 0), sizes.get(1, 0)]))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name`` added: 0 to 1 for every whole text.

    Row-wise, no shuffle. Null texts score as empty ones, which score as the classifier's constant; a column of
    that name is replaced; other columns pass.
    """
    keep = [f for f in docs.schema if f.name != name]
    schema = T.StructType([*keep, T.StructField(name, T.DoubleType())])
    small_batches(docs.sparkSession)
    at = [f.name for f in keep].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            parts = [scorer.scores(x) for x in _stretches([t.as_py() or "" for t in b.column(at)])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([np.zeros(0), *parts]))], schema.names)

    return docs.select(*[f.name for f in keep]).mapInArrow(run, schema)


def threshold(model: Model, lang: str = "lang") -> Column:
    """The calibrated threshold of each row's language; the common one where the language has none."""
    out = F.lit(model.default)
    for k, v in sorted(model.thresholds.items()):
        out = F.when(F.col(lang) == k, F.lit(v)).otherwise(out)
    return out


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those whose score reaches their language's threshold; columns as they were."""
    limit = threshold(model) if "lang" in docs.columns else F.lit(model.default)
    return score(docs, model, name="\x00score").filter(F.col("\x00score") < limit).select(*docs.columns)
