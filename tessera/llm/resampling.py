"""Quality selection by importance resampling.

Hashed n-gram models of target text and of raw text give every document a log importance weight, the ratio of
its n-grams' probabilities; adding Gumbel noise and taking the k highest samples k documents without
replacement in proportion to their weights. Both models count every row: the raw one all texts, the target one all that
are labelled good.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import cut, join_sparse, keyed, small_batches

BUCKETS = 1 << 16
"""Hash buckets of words and word pairs; the models, and what reaches the driver of them, have this size."""
REFERENCE = 24
"""N-grams of a document's weight: the mean log ratio times this, as if all texts had so many n-grams, so that length
alone moves no document. It is the sampling's temperature: whole texts' sums differ by hundreds, and noise of standard
deviation 1.28 would change nothing; over 24 n-grams texts like the target differ by less than the noise and are sampled,
and junk still lies far below them."""
SHARE = 0.75
BINS = 1024
LAST_BIN = 10_000
SEED = 17


CACHED = 200_000
"""Distinct tokens whose hashes a task remembers; then it starts anew."""

TOKENS = re.compile(r"\w+|[^\w\s]+").findall


class Grams:
    """Buckets of the tokens of texts, then of their pairs; tokens are words and runs of other signs, as written."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = np.uint64(buckets)
        self.code: dict[str, int] = {}
        self.hash = np.zeros(0, np.uint64)

    def of(self, text: str) -> np.ndarray:
        if len(self.code) > CACHED:
            self.code, self.hash = {}, np.zeros(0, np.uint64)
        tokens, code = TOKENS(text), self.code
        try:
            at = array("i", map(code.__getitem__, tokens))
        except KeyError:
            new = [t for t in dict.fromkeys(tokens) if t not in code]
            code.update(zip(new, range(len(code), len(code) + len(new)), strict=True))
            at = array("i", map(code.__getitem__, tokens))
            if len(code) > len(self.hash):
                room = np.zeros(2 * len(code), np.uint64)
                room[: len(self.hash)] = self.hash
                self.hash = room
            self.hash[len(code) - len(new) : len(code)] = [xxhash.xxh64_intdigest(t.encode()) for t in new]
        h = self.hash[np.frombuffer(at, np.int32)] if at else np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
            pair = (pair ^ (pair >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return (np.concatenate((h, pair ^ (pair >> np.uint64(32)))) % self.buckets).astype(np.int64)


def fit(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of target to raw probability per bucket, both with one added to every bucket.

    ``docs`` (doc_id, text): all of them make the raw model, and all whose id is in ``target_ids`` (doc_id) the target's.
    A task counts into two arrays and sends a row for each bucket that it met.
    """
    small_batches(docs.sparkSession)
    ids = target_ids.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).filter("doc_id is not null").distinct().withColumn("\x00target", F.lit(True))
    marked = join_sparse(docs.select("doc_id", "text"), ids, "left", "doc_id", shuffled=True).select(F.coalesce("\x00target", F.lit(False)).alias("target"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n, t = Grams(buckets), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            for target, text in zip(b.column(0), b.column(1), strict=True):
                g = grams.of(text.as_py() or "")
                np.add.at(n, g, 1)
                if target.as_py():
                    np.add.at(t, g, 1)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen]), pa.array(t[seen])], ["gram", "n", "t"])

    target, raw = np.ones(buckets), np.ones(buckets)
    for r in marked.mapInArrow(run, "gram long, n long, t long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect():
        raw[r.gram] += r.n
        target[r.gram] += r.t
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weights(rows: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``rows`` with ``log_weight`` in place of ``text``: the mean log ratio of the text's n-grams times REFERENCE; 0 where
    there are none."""
    small_batches(rows.sparkSession)
    keep = [f for f in rows.schema if f.name != "text"]
    schema = T.StructType([*keep, T.StructField("log_weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(len(ratio))
        for b in batches:
            found = (grams.of(x.as_py() or "") for x in b.column(b.num_columns - 1))
            w = [float(ratio[g].mean()) * REFERENCE if len(g) else 0.0 for g in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(w, pa.float64())], schema.names)

    return rows.select(*[f.name for f in keep], "text").mapInArrow(run, schema)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise that depends on the key and the seed alone, so that a task that runs again draws the same."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def top_k(scored: DataFrame, k: int, by: str = "sample_key", bins: int = BINS, last_bin: int = LAST_BIN) -> DataFrame:
    """The k rows of ``scored`` (key, ...) with the highest ``by``, ties by key: exact, without one sort of all rows.

    Each pass counts the rows of 1024 bins and goes into the bin that the k-th row is in, until that holds few
    rows or one value; only these are sorted. ``scored`` should be a written table; ``by`` is neither null nor NaN.
    """
    if k <= 0:
        return scored.limit(0)
    inside, above, left = F.lit(True), F.lit(False), k
    while True:
        low, high, n = scored.filter(inside).agg(F.min(by), F.max(by), F.count("*")).head()
        if n <= left:
            return scored.filter(above | inside)
        if n <= last_bin or not low < high or (high - low) / bins <= 0:
            break
        at = F.least(F.floor((F.col(by) - low) / ((high - low) / bins)), F.lit(bins - 1))
        counts = {r.b: r["count"] for r in scored.filter(inside).groupBy(at.alias("b")).count().collect()}
        for b in sorted(counts, reverse=True):
            if counts[b] >= left:
                break
            left -= counts[b]
        above = above | (inside & (at > b))
        inside = inside & (at == b)
    rest = scored.filter(inside).orderBy(F.desc(by), "key").limit(left)
    return scored.filter(above).union(rest)


def _weigh(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, doc_id, log_weight, sample_key) of rows (key, doc_id, text)."""
    ratio = fit(rows, labels.filter("quality = 1").select("doc_id"))
    return cut(log_weights(rows.select("key", "doc_id", "text"), ratio).withColumn("sample_key", F.col("log_weight") + gumbel(F.col("key"))))


def weigh(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, doc_id, log_weight, sample_key) of every row of ``docs``; the target is the labelled quality 1.

    Null and empty texts have weight 0, that of a text as likely in either model. Without labels the ratio is
    the same for all texts but for rare words. Repeated rows are rows of their own; null doc_ids are no targets.
    """
    return _weigh(keyed(docs.select("doc_id", "text")), labels)


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """(key, doc_id, log_weight, sample_key) of the sampled rows: ``share`` of all, rounded down."""
    scored = weigh(docs, labels)
    return top_k(scored, int(scored.count() * share))


def keep_sampled(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """The sampled rows of ``docs`` with their columns; rows of one doc_id are sampled each for itself."""
    name = "\x00row"
    rows = keyed(docs, name)
    scored = _weigh(rows.select(F.col(name).alias("key"), "doc_id", "text"), labels)
    kept = top_k(scored, int(scored.count() * share)).select(F.col("key").alias(name))
    return rows.join(kept, name, "left_semi").select(*docs.columns)
