"""Secret scanning: fixed patterns, and character Markov models for strings that no pattern names.

Two first-order models over the token alphabet, one of random strings and one of ordinary identifiers,
score every long token of a text by its log-likelihood ratio; a token is a secret where the ratio beats
the prior odds against secrets.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import small_batches

# The kinds in their order, their patterns and least lengths.
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CUES = ("passw", "secret", "token", "api")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

WORD = re.compile(r"[A-Za-z0-9_-]{3,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
RANDOM_STRINGS = 20_000
PRIOR_ODDS = 1e6

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


@dataclass
class Model:
    """ratio[a, b]: log P(b after a | random) - log P(b after a | identifier); row 0 is the start."""

    ratio: np.ndarray
    threshold: float

    def score(self, token: str) -> float:
        at = _codes(token)
        return float(self.ratio[np.concatenate(([0], at[:-1])), at].sum())


_CODE = np.zeros(128, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)


def _codes(token: str) -> np.ndarray:
    return _CODE[np.frombuffer(token.encode(), np.uint8)]


def _transitions(tokens: list[str]) -> np.ndarray:
    """How often each character of the alphabet follows each, or the start."""
    n = len(ALPHABET) + 1
    if not tokens:
        return np.zeros((n, n), np.int64)
    at = _codes("".join(tokens))
    before = np.concatenate(([0], at[:-1]))
    before[np.cumsum([0, *map(len, tokens[:-1])])] = 0
    return np.bincount(before * n + at, minlength=n * n).reshape(n, n)


def _log_model(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """Log transition probabilities; rows with few transitions fall back on the frequency of single characters."""
    single = counts.sum(axis=0) + 0.5
    single /= single.sum()
    return np.log((counts + weight * single) / (counts.sum(axis=1, keepdims=True) + weight))


def random_strings(n: int = RANDOM_STRINGS, seed: int = 7) -> list[str]:
    """Strings labelled random: base-64 like, alphanumeric, upper case with digits, and hexadecimal."""
    rnd = random.Random(seed)
    sets = [ALPHABET[:64], ALPHABET[:62], ALPHABET[26:62], "0123456789abcdef"]
    return ["".join(rnd.choices(sets[i % 4], k=rnd.randrange(16, 65))) for i in range(n)]


def fit(randoms: list[str], identifiers: list[str], prior_odds: float = PRIOR_ODDS) -> Model:
    """Models of two labelled samples; without identifiers that model is uniform and only the odds decide."""
    return _fit_counts(_transitions(randoms), _transitions(identifiers), prior_odds)


def _fit_counts(randoms: np.ndarray, identifiers: np.ndarray, prior_odds: float = PRIOR_ODDS) -> Model:
    return Model(_log_model(randoms) - _log_model(identifiers), math.log(prior_odds))


def _clear_of(spans: list[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """A test of whether a stretch (start, end) overlaps none of the spans, by one search in their sorted starts."""
    ordered = sorted((a, b) for _, a, b in spans)
    starts, reach = [a for a, _ in ordered], [-1, *accumulate((b for _, b in ordered), max)]
    return lambda start, end: reach[bisect_left(starts, end)] <= start


def _samples(text: str) -> tuple[list[str], list[str]]:
    """Pattern matches, which are random, and the words outside them, which with some joined ones are identifiers."""
    spans = base_spans(text)
    clear = _clear_of(spans)
    words = [m.group() for m in WORD.finditer(text) if not spans or clear(m.start(), m.end())]
    joined = [words[i : i + 3] for i in range(0, len(words), 9)]
    words += ["_".join(j) for j in joined] + ["".join(w.capitalize() for w in j) for j in joined]
    return [text[a:b] for kind, a, b in sorted(spans, key=lambda x: x[1]) if kind != "assign"], words


def train(docs: DataFrame, text: str = "text") -> Model:
    """Fit on all documents: their words, outside pattern matches, are the identifiers; generated strings and the
    pattern matches are the random ones. Each task sends one matrix of counts a class, and Spark sums them; the
    driver gets at most 2 x 68 x 68 numbers at any size. The pattern matches, mostly of one kind, weigh as much as one
    kind of the generated strings at most, so that the random model stays a mixture. An empty table is allowed.
    """
    n = len(ALPHABET) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, n * n), np.int64)
        for b in batches:
            for t in b.column(0):
                for c, tokens in zip(counts, _samples(t.as_py() or ""), strict=True):
                    c += _transitions(tokens).ravel()
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], ["at", "n"])

    small_batches(docs.sparkSession)
    counts = np.zeros(2 * n * n)
    for r in docs.select(text).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    matched, identifiers = counts.reshape(2, n, n)
    generated = _transitions(random_strings())
    return _fit_counts(generated + matched * min(1.0, generated.sum() / 4 / max(1.0, matched.sum())), identifiers)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the pattern matches, in the kinds' order; leftmost, non-overlapping in each kind."""
    out = []
    low = text.lower()
    if any(c in low for c in CUES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def all_spans(text: str, model: Model) -> list[tuple[str, int, int, float | None]]:
    """Pattern matches, and long tokens that overlap none of them and look random; by start, then kind."""
    base = base_spans(text)
    clear = _clear_of(base)
    out: list[tuple[str, int, int, float | None]] = [(k, a, b, None) for k, a, b in base]
    for m in TOKEN.finditer(text):
        if clear(m.start(), m.end()) and (s := model.score(m.group())) > model.threshold:
            out.append(("markov", m.start(), m.end(), s))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(docs: DataFrame, model: Model, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with ``spans`` in place of ``text``: array of (kind, start, end, score), code points, end exclusive.

    Row-wise, no shuffle. Null and empty texts have no spans; repeated rows are scanned each; other
    columns pass, and one named ``spans`` is replaced.
    """
    small_batches(docs.sparkSession)
    keep = [f for f in docs.schema if f.name not in (text, spans)]
    schema = T.StructType([*keep, T.StructField(spans, SPAN)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = b.num_columns - 1
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in all_spans(t.as_py() or "", model)] for t in b.column(last)]
            yield pa.RecordBatch.from_arrays([*b.columns[:last], pa.array(found, arrow)], schema.names)

    return docs.select(*[f.name for f in keep], text).mapInArrow(run, schema)


def span_text(spans: Column, kinds: list[str] | None = None) -> Column:
    """Spans as kind:start:end joined by commas, of some kinds or all."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(kinds)) if kinds else spans
    return F.concat_ws(",", F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, model: Model, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; overlapping spans become one. Null texts stay null."""
    names = docs.columns
    found = scan(docs.withColumn("\x00copy", F.col("text")), model, "\x00copy", "\x00spans")
    pieces = F.aggregate(
        F.col("\x00spans"),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.struct(
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], x["end"]).alias("at"),
        ),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))),
    )
    return found.withColumn("text", F.when(F.col("text").isNotNull(), pieces)).select(*names)
