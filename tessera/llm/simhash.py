"""Near-duplicates by 64-bit SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 4 bits have a common variant within 2 flips of either, so every fingerprint
emits its variants, equal variants meet in a shuffle, and what meets is linked. A ball of radius 2 has 2081 variants,
and most fingerprints have no neighbour, so they are enumerated in three steps, each for what met another in the step
before. The bits form three groups; of 4 differing bits two are in one group, so the other two groups (42 or 43 bits)
differ in at most 2 bits, and variants with at most one flip there must meet: 131 rows a fingerprint. Then a third of
the group left out is added, such that the bits still left out hold two of the differing bits, then the rest.
By chance a row meets others in 43 bits at a rate of 44 N / 2^43: 5 % at N = 10^10 distinct fingerprints. These go on to
50 bits, where the rate is 51 N / 2^50, below 0.1 %, so the variants of whole balls are made for near fingerprints alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.shared import components, cut, free_shuffles, hex64, keyed, small_batches

SHINGLE = 4
MAX_DISTANCE = 4
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE = (np.arange(8) * 256).astype(np.int64)


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 values of the word shingles of a text, repeats included; none where there is no word.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer words is one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.array([], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=False)] or [digest(line, 42)], np.uint64)


def majority(h: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of hash values: a bit is set if it is set in over half of them; 0 where there are none."""
    if not len(h):
        return 0
    octets = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _BYTE).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((counts.ravel() * 2 > len(h)), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, repeated shingles counted each time; 0 where there is no word."""
    return majority(hashes(text, shingle))


def with_fingerprints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, key, fp) of rows (doc_id, text, key): fp the fingerprint as a signed long. Row-wise, no shuffle; a text at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "key", "fp"])

    small_batches(rows.sparkSession)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("fp", T.LongType())])
    return rows.select("doc_id", "key", "text").mapInArrow(run, schema)


GROUPS = [[range(0, 8), range(8, 15), range(15, 22)], [range(22, 29), range(29, 36), range(36, 43)], [range(43, 50), range(50, 57), range(57, 64)]]
"""The bits of a fingerprint in three groups, each in three parts."""


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _mask(bits: Iterable[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _flips(bits: Iterable[int], most: int) -> list[int]:
    """Masks over the given bits with at most ``most`` (0, 1 or 2) of them set, as signed longs."""
    return [_mask(c) for n in range(most + 1) for c in combinations(bits, n)]


def _constant(rows: list[tuple[int, ...]]) -> Column:
    """A constant array of structs of longs from literals, folded when the plan is made."""
    columns = [F.split(F.lit(",".join(map(str, c))), ",").cast("array<bigint>") for c in zip(*rows, strict=True)]
    return F.arrays_zip(*columns)


def _met(rows: DataFrame, keep: list[int], parts: int) -> DataFrame:
    """The rows (fp, at, part) that meet another fingerprint's, with ``flipped``: equal ``at`` and ``part``. A row with a flip
    counts only where the fingerprints' own bits differ, for else they meet without it.

    One shuffle of three numbers a row. A bucket's size does not follow the corpus: it holds distinct fingerprints of one
    pattern in 42 bits or more, a family of near copies or a chance meeting of a few.
    """
    dealt = rows.repartition(parts, "at", "part")
    own = F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(k) for k in keep]), F.col("at") + 1))
    dealt = dealt.withColumns({"own": own, "flipped": own != F.col("part")})
    w = Window.partitionBy("at", "part")
    met = dealt.withColumns({"other": F.min("fp").over(w) != F.max("fp").over(w), "differ": F.min("own").over(w) != F.max("own").over(w)})
    return met.filter(F.col("other") & (~F.col("flipped") | F.col("differ"))).select("fp", "at", "part", "flipped")


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Edges (u, v) among the distinct fingerprints ``fps.fp`` such that the components of the edges are
    those of "differ in at most max_distance bits". ``max_distance`` is 4.

    No pair of a bucket is emitted: all members of a variant's bucket are within the distance of each
    other, so each is linked to the bucket's least. A bucket has at most 2081 fingerprints.
    """
    if max_distance != 4:
        raise ValueError("the enumeration is laid out for a distance of 4")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = [[b for part in g for b in part] for g in GROUPS]
    outer = [_mask(b for b in range(64) if b not in g) for g in bits]
    first = [(g, f) for g in range(3) for f in _flips([b for b in range(64) if b not in bits[g]], 1)]
    rows = fps.repartition(parts, "fp").select("fp", F.inline(_constant(first)).alias("at", "flip"))
    keep = F.element_at(F.array(*[F.lit(k) for k in outer]), (F.col("at") + 1).cast("int"))
    part = F.col("fp").bitwiseAND(keep).bitwiseXOR(F.col("flip"))
    met = cut(_met(rows.select("fp", F.col("at").cast("int").alias("at"), part.alias("part")), outer, parts))

    def chosen(of: Callable[[int, int], list[tuple[int, ...]]], keys: list[int]) -> Column:
        """The constant array that fits a row's ``at`` and ``flipped``."""
        out = F.lit(None)
        for k in keys:
            for flipped in (0, 1):
                out = F.when((F.col("at") == k) & (F.col("flipped") == bool(flipped)), _constant(of(k, flipped))).otherwise(out)
        return out

    # a third of the group left out comes in: at = 3 * group + part; what met is dealt out anew, as its rows multiply
    second = lambda g, flipped: [(3 * g + i, _mask(p), f) for i, p in enumerate(GROUPS[g]) for f in _flips(p, 1 - flipped)]
    inner = [_signed((outer[g] | _mask(p)) % (1 << 64)) for g in range(3) for p in GROUPS[g]]
    rows = met.repartition(parts, "fp", "at", "part").select("fp", F.col("part").alias("known"), F.inline(chosen(second, [0, 1, 2])).alias("to", "add", "flip"))
    part = F.col("known").bitwiseOR(F.col("fp").bitwiseAND(F.col("add"))).bitwiseXOR(F.col("flip"))
    met = cut(_met(rows.select("fp", F.col("to").cast("int").alias("at"), part.alias("part")), inner, parts))

    left = {3 * g + i: [b for b in bits[g] if b not in p] for g in range(3) for i, p in enumerate(GROUPS[g])}
    third = lambda at, flipped: [(_mask(left[at]), f) for f in _flips(left[at], 2 - flipped)]
    full = met.repartition(parts, "fp", "at", "part").select("fp", "part", F.inline(chosen(third, list(left))).alias("rest", "flip"))
    found = full.select("fp", F.col("part").bitwiseOR(F.col("fp").bitwiseAND(F.col("rest"))).bitwiseXOR(F.col("flip")).alias("variant"))
    least = found.select("fp", F.min("fp").over(Window.partitionBy("variant")).alias("root")).filter("fp <> root")
    return least.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("root"))) <= max_distance).select(F.col("fp").alias("u"), F.col("root").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE, text: str = "text") -> DataFrame:
    """(doc_id, key, fp, component_id, component_key): the class of every row of ``docs`` (doc_id, text, ...).

    component_id is the smallest doc_id reachable through links, its own included. Null and empty texts
    and texts of white space have fingerprint 0 and are linked to each other like any others. Repeated
    rows each get a row; a null doc_id sorts before all others. Copies collapse into one fingerprint
    before anything is compared. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = keyed(docs.select("doc_id", F.col(text).alias("text")))
    prints = cut(with_fingerprints(rows, shingle))
    classes = cut(prints.groupBy("fp").agg(F.min(F.struct("key", "doc_id")).alias("first")))
    roots = components(links(classes.select("fp"), max_distance))
    free_shuffles(spark)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    tops = named.groupBy("component").agg(F.min("first").alias("top"))
    named = cut(named.join(tops, "component").select("fp", F.col("top.doc_id").alias("component_id"), F.col("top.key").alias("component_key")))
    return prints.join(named, "fp").select("doc_id", "key", "fp", "component_id", "component_key")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` without all but the first row, by (doc_id, text), of each class; columns as they were."""
    name = "\x00row"
    rows = keyed(docs, name)
    found = near_duplicates(rows.select(F.col(name).alias("doc_id"), "text"), shingle, max_distance)
    dropped = found.filter("key <> component_key").select(F.col("doc_id").alias(name))
    return rows.join(dropped, name, "left_anti").select(*docs.columns)


def digest(marked: DataFrame) -> DataFrame:
    """The columns that a report needs: doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    return marked.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
