"""Near-duplicates by word shingles: ball hashing of SimHash fingerprints, then MinHash bands for the rest, propose pairs;
the exact Jaccard similarity decides.

Texts whose sets of shingles have a Jaccard similarity of at least ``SIMILARITY`` are linked. First come the links of
``simhash.links``, of fingerprints of these shingles that differ in at most 4 bits. A similarity of 0.8 lets about 10 bits
differ, so bands take up what is outside the balls, among texts that those have not joined. A band is the hash of
``ROWS`` minima, so a pair of similarity s shares at least one with probability 1 - (1 - s**ROWS)**BANDS: 0.99998 at 0.8.
Each member of a bucket is held against the bucket's first member, and then, where that left the two apart, against two
members that each bucket picks by another order. That links copies and their edits at a cost that follows the
members. What a bucket then still holds in different components is compared in full: those outside its largest
component with all members, in blocks of which each gives the links of a spanning forest and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import simhash
from tessera.llm.shared import components, cut, discard, free_shuffles, join_sparse, keyed, small_batches

SHINGLE = 5
SIMILARITY = (8, 10)
"""The least similarity as a fraction, so that the test is exact."""
BANDS, ROWS = 28, 5
BLOCK_ROWS, BLOCK_SHINGLES, SLICE = 512, 1 << 18, 4096
"""About so many rows, or shingles if they are long, make a block of a bucket; a product of two blocks takes a slice of shingles at a time."""
_RND = np.random.default_rng(11)
_FACTOR = _RND.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_SHIFT = _RND.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_BAND = [b.to_bytes(1, "little") for b in range(BANDS)]
_EMPTY = np.array([xxhash.xxh64_intdigest(b"", 42)], np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct ``simhash.hashes`` of a text; one without words has the empty shingle."""
    return _distinct(simhash.hashes(text, shingle))


def _distinct(h: np.ndarray) -> np.ndarray:
    return np.unique(h) if len(h) else _EMPTY


def bands(values: np.ndarray) -> list[int]:
    """The signed bucket number of each band."""
    least = np.full(len(_FACTOR), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 1024):
        np.minimum(least, (values[i : i + 1024, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    raw = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(no + r.tobytes()) for no, r in zip(_BAND, raw, strict=True)], np.uint64).view(np.int64).tolist()


def _prints(rows: DataFrame, shingle: int) -> DataFrame:
    """(key, set_id, n, fp, buckets) of rows (key, text); n is the number of shingles, fp the fingerprint of ``simhash``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = [simhash.hashes(t.as_py(), shingle) for t in b.column(1)]
            sets = [_distinct(h) for h in all_]
            fp = np.fromiter((simhash.majority(h) for h in all_), np.uint64, len(all_)).view(np.int64)
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids), n, pa.array(fp), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["key", "set_id", "n", "fp", "buckets"])

    small_batches(rows.sparkSession)
    return rows.select("key", "text").mapInArrow(run, "key long, set_id long, n long, fp long, buckets array<long>")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(key, members) of rows (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), shingle).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["key", "members"])

    return rows.select("key", "text").mapInArrow(run, "key long, members array<long>")


def _similar(pairs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """The pairs (u, v) that reach the similarity; only the texts of pairs are read in again."""
    nodes = pairs.select(F.col("u").alias("key")).union(pairs.select(F.col("v").alias("key"))).distinct()
    sets = cut(_sets(join_sparse(rows.select("key", "text"), nodes), shingle))
    held = pairs.join(sets.select(F.col("key").alias("u"), F.col("members").alias("a")), "u").join(sets.select(F.col("key").alias("v"), F.col("members").alias("b")), "v")
    held = held.select("u", "v", F.size("a").alias("n"), F.size("b").alias("m"), F.size(F.array_intersect("a", "b")).cast("long").alias("both"))
    part, whole = SIMILARITY
    out = cut(held.filter(F.col("both") * whole >= (F.col("n") + F.col("m") - F.col("both")) * part).select("u", "v"))
    discard(sets)
    return out


def forest(a: list[tuple[int, np.ndarray]], b: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links between components: a spanning forest of those that a pair of sorted sets (component, set) of ``a`` and ``b`` joins."""
    ta, tb = np.concatenate([s for _, s in a]), np.concatenate([s for _, s in b])
    ia, ib = (np.repeat(np.arange(len(x)), [len(s) for _, s in x]) for x in (a, b))
    shared = np.intersect1d(ta, tb)

    def placed(tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, tokens)
        real = shared[np.minimum(at, len(shared) - 1)] == tokens
        order = np.argsort(at[real], kind="stable")
        return at[real][order], owner[real][order]

    if not len(shared):
        return []
    (pa_, oa), (pb, ob) = placed(ta, ia), placed(tb, ib)
    both = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, len(shared), SLICE):
        some = []
        for at, owner, n in ((pa_, oa, len(a)), (pb, ob, len(b))):
            lo, hi = np.searchsorted(at, [first, first + SLICE])
            m = np.zeros((n, min(SLICE, len(shared) - first)), np.float32)
            m[owner[lo:hi], at[lo:hi] - first] = 1
            some.append(m)
        both += some[0] @ some[1].T
    na, nb = (np.array([len(s) for _, s in x], np.int64) for x in (a, b))
    both = both.astype(np.int64)
    part, whole = SIMILARITY
    hits = np.argwhere(both * whole >= (na[:, None] + nb - both) * part)
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in hits.tolist():
        u, v = top(a[i][0]), top(b[j][0])
        if u != v:
            root[max(u, v)] = min(u, v)
            out.append((max(u, v), min(u, v)))
    return out


def _still_apart(met: DataFrame, named: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """Links (u, v) between components that buckets still hold apart, from all pairs that no pick has settled.

    ``met`` (key, bucket, n, first) are the buckets' members, ``named`` (node, component) the components so far. A bucket of any
    size is many pairs of blocks, each a group of bounded size.
    """
    held = met.filter(F.col("key") != F.col("first")).join(named.select(F.col("node").alias("key"), "component"), "key", "left")
    members = cut(held.select("bucket", "key", "n", F.coalesce("component", "key").alias("component")))
    parts = members.groupBy("bucket", "component").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    of = parts.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("major"), F.max_by("s", F.struct("c", "component")).alias("ms"), F.max("c").alias("mc"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    blocks = lambda rows_, size: F.ceil(F.greatest(rows_ / BLOCK_ROWS, size / BLOCK_SHINGLES, F.lit(1.0)))
    of = of.filter("c > mc and c > 2").select("bucket", "major", blocks(F.col("c"), F.col("s")).alias("nb"), blocks(F.col("c") - F.col("mc"), F.col("s") - F.col("ms")).alias("na"))
    held = cut(members.join(of, "bucket"))
    dealt = lambda n: F.pmod(F.xxhash64("key"), n)
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    a = held.filter(F.col("component") != F.col("major")).select("bucket", dealt(F.col("na")).alias("i"), other("nb").alias("j"), F.lit(0).alias("side"), "key", "component")
    b = held.select("bucket", other("na").alias("i"), dealt(F.col("nb")).alias("j"), F.lit(1).alias("side"), "key", "component")
    sets = cut(_sets(join_sparse(rows.select("key", "text"), held.select("key").distinct()), shingle))
    pairs = a.union(b).join(sets, "key").select("bucket", "i", "j", "side", "component", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sides = None, ([], [])
        for batch in batches:
            out = []
            flat, ends = batch.column(5).values.to_numpy(), batch.column(5).offsets.to_numpy()
            for n, (*now, side, component) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True)):
                if now != group:
                    out += forest(*sides) if sides[0] and sides[1] else []
                    group, sides = now, ([], [])
                sides[side].append((component, flat[ends[n] : ends[n + 1]].copy()))
            yield _pairs(out)
        yield _pairs(forest(*sides) if sides[0] and sides[1] else [])

    key = ["bucket", "i", "j"]
    out = cut(pairs.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "u long, v long").distinct())
    discard(sets, members, held)
    return out


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["u", "v"])


def in_balls(reps: DataFrame) -> DataFrame:
    """Pairs (u, v) of keys of ``reps`` (key, fp) that ball hashing proposes: each link of fingerprints as one of the first keys
    that have them, and every other key with its fingerprint's first."""
    firsts = cut(reps.groupBy("fp").agg(F.min("key").alias("first")))
    linked = cut(simhash.links(firsts.select("fp")))
    of = lambda fp, key: firsts.select(F.col("fp").alias(fp), F.col("first").alias(key))
    far = linked.join(of("u", "a"), "u").join(of("v", "b"), "v").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    equal = reps.join(firsts, "fp").filter("key <> first").select(F.col("key").alias("u"), F.col("first").alias("v"))
    out = cut(far.union(equal).distinct())
    discard(firsts, linked)
    free_shuffles(reps.sparkSession)
    return out


def classes(reps: DataFrame, rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, component) for the rows ``reps`` (key, n, fp, buckets), one of each set of shingles, that aren't the first of their
    component; ``rows`` (key, text) has their texts.

    Buckets take a group-by with map-side combine and a join that adaptive execution can split, so a large
    family of near copies is no task of its own.
    """
    spread = reps.select("key", "n", F.explode("buckets").alias("bucket"))
    other = F.col("key").bitwiseXOR(F.col("bucket"))  # an order for each bucket that can be undone
    picked = spread.groupBy("bucket").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.min(other).alias("low"), F.max(other).alias("high"))
    picked = cut(picked.filter("first <> last").drop("last"))  # written, so that the join's both sides come straight from a shuffle
    met = cut(spread.join(picked, "bucket").select("bucket", "key", "n", "first", F.col("low").bitwiseXOR(F.col("bucket")).alias("low"), F.col("high").bitwiseXOR(F.col("bucket")).alias("high")))

    def paired(v: str) -> DataFrame:
        return met.filter(F.col("key") != F.col(v)).select(F.greatest("key", v).alias("u"), F.least("key", v).alias("v"))

    balls = in_balls(reps)
    named = components(_similar(balls, rows, shingle))
    for picks in (paired("first"), paired("low").union(paired("high"))):
        rest = picks.distinct().join(named.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(named.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
        rest = cut(rest.select("u", "v", F.coalesce("cu", "u").alias("cu"), F.coalesce("cv", "v").alias("cv")).filter("cu <> cv"))
        more = _similar(rest.select("u", "v"), rows, shingle).join(rest, ["u", "v"])
        named = cut(_onward(named, components(more.select(F.col("cu").alias("u"), F.col("cv").alias("v")))))
        discard(rest)
    out = _onward(named, components(_still_apart(met, named, rows, shingle)))
    discard(picked, met, balls)
    return out


def _onward(named: DataFrame, tops: DataFrame) -> DataFrame:
    """(node, component) where components themselves were linked: ``tops`` (node, component) of components."""
    joined = named.join(tops.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    return joined.select("node", F.coalesce("top", "component").alias("component")).union(tops)


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without all but the first row, by (doc_id, text), of each class; columns as they were.

    Classes are the components of the links. Equal sets of shingles collapse into one row before anything is
    compared; null and empty texts and texts of white space are equal. An empty table gives an empty result.
    """
    name = "\x00row"
    all_rows = keyed(docs, name)
    rows = all_rows.select(F.col(name).alias("key"), "text")
    prints = cut(_prints(rows, shingle))
    firsts = prints.groupBy("set_id").agg(F.min("key").alias("key"))
    reps = cut(prints.join(firsts.select("key"), "key", "left_semi").select("key", "n", "fp", "buckets"))
    later = classes(reps, rows, shingle).select(F.col("node").alias("key"))
    kept = reps.select("key").join(later, "key", "left_anti")
    dropped = cut(prints.select(F.col("key").alias(name)).join(kept.withColumnRenamed("key", name), name, "left_anti"))
    discard(prints, reps)
    free_shuffles(docs.sparkSession)
    return all_rows.join(dropped, name, "left_anti").select(*docs.columns)
