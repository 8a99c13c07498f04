"""Hard negatives of anchors by exact integer scores, computed with tables of subset sums.

Vectors are whole numbers. Candidates are stored as bit planes: a byte holds one bit of eight neighbouring places.
For an anchor and eight places a table has the sums of all 256 subsets of the anchor's numbers, so that a plane's share
of the inner product is one look-up for each eight places, and the product is the planes' shares shifted and added.

Anchors and candidates meet in blocks, every anchor's with every candidates', and a pair of blocks gives only each
anchor's best few. What is shuffled is the anchors once for each block of candidates, and the candidates once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.shared import cut, discard

PLACES = 8
ANCHORS, CANDIDATES, SLICE = 256, 131072, 2048
"""Most rows of a block of anchors and of a block of candidates, and the candidates that are scored at a time."""
TOP = 5
EASY, HARD = 80, 100
"""Percent of the positive's score that a negative has at least and at most."""

BLOCK = "block long, ids binary, labels binary, low long, width int, planes int, bytes binary"
ANCHOR = "block long, ids binary, labels binary, width int, item int, numbers binary"


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as longs; NULL for a vector that is null or has a null or non-finite one."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~odd, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def tables(numbers: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """Subset sums [group, subset, anchor] of whole numbers [anchor, place]; the places are a multiple of eight."""
    n, width = numbers.shape
    out = np.zeros((width // PLACES, 1 << PLACES, n), kind)
    grouped = numbers.T.reshape(width // PLACES, PLACES, n).astype(kind)
    for bit in range(PLACES):
        half = 1 << bit
        out[:, half : 2 * half] = out[:, :half] + grouped[:, bit, None]
    return out


def planes(numbers: np.ndarray, low: int, count: int) -> np.ndarray:
    """Bit planes [plane, group, candidate] of numbers [candidate, place] less ``low``, eight places a byte."""
    n, width = numbers.shape
    raised = (numbers - low).astype(np.uint64)
    bits = [np.packbits((raised >> np.uint64(b) & np.uint64(1)).astype(np.uint8).reshape(n, width // PLACES, PLACES), axis=2, bitorder="little")[:, :, 0].T for b in range(count)]
    return np.stack(bits) if bits else np.zeros((0, width // PLACES, n), np.uint8)


def scores(table: np.ndarray, bits: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Inner products [candidate, anchor]: ``base`` is an anchor's product with a vector of all ``low``."""
    out = np.zeros((bits.shape[2], table.shape[2]), table.dtype)
    part = np.empty_like(out)
    for plane in bits[::-1]:
        out <<= 1
        for group, byte in zip(table, plane, strict=False):
            out += np.take(group, byte, axis=0, out=part)
    return out + base


def _padded(vectors: list[np.ndarray]) -> np.ndarray:
    """The vectors with zeros after their end, to a common multiple of eight places."""
    width = -(-max((len(v) for v in vectors), default=0) // PLACES) * PLACES
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _blocks(rows: DataFrame, count: int, pack: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple], schema: str) -> DataFrame:
    """The rows (id, label, numbers) in ``count`` blocks, dealt by the hash of their unique id; a block is one row, ordered by (label, id)."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def made(block: int, held: list[tuple]) -> pa.RecordBatch:
        ids, labels, vectors = zip(*sorted(held, key=lambda r: (r[1], r[0])), strict=True)
        values = (block, *pack(np.array(ids, np.int64), np.array(labels, np.int64), _padded(vectors)))
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for b in batches:
            for now, *row in zip(*(c.to_pylist() for c in b.columns[:3]), _vectors(b.column(3)), strict=True):
                if now != block and held:
                    yield made(block, held)
                    held = []
                block = now
                held.append(tuple(row))
        if held:
            yield made(block, held)

    dealt = rows.select(_block(F.col("id"), count).alias("block"), "id", "label", "numbers")
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def _block(key: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count))


def _pack_candidates(ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray) -> tuple:
    low, high = int(numbers.min(initial=0)), int(numbers.max(initial=0))
    count = (high - low).bit_length()
    if count > 55:
        raise ValueError("scores of these vectors do not fit in 56 bits")
    return ids.tobytes(), labels.tobytes(), low, numbers.shape[1], count, planes(numbers, low, count).tobytes()


def _pack_anchors(ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray) -> tuple:
    kind = next(k for k in (np.int16, np.int32, np.int64) if k is np.int64 or np.abs(numbers).max(initial=0) <= np.iinfo(k).max)
    return ids.tobytes(), labels.tobytes(), numbers.shape[1], np.dtype(kind).itemsize, numbers.astype(kind).tobytes()


class _Pair:
    """A block of anchors and one of candidates: their ids and labels, and scores of slices of candidates."""

    def __init__(self, pairs: pa.RecordBatch, i: int):
        field = lambda name: pairs.column(name)[i].as_py()
        array = lambda name, kind: np.frombuffer(pairs.column(name)[i].as_buffer(), kind)
        self.a_ids, self.a_labels = array("a_ids", np.int64), array("a_labels", np.int64)
        self.ids, self.labels = array("ids", np.int64), array("labels", np.int64)
        width, low, count = field("width"), field("low"), field("planes")
        self.bits = array("bytes", np.uint8).reshape(count, width // PLACES, len(self.ids))
        numbers = array("numbers", f"i{field('item')}").reshape(len(self.a_ids), field("a_width")).astype(np.int64)
        numbers = np.pad(numbers, ((0, 0), (0, max(0, width - numbers.shape[1]))))[:, :width]  # places that one side lacks add nothing
        bound = int(np.abs(numbers.astype(float)).sum(axis=1).max(initial=0)) * ((1 << count) + abs(low))
        if bound >= 1 << 56:
            raise ValueError("scores of these vectors do not fit in 56 bits")
        kind = np.int32 if bound < 1 << 31 else np.int64
        self.table, self.base = tables(numbers, kind), (numbers.sum(axis=1) * low).astype(kind)

    def scores(self, first: int, last: int, take: np.ndarray) -> np.ndarray:
        return scores(self.table[:, :, take], self.bits[:, :, first:last], self.base[take]).astype(np.int64)


def _rows(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _best(s: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``top`` highest of each column of scores; of equal ones the smaller ids, which ascend."""
    if len(s) > top:
        edge = np.partition(s, len(s) - top, axis=0)[len(s) - top]
        row, column = np.nonzero(s >= edge)
    else:
        row, column = np.nonzero(np.ones_like(s, bool))
    order = np.lexsort((ids[row], -s[row, column], column))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(column, column, "left")
    return row[place < top], column[place < top]


def _positives(pairs: DataFrame, top: int) -> DataFrame:
    """(anchor_id, id, score): each pair of blocks' best rows of the anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                p, out = _Pair(b, i), []
                for label in np.unique(p.a_labels).tolist():
                    take, (first, last) = np.flatnonzero(p.a_labels == label), np.searchsorted(p.labels, [label, label + 1]).tolist()
                    for lo in range(first, last, SLICE):
                        hi = min(last, lo + SLICE)
                        s, ids, own = p.scores(lo, hi, take), p.ids[lo:hi], np.iinfo(np.int64).min
                        s[ids[:, None] == p.a_ids[take]] = own
                        row, column = _best(s, ids, top)
                        real = s[row, column] > own
                        row, column = row[real], column[real]
                        out.append((p.a_ids[take[column]], ids[row], s[row, column]))
                yield _rows(out, ["anchor_id", "id", "score"])

    return pairs.mapInArrow(run, "anchor_id long, id long, score long")


def _negatives(pairs: DataFrame, top: int) -> DataFrame:
    """(anchor_id, wanted, id, score): each pair of blocks' best rows of other labels for every wanted score of a positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                p, out = _Pair(b, i), []
                wanted = np.frombuffer(b.column("wanted")[i].as_buffer(), np.int64).reshape(len(p.a_ids), top)
                real = wanted >= 0  # of a negative score, 80 % is more than the score itself
                low = np.where(real, -(-wanted * EASY // HARD), np.iinfo(np.int64).max).min(axis=1)
                high, every = wanted.max(axis=1), np.arange(len(p.a_ids))
                for lo in range(0, len(p.ids), SLICE):
                    hi = min(len(p.ids), lo + SLICE)
                    s, ids = p.scores(lo, hi, every), p.ids[lo:hi]
                    row, column = np.nonzero((s >= low) & (s <= high) & (p.labels[lo:hi, None] != p.a_labels))
                    got, name = s[row, column], ids[row]
                    for j in range(top):
                        most = wanted[column, j]
                        fits = np.flatnonzero(real[column, j] & (got <= most) & (got * HARD >= most * EASY))
                        order = fits[np.lexsort((name[fits], -got[fits], column[fits]))]
                        c = column[order]
                        order = order[np.arange(len(c)) - np.searchsorted(c, c, "left") < top]
                        out.append((p.a_ids[column[order]], wanted[column[order], j], name[order], got[order]))
                yield _rows(out, ["anchor_id", "wanted", "id", "score"])

    return pairs.mapInArrow(run, "anchor_id long, wanted long, id long, score long")


def _first(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The ``top`` rows of each key by score and id, numbered from 1; Spark limits them before its shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def mine(vectors: DataFrame, is_anchor: Column, top: int = TOP) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (id, label, numbers).

    ``is_anchor`` says of (id, label) whether a row is an anchor. Its positives are the ``top`` other rows of its label; for
    each of them, the ``top`` rows of other labels that score from EASY to HARD percent of the positive's score. Higher
    scores come first, ties by smaller id, and all rows where there are fewer. A positive of negative score has no
    negative, and one of zero those of zero. ``numbers`` are arrays of longs; where two differ in length, the places that
    one lacks add nothing. id is a key: of rows that repeat one the least (label, numbers) counts. Rows with
    a null take no part; other columns are ignored; an empty table gives an empty result. Scores beyond 56 bits raise.
    """
    known = vectors.filter("id is not null and label is not null and numbers is not null")
    known = known.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("numbers").cast("array<bigint>").alias("numbers"))
    rows = cut(known.groupBy("id").agg(F.min(F.struct("label", "numbers")).alias("row")).select("id", "row.*"))
    asked = rows.filter(is_anchor)
    parts, total = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count()
    n_blocks = max(1, -(-total // CANDIDATES), min(parts, -(-total // SLICE)))
    n_anchors = max(1, -(-asked.count() // ANCHORS))
    blocks = cut(_blocks(rows, n_blocks, _pack_candidates, BLOCK))
    anchors = cut(_blocks(asked, n_anchors, _pack_anchors, ANCHOR))

    def met(side: DataFrame) -> DataFrame:
        """Every block of anchors with every block of candidates; the anchors travel to the candidates."""
        named = side.withColumnsRenamed({"block": "a_block", "ids": "a_ids", "labels": "a_labels", "width": "a_width"})
        spread = named.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))))
        return spread.repartition(n_blocks, "block").join(blocks.repartition(n_blocks, "block").hint("merge"), "block")

    positives = cut(_first(_positives(met(anchors), top), ["anchor_id"], top).select("anchor_id", "id", "score"))
    wanted = cut(_with_wanted(anchors, positives, n_anchors, top))
    best = cut(_first(_negatives(met(wanted), top), ["anchor_id", "wanted"], top))
    named = positives.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("wanted"))
    out = named.join(best, ["anchor_id", "wanted"])
    discard(rows, blocks, anchors, wanted)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("wanted").alias("positive_score"), F.col("score").alias("negative_score"))


def _with_wanted(anchors: DataFrame, positives: DataFrame, n_anchors: int, top: int) -> DataFrame:
    """Blocks of anchors with ``wanted``: the distinct scores of each one's positives, ``top`` longs an anchor, in the block's order."""
    limits = positives.groupBy("anchor_id").agg(F.collect_set("score").alias("scores")).withColumn("block", _block(F.col("anchor_id"), n_anchors))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(right["anchor_id"], right["scores"], strict=True))
        out = []
        for ids in left["ids"]:
            ids = np.frombuffer(ids, np.int64).tolist()
            held = np.full((len(ids), top), np.iinfo(np.int64).min)
            for row, i in zip(held, ids, strict=True):
                got = of.get(i, ())
                row[: len(got)] = got
            out.append(held.tobytes())
        return left.assign(wanted=out)

    return anchors.groupBy("block").cogroup(limits.groupBy("block")).applyInPandas(run, ANCHOR + ", wanted binary")
