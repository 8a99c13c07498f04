"""Benchmark decontamination by the q-gram lemma and banded alignment.

A stretch of text within k edits of a passage of m characters shares at least m - q + 1 - k q of its q-grams, all
on diagonals that differ by at most k. Shared q-grams are counted in bands of diagonals that overlap, so that any
such stretch lies in one band; bands that meet the bound are verified by banded alignment. A q-gram that a passage
repeats often, as periodic ones do, is not met place by place: where a band's stretch of text has it at all, all its places
in the passage count as shared, which never counts too few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.shared import cut, join_sparse, keyed, small_batches

Q = 10
ERROR_RATE = 0.08
"""Edits allowed per character of a passage, whole text against whole passage; fewer where the bound would not filter."""
INDEX_BYTES = 4_000_000
"""Passage bytes of an index that goes to every task. The q-grams of a larger benchmark stay a table and meet the texts' in a join."""
FILTER_BITS = 24
"""Bits of a q-gram's hash that the filter before the join looks at: 2 MB for any benchmark."""
STRETCH = 1_000_000
OFTEN = 16
"""Places of one q-gram in one passage from which on they are not met one by one."""
COMMON = 64
"""Places of one q-gram in all passages of the joined way beyond which a passage is asked for by its rarer q-grams."""
BAND = 65_536
"""Diagonals that are aligned at once, where neighbouring blocks ask for it."""
MEETINGS = 2_000_000
"""Meetings of q-grams that are counted at a time."""

# ASCII signs that stand for a space when texts are compared.
SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())
_SPACES = bytes.maketrans(SIGNS, b" " * len(SIGNS))
_BASE = np.uint64(0x5851F42D4C957F2D)
_BYTE = np.random.Generator(np.random.PCG64(4)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("edits", T.IntegerType())]))


def normal(text: str | None) -> bytes:
    """Lower case, ASCII signs as spaces, one space between words, as UTF-8."""
    return b" ".join((text or "").lower().encode().translate(_SPACES).split())


def budget(m: int, q: int = Q, rate: float = ERROR_RATE) -> int:
    """Edits allowed for a passage of m bytes: the rate's, or as many as leave one shared q-gram to ask for."""
    return max(0, min(int(m * rate), (m - q) // q))


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q-grams that start at each byte."""
    h = np.zeros(max(0, len(data) - q + 1), np.uint64)
    with np.errstate(over="ignore"):
        v = _BYTE[data]
        for j in range(q if len(h) else 0):
            h = h * _BASE + v[j : j + len(h)]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


class Index:
    """Q-grams of passages (item_id, text), sorted by hash, and a bit table that most texts' q-grams fail."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = ERROR_RATE):
        norm = [(i, normal(t)) for i, t in items]
        self.q = q
        self.items = [(i, b) for i, b in norm if len(b) >= q]
        size = np.array([len(b) for _, b in self.items], np.int64)
        self.k = np.array([budget(len(b), q, rate) for _, b in self.items], np.int64)
        self.need = size - q + 1 - self.k * q
        self.lead = -(-size // (self.k + 1))
        """Blocks of diagonals before that of 0, as a diagonal is a text's place less a passage's."""
        grams = [_grams(np.frombuffer(b, np.uint8), q) for _, b in self.items]
        h = np.concatenate([np.zeros(0, np.uint64), *grams])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.lexsort((place, item, h))
        h, item, place = h[order], item[order], place[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (item[1:] != item[:-1]))))
        count = np.diff(np.concatenate((new, [len(h)])))
        one_by_one = np.repeat(count <= OFTEN, count)
        self.hash, self.item, self.place = h[one_by_one], item[one_by_one], place[one_by_one]
        many = new[count > OFTEN]
        self.many_hash, self.many_item, self.many_count = h[many], item[many], count[count > OFTEN]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(h >> np.uint64(42)).astype(np.int64)] = True

    def leaks(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text one entry for each passage in it: where in the normal text, and with how few edits."""
        out: list[list[dict]] = [[] for _ in texts]
        if not self.items:
            return out
        docs = [normal(t) for t in texts]
        size = np.array([len(d) for d in docs], np.int64)
        ends = np.cumsum(size)
        h = _grams(np.frombuffer(b"".join(docs), np.uint8), self.q)
        at = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        doc = np.searchsorted(ends, at, "right")
        spot, blocks = at - (ends - size)[doc], int((size.max(initial=0) + self.q) // int(self.k.min() + 1) + self.lead.max() + 2)

        def counted(hashes: np.ndarray, key_of) -> tuple[np.ndarray, np.ndarray]:
            """Distinct keys of the meetings with ``hashes`` and how often each came, from MEETINGS at a time."""
            first, last = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
            held = np.flatnonzero(last > first)
            times = np.cumsum((last - first)[held])
            keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            done = 0
            while done < len(held):
                upto = max(done + 1, int(np.searchsorted(times, (times[done - 1] if done else 0) + MEETINGS, "right")))
                some = held[done:upto]
                count = (last - first)[some]
                entry = np.repeat(first[some] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                got, c = np.unique(key_of(entry, np.repeat(some, count)), return_counts=True)
                keys, place = np.unique(np.concatenate((keys, got)), return_inverse=True)
                n = np.bincount(place, np.concatenate((n, c)), len(keys)).astype(np.int64)
                done = upto
            return keys, n

        def band_key(entry: np.ndarray, i: np.ndarray) -> np.ndarray:
            item = self.item[entry]
            block = (spot[i] - self.place[entry]) // (self.k[item] + 1) + self.lead[item]
            return (doc[i] * len(self.items) + item) * blocks + block

        def spot_key(entry: np.ndarray, i: np.ndarray) -> np.ndarray:
            return (doc[i] * len(self.many_hash) + entry) * blocks + spot[i] // (self.k[self.many_item[entry]] + 1)

        keys, n = counted(self.hash, band_key)
        pair, block = np.divmod(keys, blocks)
        after = np.concatenate(((keys[1:] == keys[:-1] + 1) & (pair[1:] == pair[:-1]), np.zeros(min(1, len(keys)), bool)))
        band = n + np.where(after, np.concatenate((n[1:], np.zeros(min(1, len(n)), np.int64))), 0)
        credit = self._credit(counted(self.many_hash, spot_key)[0], blocks, size)
        asked: dict[tuple[int, int], list[int]] = {}
        for j in np.flatnonzero(band >= self.need[pair % len(self.items)]):
            asked.setdefault(divmod(int(pair[j]), len(self.items)), []).append(int(block[j]))
        for (d, i), more in credit.items():
            own = slice(*np.searchsorted(pair, [d * len(self.items) + i, d * len(self.items) + i + 1]))
            np.add.at(more, block[own], n[own])
            later = np.maximum(block[own] - 1, 0)
            np.add.at(more, later[block[own] > 0], n[own][block[own] > 0])
            asked[d, i] = np.flatnonzero(more >= self.need[i]).tolist()
        for d, i in sorted(k for k, v in asked.items() if v):
            best, w = None, int(self.k[i]) + 1
            whole = docs[d].find(self.items[i][1])
            if whole >= 0:
                best = 0, whole, whole + len(self.items[i][1])
            for first, last in _runs(asked[d, i], BAND // w) if best is None else []:
                low, high = ((j - int(self.lead[i])) * w for j in (first, last + 2))
                found = align(self.items[i][1], docs[d], low, high - 1, w - 1)
                if found and (best is None or found[0] < best[0]):
                    best = found
            if best:
                out[d].append({"item_id": self.items[i][0], "start": best[1], "stop": best[2], "edits": best[0]})
        return out

    def _credit(self, keys: np.ndarray, blocks: int, size: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """For each (text, passage) that share an often repeated q-gram, by block of diagonals: the places in the passage of such
        q-grams that are anywhere in the block's band."""
        pair, where = np.divmod(keys, blocks)
        out: dict[tuple[int, int], np.ndarray] = {}
        if not len(pair):
            return out
        new = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        for a, b in zip(new, np.concatenate((new[1:], [len(pair)])), strict=True):
            d, entry = divmod(int(pair[a]), len(self.many_hash))
            i = int(self.many_item[entry])
            lead = int(self.lead[i])
            more = out.setdefault((d, i), np.zeros(int(size[d]) // (int(self.k[i]) + 1) + lead + 2, np.int64))
            step = np.zeros(len(more) + 1, np.int64)  # a place of the text is in the bands of two blocks before its own to lead after it
            np.add.at(step, np.maximum(where[a:b] - 2, 0), 1)
            np.add.at(step, np.minimum(where[a:b] + lead + 1, len(more)), -1)
            more[np.cumsum(step)[:-1] > 0] += self.many_count[entry]
        return out


def _runs(blocks: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring blocks as (first, last), of at most ``most`` + 1 blocks."""
    first = last = None
    for j in sorted(set(blocks)):
        if first is not None and (j > last + 1 or last - first >= most):
            yield first, last
            first = None
        first, last = j if first is None else first, j
    if first is not None:
        yield first, last


def align(passage: bytes, text: bytes, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, stop) of the stretch of ``text`` nearest to the passage among alignments that start on the
    diagonals low..high (text position less passage position) and stray up to k from them; None beyond k edits."""
    m, begin = len(passage), max(0, low)
    exact = text.find(passage, begin, max(0, high) + m)
    if exact >= 0:
        return 0, exact, exact + m
    low, high = low - k, high + k
    width = high - low + 1
    t = np.frombuffer(text, np.uint8)
    spread = np.arange(width)
    big = m + len(text) + 1
    # cell (i, d): least edits of passage[:i] against text[s : i + low + d], s free; origin holds s
    column = low + spread
    cost = np.where((column >= 0) & (column <= len(t)), 0, big)
    origin = column.copy()
    for i in range(1, m + 1):
        column = i + low + spread
        valid = (column >= 0) & (column <= len(t))
        char = np.where((column >= 1) & (column <= len(t)), t[np.clip(column - 1, 0, max(0, len(t) - 1))] if len(t) else 0, -1)
        step = cost + (char != passage[i - 1])
        step[(column < 1) | (column > len(t))] = big
        drop = np.concatenate((cost[1:] + 1, [big]))  # passage byte without a partner
        new = np.minimum(step, drop)
        came = np.where(step <= drop, origin, np.concatenate((origin[1:], [0])))
        lead = np.minimum.accumulate(new - spread)  # text bytes without a partner, along the row
        source = np.maximum.accumulate(np.where(new - spread == lead, spread, 0))
        cost = np.where(valid, np.minimum(lead + spread, big), big)
        origin = came[source]
    end = int(np.argmin(cost))
    return (int(cost[end]), int(origin[end]), m + low + end) if cost[end] <= k else None


def _leak_type() -> pa.DataType:
    return pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("edits", pa.int32())]))


def _stretches(column: pa.Array) -> Iterator[list[str | None]]:
    held, size = [], 0
    for x in column:
        t = x.as_py()
        held.append(t)
        size += len(t or "")
        if size > STRETCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _mark_by_index(docs: DataFrame, passages: DataFrame, text: str, leaks: str) -> DataFrame:
    """Row-wise with the whole index in every task, for passages of INDEX_BYTES at most."""
    return _indexed(docs, [(r.item_id, r.text) for r in passages.orderBy("item_id", "text").collect()], text, leaks)


def _indexed(docs: DataFrame, passages: list[tuple[int, str]], text: str, leaks: str) -> DataFrame:
    index, at = Index(passages), docs.columns.index(text)
    schema = T.StructType([*docs.schema, T.StructField(leaks, LEAKS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for texts in _stretches(b.column(at)) for x in index.leaks(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, _leak_type())], schema.names)

    return docs.mapInArrow(run, schema)


def _items(passages: DataFrame) -> DataFrame:
    """(item, item_id, passage, k, need) of the passages that have q-grams; item numbers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [(i, n, d, k, len(d) - Q + 1 - k * Q) for i, n, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if len(d := normal(t)) >= Q for k in [budget(len(d))]]
            columns = zip(*kept, strict=True) if kept else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], ["item", "item_id", "passage", "k", "need"])

    numbered = passages.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("bigint").alias("item_id"), "text")
    return numbered.mapInArrow(run, "item long, item_id long, passage binary, k int, need int")


def _item_grams(items: DataFrame) -> DataFrame:
    """(gram, item, place, k, need): every q-gram of every passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [_grams(np.frombuffer(d.as_py(), np.uint8), Q) for d in b.column(1)]
            of = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            h = np.concatenate([np.zeros(0, np.uint64), *grams]).view(np.int64)
            place = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(g), dtype=np.int32) for g in grams)])
            take = [b.column(i).to_numpy()[of] for i in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(take[0]), pa.array(place), pa.array(take[1]), pa.array(take[2])], ["gram", "item", "place", "k", "need"])

    return items.select("item", "passage", "k", "need").mapInArrow(run, "gram long, item long, place int, k int, need int")


def _mark_by_join(docs: DataFrame, passages: DataFrame, text: str, leaks: str) -> DataFrame:
    """The same for a benchmark of any size: q-grams of texts that pass a bit table meet the passages' rarer ones in a join, bands
    are counted by group-bys, and texts with a band that meets the bound are aligned. Needs a column ``doc_id``.

    Passages that repeat q-grams so often that few of their places are alone make indexes of INDEX_BYTES each, a pass over the texts each."""
    name = "\x00row"
    rows = keyed(docs, name)
    whole = rows.select(name, F.col(text).alias("text"))
    items = cut(_items(passages))
    every = cut(_item_grams(items))
    many = every.groupBy("item", "gram").agg(F.count("*").alias("n"), F.min("need").alias("need")).filter(F.col("n") > OFTEN)
    periodic = cut(many.groupBy("item").agg(F.sum("n").alias("n"), F.min("need").alias("need")).filter("n >= need").select("item"))
    grams = cut(_asked_by(every.join(periodic, "item", "left_anti")))
    bit = F.shiftrightunsigned("gram", 64 - FILTER_BITS)
    bits = np.zeros(1 << FILTER_BITS, bool)
    for r in grams.groupBy((bit / 32768).cast("int").alias("at")).agg(F.bitmap_construct_agg(bit % 32768).alias("bits")).collect():
        bits[r["at"] * 32768 : (r["at"] + 1) * 32768] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
    packed = np.packbits(bits)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(packed).astype(bool)
        for b in batches:
            for key, t in zip(b.column(0), b.column(1), strict=True):
                h = _grams(np.frombuffer(normal(t.as_py()), np.uint8), Q)
                at = np.flatnonzero(table[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key.as_py(), np.int64)), pa.array(h[at].view(np.int64)), pa.array(at.astype(np.int32))], [name, "gram", "at"])

    found = whole.mapInArrow(hits, f"`{name}` long, gram long, at int")
    met = found.join(grams, "gram")
    block = F.floor((F.col("at") - F.col("place") + F.lit(1 << 40)) / (F.col("k") + 1)).alias("block")
    shared = met.groupBy(name, "item", block).agg(F.count("*").alias("n"), F.min("need").alias("need"))
    order = Window.partitionBy(name, "item").orderBy("block")
    band = F.col("n") + F.when(F.lead("block").over(order) == F.col("block") + 1, F.lead("n").over(order)).otherwise(0)
    asked = shared.withColumn("band", band).filter("band >= need").select(name, "item", "block")
    passages_of = cut(asked.join(items, "item").select(name, "item_id", "item", "block", "k", "passage"))
    texts_of = join_sparse(whole, passages_of.select(name).distinct(), "inner", name).select(name, F.lit(-1).cast("bigint").alias("item"), F.col("text"))
    both = texts_of.unionByName(passages_of, allowMissingColumns=True).select(name, "item", "block", "text", "item_id", "k", "passage")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text comes before what is asked of it, a passage and block at a time; one text is held."""
        row, doc, best = None, b"", {}
        for b in batches:
            out = []
            for i in range(b.num_rows):
                now, item = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                if now != row:
                    out.append((row, list(best.values())))
                    row, best = now, {}
                if item < 0:
                    doc = normal(b.column(3)[i].as_py())
                    continue
                if best.get(item, {}).get("edits") == 0:
                    continue
                k = b.column(5)[i].as_py()
                low = b.column(2)[i].as_py() * (k + 1) - (1 << 40)
                got = align(b.column(6)[i].as_py(), doc, low, low + 2 * k + 1, k)
                if got and (item not in best or got[0] < best[item]["edits"]):
                    best[item] = {"item_id": b.column(4)[i].as_py(), "start": got[1], "stop": got[2], "edits": got[0]}
            yield _found(out, name, leaks)
        yield _found([(row, list(best.values()))], name, leaks)

    schema = T.StructType([T.StructField(name, T.LongType()), T.StructField(leaks, LEAKS)])
    held = both.repartition(name).sortWithinPartitions(name, "item", "block").mapInArrow(verify, schema)
    marked = join_sparse(rows, held, "left", name)
    marked = marked.withColumn(leaks, F.coalesce(leaks, F.array().cast(LEAKS)))
    left = periodic.join(items, "item").withColumn("size", F.octet_length("passage"))
    before = F.sum("size").over(Window.partitionBy(F.lit(1)).orderBy("item").rowsBetween(Window.unboundedPreceding, -1))
    group = left.select("item", F.floor(F.coalesce(before, F.lit(0)) / max(1, INDEX_BYTES)).alias("group"))
    left = cut(left.join(group, "item").select("group", "item_id", F.decode("passage", "utf-8").alias("text")))
    for r in left.select("group").distinct().orderBy("group").collect():
        few = [(x.item_id, x.text) for x in left.filter(F.col("group") == r.group).orderBy("item_id", "text").collect()]
        marked = _indexed(marked, few, text, "\x00more").withColumn(leaks, F.concat(leaks, "\x00more")).drop("\x00more")
    return marked


def _found(rows: list[tuple[int | None, list[dict]]], name: str, leaks: str) -> pa.RecordBatch:
    rows = [r for r in rows if r[1]]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], _leak_type())], [name, leaks])


def _asked_by(grams: DataFrame) -> DataFrame:
    """Of (gram, item, place, k, need) the rows by which each passage is asked for, ``need`` less what is left out.

    Left out are the places of q-grams that the passage itself repeats often, then of those that are common among all passages, as
    many as leave the bound at one: a text that has the passage then still shares one of the rarer ones. A q-gram that most texts
    have meets few passages so.
    """
    common = grams.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > COMMON)
    own = F.count("*").over(Window.partitionBy("item", "gram"))
    known = grams.join(common, "gram", "left").withColumn("n", F.when(own > OFTEN, F.lit(1 << 60)).otherwise(F.coalesce("n", F.lit(0))))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("n"), "gram", "place"))
    out = known.withColumn("out", (F.col("n") > 0) & (place < F.col("need")))
    less = F.sum(F.col("out").cast("int")).over(Window.partitionBy("item"))
    return out.withColumn("need", F.col("need") - less).filter("not out").select("gram", "item", "place", "k", "need")


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", leaks: str = "leaks") -> DataFrame:
    """``docs`` with ``leaks`` added: array of (item_id, start, stop, edits), one for each passage in the text.

    Passages of INDEX_BYTES in all, or less, go to every task, and no text is shuffled; of more, the q-grams are joined.
    start and stop are bytes of the normal text. Null and empty texts have no leaks; passages that are null, have no id
    or fewer than q bytes are left out; repeated passages count each. A column of that name is replaced, others pass.
    """
    small_batches(docs.sparkSession)
    out = docs.drop(leaks)
    passages = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    size = passages.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    by = _mark_by_index if size <= INDEX_BYTES else _mark_by_join
    return by(out, passages, text, leaks).select(*out.columns, leaks)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a passage; columns as they were."""
    return mark(docs, benchmark, leaks="\x00leaks").filter(F.size("\x00leaks") == 0).select(*docs.columns)
