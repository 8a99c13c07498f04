"""Removal of repeated 100-byte strings by prefix-free parsing.

Rolling-hash triggers cut the bytes of every document into phrases. The trigger of a 100-byte string is its
least 32-byte window hash (the leftmost of equals), so equal strings have equal triggers at equal places, and
consecutive strings with one trigger form a phrase: the trigger with what surrounds it, at most 168 bytes. Strings
can repeat only where a trigger does, and a phrase that repeats as a whole settles all its strings at once.

Distinct phrases that share a trigger and differ are then dealt out by trigger and brought in order. In each task they
are parsed once more by a short rolling hash, into words that are prefix-free: the suffix array of the dictionary (the
distinct words) and that of the parse (the words of each phrase in turn), both by prefix doubling, combine into the
order of all strings. Of neighbours with 100 common bytes all but the earliest in the corpus are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut, discard, free_shuffles, join_sparse, keyed

LENGTH = 100
TRIGGER = 32
WINDOW, MODULUS = 8, 16
"""The words of a phrase end with an 8-byte window whose hash is 0 modulo 16."""
STRETCH = 1_000_000
"""Bytes of documents that a task looks at together; a longer document is taken in pieces that overlap by 99 bytes."""
HOT = 1_000
"""Distinct phrases of one trigger that one group may hold, so that no task gets an unbounded group. Those of a more
common trigger go string by string through a shuffle that Spark can split; the result is the same."""
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of the hash's base and of its inverse, kept while a task runs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            a, b = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
            a[0] = b[0] = 1
            self.up, self.down = np.cumprod(a), np.cumprod(b)
        return self.up, self.down


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _prefix(data: np.ndarray, powers: Powers) -> np.ndarray:
    _, down = powers.upto(len(data))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * down[: len(data)], dtype=np.uint64)))


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of v[i : i + width] for every i, by doubling."""
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if width > size else v


def parse(docs: list[bytes], powers: Powers) -> tuple[np.ndarray, ...]:
    """Phrases of the documents: (document, trigger hash, phrase hash, first string's start, number of strings)."""
    size = np.array([len(d) for d in docs], np.int64)
    data = np.frombuffer(b"".join(docs), np.uint8)
    ends = np.cumsum(size)
    none = (np.zeros(0, np.int64),) * 5
    if len(data) < LENGTH:
        return none
    s = _prefix(data, powers)
    up, _ = powers.upto(len(data))
    gram = _mix((s[TRIGGER:] - s[:-TRIGGER]) * up[: len(data) - TRIGGER + 1])
    places = np.uint64((1 << 28) - 1)
    ranked = (gram & ~places) | np.arange(len(gram), dtype=np.uint64)
    least = _least(ranked, LENGTH - TRIGGER + 1)
    doc = np.repeat(np.arange(len(docs)), size)[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends[doc])
    if not len(start):
        return none
    at = (least[start] & places).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))))
    first, count = start[new], np.diff(np.concatenate((new, [len(start)])))
    at, d = at[new], doc[start[new]]
    stop = first + count - 1 + LENGTH
    whole = _mix((s[stop] - s[first]) * up[first] + (count * 128 + at - first).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return d, gram[at].view(np.int64), whole.view(np.int64), first - (ends - size)[d], count


class Order:
    """The prefix-free parse of some phrases (blobs) and the order of their 100-byte strings that it gives.

    Places whose ``WINDOW``-byte rolling hash is 0 modulo ``MODULUS`` cut each blob into words; a word runs from one such
    place to the end of the window at the next, so no proper suffix of a word longer than a window is a prefix of
    another's. ``word`` are the distinct words (the dictionary), ``parse`` the words of every blob in turn.
    """

    def __init__(self, blobs: list[bytes], powers: Powers):
        self.size = np.array([len(b) for b in blobs], np.int64)
        self.end = np.cumsum(self.size)
        self.data = np.frombuffer(b"".join(blobs), np.uint8)
        begin = self.end - self.size
        s, (up, _) = _prefix(self.data, powers), powers.upto(len(self.data))
        h = _mix((s[WINDOW:] - s[:-WINDOW]) * up[: max(0, len(s) - WINDOW)])
        cut_at = np.flatnonzero(h % np.uint64(MODULUS) == 0)
        blob = np.searchsorted(self.end, cut_at, "right")
        cut_at = cut_at[cut_at + WINDOW <= self.end[blob]]
        self.start = np.union1d(begin, cut_at)
        self.blob = np.searchsorted(self.end, self.start, "right")
        after = np.concatenate((self.start[1:], self.end[-1:]))
        self.closed = np.concatenate((self.blob[1:] == self.blob[:-1], [False]))
        self.stop = np.where(self.closed, after + WINDOW, self.end[self.blob])
        whole, ids = b"".join(blobs), {}
        self.parse = np.array([ids.setdefault(whole[a:b], len(ids)) for a, b in zip(self.start.tolist(), self.stop.tolist(), strict=True)], np.int64)
        self.words = list(ids)

    def dictionary(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array of the dictionary as ranks, by prefix doubling to ``LENGTH`` bytes: of every place of every word,
        where its suffix stands; suffixes that share their first ``LENGTH`` bytes share a rank. And each word's first place."""
        size = np.array([len(w) for w in self.words], np.int64)
        end = np.repeat(np.cumsum(size), size)
        data = np.frombuffer(b"".join(self.words), np.uint8).astype(np.int64) + 1
        at = np.arange(len(data))

        def ahead(v: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros_like(v)
            out[: max(0, len(v) - by)] = v[by:]
            out[at + by >= end] = 0
            return out

        rank, depth = data, 1
        for j in range(1, 7):  # seven bytes of 257 values fit a long
            rank = rank * 257 + ahead(data, j)
        depth = 7
        rank = np.unique(rank, return_inverse=True)[1] + 1
        while depth < LENGTH:
            by = min(depth, LENGTH - depth)
            rank = np.unique(rank * (len(rank) + 1) + ahead(rank, by), return_inverse=True)[1] + 1
            depth += by
        return rank, np.cumsum(size) - size

    def parse_ranks(self, word_rank: np.ndarray) -> np.ndarray:
        """Suffix array of the parse as ranks: of every word of every blob, where the text from it on stands among the
        others, by prefix doubling over the words' own ranks until ``LENGTH`` bytes or the blob's end are covered."""
        n = len(self.parse)
        rank, span, at = word_rank[self.parse], 1, np.arange(n)
        last = np.searchsorted(self.blob, self.blob, "right")
        while True:
            to = at + span
            inside = to < last
            if not inside.any() or (self.start[np.minimum(to, n - 1)] - self.start >= LENGTH)[inside].all():
                return rank
            rank = np.unique(rank * (int(rank.max()) + 1) + np.where(inside, rank[np.minimum(to, n - 1)], 0), return_inverse=True)[1] + 1
            span *= 2

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the texts from two words of the parse have in common, ``LENGTH`` at most."""
        out = np.empty(len(a), np.int64)
        for i in range(0, len(a), 1 << 16):
            x, y = self.start[a[i : i + (1 << 16)]], self.start[b[i : i + (1 << 16)]]
            room = np.minimum(np.minimum(self.end[self.blob[a[i : i + (1 << 16)]]] - x, self.end[self.blob[b[i : i + (1 << 16)]]] - y), LENGTH)
            ahead, last = np.arange(LENGTH), len(self.data) - 1
            differ = self.data[np.minimum(x[:, None] + ahead, last)] != self.data[np.minimum(y[:, None] + ahead, last)]
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
            out[i : i + (1 << 16)] = np.minimum(first, room)
        return out


def repeats(blobs: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Of phrases in corpus order: (phrase, string) of the strings that an earlier one, in this or another phrase, equals."""
    text = Order(blobs, powers)
    suffix, first = text.dictionary()
    parse = text.parse_ranks(suffix[first])
    sorted_parse = np.argsort(parse, kind="stable")
    place = np.empty_like(sorted_parse)
    place[sorted_parse] = np.arange(len(place))
    common = [text.shared(sorted_parse[:-1], sorted_parse[1:])]  # with the next in order; then least of 2, 4, 8 ... of these
    while len(common[-1]) > 1 << len(common) - 1:
        step = 1 << len(common) - 1
        common.append(np.minimum(common[-1][:-step], common[-1][step:]))

    count = text.size - LENGTH + 1
    phrase = np.repeat(np.arange(len(blobs)), count)
    offset = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(text.end - text.size, count) + offset
    word = np.searchsorted(text.start, at, "right") - 1
    rest = text.stop[word] - at
    short = rest < LENGTH  # the string goes on in the next words of the parse
    rank = suffix[first[text.parse[word]] + at - text.start[word]]
    then = np.where(short, place[np.minimum(word + 1, len(place) - 1)] + 1, 0)
    order = np.argsort(rank * (len(place) + 1) + then, kind="stable")
    low, high = then[order][:-1] - 1, then[order][1:] - 1
    same = rank[order][1:] == rank[order][:-1]
    ask = np.flatnonzero(same & short[order][1:] & (low < high))
    if len(ask):
        x, y = low[ask], high[ask]
        level = np.frexp((y - x).astype(float))[1] - 1
        least = np.empty(len(ask), np.int64)
        for k in np.unique(level):
            of = level == k
            least[of] = np.minimum(common[k][x[of]], common[k][y[of] - (1 << k)])
        same[ask] = least >= WINDOW + LENGTH - rest[order][1:][ask]
    equal = np.flatnonzero(np.concatenate(([True], ~same)))  # where a class of equal strings begins
    earliest = np.repeat(np.minimum.reduceat(order, equal), np.diff(np.concatenate((equal, [len(order)]))))
    again = order[order != earliest]
    return phrase[again], offset[again]


def _stretches(keys: pa.Array, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(keys, places, pieces): documents, or pieces of long ones with their place, as many as fit a stretch. Every
    100-byte string of a document starts in one piece."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for key, x in zip(keys.to_pylist(), texts, strict=True):
        d = (x.as_py() or "").encode()
        for at in range(0, max(1, len(d) - LENGTH + 1), STRETCH):
            piece = d[at : at + STRETCH + LENGTH - 1] if len(d) > STRETCH else d
            if held and size + len(piece) > STRETCH:
                yield _columns(held)
                held, size = [], 0
            held.append((key, at, piece))
            size += len(piece)
    if held:
        yield _columns(held)


def _columns(held: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    keys, places, pieces = zip(*held, strict=True)
    return np.array(keys, np.int64), np.array(places, np.int64), list(pieces)


def phrases(rows: DataFrame) -> DataFrame:
    """The parse: (key, trigger, phrase, start, n) of rows (key, text). Row-wise, about one phrase in 31 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        with np.errstate(over="ignore"):
            for b in batches:
                for keys, places, pieces in _stretches(b.column(0), b.column(1)):
                    d, trigger, phrase, start, n = parse(pieces, powers)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[d]), pa.array(trigger), pa.array(phrase), pa.array((start + places[d]).astype(np.int32)), pa.array(n.astype(np.int32))], ["key", "trigger", "phrase", "start", "n"])

    return rows.select("key", "text").mapInArrow(run, "key long, trigger long, phrase long, start int, n int")


def _contents(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(trigger, key, start, bytes) of the wanted phrases, cut from the documents that have them."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("trigger", "start", "n")).alias("wanted"))
    held = join_sparse(rows.select("key", "text"), lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text, want in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                data, w = text.as_py().encode(), want.values
                start, n = w.field("start").to_numpy(), w.field("n").to_numpy()
                cutout = [data[i : i + k - 1 + LENGTH] for i, k in zip(start.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([w.field("trigger"), pa.array([key] * len(cutout), pa.int64()), w.field("start"), pa.array(cutout, pa.binary())], ["trigger", "key", "start", "bytes"])

    return held.mapInArrow(run, "trigger long, key long, start int, bytes binary")


def _later_strings(pieces: DataFrame) -> DataFrame:
    """(key, start, stop) of strings met earlier among the phrases of their trigger; groups of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        with np.errstate(over="ignore"):
            for t in _whole_groups(batches):
                b = t.combine_chunks()
                p, o = repeats(b.column("bytes").to_pylist(), powers)
                if not len(p):
                    continue
                key, start = b.column("key").to_numpy()[p], b.column("start").to_numpy()[p] + o
                order = np.lexsort((start, key))
                key, start = key[order], start[order]
                new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (start[1:] > start[:-1] + 1))))
                last = np.concatenate((new[1:], [len(key)])) - 1
                yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(start[new].astype(np.int32)), pa.array((start[last] + LENGTH).astype(np.int32))], ["key", "start", "stop"])

    dealt = pieces.repartition("trigger").sortWithinPartitions("trigger", "key", "start")
    return dealt.mapInArrow(run, "key long, start int, stop int")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches, cut only between triggers; a group has at most HOT phrases."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        for at in range(0, b.num_rows, 4000):
            part = b.slice(at, 4000)
            t = part.column(0).to_numpy()
            if rest and rest[-1].column(0)[rest[-1].num_rows - 1].as_py() != t[0]:
                yield pa.Table.from_batches(rest)
                rest = []
            if t[0] == t[-1]:
                rest.append(part)
                continue
            last = int(np.flatnonzero(t != t[-1])[-1]) + 1
            yield pa.Table.from_batches([*rest, part.slice(0, last)])
            rest = [part.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest)


def _later_of_hot(pieces: DataFrame) -> DataFrame:
    """The same for common triggers: every string by its own hash, combined before the shuffle; the join on
    the hash can be split where a string is very common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        with np.errstate(over="ignore"):
            for b in batches:
                if not b.num_rows:
                    continue
                blobs = b.column("bytes").to_pylist()
                count = np.array([len(x) for x in blobs]) - LENGTH + 1
                s = _prefix(np.frombuffer(b"".join(blobs), np.uint8), powers)
                up, _ = powers.upto(len(s))
                phrase = np.repeat(np.arange(len(blobs)), count)
                offset = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
                size = count + LENGTH - 1
                at = np.repeat(np.cumsum(size) - size, count) + offset
                h = _mix((s[at + LENGTH] - s[at]) * up[at])
                take = lambda name: b.column(b.schema.get_field_index(name)).to_numpy()[phrase]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(take("trigger")), pa.array(h.view(np.int64)), pa.array(take("key")), pa.array((take("start") + offset).astype(np.int32))], ["trigger", "h", "key", "start"])

    strings = pieces.select("trigger", "key", "start", "bytes").mapInArrow(run, "trigger long, h long, key long, start int")
    earliest = strings.groupBy("trigger", "h").agg(F.min(F.struct("key", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = strings.join(earliest, ["trigger", "h"]).filter(F.struct("key", "start") != F.col("first"))
    return met.select("key", "start", (F.col("start") + LENGTH).alias("stop"))


def repeated_ranges(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, start, stop): byte ranges of rows (key, text) that are covered by 100-byte strings which also start
    earlier, by key and then by place. Ranges of a key may overlap; their union is exact."""
    parsed = phrases(rows)
    # written first, so that both sides of the join come straight from a shuffle and a common trigger can be split
    again = cut(parsed.groupBy("trigger").count().filter("count > 1").select("trigger"))
    members = cut(parsed.join(again, "trigger", "left_semi"))
    free_shuffles(rows.sparkSession)
    place = F.struct("key", "start")
    dictionary = cut(members.groupBy("trigger", "phrase").agg(F.min(F.struct("key", "start", "n")).alias("first"), F.count("*").alias("copies")))
    copied = dictionary.filter("copies > 1").select("trigger", "phrase", F.struct("first.key", "first.start").alias("first"))
    later = members.join(copied, ["trigger", "phrase"]).filter(place != F.col("first")).select("key", "start", (F.col("start") + F.col("n") - 1 + LENGTH).alias("stop"))
    later = cut(later)
    discard(members, again)
    kinds = cut(dictionary.groupBy("trigger").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    wanted = dictionary.join(kinds, "trigger").select("trigger", "kinds", "first.key", "first.start", "first.n")
    wanted = cut(wanted)
    pieces = cut(_contents(rows, wanted))
    free_shuffles(rows.sparkSession)
    common = cut(kinds.filter(F.col("kinds") > hot).select("trigger"))
    ranges = later.union(_later_strings(pieces.join(common, "trigger", "left_anti")))
    if common.head(1):
        ranges = ranges.union(_later_of_hot(pieces.join(common, "trigger", "left_semi")))
    return ranges


def shortened(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, n_removed, n_spans, kept) of the rows (key, text) that lose bytes; kept: the bytes that remain."""
    lists = repeated_ranges(rows, hot).groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    held = join_sparse(rows.select("key", "text"), lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, spans, kept = [], [], []
            for text, ranges in zip(b.column(1), b.column(2), strict=True):
                data, w = np.frombuffer(text.as_py().encode(), np.uint8), ranges.values
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, w.field("start").to_numpy(), 1)
                np.add.at(edge, w.field("stop").to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()))
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["key", "n_removed", "n_spans", "kept"])

    return held.mapInArrow(run, "key long, n_removed long, n_spans long, kept binary")


def _rows(docs: DataFrame) -> DataFrame:
    return keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``docs`` (doc_id, text, ...) to (doc_id, n_bytes, n_removed, n_spans, kept): kept the bytes that remain.

    A byte goes if a 100-byte string over it also starts earlier: in a smaller doc_id, or further left in the same
    document. Null and empty texts have 0 bytes; texts under 100 bytes stay whole. Repeated rows, and null
    doc_ids before all others, count as documents of their own in the order of (doc_id, text). An empty table
    gives an empty result; other columns are ignored.
    """
    rows = _rows(docs)
    whole = F.coalesce("kept", F.encode("text", "utf-8")).alias("kept")
    return _report(rows, shortened(rows, hot), whole, [F.col("text")])


def digest(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The same with the kept bytes' SHA-256 in their place. Texts that lose nothing are hashed in the scan and are not shuffled."""
    rows = _rows(docs)
    changed = shortened(rows, hot).select("key", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept"))
    return _report(rows, changed, F.coalesce("kept", "whole").alias("kept_sha256"), [F.sha2("text", 256).alias("whole")])


def _report(rows: DataFrame, changed: DataFrame, kept: Column, carried: list[Column]) -> DataFrame:
    of_all = rows.select("key", "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), *carried)
    n = [F.coalesce(x, F.lit(0).cast("bigint")).alias(x) for x in ("n_removed", "n_spans")]
    return of_all.join(changed, "key", "left").select("doc_id", "n_bytes", *n, kept)
