"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a stretch of documents are laid out as one linked array of byte symbols. An
index maps every mergeable pair to all its positions; the active ranks are taken in ascending order, each
is applied to all its positions at once, and the neighbours' new pairs are entered under their ranks. A
pair with a merged symbol always has a higher rank than the merge that made the symbol, so this gives
what merging word by word would.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.shared import small_batches

# The split pattern and the byte alphabet of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

SAFE = "\\x00-\u024f\u0391-\u03a1\u03a3-\u03ff\u0400-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
"""Characters that every Unicode version since 6 puts in the same class. Other texts are split by the library."""

STRETCH = 1_000_000
"""Characters of text that share one pair index; a longer text is a stretch of its own."""

CACHED = 100_000
"""Distinct pre-tokens that a task remembers from stretch to stretch; then it starts anew."""


class Vocabulary:
    """Merges and token bytes of a tokenizer file, as arrays of fixed size that go to the tasks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("byte-level BPE without normalizer or prefix space is read")
        spare = iter(range(256, 512))
        byte_char = {b: chr(b) if b in set(PRINTABLE) else chr(next(spare)) for b in range(256)}
        char_byte = {c: b for b, c in byte_char.items()}
        ids: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        self.order = np.argsort(key, kind="stable")
        self.keys = key[self.order]
        self.left, self.right = key >> 32, key & 0xFFFFFFFF
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.byte_id = np.array([ids[byte_char[b]] for b in range(256)], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token = dict(ids) | self.special
        raw = [b""] * (max(token.values()) + 1)
        for s, i in token.items():
            raw[i] = bytes(char_byte[c] for c in s) if all(c in char_byte for c in s) else s.encode()
        self.length = np.array([len(x) for x in raw], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        self.blob = np.frombuffer(b"".join(raw), np.uint8)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where there is no merge."""
        k = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.order[at], -1)


def merge(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and the number of ids of each."""
    size = np.array([len(w) for w in words], np.int64)
    sym = vocab.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    n = len(sym)
    word = np.repeat(np.arange(len(words)), size)
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    edge = np.cumsum(size)[size > 0]
    nxt[edge - 1] = -1
    prv[(edge - size[size > 0])] = -1
    index: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def enter(at: np.ndarray) -> None:
        rank = vocab.ranks(sym[at], sym[nxt[at]])
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(np.diff(rank)) + 1
        for r, group in zip(rank[np.concatenate(([0], cut))].tolist(), np.split(at, cut), strict=True):
            if r not in index:
                index[r] = []
                heapq.heappush(ranks, r)
            index[r].append(group)

    enter(np.flatnonzero(nxt >= 0))
    while ranks:
        r = heapq.heappop(ranks)
        found = index.pop(r)
        at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
        a, b = vocab.left[r], vocab.right[r]
        at = at[(sym[at] == a) & (nxt[at] >= 0)]
        at = at[sym[nxt[at]] == b]
        if a == b and len(at) > 1:  # in a run like aaaa every second pair counts, from the left
            fresh = np.concatenate(([True], at[1:] != nxt[at[:-1]]))
            i = np.arange(len(at))
            at = at[(i - np.maximum.accumulate(np.where(fresh, i, 0))) % 2 == 0]
        if not len(at):
            continue
        gone = nxt[at]
        after = nxt[gone]
        sym[at], sym[gone], nxt[at] = vocab.made[r], -1, after
        prv[after[after >= 0]] = at[after >= 0]
        before = prv[at]
        enter(np.unique(np.concatenate((before[before >= 0], at[after >= 0]))))
    alive = sym >= 0
    return sym[alive].astype(np.int32), np.bincount(word[alive], minlength=len(words))


class Encoder:
    """Encodes texts stretch by stretch; remembers the ids of pre-tokens it has met."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.find = regex.compile(PATTERN).findall
        self.unsafe = regex.compile(f"[^{SAFE}]").search
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None
        self.reset()

    def reset(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(self, text: str) -> list[str]:
        if text.isascii() or not self.unsafe(text):
            return self.find(text)
        from tokenizers.pre_tokenizers import ByteLevel

        return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token stands for itself after a NUL, which no other can start with twice."""
        if self.special is None or not any(s in text for s in self.vocab.special):
            return self.split(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += ["\x00\x00special" + part] if i % 2 else self.split(part)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.code) > CACHED:
            self.reset()
        code, known = self.code, len(self.code)
        coded = []
        for t in texts:
            words = self.pieces(t)
            try:
                coded.append(array("i", map(code.__getitem__, words)))
            except KeyError:
                for w in words:
                    if w not in code:
                        code[w] = len(code)
                coded.append(array("i", map(code.__getitem__, words)))
        new = list(code)[known:]
        if new:
            special = {i: self.vocab.special[w[9:]] for i, w in enumerate(new) if w.startswith("\x00\x00special") and w[9:] in self.vocab.special}
            ids, count = merge(self.vocab, [b"!" if i in special else w.encode() for i, w in enumerate(new)])
            first = np.cumsum(count) - count
            for i, token in special.items():
                ids[first[i]] = token
            self.first = np.concatenate((self.first, first + len(self.flat)))
            self.flat, self.count = np.concatenate((self.flat, ids)), np.concatenate((self.count, count))
        return [gather(self.flat, self.first[i], self.count[i]) for i in (np.frombuffer(c, np.int32) for c in coded)]


def gather(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs flat[first : first + count], one after another."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(first - (ends - count), count) + np.arange(total)]


def _stretches(column: pa.Array) -> Iterator[list[str]]:
    held, size = [], 0
    for x in column:
        t = x.as_py() or ""
        if held and size + len(t) > STRETCH:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _ids_column(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))


def _texts_of(vocab: Vocabulary, ids: pa.Array) -> pa.Array:
    """The ids' bytes as UTF-8 of each row, U+FFFD for what is not UTF-8; of a null row nothing."""
    out = []
    for row in ids:
        i = np.zeros(0, np.int64) if not row.is_valid else row.values.to_numpy(zero_copy_only=False).astype(np.int64)
        out.append(gather(vocab.blob, vocab.start[i], vocab.length[i]).tobytes().decode("utf-8", "replace"))
    return pa.array(out, pa.string())


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with a column ``ids`` array<int> in place of the column ``text``; with ``decoded`` also what those ids decode to, a
    round trip in one pass of one worker.

    Row-wise: no shuffle; a task holds one stretch of texts at a time. Null and empty texts have no ids;
    special tokens' strings in a text are special tokens, as in the library by default; other columns pass.
    Columns of the new names are replaced.
    """
    vocab = Vocabulary(path)
    small_batches(docs.sparkSession)
    keep = [f for f in docs.schema if f.name not in (text, ids, decoded)]
    new = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    schema = T.StructType([*keep, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab)
        for b in batches:
            at = 0
            for texts in _stretches(b.column(b.num_columns - 1)):
                out = _ids_column(encoder.encode(texts))
                part = b.slice(at, len(texts))
                back = [_texts_of(vocab, out)] if decoded else []
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(b.num_columns - 1)), out, *back], schema.names)
                at += len(texts)

    return docs.select(*[f.name for f in keep], text).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``tokens`` with a column ``text``: the ids' bytes as UTF-8, U+FFFD for what is not UTF-8.

    Row-wise; null or empty ids give an empty text. A column of that name is replaced.
    """
    vocab = Vocabulary(path)
    small_batches(tokens.sparkSession)
    keep = [f for f in tokens.schema if f.name != text]
    at = [f.name for f in keep].index(ids)
    schema = T.StructType([*keep, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _texts_of(vocab, b.column(at))], schema.names)

    return tokens.select(*[f.name for f in keep]).mapInArrow(run, schema)
