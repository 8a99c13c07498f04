import random

import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "aa", " ", "\n", "é", "<|endoftext|>", "\x1c", "\x85", " ", "你好", "'s", "'LL", "1", "ab", "😀", "\x00", "\x00\x00special", "é", "ſ", "the ", "֋", "tion"]


def test_same_as_library_and_round_trip(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choices(PARTS, k=rnd.randrange(80))) for _ in range(300)] + ["", None, "a" * 20000, "ab" * 9000, "word " * 40000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()}
    once = {r.doc_id: r for r in bpe.encode(df, PATH, decoded="decoded").collect()}
    assert all(once[i].ids == r.ids and once[i].decoded == r.decoded for i, r in got.items())
    lib = Tokenizer.from_file(PATH)
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids
        assert got[i].decoded == lib.decode(ids, skip_special_tokens=False) == (t or "")


def test_ids_that_are_not_utf8(spark):
    df = spark.createDataFrame([(1, [222, 50256]), (2, None), (3, [])], "doc_id long, ids array<int>")
    lib = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.decoded for r in bpe.decode(df, PATH).collect()}
    assert got == {1: lib.decode([222, 50256], skip_special_tokens=False), 2: "", 3: ""}


def test_safe_ranges_split_like_the_library():
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    pre, find, safe = ByteLevel(add_prefix_space=False, use_regex=True), regex.compile(bpe.PATTERN).findall, regex.compile(f"[{bpe.SAFE}]")
    chars = [c for c in map(chr, range(0xD800)) if safe.match(c)]
    for i in range(0, len(chars), 500):
        s = "".join(f"a{c}b {c}{c} 1{c}2!{c}" for c in chars[i : i + 500])
        assert [s[a:b] for _, (a, b) in pre.pre_tokenize_str(s)] == find(s)


def test_empty_table_and_small_cache(spark, monkeypatch):
    df = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert bpe.encode(df.limit(0), PATH).count() == 0
    monkeypatch.setattr(bpe, "CACHED", 1)
    e = bpe.Encoder(bpe.Vocabulary(PATH))
    assert [e.encode(["hello world", "x"])[0].tolist() for _ in range(3)] == [[31373, 995]] * 3
