import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffixes


def slow(rows):
    """rows in corpus order: (n_bytes, n_removed, n_spans, kept) of each, with a set of all strings seen."""
    seen, out = set(), []
    for t in rows:
        data = (t or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if s in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(s)
        out.append((len(data), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randrange(1, 9)))
    para = [" ".join(word() for _ in range(60)) for _ in range(30)]
    texts = []
    for _ in range(150):
        parts = rnd.choices(para, k=rnd.randrange(1, 4))
        t = rnd.choice([" ", "\n", word()]).join(parts)
        a = rnd.randrange(len(t))
        t = t[a:] if rnd.random() < 0.3 else t
        if rnd.random() < 0.5:
            i = rnd.randrange(len(t))
            t = t[:i] + word() + t[i + rnd.randrange(3) :]
        texts.append(t)
    texts += [None, "", "x" * 99, "x" * 100, "y" * 5000, "y" * 300, "ab" * 400, "ba" * 90, "abcdefg " * 200, word() + "abcdefg " * 200]
    texts += ["<line of licence text that many documents carry, long enough to hold some hundred and more bytes of text, and yet more>" + word() for _ in range(40)]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("hot", [5, 1000])
def test_same_as_brute_force(spark, hot):
    texts = corpus()
    df = spark.createDataFrame([(i * 3 - 7, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, start string, key int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeats(df, hot).collect()}
    want = {i * 3 - 7: w for i, w in enumerate(slow(texts))}
    assert got == want
    if hot == 5:
        dig = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffixes.digest(df, hot).collect()}
        assert dig == {i: (w[1], hashlib.sha256(w[3]).hexdigest()) for i, w in want.items()}


def test_repeated_rows_null_ids_and_empty(spark):
    t = "one text that is a good deal longer than a hundred bytes so that its copies can be told and then removed from all but the first"
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffixes.remove_repeats(df).collect())
    assert got == [(0, 0), (1, len(t)), (1, len(t)), (2, 0)]
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_strings_in_order_same_as_brute_force():
    """The suffix arrays of dictionary and parse find the strings that a set of all strings finds."""
    rnd = random.Random(5)
    for _ in range(25):
        alphabet = rnd.choice([b"ab", b"abcdefgh ", bytes(range(256)), b"\x00\x01a"])
        base = [bytes(rnd.choices(alphabet, k=rnd.randrange(100, 400))) for _ in range(5)]
        blobs = [bytes([rnd.choice(alphabet)]) * 250]
        for _ in range(rnd.randrange(1, 100)):
            b = rnd.choice(base)[rnd.randrange(60) :] + rnd.choice(base)[: rnd.randrange(300)]
            i = rnd.randrange(len(b))
            b = b[:i] + bytes([rnd.choice(alphabet)]) + b[i + 1 :] if rnd.random() < 0.5 else b
            blobs += [b[: rnd.choice([168, 168, 1000])]] if len(b) >= 100 else []
        seen, want = set(), []
        for p, b in enumerate(blobs):
            for o in range(len(b) - 99):
                if b[o : o + 100] in seen:
                    want.append((p, o))
                seen.add(b[o : o + 100])
        with np.errstate(over="ignore"):
            got = suffixes.repeats(blobs, suffixes.Powers())
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == want


def test_long_texts_go_in_pieces(spark, monkeypatch):
    """Pieces of a long text overlap, so that no string is lost at their seams."""
    monkeypatch.setattr(suffixes, "STRETCH", 700)
    texts = corpus()[:60] + ["".join(random.Random(8).choices("abcdef ", k=5000)) * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with np.errstate(over="ignore"):
        got = []
        for keys, places, pieces in suffixes._stretches(*(suffixes.pa.array(x) for x in zip(*enumerate(texts), strict=True))):
            assert all(len(p) <= 700 + 99 for p in pieces)
            d, _, _, start, n = suffixes.parse(pieces, suffixes.Powers())
            got += [(keys[i], s + j) for i, s, c in zip(d, start + places[d], n, strict=True) for j in range(c)]
    assert sorted(got) == [(k, i) for k, t in enumerate(texts) for i in range(len((t or "").encode()) - 99)]
    assert df.count() == len({r.doc_id for r in suffixes.digest(df).collect()})
