import random

import pytest

from tessera.llm import decontamination as dec


def least_edits(passage, text):
    """Whole table, free start and end in the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(passage, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        i = rnd.randrange(len(s))
        kind = rnd.randrange(3)
        if kind == 0:
            s[i] = rnd.choice("abcxyz ")
        elif kind == 1:
            s.insert(i, rnd.choice("abcxyz"))
        else:
            del s[i]
    return "".join(s)


@pytest.mark.parametrize("index_bytes", [4_000_000, 0])
def test_same_as_brute_force(spark, monkeypatch, index_bytes):
    """Both ways, with the index in every task and with a join of q-grams, against whole edit tables."""
    monkeypatch.setattr(dec, "INDEX_BYTES", index_bytes)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices(["the", "on", "er", "an", "re", "é"], k=rnd.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rnd.randrange(4, 25))) for i in range(22)] + [(22, "ab " * 40), (23, "1 2 3 4 5 6 7 8 9 0 " * 9 + "the end"), (24, "on the re " * 14 + prose(9))] + [(90, None), (None, "some text of no id"), (91, "short")]
    docs = []
    for d in range(120):
        t = prose(rnd.randrange(0, 40))
        for _ in range(rnd.randrange(3)):
            i, p = rnd.choice(items[:25])
            t += rnd.choice([" ", ".\n"]) + edited(rnd, p.upper() if rnd.random() < 0.2 else p, rnd.choice([0, 0, 1, 3, 6, 12])) + " " + prose(rnd.randrange(20))
        docs.append((d, t, 4))
    near = lambda p, n: [edited(rnd, p, n) for _ in range(2)]
    periodic = ["ab " * 100, "xy " * 60, "1 2 3 4 5 6 7 8 9 0 " * 20, *near(items[22][1], 5), *near("so " + items[23][1] + " it", 9), *near(items[24][1] * 2, 8), "ab " * 30 + "cd " * 9 + "ab " * 30]
    docs += [(200 + i, t, 4) for i, t in enumerate(periodic)]
    docs += [(500, None, 1), (501, "", 1), (501, items[3][1], 1), (502, "the on " * 30000 + items[4][1], 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, leaks int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in dec.mark(df, bench).collect():
        got.setdefault(r.doc_id, set()).update((x.item_id, x.edits) for x in r.leaks)
        for x in r.leaks:
            part = dec.normal(r.text)[x.start : x.stop]
            assert least_edits(dec.normal(dict(items[:25])[x.item_id]), part) == x.edits
    for d, t, _ in docs[:-1]:
        want = {(i, e) for i, p in items[:25] if len(dec.normal(p)) >= dec.Q and (e := least_edits(dec.normal(p), dec.normal(t))) <= dec.budget(len(dec.normal(p)))}
        assert got[d] >= want and (d == 501 or got[d] == want)
    assert (4, 0) in got[502]
    clean = {r.doc_id for r in dec.keep_clean(df, bench).collect()}
    assert clean == {d for d, x in got.items() if not x} | {501}


def test_periodic_texts_in_bounded_memory():
    """Every place of the passage has a partner at every third place of the text."""
    import tracemalloc

    index = dec.Index([(1, "ab " * 1500), (2, "ab " * 1500 + "and then")])
    tracemalloc.start()
    found = index.leaks(["ab " * 40_000, "ab " * 700])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(x["item_id"], x["edits"]) for x in found[0]] == [(1, 0), (2, 6)] and found[1] == [] and peak < 200 << 20


def test_benchmark_without_repeated_qgrams():
    index = dec.Index([(1, "some passage of a few words that repeat nothing")])
    assert index.leaks(["", None, "x", "so: some passage of a few words that repeat nothing!"])[3] == [{"item_id": 1, "start": 3, "stop": 50, "edits": 0}]


def test_common_qgrams_are_left_out_of_the_join(spark, monkeypatch):
    monkeypatch.setattr(dec, "INDEX_BYTES", 0)
    monkeypatch.setattr(dec, "COMMON", 5)
    frame = "which of the following is right about the number"
    items = [(i, f"{frame} {i * 7919} and {i * i} here") for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, f"{frame} nothing else to see " * 3), (2, "a " + items[7][1] + " b"), (3, items[9][1] + " " + items[30][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {d: {i for i, p in items if least_edits(dec.normal(p), dec.normal(t)) <= dec.budget(len(dec.normal(p)))} for d, t in docs}
    assert {r.doc_id: {x.item_id for x in r.leaks} for r in dec.mark(df, bench).collect()} == want


def test_large_benchmark_and_empty_tables(spark, monkeypatch):
    items = [(i, f"passage number {i} has words like these and some others {i * i}") for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(1, "so " + items[2][1] + " and " + items[5][1])], "doc_id long, text string")
    for size in (4_000_000, 120):
        monkeypatch.setattr(dec, "INDEX_BYTES", size)
        assert {x.item_id for x in dec.mark(df, bench).head().leaks if x.edits == 0} == {2, 5}
        assert dec.mark(df, bench.limit(0)).head().leaks == [] and dec.mark(df.limit(0), bench).count() == 0
