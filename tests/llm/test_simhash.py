import random
from collections import defaultdict

import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.shared import components


def slow_print(text):
    words = []
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    word = ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_classes(prints):
    """prints: list of (doc_id, fp). Classes by breadth-first search over all pairs."""
    by = defaultdict(list)
    for d, f in prints:
        by[f].append(d)
    fps, seen, out = list(by), set(), {}
    for f in fps:
        if f in seen:
            continue
        group, todo = [], [f]
        seen.add(f)
        while todo:
            x = todo.pop()
            group.append(x)
            for y in fps:
                if y not in seen and (x ^ y).bit_count() <= 4:
                    seen.add(y)
                    todo.append(y)
        least = min(d for g in group for d in by[g])
        out |= {d: least for g in group for d in by[g]}
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, fp int").repartition(3)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.digest(simhash.near_duplicates(df)).collect()}
    fps = [(r[0], slow_print(r[1])) for r in rows]
    want = slow_classes(fps)
    assert got == {(d, f"{f:016x}"): want[d] for d, f in fps}


def test_same_as_brute_force(spark):
    rnd = random.Random(1)
    rows, base = [], [[rnd.choice(["tha", "on", "ERN", "é", "of"]) + str(rnd.randrange(50)) for _ in range(rnd.randrange(1, 300))] for _ in range(40)]
    for i in range(240):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            words[rnd.randrange(len(words))] = "x" + str(rnd.randrange(9))
        rows.append((i * 7, rnd.choice([" ", "\n", "\t "]).join(words), None, 1))
    check(spark, rows)


def test_edge_texts(spark):
    check(spark, [(5, None, "a", 0), (3, "", None, 0), (9, " \n ", "a", 0), (4, "One two", "a", 0), (1, "one TWO", "a", 0), (2, "w " * 30000, "a", 0), (8, "É é", "b", 1)])


def test_ball_links_find_every_distance(spark):
    rnd = random.Random(2)
    fps = set()
    for _ in range(60):
        x = rnd.getrandbits(64)
        fps.add(x)
        for d in (1, 2, 3, 4, 5):
            fps.add(x ^ sum(1 << b for b in rnd.sample(range(64), d)))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    got = {r.node % (1 << 64): r.component % (1 << 64) for r in components(edges).collect()}
    want = slow_classes([(f, f) for f in fps])
    groups = lambda m: {frozenset(k for k in fps if m.get(k, k) == v) for v in {m.get(k, k) for k in fps}}
    assert groups(got) == groups(want)


def test_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "u long, v long")
    got = {r.node: r.component for r in components(chain).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000} or got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "q r s t u v w")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (1, 1), (1, 1)]
    assert simhash.keep_one(df).count() == 2
    clash = df.selectExpr("*", "'x' key", "1 fp", "2 component_id", "3 component_key")
    kept = simhash.keep_one(clash)
    assert kept.columns == clash.columns and kept.count() == 2 and {r.key for r in kept.collect()} == {"x"}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_unfinished_components_raise(spark):
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long"), 1)
