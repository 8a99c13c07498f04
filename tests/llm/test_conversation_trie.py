import hashlib
import random
import zlib

import pytest

from tessera.llm import conversation_trie as ct
from tessera.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node int"


def slow(rows):
    """Prefixes as tuples of turns, subtrees by walking up from every node."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members, ends = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in members:
        kids[p[:-1]] = kids.get(p[:-1], 0) + (len(p) > 0)
    for p, m in members.items():
        worth = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (not kids.get(p))
            saved[p[:d]] = saved.get(p[:d], 0) + worth
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p], digest(p)) for p, m in members.items())


def got(df):
    rows = [tuple(r) for r in ct.trie(df).collect()]
    return sorted((a, b, -1 if c is None else c, *rest) for a, b, c, *rest in rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA).repartition(3)


def test_same_as_brute_force(spark):
    rnd = random.Random(12)
    pool = [("user", "hi"), ("user", "é ü"), ("assistant", ""), (None, None), ("assistant", "well then")]
    rows = []
    for c in rnd.sample(range(400), 150):
        for t in range(rnd.choice([1, 2, 5, 9, 14])):
            rows.append((c, rnd.choice([t, t, t, None, 3]), *rnd.choice(pool)))
    rows += [(200, t, "user", "hi") for t in range(9)] * 2 + [(None, 1, "user", "hi")]
    assert got(frame(spark, rows)) == slow(rows)


def test_copies_long_chains_and_empty(spark):
    """One conversation copied to a third of all ids, one of two thousand turns, and tables of a row or none."""
    rnd = random.Random(2)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 400) if c % 3 == 0 for t in range(4)]
    rows += [(1001, t, "user" if t % 2 else "assistant", f"turn {rnd.random()}" * 3) for t in range(700)]
    rows += [(1004, t, "user", "word " * 20) for t in range(60)]
    want = slow(rows)
    assert got(frame(spark, rows)) == want and max(w[1] for w in want) > 600
    assert got(frame(spark, [(3, None, None, None)])) == slow([(3, None, None, None)])
    assert got(frame(spark, rows).limit(0)) == []


@pytest.mark.parametrize("chunk", [1, 3])
def test_digests_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(ct, "CHUNK", chunk)
    rows = [(i % 4, i) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, conv_id long").repartition(5)
    want = {k: hashlib.sha256(",".join(str(i) for q, i in rows if q == k).encode()).hexdigest() for k in range(4)}
    assert {r.k: r.ends_sha256 for r in ct.id_digests(df, ["k"]).collect()} == want


def test_totals_of_a_forest(spark):
    rnd = random.Random(5)
    parent = {i: (None if i in (0, 7) else rnd.randrange(max(0, i - 3), i)) for i in range(300)}
    weight = {i: rnd.randrange(9) for i in parent}
    total = dict(weight)
    for i in reversed(range(300)):
        if parent[i] is not None:
            total[parent[i]] += total[i]
    df = spark.createDataFrame([(i, p, weight[i]) for i, p in parent.items()], "node long, parent long, w long")
    assert {r.node: r.w for r in ct.subtree_totals(df, ["w"]).collect()} == total
    circle = spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "node long, parent long, w long")
    with pytest.raises(RuntimeError):
        ct.subtree_totals(circle, ["w"], rounds=3)


def test_query_on_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op12_conversation_trie(spark, sf_dir)
    assert out.columns[:8] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((a, b, -1 if c is None else c, *r) for a, b, c, *r in map(tuple, out.collect())) == slow(rows)
