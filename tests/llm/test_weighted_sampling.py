import hashlib
import math
import random
import struct
from collections import Counter

import xxhash

from tessera.llm import weighted_sampling as ws


def hash_of(*parts):
    h = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else struct.pack("<q" if isinstance(p, tuple) else "<i", p[0] if isinstance(p, tuple) else p)
        h = xxhash.xxh64_intdigest(data, h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def terms(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\f\r" else c for c in text).split(" ") if w]
    h = [(signed(hash_of(w)),) for w in words]
    return Counter((signed(hash_of(a, b)),) for a, b in zip(h, h[1:], strict=False)) if len(h) > 1 else Counter(h)


def slow_sig(text, k_all=ws.SAMPLES):
    bag, out = terms(text), []
    for k in range(k_all):
        best = None
        for term, w in bag.items():
            h1, h2 = hash_of(term, k), hash_of(k, term)
            u = lambda h, s, n: ((h >> s & (1 << n) - 1) + 0.5) / (1 << n)
            r = -math.log(u(h1, 43, 21) * u(h1, 22, 21))
            lc = math.log(-math.log(u(h1, 0, 22) * u(h2, 32, 32)))
            b = u(h2, 0, 32)
            t = math.floor(math.log(w) / r + b)
            la = int((lc - r * (t - b + 1) + 128) * (1 << 24))
            name = (h2 ^ (t * 2654435761 % (1 << 64))) & (1 << 31) - 1
            best = min(best, (la, name)) if best else (la, name)
        out.append(best and best[1])
    return out


def text_of(sig):
    return "".join("f" * 8 if x is None else f"{x:08x}" for x in sig)


def likeness(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def check(spark, rows, partitions=4):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, rn int").repartition(partitions)
    got = [tuple(r)[:7] for r in ws.edited_likeness(df).collect()]
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + after[:q]
        a, b, c = slow_sig(t), slow_sig(e), slow_sig(after)
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), text_of(a), text_of(b), likeness(a, b), likeness(a, c)))
    order = lambda r: (r[0] is not None, r[0] or 0, r[3], r[4])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_same_as_brute_force(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices(["a", "é", "the", "😀", "on"], k=rnd.randrange(1, 4)))
    rows = [(rnd.choice([1, 1000, 10**9]) * 1000 + i, rnd.choice([" ", "\n", " \t"]).join(word() for _ in range(rnd.randrange(0, 40)))) for i in range(70)]
    rows += [(5, None), (6, ""), (7, "one"), (8, " \n "), (9, "w " * 500), (10, "w " * 500)]
    check(spark, rows)


def test_repeated_rows_null_ids_one_row_and_empty(spark):
    check(spark, [(3, "a b c d"), (3, "a b c d"), (None, "x y z"), (4, "q r s t u v")])
    check(spark, [(3, "a b c d e f g h")])
    check(spark, [(None, "a b c d"), (None, "e f g h")])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ws.edited_likeness(df).count() == 0 and ws.fingerprints(df).count() == 0


def test_collisions_follow_generalised_jaccard():
    rnd = random.Random(1)
    a = " ".join(rnd.choices("abcdef", k=60))
    b = a[:80] + " " + " ".join(rnd.choices("abcdef", k=15))
    x, y = terms(a), terms(b)
    want = sum((x & y).values()) / sum((x | y).values())
    assert abs(likeness(slow_sig(a, 1500), slow_sig(b, 1500)) - want) < 0.05


def test_fingerprints_of_a_table(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "y"), (3, "", "y")], "doc_id long, text string, sig string")
    got = [(r.doc_id, r.fingerprint) for r in ws.fingerprints(df).collect()]
    assert sorted(got) == [(1, text_of(slow_sig("a b c")))] * 2 + [(2, "f" * 256), (3, "f" * 256)]
