import random

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import near


def slow_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_kept(rows):
    """The first row of each component over all pairs of similarity 0.8 or more."""
    sets, root = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return sorted(rows[i][0] for i in range(len(rows)) if top(i) == i)


def near_copies():
    rnd = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "w " * 30000)]
    for k in range(60):
        words = [f"w{rnd.randrange(2000)}" for _ in range(rnd.randrange(60, 300))]
        for c in range(rnd.choice([1, 2, 3, 8])):
            copy = list(words)
            for _ in range(c and max(1, len(words) * rnd.choice([1, 2, 3, 5]) // 200)):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(10**6)}"
            rows.append((10 + k * 10 + c, " ".join(copy)))
    return rows


def test_stage_keeps_what_all_pairs_keep(spark, sf_dir):
    rows = near_copies()
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    out = corpus_pipeline.drop_near_duplicates(spark, df, sf_dir)
    want = slow_kept(rows)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == want and len(want) < len(rows) - 40


def family(n, words, edits, seed, run=1):
    """``n`` texts of one template of ``words`` words, each with ``edits`` runs of new words in it."""
    rnd = random.Random(seed)
    template = [f"t{rnd.randrange(5000)}" for _ in range(words)]
    out = []
    for i in range(n):
        t = list(template)
        for _ in range(rnd.choice(edits)):
            at = rnd.randrange(words - run)
            t[at : at + run] = [f"x{rnd.randrange(10**7)}" for _ in range(run)]
        out.append((i, " ".join(t)))
    return out


def exact_kept(rows):
    """As ``slow_kept``, with the sizes of all intersections from a product of incidence matrices."""
    sets = [sorted(slow_set(t)) for _, t in rows]
    known = {}
    for s in sets:
        for g in s:
            known[g] = known.get(g, 0) + 1
    often = {g: i for i, g in enumerate(g for g, n in known.items() if n > 1)}
    m = np.zeros((len(rows), len(often)), np.float32)
    for i, s in enumerate(sets):
        m[i, [often[g] for g in s if g in often]] = 1
    both, size = (m @ m.T).astype(int), np.array([len(s) for s in sets])
    near = 10 * both >= 8 * (size[:, None] + size - both)
    np.fill_diagonal(near, True)
    root = np.arange(len(rows))
    while True:
        new = np.where(near, root, len(rows)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return sorted(rows[i][0] for i in set(root.tolist())), int(near.sum() - len(rows)) // 2
        root = new


@pytest.mark.parametrize("shape", [(1200, 404, [5, 6, 7], 1), (1000, 300, [0, 2, 4, 6, 8], 5), (1000, 150, [2, 3, 4], 2)])
def test_families_of_one_template(spark, monkeypatch, shape):
    """Similarities on both sides of the bound, where a member has few others to be linked to."""
    n, words, edits, run = shape
    monkeypatch.setattr(near, "BLOCK_ROWS", 100)
    rows = family(n, words, edits, words, run)
    want, pairs = exact_kept(rows)
    assert pairs > 300 and 1 < len(want) < n
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in near.keep_one(df).collect()) == want


def test_ball_hashing_links_without_bands(spark, monkeypatch):
    """Of pairs of one or two edits, those within 4 bits; the rest, and they alone, need the bands."""
    from tessera.llm import simhash

    rnd, rows, want = random.Random(12), [], []
    for k in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(300)]
        other = list(words)
        for at in rnd.sample(range(300), 1 + k % 2):
            other[at] = f"x{at}"
        pair = [" ".join(words), " ".join(other)]
        rows += [(2 * k, pair[0]), (2 * k + 1, pair[1])]
        far = (simhash.fingerprint(pair[0], 5) ^ simhash.fingerprint(pair[1], 5)).bit_count() > 4
        want += [2 * k, 2 * k + 1] if far else [2 * k]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near.keep_one(df).collect()) == list(range(0, 120, 2))
    monkeypatch.setattr(near, "bands", lambda values: [])
    assert sorted(r.doc_id for r in near.keep_one(df).collect()) == want and 70 < len(want) < 110


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "q r s t u v w")], "doc_id long, text string")
    assert near.keep_one(df).count() == 2 and near.keep_one(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "'x' key", "1 buckets")
    assert near.keep_one(clash).columns == clash.columns and near.keep_one(clash).count() == 2
