import math
import random

import numpy as np
import pytest

from tessera.llm import hard_negatives as hn
from tessera.llm import queries


def slow(rows, top=5):
    """rows (id, label, vector of whole numbers); of repeated ids the least row."""
    least = {}
    for i, label, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        least.setdefault(i, (label, v))
    out = []
    for a, (label, v) in least.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=False)) for i, (_, w) in least.items()}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if i != a and least[i][0] == label][:top]:
            near = [i for i in order if least[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(near[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_tables_and_planes_give_products():
    rnd = np.random.default_rng(1)
    for low, high in ((-300, 300), (0, 1), (5, 6), (-1 << 24, 1 << 24)):
        a, c = rnd.integers(low, high, (7, 24)), rnd.integers(low, high, (50, 24))
        least = int(c.min())
        bits = hn.planes(c, least, int(c.max() - least).bit_length())
        assert (hn.scores(hn.tables(a), bits, a.sum(axis=1) * least) == c @ a.T).all()


@pytest.mark.parametrize("sizes", [(256, 131072, 2048), (2, 9, 4)])
def test_same_as_brute_force(spark, monkeypatch, sizes):
    """Ties, a vector that a third of the rows share, vectors of several lengths, repeated ids, one label without others."""
    for name, n in zip(("ANCHORS", "CANDIDATES", "SLICE"), sizes, strict=True):
        monkeypatch.setattr(hn, name, n)
    rnd = random.Random(13)
    vector = lambda n: [rnd.randrange(-6, 9) for _ in range(n)]
    same = vector(12)
    rows = [(i * 10, rnd.randrange(4), same if i % 3 == 0 else vector(rnd.choice([12, 12, 12, 5, 17, 0]))) for i in range(160)]
    rows += [(100, 0, vector(12)), (100, 0, vector(12)), (5, 9, same), (700, 8, vector(12)), (-300, 1, same)]
    odd = [(1, None, [1]), (None, 2, [1]), (200, 2, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "id long, label int, numbers array<long>, block string, score int").repartition(5)
    assert got(hn.mine(df, hn.F.col("id") % 100 == 0)) == slow(rows)
    assert hn.mine(df.limit(0), hn.F.col("id") % 100 == 0).count() == 0
    assert hn.mine(df.filter("id % 100 <> 0"), hn.F.col("id") % 100 == 0).count() == 0


def test_components_that_are_no_numbers(spark):
    rows = [([0.5, -0.001],), ([1.0, float("nan")],), ([float("inf")],), ([None, 1.0],), (None,), ([],)]
    out = spark.createDataFrame(rows, "v array<float>").select(hn.whole_numbers(hn.F.col("v")).alias("n"))
    assert [r.n for r in out.collect()] == [[128, -1], None, None, None, None, []]


def test_too_large_scores_raise(spark):
    df = spark.createDataFrame([(0, 1, [1 << 40]), (1, 1, [1 << 40])], "id long, label int, numbers array<long>")
    with pytest.raises(Exception, match="56 bits"):
        hn.mine(df, hn.F.col("id") % 100 == 0).count()


def test_query_on_the_table(spark, sf_dir):
    rows = []
    for i, v, label in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect():
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            rows.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = queries.op13_hard_negatives(spark, sf_dir)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got(out) == slow(rows)
