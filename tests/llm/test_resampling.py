import math
import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import resampling as res
from tessera.llm.shared import cut


def rows(n=400):
    rnd = random.Random(2)
    good, bad = ["the", "heat", "of", "stone", "is", "low"], ["BUY", "!!", "now", "$$", "CLICK"]
    out = []
    for i in range(n):
        q = int(rnd.random() < 0.7)
        out.append((i, " ".join(rnd.choices(good if q else bad, k=rnd.randrange(1, 80))), q))
    return out


def test_weights_same_as_brute_force(spark):
    data = rows(120)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(900, None, "x"), (901, "", "x"), (902, "é!? ok", "x")], "doc_id long, text string, key string").repartition(3)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data if i % 2] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.log_weight for r in res.weigh(docs, labels).collect()}
    split = lambda t: re.findall(r"\w+|[^\w\s]+", t or "")
    texts = {i: split(t) for i, t, _ in data} | {900: [], 901: [], 902: split("é!? ok")}
    n, full = res.BUCKETS, (1 << 64) - 1

    def bucket(*words):
        h = [xxhash.xxh64_intdigest(w.encode()) for w in words]
        if len(h) == 1:
            return h[0] % n
        x = (h[0] * 0x9E3779B97F4A7C15 & full) ^ h[1]
        x = (x ^ x >> 31) * 0xD6E8FEB86659FD93 & full
        return (x ^ x >> 32) % n

    grams = {i: [bucket(w) for w in t] + [bucket(*p) for p in zip(t, t[1:], strict=False)] for i, t in texts.items()}
    raw, target = Counter(g for x in grams.values() for g in x), Counter(g for i, _, q in data if i % 2 and q for g in grams[i])
    lr, lt = math.log(sum(raw.values()) + n), math.log(sum(target.values()) + n)
    for i, g in grams.items():
        want = res.REFERENCE * sum(math.log(target[x] + 1) - lt - math.log(raw[x] + 1) + lr for x in g) / len(g) if g else 0
        assert abs(got[i] - want) < 1e-3
    assert got[900] == got[901] == 0


def test_sample_prefers_the_target(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data if i % 3 == 0], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in res.resample(docs, labels, 0.6).collect()}
    assert len(kept) == 240
    good = [i for i, _, q in data if q]
    assert len(kept & set(good)) > 0.85 * 240
    again = res.keep_sampled(docs.withColumn("key", F.lit("k")), labels, 0.6)
    assert {r.doc_id for r in again.collect()} == kept and again.columns == ["doc_id", "text", "key"]


def test_top_k_exact_with_ties(spark):
    rnd = random.Random(4)
    values = [(i, rnd.choice([1.0, 2.5, -3.0, rnd.random(), 1e9 * rnd.random()])) for i in range(3000)]
    df = cut(spark.createDataFrame(values, "key long, v double"))
    for k in (0, 1, 7, 700, 2999, 3000, 5000):
        got = {r.key for r in res.top_k(df, k, "v", bins=5, last_bin=20).collect()}
        assert got == {i for i, _ in sorted(values, key=lambda x: (-x[1], x[0]))[:k]}


def test_gumbel_is_gumbel_and_stable(spark):
    g = [r.g for r in spark.range(20000).repartition(7).select(res.gumbel(F.col("id")).alias("g"), "id").orderBy("id").collect()]
    assert abs(sum(g) / len(g) - 0.5772) < 0.05 and abs(sum(x < 1 for x in g) / len(g) - math.exp(-math.exp(-1))) < 0.02


def test_repeats_nulls_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert res.weigh(docs, labels).count() == 3 and res.resample(docs, labels, 1.0).count() == 3
    assert res.resample(docs.limit(0), labels).count() == 0
    assert res.keep_sampled(docs, labels, 0.7).count() == 2  # of two equal rows one may stay


def test_rows_are_included_in_proportion_to_their_weights(spark):
    """Over many seeds the sample has each weight as often as drawing one row after another without replacement."""
    weights, k, runs = np.repeat([0.0, 1.0, 2.0, -3.0], 50), 60, 40
    scored = cut(spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "key long, log_weight double"))
    got = np.zeros(4)
    for seed in range(runs):
        drawn = scored.withColumn("sample_key", F.col("log_weight") + res.gumbel(F.col("key"), seed))
        got += np.bincount([r.key // 50 for r in drawn.orderBy(F.desc("sample_key")).limit(k).collect()], minlength=4)
    rng, want = np.random.default_rng(1), np.zeros(4)
    for _ in range(runs):
        p = np.exp(weights)
        want += np.bincount(rng.choice(200, k, False, p / p.sum()) // 50, minlength=4)
    assert np.abs(got - want).max() / runs < 2.5


def test_noise_has_an_effect_and_junk_stays_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = res.weigh(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    k = int(scored.count() * res.SHARE)
    kept = {r.doc_id for r in res.top_k(scored, k).collect()}
    plain = {r.doc_id for r in scored.orderBy(F.desc("log_weight")).limit(k).collect()}
    assert len(kept & plain) < 0.97 * k  # 0.90 over the ten thousand documents of sf0.1
    good, bad = ({r.doc_id for r in labels.filter(f"quality = {q}").collect()} for q in (1, 0))
    assert len(kept & good) > 0.88 * len(good) and len(kept & bad) < 0.1 * len(bad)
