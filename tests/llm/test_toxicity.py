import random
import zlib

import numpy as np

from tessera.llm import queries, toxicity


def corpus(n=700, seed=1):
    rnd = random.Random(seed)
    plain = ["the", "tion", "ering", "one", "and", "of", "ther", "reon", "heat", "onst"]
    bad = {"en": ["idiot", "scum"], "de": ["loweist", "loweung", "loweich"]}
    rows = []
    for i in range(n):
        lang, toxic = rnd.choice(["en", "de"]), int(rnd.random() < 0.3)
        words = rnd.choices(plain, k=rnd.randrange(3, 200))
        for _ in range(toxic * rnd.randrange(1, 4)):
            words.insert(rnd.randrange(len(words)), rnd.choice(bad[lang]))
        rows.append((i, " ".join(words), lang, toxic))
    return rows


def slow_score(model, text):
    """One window at a time."""
    words = toxicity.WORDS((text or "").lower())
    x = [sum((model.embedding[b % toxicity.BUCKETS] for b in toxicity._features(w)), np.zeros(toxicity.DIM)) for w in words] or [np.zeros(toxicity.DIM)]
    z = model.offset
    for k, (f, b) in enumerate(zip(model.filters, model.bias, strict=True)):
        padded = x + [np.zeros(toxicity.DIM)] * (len(f) - 1)
        out = np.max([sum(padded[i + j] @ f[j] for j in range(len(f))) + b for i in range(len(x))], axis=0)
        z += out @ model.weight[k * toxicity.FILTERS : (k + 1) * toxicity.FILTERS]
    return 1 / (1 + np.exp(-(z * model.scale + model.shift)))


def test_held_out_accuracy_and_scores_same_as_brute_force(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t, g, "x") for i, t, g, _ in rows] + [(10_000, None, None, None), (10_001, "", "en", "y"), (10_002, "word " * 30000, "fr", "y")], "doc_id long, text string, lang string, score string").repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) + 3
    out = [(y, got[i].score) for i, _, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(s >= 0.3) == y for y, s in out]) > 0.97
    for i in (0, 1, 2, 3, 50, 10_000, 10_001, 10_002):
        assert abs(got[i].score - slow_score(model, got[i].text)) < 1e-4
    assert got[10_000].score == got[10_001].score < 0.3
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert np.mean([(i in kept) == (y == 0) for i, _, _, y in rows]) > 0.97 and set(model.thresholds) == {"en", "de"}


def test_no_labels_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (1, "a b", "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ones = spark.createDataFrame([(1, 0, 1), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert [r.score < 0.3 for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [True, True]
    assert [r.score > 0.3 for r in toxicity.score(docs, toxicity.train(docs, ones)).collect()] == [True, True]
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), ones)).count() == 0
    bare = docs.drop("lang")
    assert toxicity.keep_clean(bare, toxicity.train(bare, none)).count() == 2


def test_the_sample_is_bounded_in_characters(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([r[:3] for r in rows] + [(3, "w " * 100_000, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    small, whole = toxicity.train(docs, labels, chars=20_000), toxicity.train(docs, labels)
    assert (np.abs(small.embedding - whole.embedding) > 0).any() and set(small.thresholds) == {"en", "de"}


def test_query_columns(spark, sf_dir):
    rows = queries.op7_toxicity(spark, sf_dir).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert len(rows) == len(ids) and {r.doc_id for r in rows} == ids
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_convolutions_add_to_the_words(spark):
    """Two words are toxic only side by side: the log-odds that the first dimension starts with cannot tell, the filters can."""
    rnd = random.Random(4)
    texts, y = [], []
    for i in range(2400):
        words = rnd.choices(["the", "heat", "of", "stone", "is", "low"], k=30)
        at = rnd.randrange(25)
        if i % 2:
            words[at : at + 2] = ["black", "heart"]
        else:
            words[at], words[at + 4] = "black", "heart"
        texts.append(" ".join(words))
        y.append(i % 2)
    model = toxicity.fit(texts[:2000], np.array(y[:2000]), epochs=20)
    z = toxicity._all_logits(model, texts[2000:])
    order = np.argsort(z)
    ranks = np.empty(len(z))
    ranks[order] = np.arange(len(z))
    pos = np.array(y[2000:]) == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.9


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y
    one = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int"))
    two = toxicity.train(docs, spark.createDataFrame([(i, flip(i, y)) for i, _, _, y in rows], "doc_id long, toxic int"))
    assert np.array_equal(one.embedding, two.embedding) and one.thresholds == two.thresholds


def test_thresholds_come_from_all_rows_outside_the_fit(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    # a sample of 160 rows keeps 32 for calibration, too few for a language; the other rows have enough
    model = toxicity.train(docs, labels, positives=80, negatives=80)
    assert set(model.thresholds) == {"en", "de"}


def test_thresholds_weigh_the_labels_by_their_real_share():
    rng = np.random.default_rng(2)
    score = {0: rng.beta(2, 5, 40_000), 1: rng.beta(5, 2, 4_000)}
    counts = np.array([np.histogram(score[k], toxicity.BINS, (0, 1))[0] for k in (0, 1)], float)
    fewer = np.array([np.histogram(score[k][:2_000], toxicity.BINS, (0, 1))[0] for k in (0, 1)], float)
    pick = lambda c: toxicity.set_thresholds(toxicity.fit([], np.zeros(0)), {"en": c}, np.array([40_000, 4_000])).thresholds["en"]

    def f1(at):
        hit, false = (score[1] >= at).sum(), (score[0] >= at).sum()
        return 2 * hit / (hit + false + 4_000)

    best = max(f1(at) for at in np.arange(0, 1, 0.005))
    assert f1(pick(counts)) > best - 0.002 and f1(pick(fewer)) > best - 0.02
