import hashlib
import random
import re

import numpy as np

from tessera.llm import queries, secrets


def slow_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [("assign", *m.span())] * (len(m.group(2)) >= 6)
    for kind, p, least in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
        out += [(kind, *m.span()) for m in re.finditer(p, text) if m.end() - m.start() >= least]
    return out


def model():
    rnd = random.Random(5)
    words = ["".join(rnd.choices(["the", "tion", "on", "er", "re", "ing", "key", "map"], k=rnd.randrange(1, 5))) for _ in range(5000)]
    return secrets.fit(secrets.random_strings(4000), words + ["_".join(words[i : i + 4]) for i in range(2000)])


def test_base_same_as_brute_force():
    rnd = random.Random(4)
    parts = ["password", "PASSWD", "Token", "apikey", "api_key", '"', "'", " ", ":", "=", "abc123", "AKIA", "ABCD1234EFGH5678", "deadbeef01", "é", "\n", "x", "ſecret", "Key"]
    for _ in range(3000):
        t = "".join(rnd.choices(parts, k=rnd.randrange(30)))
        assert sorted(secrets.base_spans(t)) == sorted(slow_base(t))


def test_scan_keeps_base_and_adds_random_tokens(spark):
    m = model()
    rnd = random.Random(6)
    odd = "".join(rnd.choices(secrets.ALPHABET[:62], k=40))
    rows = [(1, f"é see {odd} and theingreontion_keymapthetion here"), (2, None), (3, ""), (4, 'password = "hunter22x" ' + "0123456789abcdef01234567"), (4, "the tion " * 50000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string")
    got = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in secrets.scan(df, m).collect()]
    assert got == [(1, [("markov", 6, 46)]), (2, []), (3, []), (4, [("assign", 0, 21), ("hex", 23, 47)]), (4, [])]
    clean = [r.text for r in secrets.redact(df, m).collect()]
    assert clean[0] == "é see [secret] and theingreontion_keymapthetion here" and clean[1] is None and clean[3] == '[secret]" [secret]'


def test_held_out_accuracy():
    m = model()
    rnd = random.Random(8)
    good = ["_".join(rnd.choices(["mapping", "ering", "thekey", "reaction"], k=3)) for _ in range(300)]
    bad = secrets.random_strings(300, seed=99)
    caught = [s for s in bad if len(s) >= 20 and m.score(s) > m.threshold]
    assert not [w for w in good if m.score(w) > m.threshold] and len(caught) > 0.9 * len([s for s in bad if len(s) >= 20])


def test_train_on_tables(spark):
    df = spark.createDataFrame([(1, "some ordinary words"), (None, None)], "doc_id long, text string")
    assert secrets.train(df).threshold > 0 and secrets.train(df.limit(0)).ratio.shape == (68, 68)


def test_train_counts_every_document(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(["the", "tion", "ering", "one", "and", "map", "key"], k=20)) + " password=abcdef123") for i in range(6000)]
    rare = ["qzx", "xqv", "zvjq", "wqxz", "jzv"]
    for i in (2584, 3925):  # far behind the first 2,000 by the ids' hashes
        rows[i] = (i, " ".join(rnd.choices(rare, k=300)))
    m = secrets.train(spark.createDataFrame(rows, "doc_id long, text string"))
    names = ["_".join(rnd.choices(rare, k=7)) for _ in range(50)]
    assert not [w for w in names if m.score(w) > m.threshold]
    # the same as counting one transition at a time
    counts = np.zeros((68, 68))
    for _, t in rows:
        words = [w for w in t.split() if not w.startswith("password")]
        for w in words + ["_".join(words[i : i + 3]) for i in range(0, len(words), 9)] + ["".join(x.capitalize() for x in words[i : i + 3]) for i in range(0, len(words), 9)]:
            for a, b in zip("\0" + w, w, strict=False):
                counts[secrets.ALPHABET.find(a) + 1, secrets.ALPHABET.find(b) + 1] += 1
    want = secrets._fit_counts(secrets._transitions(secrets.random_strings()), counts)
    assert np.allclose(m.ratio, want.ratio)


def test_query_same_as_brute_force(spark, sf_dir):
    """Counts, digest and spans of the query on whole texts, the added spans by a score of one transition at a time."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    m = secrets.train(docs)

    def added(text, base):
        for x in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
            if not any(a < x.end() and x.start() < b for _, a, b in base):
                score = sum(m.ratio[secrets.ALPHABET.find(a) + 1, secrets.ALPHABET.find(b) + 1] for a, b in zip("\0" + x.group(), x.group(), strict=False))
                if score > m.threshold:
                    yield "markov", *x.span()

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rnd = random.Random(1)
    extra = {10**9 + i: f"x {''.join(rnd.choices(secrets.ALPHABET[:62], k=44))} y token: abc{i}def" for i in range(9)} | {10**9 + 50: None, 10**9 + 51: ""}
    rows = [*texts.items(), *extra.items()]
    full = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), m)
    order = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], secrets.KINDS.index(s[0]))))
    want = {i: (b := slow_base(t or ""), b + list(added(t or "", b))) for i, t in rows}
    assert {r.doc_id: r.x for r in full.select("doc_id", secrets.span_text(full.spans).alias("x")).collect()} == {i: order(w[1]) for i, w in want.items()}
    assert all("markov" in order(want[i][1]) for i in extra if i < 10**9 + 50)
    for r in queries.op9_secrets(spark, sf_dir).collect():
        base, whole = want[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in base) for x in secrets.KINDS[:3])
        assert r.base_sha256 == hashlib.sha256(order(base).encode()).hexdigest() and r.spans == order(whole)
