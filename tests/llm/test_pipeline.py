import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import queries


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        n.append(out.count())
        last, docs = docs, out
    assert n[0] >= n[1] == n[2] >= n[3] >= n[4] == n[5] and n[5] < n[0]
    texts = {r.doc_id: r.text or "" for r in last.collect()}
    lib = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    assert all(r.ids == lib.encode(texts[r.doc_id], add_special_tokens=False).ids for r in docs.collect())


def test_toxic_documents_go_and_clean_ones_stay(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir).select("doc_id").withColumn("kept", F.lit(True))
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(kept, "doc_id", "left").collect()
    assert sum((r.kept is None) == (r.toxic == 1) for r in rows) >= 0.93 * len(rows)


def test_queries_of_the_folder_have_their_sql(spark, sf_dir):
    for name, sql in queries.ORACLES.items():
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
        want = con.sql(sql)
        got = queries.QUERIES[name](spark, sf_dir)
        assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


CLASH = ["key", "ids", "spans", "score", "leaks", "fp", "n_lines", "n_removed", "n_tokens", "component_id", "decoded", "target", "bucket"]
BASE = 10**6
"""The odd rows' ids begin here, where no label is."""


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    """Null, empty, white, very long and repeated rows, null and repeated ids, columns named like the operators' own."""
    some = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(12).collect()]
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").head().text
    line = "one line here\nanother line there\nand a third line of text"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 200_000), (5, "x" * 300_000), (6, line + "\nend"), (7, line + "\nother"), (8, f"so it goes {leak} and on"), (9, some[0]), (9, some[0]), (9, some[1]), (None, "no id here"), (None, None)]
    rows += [(20 + i, t) for i, t in enumerate(some)]
    rows = [(None if i is None else BASE + i, t) for i, t in rows]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *CLASH) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(c + ' string' for c in CLASH)}").repartition(3)


def test_stages_take_odd_rows(spark, sf_dir, odd):
    marks = lambda rows: {tuple(r[c] for c in CLASH) for r in rows}
    ids = lambda rows: sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    before = odd.collect()
    out = {name: stage(spark, odd, sf_dir) for name, stage in corpus_pipeline.STAGES}
    for name in list(out)[:-1]:
        assert out[name].columns == odd.columns
        assert marks(out[name].collect()) == {tuple(CLASH)}
    toxic = out["toxicity"].collect()
    assert {(r.doc_id, r.text) for r in before if not (r.text or "").strip()} <= {(r.doc_id, r.text) for r in toxic}
    lines = out["line dedup"].collect()
    assert ids(lines) == ids(before)
    text = {r.doc_id - BASE: r for r in lines if r.doc_id is not None}
    assert text[6].text.endswith("end") and text[7].text == "other" and text[7].n_chars == 5 and text[1].text is None and text[4].text == "word " * 200_000
    near = out["near-dedup by shingles"].collect()
    assert sum(not (r.text or "").strip() for r in near) == 1 and sum(r.doc_id == BASE + 9 for r in near) <= 2
    clean = out["benchmark decontamination"].collect()
    left = {r.doc_id - BASE for r in clean if r.doc_id is not None}
    assert 8 not in left and {1, 2, 3, 4, 5, 6, 7} <= left
    tokens = out["bpe encoding and decoding"].collect()
    assert ids(tokens) == ids(before) and all(r.n_tokens == len(r.ids) and r.key == "key" and r.spans == "spans" for r in tokens)
    sha = {hashlib.sha256((r.text or "").encode()).hexdigest() for r in before}
    assert {r.decoded_sha256 for r in tokens} == sha


def test_stages_take_an_empty_table(spark, sf_dir, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf_dir).count() == 0


def test_run_is_the_stages_in_turn(spark, sf_dir):
    """Against plain sets and edit tables: what stays is clean, and no document goes without a reason."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) <= set(docs) and len(got) > 0.5 * len(docs)
    step = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, sf_dir)
    assert {r.doc_id: (r.ids, r.n_tokens, r.decoded_sha256) for r in step.collect()} == {i: (r.ids, r.n_tokens, r.decoded_sha256) for i, r in got.items()}


def test_bpe_query_same_as_the_library(spark, sf_dir):
    lib = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    lib.no_truncation(), lib.no_padding()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in queries.op8_bpe(spark, sf_dir).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
