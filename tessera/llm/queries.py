"""The queries of this folder, by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, conversation_trie, decontamination, hard_negatives, html_extraction, lines, resampling, secrets, sharding, simhash, suffixes, toxicity, weighted_sampling


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.assign(docs, ["doc_id"], sharding.default_shards())


def op2_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents sampled by importance, with their weights and keys."""
    kept = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return kept.select("doc_id", "log_weight", "sample_key")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate class of every document."""
    return simhash.digest(simhash.near_duplicates(_table(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in documents: one row for each document and passage."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.mark(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("leaks"))


def op5_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return weighted_sampling.edited_likeness(_table(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat in windows of three, as a digest."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return lines.remove_repeated(docs).select("doc_id", "n_lines", "n_removed", kept)


OP6_SQL = """
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), numbered AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM split
), filled AS (
  SELECT doc_id, place, trim(line, ' ' || chr(9) || chr(13)) AS line FROM numbered WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), windowed AS (
  SELECT doc_id, place, line, lead(line) OVER w AS line2, lead(line, 2) OVER w AS line3, lead(place) OVER w AS place2, lead(place, 2) OVER w AS place3
  FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, place) AS occurrence FROM windowed WHERE line3 IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, unnest([place, place2, place3]) AS place FROM ranked WHERE occurrence > 1
), kept AS (
  SELECT n.doc_id, count(*) AS n_lines, count(g.place) AS n_removed,
         coalesce(string_agg(n.line, chr(10) ORDER BY n.place) FILTER (WHERE g.place IS NULL), '') AS text
  FROM numbered n LEFT JOIN gone g USING (doc_id, place) GROUP BY n.doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels outside one fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", (toxicity.part() == 2).alias("held_out"), "score", predicted, (F.col("score") >= toxicity.threshold(model)).alias("rejected"))


def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digest of every document's ids and of the text that they decode to."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    tokens = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded")
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256")
    return tokens.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest, F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document: pattern matches, and those that the Markov models add."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.sha2(secrets.span_text(F.col("spans"), secrets.KINDS[:3]), 256).alias("base_sha256")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), n("markov"), base, secrets.span_text(F.col("spans")).alias("spans"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a 100-byte string covers which also starts earlier in the corpus."""
    return suffixes.digest(_table(spark, sf_dir, "documents"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by a model trained on labelled pages."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_extraction.extract(pages, html_extraction.train(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations, with the totals of its subtree."""
    return conversation_trie.trie(_table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, by exact scores against all vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), hard_negatives.whole_numbers(F.col("embedding")).alias("numbers"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_resampling": op2_resampling,
    "op3_simhash": op3_simhash,
    "op4_decontamination": op4_decontamination,
    "op5_weighted_sampling": op5_weighted_sampling,
    "op6_lines": op6_lines,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_secrets": op9_secrets,
    "op10_suffixes": op10_suffixes,
    "op11_html_extraction": op11_html_extraction,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {"op6_lines": OP6_SQL}
