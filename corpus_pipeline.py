"""A corpus pipeline: each stage calls one operator of ``tessera.llm`` on all that the stage before it kept.

``STAGES`` are (name, function) with function(spark, docs, sf_dir) -> DataFrame; ``run`` applies them in turn, each
result written as Parquet and read again, and deletes a stage's table once the next is written.

All stages take null and empty texts, repeated rows, null ids, an empty table and further columns of any name; these pass
as they are. What a stage does with them stands in its docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontamination, lines, near, toxicity
from tessera.llm.shared import cut, discard


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under their language's threshold.

    A null text scores as an empty one, which stays unless most labels are toxic; equal rows have equal scores and stay
    or go together; without labels every document stays.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated passages of lines; n_chars follows the text where lines went.

    Null, empty and short texts stay as they are; of repeated rows the first keeps its lines.
    """
    out = lines.remove_repeated(docs, n_lines="\x00lines", n_removed="\x00removed")
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("\x00removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n_chars)
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates by 5-word shingles, the first by (doc_id, text), null ids before all.

    Null, empty and white texts are equal to each other, and one of them stays, as of repeated rows.
    """
    return near.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; null and empty texts hold none, and repeated rows stay or go together."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in place of its text, their number, and a digest of the text that they decode to.

    Null and empty texts have no ids; columns that are named like the new ones are replaced.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.encode(docs, path, decoded="\x00decoded")
    new = {"n_tokens": F.size("ids").cast("bigint"), "decoded_sha256": F.sha2("\x00decoded", 256)}
    return decoded.withColumns(new).drop("\x00decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-dedup by shingles", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("bpe encoding and decoding", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        written.append(docs := cut(stage(spark, docs, sf_dir)))
        discard(*written[:-1])
        del written[:-1]
    return STAGES[-1][1](spark, docs, sf_dir)
