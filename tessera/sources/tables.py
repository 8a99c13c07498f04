"""Readers and writers: CSV dialects, tables, JSON lines, file lists, checksums."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions.scalars import parse_decimal

MARKER = T.StructType([T.StructField("event_type", T.StringType()), T.StructField("condition", T.StringType()), T.StructField("unix_time_ms", T.LongType())])


def read_dialect_csv(spark: SparkSession, paths: str | list[str], numbers: list[str] = ()) -> DataFrame:
    """CSV files with an optional first line "sep=", ; or , between fields, quoted headers of any words, and decimal commas
    in the ``numbers`` columns; every file has its own dialect. Columns are strings, but for ``numbers``.

    The driver sees the first two lines of each file, as many rows as there are files; the files are read in Spark's
    splits. A quoted field may not hold a line break. Files of other columns are stacked by name.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    begin = lines.filter("at = 0")
    heads = begin.groupBy("file").agg(F.min("n").alias("first"))
    top = begin.join(F.broadcast(heads), "file").filter(F.col("n") <= F.col("first") + 1).select("file", "value", "n", "first").collect()
    dialects: dict[tuple, list] = {}
    for name in {r.file for r in top}:
        own = sorted((r.n - r.first, r.value) for r in top if r.file == name)
        declared = own[0][1][4:5] if own[0][1].lower().startswith("sep=") and len(own) > 1 else ""
        header = own[1][1] if declared else own[0][1]
        sep = declared or (";" if header.count(";") > header.count(",") else ",")
        names = tuple(h.strip() for h in next(csv.reader([header.lstrip("\ufeff")], delimiter=sep)))
        dialects.setdefault((sep, names), []).append((name, int(bool(declared))))
    out = None
    for (sep, names), files in sorted(dialects.items()):
        of = spark.createDataFrame(files, "file string, skip int")
        body = lines.join(F.broadcast(of), "file").join(F.broadcast(heads), "file").filter((F.col("at") > 0) | (F.col("n") > F.col("first") + F.col("skip")))
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        rows = body.filter(F.trim("value") != "").select(F.from_csv("value", schema, {"sep": sep, "quote": '"', "escape": '"'}).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.DoubleType()) for c in numbers]))
    return out.withColumns({c: parse_decimal(F.col(f"`{c}`")) for c in numbers})


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, or CSV with a header under an explicit schema."""
    if path.endswith(".csv"):
        return spark.read.schema(schema).csv(path, header=True) if schema else spark.read.csv(path, header=True)
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; a malformed line keeps its text in ``_corrupt_record``."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).json(path)


def decode_markers(df: DataFrame, key: str, time: str, payload: str) -> DataFrame:
    """Payloads as event structs, other text as its own event_type, numbered by time within the source."""
    j = F.from_json(payload, MARKER)
    text = F.when(F.get_json_object(payload, "$").isNull() | F.col("_j.event_type").isNull(), F.col(payload)).otherwise(F.col("_j.event_type"))
    n = (F.row_number().over(Window.partitionBy(key).orderBy(time)) - 1).alias("marker_index")
    return df.withColumn("_j", j).select(key, time, text.alias("event_type"), F.col("_j.condition").alias("condition"), F.col("_j.unix_time_ms").alias("unix_time_ms"), n)


def session_index(files: DataFrame) -> DataFrame:
    """Per participant and session: its size, and the largest file that is no backup (a backup if there is no other).

    ``files``: participant, session, path, size. The largest session of a participant is kept.
    """
    f = files.withColumn("backup", F.lower("path").contains("backup"))
    g = f.groupBy("participant", "session").agg(F.sum("size").alias("session_size"), F.max_by(F.struct("path", "backup", "size"), F.struct((~F.col("backup")).alias("a"), "size", "path")).alias("m"))
    best = g.groupBy("participant").agg(F.max_by(F.struct("session", "session_size", "m"), F.struct("session_size", "session")).alias("b"))
    return best.select("participant", "b.session", "b.session_size", "b.m.path", F.col("b.m.backup").alias("is_backup"), F.col("b.m.size").alias("file_size"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size and time of files; the contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    w = df.write.mode(mode)
    w.csv(path, header=True) if kind == "csv" else w.parquet(path)


def write_messages(df: DataFrame, path: str) -> None:
    """Append to a JSON-lines log and to its Parquet twin."""
    df.write.mode("append").json(f"{path}/jsonl")
    df.write.mode("append").parquet(f"{path}/parquet")


def checksums(spark: SparkSession, path: str, declared: DataFrame | None = None) -> DataFrame:
    """SHA-256 of each file; with ``declared`` (name, sha256) also whether it agrees."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return f if declared is None else f.join(declared, "name", "full_outer").withColumn("ok", F.coalesce(F.col("found") == F.col("sha256"), F.lit(False)))


def content_hash(df: DataFrame) -> DataFrame:
    """One row: a hash of the table that the order of rows and columns doesn't change, and the number of rows.

    Rows are hashed where they are; their hashes are counted by their first byte, and only sums come together.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("h", a, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{a}") for a in (1, 13, 25, 37)]
    s = df.select(row.alias("h")).agg(F.count("*").alias("n_rows"), *parts)
    return s.select(F.sha2(F.concat_ws("-", F.col("n_rows").cast("string"), *[F.col(f"s{a}").cast("string") for a in (1, 13, 25, 37)]), 256).alias("content_hash"), "n_rows")
