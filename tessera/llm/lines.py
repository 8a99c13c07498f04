"""Line deduplication with overlapping windows of three lines.

Every three consecutive lines of a document, blank ones aside, are hashed to 128 bits. A window that starts at
more than one place stays where it comes first, by document and then by place; all lines that its later
occurrences cover go. Windows overlap, so the covered positions merge into runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import cut, join_sparse, keyed

SPACE = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def windows(rows: DataFrame) -> DataFrame:
    """(key, w, places, h1, h2) of rows (key, text): the w-th window, its three line numbers and its hash."""
    numbered = F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("i"), F.trim(x, F.lit(SPACE)).alias("line")))
    kept = rows.select("key", F.filter(numbered, lambda x: x["line"] != "").alias("l"))
    at = F.when(F.size("l") >= 3, F.sequence(F.lit(0), F.size("l") - 3)).otherwise(F.array().cast("array<int>"))
    three = kept.select("key", "l", F.explode(at).alias("w"))
    x, y, z = (F.get("l", F.col("w") + j) for j in range(3))
    return three.select(
        "key",
        "w",
        F.array(x["i"], y["i"], z["i"]).alias("places"),
        F.xxhash64(x["line"], y["line"], z["line"]).alias("h1"),
        F.xxhash64(F.lit("\x1e"), z["line"], x["line"], y["line"]).alias("h2"),
    )


def repeated_lines(rows: DataFrame) -> DataFrame:
    """(key, gone): the line numbers, from 0, that later occurrences of repeated windows cover.

    Counts combine before the shuffle, and the join that finds a window's occurrences can be split where one
    is very common. A document's list is no longer than its lines.
    """
    found = windows(rows)
    first = cut(found.groupBy("h1", "h2").agg(F.min(F.struct("key", "w")).alias("first"), F.count("*").alias("n")).filter("n > 1"))
    later = found.join(first, ["h1", "h2"]).filter(F.struct("key", "w") != F.col("first"))
    return later.select("key", F.explode("places").alias("place")).groupBy("key").agg(F.collect_set("place").alias("gone"))


def remove_repeated(docs: DataFrame, text: str = "text", n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` without the repeated lines in ``text``, and with the numbers of lines before and of those removed.

    Lines end at ``\\n`` and are compared without spaces, tabs and returns around them; the text that stays is as
    it was. Blank lines are in no window and stay. A text of fewer than three lines that aren't blank, an
    empty or a null one has no window and stays as it is (null has no lines). Repeated rows, and null doc_ids
    first, count in the order of (doc_id, text). Columns of the two names are replaced, others pass.
    """
    names = [c for c in docs.columns if c not in (n_lines, n_removed)]
    name = "\x00key"
    rows = keyed(docs.select(*names).withColumnsRenamed({"key": name})).select("key", *[name if c == "key" else c for c in names])
    lists = repeated_lines(rows.filter(F.col(text).isNotNull()).select("key", F.col(text).alias("text"))).withColumnRenamed("gone", "\x00gone")
    held = join_sparse(rows, lists, "left")
    at, last = held.columns.index(text), len(held.columns) - 1
    fields = [f for f in held.schema if f.name not in ("key", "\x00gone")]
    schema = T.StructType([*fields, T.StructField("\x00lines", T.LongType()), T.StructField("\x00removed", T.LongType())])
    keep = [i for i, c in enumerate(held.columns) if c not in ("key", "\x00gone")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines, removed = [], [], []
            for t, gone in zip(b.column(at), b.column(last), strict=True):
                if not t.is_valid:
                    texts.append(None), lines.append(0), removed.append(0)
                    continue
                parts = t.as_py().split("\n")
                out = set(gone.as_py() or ()) if gone.is_valid else ()
                texts.append("\n".join(x for i, x in enumerate(parts) if i not in out) if out else t.as_py())
                lines.append(len(parts)), removed.append(len(out))
            columns = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], schema.names)

    out = held.mapInArrow(run, schema).withColumnsRenamed({name: "key", "\x00lines": n_lines, "\x00removed": n_removed})
    return out.select(*names, n_lines, n_removed)
