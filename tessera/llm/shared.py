"""What the operators of this folder share: tables between stages, row keys, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset (tests, one machine) a new temporary folder takes its place, one for each application.
    """
    folder, application = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not folder and application not in _OWN:
        _OWN[application] = tempfile.mkdtemp(prefix="spark-checkpoint-")
    return folder or _OWN[application]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read and not a re-run of all stages before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._cut_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing still to run reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send rows to Python workers in batches of at most ``rows``: documents are long, and the session's usual ten
    thousand of them at a time would be most of a worker's memory. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of stages whose results were cut."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; every other column is pruned from the scan."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def keyed(docs: DataFrame, name: str = "key") -> DataFrame:
    """Add ``name``, a long unique per row and ascending in (doc_id, text), nulls first; a column of that name is replaced.

    Where doc_id is unique and never null, as in a corpus table, key is doc_id: the test reads only
    that column and counts it with map-side combine. Else the rows are ranged by (doc_id, text) and
    written once with a number each, so repeated rows stay distinct rows.
    """
    repeated = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1)
    if dict(docs.dtypes)["doc_id"] in ("bigint", "int") and not repeated.head(1):
        return docs.withColumn(name, F.col("doc_id").cast("bigint"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    return cut(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))


BUCKETS = 1 << 20
"""Hash classes of keys; at most so many rows are broadcast by ``join_sparse``, whatever the corpus."""


def join_sparse(rows: DataFrame, lists: DataFrame, how: str = "inner", key: str = "key", shuffled: bool = False) -> DataFrame:
    """Join on ``key``, "inner" or "left", of wide rows with something that few of them have.

    The hash classes of the keys in ``lists`` are broadcast, and rows of other classes stay out of the shuffle.
    Where most keys are listed this is a common join. ``shuffled``: never a broadcast of ``lists`` themselves, for
    one plan at every size.
    """
    lists = cut(lists)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    some = F.broadcast(lists.select(bucket.alias("\x00bucket")).distinct())
    met = rows.join(some, bucket == F.col("\x00bucket"), "left_semi").join(lists.hint("merge") if shuffled else lists, key, how)
    if how == "inner":
        return met
    return met.unionByName(rows.join(some, bucket == F.col("\x00bucket"), "left_anti"), allowMissingColumns=True)


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges``: (u, v), any order, repeats allowed. Returns (node, component), component the smallest
    node reachable, for every node that has an edge to another. Each round is two group-bys with
    map-side combine and two joins of written tables that adaptive execution can split, so a hub needs no task
    of its own; the number of rounds grows with the logarithm of the longest path. Stops when nothing moves,
    and raises if that has not come after ``rounds``.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e)
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        linked = large.join(least, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v")))
        old, e = e, cut(small.filter("u <> v").distinct())
        discard(old, low, large, least)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).head()
        if now == before or now[0] == now[2] and not e.join(e.select(F.col("v").alias("u")), "u", "left_semi").head(1):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))  # every node points at one root, and no root points on
        before = now
    raise RuntimeError(f"components still change after {rounds} rounds")


def hex64(c: Column) -> Column:
    """A long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))
