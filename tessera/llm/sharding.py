"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table and the shards take turns,
each claiming the first slot of its order that is free. A row's slot is the hash of its key modulo
the prime, so placing is one hash and one look-up, and adding or dropping a shard moves few rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
"""A prime, about 100 times the shards or more; the table and its broadcast have this many rows at any data size."""

SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """The table: for each slot the index of its shard. Setup of fixed size; no data row is seen.

    ``weights``: turns a shard gets in each round, 1 by default, 0 for none. Names must be unique, and one shard at least must have a turn.
    """
    weights = [1] * len(shards) if weights is None else weights
    if len(weights) != len(shards) or min(weights, default=0) < 0 or not any(weights):
        raise ValueError("weights are one for each shard, none negative and not all zero")
    if not _is_prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("slots must be a prime, no less than the shards, which need unique names")
    digest = [hashlib.md5(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digest]
    skip = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digest] if slots > 2 else [1] * len(shards)
    turns = [i for i, w in enumerate(weights) for _ in range(w)]
    table, left = [-1] * slots, slots
    while left:
        for i in turns:
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def lookup(spark: SparkSession, table: list[int], shards: list[str]) -> DataFrame:
    """The table as rows (slot, shard, shard_name); as many as it has slots, so a broadcast is bounded."""
    packed = F.split(F.lit(",".join(map(str, table))), ",")
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    return spark.range(1).select(F.posexplode(packed).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"), F.element_at(names, F.col("shard").cast("int") + 1).alias("shard_name"))


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    """A null key hashes like any other value, so its rows have one defined slot."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def assign(df: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS, prefix: str = "") -> DataFrame:
    """``df`` with ``slot``, ``shard`` and ``shard_name`` (after ``prefix``) added; columns of these names are replaced.

    No row moves: the scan hashes its key and meets the broadcast table in the same stage. Rows of equal
    keys share a shard; null keys are a key; an empty table gives an empty result.
    """
    names = [f"{prefix}{x}" for x in ("slot", "shard", "shard_name")]
    table = lookup(df.sparkSession, fill(shards, slots), shards).toDF(*names)
    placed = df.withColumn("\x00slot", slot_of(*[F.col(k) for k in keys], slots=slots)).drop(*names)
    return placed.join(F.broadcast(table), F.col("\x00slot") == table[names[0]], "left").drop("\x00slot")


def balance(placed: DataFrame, weight: Column) -> DataFrame:
    """Rows and weight per shard, combined before the shuffle."""
    return placed.groupBy("shard", "shard_name").agg(F.count("*").alias("n_rows"), F.sum(weight).alias("weight"))


def moved(df: DataFrame, keys: list[str], old: list[str], new: list[str], slots: int = SLOTS) -> DataFrame:
    """Rows whose shard name differs between two lists of shards."""
    before = assign(df, keys, old, slots, "old_")
    return assign(before, keys, new, slots, "new_").filter("old_shard_name <> new_shard_name")


def write_sharded(df: DataFrame, keys: list[str], shards: list[str], path: str, files_per_shard: int | None = None, slots: int = SLOTS) -> None:
    """Write one folder per shard. A shard is several tasks and files, ``files_per_shard`` or by default as many as keep
    the number of tasks that the input has; the input's partitions take turns, so a repeated key is no task of its own."""
    files = files_per_shard or -(-df.rdd.getNumPartitions() // len(shards))
    placed = assign(df, keys, shards, slots).withColumn("\x00part", F.pmod(F.hash(F.spark_partition_id(), "slot"), F.lit(files)))
    placed.repartition(len(shards) * files, "shard", "\x00part").drop("\x00part").write.partitionBy("shard").parquet(path)


def default_shards(n: int = SHARDS) -> list[str]:
    width = len(str(n - 1))
    return [f"shard-{i:0{width}d}" for i in range(n)]
