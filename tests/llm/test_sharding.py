from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, sharding


def slow_fill(names, slots):
    """Each turn searches the whole preference list anew."""
    import hashlib

    lists = []
    for n in names:
        d = hashlib.md5(n.encode()).digest()
        a, s = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:], "big") % (slots - 1) + 1
        lists.append([(a + s * j) % slots for j in range(slots)])
    table = {}
    while len(table) < slots:
        for i, order in enumerate(lists):
            if len(table) < slots:
                table[next(x for x in order if x not in table)] = i
    return [table[i] for i in range(slots)]


def test_fill_same_as_brute_force():
    for n, slots in ((1, 7), (3, 31), (7, 101), (10, 257)):
        names = sharding.default_shards(n)
        assert sharding.fill(names, slots) == slow_fill(names, slots)


def test_assign_places_by_table(spark):
    names = sharding.default_shards(5)
    table = sharding.fill(names, 101)
    df = spark.range(2000).withColumn("slot", F.lit("mine"))
    got = sharding.assign(df, ["id"], names, 101).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(101))).collect()
    assert len(got) == 2000 and all(r.slot == r.h and r.shard == table[r.h] and r.shard_name == names[r.shard] for r in got)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) < 1.4 * min(counts.values())


def test_null_keys_repeats_and_empty(spark):
    names = sharding.default_shards(4)
    df = spark.createDataFrame([(None, "a"), (None, "b"), (3, "c"), (3, "c")], "doc_id long, shard string")
    got = sharding.assign(df, ["doc_id"], names, 101).collect()
    assert len(got) == 4 and len({r.shard for r in got if r.doc_id is None}) == 1 and len({r.shard for r in got if r.doc_id == 3}) == 1
    assert sharding.assign(df.limit(0), ["doc_id"], names, 101).count() == 0


def test_few_rows_move_when_a_shard_goes(spark):
    names = sharding.default_shards(10)
    moved = sharding.moved(spark.range(5000), ["id"], names, names[:-1], 10007).count()
    assert 0.08 * 5000 < moved < 0.2 * 5000


def test_balance_and_files(spark, tmp_path):
    names = sharding.default_shards(3)
    df = spark.range(300).withColumn("n", F.lit(2))
    placed = sharding.assign(df, ["id"], names, 101)
    assert sum(r.weight for r in sharding.balance(placed, F.col("n")).collect()) == 600
    sharding.write_sharded(df, ["id"], names, str(tmp_path / "out"), 2, 101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def test_keys_and_columns_named_like_the_new_ones(spark, tmp_path):
    """A key that is called slot is hashed and then replaced; map columns need no hash."""
    names = sharding.default_shards(3)
    df = spark.createDataFrame([(i % 7, {"a": i}) for i in range(50)], "slot long, m map<string,long>").repartition(4)
    got = sharding.assign(df, ["slot"], names, 101)
    assert got.columns == ["m", "slot", "shard", "shard_name"] and got.count() == 50
    want = {r.s: r.h for r in df.selectExpr("slot s", "pmod(xxhash64(slot), 101) h").collect()}
    assert {r["slot"] for r in got.collect()} == set(want.values())
    sharding.write_sharded(df, ["slot"], names, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_query_same_as_brute_force(spark, sf_dir):
    """Every document's shard by the table that each turn searches anew."""
    names = sharding.default_shards()
    table = sharding.fill(names)
    rows = queries.op1_sharding(spark, sf_dir).withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(sharding.SLOTS))).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows} == docs and len(rows) == len(docs)
    assert all((r["slot"], r.shard, r.shard_name) == (r.h, table[r.h], names[table[r.h]]) for r in rows)
    turns = Counter(table)
    assert max(turns.values()) - min(turns.values()) == 1


@pytest.mark.parametrize("weights", [[0, 0], [1], [1, -1], []])
def test_weights_that_fill_nothing_raise(weights):
    with pytest.raises(ValueError):
        sharding.fill(["a", "b"], 101, weights)
    assert set(sharding.fill(["a", "b"], 101, [0, 3])) == {1}
