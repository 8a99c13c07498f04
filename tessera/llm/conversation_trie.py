"""Prefix trie of conversations, with totals of every subtree by parallel tree contraction.

A turn is two 64-bit hashes of (role, text); the prefix of d turns is the exclusive or of its turns' hashes, each mixed
with its place, so that prefixes of a long conversation come from ranges of it that each run on their own. Equal
prefixes are one node. Totals of subtrees come from rounds of joins: leaves are raked into their parents, nodes with one
child are spliced out of their chains, and once nothing is left the spliced nodes are put back in reverse order. A trie
that is a chain of a million turns takes rounds in proportion to the logarithm of its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.shared import cut, discard

GROUP, SHARED = 5, 9
"""Conversations in a rebuilt group, and the number that the shared turns are counted modulo."""
CHUNK = 4096
"""Ids that are joined into one text before the rows of a node meet."""
EMPTY = hashlib.sha256(b"").hexdigest()


def _before(f, column: str, keys: list[str]) -> Column:
    """Aggregate of ``column`` over the earlier parts of the same conversation; a row for each part, so never many."""
    return f(column).over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, part, pos, size, c1, c2, bytes): every turn's place in its conversation, from 1, and the number of its turns.

    Turns are ranged by (conv_id, turn, role, text), so a conversation of any length is many tasks; what comes before a
    range is counted from a row for each range and conversation.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).filter("conv_id is not null")
    order = ["conv_id", "turn", "role", "text"]
    hashes = {"c1": F.xxhash64("role", "text"), "c2": F.xxhash64(F.lit("\x1e"), "text", "role"), "bytes": F.octet_length("text").cast("bigint")}
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({**hashes, "part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    placed = cut(placed.drop("turn", "role", "text"))
    runs = placed.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    runs = runs.withColumns({"before": F.coalesce(_before(F.sum, "n", ["conv_id"]), F.lit(0)), "size": F.sum("n").over(Window.partitionBy("conv_id"))})
    out = placed.join(runs, ["conv_id", "part"]).withColumn("pos", F.col("row") - F.col("first") + F.col("before") + 1)
    out = cut(out.select("conv_id", "part", "pos", "size", "c1", "c2", "bytes"))
    discard(placed)
    return out


def shared_turns(conv_id: Column) -> Column:
    """How many of its first turns a conversation takes from the first of its group."""
    return F.crc32(conv_id.cast("string")) % SHARED


def _mixed(place: Column) -> dict[str, Column]:
    return {"v1": F.xxhash64("c1", place), "v2": F.xxhash64("c2", place, F.lit(2))}


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, f1, f2, v1, v2, bytes, last) of every prefix of every rebuilt conversation, that of no turns included.

    f1 and f2 name the prefix, v1 and v2 its last turn at that place; ``last`` marks the conversation's whole.
    """
    rows = numbered(turns)
    sizes = rows.groupBy("conv_id").agg(F.max("size").alias("size")).withColumn("h", shared_turns(F.col("conv_id")))
    heads = rows.filter(F.col("pos") < SHARED).select(F.col("conv_id").alias("base"), "pos", "c1", "c2", "bytes")
    lent = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads, "base").filter("pos <= h").withColumns(_mixed(F.col("pos")))
    up_to = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lent = cut(lent.select("conv_id", "pos", "v1", "v2", "bytes", *[F.bit_xor(f"v{i}").over(up_to).alias(f"f{i}") for i in (1, 2)]))
    start = lent.groupBy("conv_id").agg(F.count("*").alias("k"), F.bit_xor("v1").alias("s1"), F.bit_xor("v2").alias("s2"))
    start = sizes.join(start, "conv_id", "left").select("conv_id", "h", "size", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("k", "s1", "s2")])
    start = cut(start.withColumn("whole", F.col("k") + F.greatest(F.col("size") - F.col("h"), F.lit(0))))

    # a conversation's own turns meet its row once for each part, so that a long one has no key of its own
    runs = rows.select("conv_id", "part").distinct().join(start.drop("size"), "conv_id")
    own = rows.filter(F.col("pos") > shared_turns(F.col("conv_id"))).join(runs, ["conv_id", "part"])
    own = own.withColumn("depth", F.col("pos") - F.col("h") + F.col("k")).withColumns(_mixed(F.col("depth")))
    total = own.groupBy("conv_id", "part").agg(F.bit_xor("v1").alias("t1"), F.bit_xor("v2").alias("t2"))
    carried = total.select("conv_id", "part", *[F.coalesce(_before(F.bit_xor, f"t{i}", ["conv_id"]), F.lit(0)).alias(f"t{i}") for i in (1, 2)])
    within = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = own.join(carried, ["conv_id", "part"])
    name = lambda i: F.col(f"s{i}").bitwiseXOR(F.col(f"t{i}")).bitwiseXOR(F.bit_xor(f"v{i}").over(within)).alias(f"f{i}")
    own = own.select("conv_id", "depth", name(1), name(2), "v1", "v2", "bytes", (F.col("depth") == F.col("whole")).alias("last"))
    lent = lent.join(start.select("conv_id", "whole"), "conv_id").select("conv_id", F.col("pos").alias("depth"), "f1", "f2", "v1", "v2", "bytes", (F.col("pos") == F.col("whole")).alias("last"))
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("depth", "f1", "f2", "v1", "v2", "bytes")]
    return cut(own.union(lent).union(start.select("conv_id", *zero, (F.col("whole") == 0).alias("last"))))


def id_digests(ends: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ends_sha256) of longs: digest of the ascending ``conv_id`` of each key, in decimal and joined by commas.

    Ids are ranged and joined into texts of CHUNK ids; a key's texts then pass one task in order, one at a time, so its
    memory does not follow the key's ids.
    """
    names, longs = [*keys, "first", "ids"], ", ".join(f"{k} long" for k in keys)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = []
            for *key, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not out or out[-1][0] != key or len(out[-1][1]) == CHUNK:
                    out.append([key, []])
                out[-1][1].append(i)
            columns = list(zip(*((*k, ids[0], ",".join(map(str, ids))) for k, ids in out), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for *now, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _digest_batch(out, keys)
        if key is not None:
            yield _digest_batch([(*key, state.hexdigest())], keys)

    ids = ends.select(*[F.col(k).cast("bigint").alias(k) for k in keys], "conv_id")
    dealt = ids.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    joined = cut(dealt.mapInArrow(chunks, f"{longs}, first long, ids string"))
    return joined.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digests, f"{longs}, ends_sha256 string")


def _digest_batch(rows: list[tuple], keys: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * (len(keys) + 1)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], [*keys, "ends_sha256"])


def subtree_totals(tree: DataFrame, weights: list[str], rounds: int = 400) -> DataFrame:
    """(node, weights): for every node of a forest (node, parent, weights) the sums over its subtree, itself included.

    ``node`` is unique and of any type that Spark orders; a root has a null parent, and every other parent is a node.
    Each round rakes: every leaf's sum is final and goes to its parent, by a group-by with map-side combine. Then it
    compresses: of the nodes left with one child, those whose hash tops their parent's and their child's are spliced
    out, no two of them neighbours; the child takes the place and carries their sum upwards. Afterwards the rounds are
    undone from the last to the first, a spliced node's total being its own sum and its child's total.
    Raises if ``rounds`` do not do, as on a table whose parents form a circle.
    """
    kids = tree.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("k"))
    edge = {f"e{i}": F.lit(0).cast("bigint") for i in range(len(weights))}
    state = tree.select("node", "parent", *[F.col(w).cast("bigint").alias(f"w{i}") for i, w in enumerate(weights)])
    state = cut(state.join(kids, "node", "left").withColumns({"k": F.coalesce("k", F.lit(0)), **edge}))
    n, done = range(len(weights)), []
    for r in range(rounds):
        if state.isEmpty():
            break
        up = [F.sum(F.when(F.col("k") == 0, F.col(f"w{i}") + F.col(f"e{i}"))).alias(f"a{i}") for i in n]
        up = state.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(*up, F.count_if(F.col("k") == 0).alias("gone"), F.max(F.when(F.col("k") > 0, F.col("node"))).alias("only"))
        live = state.filter("k > 0").join(up, "node")
        live = live.withColumns({**{f"w{i}": F.col(f"w{i}") + F.coalesce(f"a{i}", F.lit(0)) for i in n}, "k": F.col("k") - F.col("gone")})
        rank = lambda c: F.xxhash64(c, F.lit(r))  # noqa: B023, E731
        spliced = (F.col("k") == 1) & F.col("parent").isNotNull() & (rank("node") > rank("parent")) & (rank("node") > rank("only"))
        live = cut(live.select(*state.columns, "only", F.coalesce(spliced, F.lit(False)).alias("spliced")))
        pushed = live.filter("spliced").select(F.col("only").alias("node"), F.col("parent").alias("above"), *[(F.col(f"w{i}") + F.col(f"e{i}")).alias(f"a{i}") for i in n])
        rest = live.filter("not spliced").join(pushed, "node", "left")
        rest = rest.withColumns({"parent": F.coalesce("above", "parent"), **{f"e{i}": F.col(f"e{i}") + F.coalesce(f"a{i}", F.lit(0)) for i in n}})
        done.append((state.filter("k = 0").select("node", *[F.col(f"w{i}") for i in n]), live))
        state = cut(rest.select(*state.columns))
    else:
        if not state.isEmpty():
            raise RuntimeError(f"the tree is not contracted after {rounds} rounds; a parent may be missing or a circle")
    known: DataFrame | None = None
    for raked, live in reversed(done):
        chain = live.filter("spliced")
        if known is not None and not chain.isEmpty():
            below = known.join(live.select("node", *[F.col(f"e{i}").alias(f"b{i}") for i in n]), "node")  # the edge carries what was spliced between them
            below = below.select(F.col("node").alias("only"), *[(F.col(f"w{i}") + F.col(f"b{i}")).alias(f"t{i}") for i in n])
            back = cut(chain.join(below, "only").select("node", *[(F.col(f"w{i}") + F.col(f"t{i}")).alias(f"w{i}") for i in n]))
            known = known.union(back)
        known = raked if known is None else known.union(raked)
    if known is None:
        known = state.select("node", *[F.col(f"w{i}") for i in n])
    return known.select("node", *[F.col(f"w{i}").alias(w) for i, w in enumerate(weights)])


def trie(turns: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations ``turns`` (conv_id, turn, role, text).

    Conversation c takes its first h turns from c - c % 5 and goes on with its own after the first h; h is crc32 of its
    decimal id modulo 9. Turns are in the order of (turn, role, text), nulls first; null roles and texts are empty, rows of a null
    conv_id take no part, repeated rows are turns each, and other columns are ignored. An empty table has no node, not even a root.
    Returns, as longs: conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, members but one times the bytes of a
    node's last text); and ends_sha256 of the ids of the members that end there.
    """
    found = prefixes(turns)
    name = ["f1", "f2", "depth"]
    nodes = found.groupBy(*name).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("v1").alias("v1"), F.max("v2").alias("v2"))
    nodes = cut(nodes)
    above = nodes.select(F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("depth").alias("pd"), F.col("conv_id").alias("parent_conv_id"))
    hung = nodes.withColumns({"p1": F.col("f1").bitwiseXOR(F.col("v1")), "p2": F.col("f2").bitwiseXOR(F.col("v2")), "pd": F.col("depth") - 1})
    hung = cut(hung.join(above, ["p1", "p2", "pd"], "left").select(*name, "conv_id", "parent_conv_id", "n_convs", "bytes"))
    kids = hung.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    placed = cut(hung.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    discard(nodes, hung)
    node = F.struct(F.col("conv_id").alias("c"), F.col("depth").alias("d"))
    parent = F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("c"), (F.col("depth") - 1).alias("d")))
    tree = placed.select(node.alias("node"), parent.alias("parent"), (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"])
    totals = totals.select(F.col("node.c").alias("conv_id"), F.col("node.d").alias("depth"), "n_leaves", "saved_tokens")
    digests = id_digests(found.filter("last").select(*name, "conv_id"), name)
    out = placed.join(digests, name, "left").join(totals, ["conv_id", "depth"])
    long = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return out.select(*[F.col(c).cast("bigint").alias(c) for c in long], F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
