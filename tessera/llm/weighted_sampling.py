"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

The terms of a text are its word pairs, weighted by how often they occur. For each of K samples a term with weight
w draws r and c from Gamma(2, 1) and b from the unit interval, all from the term's hash: t = floor(ln w / r + b),
ln a = ln c - r (t - b + 1), and the term with the least a is the sample, with its t. Two texts agree in a sample
with the probability of their generalised Jaccard similarity, the sum of the lesser weights over that of the greater.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.shared import cut

SAMPLES = 32
SPACE = "[ \\t\\n\\x0b\\f\\r]+"
_LOW = (1 << 31) - 1


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; one empty string where there is none."""
    return F.split(F.trim(text, F.lit(" \t\n\x0b\f\r")), SPACE)


def term_hashes(w: Column) -> Column:
    """Sorted hashes of the pairs of words, repeats included; a text of one word has that word. ``w``: a stored column."""
    n = F.size(w)
    pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.xxhash64(F.xxhash64(F.get(w, i)), F.xxhash64(F.get(w, i + 1))))
    one = F.when(F.get(w, F.lit(0)) != "", F.array(F.xxhash64(F.get(w, F.lit(0))))).otherwise(F.array().cast("array<bigint>"))
    return F.sort_array(F.when(n > 1, pairs).otherwise(one))


def runs(s: Column) -> Column:
    """array of (term, weight) of a sorted array: every distinct value and how often it occurs. ``s``: a stored column."""
    n = F.size(s)
    starts = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    ends = F.concat(F.slice(starts, 2, 1 << 30), F.array(n))
    return F.when(n > 0, F.zip_with(starts, ends, lambda a, b: F.struct(F.get(s, a).alias("term"), (b - a).alias("weight"))))


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """ln a of a weighted term for sample k in the upper 32 bits, and 31 bits that name (term, t) in the lower.

    The least such number is the sample: a long, so that the minimum is a plain hash aggregate.
    """
    h1, h2 = F.xxhash64(term, F.lit(k)), F.xxhash64(F.lit(k), term)
    part = lambda h, shift, bits: (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) / float(1 << bits)
    r = -F.ln(part(h1, 43, 21) * part(h1, 22, 21))
    log_c = F.ln(-F.ln(part(h1, 0, 22) * part(h2, 32, 32)))
    b = part(h2, 0, 32)
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b + 1.0)
    name = h2.bitwiseXOR(t * 2654435761).bitwiseAND(F.lit(_LOW))
    return F.shiftleft(((log_a + 128.0) * float(1 << 24)).cast("bigint"), 31).bitwiseOR(name)


def signatures(rows: DataFrame, keys: list[str], carried: list[str], samples: int = SAMPLES) -> DataFrame:
    """``rows`` (keys, carried longs, text) to (keys, carried, sig): sig array<bigint>, of nulls for a text without words.

    One row per text goes in and one comes out; where ``rows`` is dealt by one of the keys nothing is shuffled.
    """
    terms = rows.select(*keys, *carried, words(F.col("text")).alias("\x00words"))
    terms = terms.select(*keys, *carried, term_hashes(F.col("\x00words")).alias("\x00sorted"))
    terms = terms.select(*keys, *carried, runs(F.col("\x00sorted")).alias("\x00runs"))
    terms = terms.select(*keys, *carried, F.inline_outer("\x00runs")).withColumn("\x00log", F.ln(F.col("weight").cast("double")))
    least = [F.min(sample(F.col("term"), F.col("\x00log"), k)).alias(f"\x00m{k}") for k in range(samples)]
    grouped = terms.groupBy(*keys).agg(*[F.min(c).alias(c) for c in carried], *least)
    return grouped.select(*keys, *carried, F.array(*[F.col(f"\x00m{k}").bitwiseAND(F.lit(_LOW)) for k in range(samples)]).alias("sig"))


def likeness(a: Column, b: Column) -> Column:
    """Share of samples that agree: an estimate of the generalised Jaccard similarity; texts without words are alike."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x).cast("double") / F.size(a)


def as_text(sig: Column) -> Column:
    """Eight hexadecimal digits a sample; f where there is none."""
    return F.array_join(F.transform(sig, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x), 8, "0")), F.lit("ffffffff"))), "")


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``docs`` with ``fingerprint`` and ``sig`` added; equal texts have equal ones, null texts those of empty ones."""
    names = [c for c in docs.columns if c not in ("fingerprint", "sig")]
    rows = cut(docs.select(*names).withColumn("\x00row", F.monotonically_increasing_id()))  # written, as both sides of the join must see the same numbers
    marked = signatures(rows.select("\x00row", F.coalesce("text", F.lit("")).alias("text")), ["\x00row"], [], samples)
    return rows.join(marked, "\x00row").select(*names, as_text(F.col("sig")).alias("fingerprint"), "sig")


_CUTS = [(1, 13), (14, 13), (27, 13), (40, 13), (53, 12)]


def _in_ranges(rows: DataFrame) -> DataFrame:
    """(bucket, ghost, doc_id, text): rows dealt into ranges of doc_id; each range also gets, as ghosts, the rows that
    begin the next one (the last range those of the first). The ranges' bounds are an approximate quantile sketch of
    the ids, of as many values as ranges."""
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    low, bounds, nulls = rows.agg(F.min("doc_id"), F.percentile_approx("doc_id", shares, max(10_000, 20 * n)), F.count_if(F.col("doc_id").isNull())).head()
    firsts = sorted({b for b in bounds or [] if b > low}) if low is not None else []
    at = F.split(F.lit(",".join(map(str, firsts)) or "0"), ",").cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull() | F.lit(not firsts), 0).otherwise(F.size(F.filter(at, lambda b: b <= F.col("doc_id"))))
    begins = F.array_contains(at, F.col("doc_id")) if firsts else F.lit(False)
    begins = F.coalesce(begins, F.lit(False)) | (F.col("doc_id").isNull() if nulls else F.col("doc_id").eqNullSafe(F.lit(low)))
    before = F.pmod(F.col("bucket") - 1, F.lit(len(firsts) + 1))
    own, ghost = F.struct("bucket", F.lit(0).alias("ghost")), F.struct(before.alias("bucket"), F.lit(1).alias("ghost"))
    places = F.explode(F.when(begins, F.array(own, ghost)).otherwise(F.array(own)))
    return rows.withColumn("bucket", bucket).select("doc_id", "text", places.alias("p")).select("p.bucket", "p.ghost", "doc_id", "text")


def edited_likeness(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Every text of ``docs`` (doc_id, text) against its edited text and against the next document's.

    The edited text has the last quarter of the code points, rounded down, replaced by the first as many of the
    next document, or by all it has; next by (doc_id, text), the first after the last. Null texts are empty, a
    null doc_id comes first, repeated rows follow each other, a single row is its own next, and an empty table
    gives an empty result. Texts are shuffled once, by range of doc_id, and both windows and the grouping stay
    in that partitioning.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "text")
    placed = _in_ranges(rows).select("bucket", "ghost", "doc_id", "text", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next"))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next", F.lit(1), quarter))
    placed = placed.select("bucket", "ghost", "doc_id", "rn", "text", n.cast("bigint").alias("n_chars"), F.when(F.col("ghost") == 0, edited).alias("edited"))
    placed = placed.withColumn("sha", F.sha2("edited", 256))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))
    one = F.array(F.struct(F.lit(0).alias("kind"), F.col("text")))
    pieces = [F.conv(F.substring("sha", a, m), 16, 10).cast("bigint").alias(f"sha{i}") for i, (a, m) in enumerate(_CUTS)]
    stacked = placed.select("bucket", "rn", "ghost", "doc_id", "n_chars", *pieces, F.explode(F.when(F.col("ghost") == 0, both).otherwise(one)).alias("x"))
    stacked = stacked.select("bucket", "rn", "ghost", "doc_id", "n_chars", *[f"sha{i}" for i in range(5)], "x.kind", "x.text")
    marked = signatures(stacked, ["bucket", "rn", "kind"], ["ghost", "doc_id", "n_chars", *[f"sha{i}" for i in range(5)]], samples)
    follow = Window.partitionBy("bucket").orderBy("rn", "kind")
    out = marked.select("*", F.lead("sig", 1).over(follow).alias("edited_sig"), F.lead("sig", 2).over(follow).alias("next_sig")).filter("ghost = 0 and kind = 0")
    sha = F.concat(*[F.lower(F.lpad(F.hex(f"sha{i}"), m, "0")) for i, (_, m) in enumerate(_CUTS)])
    return out.select(
        "doc_id",
        "n_chars",
        sha.alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
