import random

from tessera.llm import lines


def slow(rows):
    """rows in corpus order: (lines, removed, text)."""
    seen, out = set(), []
    for t in rows:
        if t is None:
            out.append((0, 0, None))
            continue
        parts = t.split("\n")
        full = [(i, x.strip(" \t\r")) for i, x in enumerate(parts) if x.strip(" \t\r")]
        gone = set()
        for w in range(len(full) - 2):
            three = full[w : w + 3]
            if tuple(x for _, x in three) in seen:
                gone |= {i for i, _ in three}
            seen.add(tuple(x for _, x in three))
        out.append((len(parts), len(gone), "\n".join(x for i, x in enumerate(parts) if i not in gone)))
    return out


def test_same_as_brute_force(spark):
    rnd = random.Random(9)
    pool = [f"line {i}" for i in range(12)] + ["", " ", "a\r", "a", "é\t"]
    texts = ["\n".join(rnd.choices(pool, k=rnd.randrange(0, 30))) for _ in range(200)] + [None, "", "a\nb", "same\n" * 500, "same\n" * 3]
    rnd.shuffle(texts)
    df = spark.createDataFrame([(i * 2, t, "k", "g", 3) for i, t in enumerate(texts)], "doc_id long, text string, key string, gone string, n_lines int").repartition(4)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.remove_repeated(df).collect()}
    assert got == {i * 2: w for i, w in enumerate(slow(texts))}
    assert lines.remove_repeated(df).columns == ["doc_id", "text", "key", "gone", "n_lines", "n_removed"]


def test_repeated_rows_null_ids_and_empty(spark):
    t = "one\ntwo\nthree"
    df = spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed, r.text) for r in lines.remove_repeated(df).collect()) == [(0, 0, t), (1, 3, ""), (1, 3, "")]
    assert lines.remove_repeated(df.limit(0)).count() == 0
