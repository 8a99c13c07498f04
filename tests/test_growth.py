"""What grew faster than the input: plans without it, and the same results by the ways that replace it."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import features as X
from tessera.operators import metrics as M
from tessera.operators import models as L
from tessera.operators import resample as B
from tessera.plans import QUERIES
from tessera.plans.window_queries import rounded


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["control_decision_dwell", "control_decision_utility"])
def test_candidates_of_states_are_not_broadcast(spark, sf_dir, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, sf_dir))


def test_equal_errors_are_no_advantage_whatever_their_sums(spark):
    df = spark.createDataFrame([(0.7 - 0.4, 0.3, 0.3, 1e-17, None), (0.3, 0.7 - 0.4, 0.31, 0.5, None), (0.2, 0.3, 0.3, 0.5, None)], "mae double, condition_only_mae double, history_mae double, spearman double, risk_recall double")
    want = [["not_better_than_condition_only", "not_better_than_history", "rank_correlation_not_positive"], ["not_better_than_condition_only"], []]
    assert [r.reasons for r in M.deployment_gate(df).collect()] == want


def test_rounding_is_that_of_sql(spark):
    import duckdb

    v = [-2e-7, -0.0, 0.0, 2e-7, 1.0000005, -1.0000005, 2.5000005, 0.1234565, 1e300, -1e18, float("nan"), float("inf"), None]
    want = [duckdb.connect().execute(f"SELECT round(CAST({'NULL' if x is None else repr(str(x))} AS DOUBLE), 6)").fetchone()[0] for x in v]
    assert [str(r.v) for r in rounded(spark.createDataFrame([(x,) for x in v], "v double")).collect()] == [str(x) for x in want]


def test_step_up_runs_once_from_the_greatest_p_down(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(400), 2)
    df = spark.createDataFrame([(i % 2, i, float(x)) for i, x in enumerate(p)], "f int, k int, p double")
    out = B.benjamini_hochberg(df, ["f"], "p", "k")
    assert "currentrow$(), unboundedfollowing" not in plan(out).lower()
    for f in (0, 1):
        rows = sorted((r for r in out.collect() if r.f == f), key=lambda r: (r.p, r.k))
        raw = [min(1.0, r.p * len(rows) / (i + 1)) for i, r in enumerate(rows)]
        assert np.allclose([r.q_value for r in rows], np.minimum.accumulate(raw[::-1])[::-1], atol=1e-12)


def test_draws_are_dealt_in_bounded_tasks(spark, monkeypatch):
    df = spark.createDataFrame([(k, float(k % 7), 1 + k % 3) for k in range(100, 340)], "k long, s double, n long")
    whole = sorted(map(tuple, B.bootstrap_mean(df, "k", "s", "n", 10, 7).collect()))
    times = B.bootstrap_clusters(df, "k", 10, 7).join(df, "k")
    by_times = times.groupBy("b").agg((F.sum(F.col("times") * F.col("s")) / F.sum(F.col("times") * F.col("n"))).alias("e"))
    monkeypatch.setattr(B, "DRAWS", 100)
    many = B._picks(spark, 240, 10, 7)
    assert many.rdd.getNumPartitions() == 24 and max(many.rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect()) < 400
    for other in (by_times, B.bootstrap_mean(df, "k", "s", "n", 10, 7)):
        assert np.allclose(whole, sorted(map(tuple, other.collect())), atol=1e-12)


def test_rank_correlation_counts_equal_pairs_once(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(a), float(b)) for g, a, b in zip(rng.integers(0, 3, 500), rng.integers(0, 6, 500), rng.integers(0, 5, 500), strict=True)]
    df = spark.createDataFrame([*rows, (7, 1.0, 1.0), (7, 1.0, 2.0), (8, 3.0, 4.0), (0, None, 1.0)], "g int, a double, b double")
    out = M.spearman(df, ["g"], "a", "b")
    got = {r.g: (r.spearman, r.n) for r in out.collect()}
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    for g in range(3):
        a, b = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2))
        assert got[g][1] == len(a) and abs(got[g][0] - np.corrcoef(rank(a), rank(b))[0, 1]) < 1e-12
    assert got[7] == (None, 2) and got[8] == (None, 1)
    text = plan(out)
    assert text.rindex("partial_count") > text.rindex("Window")  # counted below, that is before, the first window


def test_medians_of_folds_are_counted_in_ranges(spark):
    df = spark.createDataFrame([(k, None if k % 4 == 0 else float(k * k % 31)) for k in range(60)], "k int, v double")
    out = L.impute_scale(df, B.modular_folds(df, "k", 3), "k", "v")
    assert "percentile(CASE" not in plan(out)
    for f in range(3):
        train = np.array([k * k % 31 for k in range(60) if k % 4 and k % 3 not in (f, (f + 1) % 3)], float)
        m = np.median(train)
        filled = {k: float(k * k % 31) if k % 4 else m for k in range(60)}
        t = np.array([v for k, v in filled.items() if k % 3 not in (f, (f + 1) % 3)])
        assert all(abs(r.v - (filled[r.k] - t.mean()) / t.std()) < 1e-9 for r in out.filter(F.col("fold") == f).collect())


@pytest.mark.parametrize("kind", ["long", "double"])
def test_heart_rate_variability_from_running_sums(spark, kind):
    rng = np.random.default_rng(8)
    at = np.cumsum(rng.choice([0, 400, 700, 900, 4000, 40_000], 200, p=[0.05, 0.3, 0.3, 0.3, 0.03, 0.02]))
    df = spark.createDataFrame([(1, int(t)) for t in at], "g int, ms long").withColumn("ms", F.col("ms").cast(kind))
    out = X.hrv(df, ["g"], "ms", 10_000)
    assert "collect_list" not in plan(out)
    for r in out.collect():
        rr = np.diff(at[(at >= r.ms - 10_000) & (at <= r.ms)])
        assert r.n_rr == len(rr)
        if r.ms - at[0] < 8000 or (at <= r.ms).sum() < 3 or len(rr) < 2:
            assert r.rmssd is None and r.sdnn is None and r.pnn50 is None
        else:
            d = np.diff(rr)
            assert np.allclose([r.rmssd, r.sdnn, r.pnn50], [np.sqrt((d**2).mean()), rr.std(ddof=1), (abs(d) > 50).mean()], atol=1e-6)


@pytest.mark.parametrize("segment", [None, 8])
def test_spectra_of_one_length_are_made_together(spark, segment):
    rng = np.random.default_rng(9)
    rows = [(g, i, None if i == 3 and g % 2 else float(rng.normal())) for g in range(30) for i in range(int(rng.integers(0, 24)))]
    df = spark.createDataFrame(rows, "g int, i int, v double").repartition(5)
    out = X.spectrum(df, ["g"], "i", "v", 100.0, segment)
    assert "InPandas" not in plan(out)
    got = {}
    for r in out.collect():
        got.setdefault(r.g, []).append((r.frequency, r.power))
    want = {}
    for g in range(30):
        x = np.array([v for k, _, v in rows if k == g and v is not None])
        if len(x) >= 4:
            n = min(len(x), segment or len(x))
            h = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
            parts = [x[i : i + n] for i in range(0, len(x) - n + 1, max(1, n - n // 2))]
            p = np.mean([abs(np.fft.rfft((y - y.mean()) * h)) ** 2 for y in parts], axis=0) / (100 * (h**2).sum())
            p[1 : -1 if n % 2 == 0 else None] *= 2
            want[g] = list(zip(np.fft.rfftfreq(n, 0.01), p, strict=True))
    assert got.keys() == want.keys() and all(np.allclose(sorted(got[g]), want[g], atol=1e-12) for g in want)


def test_manifest_is_made_in_as_many_tasks_as_its_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(B, "MADE", 500)
    out = B.lopo_manifest(spark.createDataFrame([(k,) for k in range(10, 80)], "k long"), "k")
    assert out.rdd.getNumPartitions() == 10
    got = sorted(map(tuple, out.collect()))
    assert got == [(f, k, "test" if k - 10 == f else "validation" if k - 10 == (f + 1) % 70 else "train") for f in range(70) for k in range(10, 80)]


def test_manifest_is_small_on_disk(spark, tmp_path):
    """Runs and repetitions, under a quarter of a byte a row where the numbers of the folds alone would be over one."""
    out = B.lopo_manifest(spark.range(1500), "id")
    out.write.parquet(str(tmp_path / "m"))
    assert sum(p.stat().st_size for p in (tmp_path / "m").glob("*.parquet")) < 1500 * 1500 / 4
    got = spark.read.parquet(str(tmp_path / "m"))
    assert got.count() == got.distinct().count() == 1500 * 1500 and [r.n for r in got.groupBy("role").agg(F.count("*").alias("n")).orderBy("n", "role").collect()] == [1500, 1500, 1500 * 1498]
    assert got.filter("(role = 'test') <> (id = fold_index) or (role = 'validation') <> (id = (fold_index + 1) % 1500)").count() == 0


def test_best_of_a_block_are_those_of_a_full_sort():
    rng = np.random.default_rng(1)
    for k, wide in ((5, 300), (5, 3), (5, 5), (1, 40)):
        c = np.round(rng.normal(size=(50, wide)), 1)
        c[rng.random(c.shape) < 0.3] = -np.inf
        c[0] = -np.inf
        place = rng.permutation(wide)
        want = [(i, j) for i in range(50) for j in [x for x in np.lexsort((place, -c[i])) if c[i, x] > -np.inf][:k]]
        row, at = L._best(c, place, k)
        assert list(zip(row.tolist(), at.tolist(), strict=True)) == [(i, int(j)) for i, j in want]


def test_index_finds_the_same_whatever_stands_on_a_shelf(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, i % 5, i % 3, rng.normal(size=8).tolist()) for i in range(600)], "k int, s int, l int, v array<double>")
    found = lambda: {(r.q, r.k) for r in L.nearest_indexed(df, "k", "s", "l", "v", 3, 0.3, block=100).collect()}
    one = found()
    sizes = []
    monkeypatch.setattr(L, "SHELF", 150)
    monkeypatch.setattr(L, "_packed", lambda rows, *keys, more=(), f=L._packed: sizes.append(rows.count()) or f(rows, *keys, more=more))
    assert found() == one and len(one) == 1800
    assert sizes[0] == 600 and sizes[1] <= 600 * 7  # once a shelf, where 0.3 of 24 cells are 8


def test_rows_held_against_many_folds_are_few(monkeypatch):
    from tessera.operators import folds as H

    monkeypatch.setattr(H, "HELD", 1000)
    b = pa.RecordBatch.from_arrays([pa.array([[i % 300] for i in range(50)]), pa.array([1.0] * 50), pa.array([[float(i)] for i in range(50)])], ["c", "y", "x"])
    parts = list(H._Rows(np.arange(300)[:, None], 1).slices(iter([b])))
    assert max(t.size for t, _, _ in parts) <= 1000 and np.concatenate([a[:, 1] for _, _, a in parts]).tolist() == list(range(50))


def test_anchors_of_folds_are_summed_once(spark):
    rng = np.random.default_rng(6)
    rows = [(i % 3, i % 4, float(a), float(b)) for i, (a, b) in enumerate(rng.random((120, 2)))]
    df = L.assemble(spark.createDataFrame(rows, "fold int, c int, a double, y double"), ["a"])
    out = L.residual_regressor(df, "fold", "c", "y", "elastic_net")
    assert plan(out).count("InMemoryTableScan") == 3 and out.count() == 120


def test_silences_of_many_sources_take_no_python(spark, sf_dir, tmp_path, monkeypatch):
    """Over several batches as ``silences`` reports them, with a source whose rows come in the last batch though they are the oldest."""
    from tessera.streaming import sessions as Z

    rows = [[(1, "head", 0), (1, "eye", 0), (4, None, 0)], [(1, "head", 2), (2, "head", 300), (2, "head", None)], [(1, "head", 360), (2, "head", 361), (3, "eye", 10), (3, "eye", 11), (3, "eye", 40), (1, "eye", 0), (1, "eye", 3)]]
    for i, part in enumerate(rows):
        df = spark.createDataFrame(part, "session long, source string, s long").select("session", "source", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    out = Z.silences_to_table(src, 3_000, 1_000, str(tmp_path)).collect()
    got = sorted((r.session, r.source or "", r.kind, r["at"] // 1000) for r in out)
    by_head = [(1, "head", "back", 360), (1, "head", "silent", 5), (2, "head", "back", 361), (2, "head", "silent", 303)]
    assert got == sorted([(1, "eye", "silent", 3), *by_head, (3, "eye", "back", 40), (3, "eye", "silent", 14), (3, "eye", "silent", 43), (4, "", "silent", 3)])
    monkeypatch.setattr(Z, "silences", None)
    assert QUERIES["stream_source_timeout"](spark, sf_dir).count() > 0


def test_rows_in_turn_share_equal_structs_and_lose_no_value():
    from tessera.streaming import sessions as Z

    kind = pa.struct([("a", pa.float64()), ("s", pa.string())])
    rows = [{"a": 1.0, "s": "x"}, {"a": 1.0, "s": "x"}, None, {"a": None, "s": "x"}, {"a": 2.0, "s": None}, {"a": 2.0, "s": None}]
    got = Z._values(pa.array(rows, kind))
    assert got == rows and got[0] is got[1] and got[4] is got[5]
    assert Z._values(pa.array(rows, kind)[3:]) == rows[3:]
    assert Z._values(pa.array([1.5, float("nan"), None])) == [1.5, None, None] and Z._values(pa.array([1.5, float("nan")])) == [1.5, None]
    assert Z._values(pa.array([[1.0, float("nan")], None])) == [[1.0, None], None] and Z._values(pa.array([True, None])) == [True, None]
    assert Z._values(pa.array([3, 4])) == [3, 4] and Z._values(pa.array([3, None])) == [3, None]
    assert [Z._median(x) for x in ([3.0], [3.0, 1.0], [3.0, 1.0, 2.0])] == [3.0, 2.0, 2.0]


def test_no_row_of_a_stream_carries_a_nested_state(spark):
    from tessera.streaming import sessions as Z

    rows = spark.createDataFrame([(1, i, i % 9, 10 * i, None, 0) for i in range(6)], "session long, ms long, target long, v int, was string, was_first int").selectExpr("*", "v > 20 applied")
    out = Z._through(rows, Z.Memory(), states=True)
    assert not [f.name for f in out.schema if f.dataType.typeName() in ("struct", "map", "array")]
    (end,) = out.filter("now is not null").select("last_ms", "now").collect()
    more = rows.select("session", (rows.ms + 6).alias("ms"), "target", "applied", "was", F.lit(1).alias("was_first"))
    known = spark.createDataFrame([(1, end.now, 0)], "session long, was string, was_first int")
    whole = Z._through(rows.unionByName(more.withColumn("v", F.lit(0))), Z.Memory(), states=True)
    onward = Z._through(more.unionByName(known, allowMissingColumns=True), Z.Memory(), states=True)
    seen = lambda df, least: sorted(map(tuple, df.filter(f"at >= {least} or now is not null").collect()), key=str)
    assert end.last_ms == 5 and seen(onward, 6) == seen(whole, 6)
