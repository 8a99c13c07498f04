"""Hand-computed cases, and brute force for what SQL doesn't express."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import features as X
from tessera.operators import joins as J
from tessera.operators import metrics as M
from tessera.operators import models as L
from tessera.operators import rank as R
from tessera.operators import resample as B
from tessera.operators import segments as G
from tessera.sources import tables as T
from tessera.streaming import sessions as Z


def test_boundary_gives_seven_windows_whose_weights_sum_to_one(spark):
    b = spark.createDataFrame([("P003", "C1", 1_000_000, 1_071_900)], "p string, c string, s long, e long")
    w = G.tumbling(b, "s", "e", 10_000).collect()
    assert len(w) == 7 and abs(sum(r.sample_weight for r in w) - 1) < 1e-12 and w[0].window_start == 1_000_000
    assert G.tumbling(b.withColumn("e", F.col("s") + 5), "s", "e", 10_000).count() == 0


def test_condition_summary_of_three_windows(spark):
    w = spark.createDataFrame([("P002", "C1", 0, 1.0, 0.5), ("P002", "C1", 1, None, 0.5), ("P002", "C1", 2, 5.0, 0.5)], "p string, c string, i int, v double, label double")
    r = X.condition_summary(w, ["p", "c"], "i", ["v"], ["label"]).first()
    assert (r.v__mean, r.v__min, r.v__max, r.v__first, r.v__last, r.window_count) == (3, 1, 5, 1, 5, 3)
    assert abs(r.v__missing_ratio - 1 / 3) < 1e-12 and r.v__slope == 2 and not r.label_conflict
    nan = X.condition_summary(w.withColumn("v", F.lit(float("nan"))), ["p"], "i", ["v"]).first()
    assert nan.v__mean is None and nan.v__missing_ratio == 1


def test_dialect_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sep=,\nx,y\n1,2.5\n")
    (tmp_path / "b.csv").write_text("x;y\nk;1,78057E+12\nl;33.615.214\n")
    assert [tuple(r) for r in T.read_dialect_csv(spark, str(tmp_path / "a.csv"), ["y"]).collect()] == [("1", 2.5)]
    assert [r.y for r in T.read_dialect_csv(spark, str(tmp_path / "b.csv"), ["y"]).collect()] == [1.78057e12, 33.615214]


def test_dialects_by_file_with_spaces_quotes_and_repeated_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('sep=;\nUnix Time;"y; 1";Note\n1,5;2,5;"a ""b"" ; c"\nUnix Time;y; 1\n\n')
    (tmp_path / "b.csv").write_text('"Unix Time","y; 1",Other\n3.5,4.5,z\n')
    got = T.read_dialect_csv(spark, str(tmp_path), ["Unix Time"])
    rows = {tuple(r[c] for c in ("Unix Time", "y; 1", "Note", "Other")) for r in got.collect()}
    assert rows == {(1.5, "2,5", 'a "b" ; c', None), (None, "y", " 1", None), (3.5, "4.5", None, "z")}
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("")
    assert T.read_dialect_csv(spark, str(tmp_path / "empty"), ["y"]).count() == 0


def test_identifiers(spark):
    df = spark.createDataFrame([("p3", "c05"), ("N 003", "C9"), ("x", "c0")], "p string, c string")
    assert [tuple(r) for r in df.select(S.normalize_participant(F.col("p")), S.normalize_condition(F.col("c"))).collect()] == [("P003", "C5"), ("P003", "C9"), (None, None)]


def test_gaze_projection_and_grid(spark):
    one, zero = F.lit(1.0), F.lit(0.0)
    px, py = S.project_gaze((zero, zero, one), (zero, zero, one), (zero, one, zero), 1280, 720, 90.0)
    right, _ = S.project_gaze((F.lit(0.2), zero, one), (zero, zero, one), (zero, one, zero), 1280, 720, 90.0)
    r = spark.range(1).select(px.alias("x"), py.alias("y"), right.alias("r")).first()
    assert abs(r.x - 640) < 1e-9 and abs(r.y - 360) < 1e-9 and r.r > 640
    n = J.grid_neighbours(spark).groupBy("number").agg(F.sort_array(F.collect_list("neighbour")).alias("n")).collect()
    got = {x.number: x.n for x in n}
    assert got[5] == [2, 4, 5, 6, 8] and got[1] == [1, 2, 4]


def test_uniform_frames_takes_each_frame_once(spark):
    frames = spark.createDataFrame([("a", t, i) for i, t in enumerate([0, 1, 2, 50, 98, 99])] + [("b", 5, 9)], "k string, t long, f int")
    w = spark.createDataFrame([("a", 0, 100), ("b", 0, 100)], "k string, s long, e long")
    got = G.uniform_frames(frames, w, ["k"], "t", "f", "s", "e", 3).collect()
    assert sorted((r.k, r.f) for r in got) == [("a", 2), ("a", 3), ("a", 4)]


def test_peak_matching(spark):
    ref = spark.createDataFrame([("s", float(t)) for t in range(1, 10)], "k string, t double")
    f1 = lambda d: M.peak_f1(ref, ref.withColumn("t", F.col("t") + d), ["k"], "t", 0.1).first().f1
    assert f1(0.05) == 1.0 and f1(0.2) == 0.0


def test_spectrum_finds_the_tone(spark):
    rows = [("w", i, math.sin(2 * math.pi * 10 * i / 500)) for i in range(1000)]
    s = X.spectrum(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], "t", "v", 500.0)
    assert s.orderBy(F.desc("power")).first().frequency == 10.0
    b = X.band_power(s, ["k"]).first()
    assert b.alpha_share > 0.95 and abs(b.total_power - 0.5) < 0.02


def test_order_pairs_each_end_once(spark):
    e = spark.createDataFrame([("s", "end", 1), ("s", "start", 2), ("s", "start", 3), ("s", "end", 5), ("s", "end", 7), ("s", "end", 8), ("s", "start", 9)], "k string, kind string, t int")
    got = sorted((r.start, r.end) for r in J.pair_by_order(e, ["k"], "kind", "t").collect())
    assert got == [(2, 5), (3, 7)]


def test_asof_is_the_same_with_and_without_buckets(spark):
    rng = np.random.default_rng(1)
    left = spark.createDataFrame([(int(k), int(t)) for k, t in zip(rng.integers(0, 4, 300), rng.integers(0, 1000, 300), strict=True)], "k int, t long")
    right = spark.createDataFrame([(int(k), int(t), float(t)) for k, t in {(k, t) for k, t in zip(rng.integers(0, 3, 60).tolist(), rng.integers(0, 1000, 60).tolist(), strict=True)}], "k int, u long, v double")
    for forward in (False, True):
        a = sorted(map(str, J.asof(left, right, ["k"], "t", "u", ["v"], forward).collect()))
        b = sorted(map(str, J.asof(left, right, ["k"], "t", "u", ["v"], forward, bucket=50).collect()))
        assert a == b and len(a) == 300


def test_one_to_one_rejects_repeats(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        J.join_one_to_one(a, a, ["k"])


def test_folds_and_pareto(spark):
    m = B.lopo_manifest(spark.createDataFrame([("P002",), ("P003",), ("P004",), ("P005",)], "p string"), "p").collect()
    assert {(r.p, r.role) for r in m if r.fold_index == 0} == {("P002", "test"), ("P003", "validation"), ("P004", "train"), ("P005", "train")}
    d = spark.createDataFrame([(1, 5, 5), (2, 5, 4), (3, 6, 9), (4, 4, 4), (5, 6, 9)], "k int, a int, b int")
    assert {r.k for r in R.pareto(d, "k", "a", "b").collect()} == {2, 3, 5}


def test_linear_models_leave_the_group_out(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(x), float(z), float(1 + 2 * x - z + 0.01 * rng.normal())) for g, x, z in zip(rng.integers(0, 5, 200), rng.normal(size=200), rng.normal(size=200), strict=True)]
    df, f = spark.createDataFrame(rows, "g int, x double, z double, y double"), [F.col("x"), F.col("z")]
    got = {r.g: r.coefficients for r in L.lopo_linear(df, "g", f, F.col("y")).collect()}
    for g in range(5):
        own = np.array([r for r in rows if r[0] != g])
        want = np.linalg.lstsq(np.column_stack([np.ones(len(own)), own[:, 1:3]]), own[:, 3], rcond=None)[0]
        assert np.allclose(got[g], want, atol=1e-8)
    poisoned = df.withColumn("y", F.when(F.col("g") == 3, F.lit(1e6)).otherwise(F.col("y")))
    assert np.allclose({r.g: r.coefficients for r in L.lopo_linear(poisoned, "g", f, F.col("y")).collect()}[3], got[3])


def test_fusion_and_pca(spark):
    rng = np.random.default_rng(3)
    t = rng.random(300)
    df = spark.createDataFrame([(float(x), float(x + 0.1 * e), float(r)) for x, e, r in zip(t, rng.normal(size=300), rng.random(300), strict=True)], "t double, a double, b double")
    w = L.late_fusion(df, ["a", "b"], "t", 0.05)
    assert abs(sum(w) - 1) < 1e-9 and w[0] > 0.8 and w[1] >= 0.05 - 1e-12
    v = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    vectors = spark.createDataFrame([(x.tolist(),) for x in v], "v array<double>")
    mean, c = L.covariance(vectors, "v", 4)
    assert np.allclose(mean, v.mean(axis=0)) and np.allclose(c, np.cov(v.T, bias=True))
    assert abs(L.linear_cka(spark.createDataFrame([(np.concatenate((x, 2 * x)).tolist(),) for x in v], "v array<double>"), "v", 4, 8) - 1) < 1e-9


def test_condition_windows_reset_and_reject_late_rows():
    m = Z.Windows(10_000)
    s = m.begin()
    assert list(m.feed(s, 12_345, "C1", 1.0)) == [] and list(m.feed(s, 22_344, "C1", 1.0)) == []
    (w,) = m.feed(s, 22_345, "C1", 1.0)
    assert w[:4] == ("window", 0, 12_345, 22_345) and w[5] == 2
    (late,) = m.feed(s, 20_000, "C2", 1.0)
    assert late[0] == "late"
    (gone,) = m.feed(s, 30_000, "C2", 1.0)
    assert gone[:6] == ("evict", 1, 22_345, 30_000, "C1", 1)
    (w,) = m.feed(s, 40_000, "C2", 1.0)
    assert w[:5] == ("window", 0, 30_000, 40_000, "C2") and w[-1] == 49_500


def test_second_session_is_refused_until_the_first_ends():
    m = Z.Sessions()
    s = m.begin()
    said = [m_[0] for ms, name, stop in [(1, "a", False), (2, "a", False), (3, "b", False), (4, None, True), (5, "b", False), (6, "a", False), (7, None, True), (8, None, True)] for m_ in m.feed(s, ms, name, stop)]
    assert said == ["begin", "refused", "end", "begin", "refused", "end"]


def test_low_coverage_locks_the_failsafe_and_a_headset_off_holds():
    m = Z.Coverage()
    s = m.begin()
    good, low = [0.9, 0.9, 0.0, None], [0.9, 0.4, None, 0.0]
    states = [next(m.feed(s, i, c, worn))[1:4] for i, (c, worn) in enumerate([(good, True), (low, True), (low, None), (low, False), (low, True), (low, True), (good, True), (low, True), (low, True), (low, True), (good, True)])]
    assert [x[0] for x in states] == ["Running", "Degraded", "Degraded", "Degraded", "Degraded", "Degraded", "Running", "Degraded", "Degraded", "Failsafe", "Failsafe"]
    assert states[3][2] == "headset_not_worn" and states[-2][2] == "low_modality_coverage_timeout" and states[-1][2] == "failsafe_locked"


def test_silence_is_reported_by_timer_over_several_batches(spark, tmp_path):
    day = "2024-01-01 00:"
    batches = [[(1, "head", "00:00"), (1, "eye", "00:00")], [(1, "head", "00:02"), (2, "head", "05:00")], [(1, "head", "06:00"), (2, "head", "06:01")]]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "session long, source string, t string").select("session", "source", F.to_timestamp(F.concat(F.lit(day), "t")).alias("ts"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    out = Z.run_to_table(Z.silences(src, 3_000, "1 second"), str(tmp_path)).collect()
    start = 1_704_067_200_000
    got = sorted((r.session, r.source, r.kind, (r["at"] - start) // 1000) for r in out)
    assert got == [(1, "eye", "silent", 3), (1, "head", "back", 360), (1, "head", "silent", 5), (2, "head", "back", 361), (2, "head", "silent", 303)]


def controller_rows(spark, sf_dir):
    from tessera.plans.stream_queries import persons, predictions

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    return predictions(e, persons(e))


def window_rows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("session"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_type").alias("condition"), "value")


def memory_rows(spark, sf_dir):
    return window_rows(spark, sf_dir).select("session", "ms", (1 + F.floor("value") % 9).alias("target"), (F.col("value") > 20).alias("applied"))


@pytest.mark.parametrize("rows, machine", [(window_rows, Z.Windows(3_600_000)), (controller_rows, Z.Controller(86_400_000)), (memory_rows, Z.Memory())])
def test_stream_and_batch_agree_over_several_batches(spark, sf_dir, tmp_path, rows, machine):
    e = rows(spark, sf_dir)
    cuts = e.approxQuantile("ms", [0.33, 0.66], 0.0)
    parts = [e.filter(F.col("ms") < cuts[0]), e.filter((F.col("ms") >= cuts[0]) & (F.col("ms") < cuts[1])), e.filter(F.col("ms") >= cuts[1])]
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    got = Z.stream(src, machine, str(tmp_path))
    assert got.select("batch").distinct().count() == 3
    want = Z.replay(e, machine)
    assert sorted(map(str, got.drop("batch").collect())) == sorted(map(str, want.collect()))


def test_states_of_sessions_end(spark, tmp_path):
    """A session that falls behind by more than ttl begins anew; one that doesn't goes on, and null times are left out."""
    for i, rows in enumerate([[(1, 0, "a", 1.0), (2, 0, "a", 1.0), (1, None, "z", 9.0)], [(2, 90_000, "a", 1.0)], [(1, 95_000, "a", None), (2, 95_000, "b", 1.0)]]):
        spark.createDataFrame(rows, "session long, ms long, condition string, value double").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    src = lambda: spark.readStream.schema("session long, ms long, condition string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    out = Z.stream(src(), Z.Windows(10_000), str(tmp_path), ttl=50_000).collect()
    count = lambda session, kind: sum(r.session == session and r.kind == kind for r in out)
    assert (count(1, "window"), count(2, "window"), count(2, "evict")) == (0, 9, 1)
    kept = Z.stream(src(), Z.Windows(10_000), str(tmp_path)).collect()
    assert sum(r.session == 1 and r.kind == "window" for r in kept) == 9


def test_personal_numbers_of_the_controller():
    """A higher baseline calls for a probe where the common one does not."""
    rows = [(i * 10_000, 5, 0.55, 0.1, True, None) for i in range(5)]
    act = lambda own: [r[5] for row in rows for r in m.feed(s, *row, own)]
    m = Z.Controller()
    s = m.begin()
    assert "low_relaxation_probe" not in act(None)
    s = m.begin()
    assert "low_relaxation_probe" in act({"baseline": 0.8, "eps_relaxation": None, "eps_discomfort": 0.2})


def controller_session(n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows, shown = [], 5
    for i in range(n):
        if i % 17 == 0:
            shown = int(rng.integers(1, 10))
        rating = {"discomfort": float(rng.random() * 0.7), "relaxation": 0.5, "pleasantness": 0.4, "monotony": float(rng.random()), "fits": True, "direction": "balanced"}
        rows.append((i * 10_000 + 60_000 * (i // 50), shown, float(rng.random()), float(rng.random() * 0.6), i % 50 not in (7, 8, 9), rating))
    return rows


def test_controller_moves_one_step_and_unlocks_nine_by_ratings():
    for seed in range(5):
        m = Z.Controller()
        s, at = m.begin(), 5
        for row in controller_session(seed=seed):
            (r,) = m.feed(s, *row)
            step, ms, before, after, action, reason, *_ = r
            assert before == at and (after == at or after in m.neighbours(at)) and (action == "hold") == (after == before)
            if after == 9 and action != "hold" and "exploration" in reason:
                assert s["intensity_safe"] and s["frequency_safe"] and s["latest"]["discomfort"] < 0.5
            at = after


def test_ratings_act_only_after_their_condition_is_left():
    rows = controller_session()
    decide = lambda data: [r[:11] for row in data for r in m.feed(s, *row)]
    m = Z.Controller()
    s = m.begin()
    want = decide(rows)
    # a condition that is new, and was no risk, is rated otherwise all the time that it is shown
    until = lambda i: next(j for j in range(i + 1, 400) if rows[j][1] != rows[i][1])
    cut = next(i for i in range(10, 300) if rows[i][1] not in {r[1] for r in rows[:i]} and rows[until(i) - 1][5]["discomfort"] < 0.5)
    stay = until(cut)
    other = [(*r[:5], r[5] | {"discomfort": 1.0, "direction": "too_strong"}) if cut <= i < stay else r for i, r in enumerate(rows)]
    s = m.begin()
    got = decide(other)
    assert got[:stay] == want[:stay]
    assert got[stay:] != want[stay:] and got[stay][10] == rows[cut][1]
    revealed = [r[10] for r in want if r[10] is not None]
    assert len(revealed) == len(set(revealed))
