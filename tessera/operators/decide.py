"""Row-wise decisions and table contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import ramp

# Weights and limits of the control policy.
RELAXATION_WEIGHT, DISCOMFORT_WEIGHT = 0.85, -0.15
EXTREME, SAFETY, HYSTERESIS = 0.95, 0.50, 0.002
SWITCH, FORCED_AFTER = (0.10, 0.45, 0.85), 3
BOREDOM, AROUSAL, DISCOMFORT, CALM = 0.25, 0.20, 0.30, 0.15
SAFE, HIGH_LOAD, HIGH_LOAD_PENALTY, RECENT_PENALTY = (1, 2, 4, 5), (9,), 0.10, 0.12
TEMPERATURE, FLOOR = 0.18, 0.08
CALM_DWELL, CALM_STEP, CALM_MOST = 3, 0.025, 0.12
STEP_REASONS = {"stable_probe": "stable_probe", "calm_exploration": "calm_exploration", "stress_recovery": "stress_recovery_step"}
MODALITIES = ("eeg", "ecg", "head", "eye")
WINDOW_MS = 10_000


def variant(coverage: dict[str, Column], least: float = 0.5) -> tuple[Column, Column]:
    """(model variant, missing modalities): full needs EEG; no_eeg ECG, head and eye; behavior_only head or eye."""
    there = {m: F.coalesce(coverage[m], F.lit(0.0)) >= least for m in MODALITIES}
    missing = F.array_compact(F.array(*[F.when(~there[m], m) for m in MODALITIES]))
    v = F.when(there["eeg"], "full").when(there["ecg"] & there["head"] & there["eye"], "no_eeg").when(there["head"] | there["eye"], "behavior_only")
    return v, missing


def recommend(state: DataFrame, key: str, candidates: DataFrame, widths: float, limit: float, least_gain: float, coverage: float) -> DataFrame:
    """One row per state: the safe neighbour with the greatest conservative gain, or a hold with its reasons.

    ``state``: key, condition, relaxation, relaxation_high, width, coverage, deployable. ``candidates``: key, candidate,
    relaxation, relaxation_half, discomfort, discomfort_half. Any hold reason stops; uncertain and unsafe
    candidates are passed over; ties go to the greater gain, then to the greater name.
    """
    c = candidates.select(key, "candidate", *[F.col(x).alias(f"c_{x}") for x in ("relaxation", "relaxation_half", "discomfort", "discomfort_half")])
    j = state.join(c, key, "left")
    uncertain = F.greatest("c_relaxation_half", "c_discomfort_half") * 2 > widths
    high = F.least(F.lit(1.0), F.col("c_discomfort") + F.col("c_discomfort_half"))
    ok = ~uncertain & (high < limit)
    gain = F.greatest(F.lit(0.0), F.col("c_relaxation") - F.col("c_relaxation_half")) - F.col("relaxation_high")
    best = F.max(F.when(ok, F.struct(gain.alias("conservative"), (F.col("c_relaxation") - F.col("relaxation")).alias("gain"), F.col("candidate"), high.alias("discomfort"))))
    g = j.groupBy(*state.columns).agg(best.alias("_b"), F.count_if(uncertain).alias("_u"))
    hold = F.array_compact(F.array(F.when(~F.col("deployable"), "state_model_not_better_than_baselines"), F.when(F.coalesce(F.col("coverage"), F.lit(0.0)) < coverage, "insufficient_modality_coverage"), F.when(F.col("width") > widths, "state_uncertainty_too_high")))
    none = F.when(F.col("_u") > 0, "candidate_uncertainty_too_high").otherwise("no_safe_candidate")
    stay = (F.col("_b.candidate") == F.col("condition")) | (F.col("_b.conservative") < least_gain)
    reasons = F.when(F.size(hold) > 0, hold).when(F.col("_b").isNull(), F.array(none)).when(stay, F.array(F.lit("no_positive_conservative_gain"))).otherwise(F.array(F.lit("highest_safe_conservative_relaxation_gain")))
    act = (F.size(hold) == 0) & F.col("_b").isNotNull() & ~stay
    return g.select(key, F.when(act, "recommend").otherwise("hold").alias("action"), F.when(act, F.col("_b.candidate")).alias("candidate"), F.when(act, F.col("_b.conservative")).alias("conservative_gain"), reasons.alias("reasons"))


def utility(relaxation: Column, discomfort: Column, recent: Column | None = None, recent_penalty: float = 0.0, high_load: Column | None = None, load_penalty: float = 0.0, adjustment: Column | None = None) -> Column:
    """Weighted utility less a penalty for each recent visit and for high load, plus a sensor adjustment."""
    u = RELAXATION_WEIGHT * relaxation + DISCOMFORT_WEIGHT * discomfort
    u = u - recent * recent_penalty if recent is not None else u
    u = u - F.when(high_load, load_penalty).otherwise(0.0) if high_load is not None else u
    return u + adjustment if adjustment is not None else u


def reactive_estimate(relaxation: Column, discomfort: Column, load_change: Column) -> tuple[Column, Column, Column]:
    """(mode, relaxation, discomfort) expected of a candidate from the change of load alone."""
    stress = (discomfort >= 0.50) | (relaxation <= 0.35)
    calm = (relaxation >= 0.55) & (discomfort <= 0.40)
    steady = (relaxation >= 0.45) & (discomfort <= 0.50)
    mode = F.when(stress, "stress_recovery").when(calm, "calm_exploration").when(steady, "stable_probe").otherwise("conservative_stay")
    want = F.when(stress, -load_change).when(calm, load_change).when(steady, F.when(load_change >= 0, 0.35 * load_change).otherwise(0.10 * load_change)).otherwise(-F.abs(load_change))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return mode, unit(relaxation + 0.10 * want), unit(discomfort - 0.08 * want)


def switch_probability(relaxation: Column, discomfort: Column, dwell: Column, arousal: Column, boredom: Column) -> tuple[Column, Column]:
    """(probability of leaving a condition, whether it is forced) by the windows shown and the sensors' state."""
    shown = F.greatest(F.lit(1), dwell + 1)
    base = F.get(F.array(*[F.lit(x) for x in SWITCH]), (F.least(shown, F.lit(len(SWITCH))) - 1).cast("int"))
    calm = (relaxation >= 0.55) & (discomfort <= 0.40)
    quiet = F.when(calm, F.least(ramp(arousal, 0.20, 0.60, True), ramp(boredom, 0.20, 0.65, True))).otherwise(0.0)
    p = base + BOREDOM * boredom + AROUSAL * arousal + DISCOMFORT * ramp(discomfort, 0.25, SAFETY) - CALM * quiet
    forced = shown >= FORCED_AFTER
    return F.when(forced, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))), forced


def weighted_pick(options: Column, draw: Column) -> Column:
    """The ``candidate`` of one of the structs (candidate, score) by weights that fall with the distance from the best
    score; NULL where there is none. ``draw`` is uniform."""
    best = F.array_max(F.transform(options, lambda x: x["score"]))
    weight = lambda x: FLOOR + F.exp(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), (x["score"] - best) / TEMPERATURE)))
    total = F.aggregate(options, F.lit(0.0), lambda s, x: s + weight(x))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("pick"))
    step = lambda s, x: F.struct((s["sum"] + weight(x)).alias("sum"), F.coalesce(s["pick"], F.when(s["sum"] + weight(x) >= draw * total, x["candidate"])).alias("pick"))
    found = F.aggregate(options, start, step)
    return F.coalesce(found["pick"], F.get(options, F.size(options) - 1)["candidate"])


def calm_penalty(relaxation: Column, discomfort: Column, dwell: Column) -> Column:
    """What a calm condition loses for each window from the CALM_DWELL-th on, so that a neighbour comes to top it."""
    calm = (relaxation >= 0.55) & (discomfort <= 0.40) & (dwell >= CALM_DWELL)
    return F.when(calm, F.least(F.lit(CALM_MOST), (dwell - CALM_DWELL + 1) * CALM_STEP)).otherwise(0.0)


def control_step(state: DataFrame, key: str, candidates: DataFrame, min_dwell: int = 0, mode: str = "probability", max_dwell: int = 2, adjacent: bool = False) -> DataFrame:
    """(key, action, target, reason, delta): one control decision for each state.

    ``state``: key, condition (grid number), relaxation, discomfort, dwell, arousal, boredom, switch_draw and pick_draw
    (uniform). ``candidates``: key, candidate, relaxation, discomfort, cooldown, recent; at most the nine of the grid.
    In turn: extreme discomfort is a failsafe; high discomfort leaves for the safety pool; then the chance to switch
    explores any condition that is not cooling; else a neighbour of better utility, by more than the hysteresis.

    ``mode`` names how it explores: "probability" by the chance to switch; "dwell" from ``max_dwell`` windows on, or CALM_DWELL of a calm
    state, while calm and steady states otherwise wait; "utility" not at all, but a calm state's own utility loses ``calm_penalty``.
    With ``adjacent``, only neighbours are explored. Where ``candidates`` have a ``mode``, a step in utility is named by it.
    """
    if mode not in ("probability", "dwell", "utility"):
        raise ValueError(f"no mode {mode}")
    i, f = (lambda c: F.floor((c - 1) / 3)), (lambda c: (c - 1) % 3)
    score = utility(F.col("relaxation"), F.col("discomfort"))
    chosen = score - F.col("recent") * RECENT_PENALTY - F.when(F.col("candidate").isin(*HIGH_LOAD), HIGH_LOAD_PENALTY).otherwise(0.0)
    one = F.struct(F.col("candidate").cast("int").alias("candidate"), chosen.alias("score"), score.alias("plain"), (F.col("cooldown") <= 0).alias("free"), (F.col("mode") if "mode" in candidates.columns else F.lit(None).cast("string")).alias("mode"))
    pool = candidates.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("_all"))
    # as many rows as states, and much larger than the planner takes arrays for: never to be broadcast
    s = state.join(pool.hint("merge"), key, "left").withColumn("_all", F.filter(F.coalesce("_all", F.array().cast(pool.schema["_all"].dataType)), lambda x: x["candidate"] != F.col("condition")))
    now, tense, calm_value = F.col("condition"), F.col("discomfort"), F.col("relaxation")
    near = lambda x: F.abs(i(x["candidate"]) - i(now)) + F.abs(f(x["candidate"]) - f(now)) == 1
    safe = F.filter("_all", lambda x: x["candidate"].isin(*SAFE) & x["free"])
    free = F.filter("_all", lambda x: x["free"] & near(x) if adjacent else x["free"])
    p, forced = switch_probability(calm_value, tense, F.col("dwell"), F.col("arousal"), F.col("boredom"))
    best = F.array_max(F.transform(F.filter("_all", near), lambda x: F.struct(x["plain"].alias("score"), x["candidate"].alias("candidate"), x["mode"].alias("mode"))))
    s = s.withColumns({"_own": utility(calm_value, tense), "_p": p, "_forced": forced, "_safe": weighted_pick(safe, F.col("pick_draw")), "_free": weighted_pick(free, F.col("pick_draw")), "_best": best})
    calm = (calm_value >= 0.55) & (tense <= 0.40)
    steady = calm | ((calm_value >= 0.45) & (tense <= SAFETY))
    ready = F.col("_forced") | steady | (F.col("arousal") >= 0.35) | (F.col("boredom") >= 0.35)
    go = ready & (F.when(F.col("_forced"), 0.0).otherwise(F.col("switch_draw")) <= F.col("_p"))
    penalty = calm_penalty(calm_value, tense, F.col("dwell")) if mode == "utility" else F.lit(0.0)
    gain = F.col("_best.score") - (F.col("_own") - penalty)
    better = F.coalesce((gain > 0) & (gain >= HYSTERESIS), F.lit(False))
    named = F.coalesce(*[F.when(F.col("_best.mode") == k, v) for k, v in STEP_REASONS.items()], F.lit("adaptive_utility_step"))
    step = F.when((penalty > 0) & (F.col("_best.score") <= F.col("_own")), "calm_dwell_exploration").otherwise(named)
    long = (F.col("dwell") >= max_dwell) & (tense < SAFETY) if max_dwell > 0 else F.lit(False)
    explore = {
        "probability": [
            (go & F.col("_free").isNotNull(), "apply", F.col("_free"), F.when(F.col("_forced"), "sensor_probability_force_exploration").otherwise("sensor_probability_exploration")),
            (go, "hold", None, F.lit("sensor_probability_no_available_condition")),
            (ready, "hold", None, F.lit("sensor_probability_hold")),
        ],
        "dwell": [
            ((long | calm & (F.col("dwell") >= CALM_DWELL)) & F.col("_free").isNotNull(), "apply", F.col("_free"), F.when(long, "stochastic_max_dwell_exploration").otherwise("stochastic_calm_exploration")),
            (steady, "hold", None, F.when(calm, "calm_wait_for_stochastic_exploration").otherwise("steady_wait_for_stochastic_exploration")),
        ],
        "utility": [],
    }[mode]
    cases = [
        (tense >= EXTREME, "failsafe", None, F.lit("extreme_predicted_discomfort")),
        ((tense >= SAFETY) & now.isin(*SAFE) & (F.col("dwell") < min_dwell), "hold", None, F.lit("safety_min_condition_dwell")),
        ((tense >= SAFETY) & F.col("_safe").isNotNull(), "apply", F.col("_safe"), F.lit("safety_recovery_stochastic")),
        (tense >= SAFETY, "hold", None, F.lit("safety_no_available_condition")),
        *explore,
        (better, "apply", F.col("_best.candidate"), step),
    ]
    action, target, reason = F.lit("hold"), now, F.when(penalty > 0, "dwell_exploration_no_better_neighbor").otherwise("stable_no_better_neighbor")
    for when, a, to, why in reversed(cases):
        action, reason = F.when(when, a).otherwise(action), F.when(when, why).otherwise(reason)
        target = F.when(when, to if to is not None else now).otherwise(target)
    return s.select(key, action.alias("action"), target.cast("int").alias("target"), reason.alias("reason"), F.when(reason.isin("adaptive_utility_step", *STEP_REASONS.values(), "calm_dwell_exploration", "dwell_exploration_no_better_neighbor", "stable_no_better_neighbor"), F.greatest(gain, F.lit(0.0))).alias("delta"))


def message_violations(start: Column, end: Column, shadow: Column, action: Column, participant: Column) -> Column:
    """Names of what is wrong with a message; empty if nothing."""
    return F.array_compact(
        F.array(
            F.when(participant.isNull(), "participant_missing"),
            F.when(~F.coalesce(end - start == WINDOW_MS, F.lit(False)), "length"),
            F.when(~F.coalesce(shadow, F.lit(False)), "not_shadow"),
            F.when(~F.coalesce(action.isin("hold", "recommend"), F.lit(False)), "action"),
        )
    )


def prediction_problems(expected: DataFrame, found: DataFrame, keys: list[str], truth: str, pred: str, tolerance: float = 1e-9, meta: list[str] = ()) -> DataFrame:
    """(keys, problem): missing and extra keys, other truths, predictions that are missing or outside 0..1, then the first of the
    ``meta`` columns (fold, validation member, seed, variant) in which the two tables differ."""
    from tessera.operators.joins import reconcile

    f = found.select(*keys, F.col(truth).alias("_t"), F.col(pred).alias("_p"), *[F.col(m).alias(f"_m_{m}") for m in meta])
    j = reconcile(expected.select(*keys, truth, *meta), f, keys)
    both = F.col("side") == "both"
    problem = (
        F.when(F.col("side") == "left", "missing")
        .when(F.col("side") == "right", "extra")
        .when(both & ~F.coalesce(F.abs(F.col(truth) - F.col("_t")) <= tolerance, F.lit(False)), "truth_differs")
        .when(both & (F.col("_p").isNull() | F.isnan("_p")), "not_finite")
        .when(both & ~F.col("_p").between(0, 1), "out_of_range")
    )
    for m in meta:
        problem = problem.when(both & ~F.col(m).eqNullSafe(F.col(f"_m_{m}")), f"{m}_differs")
    return j.select(*keys, problem.alias("problem")).filter("problem is not null")


def metric_differences(saved: DataFrame, computed: DataFrame, keys: list[str], metric: str, tolerance: float) -> DataFrame:
    c = computed.select(*keys, F.col(metric).alias("computed"))
    return saved.select(*keys, F.col(metric).alias("saved")).join(c, keys, "full_outer").filter(~F.coalesce(F.abs(F.col("saved") - F.col("computed")) <= tolerance, F.lit(False)))


def estimate_problems(table: DataFrame) -> DataFrame:
    """The rows of an estimate table that break its contract, with ``violations``: a value, interval bound or inference unit
    that is missing, windows as the unit, and an interval that does not hold its estimate. A column that the table
    lacks is missing in every row."""
    names = ("estimate", "ci_low", "ci_high", "inference_unit")
    full = table.withColumns({c: F.lit(None).cast("string" if c == "inference_unit" else "double") for c in names if c not in table.columns})
    off = (F.col("ci_low") > F.col("estimate")) | (F.col("ci_high") < F.col("estimate"))
    found = [*[F.when(F.col(c).isNull(), c) for c in names], F.when(F.col("inference_unit") == "window", "window_as_unit"), F.when(off, "interval_off_estimate")]
    return full.withColumn("violations", F.array_compact(F.array(*found))).filter(F.size("violations") > 0)
