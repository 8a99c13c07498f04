"""Column functions: identifiers, numbers, ratings, geometry, grid positions. All built on JVM-side expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the 3 x 3 grid and of the thresholds that go with it.
INTENSITY = (0.08, 0.16, 0.25)
FREQUENCY = (0.12, 0.26, 0.41)
TRUE_WORDS = ("true", "1", "yes")
FALSE_WORDS = ("false", "0", "no")


def normalize_participant(c: Column, most: int = 999) -> Column:
    """Digits of an identifier as Pnnn; NULL without digits or out of range."""
    n = F.regexp_extract(c.cast("string"), r"(\d+)(?:\.0+)?\s*$", 1)
    n = F.when(n != "", n).try_cast("int")
    return F.when(n.between(1, most), F.concat(F.lit("P"), F.lpad(n.cast("string"), 3, "0")))


def normalize_condition(c: Column) -> Column:
    n = F.regexp_extract(c.cast("string"), r"(\d+)\s*$", 1)
    n = F.when(n != "", n).try_cast("int")
    return F.when(n.between(1, 9), F.concat(F.lit("C"), n.cast("string")))


def normalize_subject(c: Column) -> Column:
    """5.0 or '5' -> 005; other text as it is, trimmed."""
    t = F.trim(c.cast("string"))
    n = t.try_cast("double").try_cast("long")
    return F.when(n.isNotNull(), F.lpad(n.cast("string"), 3, "0")).otherwise(t)


def parse_decimal(c: Column) -> Column:
    """Number text with decimal comma, or with dots that group thousands after the first, to a double."""
    t = F.regexp_replace(F.trim(c), ",", ".")
    parts = F.split(t, r"\.")
    folded = F.concat(F.get(parts, F.lit(0)), F.lit("."), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), ""))
    return F.when(F.size(parts) > 2, folded).otherwise(t).try_cast("double")


def coerce_boolean(c: Column) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as SQL's floating-point numbers have it: infinite, or not a number, where b is zero."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return F.when(b != 0, a / b).when(b == 0, F.when((a == 0) | F.isnan(a), nan).when(a > 0, inf).when(a < 0, -inf))


def logarithm(c: Column) -> Column:
    """Natural logarithm of a double: minus infinity of zero, not a number below."""
    return F.when(c > 0, F.ln(c)).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan")))


def grid_intensity_index(number: Column) -> Column:
    return F.floor((number - 1) / 3).cast("int")


def grid_frequency_index(number: Column) -> Column:
    return F.pmod(number - 1, F.lit(3)).cast("int")


def pick(values: tuple[float, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def normalize_rating(c: Column, low: int = 1, high: int = 7, reverse: bool = False) -> Column:
    """A rating on low..high to 0..1; NULL outside that range."""
    x = (c - low) / float(high - low)
    return F.when(c.between(low, high), 1.0 - x if reverse else x)


def categorize_fit(c: Column, good: list[str], bad: list[str]) -> Column:
    """1 for text with a good word, 0 with a bad one, 0.5 with both, NULL with neither."""
    has = lambda words: reduce(lambda a, b: a | b, [F.lower(c).contains(w) for w in words])
    return F.when(has(good) & has(bad), 0.5).when(has(good), 1.0).when(has(bad), 0.0)


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def iso_to_epoch_ms(c: Column) -> Column:
    """ISO-8601 text to milliseconds; without a zone it is UTC, bad text is NULL."""
    zoned = F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), c).otherwise(F.concat(c, F.lit("Z")))
    return F.unix_millis(F.try_to_timestamp(zoned))


def window_key(participant: Column, condition: Column, index: Column) -> Column:
    return F.concat_ws("_", participant, condition, F.concat(F.lit("W"), F.lpad(index.cast("string"), 2, "0")))


def safe_divide(n: Column, d: Column, least: float = 1e-12) -> Column:
    return F.when(F.abs(d) > least, n / d)


def normalized_entropy(values: Column) -> Column:
    """Entropy of the positive numbers of an array over log2 of their count; 0 for a single one, NULL for none."""
    pos = F.filter(values, lambda x: x > 0)
    total = F.aggregate(pos, F.lit(0.0), lambda s, x: s + x)
    h = F.aggregate(pos, F.lit(0.0), lambda s, x: s - x / total * F.log2(x / total))
    return F.when(F.size(pos) > 1, h / F.log2(F.size(pos).cast("double"))).when(F.size(pos) == 1, 0.0)


def ramp(c: Column, low: float, high: float, inverse: bool = False) -> Column:
    """0 at low, 1 at high, straight between; the inverse falls."""
    x = clip((c - low) / (high - low))
    return 1.0 - x if inverse else x


def yaw(x: Column, z: Column) -> Column:
    return F.degrees(F.atan2(x, z))


def pitch(x: Column, y: Column, z: Column) -> Column:
    norm = F.sqrt(x * x + y * y + z * z)
    return F.when(norm > 0, F.degrees(F.asin(clip(y / norm, -1.0, 1.0))))


Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def unit(a: Vector) -> Vector:
    n = F.sqrt(dot(a, a))
    return tuple(F.when(n > 0, x / n) for x in a)


def project_gaze(gaze: Vector, forward: Vector, up: Vector, width: int, height: int, fov: float) -> tuple[Column, Column]:
    """Pixel of a gaze direction seen by a camera that looks forward; fov across the width, degrees. NULL behind it."""
    import math

    g, f = unit(gaze), unit(forward)
    right = unit(cross(up, f))
    above = cross(f, right)
    depth = dot(g, f)
    focal = width / 2 / math.tan(math.radians(fov) / 2)
    return F.when(depth > 0, width / 2 + focal * dot(g, right) / depth), F.when(depth > 0, height / 2 - focal * dot(g, above) / depth)


def euler(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Rotation about x, y and z, degrees, of a quaternion (XYZ order)."""
    a = F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))
    b = F.asin(clip(2 * (w * y - z * x), -1.0, 1.0))
    c = F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))
    return F.degrees(a), F.degrees(b), F.degrees(c)


def safe_relative_path(c: Column) -> Column:
    """Slashes for backslashes; NULL for absolute paths and for those that climb out."""
    p = F.regexp_replace(F.regexp_replace(F.trim(c), r"\\", "/"), "^(\\./)+", "")
    return F.when(~p.rlike(r"(^/)|(^[A-Za-z]:)|((^|/)\.\.(/|$))") & (p != ""), p)


def grid_action(old: Column, new: Column) -> Column:
    """Name of the move between two grid numbers; 'illegal' for more than one step on one axis."""
    di = grid_intensity_index(new) - grid_intensity_index(old)
    df = grid_frequency_index(new) - grid_frequency_index(old)
    return (
        F.when((di == 0) & (df == 0), "hold")
        .when((F.abs(di) + F.abs(df)) != 1, "illegal")
        .when(di == 1, "intensity_up")
        .when(di == -1, "intensity_down")
        .when(df == 1, "frequency_up")
        .otherwise("frequency_down")
    )


def conservative_step(number: Column) -> Column:
    """One step towards less load: intensity first, then frequency; the least stays."""
    return F.when(grid_intensity_index(number) > 0, number - 3).when(grid_frequency_index(number) > 0, number - 1).otherwise(number)


# Fixed values: (modality, pattern, family) of feature names, the first that fits; H is head, P physiology.
FAMILIES = [
    ("H", "^head_speed_", "head_translational_speed"),
    ("H", "^head_angular_speed_deg_s_", "head_angular_velocity"),
    ("H", "^head_jerk_", "head_jerk"),
    ("H", "^head_stationary_fraction$", "head_stationary_fraction"),
    ("H", "^head_position_range$", "head_position_range"),
    ("H", "^head_motion_spectral_entropy$", "head_motion_spectral_entropy"),
    ("P", "^ecg_rr_std_ms_audit_only$", "ecg_rr_std_ms_audit_only"),
    ("P", "^ecg_hrv_", "ecg_hrv"),
    ("P", "^ecg_", "ecg_rate_signal_amplitude"),
    ("P", "_relative$", "eeg_relative_band_power"),
    ("P", "(_power|_robust_amplitude_uV)$", "eeg_absolute_power_amplitude"),
    ("P", "_hjorth_|_spectral_entropy$", "eeg_hjorth_spectral_entropy"),
    ("P", "^eeg_(alpha_beta_ratio|theta_beta_ratio|alpha_asymmetry_log_right_left)$", "eeg_ratios_asymmetry"),
]


def feature_family(modality: Column, name: Column, strict: bool = False) -> Column:
    """The one family of a feature name within its modality; NULL for a name that no rule maps, or an error if ``strict``."""
    out = F.raise_error(F.concat(F.lit("no family: "), name)).cast("string") if strict else F.lit(None).cast("string")
    for m, pattern, family in reversed(FAMILIES):
        out = F.when((modality == m) & name.rlike(pattern), family).otherwise(out)
    return out


def soft_label(c: Column, classes: int) -> Column:
    """Comma-separated weights to an array that sums to 1; NULL unless there are ``classes`` numbers, none negative, some positive."""
    v = F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("double"))
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    ok = (F.size(v) == classes) & ~F.exists(v, lambda x: x.isNull() | (x < 0)) & (total > 0)
    return F.when(ok, F.transform(v, lambda x: x / total))


def dominant(c: Column) -> Column:
    """Place, from 0, of the first greatest value of an array."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


# Fixed values: (score, feature, low, high, falling, weight). A score is the greatest of its weighted ramps, stillness the least.
RAMPS = [
    ("cardio_arousal", "hr", 105.0, 145.0, False, 1.0),
    ("cardio_arousal", "rmssd", 80.0, 180.0, True, 0.5),
    ("motion_arousal", "eye_velocity", 8.0, 20.0, False, 1.0),
    ("motion_arousal", "saccade", 0.02, 0.10, False, 1.0),
    ("motion_arousal", "head_speed", 0.018, 0.045, False, 1.0),
    ("motion_arousal", "head_angular", 9.0, 22.0, False, 1.0),
    ("stillness", "eye_velocity", 1.2, 7.0, True, 1.0),
    ("stillness", "head_speed", 0.0035, 0.018, True, 1.0),
    ("stillness", "stationary", 0.80, 0.98, False, 1.0),
    ("eeg_calm", "alpha_beta", 0.45, 0.80, False, 1.0),
    ("eeg_calm", "theta_beta", 0.35, 0.80, True, 0.5),
    ("eeg_tension", "theta_beta", 1.25, 2.25, False, 1.0),
    ("eeg_tension", "alpha_beta", 0.20, 0.35, True, 0.5),
]
TAG_AT = 0.65


def sensor_state(features: dict[str, Column], relaxation: Column, discomfort: Column, calm_relaxation: float = 0.55, calm_discomfort: float = 0.40) -> Column:
    """Struct of the scores above, boredom, physiological_arousal and tags; a missing or NULL feature adds nothing."""
    scores: dict[str, Column] = {}
    for score in dict.fromkeys(r[0] for r in RAMPS):
        parts = [F.coalesce(ramp(features[f], low, high, falling), F.lit(0.0)) * weight if f in features else F.lit(0.0) for s, f, low, high, falling, weight in RAMPS if s == score]
        scores[score] = (F.least if score == "stillness" else F.greatest)(*parts)
    calm = (relaxation >= calm_relaxation) & (discomfort <= calm_discomfort)
    scores["boredom"] = F.when(calm, scores["stillness"]).otherwise(0.0)
    scores["physiological_arousal"] = F.greatest(scores["cardio_arousal"], scores["motion_arousal"], scores["eeg_tension"], ramp(discomfort, 0.35, 0.60))
    high = lambda name: scores[name] >= TAG_AT
    tags = [
        F.when(high("cardio_arousal"), "cardio_arousal"),
        F.when(high("motion_arousal"), "motion_arousal"),
        F.when(high("stillness") & calm, "calm_stillness"),
        F.when(high("eeg_calm"), "eeg_calm"),
        F.when(high("eeg_tension"), "eeg_tension"),
        F.when(high("boredom"), "possible_boredom"),
    ]
    return F.struct(*[c.alias(n) for n, c in scores.items()], F.array_compact(F.array(*tags)).alias("tags"))
