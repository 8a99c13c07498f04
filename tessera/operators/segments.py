"""Fixed and sliding windows, chunks, frame sampling, clock choice."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window


def tumbling(bounds: DataFrame, start: str, end: str, length: int) -> DataFrame:
    """(…, index, window_start, window_end, sample_weight): windows from each row's start; an incomplete tail is dropped
    and the weights of a row's windows sum to 1."""
    n = F.floor((F.col(end) - F.col(start)) / length).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    out = bounds.select("*", n.alias("_n"), F.explode(at).alias("index"))
    first = F.col(start) + F.col("index") * F.lit(length).cast("bigint")
    return out.withColumns({"window_start": first, "window_end": first + length, "sample_weight": 1.0 / F.col("_n")}).drop("_n")


def sliding(bounds: DataFrame, start: str, end: str, length: int, step: int) -> DataFrame:
    """Overlapping windows that lie within [start, end]."""
    last = F.col(end) - length
    at = F.when(last >= F.col(start), F.sequence(F.col(start), last, F.lit(step).cast("bigint")))
    return bounds.select("*", F.posexplode(at).alias("index", "window_start")).withColumn("window_end", F.col("window_start") + length)


def task_chunks(tasks: DataFrame, origins: DataFrame, key: str, task: str, start: str, end: str, rate: float, seconds: float) -> DataFrame:
    """Sample-index chunks inside each task, from the session's origin; ``global_seq`` runs over a session by start."""
    size = int(rate * seconds)
    t = tasks.join(origins, key)
    first, last = F.floor((F.col(start) - F.col("origin")) * rate), F.floor((F.col(end) - F.col("origin")) * rate)
    n = F.floor((last - first) / size).cast("int")
    out = t.select(key, task, first.alias("_f"), F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("chunk"))
    out = out.withColumn("start_index", F.col("_f") + F.col("chunk") * size).withColumn("end_index", F.col("start_index") + size).drop("_f")
    return out.withColumn("global_seq", F.row_number().over(Window.partitionBy(key).orderBy("start_index", task)) - 1)


def chunk_problems(chunks: DataFrame, key: str, start: str, end: str, size: int, total: str) -> DataFrame:
    """Chunks with problems: overlap, negative_start, past_end, wrong_size."""
    before = F.max(end).over(Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    c = chunks.withColumn("_p", before)
    found = F.array_compact(F.array(F.when(F.col(start) < F.col("_p"), "overlap"), F.when(F.col(start) < 0, "negative_start"), F.when(F.col(end) > F.col(total), "past_end"), F.when(F.col(end) - F.col(start) != size, "wrong_size")))
    return c.withColumn("problems", found).drop("_p").filter(F.size("problems") > 0)


def baseline_windows(offsets: DataFrame, bounds: DataFrame, key: str, start: str, count: int = 4, length: int = 10_000) -> DataFrame:
    """``count`` windows from a baseline start on one clock, moved to the other by the median of ``offset`` per key."""
    shift = offsets.groupBy(key).agg(F.percentile("offset", 0.5).alias("shift"))
    out = bounds.join(shift, key).select(key, (F.col(start) + F.bround("shift").cast("bigint")).alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("index"))
    return out.select(key, "index", (F.col("_s") + F.col("index") * length).alias("window_start"), (F.col("_s") + (F.col("index") + 1) * length).alias("window_end"))


def tail_interval(phases: DataFrame, start: str, end: str, notes: str, default: float) -> DataFrame:
    """The last seconds of a phase; how many stands in the notes ("last 60 s"), else ``default``."""
    said = F.regexp_extract(F.lower(notes), r"last\s+(\d+(?:\.\d+)?)\s*s", 1)
    seconds = F.least(F.coalesce(F.when(said != "", said).cast("double"), F.lit(default)), F.col(end) - F.col(start))
    return phases.withColumn("tail_seconds", seconds).withColumn("tail_start", F.col(end) - seconds)


def frames_at(frames: DataFrame, targets: DataFrame, keys: list[str], frame_ts: str, target_ts: str, frame: str, bucket: int | None = None) -> DataFrame:
    """Nearest frame to each target of its window (ties to the earlier, then to the lower number), each frame once.

    Two as-of joins: the last frame before and the first at or after a target; no frame meets more than its neighbours.
    With ``bucket`` (units of time) a long window is many tasks.
    """
    from tessera.operators.joins import asof

    first = frames.groupBy(*keys, F.col(frame_ts).cast("double").alias("_t")).agg(F.min(F.struct(frame_ts, frame)).alias("_f"))
    goals = targets.select(*keys, F.col(target_ts).cast("double").alias("_g"))
    back = asof(goals, first, keys, "_g", "_t", ["_f"], bucket=bucket).withColumnsRenamed({"_t": "_bt", "_f": "_bf"})
    both = asof(back, first, keys, "_g", "_t", ["_f"], forward=True, bucket=bucket)
    use_back = F.col("_bt").isNotNull() & (F.col("_t").isNull() | (F.col("_g") - F.col("_bt") <= F.col("_t") - F.col("_g")))
    near = both.select(*keys, F.when(use_back, F.col("_bf")).otherwise(F.col("_f")).alias("m")).filter("m is not null")
    return near.select(*keys, F.col(f"m.{frame_ts}"), F.col(f"m.{frame}")).distinct()


def bin_centres(windows: DataFrame, start: str, end: str, count: int) -> DataFrame:
    step = (F.col(end) - F.col(start)) / float(count)
    return windows.withColumn("target", F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.col(start) + step * (i + 0.5))))


class _Centres:
    """The frames of a window, in order of time, that its bin centres can take: ``count`` on either side of each."""

    def __init__(self, start: float, end: float, count: int):
        self.centres = [start + (end - start) / count * (i + 0.5) for i in range(count)]
        self.count, self.n, self.last, self.same, self.passed = count, 0, None, 0, 0
        self.before: deque[tuple] = deque(maxlen=2 * count)
        self.held: dict[tuple, None] = {}
        self.until = 0
        """Frames from here on are held whatever the centre, as they follow one."""

    def add(self, at: float, frame: object) -> None:
        self.n += 1
        self.same = self.same + 1 if at == self.last else 1
        self.last = at
        if self.same > self.count:
            return  # of frames of one time no more than that can be taken
        while self.passed < len(self.centres) and self.centres[self.passed] <= at:
            self.held.update(dict.fromkeys(self.before))
            self.passed += 1
            self.until = 2 * self.count
        if self.until:
            self.held[at, self.n, frame] = None
            self.until -= 1
        self.before.append((at, self.n, frame))

    def chosen(self) -> list[tuple]:
        if self.n < self.count:
            return []
        if self.passed < len(self.centres):
            self.held.update(dict.fromkeys(self.before))
        free = sorted(self.held)
        taken = []
        for c in self.centres:
            best = min(free, key=lambda x: (abs(x[0] - c), *x[:2]))
            free.remove(best)
            taken.append(best)
        return [(at, f) for at, _, f in sorted(taken)]


def uniform_frames(frames: DataFrame, windows: DataFrame, keys: list[str], ts: str, frame: str, start: str, end: str, count: int) -> DataFrame:
    """``count`` distinct frames of each window, taken for the bin centres in turn, each the nearest not yet taken (ties
    to the earlier); none for a window with fewer frames.

    A window's frames pass in order of time, and of them are held those that a centre can take, at most 4 * ``count`` for
    each, so a window of any length is no frame in memory. Frames without a time are left out.
    """
    inside = frames.join(windows, keys).filter((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end)))
    inside = inside.select(*keys, start, end, F.col(ts).cast("double").alias(ts), frame)
    schema = inside.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, held = None, None
        for b in batches:
            out = []
            for *now, at, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != window:
                    out += [(*window, *x) for x in held.chosen()] if held else []
                    window, held = now, _Centres(float(now[-2]), float(now[-1]), count)
                held.add(at, f)
            yield batch(out)
        yield batch([(*window, *x) for x in held.chosen()] if held else [])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema, strict=True)], schema.names)

    return inside.repartition(*keys, start).sortWithinPartitions(*keys, start, end, ts, frame).mapInArrow(run, schema)


def timestamp_source(frames: DataFrame, key: str, direct: str, iso: str, order: str) -> DataFrame:
    """(key, source, reason): the direct clock where it is complete and its cadence plausible, else ISO, else none.

    Plausible: median step 50..200 ms, at least 90 % positive steps and 98 % not negative.
    """
    w = Window.partitionBy(key).orderBy(order)
    f = frames.withColumn("_d", F.col(direct) - F.lag(direct).over(w)).withColumn("_i", F.col(iso) - F.lag(iso).over(w))
    share = lambda cond, d: F.avg(F.when(F.col(d).isNotNull(), cond.cast("int")))
    ok = lambda c, d: (F.col(f"n_{c}") == F.col("n")) & F.col(f"m_{d}").between(50, 200) & (F.col(f"p_{d}") >= 0.9) & (F.col(f"z_{d}") >= 0.98)
    aggs = [F.count("*").alias("n")]
    for c, d in ((direct, "_d"), (iso, "_i")):
        aggs += [F.count(c).alias(f"n_{c}"), F.percentile(d, 0.5).alias(f"m_{d}"), share(F.col(d) > 0, d).alias(f"p_{d}"), share(F.col(d) >= 0, d).alias(f"z_{d}")]
    g = f.groupBy(key).agg(*aggs)
    first, second = F.coalesce(ok(direct, "_d"), F.lit(False)), F.coalesce(ok(iso, "_i"), F.lit(False))
    reason = F.when(first, "direct").when(F.col(f"n_{direct}") < F.col("n"), "direct_incomplete").otherwise("direct_implausible")
    return g.select(key, F.when(first, "direct").when(second, "iso").otherwise("none").alias("source"), reason.alias("reason"))


def convert_bounds(start: Column, end: Column, rate: float, native: float) -> tuple[Column, Column]:
    """An index range at one rate as a range at another."""
    return F.floor(start / rate * native).cast("bigint"), F.ceil(end / rate * native).cast("bigint")


def padded_crop(samples: DataFrame, windows: DataFrame, keys: list[str], ts: str, start: str, end: str, pad: int, width: int) -> DataFrame:
    """Samples of [start - pad, end + pad) with ``is_inner`` for those in [start, end)."""
    from tessera.operators.joins import samples_to_windows

    w = windows.withColumns({"_s": F.col(start) - pad, "_e": F.col(end) + pad})
    out = samples_to_windows(samples, w, keys, ts, "_s", "_e", width).drop("_s", "_e")
    return out.withColumn("is_inner", (F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end)))


def timeline(durations: DataFrame, key: str, order: str, duration: str) -> DataFrame:
    """Segments one after another on a common axis: start and end by running sum."""
    end = F.sum(duration).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return durations.withColumn("end", end).withColumn("start", F.col("end") - F.col(duration))


def trial_windows(trials: DataFrame, start: str, end: str, seconds: float) -> DataFrame:
    """Windows of fixed seconds in each trial, the tail dropped."""
    n = F.floor((F.col(end) - F.col(start)) / seconds).cast("int")
    out = trials.select("*", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("index"))
    return out.withColumns({"window_start": F.col(start) + F.col("index") * seconds, "window_end": F.col(start) + (F.col("index") + 1) * seconds})
