"""Stateful operators over session streams, and their batch twins.

A session's rows go through one small state machine in order of time. ``replay`` feeds recorded rows to it; ``stream`` does
so with every micro-batch and keeps the states between them as a table, so both give the same rows. Spark sorts the
rows of a micro-batch, on disk where they are many, and a task holds one Arrow batch and one state: neither a long
session nor a large micro-batch is ever a frame in memory. Machines keep sums and short histories, no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

# Cycle length, source timeout and command expiry in ms, windows of low coverage to failsafe, history and
# cooldown in windows, conditions of high load.
CYCLE_MS, TIMEOUT_MS, EXPIRY_MS, LOW_LIMIT, HISTORY, COOLDOWN, HIGH_LOAD = 10_000, 3_000, 9_500, 3, 16, 6, (6, 8, 9)


class Windows:
    """Closed windows of a session: the origin moves to each change of condition, and the cycle starts at 0 again.

    A row earlier than the last is rejected as late. A closed window takes its rows out of the buffer; a change of
    condition evicts what is left there. Each window has its rows' count and mean, whether the source had been silent for
    longer than the timeout at its end, the windows and visits of its condition, and the number of the command it gives.
    """

    inputs = ["ms", "condition", "value"]
    columns = "kind string, cycle long, start long, stop long, condition string, n long, mean double, silent boolean, dwell long, visits long, command long, expires long"

    def __init__(self, cycle: int = CYCLE_MS, timeout: int = TIMEOUT_MS, order: tuple[str, ...] = ("ms", "condition", "value")):
        self.cycle, self.timeout, self.order = cycle, timeout, list(order)

    def begin(self) -> dict:
        return {"condition": None, "origin": None, "index": 0, "last": None, "n": 0, "valued": 0, "total": 0.0, "seen": None, "dwell": 0, "command": 0, "history": []}

    def feed(self, s: dict, ms: int, condition: str, value: float) -> Iterator[tuple]:
        if s["last"] is not None and ms < s["last"]:
            yield ("late", None, ms, None, condition, None, value, None, None, None, None, None)
            return
        s["last"] = ms
        while s["origin"] is not None and ms >= s["origin"] + (s["index"] + 1) * self.cycle:
            yield self.close(s)
        if condition != s["condition"]:
            if s["n"]:
                yield ("evict", s["index"], s["origin"] + s["index"] * self.cycle, ms, s["condition"], s["n"], None, None, None, None, None, None)
            s.update(condition=condition, origin=ms, index=0, n=0, valued=0, total=0.0, dwell=0)
            s["history"] = (s["history"] + [condition])[-HISTORY:]
        s.update(n=s["n"] + 1, seen=ms)
        if value is not None:
            s.update(valued=s["valued"] + 1, total=s["total"] + value)

    def close(self, s: dict) -> tuple:
        start = s["origin"] + s["index"] * self.cycle
        stop = start + self.cycle
        n, mean = s["n"], s["total"] / s["valued"] if s["valued"] else None  # rows come in order, so all of them are before its end
        s.update(n=0, valued=0, total=0.0)
        s["dwell"] += 1
        s["command"] += 1
        out = ("window", s["index"], start, stop, s["condition"], n, mean, stop - s["seen"] > self.timeout, s["dwell"], s["history"].count(s["condition"]), s["command"], stop + EXPIRY_MS)
        s["index"] += 1
        return out


class Sessions:
    """Sessions of a device: one begins where none is active, rows that name another are refused until a stop comes."""

    inputs = ["ms", "name", "stop"]
    order = ["ms", "name"]
    columns = "kind string, at long, name string, active string"

    def begin(self) -> dict:
        return {"active": None}

    def feed(self, s: dict, ms: int, name: str, stop: bool) -> Iterator[tuple]:
        if stop:
            if s["active"] is not None:
                yield ("end", ms, s["active"], None)
            s["active"] = None
        elif s["active"] is None:
            s["active"] = name
            yield ("begin", ms, name, name)
        elif name != s["active"]:
            yield ("refused", ms, name, s["active"])


class Coverage:
    """State of a session from its windows' coverage by modality.

    Fewer than ``active`` modalities of coverage ``least`` degrade it, and the ``limit``-th such window in a row locks the
    failsafe for good. A headset that is known not to be worn holds, and starts the count anew.
    """

    inputs = ["ms", "coverage", "worn"]
    order = ["ms"]
    columns = "at long, state string, action string, reason string, n_active long, low_windows long"

    def __init__(self, least: float = 0.5, active: int = 2, limit: int = LOW_LIMIT):
        self.least, self.active, self.limit = least, active, limit

    def begin(self) -> dict:
        return {"low": 0, "locked": False}

    def feed(self, s: dict, ms: int, coverage: list[float], worn: bool | None) -> Iterator[tuple]:
        n = sum(c is not None and c >= self.least for c in coverage)
        if s["locked"]:
            yield (ms, "Failsafe", "failsafe", "failsafe_locked", n, s["low"])
            return
        if worn is False:
            s["low"] = 0
            yield (ms, "Degraded", "hold", "headset_not_worn", n, 0)
        elif n >= self.active:
            s["low"] = 0
            yield (ms, "Running", "decide", "", n, 0)
        else:
            s["low"] += 1
            s["locked"] = s["low"] >= self.limit
            if s["locked"]:
                yield (ms, "Failsafe", "failsafe", "low_modality_coverage_timeout", n, s["low"])
            else:
                yield (ms, "Degraded", "hold", "insufficient_active_modalities", n, s["low"])


class Memory:
    """What a session remembers of its conditions: windows dwelt, visits among the last ones, and cooldowns.

    A condition of high load that is applied cools for ``cooldown`` windows; every window takes one off.
    """

    inputs = ["ms", "target", "applied"]
    order = ["ms"]
    columns = "at long, condition long, dwell long, visits long, cooling string"

    def __init__(self, cooldown: int = COOLDOWN, high: tuple[int, ...] = HIGH_LOAD, first: int = 5):
        self.cooldown, self.high, self.first = cooldown, high, first

    def begin(self) -> dict:
        return {"now": self.first, "dwell": 0, "history": [], "cool": {}}

    def feed(self, s: dict, ms: int, target: int, applied: bool) -> Iterator[tuple]:
        s["cool"] = {c: n - 1 for c, n in s["cool"].items() if n > 1}
        now = int(target) if applied else s["now"]
        s["dwell"] = s["dwell"] + 1 if now == s["now"] else 1
        s["now"] = now
        s["history"] = (s["history"] + [now])[-HISTORY:]
        if applied and now in self.high:
            s["cool"][str(now)] = self.cooldown
        yield (ms, now, s["dwell"], s["history"].count(now), ",".join(f"{c}:{n}" for c, n in sorted(s["cool"].items())))


# The controller's order of branches, its order of ranks and its reasons.
class Controller:
    """Safety-first virtual recommendations from two predictions a window, with ratings revealed after the fact.

    The rating of a condition becomes known when the session leaves it, once, and never before. In this order: a gap
    restarts smoothing and dwell; invalid windows hold, and from the third on return towards safety; a revealed risk,
    smoothed discomfort that is high or one that rises steps back; then warm-up and recovery only watch; then monotony, low
    relaxation or a long dwell explore a neighbour. Risky conditions are left out, and the ninth too while it is locked: both
    of its axes must have been rated safe, discomfort be low and steady, and the last rating neither high nor too strong.
    ``own`` of a row, a struct, holds its person's baseline of relaxation and variability (epsilons) of both predictions; where it or
    a field is null, the machine's own numbers stand in. A join with a table of persons puts it there.
    """

    inputs = ["ms", "condition", "relaxation", "discomfort", "valid", "rating", "own"]
    order = ["ms"]
    columns = "step long, at long, before long, after long, action string, reason string, state string, relaxation double, discomfort double, dwell long, revealed long, signal_valid boolean, gap_reset boolean, c9_locked boolean"

    def __init__(self, gap: int = CYCLE_MS, baseline: float = 0.5, eps_relaxation: float = 0.05, eps_discomfort: float = 0.05, high: float = 0.5, monotony: float = 0.6, least: int = 3, longest: int = 6, fallback: int = 5):
        self.gap, self.baseline, self.eps_relaxation, self.eps_discomfort = gap, baseline, eps_relaxation, eps_discomfort
        self.high, self.monotony, self.least, self.longest, self.fallback = high, monotony, least, longest, fallback

    def begin(self) -> dict:
        return {
            "at": self.fallback, "state": "warming_up", "relaxation": [], "discomfort": [], "seen": 0, "invalid": 0, "dwell": 0, "step": 0, "last_ms": None, "axis": None, "came": None,
            "visits": {str(self.fallback): 1}, "when": {str(self.fallback): 0}, "ratings": {}, "risky": [], "safe": [], "intensity_safe": False, "frequency_safe": False, "latest": None, "actual": None, "pending": None, "own": self.personal(None),
        }

    @staticmethod
    def place(c: int) -> tuple[int, int]:
        return divmod(c - 1, 3)

    @classmethod
    def neighbours(cls, c: int) -> list[int]:
        i, f = cls.place(c)
        return [n for n in range(1, 10) if abs(cls.place(n)[0] - i) + abs(cls.place(n)[1] - f) == 1]

    @classmethod
    def load(cls, c: int) -> int:
        return sum(cls.place(c))

    def towards(self, start: int, goal: int) -> int:
        """One step on one axis, intensity first."""
        (i, f), (a, b) = self.place(start), self.place(goal)
        if i != a:
            return start + (3 if a > i else -3)
        return start + (b > f) - (b < f)

    def personal(self, own: dict | None) -> dict:
        given = {"baseline": self.baseline, "eps_relaxation": self.eps_relaxation, "eps_discomfort": self.eps_discomfort}
        return given | {k: v for k, v in (own or {}).items() if v is not None}

    @staticmethod
    def rising(s: dict) -> bool:
        d = s["discomfort"]
        return len(d) == 3 and d[0] < d[1] < d[2] and d[2] - d[0] > s["own"]["eps_discomfort"]

    def reveal(self, s: dict, condition: int, rating: dict | None) -> tuple[int | None, bool]:
        """On a change of the actual condition: (the finished condition, whether its rating is a risk)."""
        done, known = s["actual"], s["pending"]
        s["actual"], s["pending"] = condition, rating
        if done is None or done == condition or known is None or str(done) in s["ratings"]:
            return None, False
        s["ratings"][str(done)] = s["latest"] = known
        strong = known.get("direction") == "too_strong"
        risk = known["discomfort"] >= self.high or strong
        if risk:
            s["risky"] = sorted({*s["risky"], done})
        elif known.get("fits"):
            s["safe"] = sorted({*s["safe"], done})
            i, f = self.place(done)
            s["intensity_safe"] |= i == 2 and f < 2
            s["frequency_safe"] |= f == 2 and i < 2
        return done, risk

    def locked(self, s: dict, smooth: float | None) -> bool:
        last = s["latest"]
        open_axes = s["intensity_safe"] and s["frequency_safe"]
        calm = smooth is not None and smooth < self.high and not self.rising(s)
        rated = last is not None and last["discomfort"] < self.high and last.get("direction") not in (None, "too_strong")
        return not (open_axes and calm and rated)

    def safer(self, s: dict) -> int:
        """Back where it came from if that was a step down in load and no risk; else towards the nearest safe condition."""
        at, came = s["at"], s["came"]
        if came is not None and self.load(at) > self.load(came) and came not in s["risky"]:
            return came
        (i, f) = self.place(at)
        safe = sorted({*s["safe"], self.fallback}, key=lambda c: (abs(self.place(c)[0] - i) + abs(self.place(c)[1] - f), self.load(c), c))
        return self.towards(at, safe[0] if safe[0] != at else self.fallback)

    def move(self, s: dict, to: int) -> None:
        s["axis"] = "intensity" if abs(to - s["at"]) == 3 else "frequency"
        s.update(came=s["at"], at=to, dwell=0)
        s["visits"][str(to)] = s["visits"].get(str(to), 0) + 1
        s["when"][str(to)] = s["step"]

    def explore(self, s: dict, smooth: float, gentle: bool) -> int | None:
        options = [c for c in self.neighbours(s["at"]) if c not in s["risky"]]
        options = [c for c in options if c != 9 or not self.locked(s, smooth)]
        if gentle:
            options = [c for c in options if self.place(c)[0] <= self.place(s["at"])[0]]

        def rank(c: int) -> tuple:
            k, rated = str(c), s["ratings"].get(str(c))
            axis = "intensity" if abs(c - s["at"]) == 3 else "frequency"
            liked = (rated.get("relaxation") or 0.0) + (rated.get("pleasantness") or 0.0) if rated else 0.0
            visits = s["visits"].get(k, 0)
            return (rated is not None or visits > 0, visits, s["when"].get(k, -1), self.load(c), not (s["axis"] is not None and axis != s["axis"]), -liked, c)

        return min(options, key=rank, default=None)

    def feed(self, s: dict, ms: int, condition: int, relaxation: float, discomfort: float, valid: bool, rating: dict | None, own: dict | None = None) -> Iterator[tuple]:
        s["step"] += 1
        if s.get("given", s) is not own:  # rows in turn share theirs
            s["given"], s["own"] = own, self.personal(own)
        before, action, reason = s["at"], "hold", "minimum_observation_warmup"
        done, risk = self.reveal(s, condition, rating)
        gap = s["last_ms"] is not None and ms - s["last_ms"] > self.gap
        s["last_ms"] = ms
        if gap:
            s.update(relaxation=[], discomfort=[], seen=0, dwell=0)
        if not valid or relaxation is None or discomfort is None:
            s["invalid"] += 1
            reason = "signal_invalid_hold"
            if s["invalid"] >= 3:
                s["state"], to, reason = "signal_safe_return", self.safer(s), "three_invalid_windows_already_safe"
                if to != s["at"]:
                    self.move(s, to)
                    action, reason = "step", "three_invalid_windows_safe_return"
            calm, tense = (float(_median(s[k])) if s[k] else None for k in ("relaxation", "discomfort"))
            yield (s["step"], ms, before, s["at"], action, reason, s["state"], calm, tense, s["dwell"], done, False, gap, self.locked(s, tense))
            return
        if s["invalid"]:
            s.update(relaxation=[], discomfort=[], seen=0, invalid=0)
        s["relaxation"], s["discomfort"] = (s["relaxation"] + [relaxation])[-3:], (s["discomfort"] + [discomfort])[-3:]
        s["seen"] += 1
        s["dwell"] += 1
        calm, tense = float(_median(s["relaxation"])), float(_median(s["discomfort"]))
        if risk or self.rising(s) or s["seen"] >= self.least and tense >= self.high:
            s["state"], to, reason = "recovering", self.safer(s), "safety_hold"
            if to != s["at"]:
                self.move(s, to)
                action, reason = "step", "rating_recovery" if risk else "discomfort_recovery"
        elif s["seen"] < self.least:
            s["state"] = "warming_up"
        elif s["state"] in ("recovering", "signal_safe_return"):
            reason = "recovery_observation"
            if s["dwell"] >= self.least:
                s["state"], reason = "active", "recovery_complete_hold"
        else:
            s["state"], reason = "active", "active_observation_hold"
            enough, overdue = s["dwell"] >= self.least, s["dwell"] >= self.longest
            bored = s["latest"] is not None and (s["latest"].get("monotony") or 0.0) >= self.monotony and enough
            low = calm < s["own"]["baseline"] - s["own"]["eps_relaxation"] and enough
            if bored or low or overdue:
                to, reason = self.explore(s, tense, low and not overdue), "exploration_filtered_hold"
                if to is not None:
                    self.move(s, to)
                    action, reason = "step", "monotony_exploration" if bored else "low_relaxation_probe" if low and not overdue else "maximum_dwell_exploration"
        yield (s["step"], ms, before, s["at"], action, reason, s["state"], calm, tense, s["dwell"], done, True, gap, self.locked(s, tense))


CHUNK = 5_000
"""Rows of output that are handed on at once."""
_KEPT = [T.StructField("last_ms", T.LongType()), T.StructField("now", T.StringType())]


def _plain(x):
    """A machine's input with NULL for NaN."""
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return None if x != x else x


def _values(column: pa.Array, plain: bool = True) -> list:
    """The values of a machine's input, NULL for NaN but in structs. Rows in turn that have equal structs share one, which machines never change."""
    kind = column.type
    if pa.types.is_struct(kind):
        names, last, value, out = [f.name for f in kind], None, None, []
        for row in zip(*(_values(c, False) for c in column.flatten()), strict=True):
            if row != last:
                last, value = row, dict(zip(names, row, strict=True))
            out.append(value)
        return [v if there else None for v, there in zip(out, column.is_valid().to_pylist(), strict=True)] if column.null_count else out
    if pa.types.is_nested(kind):
        return [_plain(x) for x in column.to_pylist()]
    number = pa.types.is_floating(kind)
    if column.null_count or not (number or pa.types.is_integer(kind)):
        return [_plain(x) for x in column.to_pylist()] if number and plain else column.to_pylist()
    values = column.to_numpy()
    return [_plain(x) for x in values.tolist()] if number and plain and np.isnan(values).any() else values.tolist()


def _median(x: list[float]) -> float:
    x, n = sorted(x), len(x)
    return x[n // 2] if n % 2 else (x[n // 2 - 1] + x[n // 2]) / 2


def _stored(state: dict, fields: list[str], last: int | None) -> str:
    """A state as JSON text: a nested column of states, null in all rows but one a session, costs more in every row than the row's own step."""
    return json.dumps({"last_ms": last, "state": {k: state[k] for k in fields}})


def _through(rows: DataFrame, machine, states: bool) -> DataFrame:
    """Rows (session, was, inputs, order) of every session in order through the machine; ``was``, where it isn't null, is a
    state to go on from and comes first. With ``states`` also a row for each session with the state (``now``, and ``last_ms``) that it ends in."""
    out_type = T.StructType.fromDDL(f"session long, {machine.columns}")
    fields = list(machine.begin())
    schema = T.StructType([*out_type, *_KEPT]) if states else out_type
    arrow = [to_arrow_type(f.dataType) for f in schema]
    inputs, order = machine.inputs, machine.order

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, arrow, strict=True)], schema.names)

    def ended(session: int, state: dict, last: int | None) -> tuple:
        return (session, *[None] * (len(out_type) - 1), last, _stored(state, fields, last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, last, out = None, None, None, []
        for b in batches:
            before = b.column("was").to_pylist() if states and b.column("was").null_count < b.num_rows else [None] * b.num_rows
            for session, was, ms, *rest in zip(_values(b.column("session")), before, *(_values(b.column(c)) for c in inputs), strict=True):
                if session != now or state is None:
                    if states and state is not None:
                        out.append(ended(now, state, last))
                    now, state, last = session, machine.begin(), None
                if was is not None:
                    last, state = (known := json.loads(was))["last_ms"], known["state"]
                    continue
                last = ms
                for o in machine.feed(state, ms, *rest):
                    out.append((session, *o, None, None) if states else (session, *o))
                if len(out) >= CHUNK:
                    yield batch(out)
                    out = []
        if states and state is not None:
            out.append(ended(now, state, last))
        yield batch(out)

    first = ["was_first"] if states else []
    rows = rows.filter("ms is not null or was is not null" if states else "ms is not null")  # a row without a time is left out
    return rows.repartition("session").sortWithinPartitions("session", *first, *order).mapInArrow(run, schema)


def replay(rows: DataFrame, machine) -> DataFrame:
    """Recorded ``rows`` (session long and the machine's inputs and order) of each session, in order, through the machine. Spark
    sorts them within its partitions; a task holds one batch of rows and one state, however long a session is."""
    need = list(dict.fromkeys(["session", *machine.order, *machine.inputs]))
    return _through(rows.select(*need), machine, states=False)


def stream(rows: DataFrame, machine, folder: str, ttl: int | None = None) -> DataFrame:
    """Run ``rows``, a stream, through the machine over what there is now and return all its output, with the ``batch`` of each row.

    Each micro-batch goes on from the states of the one before and writes its output and its states in one folder named by its
    number, so one that runs again gives the same; states of older batches are deleted. With ``ttl`` (ms), the state of a session whose
    last row is that far behind the newest of all sessions ends, and the session begins anew if it comes back.
    ``folder`` is shared by driver and executors. The source's options bound a micro-batch; its size bounds no memory.
    """
    spark, path = rows.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"
    need = list(dict.fromkeys(["session", *machine.order, *machine.inputs]))
    out_type = T.StructType.fromDDL(f"session long, {machine.columns}")

    def write(batch: DataFrame, number: int) -> None:
        now = batch.select(*need, F.lit(None).cast("string").alias("was"), F.lit(1).alias("was_first"))
        if number:
            known = spark.read.schema(T.StructType([out_type["session"], *_KEPT])).parquet(f"{path}/all/batch={number - 1}/ended=true")
            if ttl is not None:
                newest = known.agg(F.max("last_ms")).head()[0]
                known = known.filter(F.col("last_ms") >= (newest or 0) - ttl)
            now = now.unionByName(known.select("session", F.col("now").alias("was"), F.lit(0).alias("was_first")), allowMissingColumns=True)
        out = _through(now, machine, states=True)
        out.withColumn("ended", F.col("now").isNotNull()).write.mode("overwrite").partitionBy("ended").parquet(f"{path}/all/batch={number}")
        if number > 1:
            _delete(spark, f"{path}/all/batch={number - 2}/ended=true")

    q = rows.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    _delete(spark, f"{path}/checkpoint")
    every = T.StructType([*out_type, T.StructField("ended", T.BooleanType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(every).parquet(f"{path}/all").filter("not ended").drop("ended")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def silences(rows: DataFrame, timeout: int, late: str) -> DataFrame:
    """(session, source, kind, at): when a source falls silent, ``timeout`` ms after its last row, and when it is back.

    ``rows`` (session long, source string, ts timestamp), a stream. A source that never comes back is reported by a
    timer on event time, once the watermark (``late`` behind the newest row of all) has passed it. Each source of a micro-batch is
    a call of Python, so this is for a live sink with few of them; ``silences_to_table`` is for many.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, silent = state.get if state.exists else (None, False)
        out = []
        if state.hasTimedOut:
            silent, out = True, [("silent", last + timeout)]
        else:
            stamps = pd.concat([f["ms"] for f in frames])
            for ms in sorted(stamps.tolist()):
                if last is not None and ms - last > timeout:
                    out += [] if silent else [("silent", last + timeout)]
                    out.append(("back", ms))
                last, silent = max(ms, last or ms), False
            if not silent and last + timeout < state.getCurrentWatermarkMs():
                silent = True
                out.append(("silent", last + timeout))
        state.update((last, silent))
        if not silent:
            state.setTimeoutTimestamp(last + timeout)
        yield pd.DataFrame([(key[0], key[1], *o) for o in out], columns=["session", "source", "kind", "at"])

    timed = rows.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("session", "source").applyInPandasWithState(run, "session long, source string, kind string, at long", "last long, silent boolean", "append", GroupStateTimeout.EventTimeTimeout)


def silences_to_table(rows: DataFrame, timeout: int, late: int, folder: str) -> DataFrame:
    """What ``silences`` reports of ``rows``, a stream, over what there is now, as one table (session, source, kind, at, batch).

    For many sources: a micro-batch is one sort by (session, source, ms), and the last row of each source is a typed table that the next goes
    on from, so a source costs a row and no call of Python. Timers run at the end of a micro-batch, ``late`` ms behind the newest row of all.
    A row that comes after its source was reported silent, and not from after that silence began, is too late and changes nothing, as is one
    older than its source's last of earlier batches; rows without a time are left out.
    ``folder`` is shared by driver and executors. States of older batches are deleted.
    """
    spark, path = rows.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"
    out_type = T.StructType([rows.schema["session"], rows.schema["source"], *T.StructType.fromDDL("kind string, at long, silent boolean")])
    source = Window.partitionBy("session", "source").orderBy("was_first", "ms")

    def write(batch: DataFrame, number: int) -> None:
        now = batch.select("session", "source", F.unix_millis("ts").alias("ms"), F.lit(None).cast("boolean").alias("silent"), F.lit(1).alias("was_first")).filter("ms is not null")
        if number:
            known = spark.read.schema(out_type).parquet(f"{path}/all/batch={number - 1}/ended=true")
            now = now.union(known.select("session", "source", F.col("at").alias("ms"), "silent", F.lit(0).alias("was_first")))
        newest = now.agg(F.max("ms")).head()[0]
        d = now.withColumn("begun", F.when(F.first("silent").over(source), F.first("ms").over(source) + timeout)).filter("was_first = 0 or begun is null or ms > begun")
        d = d.withColumns({"before": F.max("ms").over(source.rowsBetween(Window.unboundedPreceding, -1)), "end": F.lead("was_first").over(source).isNull()})
        told = F.coalesce(F.col("before") + timeout == F.col("begun"), F.lit(False))
        d = d.withColumns({"told": told, "last": F.greatest("ms", "before")})
        back = (F.col("was_first") == 1) & (F.col("ms") - F.col("before") > timeout)
        kept = F.coalesce("silent", F.lit(False))  # of a state that no row follows
        over = F.col("last") + timeout < F.lit((newest or 0) - late)
        said = lambda kind, at, silent=F.lit(None).cast("boolean"): F.struct(F.lit(kind).alias("kind"), at.alias("at"), silent.alias("silent"))
        events = [
            F.when(back & ~F.col("told"), said("silent", F.col("before") + timeout)),
            F.when(back, said("back", F.col("ms"))),
            F.when(F.col("end") & ~kept & over, said("silent", F.col("last") + timeout)),
            F.when(F.col("end"), said("state", F.col("last"), kept | over)),
        ]
        out = d.select("session", "source", F.inline(F.array_compact(F.array(*events))))
        out.withColumn("ended", F.col("kind") == "state").write.mode("overwrite").partitionBy("ended").parquet(f"{path}/all/batch={number}")
        if number > 1:
            _delete(spark, f"{path}/all/batch={number - 2}/ended=true")

    q = rows.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    _delete(spark, f"{path}/checkpoint")
    every = T.StructType([*out_type, T.StructField("ended", T.BooleanType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(every).parquet(f"{path}/all").filter("not ended").select("session", "source", "kind", "at", "batch")


def run_to_table(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now and read its result back. Each micro-batch is a Parquet folder of its own, so
    one that runs again writes the same folder again. ``folder`` is shared by driver and executors."""
    spark, path = df.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(df.schema.add("batch", "long")).parquet(f"{path}/out")


def decode_frames(raw: DataFrame, payload: str = "value", keep: list[str] = ()) -> DataFrame:
    """JSON messages to (session, source, ms, x), with ``reject`` naming what is wrong with one."""
    j = raw.withColumn("_j", F.from_json(payload, "session long, source string, ms long, x double"))
    reject = F.when(F.col("_j").isNull() | F.col("_j.session").isNull(), "malformed").when(~F.coalesce(F.col("_j.source").isin("head", "eye"), F.lit(False)), "unknown_source").when(F.col("_j.ms").isNull(), "no_time")
    return j.select(*keep, "_j.session", "_j.source", "_j.ms", "_j.x", reject.alias("reject"))


def watermarked(events: DataFrame, ts: str, keys: list[str], value: str, late: str, length: str, slide: str | None = None, points: int = 0) -> DataFrame:
    """Tumbling or sliding event-time windows: count, mean, std, least, greatest, root mean square, peak to peak; with
    ``points`` also that many values spread over the window, the last of each equal part."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    stats = [F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.sqrt(F.avg(F.col(value) ** 2)).alias("rms"), (F.max(value) - F.min(value)).alias("peak_to_peak")]
    d = events.withWatermark(ts, late).withColumn("w", w)
    if points:
        us = F.unix_micros
        part = F.floor((us(F.col(ts)) - us(F.col("w.start"))) * points / (us(F.col("w.end")) - us(F.col("w.start"))))
        d = d.withColumn("_part", part)
        stats.append(F.array(*[F.max_by(F.when(F.col("_part") == i, F.col(value)), F.when(F.col("_part") == i, F.col(ts))) for i in range(points)]).alias("series"))
    return d.groupBy(*keys, "w").agg(*stats)


def latest(events: DataFrame, key: str, ts: str, columns: list[str], kind: str, kinds: list[str], now: Column) -> DataFrame:
    """Per key the last row's columns and, by kind (a fixed few), the age in ms of its last row; NULL for one never seen.
    For update-mode streams."""
    seen = [(F.max(now) - F.max(F.when(F.col(kind) == k, now))).alias(f"age_{k}") for k in kinds]
    return events.groupBy(key).agg(*[F.max_by(c, ts).alias(c) for c in columns], F.count("*").alias("n_rows"), *seen)
