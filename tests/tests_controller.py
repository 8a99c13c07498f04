"""The shadow controller once more, written as a table of conditions on a session's past: for every window all that it needs is
looked up in the rows before it, and only the place, its trail and the state are carried."""

from statistics import median

# The grid, the order of branches and the names of reasons and states.
GRID = {c: ((c - 1) // 3, (c - 1) % 3) for c in range(1, 10)}
START = 5


class Twin:
    def __init__(self, gap, high=0.5, monotony=0.6, least=3, longest=6):
        self.gap, self.high, self.monotony, self.least, self.longest = gap, high, monotony, least, longest

    def ratings(self, rows, i):
        """[(condition, rating)] revealed up to window i, in order, and whether i itself reveals one."""
        known, now = [], None
        for j in range(1, i + 1):
            done, r = rows[j - 1].condition, rows[j - 1].rating
            if rows[j].condition != done and done not in [c for c, _ in known]:
                known.append((done, r))
                now = (j, done, r)
        return known, now[1:] if now and now[0] == i else None

    @staticmethod
    def risk(r, high):
        return r.discomfort >= high or r.direction == "too_strong"

    def window(self, rows, i):
        """The valid predictions since the last gap or run of invalid windows, up to and with i."""
        out = []
        for j in range(i, -1, -1):
            bad = not rows[j].valid or rows[j].relaxation is None or rows[j].discomfort is None
            if bad:
                if j == i:
                    continue
                break
            out.append((rows[j].relaxation, rows[j].discomfort))
            if j and rows[j].ms - rows[j - 1].ms > self.gap:
                break
        return out[::-1]

    def run(self, rows):
        at, came, axis, state, arrived = START, None, None, "warming_up", 0
        trail = [(START, 0)]  # (condition, window of arrival)
        for i, row in enumerate(rows):
            own = row.own
            known, fresh = self.ratings(rows, i)
            risky = {c for c, r in known if self.risk(r, self.high)}
            safe = {c for c, r in known if not self.risk(r, self.high) and r.fits}
            gap = i > 0 and row.ms - rows[i - 1].ms > self.gap
            if gap:
                arrived = i
            bad = not row.valid or row.relaxation is None or row.discomfort is None
            held = self.held(rows, i) if bad else self.window(rows, i)
            last3 = held[-3:]
            tense = median(d for _, d in last3) if last3 else None
            calm = median(r for r, _ in last3) if last3 else None
            rising = len(last3) == 3 and last3[0][1] < last3[1][1] < last3[2][1] and last3[2][1] - last3[0][1] > own.eps_discomfort
            latest = known[-1][1] if known else None
            proof = {c for c in safe if GRID[c][0] == 2 and GRID[c][1] < 2}, {c for c in safe if GRID[c][1] == 2 and GRID[c][0] < 2}
            locked = not (all(proof) and tense is not None and tense < self.high and not rising and latest is not None and latest.discomfort < self.high and latest.direction not in (None, "too_strong"))
            before, to, reason = at, at, None
            dwell = self.shown(rows, arrived, i)
            if bad:
                run = self.invalid(rows, i)
                reason = "signal_invalid_hold"
                if run >= 3:
                    state, to = "signal_safe_return", self.back(at, came, risky, safe)
                    reason = "three_invalid_windows_safe_return" if to != at else "three_invalid_windows_already_safe"
            else:
                seen = len(held)
                if fresh and self.risk(fresh[1], self.high) or rising or seen >= self.least and tense >= self.high:
                    state, to = "recovering", self.back(at, came, risky, safe)
                    reason = "safety_hold" if to == at else "rating_recovery" if fresh and self.risk(fresh[1], self.high) else "discomfort_recovery"
                elif seen < self.least:
                    state, reason = "warming_up", "minimum_observation_warmup"
                elif state in ("recovering", "signal_safe_return"):
                    reason = "recovery_observation"
                    if dwell >= self.least:
                        state, reason = "active", "recovery_complete_hold"
                else:
                    state, reason = "active", "active_observation_hold"
                    bored = latest is not None and (latest.monotony or 0) >= self.monotony and dwell >= self.least
                    low = calm < own.baseline - own.eps_relaxation and dwell >= self.least
                    due = dwell >= self.longest
                    if bored or low or due:
                        pick = self.explore(at, axis, trail, known, risky, locked, low and not due)
                        reason = "exploration_filtered_hold"
                        if pick:
                            to, reason = pick, "monotony_exploration" if bored else "low_relaxation_probe" if low and not due else "maximum_dwell_exploration"
            if to != at:
                axis = "intensity" if abs(to - at) == 3 else "frequency"
                came, at, arrived, dwell = at, to, i + 1, 0
                trail.append((to, i + 1))
            yield before, at, "step" if to != before else "hold", reason, state, dwell, fresh[0] if fresh else None, not bad, gap, locked

    def held(self, rows, i):
        """What an invalid window still holds: the last valid ones, unless a gap came since."""
        for j in range(i, -1, -1):
            if rows[j].valid and rows[j].relaxation is not None and rows[j].discomfort is not None:
                return self.window(rows, j)
            if j and rows[j].ms - rows[j - 1].ms > self.gap:
                return []
        return []

    def invalid(self, rows, i):
        n = 0
        while i >= 0 and (not rows[i].valid or rows[i].relaxation is None or rows[i].discomfort is None):
            n, i = n + 1, i - 1
        return n

    @staticmethod
    def shown(rows, first, i):
        """Valid windows since the condition was taken or a gap came."""
        return sum(r.valid and r.relaxation is not None and r.discomfort is not None for r in rows[first : i + 1])

    def back(self, at, came, risky, safe):
        load = {c: sum(g) for c, g in GRID.items()}
        if came and load[at] > load[came] and came not in risky:
            return came
        far = lambda c: abs(GRID[c][0] - GRID[at][0]) + abs(GRID[c][1] - GRID[at][1])
        goal = min(safe | {START}, key=lambda c: (far(c), load[c], c))
        goal = START if goal == at else goal
        for step, k in ((3, 0), (1, 1)):
            if GRID[goal][k] != GRID[at][k]:
                return at + step * (1 if GRID[goal][k] > GRID[at][k] else -1)
        return at

    def explore(self, at, axis, trail, known, risky, locked, gentle):
        rated = dict(known)
        best = None
        for c in GRID:
            if abs(GRID[c][0] - GRID[at][0]) + abs(GRID[c][1] - GRID[at][1]) != 1 or c in risky or c == 9 and locked or gentle and GRID[c][0] > GRID[at][0]:
                continue
            visits = [w for x, w in trail if x == c]
            liked = (rated[c].relaxation or 0) + (rated[c].pleasantness or 0) if c in rated else 0
            turn = axis is not None and axis != ("intensity" if abs(c - at) == 3 else "frequency")
            rank = (c in rated or bool(visits), len(visits), visits[-1] if visits else -1, sum(GRID[c]), not turn, -liked, c)
            best = rank if best is None or rank < best else best
        return best and best[-1]
