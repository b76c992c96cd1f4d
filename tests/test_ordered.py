"""Processors of ordered streams with a state of their own, without Spark: many keys in a cell must come out as each key alone."""

import random
from collections import Counter

import pandas as pd
import pytest

from brinelog.streaming import ordered

MINUTE = 60_000_000
WIDTHS = ({"width_s": 600, "least": 3.0, "min_rows": 2}, {"width_s": 600, "drop": 0.3, "stable": 0.9, "min_rows": 2}, {"width_s": 600, "ratio": 0.5, "min_rows": 2})


class Held:
    def __init__(self, calls):
        self.value, self.calls = None, calls

    def exists(self):
        self.calls["state"] += 1
        return self.value is not None

    def get(self):
        self.calls["state"] += 1
        return self.value

    def put(self, value):
        self.calls["state"] += 1
        self.value = value

    update = put

    def clear(self):
        self.put(None)


class Handle:
    def __init__(self):
        self.calls, self.timers = Counter(), []
        self.getListState = self.getValueState = lambda name, kind: Held(self.calls)

    def listTimers(self):
        self.calls["timers"] += 1
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)

    def getCurrentWatermarkInMs(self):
        return self.mark


def told(processor, batches):
    """All that is told of (rows, watermark in ms), in which a timer that is due calls after the rows."""
    handle, out = Handle(), []
    processor.init(handle)
    for rows, handle.mark in batches:
        if len(rows):
            out += list(processor.handleInputRows(None, iter([rows]), handle))
        if any(t <= handle.mark for t in handle.timers):
            out += list(processor.handleExpiredTimer(None, handle, None))
    return pd.concat(out).astype(object).where(lambda d: d.notna(), None) if out else pd.DataFrame(), handle.calls


def lots(keys, seed):
    """Rows in three batches, each within the watermark that comes with the next."""
    rng, rows = random.Random(seed), []
    for i in range(len(keys) * 40):
        t = rng.randrange(0, 180) * MINUTE + (rng.random() < 0.2) * 300 * MINUTE
        rows.append((t, rng.choice(keys), i, rng.random() < 0.7, rng.choice([None, 5.0, 6.0, 9.5, 40.0]), rng.choice([None, 1.0, 1.0, 2.0])))
    rows = pd.DataFrame(rows, columns=[ordered.AT, ordered.KEY, "event_id", "is_anomaly", "cod", "tss"])
    cuts = [0, 70 * MINUTE, 150 * MINUTE, 10**12]
    batches = [rows[(rows[ordered.AT] >= a) & (rows[ordered.AT] < b)] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [(b, m) for b, m in zip([*batches, rows[:0]], [0, cuts[1] // 1000 - 1, cuts[2] // 1000 - 1, 10**9], strict=True)]


MAKERS = {
    "persisted": lambda idle: ordered.Persistence([ordered.AT, ordered.KEY, "event_id", "is_anomaly"], 2, idle),
    "cooled": lambda idle: ordered.Cooldown([ordered.AT, ordered.KEY, "event_id"], 25 * MINUTE, idle),
    "tampering": lambda idle: ordered.Tampering([ordered.AT, ordered.KEY, "event_id", "cod", "tss"], *WIDTHS, idle),
}


@pytest.mark.parametrize("idle", [None, 3600, 12_000])
@pytest.mark.parametrize("name", list(MAKERS))
def test_keys_of_a_cell_come_out_as_each_alone(name, idle):
    keys = ["", "=a", "=b", "=", "=ö"]
    batches = lots(keys, 7)
    shown = lambda df: sorted(map(repr, df[sorted(df.columns)].itertuples(index=False, name=None)))
    together = told(MAKERS[name](idle), batches)[0]
    alone = pd.concat([told(MAKERS[name](idle), [(b[b[ordered.KEY] == k], m) for b, m in batches])[0] for k in keys])
    assert len(together) > 20 and shown(together) == shown(alone)


@pytest.mark.parametrize("name", list(MAKERS))
def test_calls_of_state_do_not_grow_with_keys(name):
    few, many = (told(MAKERS[name](None), lots([f"={i}" for i in range(n)], 3))[1] for n in (3, 300))
    assert all(many[c] <= few[c] + 4 for c in ("state", "timers"))


def test_batches_do_not_show_in_windows():
    """Windows told over several batches are those of all rows at once."""
    batches = lots(["=a", "=b", ""], 5)
    whole = [(pd.concat([b for b, _ in batches]), 10**9)]
    rows = [sorted(map(repr, told(MAKERS["tampering"](None), x)[0].itertuples(index=False, name=None))) for x in (batches, whole)]
    assert rows[0] == rows[1] and len(rows[0]) > 10


def test_runs_against_a_loop():
    batches = lots(["=a", "=b", ""], 9)
    rows, want = pd.concat([b for b, _ in batches]).sort_values([ordered.KEY, ordered.AT, "event_id"]), {}
    for _, mine in rows.groupby(ordered.KEY):
        n = 0
        for r in mine.itertuples():
            n = n + 1 if r.is_anomaly else 0
            if n >= 2:
                want[r.event_id] = n
    got = told(MAKERS["persisted"](None), batches)[0]
    assert dict(zip(got["event_id"], got["consecutive_count"], strict=True)) == want


def test_strongest_against_a_loop():
    """Bands without readings, of one and of many, equal readings, NaN, a factory that is null."""
    rng = random.Random(2)
    read = [(rng.randrange(0, 500), rng.choice([1, 2, 3, None]), rng.choice([1.0, 2.0, 2.0, 3.0]), float(i)) for i in range(150)]
    ask = [(rng.randrange(-100, 700) + 60, i) for i in range(200)]
    columns = [ordered.AT, "shock_id", "value", "factory_id", "cod", "tss"]
    rows = pd.DataFrame([(t, None, None, f, c, s) for t, f, c, s in read] + [(t, i, 9.0, None, None, None) for t, i in ask], columns=columns)
    made = ordered.Strongest(columns, 60, 12, 1000)
    handle = Handle()
    made.init(handle)
    made.waiting.appendList = lambda values, held=made.waiting: held.put([*(held.value or []), *values])
    for part in (rows[:100], rows[100:]):
        assert not list(made.handleInputRows((0,), iter([part]), handle))
    assert len(handle.timers) == 1
    got = pd.concat(list(made.handleExpiredTimer((0,), handle, None)))
    want = {}
    for t, i in ask:
        near = [(-c, s, f is None, f or 0) for s, f, c, _ in read if abs(t - 60 - s) <= 12]
        want[i] = min(near)[:2] if near else None
    told = {r.shock_id: None if pd.isna(r.cod) else (-r.cod, r.source_ts.value // 1000) for r in got.itertuples()}
    assert told == want and made.waiting.value is None
    assert {w is None for w in want.values()} == {True, False}


def test_timeline_against_a_loop():
    """Stages too early, too late, at both ends, several of one event, several rows of an event, and rows that meet nothing."""
    rng, columns = random.Random(4), ["event_id", "stage", ordered.AT]
    rows = [(rng.randrange(40), rng.choice([-1, 0, 0, 1, 1, 2]), rng.randrange(0, 400) * 1000) for _ in range(300)]
    frame, handle, out = pd.DataFrame(rows, columns=columns), Handle(), []
    made = ordered.Timeline(3, 50_000)
    made.init(handle)
    for part, handle.mark in ((frame[frame[ordered.AT] < 200_000], 0), (frame[frame[ordered.AT] >= 200_000], 199), (frame[:0], 10_000)):
        out += list(made.handleInputRows((0,), iter([part]), handle)) if len(part) else list(made.handleExpiredTimer((0,), handle, None))
    want = []
    for i, s, t in rows:
        if s <= 0:
            near = [[u for j, r, u in rows if s == 0 and j == i and r == k and 0 <= u - t <= 50_000] or [None] for k in (1, 2)]
            want += [(i, s, t, a, b) for a in near[0] for b in near[1]]
    got = pd.concat(out).astype(object).where(lambda d: d.notna(), None)
    assert Counter(got[["event_id", "stage", "stage_0", "stage_1", "stage_2"]].itertuples(index=False, name=None)) == Counter(want)
    assert made.waiting.value is None and not handle.timers and len(out) == 2
