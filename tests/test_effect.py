"""Event effect: equality with a full least-squares fit, and behaviour on planted panels."""

import datetime as dt
import math

import numpy as np
import pytest

from staylens.functions.stats import student_quantile
from staylens.operators import effect as FX

START = dt.date(2025, 1, 6)


def panel(seed, effect, days=500, gap=False):
    rng = np.random.default_rng(seed)
    rows, events = [], []
    for i, name in enumerate(["A", "B", "C"]):
        runs = set()
        for _ in range(28):
            start = int(rng.integers(0, days - 3))
            runs |= {start + k for k in range(int(rng.integers(1, 4)))}
        for k in range(days):
            if gap and 120 <= k < 243:
                continue
            day = START + dt.timedelta(days=k)
            level = 55 + 6 * i + 12 * math.sin(2 * math.pi * day.timetuple().tm_yday / 365.25) + (8 if day.weekday() >= 4 else 0)
            rows.append((name, day, float(level + rng.normal(0, 6) + (effect if k in runs else 0))))
        events += [(name, START + dt.timedelta(days=k)) for k in runs]
    return rows, events


def frames(spark, rows, events):
    return spark.createDataFrame(rows, "district string, date date, occupancy double"), spark.createDataFrame(events, "district string, date date")


def full_fit(rows, events):
    """The regression with all constants written out."""
    ev = set(events)
    cells = {}
    for r in rows:
        cells.setdefault((r[0], r[1].strftime("%Y-%m")), []).append(r)
    kept = [r for c in cells.values() if len(c) >= 4 and not all((r[0], r[1]) in ev for r in c) for r in c]
    names = sorted({(r[0], r[1].strftime("%Y-%m")) for r in kept})
    pos = {c: i for i, c in enumerate(names)}
    x = np.zeros((len(kept), len(names) + 7))
    ids = np.array([pos[(r[0], r[1].strftime("%Y-%m"))] for r in kept])
    for i, r in enumerate(kept):
        x[i, ids[i]] = 1
        if r[1].weekday():
            x[i, len(names) + r[1].weekday() - 1] = 1
        x[i, -1] = (r[0], r[1]) in ev
    y = np.array([r[2] for r in kept])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    inv = np.linalg.inv(x.T @ x)
    meat = sum(np.outer(s, s) for s in (x[ids == g].T @ e[ids == g] for g in range(len(names))))
    g, n, k = len(names), len(kept), x.shape[1]
    se = math.sqrt(g / (g - 1) * (n - 1) / (n - k) * (inv @ meat @ inv)[-1, -1])
    return beta[-1], se, student_quantile(0.975, g - 1), n, g


def test_equals_full_regression(spark):
    rows, events = panel(1, 5.0, gap=True)
    p, e = frames(spark, rows, events)
    got = {r["scope"]: r for r in FX.event_effect(p, e, rounds=0).collect()}
    for scope, sub, ev in [("*", rows, events)] + [(d, [r for r in rows if r[0] == d], [x for x in events if x[0] == d]) for d in "ABC"]:
        tau, se, crit, n, g = full_fit(sub, ev)
        r = got[scope]
        assert (r["n_obs"], r["n_cells"]) == (n, g)
        assert r["tau"] == pytest.approx(tau, abs=1e-8)
        assert r["se"] == pytest.approx(se, abs=1e-8)
        assert r["ci_upper"] == pytest.approx(tau + crit * se, abs=1e-6)


@pytest.mark.parametrize("effect", [-6.0, 12.0])
def test_planted_effect_is_found(spark, effect):
    p, e = frames(spark, *panel(7, effect))
    r = {x["scope"]: x for x in FX.verdict(FX.event_effect(p, e, rounds=200)).collect()}["*"]
    assert r["ci_lower"] <= effect <= r["ci_upper"]
    assert r["verdict"] == "detected_confirmed" and r["placebo_p"] < 0.05


def test_no_effect_is_not_claimed(spark):
    p, e = frames(spark, *panel(11, 0.0, gap=True))
    r = {x["scope"]: x for x in FX.event_effect(p, e, rounds=200).collect()}["*"]
    assert not r["detected"] and r["placebo_p"] > 0.05


def test_placebo_equals_direct_projection(spark):
    """One round by hand: shift the calendar, fit again with all constants."""
    rows, events = panel(3, 4.0, days=200)
    p, e = frames(spark, rows, events)
    kept = FX.demeaned(FX.informative_cells(p, e))
    shifted = [(r["district"], r["date"]) for r in FX.shifted_days(kept, 1, 5).collect()]
    base = [(r["district"], r["date"], r["occupancy"]) for r in kept.collect()]
    x, moved = base, set(shifted)
    cells = sorted({(r[0], r[1].strftime("%Y-%m")) for r in x})
    a = np.zeros((len(x), len(cells) + 7))
    for i, r in enumerate(x):
        a[i, cells.index((r[0], r[1].strftime("%Y-%m")))] = 1
        if r[1].weekday():
            a[i, len(cells) + r[1].weekday() - 1] = 1
        a[i, -1] = (r[0], r[1]) in moved
    tau = np.linalg.lstsq(a, np.array([r[2] for r in x]), rcond=None)[0][-1]
    solved = FX.solve(FX.normal_equations(kept))
    own = {r["scope"]: r["tau"] for r in solved.collect()}["*"]
    p_value = {r["scope"]: r["placebo_p"] for r in FX.placebo(kept, solved, 1, 5).collect()}["*"]
    assert p_value == (1.0 if abs(tau) >= abs(own) else 0.5)


def test_few_episodes_are_withheld(spark):
    rows, _ = panel(2, 0.0, days=120)
    events = [("A", START + dt.timedelta(days=k)) for k in range(20, 45)]
    r = {x["scope"]: x for x in FX.event_effect(*frames(spark, rows, events), rounds=0).collect()}["*"]
    assert r["n_episodes"] == 1 and not r["identifiable"] and r["tau"] is None
