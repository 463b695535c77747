"""Effect of events on occupancy: a panel regression with district-by-month constants, as sums.

The model is occupancy = cell + weekday + tau * event + error, with one constant per (district, month) cell. Demeaning
within the cell removes the constants (Frisch-Waugh-Lovell), so what is left are seven regressors whose normal
equations, cluster scores and placebo projections are plain sums. The panel is never collected; only one row of sums
per estimate reaches the small solver, which runs in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from staylens import model as M
from staylens.functions.stats import student_quantile
from staylens.operators.timeseries import episodes
from staylens.session import materialise

POOLED = "*"
DOW = [f"d{i}" for i in range(1, 7)]
REGRESSORS = [*DOW, "e"]


def informative_cells(panel: DataFrame, event_days: DataFrame, min_days: int = 30, min_cell: int = 4) -> DataFrame:
    """ML-15: rows of districts with enough days, in cells with enough days that are not all event days."""
    flags = event_days.select("district", "date", F.lit(1).alias("_e")).distinct()
    rows = panel.filter(F.col("occupancy").isNotNull()).join(flags, ["district", "date"], "left").select(
        "district", "date", "occupancy", F.coalesce("_e", F.lit(0)).alias("is_event"), F.trunc("date", "month").alias("cell"))
    w_d, w_c = W.partitionBy("district"), W.partitionBy("district", "cell")
    marked = rows.withColumns({
        "_nd": F.count("*").over(w_d), "_nc": F.count("*").over(w_c), "_ne": F.sum("is_event").over(w_c)})
    keep = (F.col("_nd") >= min_days) & (F.col("_nc") >= min_cell) & (F.col("_ne") < F.col("_nc"))
    return marked.filter(keep).drop("_nd", "_nc", "_ne")


def demeaned(kept: DataFrame) -> DataFrame:
    """Outcome, weekday dummies (Monday is in the constant) and event flag, each minus its cell mean."""
    w = W.partitionBy("district", "cell")
    raw = kept.withColumns({
        **{f"d{i}": (F.weekday("date") == i).cast("double") for i in range(1, 7)},
        "e": F.col("is_event").cast("double"), "y": F.col("occupancy"),
    })
    return raw.withColumns({f"{c}_": F.col(c) - F.avg(c).over(w) for c in ["y", *REGRESSORS]})


def _scopes(rows: DataFrame) -> DataFrame:
    """Each row counts for its district and for the pooled estimate."""
    return rows.select("*", F.explode(F.array(F.col("district"), F.lit(POOLED))).alias("scope"))


def normal_equations(rows: DataFrame) -> DataFrame:
    """One row of sums per scope: cross products of the demeaned columns, totals and counts."""
    cols = [*REGRESSORS, "y"]
    sums = [
        F.sum(F.col(f"{a}_") * F.col(f"{b}_")).alias(f"s_{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]
    ]
    return _scopes(rows).groupBy("scope").agg(
        *sums, F.count("*").alias("n_obs"), F.count_distinct("district").alias("n_districts"),
        F.count_distinct("district", "cell").alias("n_cells"), F.sum("is_event").alias("n_event_days"),
        (F.count("*") * F.var_pop("y")).alias("ss_tot"),
    )


def _matrix(pdf: pd.DataFrame, i: int, names: list[str]) -> np.ndarray:
    pos = {c: k for k, c in enumerate([*REGRESSORS, "y"])}
    get = lambda a, b: pdf[f"s_{a}_{b}" if pos[a] <= pos[b] else f"s_{b}_{a}"].iat[i]
    return np.array([[get(a, b) for b in names] for a in names], dtype=float)


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for i in range(len(pdf)):
            a = _matrix(pdf, i, REGRESSORS)
            full = _matrix(pdf, i, [*REGRESSORS, "y"])
            b = full[:-1, -1]
            inv = np.linalg.pinv(a, hermitian=True)
            beta = inv @ b
            d, g = a[:6, :6], full[:6, -1]
            d_inv = np.linalg.pinv(d, hermitian=True)
            rss = float(full[-1, -1] - beta @ b)
            out.append({
                "scope": pdf["scope"].iat[i], "beta": beta.tolist(), "inv": inv.ravel().tolist(), "tau": float(beta[-1]),
                "gamma": (d_inv @ g).tolist(), "d_inv": d_inv.ravel().tolist(), "rss": rss,
                "e_left": float(a[6, 6] - a[6, :6] @ d_inv @ a[:6, 6]),
                **{c: pdf[c].iat[i] for c in ("n_obs", "n_districts", "n_cells", "n_event_days", "ss_tot")},
            })
        yield pd.DataFrame(out)


SOLVED = (
    "scope string, beta array<double>, inv array<double>, tau double, gamma array<double>, d_inv array<double>, rss double,"
    " e_left double, n_obs long, n_districts long, n_cells long, n_event_days long, ss_tot double"
)


def solve(equations: DataFrame) -> DataFrame:
    """ML-16: coefficients per scope from the sums. Scopes without events, without ordinary days, or with the event flag
    explained by the weekdays alone have no estimate."""
    ok = (F.col("n_event_days") > 0) & (F.col("n_event_days") < F.col("n_obs")) & (F.col("n_obs") > F.col("n_cells") + 8)
    return equations.filter(ok & (F.col("n_cells") >= 2)).mapInPandas(_solve, SOLVED).filter(F.col("e_left") > 1e-12)


def cluster_scores(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Sum over cells of the squared cell score in the direction that decides tau: (last row of the inverse) . score."""
    j = _scopes(rows).join(solved.select("scope", "beta", "inv"), "scope")
    x = [F.col(f"{c}_") for c in REGRESSORS]
    resid = F.col("y_")
    weight = F.lit(0.0)
    for k, v in enumerate(x):
        resid = resid - F.col("beta")[k] * v
        weight = weight + F.col("inv")[6 * 7 + k] * v
    by_cell = j.groupBy("scope", "district", "cell").agg(F.sum(weight * resid).alias("s"))
    return by_cell.groupBy("scope").agg(F.sum(F.col("s") * F.col("s")).alias("meat"))


def _interval(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n, g = pdf["n_obs"], pdf["n_cells"]
        correction = (g / (g - 1)) * ((n - 1) / (n - (g + 7)))
        se = np.sqrt(correction * pdf["meat"])
        crit = np.array([student_quantile(0.975, int(k) - 1) for k in g])
        yield pd.DataFrame({
            "scope": pdf["scope"], "tau": pdf["tau"], "se": se, "ci_lower": pdf["tau"] - crit * se, "ci_upper": pdf["tau"] + crit * se,
            "r_squared": 1.0 - pdf["rss"] / pdf["ss_tot"], "n_obs": n, "n_districts": pdf["n_districts"], "n_cells": g,
            "n_event_days": pdf["n_event_days"],
        })


ESTIMATE = (
    "scope string, tau double, se double, ci_lower double, ci_upper double, r_squared double, n_obs long, n_districts long,"
    " n_cells long, n_event_days long"
)


def estimate(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """ML-17: cluster-robust error by cell with the small-sample factor; the columns counted in it include the cell
    constants. The interval uses t with (cells - 1) degrees of freedom."""
    return solved.join(cluster_scores(rows, solved), "scope").mapInPandas(_interval, ESTIMATE)


def shifted_days(rows: DataFrame, rounds: int, seed: int) -> DataFrame:
    """WN-21: event days of every round after a ring shift of the district's calendar by whole weeks. Weekdays and run
    lengths stay; the draw is a seeded hash of (district, round), so any task computes the same shift."""
    span = rows.groupBy("district").agg(F.min("date").alias("_o"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("_span"))
    ev = rows.filter("is_event = 1").select("district", "date").join(span, "district")
    weeks = F.greatest(F.floor(F.col("_span") / 7), F.lit(1))
    draws = ev.select("*", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    shift = F.pmod(F.xxhash64(F.lit(seed), "district", "round"), weeks) * 7
    slot = F.pmod(F.datediff("date", "_o") + shift, F.col("_span").cast("bigint"))
    return draws.select("district", "round", F.date_add("_o", slot.cast("int")).alias("date"))


def _project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if pdf.empty:
            continue
        gamma, d_inv = np.stack(pdf["gamma"].to_numpy()), np.stack(pdf["d_inv"].to_numpy()).reshape(-1, 6, 6)
        d = pdf[[f"sum_{c}" for c in DOW]].to_numpy()
        num = pdf["sum_y"].to_numpy() - (gamma * d).sum(axis=1)
        den = pdf["left"].to_numpy() - np.einsum("ni,nij,nj->n", d, d_inv, d)
        ok = den > 1e-12
        tau = np.where(ok, num / np.where(ok, den, 1.0), np.nan)
        yield pd.DataFrame({"scope": pdf["scope"], "valid": ok.astype("int64"), "hit": (ok & (np.abs(tau) >= np.abs(pdf["tau"]))).astype("int64")})


def placebo(rows: DataFrame, solved: DataFrame, rounds: int, seed: int = 20260810) -> DataFrame:
    """ML-18: share of shifted calendars whose effect is at least as strong, (hits + 1) / (valid + 1).

    The outcome is residualised once; a round needs only sums over its own event days. Those sums are built per
    (district, round) and then added up for the pooled scope, so the explode is rounds x event days, not rounds x panel."""
    base = rows.select("district", "date", "cell", "y_", *[f"{c}_" for c in DOW])
    moved = shifted_days(rows, rounds, seed).join(base, ["district", "date"])
    w = rows.groupBy("district", "cell").agg(F.count("*").alias("_nc"))
    per_cell = moved.groupBy("district", "round", "cell").agg(
        F.count("*").alias("_k"), F.sum("y_").alias("_y"), *[F.sum(f"{c}_").alias(f"_{c}") for c in DOW]).join(w, ["district", "cell"])
    per_district = per_cell.groupBy("district", "round").agg(
        F.sum("_y").alias("sum_y"), F.sum(F.col("_k") - F.col("_k") * F.col("_k") / F.col("_nc")).alias("left"),
        *[F.sum(f"_{c}").alias(f"sum_{c}") for c in DOW])
    per_scope = _scopes(per_district).groupBy("scope", "round").agg(
        F.sum("sum_y").alias("sum_y"), F.sum("left").alias("left"), *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in DOW])
    draws = per_scope.join(solved.select("scope", "tau", "gamma", "d_inv"), "scope").drop("round")
    hits = draws.mapInPandas(_project, "scope string, valid long, hit long")
    return hits.groupBy("scope").agg(((F.sum("hit") + 1) / (F.sum("valid") + 1)).alias("placebo_p"), F.sum("valid").alias("placebo_rounds"))


def event_effect(panel: DataFrame, event_days: DataFrame, rounds: int = M.PLACEBO_ROUNDS, seed: int = 20260810) -> DataFrame:
    """ML-19: estimate per district and pooled (scope '*'), with the number of independent episodes. Below ten episodes
    the effect is not identifiable and its numbers are withheld."""
    rows = materialise(demeaned(informative_cells(panel, event_days)))
    solved = materialise(solve(normal_equations(rows)))
    runs = episodes(rows.select("district", "date", "is_event"))
    runs = _scopes(runs).groupBy("scope").agg(F.sum("episodes").alias("n_episodes"))
    out = estimate(rows, solved).join(runs, "scope", "left")
    if rounds > 0:
        out = out.join(placebo(rows, solved, rounds, seed), "scope", "left")
    else:
        out = out.withColumn("placebo_p", F.lit(None).cast("double"))
    known = F.col("n_episodes") >= M.MIN_EVENT_EPISODES
    hidden = ["tau", "se", "ci_lower", "ci_upper", "placebo_p"]
    return out.select(
        "scope", known.alias("identifiable"), *[F.when(known, F.col(c)).alias(c) for c in hidden],
        F.when(known, (F.col("ci_lower") > 0) | (F.col("ci_upper") < 0)).alias("detected"),
        "r_squared", "n_obs", "n_districts", "n_cells", "n_event_days", "n_episodes",
    )


def verdict(report: DataFrame) -> DataFrame:
    """SC-49: what the interval and the placebo test say together."""
    p = F.col("placebo_p")
    text = (
        F.when(~F.col("identifiable"), "not_identifiable")
        .when(F.col("detected") & p.isNull(), "detected")
        .when(F.col("detected") & (p < 0.05), "detected_confirmed")
        .when(F.col("detected"), "detected_unconfirmed")
        .when(p < 0.05, "ambiguous").otherwise("not_detected")
    )
    return report.withColumn("verdict", text)
