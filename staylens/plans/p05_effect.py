"""Effect of events on occupancy."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens import model as M
from staylens.operators import effect as FX
from staylens.plans import p02_events as P2
from staylens.plans import p04_series as P4
from staylens.plans.registry import query


def panel(t):
    return t.district_daily


def days(t):
    """The days of every event; where some event takes place on nearly every day, few cells are informative."""
    return P2.event_days(t)


def festival_days(t):
    """The days of one kind of event."""
    return P2.event_days(t, "festival")


KEPT = f"""(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY district) AS nd, count(*) OVER (PARTITION BY district, cell) AS nc, sum(is_event) OVER (PARTITION BY district, cell) AS ne
    FROM (SELECT f.*, o.occupancy, date_trunc('month', f.date) AS cell FROM {P4.FLAGGED} f JOIN district_daily o ON o.district = f.district AND o.date = f.date))
    WHERE nd >= 30 AND nc >= 4 AND ne < nc)"""
ALL_KEPT = KEPT.replace(P4.FLAGGED, P4.ALL_FLAGGED)


@query("ml15_informative_cells", f"SELECT district, CAST(date AS VARCHAR) AS date, is_event FROM {KEPT}")
def _(t):
    return FX.informative_cells(panel(t), festival_days(t)).select("district", "date", "is_event")


@query("ml16_cross_products", f"""WITH r AS (SELECT district, CAST(is_event AS DOUBLE) - avg(is_event) OVER (PARTITION BY district, cell) AS e_, occupancy - avg(occupancy) OVER (PARTITION BY district, cell) AS y_,
      CAST(isodow(date) = 7 AS INTEGER) - avg(CAST(isodow(date) = 7 AS INTEGER)) OVER (PARTITION BY district, cell) AS d6_, is_event, cell FROM {KEPT}),
    s AS (SELECT *, district AS scope FROM r UNION ALL SELECT *, '*' FROM r)
    SELECT scope, round(sum(e_ * e_), 6) AS ee, round(sum(e_ * y_), 6) AS ey, round(sum(d6_ * e_), 6) AS de, count(*) AS n_obs, count(DISTINCT (district, cell)) AS n_cells,
    CAST(sum(is_event) AS BIGINT) AS n_event_days FROM s GROUP BY scope""")
def _(t):
    eq = FX.normal_equations(FX.demeaned(FX.informative_cells(panel(t), festival_days(t))))
    return eq.select("scope", F.col("s_e_e").alias("ee"), F.col("s_e_y").alias("ey"), F.col("s_d6_e").alias("de"), "n_obs", "n_cells", "n_event_days")


@query("ml15_informative_cells_all_events", f"SELECT district, CAST(date AS VARCHAR) AS date, is_event FROM {ALL_KEPT}")
def _(t):
    return FX.informative_cells(panel(t), days(t)).select("district", "date", "is_event")


@query("ml16_cross_products_all_events", f"""WITH r AS (SELECT district, CAST(is_event AS DOUBLE) - avg(is_event) OVER (PARTITION BY district, cell) AS e_, occupancy - avg(occupancy) OVER (PARTITION BY district, cell) AS y_,
      CAST(isodow(date) = 7 AS INTEGER) - avg(CAST(isodow(date) = 7 AS INTEGER)) OVER (PARTITION BY district, cell) AS d6_, is_event, cell FROM {ALL_KEPT}),
    s AS (SELECT *, district AS scope FROM r UNION ALL SELECT *, '*' FROM r)
    SELECT scope, round(sum(e_ * e_), 6) AS ee, round(sum(e_ * y_), 6) AS ey, round(sum(d6_ * e_), 6) AS de, count(*) AS n_obs, count(DISTINCT (district, cell)) AS n_cells,
    CAST(sum(is_event) AS BIGINT) AS n_event_days FROM s GROUP BY scope""")
def _(t):
    eq = FX.normal_equations(FX.demeaned(FX.informative_cells(panel(t), days(t))))
    return eq.select("scope", F.col("s_e_e").alias("ee"), F.col("s_e_y").alias("ey"), F.col("s_d6_e").alias("de"), "n_obs", "n_cells", "n_event_days")


@query("ml17_effect_with_clustered_errors")
def _(t):
    rows = FX.demeaned(FX.informative_cells(panel(t), days(t)))
    return FX.estimate(rows, FX.solve(FX.normal_equations(rows)))


@query("ml18_placebo")
def _(t):
    rows = FX.demeaned(FX.informative_cells(panel(t), days(t)))
    return FX.placebo(rows, FX.solve(FX.normal_equations(rows)), M.PLACEBO_ROUNDS)


@query("wn21_shifted_calendars")
def _(t):
    return FX.shifted_days(FX.informative_cells(panel(t), days(t)), M.PLACEBO_ROUNDS, 1).groupBy("district", "round").agg(
        F.count("*").alias("days"), F.min("date").alias("first_day"))


@query("ml19_event_effect_report")
def _(t):
    return FX.verdict(FX.event_effect(panel(t), days(t)))
