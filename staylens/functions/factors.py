"""Demand factors and advice texts derived from a date's circumstances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens import model as M
from staylens.functions import dates as D


def occupancy_level(occupancy: Column) -> Column:
    """SC-34."""
    return F.when(occupancy > 60, "высокая").when(occupancy > 40, "средняя").when(occupancy.isNotNull(), "низкая")


def tariff_advice(occupancy: Column) -> Column:
    """SC-34, as a code; the wording belongs to the user interface."""
    return (
        F.when(occupancy > 70, "raise").when(occupancy > 50, "hold").when(occupancy > 30, "promote")
        .when(occupancy.isNotNull(), "discount").otherwise("no_data")
    )


def demand_factors(day: Column, n_events: Column, temperature: Column) -> Column:
    """SC-33: array of (name, impact, direction) that apply to the date."""
    m = F.month(day)

    def factor(applies: Column, name: str, impact: Column) -> Column:
        return F.when(
            applies,
            F.struct(
                F.lit(name).alias("name"), impact.alias("impact"),
                F.when(impact > 0, "positive").otherwise("negative").alias("direction"),
            ),
        )

    value = lambda key: F.lit(M.IMPACT[key])
    rows = F.array(
        factor(D.is_holiday(day), "holiday", value("holiday")),
        factor(F.weekday(day) >= 5, "weekend", value("weekend")),
        factor(m.isin(*M.HIGH_SEASON_MONTHS), "high_season", value("high_season")),
        factor(m.isin(*M.WINTER_SEASON_MONTHS), "winter_season", value("winter_season")),
        factor(m.isin(*M.OFFSEASON_MONTHS), "offseason", value("offseason")),
        factor(n_events > 0, "events", value("event_nearby") * n_events),
        factor(temperature > M.WARM_TEMPERATURE, "warm_weather", value("good_weather")),
        factor(temperature < M.COLD_TEMPERATURE, "cold_weather", value("cold_weather")),
    )
    return F.filter(rows, lambda x: x.isNotNull())
