"""Column factories: one definition per metric. Nothing here rounds; presentation does."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens import model as M


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(value: date | str | Column) -> Column:
    """A reference date may be a Python date, an ISO string or a Column (for example a scalar subquery)."""
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def clip(c: str | Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), col(c)))


def ratio(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0))


def weighted_occupancy(rooms: str = "rooms_num", pct: str = "available_rooms_percent") -> Column:
    """AG-01 / UD-04: room-night weighted occupancy, 0..100. Sum over sum, so partial aggregation splits hot keys.
    Unknown availability counts as fully occupied. Written as sum(rooms * (100 - pct)) / sum(rooms), which adds whole
    numbers for whole percentages and so does not depend on the order of the rows."""
    r = F.col(rooms)
    return ratio(F.sum(r * (100.0 - clip(F.coalesce(F.col(pct), F.lit(0.0)), 0.0, 100.0))), F.sum(r))


def median_price(price: str = "min_price") -> Column:
    """Median of positive prices. The aggregation buffer counts distinct integer prices, so it is bounded by the
    price range and not by the number of rows in the group."""
    return F.percentile(F.when(F.col(price) > 0, F.col(price)), 0.5)


def own_occupancy(rooms: str = "rooms_num", free: str = "free_rooms_amount") -> Column:
    """SC-28: occupancy of one object from its own rooms, NULL when the room count is unknown or zero."""
    r = F.coalesce(F.col(rooms), F.lit(0))
    f = F.least(F.greatest(F.coalesce(F.col(free), F.lit(0)), F.lit(0)), r)
    return F.when(r > 0, 100.0 * (r - f) / F.nullif(r, F.lit(0)))


def size_bucket(rooms: str | Column = "rooms_num") -> Column:
    """SC-29."""
    r = col(rooms)
    return F.when(r <= 15, "mini").when(r <= 50, "mid").when(r.isNotNull(), "large")


def revpar(price: Column, occupancy: Column) -> Column:
    return price * occupancy / 100.0


def confidence(count: Column, high: int = M.DISTRICT_SAMPLE_HIGH, medium: int | None = None) -> Column:
    """FLT-15: with `medium` None everything below `high` is medium (district table); otherwise low closes the scale."""
    if medium is None:
        return F.when(count >= high, "high").otherwise("medium")
    return F.when(count >= high, "high").when(count >= medium, "medium").otherwise("low")


def occupancy_band(occupancy: Column) -> Column:
    """SC-51, three bands."""
    return F.when(occupancy < 40, "low").when(occupancy < 70, "medium").when(occupancy.isNotNull(), "high")


def occupancy_step(occupancy: Column) -> Column:
    """SC-51, five steps of twenty points."""
    return (
        F.when(occupancy < 20, 1).when(occupancy < 40, 2).when(occupancy < 60, 3).when(occupancy < 80, 4)
        .when(occupancy.isNotNull(), 5)
    )


def season(month: Column) -> Column:
    """SC-23."""
    branches = list(M.SEASON_MONTHS.items())
    start = F.when(month.isin(*branches[0][1]), branches[0][0])
    return reduce(lambda acc, b: acc.when(month.isin(*b[1]), b[0]), branches[1:], start)


def month_name(month: Column) -> Column:
    """SC-23."""
    return F.try_element_at(F.array(*[F.lit(m) for m in M.MONTH_NAMES]), month.cast("int"))


def staleness(as_of: Column, latest: Column, stale_after_days: int = 1) -> tuple[Column, Column]:
    """WN-23: (age in days, stale flag). No data at all is stale."""
    age = F.datediff(as_of, latest)
    return age, F.coalesce(age > stale_after_days, F.lit(True))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """SC-27, earth radius 6371 km."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) ** 2
    return 2 * 6371.0 * F.asin(F.sqrt(a))


def good_weather(temp: Column, precipitation: Column, warm: float = 10.0) -> Column:
    """SC-32: the display rule uses 10 degrees, the feature rule 15."""
    return (temp > warm) & (precipitation < M.LOW_PRECIPITATION)


def trip_score(occupancy: Column, temperature: Column, n_events: Column) -> Column:
    """SC-30: cheap quiet dates score high; warmth adds at most 20, each event costs 3; result within 0..100."""
    warmth = F.coalesce(F.least(F.lit(20.0), F.greatest(F.lit(-10.0), temperature) * 0.7), F.lit(0.0))
    warmth = F.when(temperature.isNull(), 0.0).otherwise(warmth)
    return clip(F.greatest(F.lit(0.0), 100.0 - occupancy) + warmth - 3.0 * n_events, 0.0, 100.0)


def price_change_percent(forecast: Column) -> Column:
    """SC-31: signed percent change by forecast occupancy (half-even rounding, caps 30 / 15 / 25)."""
    return (
        F.when(forecast > 75, F.least(F.lit(30.0), F.bround((forecast - 60) * 0.8, 0)))
        .when(forecast > 55, F.least(F.lit(15.0), F.bround((forecast - 50) * 0.5, 0)))
        .when(forecast < 35, -F.least(F.lit(25.0), F.bround((40 - forecast) * 0.8, 0)))
        .otherwise(0.0)
    )


def trend_label(change: Column, threshold: float, up: str = "up", down: str = "down", flat: str = "stable") -> Column:
    return F.when(change > threshold, up).when(change < -threshold, down).when(change.isNotNull(), flat)
