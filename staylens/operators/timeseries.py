"""Window logic over daily series: pace, trends, gaps, episodes and the leak-free feature matrix.

Every window is partitioned by entity and sees one row per entity and day, so its input is bounded by the calendar. The
facts are reduced to that grain before any window runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from staylens import model as M
from staylens.functions import dates as D
from staylens.functions import metrics as X
from staylens.operators import blocks as B
from staylens.operators import market as K

EPOCH = "1970-01-01"


def day_number(c: str | Column = "date") -> Column:
    return F.datediff(X.col(c), F.lit(EPOCH).cast("date"))


def ordered(keys: Sequence[str] = ("district",), desc: bool = False, by: str = "date"):
    return W.partitionBy(*keys).orderBy(F.col(by).desc() if desc else F.col(by))


# --- pace ------------------------------------------------------------------------------------------------------------
def pickup_pace(rooms: DataFrame, keys: Sequence[str] = ("district",)) -> DataFrame:
    """WN-04: change of booked rooms from the previous observed day; the first day has none."""
    booked = F.greatest(F.lit(0), F.col("total_rooms") - F.col("free_rooms"))
    w = ordered(keys)
    return rooms.withColumn("booked", booked).select(
        *keys, "date", "booked", "total_rooms", "free_rooms", "hotels_count",
        F.when(F.col("total_rooms") > 0, F.col("booked") / F.nullif("total_rooms", F.lit(0)) * 100).otherwise(0.0).alias("occupancy"),
        F.coalesce(F.col("booked") - F.lag("booked").over(w), F.lit(0)).alias("pickup"),
    )


def pickup_summary(pace: DataFrame, keys: Sequence[str] = ("district",)) -> DataFrame:
    """WN-04 / WN-08: statistics of non-zero pickups; last three against first three, seven needed."""
    nonzero = pace.filter(F.col("pickup") != 0)
    marked = nonzero.select(
        *keys, "pickup", F.row_number().over(ordered(keys)).alias("_a"), F.row_number().over(ordered(keys, desc=True)).alias("_z")
    )
    agg = marked.groupBy(*keys).agg(
        F.avg("pickup").alias("avg_pickup"), F.max("pickup").alias("max_pickup"), F.min("pickup").alias("min_pickup"),
        F.count("*").alias("_n"), (F.sum(F.when(F.col("_z") <= 3, F.col("pickup"))) / 3).alias("_recent"),
        (F.sum(F.when(F.col("_a") <= 3, F.col("pickup"))) / 3).alias("_earlier"),
    )
    samples = pace.groupBy(*keys).agg(F.count("*").alias("samples"))
    trend = (
        F.when(F.coalesce("_n", F.lit(0)) < 7, "недостаточно данных")
        .when(F.col("_recent") > F.col("_earlier") * 1.2, "ускорение")
        .when(F.col("_recent") < F.col("_earlier") * 0.8, "замедление").otherwise("стабильно")
    )
    return samples.join(agg, list(keys), "left").select(
        *keys, F.coalesce("avg_pickup", F.lit(0.0)).alias("avg_pickup"), F.coalesce("max_pickup", F.lit(0)).alias("max_pickup"),
        F.coalesce("min_pickup", F.lit(0)).alias("min_pickup"), trend.alias("trend"), "samples",
    )


def known_occupancy(stats: DataFrame, hotels: DataFrame, since: Column) -> DataFrame:
    rows = stats.filter((F.col("date") >= since) & F.col("available_rooms_percent").isNotNull())
    return K.with_hotel(rows, hotels, "district").groupBy("district", "date").agg(X.weighted_occupancy().alias("occupancy"))


def value_days_before(value: str, days: int, keys: Sequence[str] = ("district",)) -> Column:
    """JN-12: the value exactly `days` calendar days earlier, NULL when that day was not observed."""
    w = W.partitionBy(*keys).orderBy(day_number()).rangeBetween(-days, -days)
    return F.max(value).over(w)


def proxy_pickup(occupancy: DataFrame, days_ahead: int, lookback: int) -> DataFrame:
    """WN-05 / WN-06: occupancy against the calendar day `lookback` before, for the last observed dates."""
    prev = value_days_before("occupancy", lookback)
    rows = occupancy.withColumn("occupancy_lookback", F.coalesce(prev)).withColumn(
        "_rn", F.row_number().over(ordered(desc=True)))
    return rows.filter(F.col("_rn") <= days_ahead).select(
        "district", "date", F.col("occupancy").alias("occupancy_today"), "occupancy_lookback",
        (F.col("occupancy") - F.col("occupancy_lookback")).alias("proxy_pickup_pct"),
    )


def proxy_pickup_summary(points: DataFrame) -> DataFrame:
    """WN-08, calendar variant: the sum of the last three deltas against half a point."""
    rows = points.filter(F.col("proxy_pickup_pct").isNotNull()).withColumn("_z", F.row_number().over(ordered(desc=True)))
    last = F.sum(F.when(F.col("_z") <= 3, F.col("proxy_pickup_pct")))
    trend = F.when(F.count("*") < 3, "стабильно").when(last > 0.5, "ускорение").when(last < -0.5, "замедление").otherwise("стабильно")
    return rows.groupBy("district").agg(
        F.avg("proxy_pickup_pct").alias("avg_pct"), F.max("proxy_pickup_pct").alias("max_pct"),
        F.min("proxy_pickup_pct").alias("min_pct"), trend.alias("trend"),
    )


def pace_narrative(summary: DataFrame) -> DataFrame:
    """SC-49: reading of the pace from the direction at the edges and the sign of the mean."""
    up, down = F.col("trend") == "ускорение", F.col("trend") == "замедление"
    mean = F.col("avg_pickup")
    text = (
        F.when(up & (mean > 0), "growing").when(down & (mean < 0), "slowing").when(up | down, "mixed").otherwise("no_shift")
    )
    return summary.withColumn("narrative", text)


def half_trend(points: DataFrame, keys: Sequence[str], value: str, order: str, threshold: float) -> DataFrame:
    """WN-09: mean of the second half minus mean of the first; the odd point belongs to the second half."""
    w = W.partitionBy(*keys)
    marked = points.select(
        *keys, value, F.row_number().over(w.orderBy(order)).alias("_rn"), F.count("*").over(w).alias("_n"))
    first = F.col("_rn") <= F.floor(F.col("_n") / 2)
    agg = marked.groupBy(*keys).agg(
        F.avg(F.when(first, F.col(value))).alias("first_half"), F.avg(F.when(~first, F.col(value))).alias("second_half"),
        F.count("*").alias("points"),
    )
    diff = F.col("second_half") - F.coalesce("first_half", F.lit(0.0))
    return agg.withColumn("diff", diff).withColumn(
        "trend", F.when(F.col("points") < 2, "stable").otherwise(X.trend_label(F.col("diff"), threshold, "growing", "declining")))


# --- gaps and spines -------------------------------------------------------------------------------------------------
def daily_spine(series: DataFrame, keys: Sequence[str] = ("district",)) -> DataFrame:
    span = series.groupBy(*keys).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    return span.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("date"))


def interpolate_short_gaps(series: DataFrame, value: str, keys: Sequence[str] = ("district",), limit: int = 7) -> DataFrame:
    """WN-18: one row per calendar day; holes of at most `limit` days are filled on the straight line, longer stay NULL."""
    rows = daily_spine(series, keys).join(series.select(*keys, "date", value), [*keys, "date"], "left")
    back = ordered(keys).rowsBetween(W.unboundedPreceding, 0)
    ahead = ordered(keys).rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("date").alias("d"), F.col(value).alias("v")))
    p, n = F.last(known, True).over(back), F.first(known, True).over(ahead)
    marked = rows.withColumn("_p", p).withColumn("_n", n)
    gap = F.datediff(F.col("_n.d"), F.col("_p.d"))
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * F.datediff("date", F.col("_p.d")) / F.nullif(gap, F.lit(0))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(gap - 1 <= limit, line)
    return marked.select(*keys, "date", F.col(value).alias("observed"), filled.alias(value))


def with_breaks(series: DataFrame, value: str, key: str, max_gap: int = 2) -> DataFrame:
    """WN-19: an empty marker row before each observation that follows a hole of more than `max_gap` days."""
    gap = F.datediff("date", F.lag("date").over(ordered([key])))
    rows = series.select(key, "date", value).withColumn("_gap", gap)
    marks = F.when(F.col("_gap") > max_gap, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    return rows.select(key, "date", value, F.explode(marks).alias("is_break")).withColumn(
        value, F.when(~F.col("is_break"), F.col(value)))


def residual_spread(series: DataFrame, value: str, keys: Sequence[str] = ("district",)) -> DataFrame:
    """WN-20: population spread of the last thirty values around their seven-row mean; 10 for short histories."""
    w = ordered(keys)
    rows = series.select(
        *keys, (F.col(value) - F.avg(value).over(w.rowsBetween(-6, 0))).alias("_r"),
        F.row_number().over(ordered(keys, desc=True)).alias("_rn"), F.count("*").over(W.partitionBy(*keys)).alias("_n"))
    return rows.filter(F.col("_rn") <= 30).groupBy(*keys).agg(
        F.when(F.max("_n") > 30, F.stddev_pop("_r")).otherwise(10.0).alias("spread"))


def fill_series(series: DataFrame, value: str, keys: Sequence[str] = ("district",)) -> DataFrame:
    """WN-17: forward, then backward, then zero."""
    w = ordered(keys)
    forward = F.last(value, True).over(w.rowsBetween(W.unboundedPreceding, 0))
    backward = F.first(value, True).over(w.rowsBetween(0, W.unboundedFollowing))
    return series.withColumn(value, F.coalesce(forward, backward, F.lit(0.0)))


def episodes(flagged: DataFrame, keys: Sequence[str] = ("district",)) -> DataFrame:
    """WN-16: runs of event days; only an observed ordinary day ends a run, a hole in the data does not."""
    start = (F.col("is_event") == 1) & (F.coalesce(F.lag("is_event").over(ordered(keys)), F.lit(0)) == 0)
    return flagged.withColumn("_start", start.cast("int")).groupBy(*keys).agg(F.sum("_start").alias("episodes"))


# --- sessions --------------------------------------------------------------------------------------------------------
def concurrency_blocks(spans: DataFrame, key: str, start: str, end: str, count: int | None = None) -> DataFrame:
    """WN-24, first level: net change and highest running sum of each stretch of instants of a key."""
    moves = spans.select(key, F.explode(F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col(end).alias("at"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("m")).select(key, "m.*")
    net = moves.groupBy(key, "at").agg((F.sum("up") - F.sum("down")).alias("net"))
    running = F.sum("net").over(B.within([key], ["at"]))
    return B.in_blocks(net, [key], ["at"], count).withColumn("open", running).groupBy(key, B.BLOCK).agg(F.sum("net").alias("net"), F.max("open").alias("peak"))


def peak_concurrency(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """WN-24: most spans open at once per key. Starts and ends are reduced to net changes per instant before the running
    sum, so simultaneous spans arrive as one row; at one instant ends count before starts. A key's instants are cut into blocks, each
    block takes its own running maximum, and what is open when it begins is carried forward from the blocks before."""
    blocks = concurrency_blocks(spans, key, start, end)
    before = B.carried(blocks, [key], "net")
    return B.meet(blocks, before, [key, B.BLOCK]).groupBy(key).agg(F.max(F.col("before") + F.col("peak")).alias("peak"))


# --- features --------------------------------------------------------------------------------------------------------
def with_future_dates(series: DataFrame, horizon: int, keys: Sequence[str] = ("district",)) -> DataFrame:
    """SO-08: observed rows plus the next `horizon` dates without a value; observed dates are never replaced."""
    ahead = series.groupBy(*keys).agg(F.max("date").alias("_hi")).select(
        *keys, F.explode(F.sequence(F.date_add("_hi", 1), F.date_add("_hi", horizon))).alias("date"))
    return series.unionByName(ahead.join(series.select(*keys, "date"), [*keys, "date"], "left_anti"), allowMissingColumns=True)


def lag_features(df: DataFrame, y: str = "y", keys: Sequence[str] = ("district",)) -> DataFrame:
    """WN-10 / WN-12: values n observed rows back, and differences that end one row before the current."""
    w = ordered(keys)
    lags = {f"lag_{n}": F.lag(y, n).over(w) for n in M.LAG_DAYS}
    diffs = {f"diff_{d}": F.lag(y, 1).over(w) - F.lag(y, 1 + d).over(w) for d in M.DIFF_DAYS}
    return df.withColumns({**lags, **diffs})


def rolling_features(df: DataFrame, y: str = "y", keys: Sequence[str] = ("district",)) -> DataFrame:
    """WN-11: statistics over preceding rows only; the spread needs two values and is filled backward, then with zero."""
    w = ordered(keys)
    seven, thirty = w.rowsBetween(-7, -1), w.rowsBetween(-30, -1)
    out = df.withColumns({
        "rolling_mean_7": F.avg(y).over(seven), "rolling_mean_30": F.avg(y).over(thirty),
        "_std": F.when(F.count(y).over(seven) >= 2, F.stddev_samp(y).over(seven)),
        "rolling_min_7": F.min(y).over(seven), "rolling_max_7": F.max(y).over(seven),
    })
    fill = F.first("_std", True).over(w.rowsBetween(0, W.unboundedFollowing))
    return out.withColumn("rolling_std_7", F.coalesce(fill, F.lit(0.0))).drop("_std")


def trend_features(df: DataFrame, keys: Sequence[str] = ("district",)) -> DataFrame:
    """WN-13."""
    index = F.row_number().over(ordered(keys)) - 1
    return df.withColumn("time_index", index).withColumn(
        "trend", F.col("time_index") / F.count("*").over(W.partitionBy(*keys)))


def price_features(df: DataFrame, price: str = "price", keys: Sequence[str] = ("district",)) -> DataFrame:
    """WN-14: a missing price is zero, as is a change that cannot be computed; the mean includes the current row."""
    w = ordered(keys)
    p = F.coalesce(F.col(price), F.lit(0.0)).cast("double")
    out = df.withColumn(price, p).withColumn("_p7", F.lag(price, 7).over(w))
    change = F.when(F.col("_p7") != 0, (F.col(price) - F.col("_p7")) / F.nullif("_p7", F.lit(0.0)) * 100).when(
        (F.col("_p7") == 0) & (F.col(price) > 0), F.lit(float("inf"))).otherwise(0.0)
    return out.withColumns({
        "price_lag_7": F.coalesce("_p7", F.lit(0.0)), "price_trend_7": change,
        "price_rolling_mean_7": F.avg(price).over(w.rowsBetween(-6, 0)),
    }).drop("_p7")


def holiday_features(df: DataFrame) -> DataFrame:
    """WN-15: distances to the neighbouring holidays capped at fourteen days and the long-weekend flag."""
    d, cap = F.col("date"), M.HOLIDAY_SEARCH_RANGE_DAYS
    weekend = F.weekday(d) >= 5
    to = D.days_to_holiday(d, cap)
    since = F.least(F.lit(cap), D.days_since_holiday(F.date_sub(d, 1), cap) + 1)
    season = F.when(F.month(d).isin(12, 1, 2, 3), 1).when(F.month(d).isin(4, 5), 2).when(F.month(d).isin(6, 7, 8, 9), 3).otherwise(4)
    return df.withColumns({
        "is_holiday": D.is_holiday(d).cast("int"), "days_to_holiday": to, "days_from_holiday": since,
        "is_long_weekend": (weekend | (F.weekday(d).isin(0, 4) & (to <= 1))).cast("int"), "season": season,
    })


def calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns(D.calendar_columns("date"))


def month_mean_temperature(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in M.MONTH_MEAN_TEMPERATURE]), month)


def weather_features(df: DataFrame, weather: DataFrame) -> DataFrame:
    """JN-16: the day's weather, else the month's mean temperature and no rain."""
    w = weather.select("date", F.col("temperature").alias("_t"), F.col("precipitation").alias("_r"))
    mean = month_mean_temperature(F.month("date"))
    return df.join(w, "date", "left").withColumns({
        "temperature": F.coalesce("_t", mean), "precipitation": F.coalesce("_r", F.lit(0.0)),
    }).withColumns({
        "temp_deviation": F.col("temperature") - mean,
        "is_good_weather": X.good_weather(F.col("temperature"), F.col("precipitation"), M.WARM_TEMPERATURE).cast("int"),
    }).drop("_t", "_r")


def event_features(df: DataFrame, events: DataFrame, keys: Sequence[str] = ("district",)) -> DataFrame:
    """ML-02: events on the day, events in [-3, +7] days, major-type flag. Daily counts first, then a range frame over
    days; the frame runs over the union of event days and series days, so neighbours outside the series still count."""
    major = F.lower(F.coalesce("event_type", F.lit(""))).rlike("|".join(M.MAJOR_EVENT_TYPES))
    daily = events.groupBy(*keys, F.col("date_start").alias("date")).agg(
        F.count("*").alias("_n"), F.max(major.cast("int")).alias("_major"))
    spine = df.select(*keys, "date").distinct().join(daily, [*keys, "date"], "full")
    lo, hi = M.EVENT_SEARCH_RANGE_DAYS
    w = W.partitionBy(*keys).orderBy(day_number()).rangeBetween(lo, hi)
    counted = spine.select(
        *keys, "date", F.coalesce("_n", F.lit(0)).alias("events_count"),
        F.sum(F.coalesce("_n", F.lit(0))).over(w).alias("events_week"), F.coalesce("_major", F.lit(0)).alias("has_major_event"))
    return df.join(counted, [*keys, "date"])


def feature_matrix(series: DataFrame, weather: DataFrame, events: DataFrame, horizon: int = 0) -> DataFrame:
    """ML-01: all features of a (district, date, y, price) series, with future rows when a horizon is given. The joins and
    windows share the district key, so Spark keeps one partitioning through the chain of windows."""
    rows = with_future_dates(series, horizon) if horizon else series
    rows = event_features(weather_features(rows, weather), events)
    rows = holiday_features(calendar_features(rows))
    return price_features(trend_features(rolling_features(lag_features(rows))))


FEATURES = (
    "day_of_week", "day_of_month", "month", "quarter", "week_of_year", "is_weekend", "is_month_start", "is_month_end",
    "is_holiday", "days_to_holiday", "days_from_holiday", "is_long_weekend", "season",
    "lag_1", "lag_7", "lag_14", "lag_30", "lag_90", "diff_1", "diff_7",
    "rolling_mean_7", "rolling_mean_30", "rolling_std_7", "rolling_min_7", "rolling_max_7",
    "temperature", "precipitation", "temp_deviation", "is_good_weather",
    "events_count", "events_week", "has_major_event", "time_index", "trend",
    "price", "price_lag_7", "price_trend_7", "price_rolling_mean_7",
)


def holdout_features(features: DataFrame, test_days: int = 14, keys: Sequence[str] = ("district",)) -> DataFrame:
    """WN-22: marks the last `test_days` valued rows as test and rewrites their history features so that nothing in the
    test tail is seen: lags that reach into it and rolling statistics take the last training value, differences are 0."""
    valued = features.filter(F.col("y").isNotNull())
    rn = F.row_number().over(ordered(keys, desc=True))
    marked = valued.withColumn("_rn", rn).withColumn("is_test", F.col("_rn") <= test_days)
    w = ordered(keys).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last_train = lambda c: F.last(F.when(~F.col("is_test"), F.col(c)), True).over(w)
    position = F.lit(test_days) - F.col("_rn")  # 0 for the first test row
    new = {}
    for n in M.LAG_DAYS:
        new[f"lag_{n}"] = F.when(F.col("is_test") & (position - n >= 0), last_train("y")).otherwise(F.col(f"lag_{n}"))
    for d in M.DIFF_DAYS:
        new[f"diff_{d}"] = F.when(F.col("is_test"), 0.0).otherwise(F.col(f"diff_{d}"))
    for c in ("rolling_mean_7", "rolling_mean_30", "rolling_std_7", "rolling_min_7", "rolling_max_7"):
        new[c] = F.when(F.col("is_test"), last_train(c)).otherwise(F.col(c))
    return marked.withColumns(new).drop("_rn")
