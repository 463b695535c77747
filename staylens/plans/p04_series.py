"""Time series, features, forecast tables and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens import model as M
from staylens.functions import dates as D
from staylens.functions import factors as FA
from staylens.functions import metrics as X
from staylens.operators import events as E
from staylens.operators import forecasts as C
from staylens.operators import market as K
from staylens.operators import timeseries as T
from staylens.plans import p01_market as P1
from staylens.plans import p02_events as P2
from staylens.plans.p03_text import HD
from staylens.plans.registry import query
from staylens.sources import tables as R

TODAY = "(SELECT today FROM as_of)"


def occ(t):
    return t.district_daily


ROOMS = f"""SELECT district, date, coalesce(sum(rooms_num), 0) AS total_rooms, coalesce(sum(free_rooms_amount), 0) AS free_rooms,
    count(DISTINCT s.id) AS hotels_count FROM {P1.JOINED} WHERE date >= {TODAY} - 365 GROUP BY district, date"""
PACE = f"""SELECT district, date, booked, total_rooms, free_rooms, hotels_count, CASE WHEN total_rooms > 0 THEN booked / total_rooms * 100 ELSE 0 END AS occupancy,
    coalesce(booked - lag(booked) OVER (PARTITION BY district ORDER BY date), 0) AS pickup
    FROM (SELECT *, greatest(0, total_rooms - free_rooms) AS booked FROM ({ROOMS}))"""


def pace(t):
    return T.pickup_pace(K.daily_rooms(t.stats, t.hotels, F.date_sub(t.as_of, 365), ["district"]))


@query("wn04_pickup_pace", f"""SELECT district, CAST(date AS VARCHAR) AS date, CAST(booked AS BIGINT) AS booked, CAST(total_rooms AS BIGINT) AS total_rooms,
    CAST(free_rooms AS BIGINT) AS free_rooms, hotels_count, round(occupancy, 6) AS occupancy, CAST(pickup AS BIGINT) AS pickup FROM ({PACE})""")
def _(t):
    return pace(t)


SUMMARY = f"""WITH p AS ({PACE}), z AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY date) AS a, row_number() OVER (PARTITION BY district ORDER BY date DESC) AS z
      FROM p WHERE pickup <> 0),
    g AS (SELECT district, avg(pickup) AS avg_pickup, max(pickup) AS max_pickup, min(pickup) AS min_pickup, count(*) AS n,
      sum(pickup) FILTER (WHERE z <= 3) / 3 AS r, sum(pickup) FILTER (WHERE a <= 3) / 3 AS e FROM z GROUP BY district)
    SELECT s.district, coalesce(avg_pickup, 0) AS avg_pickup, coalesce(max_pickup, 0) AS max_pickup, coalesce(min_pickup, 0) AS min_pickup,
      CASE WHEN coalesce(n, 0) < 7 THEN 'недостаточно данных' WHEN r > e * 1.2 THEN 'ускорение' WHEN r < e * 0.8 THEN 'замедление' ELSE 'стабильно' END AS trend, samples
    FROM (SELECT district, count(*) AS samples FROM p GROUP BY district) s LEFT JOIN g ON g.district = s.district"""


@query("wn08_pickup_trend", f"""SELECT district, round(avg_pickup, 6) AS avg_pickup, CAST(max_pickup AS BIGINT) AS max_pickup, CAST(min_pickup AS BIGINT) AS min_pickup, trend, samples
    FROM ({SUMMARY})""")
def _(t):
    return T.pickup_summary(pace(t))


@query("sc49_pace_narrative", f"""SELECT district, trend, CASE WHEN trend = 'ускорение' AND avg_pickup > 0 THEN 'growing' WHEN trend = 'замедление' AND avg_pickup < 0 THEN 'slowing'
    WHEN trend IN ('ускорение', 'замедление') THEN 'mixed' ELSE 'no_shift' END AS narrative FROM ({SUMMARY})""")
def _(t):
    return T.pace_narrative(T.pickup_summary(pace(t))).select("district", "trend", "narrative")


KNOWN = f"""SELECT district, date, {P1.OCC} AS occupancy FROM {P1.JOINED} WHERE date >= {TODAY} - 120 AND available_rooms_percent IS NOT NULL GROUP BY district, date"""
PROXY = f"""WITH k AS ({KNOWN}), r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY date DESC) AS rn FROM k)
    SELECT r.district, r.date, r.occupancy AS occupancy_today, p.occupancy AS occupancy_lookback, r.occupancy - p.occupancy AS proxy_pickup_pct
    FROM r LEFT JOIN k p ON p.district = r.district AND p.date = r.date - 7 WHERE rn <= 60"""


def proxy(t):
    return T.proxy_pickup(T.known_occupancy(t.stats, t.hotels, F.date_sub(t.as_of, 120)), 60, 7)


@query("wn05_proxy_pickup", f"""SELECT district, CAST(date AS VARCHAR) AS date, round(occupancy_today, 6) AS occupancy_today, round(occupancy_lookback, 6) AS occupancy_lookback,
    round(proxy_pickup_pct, 6) AS proxy_pickup_pct FROM ({PROXY})""")
def _(t):
    return proxy(t)


@query("wn08_proxy_trend", f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY date DESC) AS z FROM ({PROXY}) WHERE proxy_pickup_pct IS NOT NULL),
    g AS (SELECT district, avg(proxy_pickup_pct) AS a, max(proxy_pickup_pct) AS mx, min(proxy_pickup_pct) AS mn, count(*) AS n, sum(proxy_pickup_pct) FILTER (WHERE z <= 3) AS l FROM x GROUP BY district)
    SELECT district, round(a, 6) AS avg_pct, round(mx, 6) AS max_pct, round(mn, 6) AS min_pct,
    CASE WHEN n < 3 THEN 'стабильно' WHEN l > 0.5 THEN 'ускорение' WHEN l < -0.5 THEN 'замедление' ELSE 'стабильно' END AS trend FROM g""")
def _(t):
    return T.proxy_pickup_summary(proxy(t))


@query("wn06_last_observed_dates", """SELECT district, CAST(date AS VARCHAR) AS date FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY date DESC) AS rn FROM district_daily)
    WHERE rn <= 14""")
def _(t):
    return occ(t).withColumn("rn", F.row_number().over(T.ordered(desc=True))).filter("rn <= 14").select("district", "date")


@query("jn12_calendar_lag_join", """SELECT a.district, CAST(a.date AS VARCHAR) AS date, round(b.occupancy, 6) AS before FROM district_daily a
    LEFT JOIN district_daily b ON b.district = a.district AND b.date = a.date - 28""")
def _(t):
    return occ(t).select("district", "date", T.value_days_before("occupancy", 28).alias("before"))


HALF = """SELECT district, model, predicted_occupancy AS v, row_number() OVER (PARTITION BY district, model ORDER BY forecast_date) AS rn,
    count(*) OVER (PARTITION BY district, model) AS n FROM forecasts WHERE forecast_date >= DATE '2001-10-01'"""


@query("wn09_half_trend", f"""WITH h AS ({HALF}), g AS (SELECT district, model, avg(v) FILTER (WHERE rn <= n // 2) AS a, avg(v) FILTER (WHERE rn > n // 2) AS b, count(*) AS points FROM h GROUP BY district, model)
    SELECT district, model, round(a, 6) AS first_half, round(b, 6) AS second_half, points, round(b - coalesce(a, 0), 6) AS diff,
    CASE WHEN points < 2 THEN 'stable' WHEN b - coalesce(a, 0) > 3 THEN 'growing' WHEN b - coalesce(a, 0) < -3 THEN 'declining' ELSE 'stable' END AS trend FROM g""")
def _(t):
    return T.half_trend(t.forecasts.filter(F.col("forecast_date") >= "2001-10-01"), ["district", "model"], "predicted_occupancy", "forecast_date", 3)


@query("wn18_short_gap_interpolation", f"""WITH s AS (SELECT district, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM district_daily GROUP BY district),
    j AS (SELECT s.district, s.date, o.occupancy AS y FROM s LEFT JOIN district_daily o ON o.district = s.district AND o.date = s.date),
    k AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN date END IGNORE NULLS) OVER a AS pd, last_value(y IGNORE NULLS) OVER a AS pv,
      first_value(CASE WHEN y IS NOT NULL THEN date END IGNORE NULLS) OVER b AS nd, first_value(y IGNORE NULLS) OVER b AS nv FROM j
      WINDOW a AS (PARTITION BY district ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             b AS (PARTITION BY district ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT district, CAST(date AS VARCHAR) AS date, round(y, 6) AS observed, round(CASE WHEN y IS NOT NULL THEN y WHEN nd - pd - 1 <= 7 THEN pv + (nv - pv) * (date - pd) / (nd - pd) END, 6) AS occupancy FROM k
    WHERE district IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST') AND date BETWEEN (SELECT min(date) FROM district_daily) AND (SELECT max(date) FROM district_daily)""")
def _(t):
    return T.interpolate_short_gaps(t.district_daily, "occupancy")


@query("wn19_break_rows", f"""WITH g AS (SELECT id, date, CAST(rooms_num AS DOUBLE) AS v, date - lag(date) OVER (PARTITION BY id ORDER BY date) AS gap FROM hotel_statistics)
    SELECT id, CAST(date AS VARCHAR) AS date, v, FALSE AS is_break FROM g UNION ALL SELECT id, CAST(date AS VARCHAR), NULL, TRUE FROM g WHERE gap > 2""")
def _(t):
    return T.with_breaks(t.stats.withColumn("v", F.col("rooms_num").cast("double")), "v", "id")


@query("wn20_residual_spread", """WITH r AS (SELECT district, occupancy - avg(occupancy) OVER (PARTITION BY district ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS r,
      row_number() OVER (PARTITION BY district ORDER BY date DESC) AS rn FROM district_daily) SELECT district, round(stddev_pop(r), 6) AS spread FROM r WHERE rn <= 30 GROUP BY district""")
def _(t):
    return T.residual_spread(occ(t), "occupancy")


@query("wn17_fill_series", """SELECT id, CAST(date AS VARCHAR) AS date, round(coalesce(last_value(available_rooms_percent IGNORE NULLS) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(available_rooms_percent IGNORE NULLS) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 6) AS pct FROM hotel_statistics""")
def _(t):
    return T.fill_series(t.stats.select("id", "date", F.col("available_rooms_percent").alias("pct")), "pct", ["id"])


FLAGGED = f"""(SELECT a.district, a.date, CASE WHEN d.date IS NULL THEN 0 ELSE 1 END AS is_event FROM district_daily a
    LEFT JOIN ({P2.FESTIVALS}) d ON d.district = a.district AND d.date = a.date)"""


@query("wn16_event_episodes", f"""SELECT district, CAST(sum(CASE WHEN is_event = 1 AND coalesce(p, 0) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS episodes FROM (
    SELECT *, lag(is_event) OVER (PARTITION BY district ORDER BY date) AS p FROM {FLAGGED}) GROUP BY district""")
def _(t):
    from staylens.operators.upsert import panel_dump

    return T.episodes(panel_dump(t.district_daily, P2.event_days(t, "festival")))


ALL_FLAGGED = FLAGGED.replace(P2.FESTIVALS, P2.DAYS)


@query("wn16_event_episodes_all_events", f"""SELECT district, CAST(sum(CASE WHEN is_event = 1 AND coalesce(p, 0) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS episodes FROM (
    SELECT *, lag(is_event) OVER (PARTITION BY district ORDER BY date) AS p FROM {ALL_FLAGGED}) GROUP BY district""")
def _(t):
    from staylens.operators.upsert import panel_dump

    return T.episodes(panel_dump(t.district_daily, P2.event_days(t)))


@query("wn24_peak_concurrency", """WITH m AS (SELECT event_type, ts AS pt, 1 AS n FROM events UNION ALL SELECT event_type, ts + INTERVAL 1 HOUR, -1 FROM events),
    g AS (SELECT event_type, pt, sum(n) AS n FROM m GROUP BY 1, 2), r AS (SELECT event_type, sum(n) OVER (PARTITION BY event_type ORDER BY pt) AS o FROM g)
    SELECT event_type, CAST(max(o) AS BIGINT) AS peak FROM r GROUP BY event_type""")
def _(t):
    spans = t.raw("events").select("event_type", "ts", (F.col("ts") + F.expr("interval 1 hour")).alias("te"))
    return T.peak_concurrency(spans, "event_type", "ts", "te")


# --- features ---------------------------------------------------------------------------------------------------------
W_ = "(PARTITION BY district ORDER BY date%s)"
YS = "(SELECT district, date, occupancy AS y FROM district_daily)"


@query("wn10_lag_features", "SELECT district, CAST(date AS VARCHAR) AS date, " + ", ".join(f"round(lag(y, {n}) OVER {W_ % ''}, 6) AS lag_{n}" for n in M.LAG_DAYS) + f" FROM {YS}")
def _(t):
    rows = T.lag_features(occ(t).withColumnRenamed("occupancy", "y"))
    return rows.select("district", "date", *[f"lag_{n}" for n in M.LAG_DAYS])


ROLL = f"""SELECT district, date, y, avg(y) OVER {W_ % ' ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING'} AS rolling_mean_7, avg(y) OVER {W_ % ' ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING'} AS rolling_mean_30,
    CASE WHEN count(y) OVER {W_ % ' ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING'} >= 2 THEN stddev_samp(y) OVER {W_ % ' ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING'} END AS s,
    min(y) OVER {W_ % ' ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING'} AS rolling_min_7, max(y) OVER {W_ % ' ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING'} AS rolling_max_7 FROM {YS}"""


@query("wn11_rolling_features", f"""SELECT district, CAST(date AS VARCHAR) AS date, round(rolling_mean_7, 6) AS rolling_mean_7, round(rolling_mean_30, 6) AS rolling_mean_30,
    round(coalesce(first_value(s IGNORE NULLS) OVER {W_ % ' ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING'}, 0), 6) AS rolling_std_7, round(rolling_min_7, 6) AS rolling_min_7,
    round(rolling_max_7, 6) AS rolling_max_7 FROM ({ROLL})""")
def _(t):
    return T.rolling_features(occ(t).withColumnRenamed("occupancy", "y")).drop("y")


@query("wn12_differences", f"""SELECT district, CAST(date AS VARCHAR) AS date, round(lag(y, 1) OVER {W_ % ''} - lag(y, 2) OVER {W_ % ''}, 6) AS diff_1,
    round(lag(y, 1) OVER {W_ % ''} - lag(y, 8) OVER {W_ % ''}, 6) AS diff_7 FROM {YS}""")
def _(t):
    return T.lag_features(occ(t).withColumnRenamed("occupancy", "y")).select("district", "date", "diff_1", "diff_7")


@query("wn13_trend_index", f"""SELECT district, CAST(date AS VARCHAR) AS date, CAST(i AS INTEGER) AS time_index, round(i / CAST(n AS DOUBLE), 6) AS trend FROM (
    SELECT *, row_number() OVER {W_ % ''} - 1 AS i, count(*) OVER (PARTITION BY district) AS n FROM {YS})""")
def _(t):
    return T.trend_features(occ(t)).drop("occupancy")


PR = f"(SELECT district, date, avg_price AS p FROM ({P1.SERIES}))"


@query("wn14_price_features", f"""SELECT district, CAST(date AS VARCHAR) AS date, round(coalesce(p, 0), 6) AS price, round(coalesce(l, 0), 6) AS price_lag_7,
    CASE WHEN l IS NULL OR l = 0 THEN 0 ELSE round((coalesce(p, 0) - l) / l * 100, 6) END AS price_trend_7, round(m, 6) AS price_rolling_mean_7 FROM (
    SELECT *, lag(coalesce(p, 0), 7) OVER {W_ % ''} AS l, avg(coalesce(p, 0)) OVER {W_ % ' ROWS BETWEEN 6 PRECEDING AND CURRENT ROW'} AS m FROM {PR})""")
def _(t):
    return T.price_features(P1.series(t).select("district", "date", F.col("avg_price").alias("price")))


NEXT = f"""h AS (SELECT CAST(y || '-' || md AS DATE) AS hd FROM (SELECT unnest(range(1993, 2004)) AS y), (SELECT unnest({HD}) AS md)),
    x AS (SELECT DISTINCT date AS d FROM hotel_statistics),
    n AS (SELECT d, least(14, min(hd - d) FILTER (WHERE hd >= d)) AS k, least(14, min(d - hd) FILTER (WHERE hd < d)) AS b FROM x, h GROUP BY d)"""


@query("wn15_holiday_distances", f"""WITH {NEXT} SELECT CAST(d AS VARCHAR) AS date, CAST(k = 0 AS INTEGER) AS is_holiday, CAST(k AS INTEGER) AS days_to_holiday, CAST(b AS INTEGER) AS days_from_holiday,
    CAST(isodow(d) >= 6 OR (isodow(d) IN (1, 5) AND k <= 1) AS INTEGER) AS is_long_weekend,
    CASE WHEN month(d) IN (12, 1, 2, 3) THEN 1 WHEN month(d) IN (4, 5) THEN 2 WHEN month(d) IN (6, 7, 8, 9) THEN 3 ELSE 4 END AS season FROM n""")
def _(t):
    return T.holiday_features(t.stats.select("date").distinct())


def mean_weather(t):
    return t.weather.select("date", ((F.col("temperature_max") + F.col("temperature_min")) / 2).alias("temperature"), "precipitation")


MT = "([" + ", ".join(str(v) for v in M.MONTH_MEAN_TEMPERATURE) + "])[month(x.date)]"
WX = f"""SELECT x.date, coalesce((temperature_max + temperature_min) / 2, {MT}) AS temperature, coalesce(precipitation, 0) AS precipitation,
    coalesce((temperature_max + temperature_min) / 2, {MT}) - {MT} AS temp_deviation FROM (SELECT DISTINCT date FROM hotel_statistics) x LEFT JOIN weather w ON w.date = x.date"""


@query("jn16_weather_with_fallback", f"""SELECT CAST(date AS VARCHAR) AS date, CAST(temperature AS DOUBLE) AS temperature, CAST(precipitation AS DOUBLE) AS precipitation,
    CAST(temp_deviation AS DOUBLE) AS temp_deviation, CAST(temperature > 15 AND precipitation < 5 AS INTEGER) AS is_good_weather FROM ({WX})""")
def _(t):
    return T.weather_features(t.stats.select("date").distinct(), mean_weather(t))


EVD = f"(SELECT a.district, e.date_start AS date, e.event_type FROM ({P2.ASSIGNED}) a JOIN cal_events e ON e.event_id = a.event_id)"


def district_events(t):
    return E.by_district(t.cal_events, P2.gazetteer(t))


EVF = f"""SELECT s.district, s.date, coalesce(max(n) FILTER (WHERE d.date = s.date), 0) AS events_count, coalesce(sum(n), 0) AS events_week, coalesce(max(m) FILTER (WHERE d.date = s.date), 0) AS has_major_event
    FROM district_daily s LEFT JOIN (SELECT district, date, count(*) AS n, max(CAST(event_type IN ('concert', 'festival', 'sport') AS INTEGER)) AS m FROM {EVD} GROUP BY 1, 2) d
    ON d.district = s.district AND d.date BETWEEN s.date - 3 AND s.date + 7 GROUP BY s.district, s.date"""


@query("ml02_event_features", f"""SELECT district, CAST(date AS VARCHAR) AS date, CAST(events_count AS BIGINT) AS events_count, CAST(events_week AS BIGINT) AS events_week,
    CAST(has_major_event AS INTEGER) AS has_major_event FROM ({EVF})""")
def _(t):
    return T.event_features(occ(t), district_events(t)).drop("occupancy")


def features(t, horizon=0):
    # occupancy and price of a district's day from one pass over the facts
    priced = t.stats.withColumn("_price", F.when(F.col("rooms_num") > 0, F.col("min_price")))
    rows = K.with_hotel(priced, t.hotels, "district").groupBy("district", "date").agg(X.weighted_occupancy().alias("y"), X.median_price("_price").alias("price"))
    return T.feature_matrix(rows, mean_weather(t), district_events(t), horizon)


@query("ml01_feature_matrix", f"""WITH {NEXT}, r AS ({ROLL}), w AS ({WX}), e AS ({EVF}), p AS {PR},
    f AS (SELECT r.*, row_number() OVER (PARTITION BY r.district ORDER BY r.date) - 1 AS i, lag(y, 7) OVER (PARTITION BY r.district ORDER BY r.date) AS lag_7,
      coalesce(first_value(s IGNORE NULLS) OVER (PARTITION BY r.district ORDER BY r.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS sd FROM r)
    SELECT f.district, CAST(f.date AS VARCHAR) AS date, round(y, 6) AS y, round(f.lag_7, 6) AS lag_7, round(sd, 6) AS rolling_std_7, round(rolling_mean_30, 6) AS rolling_mean_30,
      CAST(i AS INTEGER) AS time_index, CAST(isodow(f.date) - 1 AS INTEGER) AS day_of_week, CAST(k AS INTEGER) AS days_to_holiday, CAST(w.temperature AS DOUBLE) AS temperature,
      CAST(e.events_week AS BIGINT) AS events_week, round(coalesce(p.p, 0), 6) AS price
    FROM f JOIN n ON n.d = f.date JOIN w ON w.date = f.date JOIN e ON e.district = f.district AND e.date = f.date LEFT JOIN p ON p.district = f.district AND p.date = f.date""")
def _(t):
    return features(t).select("district", "date", "y", "lag_7", "rolling_std_7", "rolling_mean_30", "time_index", "day_of_week", "days_to_holiday", "temperature", "events_week", "price")


@query("so08_future_rows", """SELECT district, CAST(date AS VARCHAR) AS date, round(occupancy, 6) AS occupancy FROM district_daily
    UNION ALL SELECT district, CAST(max(date) + CAST(i AS INTEGER) AS VARCHAR), NULL FROM district_daily, (SELECT unnest(range(1, 15)) AS i) GROUP BY district, i""")
def _(t):
    return T.with_future_dates(occ(t), 14)


BASE22 = "SELECT district, date, " + ", ".join(f"lag(y, {n}) OVER {W_ % ''} AS lag_{n}" for n in M.LAG_DAYS) + f""", lag(y, 1) OVER {W_ % ''} - lag(y, 2) OVER {W_ % ''} AS diff_1,
    lag(y, 1) OVER {W_ % ''} - lag(y, 8) OVER {W_ % ''} AS diff_7, avg(y) OVER {W_ % ' ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING'} AS rolling_mean_7,
    max(y) OVER {W_ % ' ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING'} AS rolling_max_7, row_number() OVER (PARTITION BY district ORDER BY date DESC) AS rn, y FROM {YS}"""
TRAIN22 = lambda c: f"last_value(CASE WHEN rn > 14 THEN {c} END IGNORE NULLS) OVER {W_ % ' ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING'}"
KEPT22 = ("district", "date", "is_test", *[f"lag_{n}" for n in M.LAG_DAYS], "diff_1", "diff_7", "rolling_mean_7", "rolling_max_7")


@query("wn22_holdout_features", f"SELECT district, CAST(date AS VARCHAR) AS date, rn <= 14 AS is_test, " + ", ".join(
    f"round(CASE WHEN rn <= 14 AND 14 - rn - {n} >= 0 THEN {TRAIN22('y')} ELSE lag_{n} END, 6) AS lag_{n}" for n in M.LAG_DAYS) + ", " + ", ".join(
    f"round(CASE WHEN rn <= 14 THEN 0 ELSE diff_{n} END, 6) AS diff_{n}" for n in M.DIFF_DAYS) + ", " + ", ".join(
    f"round(CASE WHEN rn <= 14 THEN {TRAIN22(c)} ELSE {c} END, 6) AS {c}" for c in ("rolling_mean_7", "rolling_max_7")) + f" FROM ({BASE22})")
def _(t):
    return T.holdout_features(T.rolling_features(T.lag_features(occ(t).withColumnRenamed("occupancy", "y")))).select(*KEPT22)


# --- forecasts --------------------------------------------------------------------------------------------------------
PAIRS = """(SELECT f.district, model, forecast_date, horizon, predicted_occupancy AS f, d.occupancy AS a, confidence_lower AS lo, confidence_upper AS hi
    FROM forecasts f JOIN district_daily d ON d.district = f.district AND d.date = f.forecast_date)"""


def pairs(t, model=None):
    return C.forecast_vs_actual(t.forecasts, occ(t), model)


@query("jn14_forecast_vs_actual", f"""SELECT district, model, CAST(forecast_date AS VARCHAR) AS forecast_date, horizon, round(f, 6) AS forecast, round(a, 6) AS actual, round(lo, 6) AS lower,
    round(hi, 6) AS upper, TRUE AS has_interval FROM {PAIRS} WHERE model = 'ensemble'""")
def _(t):
    return pairs(t, "ensemble")


@query("so06_common_dates", "SELECT DISTINCT CAST(forecast_date AS VARCHAR) AS date FROM forecasts INTERSECT SELECT CAST(date AS VARCHAR) FROM district_daily")
def _(t):
    return t.forecasts.select(F.col("forecast_date").alias("date")).intersect(occ(t).select("date"))


METRICS = """count(*) AS n, sqrt(avg((f - a) ** 2)) AS rmse, avg(abs(f - a)) AS mae, CASE WHEN max(a) > min(a) THEN 1 - sum((f - a) ** 2) / (count(*) * var_pop(a)) END AS r2,
    avg(abs(f - a) / a * 100) FILTER (WHERE a >= 1) AS mape, avg(f - a) AS bias"""
R6 = lambda cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)


@query("ml10_error_metrics", f"SELECT district, model, n, {R6(['rmse', 'mae', 'r2', 'mape', 'bias'])} FROM (SELECT district, model, {METRICS} FROM {PAIRS} GROUP BY district, model)")
def _(t):
    return C.error_metrics(pairs(t), ["district", "model"])


@query("ml11_interval_coverage", f"""SELECT district, count(*) AS samples, round(sqrt(avg((f - a) ** 2)), 6) AS rmse, round(avg(abs(f - a)), 6) AS mae,
    CASE WHEN count(*) >= 3 THEN round(avg(CASE WHEN a BETWEEN lo AND hi THEN 1.0 ELSE 0 END), 6) END AS ci_coverage FROM {PAIRS} WHERE model = 'ensemble' GROUP BY district""")
def _(t):
    return C.interval_coverage(pairs(t, "ensemble"))


def weights(t):
    return C.inverse_rmse_weights(C.error_metrics(pairs(t), ["district", "model"])).select("district", "model", "rmse", "weight")


WEIGHTS = f"(SELECT district, model, rmse, 1 / (rmse + 0.1) / sum(1 / (rmse + 0.1)) OVER (PARTITION BY district) AS weight FROM (SELECT district, model, {METRICS} FROM {PAIRS} GROUP BY district, model))"


@query("ml08_inverse_rmse_weights", f"SELECT district, model, {R6(['rmse', 'weight'])} FROM {WEIGHTS}")
def _(t):
    return weights(t)


@query("ml07_simple_average", """SELECT district, CAST(forecast_date AS VARCHAR) AS forecast_date, round(least(100.0, greatest(0.0, avg(predicted_occupancy))), 6) AS occupancy,
    round(avg(confidence_lower), 6) AS lower_bound, round(avg(confidence_upper), 6) AS upper_bound, count(*) AS models FROM forecasts GROUP BY district, forecast_date""")
def _(t):
    return C.simple_average(t.forecasts)


@query("ml07_weighted_average", f"""WITH p AS (SELECT f.*, coalesce(weight, 0.33) AS w FROM forecasts f LEFT JOIN {WEIGHTS} q ON q.district = f.district AND q.model = f.model),
    m AS (SELECT district, forecast_date, sum(predicted_occupancy * w) / sum(w) AS m FROM p GROUP BY 1, 2),
    g AS (SELECT p.district, p.forecast_date, any_value(m) AS m, sqrt(sum(w * (predicted_occupancy - m) ** 2) / sum(w)) AS s, sum(w * (confidence_upper - confidence_lower) / 2) / sum(w) AS h
      FROM p JOIN m ON m.district = p.district AND m.forecast_date = p.forecast_date GROUP BY 1, 2)
    SELECT district, CAST(forecast_date AS VARCHAR) AS forecast_date, round(least(100.0, greatest(0.0, m)), 6) AS occupancy, round(greatest(0.0, m - h - s), 6) AS lower_bound,
    round(least(100.0, m + h + s), 6) AS upper_bound FROM g""")
def _(t):
    return C.weighted_average(t.forecasts, weights(t))


@query("ml07_best_model", """WITH p AS MATERIALIZED (SELECT district, model, forecast_date, predicted_occupancy AS f FROM forecasts),
    d AS MATERIALIZED (SELECT district, date, occupancy AS a FROM district_daily),
    e AS (SELECT p.district, p.model, sqrt(avg((f - a) ** 2)) AS rmse FROM p JOIN d ON d.district = p.district AND d.date = p.forecast_date GROUP BY 1, 2),
    b AS (SELECT district, arg_min(model, (rmse, model)) AS model FROM e GROUP BY district)
    SELECT p.district, p.model, CAST(forecast_date AS VARCHAR) AS forecast_date, round(f, 6) AS predicted_occupancy FROM p JOIN b ON b.district = p.district AND b.model = p.model""")
def _(t):
    return C.best_model(t.forecasts, weights(t)).select("district", "model", "forecast_date", "predicted_occupancy")


def origins(t):
    return C.rolling_origins(occ(t), 7, 5, 200)


OBS = """(WITH r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY district) AS n FROM district_daily),
    o AS (SELECT district, date AS origin, occupancy AS naive FROM r WHERE i >= 200 AND i < n - 7 AND (i - 200) % 5 = 0),
    p AS (SELECT o.*, CAST(h AS INTEGER) AS h, origin + CAST(h AS INTEGER) AS target FROM o, (SELECT unnest(range(1, 8)) AS h))
    SELECT p.*, a.occupancy AS actual, s.occupancy AS seasonal_naive, w.occupancy AS same_weekday FROM p JOIN district_daily a ON a.district = p.district AND a.date = p.target
    LEFT JOIN district_daily s ON s.district = p.district AND s.date = p.origin - 6 LEFT JOIN district_daily w ON w.district = p.district AND w.date = p.target - 7)"""


@query("ml13_rolling_origins", f"""SELECT district, CAST(origin AS VARCHAR) AS origin, h, CAST(target AS VARCHAR) AS target, {R6(['naive', 'actual', 'seasonal_naive', 'same_weekday'])} FROM {OBS}""")
def _(t):
    return origins(t)


@query("ml13_backtest_report", f"""WITH j AS (SELECT o.*, f.model, f.predicted_occupancy AS f, CASE WHEN origin < DATE '2000-01-01' THEN 'before' ELSE 'after' END AS regime FROM {OBS} o
      JOIN forecasts f ON f.district = o.district AND f.origin_date = o.origin AND f.forecast_date = o.target)
    SELECT model, h, regime, count(*) AS n, round(avg(abs(f - actual)), 6) AS mae, round(sqrt(avg((f - actual) ** 2)), 6) AS rmse, round(avg(f - actual), 6) AS bias,
    round(avg(abs(naive - actual)), 6) AS mae_naive, round(avg(abs(seasonal_naive - actual)), 6) AS mae_seasonal_naive, round(avg(abs(same_weekday - actual)), 6) AS mae_same_weekday
    FROM j GROUP BY model, h, regime""")
def _(t):
    return C.backtest_report(origins(t), t.forecasts, F.lit("2000-01-01").cast("date"))


@query("ml14_paired_bootstrap")
def _(t):
    obs = origins(t)
    rows = obs.select("district", "origin", "h", (F.col("same_weekday") - F.col("actual")).alias("m"), (F.col("naive") - F.col("actual")).alias("n")).filter("m IS NOT NULL")
    return C.paired_bootstrap(rows, ["h"], "m", "n")


@query("ml23_fallback_forecast", """WITH b AS (SELECT district, avg(occupancy) AS b, max(date) AS d FROM district_daily GROUP BY district),
    x AS (SELECT district, d + CAST(h AS INTEGER) AS forecast_date, CAST(h AS INTEGER) AS h, least(100.0, greatest(0.0, b + (h % 7 - 3) * 2)) AS o FROM b, (SELECT unnest(range(1, 15)) AS h))
    SELECT district, CAST(forecast_date AS VARCHAR) AS forecast_date, h, round(o, 6) AS occupancy, round(greatest(0.0, o - 15), 6) AS lower_bound, round(least(100.0, o + 15), 6) AS upper_bound FROM x""")
def _(t):
    return C.fallback_forecast(occ(t), 14)


@query("ml22_fingerprint", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY date) AS a, row_number() OVER (PARTITION BY district ORDER BY date DESC) AS z,
      count(*) OVER (PARTITION BY district) AS n, CAST(date AS VARCHAR) || '=' || printf('%.4f', occupancy) AS item FROM district_daily),
    h AS (SELECT district, max(n) AS n, string_agg(item, ',' ORDER BY item) FILTER (WHERE a <= 3) AS f, string_agg(item, ',' ORDER BY item) FILTER (WHERE z <= 5) AS l FROM r WHERE a <= 3 OR z <= 5 GROUP BY district)
    SELECT district, left(sha256(n || '#' || f || '#' || l || '#' || (SELECT min(date) || '|' || max(date) FROM weather) || '#' ||
      (SELECT count(*) || '|' || min(date_start) || '|' || max(date_start) FROM cal_events) || '#v1'), 16) AS fingerprint FROM h""")
def _(t):
    return C.fingerprint(occ(t), t.weather, t.cal_events, "v1")


@query("ag42_horizon_card", """SELECT district, round(avg(predicted_occupancy), 6) AS avg_occupancy, round(max(predicted_occupancy), 6) AS max_occupancy, round(min(predicted_occupancy), 6) AS min_occupancy
    FROM forecasts WHERE model = 'ensemble' AND forecast_date > (SELECT today FROM as_of) - 7 GROUP BY district""")
def _(t):
    return C.horizon_card(t.forecasts.filter((F.col("model") == "ensemble") & (F.col("forecast_date") > F.date_sub(t.as_of, 7))))


@query("sc48_value_at_date", """SELECT district, model, round(coalesce(max(predicted_occupancy) FILTER (WHERE forecast_date = DATE '1999-05-05'), arg_min(predicted_occupancy, forecast_date)), 6) AS occupancy
    FROM forecasts GROUP BY district, model""")
def _(t):
    return C.value_at(t.forecasts, F.lit("1999-05-05").cast("date"))


@query("jn11_nearest_in_time", f"""SELECT district, CAST(date AS VARCHAR) AS date, round(occupancy, 6) AS occupancy, CAST(distance AS INTEGER) AS distance FROM (
    SELECT *, abs(date - DATE '1997-06-28') AS distance, row_number() OVER (PARTITION BY district ORDER BY abs(date - DATE '1997-06-28'), date) AS rn FROM district_daily) WHERE rn = 1 AND distance <= 7""")
def _(t):
    return C.nearest_in_time(t.district_daily, F.lit("1997-06-28").cast("date"))


@query("jn11_nearest_across_a_gap", f"""SELECT district, CAST(date AS VARCHAR) AS date, round(occupancy, 6) AS occupancy, CAST(distance AS INTEGER) AS distance FROM (
    SELECT *, abs(date - DATE '1997-06-28') AS distance, row_number() OVER (PARTITION BY district ORDER BY abs(date - DATE '1997-06-28'), date) AS rn FROM district_daily
    WHERE date NOT BETWEEN DATE '1997-06-26' AND DATE '1997-06-30' AND (district <> 'ASIA' OR date NOT BETWEEN DATE '1997-06-20' AND DATE '1997-07-06')) WHERE rn = 1 AND distance <= 7""")
def _(t):
    """Five days are missing everywhere, in one district more than the search reaches: the earlier of two equally near days, or none."""
    missing = F.col("date").between("1997-06-26", "1997-06-30") | ((F.col("district") == "ASIA") & F.col("date").between("1997-06-20", "1997-07-06"))
    return C.nearest_in_time(t.district_daily.filter(~missing), F.lit("1997-06-28").cast("date"))


@query("jn15_merged_series", f"""WITH u AS (SELECT district, date, occupancy AS a, NULL AS f, NULL AS lo, NULL AS hi FROM district_daily
      UNION ALL SELECT district, forecast_date, NULL, predicted_occupancy, confidence_lower, confidence_upper FROM forecasts WHERE model = 'ensemble'
      UNION ALL SELECT district, {TODAY} + CAST(i AS INTEGER), NULL, NULL, NULL, NULL FROM (SELECT DISTINCT district FROM district_daily), (SELECT unnest(range(1, 15)) AS i))
    SELECT district, CAST(date AS VARCHAR) AS date, round(max(a), 6) AS factual, round(max(f), 6) AS forecast, round(max(lo), 6) AS lower, round(max(hi), 6) AS upper FROM u GROUP BY district, date""")
def _(t):
    return C.merged_series(occ(t), t.forecasts.filter(F.col("model") == "ensemble"), t.as_of)


@query("jn15_wide_models", "SELECT district, CAST(forecast_date AS VARCHAR) AS forecast_date, " + ", ".join(
    f"round(max(predicted_occupancy) FILTER (WHERE model = '{m}'), 6) AS {m}" for m in ("trees", "additive", "ensemble")) + " FROM forecasts GROUP BY district, forecast_date")
def _(t):
    return C.wide_models(t.forecasts, ["trees", "additive", "ensemble"])


SCORE = "least(100.0, greatest(0.0, greatest(0.0, 100 - o) + CASE WHEN temp IS NULL THEN 0 ELSE least(20.0, greatest(-10.0, temp) * 0.7) END - 3 * n))"
BD = f"""SELECT district, forecast_date, o, temp, n, {SCORE} AS score, row_number() OVER (PARTITION BY district ORDER BY {SCORE} DESC, forecast_date) AS place FROM (
    SELECT f.district, f.forecast_date, predicted_occupancy AS o, temperature_max AS temp, coalesce(n, 0) AS n FROM forecasts f LEFT JOIN weather w ON w.date = f.forecast_date
    LEFT JOIN (SELECT date_start, count(*) AS n FROM cal_events GROUP BY 1) e ON e.date_start = f.forecast_date WHERE model = 'ensemble' AND f.forecast_date >= (SELECT today FROM event_today))"""


@query("jn18_best_dates", f"""SELECT district, CAST(forecast_date AS VARCHAR) AS forecast_date, round(o, 6) AS occupancy, temp AS temperature, n AS n_events, round(score, 6) AS score,
    CAST(place AS INTEGER) AS place FROM ({BD}) WHERE place <= 5""")
def _(t):
    return C.best_dates(t.forecasts.filter(F.col("model") == "ensemble"), t.weather, t.cal_events, t.event_today)


@query("sc30_trip_scores", f"SELECT district, CAST(forecast_date AS VARCHAR) AS forecast_date, round(score, 6) AS score FROM ({BD})")
def _(t):
    return C.best_dates(t.forecasts.filter(F.col("model") == "ensemble"), t.weather, t.cal_events, t.event_today, 1 << 30).select("district", "forecast_date", "score")


@query("st02_top_dates", f"SELECT district, CAST(forecast_date AS VARCHAR) AS forecast_date FROM ({BD}) WHERE place <= 3")
def _(t):
    return C.best_dates(t.forecasts.filter(F.col("model") == "ensemble"), t.weather, t.cal_events, t.event_today, 3).select("district", "forecast_date")


FWEEK = "forecast_date BETWEEN (SELECT today FROM as_of) AND (SELECT today FROM as_of) + 7"


def week_ahead(t):
    return t.forecasts.filter((F.col("model") == "additive") & F.col("forecast_date").between(t.as_of, F.date_add(t.as_of, 7)))


PCT = "CASE WHEN f > 75 THEN least(30, round_even((f - 60) * 0.8, 0)) WHEN f > 55 THEN least(15, round_even((f - 50) * 0.5, 0)) WHEN f < 35 THEN -least(25, round_even((40 - f) * 0.8, 0)) ELSE 0 END"


@query("sc31_price_advice", f"""WITH r AS (SELECT s.district, median_price, avg_occupancy, coalesce(f, avg_occupancy) AS f FROM ({P1.SNAP}) s
      LEFT JOIN (SELECT district, avg(predicted_occupancy) AS f FROM forecasts WHERE model = 'additive' AND {FWEEK} GROUP BY district) w ON w.district = s.district WHERE median_price > 0)
    SELECT district, round(median_price, 6) AS current_price, round(avg_occupancy, 6) AS current_occupancy, round(f, 6) AS forecast_occupancy, {PCT} AS percent,
    round(median_price * (1 + {PCT} / 100), 6) AS recommended_price FROM r""")
def _(t):
    return C.price_advice(P1.snapshot(t), week_ahead(t))


@query("ag40_trip_summary", f"""WITH h AS (SELECT district, predicted_occupancy AS v, row_number() OVER (PARTITION BY district ORDER BY forecast_date) AS rn, count(*) OVER (PARTITION BY district) AS n
      FROM forecasts WHERE model = 'additive' AND {FWEEK}),
    g AS (SELECT district, avg(v) AS f, avg(v) FILTER (WHERE rn > n // 2) - coalesce(avg(v) FILTER (WHERE rn <= n // 2), 0) AS d, count(*) AS n FROM h GROUP BY district),
    e AS (SELECT * FROM cal_events WHERE date_start BETWEEN {P2.TODAY} AND {P2.TODAY} + 14)
    SELECT g.district, round(f, 6) AS forecast_occupancy, CASE WHEN f < 40 THEN 'low' WHEN f > 70 THEN 'high' ELSE 'medium' END AS level,
    CASE WHEN n < 2 THEN 'stable' WHEN d > 3 THEN 'growing' WHEN d < -3 THEN 'declining' ELSE 'stable' END AS trend, (SELECT count(*) FROM e) AS events_count,
    (SELECT string_agg(title, '; ' ORDER BY date_start, event_id) FROM (SELECT * FROM e ORDER BY date_start, event_id LIMIT 3)) AS first_events,
    coalesce(free_rooms, 0) AS available_rooms, round(median_price, 6) AS avg_price FROM g LEFT JOIN ({P1.SNAP}) s ON s.district = g.district""")
def _(t):
    return C.trip_summary(week_ahead(t), t.cal_events, P1.snapshot(t), t.event_today, 14)


@query("ag37_insights", f"""WITH k AS (SELECT avg_occupancy AS occ FROM ({P1.TOTALS})),
    h AS (SELECT predicted_occupancy AS v, row_number() OVER (ORDER BY forecast_date) AS rn, count(*) OVER () AS n FROM forecasts WHERE model = 'ensemble' AND district = 'ASIA' AND forecast_date > {TODAY} - 30),
    g AS (SELECT avg(v) FILTER (WHERE rn > n // 2) - avg(v) FILTER (WHERE rn <= n // 2) AS d, count(*) AS n FROM h),
    w AS (SELECT avg(temperature_max) AS t, count(*) FILTER (WHERE precipitation > 1) AS rain, count(*) AS n FROM weather WHERE date >= DATE '2001-06-01'),
    e AS (SELECT count(*) AS n FROM cal_events WHERE date_start >= {P2.TODAY}),
    u AS (SELECT 1 AS rank, CASE WHEN occ > 0 AND occ < 40 THEN 'quiet' WHEN occ BETWEEN 40 AND 70 THEN 'moderate' WHEN occ > 70 THEN 'busy' END AS rule, occ AS metric FROM k
      UNION ALL SELECT 2, CASE WHEN d > 5 THEN 'rising' WHEN d < -5 THEN 'falling' ELSE 'steady' END, d FROM g WHERE n >= 4
      UNION ALL SELECT 3, CASE WHEN t > 20 THEN 'warm' WHEN t < 0 THEN 'cold' END, t FROM w UNION ALL SELECT 4, CASE WHEN rain > n / 2 THEN 'rainy' END, rain FROM w
      UNION ALL SELECT 5, CASE WHEN n > 3 THEN 'many_events' END, n FROM e)
    SELECT rank, rule, round(CAST(metric AS DOUBLE), 6) AS metric FROM u WHERE rule IS NOT NULL ORDER BY rank LIMIT 4""")
def _(t):
    occupancy = P1.totals(t).select(F.col("avg_occupancy").alias("occ"))
    points = t.forecasts.filter((F.col("model") == "ensemble") & (F.col("district") == "ASIA") & (F.col("forecast_date") > F.date_sub(t.as_of, 30)))
    n = E.upcoming(t.cal_events, t.event_today).agg(F.count("*")).scalar()
    return C.insights(occupancy, points, t.weather.filter(F.col("date") >= "2001-06-01"), n)


@query("src15_saved_forecasts", """SELECT district, CAST(forecast_date AS VARCHAR) AS forecast_date, round(predicted_occupancy, 6) AS predicted_occupancy, round(confidence_lower, 6) AS confidence_lower,
    round(confidence_upper, 6) AS confidence_upper FROM forecasts WHERE model = 'ensemble' AND forecast_date IN (SELECT date_start FROM cal_events WHERE event_type = 'sport')""")
def _(t):
    dates = t.cal_events.filter(F.col("event_type") == "sport").select(F.col("date_start").alias("date"))
    return R.saved_forecasts(t.forecasts, dates)


@query("src16_model_history", f"""WITH u AS (SELECT 'd:' || district AS entity, date, avg_occupancy AS occupancy FROM ({P1.SERIES})
      UNION ALL SELECT 'h:' || id, date, 100 - coalesce(available_rooms_percent, 0) FROM hotel_statistics), c AS (SELECT *, count(*) OVER (PARTITION BY entity) AS points FROM u)
    SELECT entity, CAST(date AS VARCHAR) AS date, round(occupancy, 6) AS occupancy, points FROM c WHERE points >= 560""")
def _(t):
    return R.model_history(P1.series(t), t.stats, 560)


@query("src17_model_holidays", f"""WITH x AS (SELECT min(date) AS lo, max(date) + 90 AS hi FROM district_daily),
    h AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM x),
    u AS (SELECT d AS date, {"([" + ", ".join(f"'{n}'" for _, _, n in D.PUBLIC_HOLIDAYS) + "])"}[list_position({HD}, strftime(d, '%m-%d'))] AS holiday, -2 AS lo, 2 AS hi, 0 AS r, '' AS id
        FROM h WHERE list_contains({HD}, strftime(d, '%m-%d')) UNION ALL SELECT date_start, title, 0, 0, 1, event_id FROM cal_events)
    SELECT CAST(date AS VARCHAR) AS date, holiday, CAST(lo AS INTEGER) AS lower_window, CAST(hi AS INTEGER) AS upper_window FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY r, id) AS rn FROM u) WHERE rn = 1""")
def _(t):
    return R.model_holidays(occ(t), t.cal_events)


@query("sc33_demand_factors", f"""WITH x AS (SELECT s.date AS d, n, temperature_max AS temp FROM (SELECT DISTINCT date FROM hotel_statistics) s
      LEFT JOIN (SELECT date_start, count(*) AS n FROM cal_events GROUP BY 1) e ON e.date_start = s.date LEFT JOIN weather w ON w.date = s.date),
    u AS (SELECT d, 'holiday' AS name, 15.0 AS impact FROM x WHERE list_contains({HD}, strftime(d, '%m-%d')) UNION ALL SELECT d, 'weekend', 8 FROM x WHERE isodow(d) >= 6
      UNION ALL SELECT d, 'high_season', 20 FROM x WHERE month(d) IN (6, 7, 8) UNION ALL SELECT d, 'winter_season', 10 FROM x WHERE month(d) IN (12, 1, 2, 3)
      UNION ALL SELECT d, 'offseason', -10 FROM x WHERE month(d) IN (10, 11) UNION ALL SELECT d, 'events', 5 * n FROM x WHERE n > 0
      UNION ALL SELECT d, 'warm_weather', 5 FROM x WHERE temp > 15 UNION ALL SELECT d, 'cold_weather', -5 FROM x WHERE temp < -15)
    SELECT CAST(d AS VARCHAR) AS date, name, CAST(impact AS DOUBLE) AS impact, CASE WHEN impact > 0 THEN 'positive' ELSE 'negative' END AS direction FROM u""")
def _(t):
    ev = t.cal_events.groupBy(F.col("date_start").alias("date")).agg(F.count("*").alias("n"))
    days = t.stats.select("date").distinct().join(ev, "date", "left").join(t.weather.select("date", "temperature_max"), "date", "left")
    return days.select("date", F.inline(FA.demand_factors(F.col("date"), F.col("n"), F.col("temperature_max"))))


IMP = """(SELECT * FROM (SELECT 'lag_' || l_linenumber AS feature, round(sum(l_quantity) / 1000, 6) AS importance FROM lineitem GROUP BY 1
    UNION ALL SELECT 'price_' || l_returnflag, round(sum(l_quantity) / 1000, 6) FROM lineitem GROUP BY 1 UNION ALL SELECT 'month_' || l_linestatus, round(sum(l_quantity) / 1000, 6) FROM lineitem GROUP BY 1))"""


def importances(t):
    li = t.raw("lineitem")
    part = lambda prefix, c: li.groupBy(F.concat(F.lit(prefix), F.col(c).cast("string")).alias("feature")).agg(F.round(F.sum("l_quantity") / 1000, 6).alias("importance"))
    return part("lag_", "l_linenumber").unionByName(part("price_", "l_returnflag")).unionByName(part("month_", "l_linestatus"))


@query("ag32_importance_by_group", f"""SELECT CASE WHEN feature LIKE 'lag%' THEN 'lag' WHEN feature LIKE 'price%' THEN 'price' ELSE 'calendar' END AS "group", round(sum(importance), 6) AS importance FROM {IMP} GROUP BY 1""")
def _(t):
    return C.importance_by_group(importances(t))


@query("st07_top_factors", f"SELECT feature, importance FROM {IMP} ORDER BY importance DESC, feature LIMIT 5")
def _(t):
    return C.top_factors(importances(t))
