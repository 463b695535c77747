"""Table functions, the metric as SQL, reference tables, and tables written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens import catalog
from staylens import model as M
from staylens.operators import effect as FX
from staylens.operators import upsert as U
from staylens.plans import p01_market as P1
from staylens.plans import p02_events as P2
from staylens.plans import p04_series as P4
from staylens.plans.registry import query
from staylens.session import materialise
from staylens.sources import payloads as P
from staylens.sources import reference as RF
from staylens.streaming.jobs import work_folder


@query("ud04_occupancy_as_sql", f"SELECT district, CAST(date AS VARCHAR) AS date, round({P1.OCC}, 6) AS occupancy FROM {P1.JOINED} GROUP BY district, date")
def _(t):
    catalog.register(t.spark, t)
    return t.spark.sql(f"SELECT district, date, {catalog.WEIGHTED_OCCUPANCY_SQL} AS occupancy FROM hotel_days GROUP BY district, date")


@query("ud01_revenue_function", f"""SELECT district, round(o, 6) AS occupancy, round(p, 6) AS adr, round(o * p / 100, 6) AS revpar FROM (SELECT district, {P1.OCC} AS o, {P1.MED} AS p FROM {P1.JOINED}
    WHERE date >= DATE '2001-01-01' GROUP BY district)""")
def _(t):
    catalog.register(t.spark, t)
    return t.spark.sql("SELECT * FROM revenue_metrics(DATE'2001-01-01')")


@query("ud01_timeseries_function", f"""SELECT CAST(date AS VARCHAR) AS date, round({P1.OCC}, 6) AS occupancy FROM {P1.JOINED} WHERE district = 'ASIA' AND date >= DATE '2000-01-01' AND rooms_num > 0 GROUP BY date""")
def _(t):
    catalog.register(t.spark, t)
    return t.spark.sql("SELECT * FROM occupancy_timeseries('ASIA', DATE'2000-01-01')")


@query("ud01_segment_function", f"""SELECT {P1.SIZE} AS size, count(DISTINCT s.id) AS objects, round({P1.OCC}, 6) AS occupancy FROM {P1.JOINED} WHERE district = 'EUROPE' AND date >= DATE '2001-01-01' GROUP BY 1""")
def _(t):
    catalog.register(t.spark, t)
    return t.spark.sql("SELECT * FROM segment_metrics('EUROPE', DATE'2001-01-01')")


def asked(t, sql):
    catalog.register(t.spark, t)
    return t.spark.sql(sql)


@query("ud01_hotels_function", "SELECT id, name, city, district, CAST(min_price AS INTEGER) AS min_price FROM hotels WHERE city = 'ASIA' OR district = 'ASIA'")
def _(t):
    return asked(t, "SELECT * FROM search_hotels('ASIA')")


@query("ud01_events_function", """SELECT event_id, title, CAST(date_start AS VARCHAR) AS date_start, event_type, location FROM cal_events WHERE date_start >= DATE '1995-01-01'
    AND contains(lower(concat_ws(' ', title, event_type, location)), 'e')""")
def _(t):
    return asked(t, "SELECT * FROM search_events('E', DATE'1995-01-01')")


@query("ud01_weather_function", """SELECT CAST(date AS VARCHAR) AS date, round(temperature_max, 6) AS temperature_max, round(temperature_min, 6) AS temperature_min, round(precipitation, 6) AS precipitation FROM weather
    WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-01-01'""")
def _(t):
    return asked(t, "SELECT * FROM weather_between(DATE'1996-01-01', DATE'1997-01-01')")


@query("ud01_forecast_function", """SELECT CAST(forecast_date AS VARCHAR) AS forecast_date, model, round(predicted_occupancy, 6) AS predicted_occupancy FROM forecasts
    WHERE district = 'ASIA' AND forecast_date >= DATE '1997-01-01'""")
def _(t):
    return asked(t, "SELECT * FROM stored_forecast('ASIA', DATE'1997-01-01')")


@query("ud01_statistics_function", f"""SELECT district, round({P1.OCC}, 6) AS occupancy, CAST(sum(rooms_num) AS BIGINT) AS rooms FROM {P1.JOINED} WHERE date = DATE '1997-08-01' GROUP BY district""")
def _(t):
    return asked(t, "SELECT * FROM statistics_on(DATE'1997-08-01')")


@query("ud01_prices_function", f"""SELECT round(quantile_cont(min_price, 0.1), 6) AS p10, round(quantile_cont(min_price, 0.5), 6) AS p50, round(quantile_cont(min_price, 0.9), 6) AS p90, count(*) AS samples
    FROM (SELECT district, date, CAST(s.min_price AS DOUBLE) AS min_price FROM {P1.JOINED}) WHERE district = 'ASIA' AND date >= DATE '1997-01-01' AND min_price > 0""")
def _(t):
    return asked(t, "SELECT * FROM price_distribution('ASIA', DATE'1997-01-01')")


DAYS = f"(SELECT district, date, {P1.OCC} AS o FROM {P1.JOINED} WHERE rooms_num > 0 GROUP BY district, date)"


@query("ud01_pace_function", f"""SELECT a.district, CAST(a.date AS VARCHAR) AS date, round(a.o, 6) AS occupancy, round(b.o, 6) AS occupancy_lookback, round(a.o - b.o, 6) AS pickup FROM {DAYS} a
    LEFT JOIN {DAYS} b ON b.district = a.district AND b.date = a.date - 7 WHERE a.date >= DATE '1997-01-01'""")
def _(t):
    return asked(t, "SELECT * FROM booking_pace(DATE'1997-01-01', 7)")


@query("ud01_districts_function", f"""SELECT a.district, round(occupancy, 6) AS occupancy, days, round(adr, 6) AS adr, round(adr * occupancy / 100, 6) AS revpar
    FROM (SELECT district, avg(o) AS occupancy, count(*) AS days FROM {DAYS} WHERE district IN ('ASIA', 'EUROPE') AND date >= DATE '1997-01-01' GROUP BY district) a
    LEFT JOIN (SELECT district, quantile_cont(CAST(s.min_price AS DOUBLE), 0.5) AS adr FROM {P1.JOINED} WHERE date >= DATE '1997-01-01' AND s.min_price > 0 GROUP BY district) b ON b.district = a.district""")
def _(t):
    return asked(t, "SELECT * FROM compare_districts('ASIA', 'EUROPE', DATE'1997-01-01')")


@query("ud01_models_function", f"""SELECT model, count(*) AS n, round(sqrt(avg((predicted_occupancy - o) ** 2)), 6) AS rmse, round(avg(abs(predicted_occupancy - o)), 6) AS mae, round(avg(predicted_occupancy - o), 6) AS bias
    FROM forecasts f JOIN {DAYS} d ON d.district = f.district AND d.date = f.forecast_date WHERE f.district = 'ASIA' GROUP BY model""")
def _(t):
    return asked(t, "SELECT * FROM compare_forecast_models('ASIA')")


@query("ud01_event_effect_function")
def _(t):
    effect = materialise(FX.verdict(FX.event_effect(t.district_daily, P2.event_days(t), 20)))
    catalog.register(t.spark, t, effect)
    return t.spark.sql("SELECT * FROM event_effect(NULL)")


@query("src13_cities_and_districts", "SELECT district, lat, lon, count(*) AS listings FROM (SELECT *, CASE lower(district_text) " + " ".join(
    f"WHEN '{c}' THEN '{d}'" for c, d in M.CITY_TO_DISTRICT.items()) + " END AS d FROM listing) JOIN (VALUES " + ", ".join(
    f"('{d}', {a}::DOUBLE, {b}::DOUBLE)" for d, (a, b) in M.DISTRICT_CENTERS.items()) + ") AS c(district, lat, lon) ON c.district = d GROUP BY ALL")
def _(t):
    places = RF.cities(t.spark).join(RF.districts(t.spark), "district")
    return t.listing.select(F.lower("district_text").alias("city")).join(places, "city").groupBy("district", "lat", "lon").agg(F.count("*").alias("listings"))


@query("src13_season_days", """SELECT CASE WHEN month(date) IN (12, 1, 2, 3) THEN 'winter' WHEN month(date) IN (4, 5) THEN 'spring' WHEN month(date) IN (6, 7, 8, 9) THEN 'summer' ELSE 'autumn' END AS season,
    count(*) AS hotel_days FROM hotel_statistics GROUP BY 1""")
def _(t):
    return t.stats.withColumn("month", F.month("date")).join(RF.seasons(t.spark), "month").groupBy("season").agg(F.count("*").alias("hotel_days"))


@query("src07_panel_csv", f"""SELECT a.district, CAST(a.date AS VARCHAR) AS date, round(a.occupancy, 6) AS occupancy, CASE WHEN d.date IS NULL THEN 0 ELSE 1 END AS is_event
    FROM district_daily a LEFT JOIN ({P2.DAYS}) d ON d.district = a.district AND d.date = a.date""")
def _(t):
    path = work_folder(t.spark, "panel")
    U.write_csv(U.panel_dump(t.district_daily, P2.event_days(t)), path)
    panel, days = P.read_panel_csv(t.spark, path)
    return U.panel_dump(panel, days)


@query("snk10_json_dump", f"""SELECT event_id, title, CAST(date_start AS VARCHAR) AS date_start FROM cal_events WHERE date_start >= {P2.TODAY}""")
def _(t):
    path = work_folder(t.spark, "events-json")
    U.write_json(t.cal_events.filter(F.col("date_start") >= t.event_today).select("event_id", "title", "date_start"), path)
    return t.spark.read.schema("event_id string, title string, date_start date").json(path)


@query("snk02_stored_merge", """SELECT id, CAST(date AS VARCHAR) AS date, CASE WHEN month(date) = 3 THEN rooms_num + 1 ELSE rooms_num END AS rooms_num FROM hotel_statistics""")
def _(t):
    """The keyed table on storage: first load, then a change that touches some of its partitions, twice."""
    schema = M.HOTEL_STATISTICS
    table = U.statistics_table(t.spark, work_folder(t.spark, "stored"))
    how = lambda old, new: U.overwrite(old, new, ["id", "date"])
    table.merge(t.stats, schema, how)
    change = t.stats.filter(F.month("date") == 3).withColumn("rooms_num", F.col("rooms_num") + 1)
    table.merge(change, schema, how)
    table.merge(change, schema, how)
    return t.spark.read.parquet(table.path).select("id", "date", "rooms_num")
