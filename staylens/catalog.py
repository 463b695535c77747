"""UD-01: the named, parameterised questions. `register` publishes the tables as views and SQL table functions over them;
the methods of `Catalog` carry the same names for Python, including the questions that need models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens import model as M
from staylens.operators import effect as FX
from staylens.operators import events as E
from staylens.operators import forecasts as C
from staylens.operators import market as K
from staylens.operators import models as MO
from staylens.operators import timeseries as T

# The core metric as SQL text (UD-04), for views and table functions.
WEIGHTED_OCCUPANCY_SQL = (
    "sum(rooms_num * (100.0D - least(100.0D, greatest(0.0D, coalesce(available_rooms_percent, 0.0D)))))"
    " / nullif(sum(rooms_num), 0)"
)

FUNCTIONS = {
    "search_hotels": (
        "place STRING", "id STRING, name STRING, city STRING, district STRING, min_price INT",
        "SELECT id, name, city, district, min_price FROM hotels WHERE city = search_hotels.place OR district = search_hotels.place"),
    "search_events": (
        "needle STRING, date_from DATE", "event_id STRING, title STRING, date_start DATE, event_type STRING, location STRING",
        "SELECT event_id, title, date_start, event_type, location FROM cal_events WHERE date_start >= search_events.date_from"
        " AND contains(lower(concat_ws(' ', title, event_type, location)), lower(search_events.needle))"),
    "weather_between": (
        "date_from DATE, date_to DATE", "date DATE, temperature_max DOUBLE, temperature_min DOUBLE, precipitation DOUBLE",
        "SELECT date, temperature_max, temperature_min, precipitation FROM weather WHERE date BETWEEN weather_between.date_from AND weather_between.date_to"),
    "stored_forecast": (
        "area STRING, date_from DATE", "forecast_date DATE, model STRING, predicted_occupancy DOUBLE",
        "SELECT forecast_date, model, predicted_occupancy FROM forecasts WHERE district = stored_forecast.area AND forecast_date >= stored_forecast.date_from"),
    "statistics_on": (
        "day DATE", "district STRING, occupancy DOUBLE, rooms BIGINT",
        f"SELECT district, {WEIGHTED_OCCUPANCY_SQL}, sum(rooms_num) FROM hotel_days WHERE date = statistics_on.day GROUP BY district"),
    "occupancy_timeseries": (
        "area STRING, date_from DATE", "date DATE, occupancy DOUBLE",
        f"SELECT date, {WEIGHTED_OCCUPANCY_SQL} FROM hotel_days WHERE district = occupancy_timeseries.area AND date >= occupancy_timeseries.date_from AND rooms_num > 0 GROUP BY date"),
    "revenue_metrics": (
        "date_from DATE", "district STRING, occupancy DOUBLE, adr DOUBLE, revpar DOUBLE",
        f"SELECT district, o, p, o * p / 100 FROM (SELECT district, {WEIGHTED_OCCUPANCY_SQL} AS o, percentile_cont(0.5) WITHIN GROUP (ORDER BY min_price) FILTER (WHERE min_price > 0) AS p"
        " FROM hotel_days WHERE date >= revenue_metrics.date_from GROUP BY district)"),
    "price_distribution": (
        "area STRING, date_from DATE", "p10 DOUBLE, p50 DOUBLE, p90 DOUBLE, samples BIGINT",
        "SELECT percentile(min_price, 0.1), percentile(min_price, 0.5), percentile(min_price, 0.9), count(*) FROM hotel_days"
        " WHERE district = price_distribution.area AND date >= price_distribution.date_from AND min_price > 0"),
    "segment_metrics": (
        "area STRING, date_from DATE", "size STRING, objects BIGINT, occupancy DOUBLE",
        f"SELECT CASE WHEN rooms_num <= 15 THEN 'mini' WHEN rooms_num <= 50 THEN 'mid' ELSE 'large' END, count(DISTINCT id), {WEIGHTED_OCCUPANCY_SQL} FROM hotel_days"
        " WHERE district = segment_metrics.area AND date >= segment_metrics.date_from GROUP BY 1"),
    "booking_pace": (
        "date_from DATE, lookback INT", "district STRING, date DATE, occupancy DOUBLE, occupancy_lookback DOUBLE, pickup DOUBLE",
        "SELECT a.district, a.date, a.occupancy, b.occupancy, a.occupancy - b.occupancy FROM district_days a LEFT JOIN district_days b"
        " ON b.district = a.district AND b.date = date_sub(a.date, booking_pace.lookback) WHERE a.date >= booking_pace.date_from"),
    "compare_districts": (
        "one STRING, other STRING, date_from DATE", "district STRING, occupancy DOUBLE, days BIGINT, adr DOUBLE, revpar DOUBLE",
        "SELECT o.district, o.occupancy, o.days, p.adr, p.adr * o.occupancy / 100 FROM (SELECT district, avg(occupancy) AS occupancy, count(*) AS days FROM district_days"
        " WHERE district IN (compare_districts.one, compare_districts.other) AND date >= compare_districts.date_from GROUP BY district) o LEFT JOIN (SELECT district, percentile(min_price, 0.5) AS adr FROM hotel_days"
        " WHERE date >= compare_districts.date_from AND min_price > 0 GROUP BY district) p ON p.district = o.district"),
    "compare_forecast_models": (
        "area STRING", "model STRING, n BIGINT, rmse DOUBLE, mae DOUBLE, bias DOUBLE",
        "SELECT f.model, count(*), sqrt(avg(pow(f.predicted_occupancy - d.occupancy, 2))), avg(abs(f.predicted_occupancy - d.occupancy)), avg(f.predicted_occupancy - d.occupancy)"
        " FROM forecasts f JOIN district_days d ON d.district = f.district AND d.date = f.forecast_date WHERE f.district = compare_forecast_models.area GROUP BY f.model"),
}


def register(spark: SparkSession, tables, effect: DataFrame | None = None) -> None:
    """Publish views and table functions. `tables` offers hotels, stats, cal_events, forecasts and weather. The event effect is a model: give its
    stored result (of `Catalog.get_event_effect`), and `event_effect(verdict)` reads it; a null verdict takes all rows."""
    tables.hotels.createOrReplaceTempView("hotels")
    tables.stats.createOrReplaceTempView("hotel_statistics")
    tables.cal_events.createOrReplaceTempView("cal_events")
    tables.forecasts.createOrReplaceTempView("forecasts")
    tables.weather.createOrReplaceTempView("weather")
    K.with_hotel(tables.stats, tables.hotels, "district", "city").createOrReplaceTempView("hotel_days")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW district_days AS SELECT district, date, {WEIGHTED_OCCUPANCY_SQL} AS occupancy FROM hotel_days WHERE rooms_num > 0 GROUP BY district, date")
    functions = dict(FUNCTIONS)
    if effect is not None:
        effect.createOrReplaceTempView("event_effect_result")
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in effect.schema.fields)
        functions["event_effect"] = ("outcome STRING", columns, "SELECT * FROM event_effect_result WHERE event_effect.outcome IS NULL OR verdict = event_effect.outcome")
    for name, (params, columns, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS TABLE({columns}) RETURN {body}")


class Catalog:
    """The same questions from Python. The reference date is given, never taken from the clock."""

    def __init__(self, tables, today):
        self.t, self.today = tables, today

    def _series(self) -> DataFrame:
        return K.daily_series(self.t.stats, self.t.hotels)

    def search_hotels(self, city: str, limit: int = 7) -> DataFrame:
        return E.cascade_search(self.t.hotels, city, M.CITY_TO_DISTRICT.get(city.lower(), city), limit)

    def search_events(self, needle: str, limit: int = 7) -> DataFrame:
        return E.nearest_first(E.token_search(E.upcoming(self.t.cal_events, self.today), needle), self.today, limit)

    def get_weather(self, days: int) -> DataFrame:
        return self.t.weather.filter(F.col("date").between(self.today, F.date_add(self.today, days)))

    def forecast_occupancy(self, days: int = 7) -> DataFrame:
        return MO.additive_forecast(self._series().select("district", "date", F.col("avg_occupancy").alias("y")), min(days, M.MAX_FORECAST_HORIZON_DAYS))

    def get_statistics(self) -> DataFrame:
        return K.statistics_card(K.district_snapshot(self.t.stats, self.t.hotels, K.latest_date(self.t.stats)))

    def get_revenue_metrics(self, days: int = 30) -> DataFrame:
        since = F.date_sub(self.today, days)
        return K.revenue_window(self._series(), K.price_percentiles(self.t.stats, self.t.hotels, since), since, self.today)

    def get_event_effect(self, rounds: int = M.PLACEBO_ROUNDS, places: DataFrame | None = None) -> DataFrame:
        panel = self._series().select("district", "date", F.col("avg_occupancy").alias("occupancy"))
        located = E.with_district(self.t.cal_events, places, M.DEFAULT_DISTRICT) if places is not None else self.t.cal_events.withColumn("district", F.lit(M.DEFAULT_DISTRICT))
        return FX.verdict(FX.event_effect(panel, E.event_days(located, F.col("district")), rounds))

    def get_booking_pace(self, days_ahead: int = 14, lookback: int = 7) -> DataFrame:
        return T.proxy_pickup(T.known_occupancy(self.t.stats, self.t.hotels, F.date_sub(self.today, days_ahead + lookback)), days_ahead, lookback)

    def compare_districts(self, districts: list[str], days: int = 30) -> DataFrame:
        since = F.date_sub(self.today, days)
        return K.compare_districts(self._series(), K.price_percentiles(self.t.stats, self.t.hotels, since), since, districts)

    def compare_forecast_models(self) -> DataFrame:
        return C.error_metrics(C.forecast_vs_actual(self.t.forecasts, self._series().withColumnRenamed("avg_occupancy", "occupancy"), None), ["district", "model"])

    def get_occupancy_timeseries(self, days: int = 30) -> DataFrame:
        return self._series().filter(F.col("date") >= F.date_sub(self.today, days))

    def get_price_distribution(self, days: int = 30) -> DataFrame:
        return K.price_percentiles(self.t.stats, self.t.hotels, F.date_sub(self.today, days))

    def get_segment_benchmark(self) -> DataFrame:
        return K.segment_benchmark(self.t.stats, self.t.hotels, K.latest_date(self.t.stats))
