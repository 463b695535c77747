"""Scans of the stored tables: pages, ranges, constraints, windows of an incremental import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from staylens import model as M
from staylens.functions import dates as D
from staylens.functions import text as S

SCHEMAS = {
    "hotels": M.HOTELS, "hotel_statistics": M.HOTEL_STATISTICS, "events": M.CAL_EVENTS, "forecasts": M.FORECASTS, "weather": M.WEATHER,
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """SRC-01: typed scan of a stored table; only the columns and partitions a query needs are read."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")


def hotel_page(
    hotels: DataFrame, city: str | None = None, district: str | None = None, limit: int = 100, offset: int = 0
) -> DataFrame:
    """SRC-02 / ST-04: a page of the registry in id order with the total and whether more rows follow."""
    rows = hotels
    if city is not None:
        rows = rows.filter(F.col("city") == city)
    if district is not None:
        rows = rows.filter(F.col("district") == district)
    total = rows.agg(F.count("*")).scalar()
    page = rows.orderBy("id").offset(offset).limit(limit)
    return page.select("*", total.alias("total"), (total > offset + limit).alias("has_more"))


def hotel_days(stats: DataFrame, hotel_id: str, date_from: Column, date_to: Column) -> DataFrame:
    """SRC-04."""
    zero = F.lit(0)
    return stats.filter((F.col("id") == hotel_id) & F.col("date").between(date_from, date_to)).select(
        "id", "date", F.coalesce("rooms_num", zero).alias("rooms_num"), F.coalesce("free_rooms_amount", zero).alias("free_rooms_amount"),
        F.coalesce("available_rooms_percent", F.lit(0.0)).alias("available_rooms_percent"), "min_price", "max_capacity",
    ).orderBy("date")


def check_rows(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """FLT-08: (good rows, quarantined rows with the first broken rule). A NULL passes, as in a table constraint."""
    reason = F.coalesce(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()])
    marked = rows.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def hotel_rules() -> dict[str, Column]:
    return {"rating": F.col("rating").between(0, 10), "price": F.col("min_price") >= 0, "name": F.trim("name") != ""}


def statistics_rules() -> dict[str, Column]:
    return {"percent": F.col("available_rooms_percent").between(0, 100), "rooms": F.col("rooms_num") >= 0}


def listing_rows(raw: DataFrame, today: Column, source: str) -> DataFrame:
    """SRC-18: raw listings to event rows; an unreadable date becomes today, the id is the hash of source, date, title."""
    day = F.coalesce(D.coerce_date("date_raw"), today)
    return raw.filter(F.coalesce("title", F.lit("")) != "").select(
        "*", day.alias("date_start"), S.event_id(F.lit(source), day.cast("string"), F.col("title")).alias("event_id")
    )


def import_window(stats: DataFrame, today: Column, date_from: Column | None = None, days: int | None = None) -> tuple[Column, Column]:
    """SRC-12: from an explicit start, a number of days, the day after the last stored one, or two weeks ago."""
    if date_from is not None:
        return date_from, today
    if days is not None:
        return F.date_sub(today, days), today
    last = stats.select(F.max("date")).scalar()
    return F.coalesce(F.date_add(last, 1), F.date_sub(today, 14)), today


def saved_forecasts(forecasts: DataFrame, dates: DataFrame, model: str = "ensemble") -> DataFrame:
    """SRC-15: stored forecasts of one model for a list of dates."""
    wanted = dates.select(F.col("date").alias("forecast_date")).distinct()
    return forecasts.filter(F.col("model") == model).join(wanted, "forecast_date", "left_semi").select(
        "district", "forecast_date", "predicted_occupancy", "confidence_lower", "confidence_upper"
    )


def model_history(series: DataFrame, stats: DataFrame, min_points: int) -> DataFrame:
    """SRC-16: training history per entity, district (weighted series) or hotel (100 minus available percent), gated by
    the number of points."""
    both = series.select(F.concat(F.lit("d:"), "district").alias("entity"), "date", F.col("avg_occupancy").alias("occupancy")).unionByName(
        stats.select(F.concat(F.lit("h:"), "id").alias("entity"), "date", (100 - F.coalesce("available_rooms_percent", F.lit(0.0))).alias("occupancy"))
    ).filter(F.col("occupancy").isNotNull())
    n = F.count("*").over(W.partitionBy("entity"))
    return both.withColumn("points", n).filter(F.col("points") >= min_points)


def model_holidays(dates: DataFrame, events: DataFrame) -> DataFrame:
    """SRC-17: holiday table of a model: public holidays within the history and ninety days past it, with a window of two
    days either side, events with none; one row per date, holidays first, then events by title and id."""
    span = dates.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", F.date_add("hi", 90))).alias("date"))
    public = days.filter(D.is_holiday(F.col("date"))).select(
        "date", D.holiday_name(F.col("date")).alias("holiday"), F.lit(-2).alias("lower_window"),
        F.lit(2).alias("upper_window"), F.lit(0).alias("_rank"), F.lit("").alias("_id"))
    other = events.filter(F.col("date_start").isNotNull()).select(
        F.col("date_start").alias("date"), F.col("title").alias("holiday"), F.lit(0).alias("lower_window"),
        F.lit(0).alias("upper_window"), F.lit(1).alias("_rank"), F.col("event_id").alias("_id"))
    best = F.min_by(F.struct("holiday", "lower_window", "upper_window"), F.struct("_rank", "_id")).alias("r")
    return public.unionByName(other).groupBy("date").agg(best).select("date", "r.*")
