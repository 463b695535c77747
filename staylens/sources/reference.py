"""Reference tables as small literal DataFrames (SRC-13). Their size is that of the lists in `model` and below. The planner takes a local
table for an unbounded one, so those that others are joined with carry a hint: it is they that are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens import model as M
from staylens.functions import dates as D

# --- fixed values: curated major events --------------------------------------------------------------------------------
MAJOR_EVENTS = (
    ("Olkhon Ice Fest 2025", "2025-02-15", "2025-03-15", "festival", "о. Ольхон, Хужир"),
    ("Baikal Race 2025 — гонка на собачьих упряжках", "2025-02-20", "2025-02-26", "sport", "оз. Байкал"),
    ("Байкальская Миля 2025", "2025-03-07", "2025-03-11", "sport", "оз. Байкал"),
    ("Майские праздники 2025", "2025-05-01", "2025-05-10", "holiday", "Иркутск, область"),
    ("Парад Победы в Иркутске", "2025-05-09", None, "holiday", "Иркутск, центр"),
    ("Новогодние праздники 2025-2026", "2025-12-31", "2026-01-08", "holiday", "Иркутская область"),
    ("Цирк на льду «По щучьему велению»", "2026-01-02", "2026-01-10", "theater", "ЛД «Айсберг», Иркутск"),
    ("Olkhon Ice Fest 2026", "2026-02-15", "2026-03-15", "festival", "о. Ольхон, Хужир"),
    ("Концерт группы «Ленинград»", "2026-02-27", "2026-02-28", "concert", "ЛД «Айсберг», ул. Лермонтова 255/1, Иркутск"),
)
SCHOOL_EVENTS = (
    ("Осенние школьные каникулы", "2025-10-25", "2025-11-04"),
    ("Зимние школьные каникулы", "2025-12-31", "2026-01-11"),
    ("Дополнительные каникулы (1 класс)", "2026-02-21", "2026-03-01"),
)
# -----------------------------------------------------------------------------------------------------------------------


def cities(spark: SparkSession) -> DataFrame:
    """City, district and the rank that decides between several matches."""
    rows = [(i, c, d) for i, (c, d) in enumerate(M.CITY_TO_DISTRICT.items())]
    return F.broadcast(spark.createDataFrame(rows, "rank int, city string, district string"))


def districts(spark: SparkSession) -> DataFrame:
    rows = [(d, lat, lon) for d, (lat, lon) in M.DISTRICT_CENTERS.items()]
    return F.broadcast(spark.createDataFrame(rows, "district string, lat double, lon double"))


def city_slugs(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(M.CITY_SLUGS.items()), "slug string, city string"))


def seasons(spark: SparkSession) -> DataFrame:
    rows = [(m, s) for s, months in M.SEASON_MONTHS.items() for m in months]
    return F.broadcast(spark.createDataFrame(rows, "month int, season string"))


def major_events(spark: SparkSession) -> DataFrame:
    """Curated events and school breaks as event rows; the id is a hash of prefix, date and title."""
    rows = [("major", *e) for e in MAJOR_EVENTS] + [("school", t, a, b, "school_holiday", "Россия") for t, a, b in SCHOOL_EVENTS]
    df = spark.createDataFrame(rows, "source_id string, title string, s string, e string, event_type string, location string")
    key = F.concat_ws("_", "source_id", "s", "title")
    return df.select(
        F.concat(F.col("source_id"), F.lit("_"), F.left(F.md5(key), F.lit(12))).alias("event_id"), "title",
        F.col("s").cast("date").alias("date_start"), F.col("e").cast("date").alias("date_end"), "event_type", "location", "source_id")


def school_breaks(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(list(D.SCHOOL_BREAKS), "s string, e string, name string")
    return df.select(F.col("s").cast("date").alias("date_start"), F.col("e").cast("date").alias("date_end"), "name")
