"""Readers of landed payloads: one input row is one document, parsed inside the executors.

Every reader takes a DataFrame with a text column, so the same code serves a batch folder and a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens import model as M
from staylens.functions.text import lookup

# --- fixed values: weather codes, lodging kinds ----------------------------------------------------------------------
WEATHER_TEXT = {
    0: "ясно",
    1: "преимущественно ясно",
    2: "переменная облачность",
    3: "пасмурно",
    45: "туман",
    48: "туман с изморозью",
    51: "лёгкая морось",
    53: "морось",
    55: "сильная морось",
    61: "небольшой дождь",
    63: "дождь",
    65: "сильный дождь",
    71: "небольшой снег",
    73: "снег",
    75: "сильный снег",
    77: "снежные зёрна",
    80: "ливневый дождь",
    81: "сильный ливень",
    85: "небольшой снегопад",
    86: "сильный снегопад",
    95: "гроза",
    96: "гроза с градом",
}
OSM_KINDS = {
    "hotel": "Отель",
    "hostel": "Хостел",
    "guest_house": "Гостевой дом",
    "apartment": "Апартаменты",
    "motel": "Мотель",
    "resort": "Курорт",
    "chalet": "Шале",
    "aparthotel": "Апарт-отель",
    "camp_site": "Кемпинг",
    "caravan_site": "Кемпинг",
    "alpine_hut": "База отдыха",
    "wilderness_hut": "База отдыха",
}
# -------------------------------------------------------------------------------------------------------------------


def weather_text(code: Column) -> Column:
    """SC-32."""
    table = {str(k): v for k, v in WEATHER_TEXT.items()}
    key = code.cast("string")
    return F.when(code.isNull(), "нет данных").otherwise(F.coalesce(lookup(table, key), F.concat(F.lit("код "), key)))


def series_from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC-06: 'district,date,occupancy,n' lines without a header; lines that do not parse are dropped."""
    part = F.split(F.col(column), ",")
    return lines.select(
        F.trim(F.try_element_at(part, F.lit(1))).alias("district"),
        F.try_to_date(F.trim(F.try_element_at(part, F.lit(2))), "yyyy-MM-dd").alias("date"),
        F.try_element_at(part, F.lit(3)).try_cast("double").alias("occupancy"),
        F.try_element_at(part, F.lit(4)).try_cast("int").alias("n"),
    ).filter(F.col("date").isNotNull() & F.col("occupancy").isNotNull())


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06. The order by date is left to the windows that need it."""
    return series_from_lines(spark.read.text(path))


def read_panel_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-07: (panel, event days) from 'district,date,occupancy,is_event' with a header."""
    rows = spark.read.schema("district string, date date, occupancy double, is_event int").option("header", True).csv(path)
    return rows.select("district", "date", "occupancy"), rows.filter("is_event = 1").select("district", "date").distinct()


HOTEL_SCHEMA = (
    "id string, name string, city_url string, city_name string, coords array<double>, rating double, min_price int,"
    " photos array<string>, type_name string, category_name string, type string, rooms_num int,"
    " rooms array<struct<free: int, single_bed: int, capacity: int>>"
)


def first_photo(photos: Column) -> Column:
    """SC-36: the first photo is an address or an object that carries one."""
    first = F.try_element_at(photos, F.lit(1))
    is_object = F.startswith(first, F.lit("{"))
    return F.nullif(F.when(is_object, F.get_json_object(first, "$.url")).otherwise(first), F.lit(""))


def lodging_kind(h: Column) -> Column:
    """SC-36: first textual kind; numeric codes are dropped."""
    text = lambda c: F.when(~F.trim(c).rlike(r"^[0-9.]*$"), F.trim(c))
    return F.coalesce(text(h["type_name"]), text(h["category_name"]), text(h["type"]))


def free_rooms(rooms: Column, rooms_num: Column) -> Column:
    """SC-35: free rooms, a single-bed entry counts one, never above the stock when the stock is known."""
    one = lambda r: F.when(F.coalesce(r["single_bed"], F.lit(0)) == 0, F.coalesce(r["free"], F.lit(0))).otherwise(1)
    total = F.aggregate(F.coalesce(rooms, F.array()), F.lit(0), lambda acc, r: acc + one(r))
    return F.when(rooms_num > 0, F.least(total, rooms_num)).otherwise(total)


def max_capacity(rooms: Column, rooms_num: Column) -> Column:
    """SC-35."""
    total = F.aggregate(rooms, F.lit(0), lambda acc, r: acc + F.coalesce(r["capacity"], F.lit(1)))
    return F.greatest(F.when(F.size(rooms) > 0, total).otherwise(rooms_num), rooms_num)


def hotel_pages(pages: DataFrame, column: str, extract_date: Column) -> DataFrame:
    """SRC-08: availability pages to one row per hotel that carries registry and statistics columns."""
    page = F.from_json(F.col(column), "response struct<hotels: array<string>>")
    one = pages.select(F.explode(page["response"]["hotels"]).alias("_raw"), extract_date.alias("date"))
    h = F.col("h")
    rooms_num = F.coalesce(h["rooms_num"], F.lit(0))
    free = free_rooms(h["rooms"], rooms_num)
    city = F.coalesce(h["city_name"], lookup(M.CITY_SLUGS, h["city_url"]), h["city_url"])
    return one.select("date", F.from_json("_raw", HOTEL_SCHEMA).alias("h")).select(
        F.concat(h["id"], F.lit("_101hotels")).alias("id"),
        h["name"].alias("name"),
        city.alias("city"),
        F.coalesce(lookup(M.CITY_TO_DISTRICT, F.lower(lookup(M.CITY_SLUGS, h["city_url"]))), F.lit("Неизвестный")).alias("district"),
        F.try_element_at(h["coords"], F.lit(2)).alias("lat"),
        F.try_element_at(h["coords"], F.lit(1)).alias("lon"),
        h["rating"].alias("rating"),
        h["min_price"].alias("min_price"),
        first_photo(h["photos"]).alias("image_url"),
        lodging_kind(h).alias("accommodation_type"),
        "date",
        rooms_num.alias("rooms_num"),
        free.alias("free_rooms_amount"),
        F.when(rooms_num > 0, free * 100 / F.nullif(rooms_num, F.lit(0))).otherwise(0.0).alias("available_rooms_percent"),
        max_capacity(h["rooms"], rooms_num).alias("max_capacity"),
    )


REGISTRY = ("id", "name", "city", "district", "lat", "lon", "rating", "min_price", "image_url", "accommodation_type")
STATISTICS = ("id", "date", "rooms_num", "free_rooms_amount", "available_rooms_percent", "min_price", "max_capacity")

WEATHER_SCHEMA = (
    "daily struct<time: array<date>, temperature_2m_max: array<double>, temperature_2m_min: array<double>,"
    " temperature_2m_mean: array<double>, precipitation_sum: array<double>, wind_speed_10m_max: array<double>,"
    " weathercode: array<int>>"
)


def weather_days(payloads: DataFrame, column: str) -> DataFrame:
    """SRC-09: parallel arrays to one row per day; a missing mean is the middle of the extremes."""
    d = F.from_json(F.col(column), WEATHER_SCHEMA)["daily"]
    # a list that the payload leaves out must not take the others with it
    given = lambda name, kind="double": F.coalesce(d[name], F.array().cast(f"array<{kind}>"))
    zipped = F.arrays_zip(
        d["time"].alias("date"), given("temperature_2m_max").alias("temperature_max"),
        given("temperature_2m_min").alias("temperature_min"), given("temperature_2m_mean").alias("mean"),
        given("precipitation_sum").alias("rain"), given("wind_speed_10m_max").alias("wind"),
        given("weathercode", "int").alias("weather_code"),
    )
    rows = payloads.select(F.inline(zipped)).toDF("date", "temperature_max", "temperature_min", "mean", "rain", "wind", "weather_code")
    top = F.col("temperature_max")
    middle = F.coalesce(F.bround((top + F.col("temperature_min")) / 2, 1), top)
    rain = F.coalesce("rain", F.lit(0.0))
    return rows.filter(F.col("date").isNotNull()).select(
        "date", "temperature_max", "temperature_min", F.coalesce("mean", middle).alias("temperature"),
        rain.alias("precipitation"), F.coalesce(F.bround("wind", 1), F.lit(0.0)).alias("wind_speed"), "weather_code",
        weather_text(F.col("weather_code")).alias("weather_text"),
        F.coalesce((top > 10) & (rain < 5), F.lit(False)).alias("is_good_weather"),
    )


OSM_SCHEMA = "type string, id bigint, lat double, lon double, center struct<lat: double, lon: double>, tags map<string, string>"


def osm_lodging(elements: DataFrame, column: str) -> DataFrame:
    """SRC-10: map elements to lodging rows; ways take their centre."""
    e = F.from_json(F.col(column), OSM_SCHEMA)
    rows = elements.select(e.alias("e"))
    c, tags = F.col("e"), F.col("e.tags")
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    node = c["type"] == "node"
    kind = tag("tourism")
    return rows.select(
        F.concat(F.lit("osm_"), c["id"].cast("string")).alias("hotel_key"),
        F.coalesce(F.nullif(tag("name"), F.lit("")), F.nullif(tag("name:ru"), F.lit("")), F.nullif(tag("name:en"), F.lit("")), F.lit("")).alias("name"),
        F.when(node, c["lat"]).otherwise(c["center"]["lat"]).alias("lat"),
        F.when(node, c["lon"]).otherwise(c["center"]["lon"]).alias("lon"),
        lookup(OSM_KINDS, kind).alias("accommodation_type"),
        tag("addr:city").alias("city"),
        kind.alias("_kind"),
    ).filter(F.col("_kind").isin(list(OSM_KINDS)) & F.col("lat").isNotNull() & F.col("lon").isNotNull()).drop("_kind")


CATALOGUE_SCHEMA = (
    "key string, name string, accommodation_type string, geo struct<latitude: double, longitude: double>,"
    " review_summary struct<rating: double, count: int>, image string, url string"
)


def catalogue_hotels(items: DataFrame, column: str) -> DataFrame:
    """SRC-11: nested catalogue records flattened."""
    r = F.from_json(F.col(column), CATALOGUE_SCHEMA)
    c = F.col("r")
    blank = lambda x: F.coalesce(x, F.lit(""))
    return items.select(r.alias("r")).select(
        blank(c["key"]).alias("hotel_key"), blank(c["name"]).alias("name"), blank(c["accommodation_type"]).alias("accommodation_type"),
        F.coalesce(c["geo"]["latitude"], F.lit(0.0)).alias("lat"), F.coalesce(c["geo"]["longitude"], F.lit(0.0)).alias("lon"),
        c["review_summary"]["rating"].alias("tripadvisor_rating"),
        F.coalesce(c["review_summary"]["count"], F.lit(0)).alias("tripadvisor_reviews"),
        blank(c["image"]).alias("image_url"), blank(c["url"]).alias("tripadvisor_url"),
    )
