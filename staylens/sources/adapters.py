"""Views of the lodging domain over the star-schema tables, as DataFrames and as the SQL the oracles share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.functions import metrics as X
from staylens.session import spread

CARDS = 50_000  # listing cards that one task reads

# Words of the synthetic listing cards.
GENITIVE = (
    "января", "февраля", "марта", "апреля", "мая", "июня",
    "июля", "августа", "сентября", "октября", "ноября", "декабря",
)
LISTING_WORDS = ("Концерт", "Фестиваль", "Выставка", "Спектакль", "Матч", "Экскурсия", "Открытие", "Встреча с")
AGE_TEXTS = ("12+", "для детей 6 + и взрослых", "0+", "45+", "без ограничений")
AGE_RANGES = ("6-12", "0", "18+", "16-")
PLACES = (
    "г. Иркутск, ул. Карла Маркса, 1", "Листвянка, Музей Байкала", "Москва", "Москва — Иркутск", "не могут указать",
    "-", " Хужир 5 мая ", "ул",
)
TIME_TEXTS = ("18:00", "7:05", "18:00:30", "вечером", " 19:30 ", "25:00")
SCHEMA_TYPES = ("MusicEvent", "TheaterEvent", "Place", "SportsEvent", "Festival")
DISTRICT_TEXTS = ("Иркутский район", "хужир", "Ольхонский", "слюдян", "Марс", "-")


class Tables:
    """Lazy access to the tables of one data folder. Each property is a plan; nothing runs or is cached here."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.rstrip('/')}/{name}.parquet")

    @cached_property
    def hotels(self) -> DataFrame:
        k = F.col("s_suppkey")
        geo = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        kinds = F.array(*[F.lit(x) for x in ("hotel", "hostel", "guesthouse", "apartment")])
        registry = self.raw("supplier").join(geo, F.col("s_nationkey") == F.col("n_nationkey")).select(
            k.cast("string").alias("id"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("district"),
            F.when(k % 25 != 7, (k % 400).cast("double") / 100 + 51.5).alias("lat"),
            F.when(k % 25 != 7, (k % 600).cast("double") / 100 + 103.5).alias("lon"),
            ((k % 50).cast("double") / 10).alias("rating"),
            F.floor(F.abs("s_acctbal")).cast("int").alias("min_price"),
            F.try_element_at(kinds, (k % 6 + 1).cast("int")).alias("accommodation_type"),
            F.when(k % 3 != 0, F.concat(F.lit("https://img.example/"), k.cast("string"))).alias("image_url"),
        )
        return registry

    @cached_property
    def stats(self) -> DataFrame:
        pct = F.when(F.max("l_tax") > 0, F.round(F.max("l_discount") * 1000, 6))
        rooms = F.sum("l_quantity").cast("int")
        base = (
            self.raw("lineitem")
            .groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
            .agg(
                rooms.alias("rooms_num"),
                pct.alias("available_rooms_percent"),
                F.floor(F.min(F.col("l_extendedprice") / F.col("l_quantity"))).cast("int").alias("min_price"),
                F.max("l_shipdate").alias("updated_at"),
            )
        )
        return base.select(
            F.col("l_suppkey").cast("string").alias("id"),
            "date",
            "rooms_num",
            F.floor(F.col("rooms_num") * F.col("available_rooms_percent") / 100.0).cast("int").alias(
                "free_rooms_amount"
            ),
            "available_rooms_percent",
            "min_price",
            (F.col("rooms_num") * 2).alias("max_capacity"),
            "updated_at",
        )

    @cached_property
    def cal_events(self) -> DataFrame:
        k = F.col("o_orderkey")
        joined = (
            self.raw("orders")
            .join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        )
        kind = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "concert")
            .when(F.col("o_orderpriority") == "2-HIGH", "festival")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "sport")
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "event")
            .otherwise("exhibition")
        )
        start = F.to_date("o_orderdate")
        place = F.concat("n_name", F.lit(";"))
        price = F.floor(F.col("o_totalprice") / 100).cast("int")
        return joined.select(
            k.cast("string").alias("event_id"),
            F.concat_ws(" ", "c_mktsegment", "o_orderpriority").alias("title"),
            F.when(k % 4 != 0, F.concat(F.lit("Hosted by "), "c_name")).alias("description"),
            start.alias("date_start"),
            F.date_add(start, (k % 5).cast("int")).alias("date_end"),
            kind.alias("event_type"),
            F.when(k % 10 != 0, place).alias("location"),
            F.col("o_orderstatus").alias("source_id"),
            F.concat(F.lit("https://events.example/"), k.cast("string")).alias("url"),
            F.when(k % 3 != 0, F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":30:00"))).alias("time_start"),
            F.when(k % 7 != 0, price).alias("price_min"),
            F.when(k % 7 == 3, price + 500).alias("price_max"),
            F.when(k % 2 == 0, F.concat(F.lit("https://img.example/e"), k.cast("string"))).alias("image_url"),
            F.when(k % 20 == 10, F.concat(F.lit("Main st 1, "), place)).alias("address"),
            F.when(k % 6 == 0, "12+").alias("age_restriction"),
        )

    @cached_property
    def district_daily(self) -> DataFrame:
        """Daily occupancy per district, the base of the stored forecasts."""
        return (
            self.stats.join(self.hotels.select("id", "district"), "id")
            .groupBy("district", "date")
            .agg(X.weighted_occupancy().alias("occupancy"))
        )

    @cached_property
    def forecasts(self) -> DataFrame:
        """Stored forecasts: each model repeats the value seen `horizon` days before, with a band of eight points."""
        models = F.array(
            F.struct(F.lit("trees").alias("model"), F.lit(1).alias("horizon")),
            F.struct(F.lit("additive").alias("model"), F.lit(7).alias("horizon")),
            F.struct(F.lit("ensemble").alias("model"), F.lit(3).alias("horizon")),
        )
        occ = F.col("occupancy")
        return self.district_daily.select("district", "date", "occupancy", F.inline(models)).select(
            "district",
            F.date_add("date", F.col("horizon")).alias("forecast_date"),
            F.col("date").alias("origin_date"),
            "horizon",
            "model",
            occ.alias("predicted_occupancy"),
            F.greatest(F.lit(0.0), occ - 8.0).alias("confidence_lower"),
            F.least(F.lit(100.0), occ + 8.0).alias("confidence_upper"),
        )

    @cached_property
    def weather(self) -> DataFrame:
        code = F.array(*[F.lit(c) for c in (0, 1, 2, 3, 45, 61, 71, 80, 95)])
        day = (
            self.raw("orders")
            .groupBy(F.to_date("o_orderdate").alias("date"))
            .agg(F.sum("o_custkey").alias("a"), F.sum("o_orderkey").alias("b"))
            .filter(F.col("b") % 10 != 0)
        )
        top = (F.col("a") % 50 - 15).cast("double")
        return day.select(
            "date",
            top.alias("temperature_max"),
            (top - 8).alias("temperature_min"),
            (F.col("b") % 12).cast("double").alias("precipitation"),
            (F.col("a") % 20).cast("double").alias("wind_speed"),
            F.element_at(code, (F.col("b") % 9 + 1).cast("int")).alias("weather_code"),
        )

    @cached_property
    def listing(self) -> DataFrame:
        """Raw event listings: one noisy Russian card per order, so that the text functions have text to read."""
        k = F.col("o_orderkey")
        orders = self.raw("orders")
        joined = spread(orders, orders.count(), CARDS).join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
        day = F.to_date("o_orderdate")
        d, m, y = F.dayofmonth(day), F.month(day), F.year(day)
        txt = lambda c: c.cast("string")
        two = lambda c: F.lpad(txt(c), 2, "0")
        month = F.element_at(F.array(*[F.lit(x) for x in GENITIVE]), m)
        month_after = F.element_at(F.array(*[F.lit(x) for x in GENITIVE]), m % 12 + 1)
        pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (k % n + 1).cast("int"))
        n = txt(F.floor(F.col("o_totalprice") / 100).cast("int"))
        sp = F.lit(" ")
        return joined.select(
            "o_orderkey",
            day.alias("posted"),
            F.col("o_orderstatus").alias("source"),
            F.concat(
                pick(LISTING_WORDS, 8), F.lit(" «"), F.col("c_mktsegment"), F.lit("»"),
                F.when(k % 9 == 0, " — реклама").when(k % 11 == 0, " подлежат обязательной сертификации").otherwise(""),
                F.when(k % 5 == 0, "  (Дом Кино!)").otherwise(""),
            ).alias("title"),
            F.when(k % 3 != 0, F.concat(F.lit("<p>Для детей &amp; взрослых, "), F.col("c_name"), F.lit("</p>"))).alias("description"),
            F.when(k % 4 == 0, F.concat(txt(d), sp, month, sp, txt(y)))
            .when(k % 4 == 1, F.concat(two(d), F.lit("."), two(m), F.lit("."), txt(y)))
            .when(k % 4 == 2, F.concat(txt(d), sp, month))
            .otherwise(F.concat(two(d), F.lit("."), two(m), F.lit("."), F.lpad(txt(y % 100), 2, "0"))).alias("date_text"),
            F.when(k % 3 == 0, F.concat(txt(d), F.lit("-"), txt(d + 5), sp, month))
            .when(k % 3 == 1, F.concat(F.lit("с "), txt(d), sp, month, F.lit(" по 7 "), month_after))
            .otherwise("постоянно").alias("range_text"),
            F.when(k % 5 == 0, F.concat(F.lit("от "), n, F.lit(" руб.")))
            .when(k % 5 == 1, F.concat(F.lit("От "), n, F.lit("₽")))
            .when(k % 5 == 2, "Бесплатно")
            .when(k % 5 == 3, F.concat(F.lit("Билеты от "), n, F.lit(" р., дети 6+")))
            .otherwise(F.concat(F.lit("1 "), F.right(n, F.lit(3)), F.lit(" рублей"))).alias("price_text"),
            pick(AGE_TEXTS, 5).alias("age_text"),
            pick(AGE_RANGES, 4).alias("age_range"),
            F.when(k % 8 != 5, pick(PLACES, 8)).alias("place"),
            pick(TIME_TEXTS, 6).alias("time_text"),
            F.when(k % 4 == 0, F.date_format(day, "yyyy-MM-dd"))
            .when(k % 4 == 1, txt(F.datediff(day, F.lit("1970-01-01").cast("date"))))
            .when(k % 4 == 2, "скоро").alias("date_raw"),
            F.when(k % 3 == 0, F.concat(F.lit("https://schema.org/"), pick(SCHEMA_TYPES, 5))).alias("schema_type"),
            F.when(k % 6 != 5, pick(DISTRICT_TEXTS, 6)).alias("district_text"),
            F.concat(
                F.lit("connect postgres://bot:s3cret"), txt(k), F.lit("@db failed; password = p"), txt(k),
                F.lit(" api-key=abc TOKEN=xyz "), F.col("c_name"),
            ).alias("error_text"),
        )

    # Reference dates, as scalar subqueries over the cheapest column that carries them.
    @cached_property
    def as_of(self) -> Column:
        return self.raw("lineitem").select(F.to_date(F.max("l_shipdate"))).scalar()

    @cached_property
    def event_today(self) -> Column:
        """A day inside the event calendar: thirty days before its last start date."""
        return self.raw("orders").select(F.date_sub(F.to_date(F.max("o_orderdate")), 30)).scalar()


def _words(words) -> str:
    return "([" + ", ".join(f"'{w}'" for w in words) + "])"


def _pick(words, n: int) -> str:
    return f"{_words(words)}[k % {n} + 1]"


# The same views as SQL; an oracle gets the ones it mentions as common table expressions.
ORACLE_VIEWS = {
    "hotels": """
        SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, n_name AS city, r_name AS district,
               CASE WHEN s_suppkey % 25 <> 7 THEN CAST(s_suppkey % 400 AS DOUBLE) / 100 + CAST(51.5 AS DOUBLE) END AS lat,
               CASE WHEN s_suppkey % 25 <> 7 THEN CAST(s_suppkey % 600 AS DOUBLE) / 100 + CAST(103.5 AS DOUBLE) END AS lon,
               CAST(s_suppkey % 50 AS DOUBLE) / 10 AS rating,
               CAST(floor(abs(s_acctbal)) AS INTEGER) AS min_price,
               CASE s_suppkey % 6 WHEN 0 THEN 'hotel' WHEN 1 THEN 'hostel' WHEN 2 THEN 'guesthouse'
                    WHEN 3 THEN 'apartment' END AS accommodation_type,
               CASE WHEN s_suppkey % 3 <> 0 THEN 'https://img.example/' || CAST(s_suppkey AS VARCHAR) END AS image_url
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "hotel_statistics": """
        SELECT id, date, rooms_num,
               CAST(floor(rooms_num * available_rooms_percent / 100) AS INTEGER) AS free_rooms_amount,
               available_rooms_percent, min_price, rooms_num * 2 AS max_capacity, updated_at
        FROM (SELECT CAST(l_suppkey AS VARCHAR) AS id, CAST(l_shipdate AS DATE) AS date,
                     CAST(sum(l_quantity) AS INTEGER) AS rooms_num,
                     CASE WHEN max(l_tax) > 0 THEN round(max(l_discount) * 1000, 6) END AS available_rooms_percent,
                     CAST(floor(min(l_extendedprice / l_quantity)) AS INTEGER) AS min_price,
                     max(l_shipdate) AS updated_at
              FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))""",
    "cal_events": """
        SELECT CAST(o_orderkey AS VARCHAR) AS event_id, c_mktsegment || ' ' || o_orderpriority AS title,
               CASE WHEN o_orderkey % 4 <> 0 THEN 'Hosted by ' || c_name END AS description,
               CAST(o_orderdate AS DATE) AS date_start,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) AS date_end,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'concert' WHEN '2-HIGH' THEN 'festival'
                    WHEN '3-MEDIUM' THEN 'sport' WHEN '4-NOT SPECIFIED' THEN 'event' ELSE 'exhibition' END AS event_type,
               CASE WHEN o_orderkey % 10 <> 0 THEN n_name || ';' END AS location,
               o_orderstatus AS source_id, 'https://events.example/' || CAST(o_orderkey AS VARCHAR) AS url,
               CASE WHEN o_orderkey % 3 <> 0
                    THEN lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':30:00' END AS time_start,
               CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice / 100) AS INTEGER) END AS price_min,
               CASE WHEN o_orderkey % 7 = 3 THEN CAST(floor(o_totalprice / 100) AS INTEGER) + 500 END AS price_max,
               CASE WHEN o_orderkey % 2 = 0 THEN 'https://img.example/e' || CAST(o_orderkey AS VARCHAR) END AS image_url,
               CASE WHEN o_orderkey % 20 = 10 THEN 'Main st 1, ' || n_name || ';' END AS address,
               CASE WHEN o_orderkey % 6 = 0 THEN '12+' END AS age_restriction
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "district_daily": """
        SELECT district, date,
               sum(rooms_num * (100.0 - least(100.0, greatest(0.0, coalesce(available_rooms_percent, 0)))))
               / nullif(sum(rooms_num), 0) AS occupancy
        FROM hotel_statistics s JOIN hotels h ON h.id = s.id GROUP BY district, date""",
    "forecasts": """
        SELECT district, date + horizon AS forecast_date, date AS origin_date, horizon, model,
               occupancy AS predicted_occupancy, greatest(0.0, occupancy - 8.0) AS confidence_lower,
               least(100.0, occupancy + 8.0) AS confidence_upper
        FROM district_daily, (VALUES ('trees', 1), ('additive', 7), ('ensemble', 3)) AS m(model, horizon)""",
    "weather": """
        SELECT date, CAST(a % 50 - 15 AS DOUBLE) AS temperature_max, CAST(a % 50 - 23 AS DOUBLE) AS temperature_min,
               CAST(b % 12 AS DOUBLE) AS precipitation, CAST(a % 20 AS DOUBLE) AS wind_speed,
               ([0, 1, 2, 3, 45, 61, 71, 80, 95])[CAST(b % 9 + 1 AS INTEGER)] AS weather_code
        FROM (SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(o_custkey) AS BIGINT) AS a,
                     CAST(sum(o_orderkey) AS BIGINT) AS b
              FROM orders GROUP BY CAST(o_orderdate AS DATE)) WHERE b % 10 <> 0""",
    "listing": f"""
        SELECT o_orderkey, day AS posted, o_orderstatus AS source,
               {_pick(LISTING_WORDS, 8)} || ' «' || c_mktsegment || '»' ||
               CASE WHEN k % 9 = 0 THEN ' — реклама' WHEN k % 11 = 0 THEN ' подлежат обязательной сертификации' ELSE '' END ||
               CASE WHEN k % 5 = 0 THEN '  (Дом Кино!)' ELSE '' END AS title,
               CASE WHEN k % 3 <> 0 THEN '<p>Для детей &amp; взрослых, ' || c_name || '</p>' END AS description,
               CASE k % 4 WHEN 0 THEN d || ' ' || mon || ' ' || y WHEN 1 THEN lpad(d, 2, '0') || '.' || lpad(m, 2, '0') || '.' || y
                    WHEN 2 THEN d || ' ' || mon ELSE lpad(d, 2, '0') || '.' || lpad(m, 2, '0') || '.' || right(y, 2) END AS date_text,
               CASE k % 3 WHEN 0 THEN d || '-' || CAST(day(day) + 5 AS VARCHAR) || ' ' || mon
                    WHEN 1 THEN 'с ' || d || ' ' || mon || ' по 7 ' || mon2 ELSE 'постоянно' END AS range_text,
               CASE k % 5 WHEN 0 THEN 'от ' || n || ' руб.' WHEN 1 THEN 'От ' || n || '₽' WHEN 2 THEN 'Бесплатно'
                    WHEN 3 THEN 'Билеты от ' || n || ' р., дети 6+' ELSE '1 ' || right(n, 3) || ' рублей' END AS price_text,
               {_pick(AGE_TEXTS, 5)} AS age_text, {_pick(AGE_RANGES, 4)} AS age_range,
               CASE WHEN k % 8 <> 5 THEN {_pick(PLACES, 8)} END AS place, {_pick(TIME_TEXTS, 6)} AS time_text,
               CASE k % 4 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN CAST(day - DATE '1970-01-01' AS VARCHAR)
                    WHEN 2 THEN 'скоро' END AS date_raw,
               CASE WHEN k % 3 = 0 THEN 'https://schema.org/' || {_pick(SCHEMA_TYPES, 5)} END AS schema_type,
               CASE WHEN k % 6 <> 5 THEN {_pick(DISTRICT_TEXTS, 6)} END AS district_text,
               'connect postgres://bot:s3cret' || k || '@db failed; password = p' || k || ' api-key=abc TOKEN=xyz ' || c_name AS error_text
        FROM (SELECT *, CAST(o_orderdate AS DATE) AS day, o_orderkey AS k, CAST(day(o_orderdate) AS VARCHAR) AS d,
                     CAST(month(o_orderdate) AS VARCHAR) AS m, CAST(year(o_orderdate) AS VARCHAR) AS y,
                     {_words(GENITIVE)}[month(o_orderdate)] AS mon, {_words(GENITIVE)}[month(o_orderdate) % 12 + 1] AS mon2,
                     CAST(CAST(floor(o_totalprice / 100) AS INTEGER) AS VARCHAR) AS n
              FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "as_of": "SELECT CAST(max(l_shipdate) AS DATE) AS today FROM lineitem",
    "event_today": "SELECT CAST(max(o_orderdate) AS DATE) - 30 AS today FROM orders",
}
