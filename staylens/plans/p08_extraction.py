"""Payload readers and extraction, on documents that Spark builds from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.functions import dates as D
from staylens.operators import extraction as XT
from staylens.plans.registry import query
from staylens.session import spread
from staylens.sources import payloads as P

TODAY = "(SELECT today FROM event_today)"
GEN = "([" + ", ".join(f"'{m}'" for m in D.MONTHS_GENITIVE) + "])"
PAGES = 50_000  # hotel pages that one task writes and reads, at most
txt = lambda c: F.col(c).cast("string")


# --- payloads ---------------------------------------------------------------------------------------------------------
def hotel_payload(t):
    """Availability pages as the collector lands them: one page per hotel and day, with all its rooms nested."""
    joined = t.stats.drop("min_price").join(t.hotels.hint("shuffle_hash"), "id")  # days are never broadcast, however few bytes are expected
    rows = spread(joined, t.raw("lineitem").count(), PAGES)
    k = F.col("id").cast("bigint")
    rooms = F.transform(F.sequence(F.lit(1), F.col("rooms_num")), lambda i: F.struct(
        (i % 3).cast("int").alias("free"), F.when(i % 4 == 0, 1).otherwise(0).alias("single_bed"), (i % 2 + 1).cast("int").alias("capacity")))
    url = F.concat(F.lit("https://img.example/"), "id")
    hotel = lambda photos: F.to_json(F.struct(
        "id", "name", F.lit("irkutsk").alias("city_url"), F.array("lon", "lat").alias("coords"), "rating", "min_price", photos.alias("photos"),
        F.lit("3").alias("type_name"), F.col("accommodation_type").alias("category_name"), "rooms_num", rooms.alias("rooms")))
    one = F.when(k % 2 == 0, hotel(F.array(url))).otherwise(hotel(F.array(F.struct(url.alias("url")))))
    return rows.select("date", F.concat(F.lit('{"response": {"hotels": ['), one, F.lit("]}}")).alias("page"))


ROOMS = "least(rooms_num, list_sum(list_transform(range(1, rooms_num + 1), lambda i: CASE WHEN i % 4 = 0 THEN 1 ELSE i % 3 END)))"
BEDS = "CAST(greatest(rooms_num, list_sum(list_transform(range(1, rooms_num + 1), lambda i: i % 2 + 1))) AS INTEGER)"


@query("src08_hotel_payload", f"""SELECT h.id || '_101hotels' AS id, name, 'Иркутск' AS city, 'Иркутский' AS district, round(lat, 6) AS lat, round(lon, 6) AS lon, h.min_price,
    'https://img.example/' || h.id AS image_url, accommodation_type, CAST(date AS VARCHAR) AS date, rooms_num, CAST({ROOMS} AS INTEGER) AS free_rooms_amount,
    round({ROOMS} * 100 / CAST(rooms_num AS DOUBLE), 6) AS available_rooms_percent, round(rating, 6) AS rating, {BEDS} AS max_capacity
    FROM (SELECT id, date, rooms_num FROM hotel_statistics) s JOIN hotels h ON h.id = s.id""")
def _(t):
    return P.hotel_pages(hotel_payload(t), "page", F.col("date"))


@query("sc35_rooms_reduction", f"""SELECT id || '_101hotels' AS id, CAST({ROOMS} AS INTEGER) AS free_rooms_amount, {BEDS} AS max_capacity FROM hotel_statistics""")
def _(t):
    return P.hotel_pages(hotel_payload(t), "page", F.col("date")).select("id", "free_rooms_amount", "max_capacity")


@query("sc36_first_photo_and_kind", """SELECT h.id || '_101hotels' AS id, 'https://img.example/' || h.id AS image_url, accommodation_type FROM hotels h
    JOIN hotel_statistics s ON s.id = h.id""")
def _(t):
    return P.hotel_pages(hotel_payload(t), "page", F.col("date")).select("id", "image_url", "accommodation_type")


@query("src09_weather_payload", """SELECT CAST(date AS VARCHAR) AS date, temperature_max, temperature_min, (temperature_max + temperature_min) / 2 AS temperature, precipitation, wind_speed, weather_code,
    temperature_max > 10 AND precipitation < 5 AS is_good_weather FROM weather""")
def _(t):
    month = t.weather.groupBy(F.trunc("date", "month").alias("m")).agg(F.array_sort(F.collect_list(F.struct("date", "temperature_max", "temperature_min", "precipitation", "wind_speed", "weather_code"))).alias("d"))
    series = lambda c, name: F.transform("d", lambda x: x[c]).alias(name)
    page = F.to_json(F.struct(F.struct(
        F.transform("d", lambda x: x["date"].cast("string")).alias("time"), series("temperature_max", "temperature_2m_max"), series("temperature_min", "temperature_2m_min"),
        series("precipitation", "precipitation_sum"), series("wind_speed", "wind_speed_10m_max"), series("weather_code", "weathercode")).alias("daily")))
    return P.weather_days(month.select(page.alias("page")), "page").drop("weather_text")


@query("src10_map_elements", """SELECT 'osm_' || id AS hotel_key, coalesce(CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN name END, 'N' || id) AS name, round(lat, 6) AS lat, round(lon, 6) AS lon,
    CASE accommodation_type WHEN 'hotel' THEN 'Отель' WHEN 'hostel' THEN 'Хостел' ELSE 'Апартаменты' END AS accommodation_type, city FROM hotels
    WHERE lat IS NOT NULL AND accommodation_type IN ('hotel', 'hostel', 'apartment')""")
def _(t):
    k = F.col("id").cast("bigint")
    tags = F.create_map(F.lit("tourism"), "accommodation_type", F.lit("addr:city"), "city", F.when(k % 2 == 0, "name").otherwise("name:en"), F.when(k % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("N"), "id")))
    node = F.to_json(F.struct(F.lit("node").alias("type"), k.alias("id"), "lat", "lon", tags.alias("tags")))
    way = F.to_json(F.struct(F.lit("way").alias("type"), k.alias("id"), F.struct("lat", "lon").alias("center"), tags.alias("tags")))
    return P.osm_lodging(t.hotels.select(F.when(k % 3 == 0, node).otherwise(way).alias("e")), "e")


@query("src11_catalogue_records", """SELECT id AS hotel_key, name, coalesce(accommodation_type, '') AS accommodation_type, round(coalesce(lat, 0), 6) AS lat, round(coalesce(lon, 0), 6) AS lon, rating AS tripadvisor_rating,
    min_price AS tripadvisor_reviews FROM hotels""")
def _(t):
    rec = F.to_json(F.struct(F.col("id").alias("key"), "name", "accommodation_type", F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("geo"),
                             F.struct("rating", F.col("min_price").alias("count")).alias("review_summary")))
    return P.catalogue_hotels(t.hotels.select(rec.alias("r")), "r").drop("image_url", "tripadvisor_url")


@query("src06_series_lines", "SELECT district, CAST(date AS VARCHAR) AS date, round(occupancy, 6) AS occupancy FROM district_daily")
def _(t):
    good = t.district_daily.select(F.concat_ws(",", "district", txt("date"), F.format_string("%.12f", "occupancy"), F.lit("1")).alias("value"))
    bad = t.district_daily.select(F.concat_ws(",", "district", F.lit("soon"), F.lit("n/a")).alias("value"))
    return P.series_from_lines(good.unionByName(bad)).drop("n")


# --- documents --------------------------------------------------------------------------------------------------------
def event_pages(t, nested=True):
    """One page per event with a JSON-LD block; the event node sits inside an item list."""
    k = F.col("event_id").cast("bigint")
    start = F.concat(txt("date_start"), F.lit("T"), F.left(F.coalesce("time_start", F.lit("10:00:00")), F.lit(5)), F.lit(":00+08:00"))
    place = F.when(k % 2 == 0, F.to_json(F.struct(F.col("location").alias("name"), F.struct(F.col("address").alias("streetAddress")).alias("address")))).otherwise(
        F.to_json(F.struct(F.col("location").alias("name"), "address")))
    offers = F.when(k % 5 == 0, F.concat(F.lit("["), F.to_json(F.struct(F.lit("RUB").alias("c"))), F.lit(","), F.to_json(F.struct(F.col("price_max").alias("highPrice"))), F.lit("]"))).otherwise(
        F.to_json(F.struct(txt("price_min").alias("lowPrice"), F.col("price_max").alias("highPrice"))))
    kind = F.lit('"@type": ["Event", "Thing"]') if nested else F.lit('"@type": "Event"')
    head = F.to_json(F.struct(F.col("title").alias("name"), start.alias("startDate"), txt("date_end").alias("endDate"), "description", "url",
                              F.when(F.col("age_restriction").isNotNull(), "12-99").otherwise("0-99").alias("typicalAgeRange"), F.col("image_url").alias("image")))
    node = F.concat(F.lit("{"), kind, F.lit(", "), F.substr(head, F.lit(2)))
    node = F.concat(F.left(node, F.length(node) - 1), F.lit(', "location": '), place, F.lit(', "offers": '), offers, F.lit("}"))
    body = F.concat(F.lit('{"@type": "ItemList", "items": [{"item": '), node, F.lit("}]}")) if nested else F.concat(F.lit('{"@graph": ['), node, F.lit("]}"))
    return t.cal_events.select("event_id", F.concat(F.lit('<html><script type="application/ld+json">'), body, F.lit("</script></html>")).alias("html"))


@query("sc37_jsonld_walk", "SELECT event_id, title AS name FROM cal_events")
def _(t):
    nodes = XT.event_nodes(XT.script_blocks(event_pages(t), "html", "event_id"), "event_id")
    return nodes.select("event_id", F.get_json_object("node", "$.name").alias("name"))


@query("ud05_node_table_function", "SELECT count(*) AS n FROM cal_events")
def _(t):
    return XT.event_nodes(XT.script_blocks(event_pages(t), "html")).agg(F.count("*").alias("n"))


@query("sc38_jsonld_event", f"""SELECT event_id, title, description, image_url, age_restriction, left(coalesce(time_start, '10:00:00'), 5) AS time_start, url, CAST(date_start AS VARCHAR) AS date_start,
    CASE WHEN date_end <> date_start THEN CAST(date_end AS VARCHAR) END AS date_end, coalesce(location, 'Иркутск') AS location, address,
    CASE WHEN CAST(event_id AS BIGINT) % 5 <> 0 THEN price_min END AS price_min, CASE WHEN CAST(event_id AS BIGINT) % 5 <> 0 THEN price_max END AS price_max,
    CASE WHEN CAST(event_id AS BIGINT) % 5 = 0 OR price_min IS NULL THEN NULL WHEN price_max > price_min THEN price_min || ' — ' || price_max || ' руб' ELSE 'от ' || price_min || ' руб' END AS price FROM cal_events""")
def _(t):
    nodes = XT.event_nodes(XT.script_blocks(event_pages(t), "html", "event_id"), "event_id")
    fields = XT.jsonld_event(F.col("node"), F.lit(""), t.event_today)
    return nodes.select("event_id", *[c.alias(n) for n, c in fields.items()])


@query("sc39_graph_events", """SELECT event_id AS source_event, title, coalesce(description, '') AS description, CAST(date_start AS VARCHAR) AS date_start, CAST(date_end AS VARCHAR) AS date_end, price_max,
    'zeroevent_' || left(md5('zeroevent_' || CAST(date_start AS VARCHAR) || '_' || title), 12) AS event_id FROM cal_events""")
def _(t):
    pages = event_pages(t, nested=False).withColumnRenamed("event_id", "source_event")
    return XT.graph_events(pages, "html", "source_event").drop("price_min", "age_restriction")


def state_pages(t):
    k = F.col("event_id").cast("bigint")
    micro = F.to_json(F.struct(F.col("description").alias("text"), "url", F.struct(F.col("image_url").alias("url")).alias("image")))
    item = F.struct("title", F.when(k % 8 != 0, txt("date_start")).alias("date"), txt("date_end").alias("seanceEndDate"), F.array(F.struct(F.col("location").alias("title"), "address")).alias("places"),
                    F.struct(F.col("price_min").alias("min"), F.col("price_max").alias("max")).alias("price"), micro.alias("microdata"))
    state = F.to_json(F.struct(F.struct(F.struct(F.struct(F.array(item).alias("items")).alias("events")).alias("pageProps")).alias("props")))
    return t.cal_events.select(F.col("event_id").alias("page"), F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script>")).alias("html"))


@query("sc40_page_state", """SELECT event_id AS page, title, description, CAST(date_start AS VARCHAR) AS date_start, CASE WHEN date_end <> date_start THEN CAST(date_end AS VARCHAR) END AS date_end,
    coalesce(location, 'Иркутск') AS location, address, price_min, price_max, url, image_url, (SELECT count(*) FROM cal_events WHERE CAST(event_id AS BIGINT) % 8 = 0) AS skipped
    FROM cal_events WHERE CAST(event_id AS BIGINT) % 8 <> 0""")
def _(t):
    events, skipped = XT.page_state_events(state_pages(t), "html", "page")
    return events.drop("event_id", "event_type").withColumn("skipped", skipped.scalar())


def listing_pages(t):
    """A listing page per card: genre, title, date line, button, venue, price."""
    k = F.col("o_orderkey")
    date_line = F.concat(F.dayofmonth("posted").cast("string"), F.lit(" "), F.element_at(F.array(*[F.lit(m) for m in D.MONTHS_GENITIVE]), F.month("posted")), F.lit(", пт 19:00"))
    venue = F.when(k % 2 == 0, "Театр драмы").otherwise("во дворе")
    parts = [F.lit("<div>Афиша</div><b>12+</b><i>концерт</i><h3>"), F.col("title"), F.lit("</h3><b>16+</b><p>"), date_line, F.lit("</p><a>купить билет</a><p>"), venue, F.lit("</p><p>"), F.col("price_text"), F.lit("</p>")]
    return t.listing.select("o_orderkey", F.concat(*parts).alias("html"))


ROLL = f"CASE WHEN month(posted) < month({TODAY}) OR (month(posted) = month({TODAY}) AND day(posted) < day({TODAY})) THEN 1 ELSE 0 END"
ROLLED = f"TRY_CAST((year({TODAY}) + {ROLL}) || '-' || lpad(CAST(month(posted) AS VARCHAR), 2, '0') || '-' || lpad(CAST(day(posted) AS VARCHAR), 2, '0') AS DATE)"


@query("sc41_listing_lines", f"""SELECT o_orderkey, trim(title) AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'Театр драмы' ELSE 'Иркутск' END AS location,
    CAST(coalesce({ROLLED}, {TODAY}) AS VARCHAR) AS date_start, '19:00' AS time_start FROM listing WHERE NOT contains(title, 'сертификац')""")
def _(t):
    return XT.listing_events(listing_pages(t), "html", t.event_today, "o_orderkey").drop("line", "price_min")


def markdown_pages(t):
    k = F.col("o_orderkey").cast("string")
    month = F.element_at(F.array(*[F.lit(m) for m in D.MONTHS_GENITIVE]), F.month("posted"))
    md = F.concat(F.lit("# Меню\nглавная страница сайта\n## "), F.col("title"), F.lit("\nКогда: "), F.dayofmonth("posted").cast("string"), F.lit(" "), month,
                  F.lit("\nМесто: Зал "), k, F.lit("\nот 300 руб [Билет "), k, F.lit("](https://kassir.ru/e/"), k, F.lit(") [Билет "), k, F.lit("](https://kassir.ru/again/"), k,
                  F.lit(") [фото](https://cdn.kassir.ru/p.png)"))
    return t.listing.select("o_orderkey", "title", md.alias("md"))


@query("sc42_markdown_blocks", f"""SELECT o_orderkey, trim(title) AS title, CAST(coalesce({ROLLED}, {TODAY}) AS VARCHAR) AS date_start, 'от 300 руб' AS price, 300 AS price_min, 'зал ' || o_orderkey AS location FROM listing""")
def _(t):
    return XT.markdown_events(markdown_pages(t).drop("title"), "md", "md", t.event_today, "o_orderkey").drop("description", "event_id", "event_type")


@query("sc42_ticket_blocks", f"""SELECT o_orderkey, trim(title) AS title, CAST({ROLLED} AS VARCHAR) AS date_start, 300 + CAST(o_orderkey % 50 AS INTEGER) AS price_min,
    1500 + CAST(o_orderkey % 70 AS INTEGER) AS price_max FROM listing WHERE {ROLLED} IS NOT NULL AND NOT regexp_matches(lower(title), '{XT.NOISE_LINE}') AND length(trim(title)) > 2""")
def _(t):
    k = F.col("o_orderkey")
    month = F.element_at(F.array(*[F.lit(m) for m in D.MONTHS_GENITIVE]), F.month("posted"))
    head = F.when(k % 2 == 0, F.concat(F.lit("!["), F.col("title"), F.lit("](http://x/p.png)"))).otherwise(F.concat(F.lit("![афиша](http://x/p.png)\n\n## "), F.col("title")))
    prices = F.concat(F.lit("\n* "), (k % 50 + 300).cast("string"), F.lit(" — 1 "), (k % 70 + 500).cast("string"))
    md = F.concat(F.lit("# Афиша\n"), head, F.lit("\n* "), F.dayofmonth("posted").cast("string"), F.lit(" "), month, prices, F.lit("\n* 12+"))
    return XT.ticket_blocks(t.listing.select("o_orderkey", md.alias("md")), "md", "kassa", t.event_today, "o_orderkey").drop("event_id")


@query("sc43_markdown_links", "SELECT o_orderkey, 'билет ' || o_orderkey AS title, 'https://kassir.ru/e/' || o_orderkey AS url FROM listing")
def _(t):
    return XT.markdown_links(markdown_pages(t), "md", "kassir.ru", "o_orderkey")


@query("sc43_markdown_venues", """SELECT o_orderkey, unnest(['меню', 'главная страница сайта', lower(trim(title)), 'когда: ' || day(posted) || ' ' || """ + GEN + """[month(posted)]]) AS title, 'Зал ' || o_orderkey AS venue FROM listing""")
def _(t):
    return XT.markdown_venues(markdown_pages(t).withColumnRenamed("title", "_t"), "md", "o_orderkey")


@query("sc44_channel_messages", """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, trim(title) || chr(10) || date_text AS text, strftime(posted, '%Y-%m-%d') || ' 08:00:00' AS posted,
    'https://t.me/news/' || o_orderkey AS url, 'https://cdn.example/' || o_orderkey || '.jpg' AS image_url FROM listing""")
def _(t):
    k = txt("o_orderkey")
    html = F.concat(
        F.lit('<div class="tgme_widget_message" data-post="news/'), k, F.lit("\"><a style=\"background-image:url('https://cdn.example/"), k,
        F.lit(".jpg')\"></a><div class=\"tgme_widget_message_text js\"><b>"), F.col("title"), F.lit("</b><br/>"), F.col("date_text"), F.lit('</div><time class="datetime" datetime="'),
        F.date_format("posted", "yyyy-MM-dd"), F.lit('T08:00:00+00:00"></time></div><div class="tgme_widget_message" data-post="news/x"><a class="tgme_widget_message_forwarded_from_name">z</a>'
                                                  '<div class="tgme_widget_message_text">копия</div></div>'))
    return XT.channel_messages(t.listing.select("o_orderkey", html.alias("html")), "html", F.lit("news"), "o_orderkey")


@query("sc16_posts_to_events")
def _(t):
    post = F.concat_ws("\n", "title", F.concat(F.lit("Когда: "), F.col("date_text")), F.concat(F.lit("📍 "), F.coalesce("place", F.lit("Иркутск"))), "price_text", "age_text")
    posts = t.listing.select("o_orderkey", "posted", "source", post.alias("text"))
    return XT.posts_to_events(posts, "text", "posted", F.col("source"), t.event_today, "o_orderkey")


@query("sc21_relative_dates", """SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 4 THEN posted WHEN 0 THEN posted + 1 WHEN 1 THEN posted + 2 WHEN 2 THEN posted + CAST((5 - (isodow(posted) - 1) + 6) % 7 + 1 AS INTEGER) END AS VARCHAR) AS day FROM listing""")
def _(t):
    k = F.col("o_orderkey")
    phrase = F.when(k % 5 == 0, "Встречаемся завтра!").when(k % 5 == 1, "Уже послезавтра").when(k % 5 == 2, "ждём в субботу").when(k % 5 == 4, "ждём на этой неделе").otherwise("когда-нибудь")
    return t.listing.select("o_orderkey", D.relative_date(phrase, F.col("posted")).alias("day"))


@query("sc52_description_lines", """SELECT o_orderkey, trim(title) || ' открыт вход ' || date_text AS text FROM listing""")
def _(t):
    md = F.concat(F.lit("\n* "), F.col("title"), F.lit("\nПодробнее\n[открыт вход](http://x/y)\n\n"), F.col("date_text"), F.lit("\n* 5 мая другое\nдальше не читать"))
    return t.listing.select("o_orderkey", XT.description_after(md).alias("text"))
