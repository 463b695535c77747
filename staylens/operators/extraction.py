"""Events out of pages, posts and Markdown. One input row is one document; lines and blocks of a document are handled as
array values inside its row, so nothing is shuffled to look at neighbouring lines."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.functions import dates as D
from staylens.functions import text as S

# --- fixed values: words that decide what a line is -------------------------------------------------------------------
MONTHS = "|".join(D.MONTHS_GENITIVE)
DATE_LINE = rf"(\d{{1,2}})\s+({MONTHS})"
DATE_LINE_TIME = rf"(\d{{1,2}})\s+({MONTHS})[,\s]+(?:пн|вт|ср|чт|пт|сб|вс)?\s*(\d{{1,2}}:\d{{2}})?"
GENRES = (
    "концерт", "спектакль", "выставка", "гастроли", "спорт",
    "бизнес", "другое", "балет", "конференция", "концерт при свечах",
    "музыкальная драма", "обучение", "выставка картин", "ужин",
)
SKIP_LINES = ("6+", "12+", "16+", "18+", "0+", "актуальное", "скоро", "все события", "показать еще", "пушкинская карта")
NOT_VENUES = (
    "купить билет", "подробнее", "экскурсия", "лекция", "мастер-класс",
    "квест", "квиз", "прогулка", "концерт", "спектакль", "выставка",
    "фестиваль", "шоу", "спорт", "бизнес", "другое", "балет",
)
VENUE_LINE = (
    r"театр|филармония|музей|галерея|дворец|центр|дк|библиотека|зал|клуб|арена|стадион|кинотеатр|"
    r"ул\.|улица|пр\.|площадь|набережная"
)
PRICE_LINE = r"(?:от\s+)?(\d{2,5})\s*(?:руб|₽|р\.?(?:[^\p{L}\p{N}_]|$))"
SERVICE_HEADINGS = ("меню", "навигация", "поиск", "войти", "регистрация", "корзина")
NOISE_LINE = r"^(?:афиша|билеты|kassir|логотип|меню|реклама|подробнее|купить билет|показать ещё|показать еще)(?:[^\p{L}\p{N}_]|$)"
POST_KEYWORDS = (
    "концерт", "выставка", "фестиваль", "мастер-класс",
    "экскурсия", "тур ", "поход", "праздник", "открытие",
    "спектакль", "премьера", "шоу", "форум", "семинар",
    "конференция", "ярмарка", "марафон", "вечер ",
    "festival", "concert", "show", "exhibition", "tour",
)
GREETING = "понедельник|вторник|сред|четверг|пятниц|суббот|воскресень|настроен"
POST_LABELS = ("место", "где", "адрес", "площадка", "локация")
POST_VENUE_WORDS = (
    "дворец|театр|музей|галерея|центр|клуб|филармония|ДК|библиотека|зал|арена|стадион|отель|гостиница|парк|площадь"
)
# -------------------------------------------------------------------------------------------------------------------


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns as the output of a one-row generator. Later filters and projections then read the values; without it
    the optimizer would write each long expression into every place that mentions the column."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def dated(rows: DataFrame, text: Column) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with the parts of the date that a text names, each read once, and these columns for `dates.date_of`."""
    rows = computed(rows, _date=text)
    parts = D.date_parts("_date")
    return computed(rows, **parts), {n: F.col(n) for n in parts}


# --- JSON-LD ---------------------------------------------------------------------------------------------------------
def script_blocks(pages: DataFrame, html: str, *keep: str) -> DataFrame:
    """SC-37, first half: the JSON-LD script bodies of a page."""
    bodies = F.regexp_extract_all(F.col(html), F.lit(r'(?s)<script type="application/ld\+json">(.*?)</script>'), F.lit(1))
    return pages.select(*keep, F.explode(bodies).alias("block"))


def _event_nodes(text: str | None) -> Iterator[tuple[str]]:
    try:
        pending = [json.loads(text or "null")]
    except ValueError:
        return
    while pending:
        node = pending.pop()
        if isinstance(node, list):
            pending.extend(node)
        elif isinstance(node, dict):
            kind = node.get("@type")
            kinds = kind if isinstance(kind, list) else [kind]
            if any(isinstance(k, str) and "Event" in k for k in kinds):
                yield (json.dumps(node, ensure_ascii=False),)
            else:
                pending.extend(node.values())


def register_node_function(spark: SparkSession, name: str = "jsonld_event_nodes") -> None:
    """UD-05: a table function for lateral joins: every node of event type at any depth, without its inner nodes."""

    @F.udtf(returnType="node string")
    class EventNodes:
        def eval(self, block: str):
            yield from _event_nodes(block)

    spark.udtf.register(name, EventNodes)


def event_nodes(blocks: DataFrame, *keep: str) -> DataFrame:
    """SC-37, second half: one row per event node. Depth is not bounded, which built-in expressions cannot follow."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            nodes = [[n for (n,) in _event_nodes(b)] if b is not None else [] for b in pdf["block"]]
            yield pdf[list(keep)].assign(node=nodes).explode("node").dropna(subset="node")

    kept = blocks.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), "node string"])
    return blocks.select(*keep, "block").mapInPandas(walk, schema)


def _first_given(*cols: Column) -> Column:
    return F.coalesce(*[F.when(~c.isin("", "0", "null"), c) for c in cols])


def whole(c: Column) -> Column:
    return c.try_cast("double").cast("int")


def jsonld_event(node: Column, url: Column, today: Column, city: str = "Иркутск") -> dict[str, Column]:
    """SC-38: fields of a schema.org event node."""
    g = lambda path: F.get_json_object(node, path)
    day, clock, end = D.iso_parts(F.coalesce(g("$.startDate"), F.lit("")), F.coalesce(g("$.endDate"), F.lit("")))
    day = F.coalesce(day, today)
    address = g("$.location.address")
    street = _first_given(g("$.location.address.streetAddress"), g("$.location.address.addressLocality"))
    low = whole(_first_given(g("$.offers.lowPrice"), g("$.offers.price")))
    high = whole(_first_given(g("$.offers.highPrice"), g("$.offers.maxPrice")))
    image = g("$.image")
    price = F.when(high > low, F.concat(low.cast("string"), F.lit(" — "), high.cast("string"), F.lit(" руб"))).when(
        low.isNotNull(), F.concat(F.lit("от "), low.cast("string"), F.lit(" руб")))
    return {
        "title": F.trim(F.coalesce(g("$.name"), F.lit(""))),
        "description": F.nullif(F.trim(g("$.description")), F.lit("")),
        "image_url": F.when(~image.rlike(r"^\s*[\[{]"), image),
        "age_restriction": F.when(F.contains(g("$.typicalAgeRange"), F.lit("-")), S.age_range(g("$.typicalAgeRange"))),
        "time_start": clock,
        "url": F.coalesce(F.nullif(url, F.lit("")), g("$.url")),
        "date_start": day,
        "date_end": F.nullif(end, day),
        "location": F.coalesce(F.nullif(g("$.location.name"), F.lit("")), F.lit(city)),
        "address": F.nullif(F.trim(F.when(address.rlike(r"^\s*\{"), street).when(~address.rlike(r"^\s*\["), address)), F.lit("")),
        "price_min": low,
        "price_max": high,
        "price": price,
    }


def graph_events(pages: DataFrame, html: str, *keep: str) -> DataFrame:
    """SC-39: the @graph list of the first JSON-LD block; events with a name and a readable start date. Offers may be an
    object or a list, of which the first high price counts."""
    block = F.regexp_extract(F.col(html), r'(?s)<script type="application/ld\+json">(\{.*?\})</script>', 1)
    items = F.from_json(block, "`@graph` array<string>")["@graph"]
    rows = pages.select(*keep, F.explode(items).alias("node"))
    g = lambda path: F.get_json_object("node", path)
    offers = g("$.offers")
    offer_type = "struct<highPrice: string, maxPrice: string>"
    listed = F.from_json(F.when(offers.rlike(r"^\s*\["), offers).otherwise(F.concat(F.lit("["), offers, F.lit("]"))), f"array<{offer_type}>")
    highs = F.filter(F.transform(listed, lambda o: whole(_first_given(o["highPrice"], o["maxPrice"]))), lambda v: v.isNotNull())
    description = S.clean_html(F.coalesce(g("$.description"), F.lit("")))
    name = F.trim(F.coalesce(g("$.name"), F.lit("")))
    out = rows.filter(g("$.@type") == "Event").select(
        *keep, name.alias("title"), description.alias("description"), D.coerce_date(g("$.startDate")).alias("date_start"),
        D.coerce_date(g("$.endDate")).alias("date_end"), S.price_from(description).alias("price_min"),
        F.try_element_at(highs, F.lit(1)).alias("price_max"),
        F.coalesce(S.age_limit(description), S.age_limit(name)).alias("age_restriction"))
    return out.filter((F.col("title") != "") & F.col("date_start").isNotNull()).withColumn(
        "event_id", S.event_id(F.lit("zeroevent"), F.col("date_start").cast("string"), F.col("title")))


STATE_ITEM = (
    "struct<title: string, date: string, seanceStartDate: string, seanceEndDate: string, topPlaceTitle: string,"
    " places: array<struct<title: string, address: string>>, price: struct<min: int, max: int>,"
    " genres: array<struct<title: string>>, microdata: string>"
)


def page_state_events(pages: DataFrame, html: str, *keep: str) -> tuple[DataFrame, DataFrame]:
    """SC-40: (events of the embedded page state, one-row count of items without a start date)."""
    state = F.regexp_extract(F.col(html), r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    schema = f"props struct<pageProps: struct<events: struct<items: array<{STATE_ITEM}>>>>"
    items = F.from_json(state, schema)["props"]["pageProps"]["events"]["items"]
    i = F.col("i")
    start = F.left(_first_given(i["date"], i["seanceStartDate"]), F.lit(10))
    rows = pages.select(*keep, F.explode(items).alias("i")).withColumn("start", start)
    usable = (F.length(F.trim(F.coalesce(i["title"], F.lit("")))) >= 3) & F.col("start").isNotNull()
    m = i["microdata"]
    place = F.try_element_at(i["places"], F.lit(1))
    end = F.left(i["seanceEndDate"], F.lit(10))
    title = F.trim(i["title"])
    events = rows.filter(usable).select(
        *keep, S.event_id(F.lit("culture_rf"), F.col("start"), title).alias("event_id"), title.alias("title"),
        F.nullif(F.trim(F.get_json_object(m, "$.text")), F.lit("")).alias("description"), F.col("start").alias("date_start"),
        F.nullif(end, F.col("start")).alias("date_end"),
        S.event_type(title, F.try_element_at(i["genres"], F.lit(1))["title"]).alias("event_type"),
        F.coalesce(i["topPlaceTitle"], place["title"], F.lit("Иркутск")).alias("location"), place["address"].alias("address"),
        i["price"]["min"].alias("price_min"), i["price"]["max"].alias("price_max"), F.get_json_object(m, "$.url").alias("url"),
        F.get_json_object(m, "$.image.url").alias("image_url"))
    return events, rows.filter(~F.coalesce(usable, F.lit(False))).agg(F.count("*").alias("skipped"))


# --- listings and Markdown -------------------------------------------------------------------------------------------
def text_lines(c: Column) -> Column:
    """Trimmed non-empty lines of a page or text."""
    plain = F.regexp_replace(c, r"<[^>]+>", "\n")
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def listing_events(pages: DataFrame, html: str, today: Column, *keep: str) -> DataFrame:
    """SC-41: one event per line that carries a date: the nearest fitting line of the five above is the title, the first
    venue-like of the three below the place, prices are looked for around the date."""
    base = pages.select(*keep, text_lines(F.col(html)).alias("lines"))
    is_date = lambda x: F.lower(x).rlike(DATE_LINE_TIME)
    at = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: is_date(F.element_at(F.col("lines"), i)))
    rows = base.filter(F.size("lines") > 0).select(*keep, "lines", F.explode(at).alias("i"))
    i, lines = F.col("i"), F.col("lines")
    low = lambda x: F.lower(x)
    start = F.greatest(i - 5, F.lit(2))
    above = F.when(i > start, F.reverse(F.slice(lines, start, F.greatest(i - start, F.lit(0))))).otherwise(F.array().cast("array<string>"))
    title_like = lambda x: (F.length(x) > 5) & ~low(x).isin(*SKIP_LINES) & ~low(x).isin(*GENRES) & ~x.rlike(r"^\d+\+$")
    below = F.when(i < F.size(lines), F.slice(lines, i + 1, F.lit(3))).otherwise(F.array().cast("array<string>"))
    stop = F.array_position(F.transform(below, is_date), True)
    before_stop = lambda n: (stop == 0) | (n + 1 < stop)
    skip = lambda x: low(x).isin(*SKIP_LINES, *GENRES, *NOT_VENUES) | x.rlike(r"^\d+\+$")
    venue_like = lambda x, n: before_stop(n) & ~skip(x) & low(x).rlike(VENUE_LINE) & (F.length(x) > 3) & (F.length(x) < 80)
    line = F.lower(F.element_at(lines, i))
    window = F.lower(F.array_join(F.slice(lines, F.greatest(i - 3, F.lit(1)), F.least(i - 1, F.lit(3)) + 5), "\n"))
    rows, parts = dated(rows, S.extract(line, DATE_LINE, 0))
    out = computed(rows, title=F.try_element_at(F.filter(above, title_like), F.lit(1))).select(
        *keep, i.alias("line"), "title",
        F.coalesce(F.try_element_at(F.filter(below, venue_like), F.lit(1)), F.lit("Иркутск")).alias("location"),
        F.coalesce(D.date_of(parts, today), today).alias("date_start"),
        S.extract(line, DATE_LINE_TIME, 3).alias("time_start"), S.extract(window, PRICE_LINE).try_cast("int").alias("price_min"))
    return out.filter(F.col("title").isNotNull() & S.is_valid_title("title"))


def markdown_events(pages: DataFrame, markdown: str, source: str, today: Column, *keep: str) -> DataFrame:
    """SC-42: blocks between headings to events: first line the title, then date, price, place, and the next lines."""
    blocks = F.split(F.col(markdown), r"\n#{1,3}\s+")
    rows = pages.select(*keep, F.explode(blocks).alias("block")).filter(F.length("block") >= 20)
    lines = F.split(F.trim("block"), "\n")
    low = F.lower("block")
    price = r"от\s*(\d+)\s*(?:руб|₽|р\.?)"
    rows, parts = dated(rows.withColumn("_today", today), S.extract(low, DATE_LINE, 0))
    rows = computed(
        rows, title=F.trim(F.element_at(lines, 1)), day=F.coalesce(D.date_of(parts, F.col("_today")), F.col("_today")),
        text=F.trim(F.array_join(F.slice(lines, 2, 3), " ")))
    title, day, text = F.col("title"), F.col("day"), F.col("text")
    return rows.filter(F.length(title).between(5, 200) & ~F.lower(title).rlike(S.any_of(SERVICE_HEADINGS))).select(
        *keep, title.alias("title"), day.alias("date_start"), S.extract(low, price, 0).alias("price"),
        S.extract(low, price).try_cast("int").alias("price_min"),
        F.coalesce(F.trim(S.extract(low, r"(?:место|площадка|адрес)[:\s]+([^\n]+)")), F.lit("Иркутск")).alias("location"),
        text.alias("description"), S.event_id(F.lit(source), day.cast("string"), title).alias("event_id"), S.event_type(title, text).alias("event_type"))


def markdown_links(pages: DataFrame, markdown: str, host: str, *keep: str) -> DataFrame:
    """SC-43: title to address per page; the first link of a title counts, picture hosts do not."""
    p = F.lit(r"\[([^\]]{3,60})\]\((https?://[^)]+)\)")
    md = F.col(markdown)
    pairs = F.arrays_zip(
        F.regexp_extract_all(md, p, F.lit(1)).alias("title"), F.regexp_extract_all(md, p, F.lit(2)).alias("url"))
    rows = pages.select(*keep, F.posexplode(pairs).alias("pos", "p")).select(
        *keep, "pos", F.lower(F.trim("p.title")).alias("title"), F.trim("p.url").alias("url"))
    fit = F.contains("url", F.lit(host)) & ~F.contains("url", F.lit("cdn." + host))
    return rows.filter(fit).groupBy(*keep, "title").agg(F.min_by("url", "pos").alias("url"))


def markdown_venues(pages: DataFrame, markdown: str, *keep: str) -> DataFrame:
    """SC-43: every line of the five above a venue label maps to that venue; the last label wins."""
    label = r"(?:площадка|место|где)\s*[:\-–]\s*(.+)"
    base = pages.select(*keep, F.split(F.col(markdown), "\n").alias("lines"))
    at = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.lower(F.element_at(F.col("lines"), i)).rlike(label))
    rows = base.select(*keep, "lines", F.explode(at).alias("i"))
    i, lines = F.col("i"), F.col("lines")
    venue = F.trim(S.extract(F.element_at(lines, i), "(?iu)" + label))
    first = F.greatest(i - 5, F.lit(1))
    above = F.filter(F.transform(F.slice(lines, first, i - first), lambda x: F.trim(x)), lambda x: F.length(x) > 3)
    keys = F.transform(above, lambda x: F.trim(F.regexp_replace(F.lower(x), r"^#+", "")))
    return rows.select(*keep, i.alias("i"), venue.alias("venue"), F.explode(keys).alias("title")).groupBy(*keep, "title").agg(
        F.max_by("venue", "i").alias("venue"))


def channel_messages(pages: DataFrame, html: str, channel: Column, *keep: str) -> DataFrame:
    """SC-44: channel preview to message rows; forwarded posts and posts without text are left out."""
    parts = F.filter(F.split(F.col(html), r'<div class="tgme_widget_message"'), lambda _, i: i > 0)
    rows = pages.select(*keep, channel.alias("channel"), F.explode(parts).alias("m"))
    m = F.col("m")
    number = S.extract(m, r'data-post="[^"]*?([^"/]+)"')
    body = S.extract(m, r'(?s)<div class="tgme_widget_message_text[^"]*"[^>]*>(.*?)</div>')
    text = F.trim(F.array_join(text_lines(body), "\n"))
    posted = F.try_to_timestamp(S.extract(m, r'<time[^>]*class="datetime"[^>]*datetime="([^"]+)"'))
    return rows.filter(~F.contains(m, F.lit("tgme_widget_message_forwarded_from_name"))).select(
        *keep, number.alias("id"), text.alias("text"), posted.alias("posted"),
        F.concat(F.lit("https://t.me/"), "channel", F.lit("/"), number).alias("url"),
        S.extract(m, r"background-image:\s*url\(['\"]?(https?://[^)'\"]+)").alias("image_url")).filter(F.coalesce("text", F.lit("")) != "")


def post_location(text: Column) -> Column:
    """Place of a post. Each line offers what follows a pin, what follows a place label, and each sentence the venue it names
    after its preposition; pins win over labels, labels over sentences."""
    lines = F.split(text, "\n")
    pins = F.transform(lines, lambda x: F.trim(F.coalesce(F.try_element_at(F.split(x, "📍"), F.lit(2)), F.lit(""))))
    label = rf"(?iU)(?:{S.any_of(POST_LABELS)})\s*[:–-]\s*"
    values = F.transform(lines, lambda x: F.when(x.rlike(label), F.trim(F.element_at(F.split(x, label, 2), -1))).otherwise(""))
    venue = rf"(?iU)^(?:в|на)\s+((?:\S+\s+){{0,3}}?(?:{POST_VENUE_WORDS})(?:\s*«[^»]+»)?)"
    venues = F.transform(F.split(text, r"[.!?\n]\s*"), lambda x: F.regexp_extract(F.trim(x), venue, 1))
    long_enough = lambda v: F.filter(v, lambda x: F.length(x) >= 3)
    return F.coalesce(*[S.first_filled(long_enough(v)) for v in (pins, values, venues)], F.lit("Иркутск"))


def posts_to_events(posts: DataFrame, text: str, posted: str, source: Column, today: Column, *keep: str) -> DataFrame:
    """SC-16: posts that read like events. Title from the first line or the first quoted name, date from the text or the
    post; dates more than a year away and greeting lines are rejected."""
    key = S.any_of(POST_KEYWORDS)
    raw = F.col(text)
    fit = posts.filter((F.length(raw) >= 30) & F.lower(raw).rlike(key)).select(
        *keep, raw.alias("_text"), F.col(posted).alias("_posted"), source.alias("source"))
    c, low = F.col("_text"), F.lower(F.col("_text"))
    first = F.trim(F.regexp_replace(F.element_at(F.split(F.trim(c), "\n"), 1), r"[*_~`]|[\x{1F300}-\x{1F9FF}]", ""))
    quoted = F.coalesce(S.extract(c, "«([^»]+)»"), S.extract(c, '"([^"]+)"'))
    title = F.when(F.length(first).between(5, 150), first).otherwise(quoted)
    candidate = F.coalesce(
        S.extract(low, rf"(?:с\s+)?(\d{{1,2}}(?:\s*[-–]\s*\d{{1,2}})?\s+(?:{MONTHS})(?:\s+\d{{4}})?)", 0),
        S.extract(low, r"(\d{1,2}\.\d{1,2}(?:\.\d{2,4})?)(?:[^\p{L}\p{N}_]|$)", 1))
    rows = computed(fit.withColumn("_today", today), _date=candidate, _iso=S.extract(c, r"(\d{4}-\d{2}-\d{2})"))
    rows = computed(rows, **D.date_parts("_date"))
    parts = {n: F.col(n) for n in D.date_parts("_date")}
    day = F.coalesce(D.date_of(parts, F.col("_today")), D.coerce_date("_iso"), D.relative_date(c, F.col("_posted")), F.col("_posted"))
    rows = computed(rows, title=title, date_start=day)
    t = F.col("title")
    greeting = (F.length(t) < 50) & F.lower(t).rlike(GREETING) & ~F.lower(t).rlike(key) & (F.upper(t) == t)
    kept = rows.filter(t.isNotNull() & ~greeting & (F.abs(F.datediff("date_start", today)) <= 365))
    x = F.col("_text")
    return kept.select(
        *keep, t, "date_start", S.extract(x, r"(\d{1,2}:\d{2})").alias("time_start"), post_location(x).alias("location"),
        S.price_any(x).alias("price_min"), x.alias("description"), S.age_limit(x).alias("age_restriction"),
        S.event_type("title", x).alias("event_type"),
        F.concat(F.lit("tg_"), "source", F.lit("_"), F.left(F.md5(F.concat(t, F.col("date_start").cast("string"))), F.lit(10))).alias("event_id"))


def ticket_blocks(pages: DataFrame, markdown: str, source: str, today: Column, *keep: str) -> DataFrame:
    """SC-42, ticket site: a picture whose caption is the title, perhaps a heading that names it better, then bullets with the
    date and the price range. The range line decides; the three lines before it are read backwards from it."""
    base = pages.select(*keep, today.alias("_today"), F.filter(F.transform(F.split(F.col(markdown), "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))
    spread = r"^\*\s+(\d[\d\s]*)[—–-]\s*(\d[\d\s]*)"
    at = F.filter(F.sequence(F.lit(3), F.greatest(F.size("lines"), F.lit(3))), lambda i: F.try_element_at("lines", i).rlike(spread))
    rows = base.select(*keep, "_today", "lines", F.explode(at).alias("i"))
    line = lambda back: F.coalesce(F.try_element_at("lines", F.col("i") - back), F.lit(""))
    rows = computed(rows.select(*keep, "_today", "lines", "i"), prices=line(0), when=S.extract(F.lower(line(1)), DATE_LINE, 0), name=line(2), above=line(3))
    number = lambda n: F.regexp_replace(F.regexp_extract("prices", spread, n), r"\s", "").try_cast("int")
    caption = F.regexp_extract("name", r"^!\[([^\]]{3,})\]", 1)
    heading = F.trim(F.regexp_extract("name", r"^#+\s+(.+)$", 1))
    rows, parts = dated(rows.drop("lines"), F.col("when"))
    rows = computed(rows, title=F.when(caption != "", F.trim(caption)).when((heading != "") & F.col("above").rlike(r"^!\["), heading),
                    date_start=D.date_of(parts, F.col("_today")), price_min=number(1), price_max=number(2))
    found = rows.filter(F.col("title").isNotNull() & F.col("date_start").isNotNull() & ~F.lower("title").rlike(NOISE_LINE))
    return found.select(*keep, "title", "date_start", "price_min", "price_max", S.event_id(F.lit(source), F.col("date_start").cast("string"), F.col("title")).alias("event_id"))


def description_after(text: Column) -> Column:
    """SC-52: the lines that follow a match as one text. Lines are read in order: a picture, heading, rule or dated bullet ends
    the description, empty and noise lines are passed over, of all others the plain text is kept."""
    plain = lambda x: S.strip_markdown(F.regexp_replace(x, r"^\*\s+", ""))
    ends = lambda x: x.rlike(r"^(?:!\[|##|---)") | (x.startswith("*") & F.lower(x).rlike(DATE_LINE))
    start = F.struct(F.lit(True).alias("open"), F.array().cast("array<string>").alias("kept"))

    def read(state: Column, line: Column) -> Column:
        x = F.trim(line)
        going = state["open"] & ~ends(x)
        wanted = going & (plain(x) != "") & ~F.lower(x).rlike(NOISE_LINE)
        return F.struct(going.alias("open"), F.when(wanted, F.array_append(state["kept"], plain(x))).otherwise(state["kept"]).alias("kept"))

    return F.nullif(F.array_join(F.aggregate(F.split(text, "\n"), start, read, lambda s: s["kept"]), " "), F.lit(""))
