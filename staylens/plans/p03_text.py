"""Text, date and label functions over the listing cards, the pages and the event calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens import model as M
from staylens.functions import dates as D
from staylens.functions import metrics as X
from staylens.functions import text as S
from staylens.functions.factors import occupancy_level, tariff_advice
from staylens.functions.geo import district_coords, resolve_district_name
from staylens.plans.registry import query
from staylens.sources.payloads import WEATHER_TEXT, weather_text

TODAY = "(SELECT today FROM event_today)"
NAMES = "([" + ", ".join(f"'{m}'" for m in D.MONTHS_GENITIVE + M.MONTH_NAMES) + "])"


def q(text: str) -> str:
    return text.replace("'", "''")


def sql_month(expr: str) -> str:
    return f"((nullif(list_position({NAMES}, {expr}), 0) - 1) % 12 + 1)"


def sql_date(y: str, m: str, d: str) -> str:
    return f"TRY_CAST(lpad(CAST({y} AS VARCHAR), 4, '0') || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad(CAST({d} AS VARCHAR), 2, '0') AS DATE)"


def sql_case(table: dict[str, str], expr: str) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def rx(expr: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({expr}, '{q(pattern)}', {group}), '')"


@query("sc01_title_key", r"""SELECT o_orderkey, trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key
    FROM listing""")
def _(t):
    return t.listing.select("o_orderkey", S.title_key("title").alias("key"))


CLEAN = r"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("sc02_clean_text", f"SELECT page_id, {CLEAN} AS text FROM pages")
def _(t):
    return t.raw("pages").select("page_id", S.clean_text("html").alias("text"))


ENT = "html"
for _entity, _char in S.ENTITIES.items():
    ENT = f"replace({ENT}, '{_entity}', '{q(_char)}')"


@query("sc03_clean_html", f"SELECT page_id, {CLEAN.replace('html', ENT)} AS text FROM pages")
def _(t):
    return t.raw("pages").select("page_id", S.clean_html("html").alias("text"))


MD = "'![pic](http://x/' || o_orderkey || ') **' || title || '** see [the *card*](http://y/' || o_orderkey || ') *' || place || '*'"


@query("sc04_strip_markdown", rf"""SELECT o_orderkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({MD},
    '!\[[^\]]*\]\([^)]+\)', '', 'g'), '\[([^\]]*)\]\([^)]+\)', '\1', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g')) AS text FROM listing""")
def _(t):
    k = F.col("o_orderkey").cast("string")
    md = F.concat(F.lit("![pic](http://x/"), k, F.lit(") **"), F.col("title"), F.lit("** see [the *card*](http://y/"), k,
                  F.lit(") *"), F.col("place"), F.lit("*"))
    return t.listing.select("o_orderkey", S.strip_markdown(md).alias("text"))


SLUG = "lower(title)"
for _a, _b in S.TRANSLIT.items():
    SLUG = f"replace({SLUG}, '{_a}', '{_b}')"
SLUG = f"regexp_replace({SLUG}, '[^a-z0-9_]', '', 'g')"


@query("sc05_ascii_slug", f"SELECT o_orderkey, coalesce(nullif({SLUG}, ''), 'all') AS slug FROM listing")
def _(t):
    return t.listing.select("o_orderkey", S.ascii_slug("title").alias("slug"))


@query("sc06_event_ids", """SELECT o_orderkey, source || '_' || left(md5(source || '_' || date_text || '_' || title), 12) AS id,
    source || '_' || left(md5(source || '_' || title || '_' || date_text), 12) AS id_title_first,
    source || '_' || left(md5(coalesce(nullif(date_raw, ''), title)), 10) AS id_short FROM listing""")
def _(t):
    src, day, title = F.col("source"), F.col("date_text"), F.col("title")
    return t.listing.select("o_orderkey", S.event_id(src, day, title).alias("id"),
                            S.event_id_title_first(src, title, day).alias("id_title_first"),
                            S.event_id_from_url(src, F.col("date_raw"), title).alias("id_short"))


RED = "error_text"
for _p in S.CREDENTIALS:
    RED = f"regexp_replace({RED}, '(?i){_p}', '[REDACTED]', 'g')"


@query("sc07_redact", f"SELECT o_orderkey, {RED} AS text FROM listing")
def _(t):
    return t.listing.select("o_orderkey", S.redact("error_text").alias("text"))


BLOCK = "coalesce(title, '') || chr(10) || 'Место: ' || coalesce(place, '') || chr(10) || price_text"
LOC = f"coalesce({rx(BLOCK, '(?i)' + S.PLACE_LABEL + '+([^\n,]{3,80})')}, {rx(BLOCK, '(?i)' + S.VENUE, 0)})"
LOC = rf"trim(regexp_replace(trim(regexp_extract({LOC}, '^([^•]*)', 1)), '(?i)\s*\d{{1,2}}\s+(?:янв|фев|мар|апр|мая|июн|июл|авг|сен|окт|ноя|дек)[\p{{L}}\p{{N}}_]*.*$', ''))"


@query("sc08_location", f"SELECT o_orderkey, coalesce(nullif({LOC}, ''), 'Иркутск') AS location FROM listing")
def _(t):
    block = F.concat(F.col("title"), F.lit("\nМесто: "), F.coalesce("place", F.lit("")), F.lit("\n"), F.col("price_text"))
    return t.listing.select("o_orderkey", S.location_from_block(block).alias("location"))


ADDR = rf"trim(regexp_replace(regexp_replace(trim({rx('place', '(?i)' + S.ADDRESS, 0)}), '[,.]+$', ''), '\s+', ' ', 'g'))"


@query("sc09_address", f"SELECT o_orderkey, CASE WHEN length({ADDR}) > 8 AND length({ADDR}) < 120 THEN {ADDR} END AS address FROM listing")
def _(t):
    return t.listing.select("o_orderkey", S.address_in("place").alias("address"))


RAWT = "title || ' ' || coalesce(place, '')"


@query("sc10_split_title", rf"""WITH r AS (SELECT o_orderkey, {RAWT} AS c, regexp_extract({RAWT}, ' ([^ ]*)$', 1) AS w FROM listing),
    p AS (SELECT *, regexp_matches(lower(w), '{S.TITLE_VENUE_WORDS}') AS hit,
      CASE WHEN regexp_matches(lower(c), '{S.TITLE_VENUE_WORDS}') THEN strpos(lower(c), regexp_extract(lower(c), '{S.TITLE_VENUE_WORDS}')) ELSE 0 END AS pos FROM r)
    SELECT o_orderkey, CASE WHEN hit THEN trim(regexp_replace(c, ' [^ ]*$', '')) WHEN pos > 6 THEN trim(substr(c, 1, pos - 1)) ELSE c END AS title,
      CASE WHEN hit THEN trim(w) WHEN pos > 6 THEN trim(substr(c, pos)) ELSE 'Иркутская область' END AS venue FROM p""")
def _(t):
    title, venue = S.split_title(F.concat(F.col("title"), F.lit(" "), F.coalesce("place", F.lit(""))))
    return t.listing.select("o_orderkey", title.alias("title"), venue.alias("venue"))


@query("sc11_prices", rf"""SELECT o_orderkey, TRY_CAST({rx('lower(price_text)', S.PRICE_FROM)} AS INTEGER) AS price_from,
    TRY_CAST(regexp_replace({rx('lower(price_text)', S.PRICE_ANY)}, '\s+', '', 'g') AS INTEGER) AS price_any FROM listing""")
def _(t):
    return t.listing.select("o_orderkey", S.price_from("price_text").alias("price_from"), S.price_any("price_text").alias("price_any"))


AGE = f"TRY_CAST({rx('age_text', S.AGE_PLUS)} AS INTEGER)"
AGER = "TRY_CAST(" + rx("age_range", r"^\s*(\d{1,2})(?:\s*[-–]\s*\d{0,2}|\s*\+)?\s*$") + " AS INTEGER)"


@query("sc12_ages", f"""SELECT o_orderkey, CASE WHEN {AGE} > 0 AND {AGE} <= 21 THEN {AGE} || '+' END AS age,
    CASE WHEN {AGER} > 0 THEN {AGER} || '+' END AS age_from_range FROM listing""")
def _(t):
    return t.listing.select("o_orderkey", S.age_limit("age_text").alias("age"), S.age_range("age_range").alias("age_from_range"))


FULL = "lower(title || ' ' || coalesce(description, ''))"
CLASS = "CASE " + " ".join(
    f"WHEN regexp_matches({text}, '{S.any_of(words)}') THEN '{name}'" for text in ("lower(title)", FULL)
    for name, words in S.EVENT_KEYWORDS.items()) + " ELSE 'event' END"


@query("sc13_event_type", rf"""SELECT o_orderkey, coalesce({sql_case(S.JSONLD_TYPES, "trim(regexp_extract(schema_type, '([^/#]*)$', 1))")}, {CLASS}) AS kind
    FROM listing""")
def _(t):
    return t.listing.select("o_orderkey", S.event_type("title", "description", F.col("schema_type")).alias("kind"))


LABEL = f"CASE WHEN coalesce(event_type, '') = '' THEN 'событие' ELSE coalesce({sql_case(S.EVENT_TYPE_LABELS, 'lower(event_type)')}, event_type) END"


@query("sc14_labels", f"SELECT event_id, {LABEL} AS label FROM cal_events")
def _(t):
    return t.cal_events.select("event_id", S.event_type_label("event_type").alias("label"))


HOTEL_DOC = """concat_ws('. ', 'Отель ' || name, CASE WHEN city <> '' THEN 'в городе ' || city END,
    CASE WHEN district <> '' THEN '(' || district || ' район)' END, CASE WHEN rating <> 0 THEN 'Рейтинг: ' || CAST(rating AS VARCHAR) END,
    CASE WHEN min_price <> 0 THEN 'Минимальная цена: ' || min_price || ' руб.' END) || '.'"""
EVENT_DOC = f"""concat_ws('. ', coalesce(title, 'Событие'), CASE WHEN coalesce(location, '') <> '' THEN 'Место: ' || location END,
    'Дата: ' || CAST(date_start AS VARCHAR), CASE WHEN coalesce(event_type, '') <> '' THEN 'Тип: ' || {LABEL} END) || '.'"""


@query("sc15_hotel_documents", f"SELECT id, {HOTEL_DOC} AS text FROM hotels")
def _(t):
    return t.hotels.select("id", S.hotel_text().alias("text"))


@query("sc15_event_documents", f"SELECT event_id, {EVENT_DOC} AS text FROM cal_events")
def _(t):
    return t.cal_events.select("event_id", S.event_text().alias("text"))


NAMED = r"(\d{1,2})\s+([\p{L}\p{N}_]+)(?:\s+(\d{4}))?"
DOT = r"(\d{1,2})\.(\d{1,2})(?:\.(\d{2,4}))?"
ROLL = f"year({TODAY}) + CASE WHEN m < month({TODAY}) OR (m = month({TODAY}) AND d < day({TODAY})) THEN 1 ELSE 0 END"


@query("sc17_russian_date", f"""WITH p AS (SELECT o_orderkey, CAST({rx('lower(date_text)', NAMED)} AS INTEGER) AS d,
      {sql_month(rx('lower(date_text)', NAMED, 2))} AS m, CAST({rx('lower(date_text)', NAMED, 3)} AS INTEGER) AS y,
      CAST({rx('lower(date_text)', DOT)} AS INTEGER) AS d2, CAST({rx('lower(date_text)', DOT, 2)} AS INTEGER) AS m2,
      CAST({rx('lower(date_text)', DOT, 3)} AS INTEGER) AS y2 FROM listing)
    SELECT o_orderkey, CAST(CASE WHEN m IS NOT NULL THEN {sql_date(f'coalesce(y, {ROLL})', 'm', 'd')}
      ELSE {sql_date(f'CASE WHEN y2 < 100 THEN y2 + 2000 ELSE coalesce(y2, year({TODAY})) END', 'm2', 'd2')} END AS VARCHAR) AS day FROM p""")
def _(t):
    return t.listing.select("o_orderkey", D.russian_date("date_text", t.event_today).alias("day"))


G = "|".join(D.MONTHS_GENITIVE)
TWO = rf"с\s+(\d{{1,2}})\s+({G})\s+(?:по|до)\s+(\d{{1,2}})\s+({G})"
ONE = rf"(?:с\s+)?(\d{{1,2}})\s*[-–—]\s*(\d{{1,2}})\s+({G})"


@query("sc18_russian_range", f"""WITH p AS (SELECT o_orderkey, CAST(coalesce({rx('range_text', TWO)}, {rx('range_text', ONE)}) AS INTEGER) AS d,
      coalesce({sql_month(rx('range_text', TWO, 2))}, {sql_month(rx('range_text', ONE, 3))}) AS m,
      CAST(coalesce({rx('range_text', TWO, 3)}, {rx('range_text', ONE, 2)}) AS INTEGER) AS d2,
      coalesce({sql_month(rx('range_text', TWO, 4))}, {sql_month(rx('range_text', ONE, 3))}) AS m2,
      {rx('range_text', TWO)} IS NOT NULL AS two FROM listing),
    z AS (SELECT *, {ROLL} AS y FROM p)
    SELECT o_orderkey, CAST({sql_date('y', 'm', 'd')} AS VARCHAR) AS start_day,
      CAST(CASE WHEN two OR d2 > d THEN {sql_date('y', 'm2', 'd2')} END AS VARCHAR) AS end_day FROM z""")
def _(t):
    a, b = D.russian_range("range_text", t.event_today)
    return t.listing.select("o_orderkey", a.alias("start_day"), b.alias("end_day"))


CLK = r"^(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?$"
PART = lambda i: f"regexp_extract(trim(time_text), '{CLK}', {i})"


@query("sc19_clock_time", f"""SELECT o_orderkey, CASE WHEN TRY_CAST({PART(1)} AS INTEGER) < 24 AND TRY_CAST({PART(2)} AS INTEGER) < 60
    THEN lpad({PART(1)}, 2, '0') || ':' || lpad({PART(2)}, 2, '0') || ':' || right('00' || {PART(3)}, 2) END AS clock FROM listing""")
def _(t):
    return t.listing.select("o_orderkey", D.clock_time("time_text").alias("clock"))


@query("sc20_coerce_date", """SELECT o_orderkey, CAST(coalesce(TRY_CAST(date_raw AS DATE), DATE '1970-01-01' + TRY_CAST(date_raw AS INTEGER)) AS VARCHAR) AS day
    FROM listing""")
def _(t):
    return t.listing.select("o_orderkey", D.coerce_date("date_raw").alias("day"))


@query("sc22_iso_parts", """SELECT event_id, CAST(date_start AS VARCHAR) AS day, left(time_start, 5) AS clock,
    CASE WHEN date_end <> date_start THEN CAST(date_end AS VARCHAR) END AS end_day FROM cal_events""")
def _(t):
    start = F.concat_ws("T", F.col("date_start").cast("string"), "time_start")
    a, b, c = D.iso_parts(start, F.col("date_end").cast("string"))
    return t.cal_events.select("event_id", a.alias("day"), b.alias("clock"), c.alias("end_day"))


@query("sc23_month_and_season", """SELECT CAST(month(date_start) AS INTEGER) AS month, """ + "([" + ", ".join(f"'{m}'" for m in M.MONTH_NAMES) + """])[month(date_start)] AS name,
    CASE WHEN month(date_start) IN (12, 1, 2, 3) THEN 'winter' WHEN month(date_start) IN (4, 5) THEN 'spring'
    WHEN month(date_start) IN (6, 7, 8, 9) THEN 'summer' ELSE 'autumn' END AS season, count(*) AS n FROM cal_events GROUP BY 1, 2, 3""")
def _(t):
    m = F.month("date_start")
    return t.cal_events.groupBy(m.alias("month"), X.month_name(m).alias("name"), X.season(m).alias("season")).agg(F.count("*").alias("n"))


YW = "year(d) - CASE WHEN month(d) < 4 THEN 1 ELSE 0 END"
YS = "CAST(year(d) - CASE WHEN month(d) < 6 THEN 1 ELSE 0 END AS VARCHAR)"


@query("sc24_season_ranges", f"""WITH x AS (SELECT DISTINCT date_start AS d FROM cal_events)
    SELECT CAST(d AS VARCHAR) AS focus, CAST({YW} AS VARCHAR) || '-12-01' AS winter_from, CAST({YW} + 1 AS VARCHAR) || '-03-31' AS winter_to,
    {YS} || '-06-01' AS summer_from, {YS} || '-09-30' AS summer_to, CAST(d - 29 AS VARCHAR) AS trail_from,
    d - 29 <= DATE '1997-10-25' AND d >= DATE '1997-06-24' AS in_gap FROM x""")
def _(t):
    d = F.col("d")
    wf, wt = D.season_range(d, "winter")
    sf, st = D.season_range(d, "summer")
    pf, pt = D.period_range(d, 30)
    gap = D.overlaps(pf, pt, F.lit("1997-06-24").cast("date"), F.lit("1997-10-25").cast("date"))
    return t.cal_events.select(F.col("date_start").alias("d")).distinct().select(
        d.alias("focus"), wf.alias("winter_from"), wt.alias("winter_to"), sf.alias("summer_from"), st.alias("summer_to"),
        pf.alias("trail_from"), gap.alias("in_gap"))


@query("sc25_calendar_features", """SELECT CAST(d AS VARCHAR) AS d, CAST(isodow(d) - 1 AS INTEGER) AS day_of_week, CAST(day(d) AS INTEGER) AS day_of_month,
    CAST(month(d) AS INTEGER) AS month, CAST(quarter(d) AS INTEGER) AS quarter, CAST(weekofyear(d) AS INTEGER) AS week_of_year,
    CAST(isodow(d) >= 6 AS INTEGER) AS is_weekend, CAST(day(d) = 1 AS INTEGER) AS is_month_start, CAST(d = last_day(d) AS INTEGER) AS is_month_end
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def _(t):
    days = t.raw("orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select("d", *[c.alias(n) for n, c in D.calendar_columns("d").items()])


HD = "([" + ", ".join(f"'{m:02d}-{d:02d}'" for m, d, _ in D.PUBLIC_HOLIDAYS) + "])"
HN = "([" + ", ".join(f"'{n}'" for _, _, n in D.PUBLIC_HOLIDAYS) + "])"
ISH = lambda e: f"list_contains({HD}, strftime({e}, '%m-%d'))"
BREAKS = ", ".join(f"(DATE '{s}', DATE '{e}')" for s, e, _ in D.SCHOOL_BREAKS)


@query("sc26_holiday_features", f"""WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) + 9496 AS d FROM orders),
    h AS (SELECT CAST(y || '-' || md AS DATE) AS hd FROM (SELECT unnest(range(2019, 2030)) AS y), (SELECT unnest({HD}) AS md)),
    n AS (SELECT d, least(30, min(hd - d)) AS k FROM x JOIN h ON hd >= d AND hd <= d + 366 GROUP BY d),
    b AS (SELECT * FROM (VALUES {BREAKS}) AS b(s, e)),
    l AS (SELECT d, bool_or({ISH('d + i')} AND isodow(d + i) IN (1, 5)) AS lw FROM x, (SELECT CAST(unnest(range(-3, 4)) AS INTEGER) AS i) GROUP BY d)
    SELECT CAST(x.d AS VARCHAR) AS d, {ISH('x.d')} AS is_holiday, {HN}[nullif(list_position({HD}, strftime(x.d, '%m-%d')), 0)] AS holiday_name,
      CAST(k AS INTEGER) AS days_to_holiday, lw AS is_long_weekend, {ISH('x.d + 1')} AS is_pre_holiday, {ISH('x.d - 1')} AS is_post_holiday,
      EXISTS (SELECT 1 FROM b WHERE x.d BETWEEN s AND e) AS is_school_holiday,
      CAST(CASE WHEN EXISTS (SELECT 1 FROM b WHERE x.d BETWEEN s AND e) THEN 0
        ELSE least(30, coalesce((SELECT min(s - x.d) FROM b WHERE s > x.d), 30)) END AS INTEGER) AS days_to_school_holiday
    FROM x JOIN n ON n.d = x.d JOIN l ON l.d = x.d""")
def _(t):
    days = t.raw("orders").select(F.date_add(F.to_date("o_orderdate"), 9496).alias("d")).distinct()
    return days.select("d", *[c.alias(n) for n, c in D.holiday_columns("d").items()])


@query("sc27_haversine", """SELECT id, round(2 * 6371 * asin(sqrt(sin(radians(lat - 52.2978) / 2) ** 2
    + cos(radians(CAST(52.2978 AS DOUBLE))) * cos(radians(lat)) * sin(radians(lon - 104.2964) / 2) ** 2)), 6) AS km FROM hotels""")
def _(t):
    lat, lon = M.DEFAULT_COORDS
    return t.hotels.select("id", X.haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")).alias("km"))


@query("sc28_own_occupancy", """SELECT id, CAST(date AS VARCHAR) AS date, CASE WHEN rooms_num > 0 THEN round(100.0 * (rooms_num -
    least(greatest(coalesce(free_rooms_amount, 0), 0), rooms_num)) / rooms_num, 6) END AS occupancy FROM hotel_statistics""")
def _(t):
    return t.stats.select("id", "date", X.own_occupancy().alias("occupancy"))


@query("sc29_size_buckets", """SELECT CASE WHEN rooms_num <= 15 THEN 'mini' WHEN rooms_num <= 50 THEN 'mid' ELSE 'large' END AS bucket, count(*) AS n
    FROM hotel_statistics GROUP BY 1""")
def _(t):
    return t.stats.groupBy(X.size_bucket().alias("bucket")).agg(F.count("*").alias("n"))


@query("sc32_weather_text", "SELECT CAST(date AS VARCHAR) AS date, CASE weather_code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in WEATHER_TEXT.items())
       + " END AS text, temperature_max > 10 AND precipitation < 5 AS good, temperature_max > 15 AND precipitation < 5 AS warm FROM weather")
def _(t):
    temp, rain = F.col("temperature_max"), F.col("precipitation")
    return t.weather.select("date", weather_text(F.col("weather_code")).alias("text"), X.good_weather(temp, rain).alias("good"),
                            X.good_weather(temp, rain, 15.0).alias("warm"))


@query("sc45_district_resolver", "SELECT o_orderkey, CASE lower(district_text) " + " ".join(f"WHEN '{c}' THEN '{d}'" for c, d in M.CITY_TO_DISTRICT.items())
       + " ELSE CASE WHEN list_contains([" + ", ".join(f"'{d}'" for d in M.DISTRICTS) + "], district_text) THEN district_text "
       + " ".join(f"WHEN contains(lower(district_text), '{d.lower()}') OR contains('{d.lower()}', lower(district_text)) THEN '{d}'" for d in M.DISTRICTS)
       + " END END AS district FROM listing")
def _(t):
    return t.listing.select("o_orderkey", resolve_district_name(F.col("district_text")).alias("district"))


@query("sc46_district_coords", "SELECT o_orderkey, CASE district_text " + " ".join(f"WHEN '{d}' THEN {a}" for d, (a, _) in M.DISTRICT_CENTERS.items())
       + " ELSE 52.2978 END::DOUBLE AS lat FROM listing")
def _(t):
    return t.listing.select("o_orderkey", district_coords(F.col("district_text"))[0].alias("lat"))


@query("sc47_regressor_slug", """SELECT event_id, CASE WHEN event_type IS NULL OR event_type IN ('', 'unknown') THEN 'general_event'
    ELSE translate(lower(event_type), ' -', '__') END AS slug FROM cal_events""")
def _(t):
    return t.cal_events.select("event_id", S.regressor_slug("event_type").alias("slug"))


@query("flt02_spam", f"""SELECT o_orderkey, regexp_matches({FULL}, '{S.any_of(S.SPAM_MARKERS)}') AS spam FROM listing""")
def _(t):
    return t.listing.select("o_orderkey", S.is_spam("title", "description").alias("spam"))


@query("flt03_outside_region", f"""SELECT o_orderkey, regexp_matches(lower(coalesce(place, '')), '{S.any_of(S.OUTSIDE_MARKERS)}')
    AND NOT regexp_matches(lower(coalesce(place, '')), '{S.any_of(S.REGION_MARKERS)}') AS outside FROM listing""")
def _(t):
    return t.listing.select("o_orderkey", S.is_outside_region("place").alias("outside"))


@query("flt04_clean_location", """SELECT o_orderkey, CASE WHEN length(trim(place)) BETWEEN 3 AND 200 AND NOT contains(lower(place), 'не могут')
    AND NOT contains(lower(place), 'индивидуальное предприятие') AND NOT contains(lower(place), 'http') AND NOT contains(lower(place), '«"')
    THEN trim(place) END AS location FROM listing""")
def _(t):
    return t.listing.select("o_orderkey", S.clean_location("place").alias("location"))


@query("flt13_valid_title", f"SELECT o_orderkey, length(title) BETWEEN 1 AND 120 AND NOT regexp_matches(lower(title), '{S.LEGAL_NOISE}') AS valid FROM listing")
def _(t):
    return t.listing.select("o_orderkey", S.is_valid_title("title").alias("valid"))


@query("flt07_rating", "SELECT id, CASE WHEN rating * 2 > 5 THEN round_even(rating * 2 / 2, 1) ELSE rating * 2 END AS rating FROM hotels")
def _(t):
    r = F.col("rating") * 2
    return t.hotels.select("id", F.when(r > 5, F.bround(r / 2, 1)).otherwise(r).alias("rating"))


@query("sc51_occupancy_bands", """SELECT CASE WHEN occupancy < 40 THEN 'low' WHEN occupancy < 70 THEN 'medium' ELSE 'high' END AS band,
    CASE WHEN occupancy < 20 THEN 1 WHEN occupancy < 40 THEN 2 WHEN occupancy < 60 THEN 3 WHEN occupancy < 80 THEN 4 ELSE 5 END AS step, count(*) AS n
    FROM district_daily GROUP BY 1, 2""")
def _(t):
    o = F.col("occupancy")
    return t.district_daily.groupBy(X.occupancy_band(o).alias("band"), X.occupancy_step(o).alias("step")).agg(F.count("*").alias("n"))


@query("sc34_tariff_advice", """SELECT CASE WHEN occupancy > 70 THEN 'raise' WHEN occupancy > 50 THEN 'hold' WHEN occupancy > 30 THEN 'promote' ELSE 'discount' END AS advice,
    CASE WHEN occupancy > 60 THEN 'высокая' WHEN occupancy > 40 THEN 'средняя' ELSE 'низкая' END AS level, count(*) AS n FROM district_daily GROUP BY 1, 2""")
def _(t):
    o = F.col("occupancy")
    return t.district_daily.groupBy(tariff_advice(o).alias("advice"), occupancy_level(o).alias("level")).agg(F.count("*").alias("n"))


@query("sc31_price_rules", """SELECT district, CAST(date AS VARCHAR) AS date, CASE WHEN occupancy > 75 THEN least(30, round_even((occupancy - 60) * 0.8, 0))
    WHEN occupancy > 55 THEN least(15, round_even((occupancy - 50) * 0.5, 0)) WHEN occupancy < 35 THEN -least(25, round_even((40 - occupancy) * 0.8, 0)) ELSE 0 END AS percent
    FROM district_daily""")
def _(t):
    return t.district_daily.select("district", "date", X.price_change_percent(F.col("occupancy")).alias("percent"))
