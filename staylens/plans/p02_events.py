"""Events: scans, geography, day logic, deduplication, upserts and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.functions import text as S
from staylens.operators import events as E
from staylens.operators import upsert as U
from staylens.plans import p01_market as P1
from staylens.plans.p03_text import CLASS
from staylens.plans.registry import query
from staylens.sources import tables as R

TODAY = "(SELECT today FROM event_today)"
EV = """event_id, title, description, CAST(date_start AS VARCHAR) AS date_start, CAST(date_end AS VARCHAR) AS date_end,
    event_type, location, source_id, url, time_start, price_min, price_max, image_url, address, age_restriction"""
PLAIN = EV


@query("src01_typed_scans", """SELECT 'hotels' AS name, count(*) AS n FROM hotels UNION ALL SELECT 'hotel_statistics', count(*) FROM hotel_statistics
    UNION ALL SELECT 'events', count(*) FROM cal_events UNION ALL SELECT 'forecasts', count(*) FROM forecasts""")
def _(t):
    tables = {"hotels": t.hotels, "hotel_statistics": t.stats, "events": t.cal_events, "forecasts": t.forecasts}
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("src02_hotel_listing", """SELECT id, name, city, district, (SELECT count(*) FROM hotels WHERE district = 'ASIA') AS total FROM hotels
    WHERE district = 'ASIA' ORDER BY id LIMIT 10 OFFSET 5""")
def _(t):
    return R.hotel_page(t.hotels, district="ASIA", limit=10, offset=5).select("id", "name", "city", "district", "total")


@query("st04_pagination", """SELECT id, (SELECT count(*) FROM hotels) > 20 AS has_more FROM hotels ORDER BY id LIMIT 10 OFFSET 10""")
def _(t):
    return R.hotel_page(t.hotels, limit=10, offset=10).select("id", "has_more")


@query("src03_point_lookup", "SELECT id, name, city, district, rating, min_price, accommodation_type FROM hotels WHERE id = '7'")
def _(t):
    return t.hotels.filter(F.col("id") == "7").select("id", "name", "city", "district", "rating", "min_price", "accommodation_type")


@query("src04_fact_range", """SELECT id, CAST(date AS VARCHAR) AS date, coalesce(rooms_num, 0) AS rooms_num, coalesce(free_rooms_amount, 0) AS free_rooms_amount,
    coalesce(available_rooms_percent, 0) AS available_rooms_percent, min_price, max_capacity FROM hotel_statistics
    WHERE id = '7' AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""")
def _(t):
    return R.hotel_days(t.stats, "7", F.lit("1997-01-01").cast("date"), F.lit("1998-12-31").cast("date"))


@query("src05_event_scan", f"""SELECT {EV} FROM cal_events WHERE date_start >= {TODAY} - 365 AND source_id = 'O' AND contains(lower(location), 'nation_1;')
    ORDER BY abs(cal_events.date_start - {TODAY}), event_id LIMIT 50 OFFSET 5""")
def _(t):
    rows = E.scan(t.cal_events, date_from=F.date_sub(t.event_today, 365), source="O", city="NATION_1;")
    return E.nearest_first(rows, t.event_today, 50, 5)


@query("st01_nearest_events", f"SELECT event_id, title FROM cal_events ORDER BY abs(date_start - {TODAY}), event_id LIMIT 100")
def _(t):
    return E.nearest_first(t.cal_events, t.event_today, 100).select("event_id", "title")


@query("flt05_contains_ci", "SELECT event_id, location FROM cal_events WHERE location ILIKE '%nation\\_1;%' ESCAPE '\\'")
def _(t):
    return t.cal_events.filter(E.contains_ci("location", "Nation_1;")).select("event_id", "location")


@query("flt06_future_only", f"SELECT event_id FROM cal_events WHERE date_start >= {TODAY}")
def _(t):
    return E.upcoming(t.cal_events, t.event_today).select("event_id")


@query("flt08_row_constraints", """SELECT CASE WHEN rating > 4 THEN 'rating' WHEN min_price < 500 THEN 'price' WHEN name = '' THEN 'name' END AS reason, count(*) AS n
    FROM (SELECT rating, min_price, name FROM hotels) GROUP BY 1""")
def _(t):
    good, bad = R.check_rows(t.hotels, {"rating": F.col("rating").between(0, 4), "price": F.col("min_price") >= 500, "name": F.col("name") != ""})
    return good.select(F.lit(None).cast("string").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("flt09_not_past", f"SELECT event_id, event_type FROM cal_events WHERE event_type <> 'event' OR date_start >= {TODAY}")
def _(t):
    return E.not_past(t.cal_events, "event_type", "date_start", t.event_today).select("event_id", "event_type")


@query("flt10_explorer", f"""SELECT event_id, title FROM cal_events WHERE date_start BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' AND event_type IN ('concert', 'sport')
    AND source_id IN ('O', 'F') AND (contains(lower(title), 'auto') OR contains(lower(coalesce(location, '')), 'auto') OR contains(lower(coalesce(description, '')), 'auto'))""")
def _(t):
    d = lambda s: F.lit(s).cast("date")
    return E.explorer(t.cal_events, d("1998-01-01"), d("1998-06-30"), ["concert", "sport"], ["O", "F"], "auto").select("event_id", "title")


@query("flt11_token_search", f"""WITH e AS (SELECT *, contains(lower(concat_ws(' ', title, event_type, location)), 'build') OR contains(lower(concat_ws(' ', title, event_type, location)), 'festi') AS hit
    FROM cal_events WHERE date_start >= {TODAY}) SELECT event_id, title FROM e WHERE hit OR NOT (SELECT bool_or(hit) FROM e) ORDER BY abs(date_start - {TODAY}), event_id LIMIT 7""")
def _(t):
    found = E.token_search(E.upcoming(t.cal_events, t.event_today), "Building a festival in it")
    return E.nearest_first(found, t.event_today, 7).select("event_id", "title")


@query("flt11_token_search_fallback", f"""SELECT event_id, title FROM cal_events WHERE date_start >= {TODAY} ORDER BY abs(date_start - {TODAY}), event_id LIMIT 7""")
def _(t):
    found = E.token_search(E.upcoming(t.cal_events, t.event_today), "zzzz yyyy")
    return E.nearest_first(found, t.event_today, 7).select("event_id", "title")


@query("flt12_cascade_search", "SELECT id, city, district FROM hotels WHERE district = 'ASIA' ORDER BY id LIMIT 7")
def _(t):
    return E.cascade_search(t.hotels, "NO SUCH CITY", "ASIA", 7).select("id", "city", "district")


@query("flt14_event_gate", """SELECT source || '_' || o_orderkey AS event_id, CAST(coalesce(TRY_CAST(date_raw AS DATE), DATE '1970-01-01' + TRY_CAST(date_raw AS INTEGER)) AS VARCHAR) AS date_start
    FROM listing WHERE coalesce(TRY_CAST(date_raw AS DATE), DATE '1970-01-01' + TRY_CAST(date_raw AS INTEGER)) IS NOT NULL""")
def _(t):
    raw = t.listing.withColumn("event_id", F.concat_ws("_", "source", "o_orderkey")).withColumnRenamed("source", "source_id")
    return E.to_event_rows(raw).select("event_id", "date_start")


@query("src18_listing_rows", f"""SELECT o_orderkey, 'irk_' || left(md5('irk_' || day || '_' || title), 12) AS event_id, day AS date_start FROM (
    SELECT o_orderkey, title, CAST(coalesce(TRY_CAST(date_raw AS DATE), DATE '1970-01-01' + TRY_CAST(date_raw AS INTEGER), {TODAY}) AS VARCHAR) AS day FROM listing)""")
def _(t):
    return R.listing_rows(t.listing, t.event_today, "irk").select("o_orderkey", "event_id", "date_start")


def gazetteer(t):
    """Cities and districts of the adapted tables; the semicolon closes the city name inside a location."""
    return t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat("n_name", F.lit(";")).alias("city"), F.col("r_name").alias("district"), F.col("n_nationkey").alias("rank"))


GEO = "(SELECT n_nationkey AS rank, lower(n_name || ';') AS city, r_name AS gd FROM nation JOIN region ON n_regionkey = r_regionkey)"
ASSIGNED = f"""SELECT DISTINCT event_id, gd AS district, TRUE AS geo_inferred, date_start FROM cal_events JOIN {GEO}
      ON contains(lower(coalesce(location, '')), city) OR contains(lower(coalesce(address, '')), city)
      OR contains(lower(coalesce(location, '')), lower(gd)) OR contains(lower(coalesce(address, '')), lower(gd))
    UNION ALL SELECT event_id, r_name, FALSE, date_start FROM cal_events, region WHERE location IS NULL AND address IS NULL"""


@query("jn05_events_by_district", f"SELECT event_id, district, geo_inferred FROM ({ASSIGNED})")
def _(t):
    return E.by_district(t.cal_events, gazetteer(t)).select("event_id", "district", "geo_inferred")


@query("jn05_nearest_per_district", f"""SELECT event_id, district FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY abs(date_start - {TODAY}), event_id) AS rn
    FROM ({ASSIGNED})) WHERE rn <= 20""")
def _(t):
    return E.nearest_per_district(E.by_district(t.cal_events, gazetteer(t)), t.event_today, 20).select("event_id", "district")


def located(t, default=""):
    return E.with_district(t.cal_events, gazetteer(t), default)


@query("jn06_first_match_district", f"""WITH m AS (SELECT event_id, arg_min(gd, rank) AS d FROM cal_events
    JOIN {GEO} ON contains(lower(concat_ws(' ', coalesce(location, ''), coalesce(address, ''))), city) GROUP BY event_id)
    SELECT e.event_id, coalesce(d, '') AS district FROM cal_events e LEFT JOIN m ON m.event_id = e.event_id""")
def _(t):
    return located(t).select("event_id", "district")


WITH_D = f"""m AS (SELECT event_id AS mid, arg_min(gd, rank) AS d FROM cal_events
    JOIN {GEO} ON contains(lower(concat_ws(' ', coalesce(location, ''), coalesce(address, ''))), city) GROUP BY event_id),
    ed AS (SELECT e.*, coalesce(d, '') AS district FROM cal_events e LEFT JOIN m ON mid = e.event_id)"""
DAYS = f"""WITH {WITH_D} SELECT DISTINCT CASE WHEN district = '' THEN 'AFRICA' ELSE district END AS district,
    CAST(unnest(generate_series(date_start, greatest(coalesce(date_end, date_start), date_start), INTERVAL 1 DAY)) AS DATE) AS date FROM ed"""


FESTIVALS = DAYS + " WHERE event_type = 'festival'"


def event_days(t, kind: str | None = None):
    """Days on which a district has an event, of one kind if given."""
    events = located(t, "AFRICA")
    return E.event_days(events if kind is None else events.filter(F.col("event_type") == kind), F.col("district"))


@query("jn07_event_days", f"SELECT district, CAST(date AS VARCHAR) AS date FROM ({DAYS})")
def _(t):
    return event_days(t)


@query("jn13_nearby_events", """WITH d AS (SELECT date_start AS date, count(*) AS n FROM cal_events GROUP BY 1), x AS (SELECT DISTINCT date FROM hotel_statistics)
    SELECT CAST(x.date AS VARCHAR) AS date, CAST(coalesce((SELECT n FROM d WHERE d.date = x.date), 0) AS BIGINT) AS on_day,
    CAST(coalesce(sum(d.n), 0) AS BIGINT) AS nearby FROM x LEFT JOIN d ON d.date BETWEEN x.date - 3 AND x.date + 7 GROUP BY x.date""")
def _(t):
    return E.nearby_counts(t.stats, t.cal_events)


@query("jn20_events_on_forecast_dates", """SELECT event_id FROM cal_events WHERE date_start IN (SELECT forecast_date FROM forecasts WHERE model = 'ensemble')""")
def _(t):
    dates = t.forecasts.filter(F.col("model") == "ensemble").select(F.col("forecast_date").alias("date_start")).distinct()
    return t.cal_events.join(dates, "date_start", "left_semi").select("event_id")


@query("so01_union_of_sources", """SELECT event_id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(title)), date_start
    ORDER BY CASE source_id WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, event_id) AS rn FROM cal_events WHERE trim(title) <> '') WHERE rn = 1""")
def _(t):
    parts = [t.cal_events.filter(F.col("source_id") == s) for s in ("O", "F", "P")]
    return E.union_sources(parts).select("event_id", "source_id")


@query("so02_cross_page_dedup", """SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn
    FROM lineitem) WHERE rn = 1""")
def _(t):
    rows = t.raw("lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return E.keep_first(rows, ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query("so03_title_prefix_dedup", """SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY left(lower(title), 12) ORDER BY o_orderkey) AS rn FROM listing) WHERE rn = 1""")
def _(t):
    rows = t.listing.select("o_orderkey", "title")
    return E.keep_first(rows, [F.left(F.lower("title"), F.lit(12))], ["o_orderkey"]).select("o_orderkey")


FILLED = " + ".join(f"CAST({c} IS NOT NULL AND CAST({c} AS VARCHAR) NOT IN ('', '0') AS INTEGER)" for c in E.COMPLETENESS)
KEY = r"trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("so04_exact_dedup", f"""WITH {WITH_D}, k AS (SELECT *, {KEY} AS title_key, {FILLED} AS score FROM ed),
    b AS (SELECT title_key, date_start, district, arg_min(event_id, lpad(CAST(9 - score AS VARCHAR), 2, '0') || event_id) AS event_id,
      arg_min(source_id, lpad(CAST(9 - score AS VARCHAR), 2, '0') || event_id) AS source_id FROM k GROUP BY title_key, date_start, district),
    o AS (SELECT b.event_id, string_agg(DISTINCT k.source_id, ',' ORDER BY k.source_id) AS also_at FROM b JOIN k ON k.title_key = b.title_key
      AND k.date_start = b.date_start AND k.district = b.district AND k.source_id <> b.source_id GROUP BY b.event_id)
    SELECT b.event_id, district, title_key, coalesce(also_at, '') AS also_at FROM b LEFT JOIN o ON o.event_id = b.event_id""")
def _(t):
    return E.exact_dedup(located(t), F.col("district")).select("event_id", "district", "title_key", F.array_join("also_at", ",").alias("also_at"))


@query("ag29_events_by_source", "SELECT source_id, count(*) AS n FROM cal_events GROUP BY 1")
def _(t):
    return E.source_counts(t.cal_events, "source_id")


@query("ag36_events_by_type", "SELECT event_type, count(*) AS n FROM cal_events GROUP BY 1")
def _(t):
    return E.source_counts(t.cal_events, "event_type")


@query("ag29_month_calendar", """WITH c AS (SELECT DATE '1998-06-01' + CAST(i AS INTEGER) AS date FROM (SELECT unnest(range(0, 42)) AS i))
    SELECT CAST(date AS VARCHAR) AS date, (SELECT count(*) FROM cal_events WHERE date_start = date) AS events, month(date) = 6 AS in_month FROM c""")
def _(t):
    return E.month_calendar(t.cal_events, F.lit("1998-06-01").cast("date"))


RUNS = """(SELECT event_type AS source, ts AS run_ts, CASE CAST(floor(value) AS INTEGER) % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'warn' ELSE 'fail' END AS status,
    CAST(CAST(floor(value) AS INTEGER) % 5 AS INTEGER) AS items, event_id FROM events)"""


def source_runs(t):
    """The activity stream read as a log of source runs."""
    v = F.floor("value").cast("int")
    return t.raw("events").select(
        F.col("event_type").alias("source"), F.col("ts").alias("run_ts"),
        F.when(v % 3 == 0, "ok").when(v % 3 == 1, "warn").otherwise("fail").alias("status"), (v % 5).alias("items"), "event_id")


@query("ag30_source_run_summary", f"""WITH l AS (SELECT source, arg_max(status, run_ts) AS status, arg_max(items, run_ts) AS items, max(run_ts) AS run_ts FROM {RUNS} GROUP BY source),
    x AS (SELECT *, epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(run_ts)) > 7200 AS st FROM l)
    SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'warn') AS warn, count(*) FILTER (WHERE status = 'fail') AS failed,
    count(*) FILTER (WHERE st) AS stale, count(*) FILTER (WHERE status = 'ok' AND items = 0) AS empty,
    coalesce(string_agg(source, ',' ORDER BY source) FILTER (WHERE status = 'fail'), '') AS failed_sources,
    coalesce(string_agg(source, ',' ORDER BY source) FILTER (WHERE st), '') AS stale_sources FROM x""")
def _(t):
    return E.run_summary(source_runs(t), F.lit("2024-02-01 00:00:00").cast("timestamp"), 2)


# --- sinks as merged content ------------------------------------------------------------------------------------------


@query("snk01_upsert_hotels", """WITH n AS (SELECT id, name || ' renamed' AS name, city, district, lat, lon, rating, min_price + 10 AS min_price,
      CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 'resort' END AS accommodation_type, CAST(NULL AS VARCHAR) AS image_url FROM hotels WHERE CAST(id AS BIGINT) % 2 = 0
      UNION ALL SELECT 'new' || id, name, city, district, lat, lon, rating, min_price, accommodation_type, image_url FROM hotels WHERE CAST(id AS BIGINT) % 10 = 1)
    SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN n.id IS NOT NULL THEN n.min_price ELSE o.min_price END AS min_price,
      coalesce(n.accommodation_type, o.accommodation_type) AS accommodation_type, coalesce(n.image_url, o.image_url) AS image_url
    FROM hotels o FULL JOIN n ON n.id = o.id""")
def _(t):
    k = F.col("id").cast("bigint")
    upd = t.hotels.filter(k % 2 == 0).select(
        "id", F.concat("name", F.lit(" renamed")).alias("name"), "city", "district", "lat", "lon", "rating", (F.col("min_price") + 10).alias("min_price"),
        F.when(k % 4 == 0, "resort").alias("accommodation_type"), F.lit(None).cast("string").alias("image_url"))
    ins = t.hotels.filter(k % 10 == 1).withColumn("id", F.concat(F.lit("new"), "id"))
    return U.merge_hotels(t.hotels, upd.unionByName(ins)).select("id", "name", "min_price", "accommodation_type", "image_url")


@query("snk02_upsert_statistics", f"""SELECT id, CAST(date AS VARCHAR) AS date, CASE WHEN day(date) = 15 THEN rooms_num + 1 ELSE rooms_num END AS rooms_num, free_rooms_amount
    FROM hotel_statistics""")
def _(t):
    new = t.stats.filter(F.dayofmonth("date") == 15).withColumn("rooms_num", F.col("rooms_num") + 1)
    return U.overwrite(t.stats, new, ["id", "date"]).select("id", "date", "rooms_num", "free_rooms_amount")


@query("snk03_upsert_events_overwrite", """SELECT event_id, CASE WHEN event_type = 'sport' THEN 'match' ELSE event_type END AS event_type FROM cal_events""")
def _(t):
    new = t.cal_events.filter(F.col("event_type") == "sport").withColumn("event_type", F.lit("match"))
    return U.overwrite(t.cal_events, new, ["event_id"]).select("event_id", "event_type")


OLDE = "(SELECT source_id, date_start, title, arg_min(event_id, event_id) AS event_id, arg_min(url, event_id) AS url, arg_min(coalesce(description, ''), event_id) AS description FROM cal_events WHERE CAST(event_id AS BIGINT) % 2 = 0 GROUP BY 1, 2, 3)"
NEWE = "(SELECT source_id, date_start, title, arg_max(event_id, event_id) AS event_id, arg_max(coalesce(description, ''), event_id) AS description FROM cal_events WHERE CAST(event_id AS BIGINT) % 2 = 1 GROUP BY 1, 2, 3)"


@query("snk04_upsert_events_coalesce", f"""SELECT coalesce(o.source_id, n.source_id) AS source_id, CAST(coalesce(o.date_start, n.date_start) AS VARCHAR) AS date_start,
    coalesce(o.title, n.title) AS title, coalesce(o.event_id, n.event_id) AS event_id, o.url, coalesce(nullif(n.description, ''), nullif(o.description, '')) AS description
    FROM {OLDE} o FULL JOIN {NEWE} n ON o.source_id = n.source_id AND o.date_start = n.date_start AND o.title = n.title""")
def _(t):
    cols = ["source_id", "date_start", "title", "event_id", "url", "description"]
    odd = F.col("event_id").cast("bigint") % 2
    old = E.keep_first(t.cal_events.filter(odd == 0).select(*cols), ["source_id", "date_start", "title"], ["event_id"])
    new = t.cal_events.filter(odd == 1).select(*cols).withColumn("url", F.lit(None).cast("string")).withColumn("ord", F.col("event_id"))
    return U.merge_events(old, new, "ord")


@query("snk05_current_forecasts", """SELECT district, CAST(forecast_date AS VARCHAR) AS forecast_date, model, CAST(max(origin_date) AS VARCHAR) AS origin_date,
    round(arg_max(predicted_occupancy, origin_date), 6) AS predicted_occupancy FROM (SELECT * REPLACE ('any' AS model) FROM forecasts) GROUP BY district, forecast_date, model""")
def _(t):
    return U.current_forecasts(t.forecasts.withColumn("model", F.lit("any"))).select("district", "forecast_date", "model", "origin_date", "predicted_occupancy")


@query("snk06_delete_by_source", "SELECT event_id, source_id, (SELECT count(*) FROM cal_events WHERE source_id = 'P') AS removed FROM cal_events WHERE source_id <> 'P'")
def _(t):
    keys = t.cal_events.filter(F.col("source_id") == "P").select("source_id")
    left, removed = U.delete_matching(t.cal_events, keys, ["source_id"])
    return left.select("event_id", "source_id", removed.scalar().alias("removed"))


@query("snk07_patch_hotels", """SELECT h.id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 0 ELSE rating END AS rating,
    CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN 'patched' ELSE accommodation_type END AS accommodation_type FROM hotels h""")
def _(t):
    k = F.col("id").cast("bigint")
    p = t.hotels.filter(k % 3 == 0).select("id", F.lit(0.0).alias("rating"), F.when(k % 6 == 0, "patched").otherwise("").alias("accommodation_type"))
    return U.patch(t.hotels, p, "id", ["rating", "accommodation_type"]).select("id", "rating", "accommodation_type")


@query("snk08_export_occupancy", """SELECT CAST(date AS VARCHAR) AS date, s.id AS hotel_id, name AS hotel_name, district, city, coalesce(rooms_num, 0) AS rooms_num,
    coalesce(free_rooms_amount, 0) AS free_rooms_amount, coalesce(available_rooms_percent, 0) AS available_rooms_percent, coalesce(s.min_price, 0) AS min_price
    FROM hotel_statistics s JOIN hotels h ON h.id = s.id""")
def _(t):
    return U.export_occupancy(t.stats, t.hotels)


@query("snk08_export_events", """SELECT event_id, title, CAST(date_start AS VARCHAR) AS date_start, coalesce(CAST(date_end AS VARCHAR), '') AS date_end,
    coalesce(event_type, '') AS event_type, coalesce(location, '') AS location, source_id AS source FROM cal_events""")
def _(t):
    return U.export_events(t.cal_events)


@query("snk08_export_hotels", """SELECT id, name, city, district, lat, lon, coalesce(rating, 0) AS rating, coalesce(min_price, 0) AS min_price,
    coalesce(accommodation_type, '') AS accommodation_type FROM (SELECT * REPLACE (round(lat, 6) AS lat, round(lon, 6) AS lon) FROM hotels)""")
def _(t):
    return U.export_hotels(t.hotels)


@query("snk09_panel_dump", f"""WITH d AS (SELECT * FROM ({DAYS}))
    SELECT a.district, CAST(a.date AS VARCHAR) AS date, round(avg_occupancy, 6) AS occupancy, CASE WHEN d.date IS NULL THEN 0 ELSE 1 END AS is_event
    FROM ({P1.SERIES}) a LEFT JOIN d ON d.district = a.district AND d.date = a.date""")
def _(t):
    panel = P1.series(t).select("district", "date", F.col("avg_occupancy").alias("occupancy"))
    return U.panel_dump(panel, event_days(t))


@query("snk11_relabel", f"""SELECT o_orderkey, CASE WHEN kind = 'event' AND label <> 'event' THEN label ELSE kind END AS event_type FROM (
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'event' ELSE 'other' END AS kind, {CLASS} AS label FROM listing)""")
def _(t):
    rows = t.listing.withColumn("event_type", F.when(F.col("o_orderkey") % 2 == 0, "event").otherwise("other"))
    return U.relabel(rows, S.event_type("title", "description")).select("o_orderkey", "event_type")


IMPORT = """(SELECT CASE WHEN l_linenumber = 7 THEN 'x' || l_suppkey ELSE CAST(l_suppkey AS VARCHAR) END AS id,
    CASE l_orderkey % 4 WHEN 0 THEN 'junk' WHEN 1 THEN CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS VARCHAR) ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date_raw,
    CASE WHEN l_orderkey % 5 = 0 THEN 'many' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS rooms_raw,
    CAST(l_discount * 2000 - 20 AS VARCHAR) AS pct_raw, l_orderkey, l_linenumber FROM lineitem)"""


def import_rows(t):
    k = F.col("l_orderkey")
    day = F.to_date("l_shipdate")
    return t.raw("lineitem").select(
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("x"), F.col("l_suppkey").cast("string"))).otherwise(F.col("l_suppkey").cast("string")).alias("id"),
        F.when(k % 4 == 0, "junk").when(k % 4 == 1, F.datediff(day, F.lit("1970-01-01").cast("date")).cast("string"))
        .otherwise(F.date_format(day, "yyyy-MM-dd")).alias("date_raw"),
        F.when(k % 5 == 0, "many").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("rooms_raw"),
        F.lit("3").alias("free_raw"), (F.col("l_discount") * 2000 - 20).cast("string").alias("pct_raw"), F.lit("n/a").alias("price_raw"))


@query("src12_import_rows", f"""SELECT id, CAST(coalesce(TRY_CAST(date_raw AS DATE), DATE '1970-01-01' + TRY_CAST(date_raw AS INTEGER)) AS VARCHAR) AS date,
    TRY_CAST(rooms_raw AS INTEGER) AS rooms_num, round(greatest(0.0, least(100.0, TRY_CAST(pct_raw AS DOUBLE))), 6) AS available_rooms_percent
    FROM {IMPORT} WHERE id IN (SELECT id FROM hotels) AND coalesce(TRY_CAST(date_raw AS DATE), DATE '1970-01-01' + TRY_CAST(date_raw AS INTEGER)) IS NOT NULL""")
def _(t):
    good, _, _ = U.normalise_import(import_rows(t), t.hotels)
    return good.select("id", "date", "rooms_num", "available_rooms_percent")


@query("jn02_known_and_unknown_hotels", f"""SELECT CASE WHEN id NOT IN (SELECT id FROM hotels) THEN 'unknown' WHEN date_raw = 'junk' THEN 'invalid' ELSE 'valid' END AS part, count(*) AS n
    FROM {IMPORT} GROUP BY 1""")
def _(t):
    parts = dict(zip(("valid", "unknown", "invalid"), U.normalise_import(import_rows(t), t.hotels)))
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("src12_import_window", """SELECT CAST(max(date) + 1 AS VARCHAR) AS date_from, CAST(max(date) + 15 AS VARCHAR) AS date_to FROM hotel_statistics""")
def _(t):
    start, end = R.import_window(t.stats, F.date_add(t.as_of, 15))
    return t.spark.range(1).select(start.alias("date_from"), end.alias("date_to"))
