"""Market queries: sources, filters, district series, segments, prices, seasonality."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from staylens import model as M
from staylens.functions import metrics as X
from staylens.operators import market as K
from staylens.plans.registry import query

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE")
IN_REGIONS = "district IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')"
OCC = (
    "sum(rooms_num * (100.0 - least(100.0, greatest(0.0, coalesce(available_rooms_percent, 0)))))"
    " / nullif(sum(rooms_num), 0)"
)
MED = "quantile_cont(min_price, 0.5) FILTER (WHERE min_price > 0)"
SIZE = "CASE WHEN rooms_num <= 15 THEN 'mini' WHEN rooms_num <= 50 THEN 'mid' ELSE 'large' END"
JOINED = "hotel_statistics s JOIN (SELECT id AS hid, district, city, accommodation_type FROM hotels) h ON hid = s.id"
LATEST = "(SELECT max(date) FROM hotel_statistics)"
SERIES = f"""SELECT district, date, {OCC} AS avg_occupancy, {MED} AS avg_price,
    CAST(sum(rooms_num) AS BIGINT) AS total_rooms, CAST(sum(max_capacity) AS BIGINT) AS total_capacity
    FROM {JOINED} WHERE rooms_num > 0 GROUP BY district, date"""
MONTHLY = f"""SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, {OCC} AS avg_occupancy,
    {MED} AS avg_price, CAST(sum(rooms_num) AS BIGINT) AS total_rooms,
    CAST(sum(free_rooms_amount) AS BIGINT) AS free_rooms, count(*) AS records_count,
    count(DISTINCT date) AS days_count FROM hotel_statistics WHERE rooms_num > 0 GROUP BY 1, 2"""
EVENT_MONTHS = """SELECT CAST(year(date_start) AS INTEGER) AS year, CAST(month(date_start) AS INTEGER) AS month,
    count(*) AS events_count FROM cal_events GROUP BY 1, 2"""
SNAP = f"""SELECT district, {OCC} AS avg_occupancy, CAST(sum(free_rooms_amount) AS BIGINT) AS free_rooms,
    CAST(sum(rooms_num) AS BIGINT) AS total_rooms, {MED} AS median_price, max(date) AS as_of_date,
    count(DISTINCT s.id) AS hotels_count FROM {JOINED} WHERE date = {LATEST} GROUP BY district"""
RECENT = f"""SELECT DISTINCT ON (id) id, date, rooms_num, free_rooms_amount, available_rooms_percent, min_price,
    max_capacity FROM hotel_statistics WHERE date >= {LATEST} - 14 ORDER BY id, date DESC"""
PCTS = f"""SELECT district, count(*) AS samples, quantile_cont(min_price, 0.1) AS p10, quantile_cont(min_price, 0.25) AS p25,
    quantile_cont(min_price, 0.5) AS p50, quantile_cont(min_price, 0.75) AS p75, quantile_cont(min_price, 0.9) AS p90
    FROM {JOINED} WHERE date >= (SELECT today FROM as_of) - 90 AND min_price > 0 GROUP BY district"""
MONTHS12 = f"""SELECT m.month, coalesce(occupancy, 0) AS occupancy, coalesce(avg_price, 0) AS avg_price,
    CAST(coalesce(events, 0) AS BIGINT) AS events, CAST(coalesce(samples, 0) AS BIGINT) AS samples
    FROM (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS month) m
    LEFT JOIN (SELECT month, avg(avg_occupancy) AS occupancy, avg(coalesce(avg_price, 0)) AS avg_price,
               sum(days_count) AS samples FROM ({MONTHLY}) GROUP BY month) a ON a.month = m.month
    LEFT JOIN (SELECT month, sum(events_count) AS events FROM ({EVENT_MONTHS}) GROUP BY month) e ON e.month = m.month"""
RU_MONTH = ("([" + ", ".join(f"'{m}'" for m in M.MONTH_NAMES) + "])[month]")
SEASON = ("CASE WHEN month IN (12, 1, 2, 3) THEN 'winter' WHEN month IN (4, 5) THEN 'spring'"
          " WHEN month IN (6, 7, 8, 9) THEN 'summer' ELSE 'autumn' END")


def since(t, days):
    return F.date_sub(t.as_of, days)


def series(t):
    return K.daily_series(t.stats, t.hotels)


def snapshot(t):
    return K.district_snapshot(t.stats, t.hotels, t.as_of)


def percentiles(t):
    return K.price_percentiles(t.stats, t.hotels, since(t, 90))


def months(t):
    return K.seasonality(K.monthly_statistics(t.stats), K.events_by_month(t.cal_events))


@query("ag01_weighted_occupancy", f"SELECT district, round({OCC}, 6) AS occupancy, count(*) AS n FROM {JOINED} GROUP BY district")
def _(t):
    return K.with_hotel(t.stats, t.hotels, "district").groupBy("district").agg(
        X.weighted_occupancy().alias("occupancy"), F.count("*").alias("n"))


@query("jn01_facts_with_hotels", f"""SELECT s.id, CAST(date AS VARCHAR) AS date, district, city, rooms_num FROM {JOINED}
    WHERE date >= (SELECT today FROM as_of) - 60""")
def _(t):
    return K.with_hotel(t.stats.filter(F.col("date") >= since(t, 60)), t.hotels, "district", "city").select(
        "id", "date", "district", "city", "rooms_num")


@query("ag02_daily_series", f"""SELECT district, CAST(date AS VARCHAR) AS date, round(avg_occupancy, 6) AS avg_occupancy,
    round(avg_price, 6) AS avg_price, total_rooms, total_capacity FROM ({SERIES})""")
def _(t):
    return series(t)


@query("ag03_monthly_statistics", f"""SELECT year, month, round(avg_occupancy, 6) AS avg_occupancy,
    round(avg_price, 6) AS avg_price, total_rooms, free_rooms, records_count, days_count FROM ({MONTHLY})""")
def _(t):
    return K.monthly_statistics(t.stats)


@query("ag04_events_by_month", EVENT_MONTHS)
def _(t):
    return K.events_by_month(t.cal_events)


TOTALS = f"""SELECT (SELECT count(*) FROM hotels) AS total_hotels, (SELECT count(DISTINCT city) FROM hotels) AS total_cities,
    (SELECT count(*) FROM cal_events) AS total_events, CAST(coalesce(sum(rooms_num), 0) AS BIGINT) AS total_rooms,
    CAST(coalesce(sum(free_rooms_amount), 0) AS BIGINT) AS free_rooms, coalesce({OCC}, 0) AS avg_occupancy,
    max(date) AS as_of_date FROM hotel_statistics WHERE date = {LATEST}"""


def totals(t):
    return K.total_metrics(t.stats, t.hotels, t.cal_events, t.as_of)


@query("ag05_total_metrics", f"""SELECT * REPLACE (round(avg_occupancy, 6) AS avg_occupancy,
    CAST(as_of_date AS VARCHAR) AS as_of_date) FROM ({TOTALS})""")
def _(t):
    return totals(t)


@query("ag06_district_snapshot", f"""SELECT * REPLACE (round(avg_occupancy, 6) AS avg_occupancy,
    round(median_price, 6) AS median_price, CAST(as_of_date AS VARCHAR) AS as_of_date) FROM ({SNAP})""")
def _(t):
    return snapshot(t)


PERIOD = f"""SELECT district, {OCC} AS avg_occupancy,
    CAST(sum(free_rooms_amount) AS DOUBLE) / nullif(count(DISTINCT date), 0) AS free_rooms,
    CAST(sum(rooms_num) AS DOUBLE) / nullif(count(DISTINCT date), 0) AS total_rooms, {MED} AS median_price,
    count(DISTINCT s.id) AS hotels_count FROM {JOINED}
    WHERE date BETWEEN (SELECT today FROM as_of) - 180 AND (SELECT today FROM as_of) GROUP BY district"""


@query("ag07_district_period", f"""SELECT district, round(avg_occupancy, 6) AS avg_occupancy, round(free_rooms, 6) AS free_rooms,
    round(total_rooms, 6) AS total_rooms, round(median_price, 6) AS median_price, hotels_count FROM ({PERIOD})""")
def _(t):
    return K.district_period(t.stats, t.hotels, since(t, 180), t.as_of)


@query("st03_district_order", f"""SELECT district, CAST(row_number() OVER (ORDER BY avg_occupancy DESC NULLS LAST) AS INTEGER) AS place
    FROM ({PERIOD})""")
def _(t):
    period = K.district_period(t.stats, t.hotels, since(t, 180), t.as_of)
    return period.select("district", F.row_number().over(
        W.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("avg_occupancy"))).alias("place"))


@query("ag08_hotels_by_city", "SELECT city, count(*) AS hotels_count FROM hotels GROUP BY city")
def _(t):
    return K.hotels_by_city(t.hotels)


@query("ag09_hotels_by_district", """SELECT district, count(*) AS hotels_count, round(avg(rating), 6) AS avg_rating
    FROM hotels GROUP BY district""")
def _(t):
    return K.hotels_by_district(t.hotels)


@query("jn04_hotels_by_district_prices", f"""SELECT a.district, count, round(median_price, 6) AS median_price, avg_rating
    FROM (SELECT district, count(*) AS count, round(avg(rating), 6) AS avg_rating FROM hotels WHERE {IN_REGIONS} GROUP BY district) a
    LEFT JOIN ({SNAP}) b ON a.district = b.district""")
def _(t):
    return K.hotels_by_district_with_prices(t.hotels, snapshot(t), REGIONS)


@query("ag10_weekday_heatmap", f"""WITH c AS (SELECT CAST(isodow(date) AS INTEGER) AS weekday, CAST(month(date) AS INTEGER) AS month,
      {OCC} AS occupancy, count(*) AS samples FROM {JOINED} WHERE available_rooms_percent IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT coalesce(min(occupancy) FILTER (WHERE samples >= 5 AND occupancy > 0), 0) AS lo,
      coalesce(max(occupancy) FILTER (WHERE samples >= 5 AND occupancy > 0), 100) AS hi FROM c)
    SELECT weekday, month, round(occupancy, 6) AS occupancy, samples,
      round(least(1.0, greatest(0.0, (occupancy - lo) / greatest(hi - lo, 1.0))), 6) AS scale FROM c, b""")
def _(t):
    return K.weekday_heatmap(t.stats, t.hotels)


@query("ag10_weekday_heatmap_by_district", f"""SELECT district, CAST(isodow(date) AS INTEGER) AS weekday,
    CAST(month(date) AS INTEGER) AS month, round({OCC}, 6) AS occupancy, count(*) AS samples FROM {JOINED}
    WHERE available_rooms_percent IS NOT NULL GROUP BY 1, 2, 3""")
def _(t):
    return K.weekday_heatmap(t.stats, t.hotels, by_district=True).drop("scale")


@query("ag11_daily_rooms", f"""SELECT district, CAST(date AS VARCHAR) AS date, CAST(coalesce(sum(rooms_num), 0) AS BIGINT) AS total_rooms,
    CAST(coalesce(sum(free_rooms_amount), 0) AS BIGINT) AS free_rooms, count(DISTINCT s.id) AS hotels_count
    FROM {JOINED} WHERE date >= (SELECT today FROM as_of) - 180 GROUP BY district, date""")
def _(t):
    return K.daily_rooms(t.stats, t.hotels, since(t, 180), ["district"])


@query("wn01_latest_per_hotel", f"SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM ({RECENT})")
def _(t):
    return K.recent_snapshots(t.stats, t.as_of)


@query("wn02_latest_row_own_occupancy", """SELECT DISTINCT ON (id) id, CAST(date AS VARCHAR) AS date, rooms_num,
    free_rooms_amount, min_price, CASE WHEN rooms_num > 0 THEN round(100.0 * (rooms_num - least(greatest(
      coalesce(free_rooms_amount, 0), 0), rooms_num)) / rooms_num, 6) END AS occupancy
    FROM hotel_statistics ORDER BY id, hotel_statistics.date DESC""")
def _(t):
    return K.latest_per_key(t.stats, ["id"], "date", K.SNAPSHOT_COLUMNS).select(
        "id", "date", "rooms_num", "free_rooms_amount", "min_price", X.own_occupancy().alias("occupancy"))


@query("ag12_segments_by_size", f"""SELECT {SIZE} AS size_bucket, count(*) AS count, round({OCC}, 6) AS avg_occupancy,
    round(avg(min_price), 6) AS avg_price FROM ({RECENT}) WHERE rooms_num IS NOT NULL GROUP BY 1""")
def _(t):
    return K.segments_by_size(t.stats, t.as_of)


BY_TYPE = """SELECT coalesce(accommodation_type, 'unknown') AS type, count(*) AS count, round(avg(min_price), 6) AS avg_price
    FROM hotels GROUP BY 1"""


@query("ag13_segments_by_type", BY_TYPE)
def _(t):
    return K.segments_by_type(t.hotels)


@query("ag31_top_types", f"""SELECT *, CAST(sum(count) OVER () AS BIGINT) AS shown FROM (
    SELECT type, count, CAST(row_number() OVER (ORDER BY count DESC, type) AS INTEGER) AS rank,
    CAST(sum(count) OVER () AS BIGINT) AS total, count(*) OVER () AS kinds FROM ({BY_TYPE})) WHERE rank <= 3""")
def _(t):
    return K.top_types(K.segments_by_type(t.hotels), 3)


@query("ag14_district_breakdown", f"""WITH latest AS (SELECT district, rooms_num, available_rooms_percent,
      nullif(min_price, 0) AS min_price, {SIZE} AS size, coalesce(accommodation_type, 'не указан') AS type
      FROM ({RECENT}) s JOIN (SELECT id AS hid, district, accommodation_type FROM hotels) h ON hid = s.id),
    u AS (SELECT district, 'size' AS split, size AS segment, count(*) AS count, {OCC} AS o, avg(min_price) AS p FROM latest
          WHERE rooms_num IS NOT NULL GROUP BY district, size
      UNION ALL SELECT district, 'type', type, count(*), {OCC}, avg(min_price) FROM latest GROUP BY district, type
      UNION ALL SELECT district, 'total', 'all', count(rooms_num), {OCC}, avg(min_price) FROM latest GROUP BY district)
    SELECT district, split, segment, count, round(o, 6) AS avg_occupancy, round(p, 6) AS avg_min_price,
      CASE WHEN p <> 0 AND o <> 0 THEN round(p * o / 100, 6) END AS revpar FROM u""")
def _(t):
    return K.district_breakdown(t.stats, t.hotels, t.as_of)


@query("ag15_segment_benchmark", f"""WITH own AS (SELECT h.id, h.district, s.date, s.min_price, s.rooms_num,
      CASE WHEN rooms_num > 0 THEN 100.0 * (rooms_num - least(greatest(coalesce(free_rooms_amount, 0), 0), rooms_num)) / rooms_num END AS occupancy,
      CASE WHEN coalesce(rooms_num, 0) BETWEEN 1 AND 15 THEN 'mini' WHEN coalesce(rooms_num, 0) BETWEEN 16 AND 50 THEN 'mid' ELSE 'large' END AS size_bucket
      FROM hotels h LEFT JOIN (SELECT DISTINCT ON (id) * FROM hotel_statistics ORDER BY id, date DESC) s ON s.id = h.id),
    peers AS (SELECT DISTINCT ON (s.id, {SIZE}) s.id AS pid, district AS pdistrict, {SIZE} AS psize, rooms_num, available_rooms_percent, min_price
      FROM {JOINED} WHERE date >= {LATEST} - 14 AND rooms_num BETWEEN 0 AND 10000 ORDER BY s.id, {SIZE}, date DESC),
    seg AS (SELECT o.id, count(pid) AS n, {OCC.replace('rooms_num', 'p.rooms_num')} AS so, avg(p.min_price) AS sp
      FROM own o LEFT JOIN peers p ON pdistrict = o.district AND psize = o.size_bucket AND pid <> o.id GROUP BY o.id)
    SELECT o.id, district, size_bucket, round(occupancy, 6) AS occupancy, min_price, CAST(date AS VARCHAR) AS as_of, n,
      round(so, 6) AS seg_occupancy, round(sp, 6) AS seg_price, round(occupancy - so, 6) AS occupancy_delta,
      round(min_price - sp, 6) AS price_delta, {LATEST} - date > 2 AS is_stale FROM own o JOIN seg ON seg.id = o.id""")
def _(t):
    return K.segment_benchmark(t.stats, t.hotels, t.as_of)


@query("sc50_object_vs_segment", f"""WITH own AS (SELECT h.id, h.district, s.date, s.min_price,
      CASE WHEN coalesce(rooms_num, 0) BETWEEN 1 AND 15 THEN 'mini' WHEN coalesce(rooms_num, 0) BETWEEN 16 AND 50 THEN 'mid' ELSE 'large' END AS size_bucket
      FROM hotels h LEFT JOIN (SELECT DISTINCT ON (id) * FROM hotel_statistics ORDER BY id, date DESC) s ON s.id = h.id)
    SELECT size_bucket, count(*) AS objects, count(*) FILTER (WHERE {LATEST} - date > 2) AS stale FROM own GROUP BY size_bucket""")
def _(t):
    return K.segment_benchmark(t.stats, t.hotels, t.as_of).groupBy("size_bucket").agg(
        F.count("*").alias("objects"), F.count_if("is_stale").alias("stale"))


@query("ag16_price_percentiles", f"""SELECT district, samples, round(p10, 6) AS p10, round(p25, 6) AS p25, round(p50, 6) AS p50,
    round(p75, 6) AS p75, round(p90, 6) AS p90 FROM ({PCTS})""")
def _(t):
    return percentiles(t)


@query("ag17_compare_districts", f"""SELECT a.district, round(occupancy, 6) AS occupancy, a.samples, round(p50, 6) AS adr_proxy,
    round(p50 * occupancy / 100, 6) AS revpar_proxy FROM (SELECT district, avg(avg_occupancy) AS occupancy, count(*) AS samples
      FROM ({SERIES}) WHERE date >= (SELECT today FROM as_of) - 90 AND {IN_REGIONS} GROUP BY district) a
    LEFT JOIN ({PCTS}) b ON a.district = b.district""")
def _(t):
    return K.compare_districts(series(t), percentiles(t), since(t, 90), REGIONS)


REV = f"""SELECT district, coalesce(avg_occupancy, 0) AS occupancy, coalesce(median_price, 0) AS adr,
    coalesce(median_price, 0) * coalesce(avg_occupancy, 0) / 100 AS revpar, hotels_count,
    CASE WHEN hotels_count >= 10 THEN 'high' WHEN hotels_count >= 3 THEN 'medium' ELSE 'low' END AS confidence,
    total_rooms, as_of_date FROM ({SNAP}) WHERE {IN_REGIONS}"""
REGION = f"""SELECT sum(occupancy * total_rooms) / nullif(sum(total_rooms), 0) AS occupancy,
    sum(adr * total_rooms) / nullif(sum(total_rooms), 0) AS adr, max(as_of_date) AS as_of_date FROM ({REV})"""


@query("ag18_revenue_by_district", f"""SELECT * REPLACE (round(occupancy, 6) AS occupancy, round(adr, 6) AS adr,
    round(revpar, 6) AS revpar, CAST(as_of_date AS VARCHAR) AS as_of_date) FROM ({REV})""")
def _(t):
    return K.revenue_by_district(snapshot(t), REGIONS)


@query("ag18_revenue_total", f"""SELECT round(occupancy, 6) AS occupancy, round(adr, 6) AS adr,
    CAST(as_of_date AS VARCHAR) AS as_of_date, round(adr * occupancy / 100, 6) AS revpar FROM ({REGION})""")
def _(t):
    return K.revenue_total(K.revenue_by_district(snapshot(t), REGIONS))


@query("ag43_revpar_delta", f"""SELECT district, round(revpar, 6) AS revpar, round(r, 6) AS region_revpar, round(revpar - r, 6) AS delta,
    CASE WHEN r > 0 THEN round((revpar - r) / r * 100, 6) ELSE 0 END AS delta_pct
    FROM ({REV}), (SELECT adr * occupancy / 100 AS r FROM ({REGION}))""")
def _(t):
    return K.revpar_delta(K.revenue_by_district(snapshot(t), REGIONS))


@query("st05_top_districts_by_revpar", f"""SELECT district, round(revpar, 6) AS revpar FROM ({REV})
    WHERE confidence <> 'low' AND revpar > 0 ORDER BY revpar DESC, district LIMIT 5""")
def _(t):
    rev = K.revenue_by_district(snapshot(t), REGIONS)
    return rev.filter((F.col("confidence") != "low") & (F.col("revpar") > 0)).orderBy(
        F.desc("revpar"), "district").limit(5).select("district", "revpar")


@query("st05_top_districts_by_objects", "SELECT district, count(*) AS n FROM hotels GROUP BY district ORDER BY n DESC, district LIMIT 3")
def _(t):
    return t.hotels.groupBy("district").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "district").limit(3)


@query("ag19_kpi", f"""SELECT total_hotels, total_cities, total_events, total_rooms, free_rooms, round(avg_occupancy, 6) AS avg_occupancy,
    CAST(as_of_date AS VARCHAR) AS as_of_date, (SELECT round(sum(coalesce(median_price, 0) * total_rooms)
      / nullif(sum(total_rooms) FILTER (WHERE median_price > 0), 0), 6) FROM ({SNAP})) AS avg_price,
    CAST((SELECT today FROM as_of) - as_of_date AS INTEGER) AS data_age_days, (SELECT today FROM as_of) - as_of_date > 1 AS is_stale
    FROM ({TOTALS})""")
def _(t):
    return K.kpi(totals(t), snapshot(t), t.as_of)


@query("wn23_staleness", """SELECT district, CAST((SELECT today FROM as_of) - max(date) AS INTEGER) AS age_days,
    (SELECT today FROM as_of) - max(date) > 1 AS is_stale FROM hotel_statistics s JOIN hotels h ON s.id = h.id GROUP BY district""")
def _(t):
    age, stale = X.staleness(t.as_of, F.col("last"))
    return K.with_hotel(t.stats, t.hotels, "district").groupBy("district").agg(F.max("date").alias("last")).select(
        "district", age.alias("age_days"), stale.alias("is_stale"))


@query("ag20_seasonality", f"""SELECT month, {RU_MONTH} AS month_name, {SEASON} AS season, round(occupancy, 6) AS occupancy,
    round(avg_price, 6) AS avg_price, events, samples, samples > 0 AS has_data, samples < 1 AS is_gap,
    CASE WHEN samples >= 3 THEN 'high' WHEN samples >= 1 THEN 'limited' ELSE 'none' END AS confidence FROM ({MONTHS12})""")
def _(t):
    return months(t)


@query("ag20_seasonality_summary", f"""WITH m AS ({MONTHS12}) SELECT
    CASE WHEN count(*) FILTER (WHERE samples >= 1) >= 3 THEN round(corr(events, occupancy) FILTER (WHERE samples >= 1), 6) END AS correlation,
    round(avg(occupancy) FILTER (WHERE samples >= 1 AND occupancy > 0), 6) AS avg_occupancy,
    (SELECT {RU_MONTH} FROM m WHERE samples >= 3 AND occupancy > 0 ORDER BY occupancy DESC, month LIMIT 1) AS peak_month,
    (SELECT {RU_MONTH} FROM m WHERE samples >= 3 AND occupancy > 0 ORDER BY occupancy, month LIMIT 1) AS low_month,
    count(*) FILTER (WHERE samples >= 1 AND occupancy > 0) AS covered_months,
    coalesce(string_agg(CAST(month AS VARCHAR), ',' ORDER BY month) FILTER (WHERE samples = 0), '') AS missing_months FROM m""")
def _(t):
    return K.seasonality_summary(months(t))


@query("ml20_correlation", f"""SELECT round(corr(events, occupancy), 6) AS correlation, count(*) AS n FROM (
    SELECT a.year, a.month, avg_occupancy AS occupancy, coalesce(events_count, 0) AS events FROM ({MONTHLY}) a
    LEFT JOIN ({EVENT_MONTHS}) b ON a.year = b.year AND a.month = b.month)""")
def _(t):
    both = K.monthly_statistics(t.stats).join(K.events_by_month(t.cal_events), ["year", "month"], "left")
    ev = F.coalesce("events_count", F.lit(0)).cast("double")
    return both.agg(F.when(F.count("*") >= 3, F.corr(ev, F.col("avg_occupancy"))).alias("correlation"), F.count("*").alias("n"))


@query("ag33_season_insights", f"""WITH m AS (SELECT * FROM ({MONTHS12}) WHERE samples > 0) SELECT
    (SELECT {RU_MONTH} FROM m ORDER BY occupancy, month LIMIT 1) AS best_month,
    (SELECT {RU_MONTH} FROM m ORDER BY occupancy DESC, month DESC LIMIT 1) AS peak_month,
    (SELECT {RU_MONTH} FROM m ORDER BY avg_price, month LIMIT 1) AS cheapest_month""")
def _(t):
    return K.season_insights(months(t))


@query("ag33_season_means", f"""SELECT {SEASON} AS season, round(avg(occupancy), 6) AS occupancy, round(avg(avg_price), 6) AS avg_price,
    CAST(sum(samples) AS BIGINT) AS days FROM ({MONTHS12}) WHERE samples > 0 GROUP BY 1""")
def _(t):
    return K.season_means(months(t))


@query("ag21_district_table", f"""SELECT district, round(coalesce(avg_occupancy, 0), 6) AS occupancy, round(coalesce(free_rooms, 0), 6) AS free_rooms,
    round(coalesce(total_rooms, 0), 6) AS total_rooms, round(coalesce(median_price, 0), 6) AS median_price, hotels_count,
    CASE WHEN hotels_count >= 10 THEN 'high' ELSE 'medium' END AS confidence
    FROM ({PERIOD}) WHERE {IN_REGIONS} AND hotels_count >= 4""")
def _(t):
    return K.district_table(K.district_period(t.stats, t.hotels, since(t, 180), t.as_of), t.hotels, REGIONS)


@query("ag21_district_table_without_statistics", f"""SELECT district, CAST(NULL AS DOUBLE) AS occupancy, CAST(NULL AS DOUBLE) AS free_rooms,
    CAST(NULL AS DOUBLE) AS total_rooms, CAST(NULL AS DOUBLE) AS median_price, count(*) AS hotels_count, CAST(NULL AS VARCHAR) AS confidence
    FROM hotels WHERE {IN_REGIONS} GROUP BY district HAVING count(*) >= 4""")
def _(t):
    return K.district_table(K.district_period(t.stats, t.hotels, F.date_add(t.as_of, 1), F.date_add(t.as_of, 9)), t.hotels, REGIONS)


@query("flt15_reliability_gate", f"""SELECT city, n, CASE WHEN n >= 10 THEN 'high' ELSE 'medium' END AS district_level,
    CASE WHEN n >= 10 THEN 'high' WHEN n >= 3 THEN 'medium' ELSE 'low' END AS revenue_level
    FROM (SELECT city, count(DISTINCT s.id) AS n FROM {JOINED} GROUP BY city) WHERE n >= 4""")
def _(t):
    n = F.col("n")
    return K.with_hotel(t.stats, t.hotels, "city").groupBy("city").agg(F.count_distinct("id").alias("n")).filter(n >= 4).select(
        "city", "n", X.confidence(n).alias("district_level"), X.confidence(n, medium=3).alias("revenue_level"))


@query("flt01_district_whitelist", f"SELECT id, district FROM hotels WHERE {IN_REGIONS}")
def _(t):
    return t.hotels.filter(F.col("district").isin(list(REGIONS))).select("id", "district")


@query("ag22_recommendations", f"""WITH d AS (SELECT * FROM ({SNAP}) WHERE {IN_REGIONS} AND avg_occupancy > 0),
    m AS (SELECT month, avg(avg_occupancy) AS occ FROM ({MONTHLY}) GROUP BY month), cur AS (SELECT month(today) AS cm FROM as_of),
    lo AS (SELECT * FROM m ORDER BY occ, month LIMIT 1), hi AS (SELECT * FROM m ORDER BY occ DESC, month LIMIT 1)
    SELECT 1 AS rank, 'tourist' AS type, 'quiet_district' AS rule, district AS subject, round(avg_occupancy, 6) AS occupancy, 'now' AS period,
      100 - round_even(avg_occupancy, 0) AS effect FROM (SELECT * FROM d ORDER BY avg_occupancy, district LIMIT 1)
    UNION ALL SELECT 2, 'hotelier', 'busy_district', district, round(avg_occupancy, 6), 'now', round_even(avg_occupancy / 5, 0)
      FROM (SELECT * FROM d ORDER BY avg_occupancy DESC, district DESC LIMIT 1) WHERE avg_occupancy > 50
    UNION ALL SELECT 3, 'tourist', 'low_month', {RU_MONTH}, round(occ, 6), CASE WHEN month > cm THEN 'this_year' WHEN month = cm THEN 'now'
      ELSE 'next_year' END, round_even(100 - occ, 0) FROM lo, cur
    UNION ALL SELECT 4, 'hotelier', 'peak_month', {RU_MONTH}, round(occ, 6), CASE WHEN month > cm THEN 'this_year' WHEN month = cm THEN 'now'
      ELSE 'next_year' END, round_even(occ / 4, 0) FROM hi, cur""")
def _(t):
    return K.recommendations(snapshot(t), K.monthly_statistics(t.stats), REGIONS, F.month(t.as_of))


@query("ag23_data_coverage", f"""SELECT district, strftime(date, '%Y-%m') AS month, count(*) AS days_count, round(avg(avg_occupancy), 6) AS avg_occupancy,
    round(min(avg_occupancy), 6) AS min_occupancy, round(max(avg_occupancy), 6) AS max_occupancy FROM ({SERIES}) GROUP BY 1, 2""")
def _(t):
    return K.data_coverage(series(t))


@query("so07_missing_months", f"""WITH o AS (SELECT DISTINCT district, date_trunc('month', date) AS m FROM {JOINED} WHERE rooms_num > 0),
    r AS (SELECT district, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM o GROUP BY district)
    SELECT district, strftime(m, '%Y-%m-%d') AS month FROM r WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.district = r.district AND o.m = r.m)""")
def _(t):
    return K.missing_months(K.daily_series(t.stats, t.hotels))


@query("wn03_gaps", """SELECT district, CAST(a AS VARCHAR) AS gap_from, CAST(b AS VARCHAR) AS gap_to, CAST(b - a AS INTEGER) AS gap_days FROM (
    SELECT district, date AS a, lead(date) OVER (PARTITION BY district ORDER BY date) AS b FROM district_daily) WHERE b - a > 1""")
def _(t):
    return K.gaps(t.district_daily, 1, "district")


@query("wn03_gaps_per_hotel", f"""SELECT id, CAST(a AS VARCHAR) AS gap_from, CAST(b AS VARCHAR) AS gap_to, CAST(b - a AS INTEGER) AS gap_days FROM (
    SELECT id, date AS a, lead(date) OVER (PARTITION BY id ORDER BY date) AS b FROM hotel_statistics) WHERE b - a > 7""")
def _(t):
    return K.gaps(t.stats, 7, "id")


@query("ag24_metadata", f"""SELECT CAST(min(date) AS VARCHAR) AS data_from, CAST(max(date) AS VARCHAR) AS data_to,
    CAST(max(updated_at) AS VARCHAR) AS last_refresh, (SELECT count(*) FROM hotels) AS hotels_count, (SELECT count(*) FROM cal_events) AS events_count,
    (SELECT count(*) FROM cal_events WHERE date_start >= (SELECT today FROM event_today)) AS upcoming_events,
    (SELECT count(*) FROM (SELECT date AS a, lead(date) OVER (ORDER BY date) AS b FROM (SELECT DISTINCT date FROM hotel_statistics))
     WHERE b - a > 7) AS gap_count FROM hotel_statistics""")
def _(t):
    return K.metadata(t.stats, t.hotels, t.cal_events, t.event_today)


HIST = f"""SELECT date, avg(avg_price) AS avg_price, min(avg_price) AS min_price, max(avg_price) AS max_price, count(*) AS samples
    FROM ({SERIES}) WHERE date BETWEEN (SELECT today FROM as_of) - 60 AND (SELECT today FROM as_of) AND avg_price > 0 GROUP BY date"""


@query("ag25_price_history", f"""SELECT CAST(date AS VARCHAR) AS date, round(avg_price, 6) AS avg_price, min_price, max_price, samples FROM ({HIST})""")
def _(t):
    return K.price_history(series(t), since(t, 60), t.as_of)


@query("wn07_price_trend", f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS rn FROM ({HIST})),
    a AS (SELECT avg(avg_price) FILTER (WHERE rn <= 7) AS x, avg(avg_price) FILTER (WHERE rn BETWEEN 8 AND 14) AS y, count(*) AS n FROM r WHERE rn <= 14)
    SELECT round(x, 6) AS recent_avg, round(y, 6) AS previous_avg, round((x - y) / y * 100, 6) AS change_percent,
    CASE WHEN (x - y) / y * 100 > 2 THEN 'up' WHEN (x - y) / y * 100 < -2 THEN 'down' ELSE 'stable' END AS direction FROM a WHERE n = 14""")
def _(t):
    return K.seven_day_trend(K.price_history(series(t), since(t, 60), t.as_of), "avg_price")


@query("wn07_occupancy_trend_by_district", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY date DESC) AS rn FROM ({SERIES})),
    a AS (SELECT district, avg(avg_occupancy) FILTER (WHERE rn <= 7) AS x, avg(avg_occupancy) FILTER (WHERE rn BETWEEN 8 AND 14) AS y, count(*) AS n
      FROM r WHERE rn <= 14 GROUP BY district)
    SELECT district, round(x, 6) AS recent_avg, round(y, 6) AS previous_avg, round((x - y) / y * 100, 6) AS change_percent,
    CASE WHEN (x - y) / y * 100 > 2 THEN 'up' WHEN (x - y) / y * 100 < -2 THEN 'down' ELSE 'stable' END AS direction FROM a WHERE n = 14""")
def _(t):
    return K.seven_day_trend(series(t), "avg_occupancy", keys=["district"])


@query("ag26_district_date_heatmap", f"""SELECT district, CAST(date AS VARCHAR) AS date, round(avg_occupancy, 6) AS occupancy FROM ({SERIES})
    WHERE date BETWEEN (SELECT today FROM as_of) - 90 AND (SELECT today FROM as_of)""")
def _(t):
    return series(t).filter(F.col("date").between(since(t, 90), t.as_of)).select(
        "district", "date", F.col("avg_occupancy").alias("occupancy"))


@query("ag27_timeseries_summary", f"""SELECT district, round(min(avg_occupancy), 6) AS min_occupancy, round(max(avg_occupancy), 6) AS max_occupancy,
    round(avg(avg_occupancy), 6) AS avg_occupancy, count(*) AS samples FROM ({SERIES})
    WHERE date BETWEEN (SELECT today FROM as_of) - 365 AND (SELECT today FROM as_of) GROUP BY district""")
def _(t):
    return K.timeseries_summary(series(t), since(t, 365), t.as_of)


@query("ag28_selection_series", f"""SELECT CAST(date AS VARCHAR) AS date, round(avg(avg_occupancy), 6) AS occupancy,
    round(avg(avg_price) FILTER (WHERE avg_price > 0), 6) AS price, CAST(sum(total_rooms) AS BIGINT) AS total_rooms FROM ({SERIES})
    WHERE {IN_REGIONS} GROUP BY date""")
def _(t):
    return K.selection_series(series(t), REGIONS)


MAP = f"""SELECT h.id, name, city, h.district, lat, lon, rating, h.min_price, coalesce(rooms_num, 0) AS rooms_num,
    least(greatest(coalesce(free_rooms_amount, 0), 0), coalesce(rooms_num, 0)) AS free_rooms,
    CASE WHEN rooms_num > 0 THEN 100.0 * (rooms_num - least(greatest(coalesce(free_rooms_amount, 0), 0), rooms_num)) / rooms_num END AS occupancy,
    avg_occupancy AS district_occupancy, coalesce(max_capacity, 0) AS max_capacity
    FROM hotels h %s JOIN (SELECT id, rooms_num, free_rooms_amount, max_capacity FROM hotel_statistics WHERE date = {LATEST}) s ON s.id = h.id
    LEFT JOIN ({SNAP}) d ON d.district = h.district WHERE lat <> 0 AND lon <> 0"""


def latest_rows(t):
    return t.stats.filter(F.col("date") == t.as_of)


@query("jn03_map_rows", f"""SELECT * REPLACE (round(occupancy, 6) AS occupancy, round(district_occupancy, 6) AS district_occupancy,
    round(lat, 6) AS lat, round(lon, 6) AS lon) FROM ({MAP % 'LEFT'})""")
def _(t):
    return K.map_rows(t.hotels, latest_rows(t), snapshot(t), explicit_date=False)


@query("jn03_map_rows_on_date", f"""SELECT * REPLACE (round(occupancy, 6) AS occupancy, round(district_occupancy, 6) AS district_occupancy,
    round(lat, 6) AS lat, round(lon, 6) AS lon) FROM ({MAP % ''})""")
def _(t):
    return K.map_rows(t.hotels, latest_rows(t), snapshot(t), explicit_date=True)


@query("ag28_selection_kpi", f"""SELECT count(*) AS total_hotels, CAST(sum(rooms_num) AS BIGINT) AS total_rooms, CAST(sum(free_rooms) AS BIGINT) AS free_rooms,
    round(100.0 * (sum(rooms_num) - sum(free_rooms)) / nullif(sum(rooms_num), 0), 6) AS occupancy FROM ({MAP % 'LEFT'})""")
def _(t):
    return K.selection_kpi(K.map_rows(t.hotels, latest_rows(t), snapshot(t), explicit_date=False))


@query("ag34_statistics_card", f"""SELECT round(avg(avg_occupancy) FILTER (WHERE avg_occupancy > 0), 6) AS avg_occupancy,
    CAST(sum(total_rooms) AS BIGINT) AS total_rooms, CAST(sum(free_rooms) AS BIGINT) AS free_rooms FROM ({SNAP})""")
def _(t):
    return K.statistics_card(snapshot(t))


@query("ag34_revenue_window", f"""SELECT a.district, round(o, 6) AS occupancy, days, CAST(l AS VARCHAR) AS last_date, round(p50, 6) AS adr,
    round(p50 * o / 100, 6) AS revpar, (SELECT today FROM as_of) - l > 3 AS is_stale FROM (SELECT district, avg(avg_occupancy) AS o, count(*) AS days,
      max(date) AS l FROM ({SERIES}) WHERE date >= (SELECT today FROM as_of) - 90 GROUP BY district) a LEFT JOIN ({PCTS}) b ON a.district = b.district""")
def _(t):
    return K.revenue_window(series(t), percentiles(t), since(t, 90), t.as_of)


@query("ag35_register_coverage", f"""SELECT total_hotels, 549 AS register_total, round(total_hotels / 549.0 * 100, 6) AS coverage_percent FROM ({TOTALS})""")
def _(t):
    return K.register_coverage(totals(t))


@query("ag39_rollup", f"""SELECT district, size, type, CAST(grouping(district, size, type) AS INTEGER) AS level, round({OCC}, 6) AS occupancy, count(*) AS objects
    FROM (SELECT district, {SIZE} AS size, coalesce(accommodation_type, 'unknown') AS type, rooms_num, available_rooms_percent
      FROM ({RECENT}) s JOIN (SELECT id AS hid, district, accommodation_type FROM hotels) h ON hid = s.id)
    GROUP BY GROUPING SETS ((district, size), (district, type), (district), ())""")
def _(t):
    return K.rollup(t.stats, t.hotels, t.as_of)


@query("ag41_years", "SELECT DISTINCT CAST(year(date) AS INTEGER) AS year FROM hotel_statistics")
def _(t):
    return t.stats.select(F.year("date").alias("year")).distinct()


@query("st06_top_candidates", """SELECT h.id, name, district, max(rooms_num) AS rooms_num, count(date) AS history_points
    FROM hotels h JOIN hotel_statistics s ON s.id = h.id WHERE rooms_num >= 20 GROUP BY h.id, name, district HAVING count(date) >= 60
    ORDER BY max(rooms_num) DESC, count(date) DESC, h.id LIMIT 20""")
def _(t):
    return K.top_candidates(t.stats, t.hotels, 20)


SNAPCOLS = """id, CAST(date AS VARCHAR) AS date, coalesce(rooms_num, 0) AS rooms_num, coalesce(free_rooms_amount, 0) AS free_rooms,
    coalesce(max_capacity, 0) AS max_capacity"""


@query("src14_latest_snapshot", f"SELECT {SNAPCOLS} FROM hotel_statistics WHERE date = {LATEST}")
def _(t):
    return K.snapshot_on(t.stats, t.as_of, strict=True)


@query("jn10_snapshot_as_of", f"""SELECT {SNAPCOLS} FROM hotel_statistics
    WHERE date = (SELECT max(date) FROM hotel_statistics WHERE date <= DATE '1997-08-01')""")
def _(t):
    return K.snapshot_on(t.stats, F.lit("1997-08-01").cast("date"))


@query("jn10_snapshot_after_a_gap", f"""SELECT {SNAPCOLS} FROM hotel_statistics WHERE date = (SELECT max(date) FROM hotel_statistics WHERE date < DATE '1997-07-20')""")
def _(t):
    """No facts for a fortnight before the day: the last day that has some."""
    gap = t.stats.filter(~F.col("date").between("1997-07-20", "1997-08-03"))
    return K.snapshot_on(gap, F.lit("1997-08-01").cast("date"))


@query("jn10_as_of_per_hotel", f"""SELECT DISTINCT ON (id) id, CAST(date AS VARCHAR) AS date, rooms_num, free_rooms_amount, available_rooms_percent,
    min_price, max_capacity FROM hotel_statistics WHERE hotel_statistics.date <= DATE '1997-08-01' ORDER BY id, hotel_statistics.date DESC""")
def _(t):
    return K.as_of_per_hotel(t.stats, F.lit("1997-08-01").cast("date"))
