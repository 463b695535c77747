"""Similar titles, map matching, document index and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.functions.similarity import token_set_ratio_column
from staylens.operators import events as E
from staylens.operators import matching as G
from staylens.operators import search as Q
from staylens.plans import p02_events as P2
from staylens.plans.p03_text import EVENT_DOC, HOTEL_DOC
from staylens.plans.registry import query
from staylens.session import materialise
from staylens.streaming import jobs as J


def spelled(t):
    """Events whose titles are written in two ways, so that the exact pass leaves something to the fuzzy one."""
    k = F.col("event_id").cast("bigint")
    title = F.when(k % 3 == 0, F.concat(F.col("title"), F.lit(" show"))).when(k % 3 == 1, F.replace("title", F.lit("E"), F.lit("EE"))).otherwise(F.col("title"))
    return P2.located(t).withColumn("title", title)


@query("ud02_token_set_ratio")
def _(t):
    keys = t.cal_events.select(F.lower("title").alias("a")).distinct()
    other = F.concat_ws(" ", F.reverse(F.split("a", " ")))
    return keys.select("a", token_set_ratio_column(F.col("a"), other).alias("same_tokens"), token_set_ratio_column(F.col("a"), F.replace("a", F.lit("e"), F.lit("ee"))).alias("spelled"))


@query("so05_fuzzy_dedup")
def _(t):
    exact = E.exact_dedup(spelled(t), F.col("district"))
    return G.fuzzy_dedup(exact).select("event_id", "district", "date_start", "group_key", F.array_join("also_at", ",").alias("also_at"))


def catalogue(t):
    """A second catalogue: customers scattered over the map the hotels are on."""
    k = F.col("c_custkey")
    return t.raw("customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("id"), ((k % 4000).cast("double") / 1000 + 51.5).alias("lat"), ((k % 6000).cast("double") / 1000 + 103.5).alias("lon"),
        F.when(k % 7 != 0, F.lower("c_mktsegment")).alias("accommodation_type"))


@query("jn08_nearest_one_to_one")
def _(t):
    return G.match_one_to_one(t.hotels, catalogue(t), 5.0)


PAIRS = """(SELECT h.id AS l, c.id AS r, 2 * 6371 * asin(sqrt(sin(radians(c.lat - h.lat) / 2) ** 2 + cos(radians(h.lat)) * cos(radians(c.lat)) * sin(radians(c.lon - h.lon) / 2) ** 2)) AS km
    FROM hotels h, (SELECT 'c' || c_custkey AS id, CAST(c_custkey % 4000 AS DOUBLE) / 1000 + CAST(51.5 AS DOUBLE) AS lat, CAST(c_custkey % 6000 AS DOUBLE) / 1000 + CAST(103.5 AS DOUBLE) AS lon FROM customer) c
    WHERE h.lat IS NOT NULL)"""


@query("jn08_pairs_within_radius", f"SELECT l, r, round(km, 6) AS km FROM {PAIRS} WHERE km < 5")
def _(t):
    return G.pairs_within(t.hotels.filter("lat IS NOT NULL"), catalogue(t), 5.0)


@query("jn09_fill_types")
def _(t):
    return G.fill_types(t.hotels, catalogue(t), 5.0)[1]


FALLBACK = {"small ring": "a ring to wear", "widget": "a thing", "red": "something red"}
KINDS = {"ECONOMY": "cheap", "STANDARD": "usual"}


@query("jn19_fill_descriptions", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_brand WHEN lower(p_name) = 'small ring' THEN 'a ring to wear'
    WHEN contains(lower(p_name), 'small ring') OR contains('small ring', lower(p_name)) THEN 'a ring to wear' WHEN contains(lower(p_name), 'widget') OR contains('widget', lower(p_name)) THEN 'a thing'
    WHEN contains(lower(p_name), 'red') OR contains('red', lower(p_name)) THEN 'something red' WHEN p_type = 'ECONOMY' THEN 'cheap' WHEN p_type = 'STANDARD' THEN 'usual' ELSE '' END AS description FROM part""")
def _(t):
    items = t.raw("part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).alias("description"))
    return G.fill_descriptions(items, FALLBACK, KINDS).select("p_partkey", "description")


@query("jn17_weather_history_and_forecast", """SELECT CAST(date AS VARCHAR) AS date, CASE WHEN date < DATE '2000-01-01' THEN temperature_max ELSE temperature_max + 1 END AS temperature_max FROM weather
    WHERE date < DATE '2000-01-01' OR date >= DATE '1999-12-01' AND NOT (date < DATE '2000-01-01')""")
def _(t):
    cols = t.weather.select("date", "temperature_max")
    today = F.lit("2000-01-01").cast("date")
    return G.merge_weather(cols, cols.filter(F.col("date") >= today).withColumn("temperature_max", F.col("temperature_max") + 1), today)


@query("ml24_rendered_documents", f"""SELECT 'hotel_' || id AS id, {HOTEL_DOC} AS text, 'hotel' AS type, district AS place FROM hotels
    UNION ALL SELECT 'event_' || event_id, {EVENT_DOC}, 'event', CAST(date_start - DATE '1970-01-01' AS VARCHAR) FROM cal_events""")
def _(t):
    m = F.col("metadata")
    return Q.rendered_documents(t.hotels, t.cal_events).select("id", "text", m["type"].alias("type"), F.coalesce(m["district"], m["date_epoch_days"]).alias("place"))


@query("ml24_document_index")
def _(t):
    index = Q.stored_index(Q.rendered_documents(t.hotels, t.cal_events), J.work_folder(t.spark, "index"), 64)
    return index.select("id", F.size("embedding").alias("dimensions"), F.col("metadata")["source"].alias("source"), "embedding")


CENTRE = """c AS (SELECT label, list(v ORDER BY i) AS q FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i) GROUP BY label)"""


@query("ml25_vector_search", f"""WITH {CENTRE}, s AS (SELECT c.label AS query_id, vec_id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS d FROM embeddings, c)
    SELECT query_id, vec_id, round(d, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM s) WHERE rank <= 10""")
def _(t):
    v = t.raw("embeddings")
    return Q.top_k(v, Q.centroids(v, "label"), 10, "vec_id")


@query("ml25_filtered_vector_search", f"""WITH {CENTRE}, s AS (SELECT c.label AS query_id, vec_id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS d FROM embeddings e, c WHERE e.label >= 3)
    SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM s) WHERE rank <= 5""")
def _(t):
    v = t.raw("embeddings")
    return Q.top_k(Q.matching(v, F.col("label") >= 3), Q.centroids(v, "label"), 5, "vec_id").drop("distance")


@query("ml25_hashed_search")
def _(t):
    """Every hundredth vector against all, through the hashed index."""
    v = t.raw("embeddings")
    asked = v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return Q.hashed_top_k(materialise(Q.hashed_index(v, 8, "vec_id")), asked, 10, 8, 216, "vec_id")


@query("ml26_document_list_and_delete", """SELECT source, count(*) AS n FROM (SELECT 'hotels' AS source, id FROM hotels WHERE district <> 'ASIA' UNION ALL SELECT 'events', event_id FROM cal_events) GROUP BY source""")
def _(t):
    docs = Q.rendered_documents(t.hotels, t.cal_events)
    gone = docs.filter(F.col("metadata")["district"] == "ASIA")
    left = Q.delete_documents(docs, gone)
    return Q.list_documents(left).groupBy(F.col("metadata")["source"].alias("source")).agg(F.count("*").alias("n"))
