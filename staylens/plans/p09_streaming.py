"""Streams over the landed tables: each runs over all available files into a table, which is the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.functions import text as S
from staylens.operators import upsert as U
from staylens.plans.p02_events import RUNS, source_runs
from staylens.plans.registry import query
from staylens.streaming import jobs as J
from staylens.streaming import timed as TS


def stored(t, stream, name):
    """Write an append stream to Parquet until the source is drained and read it back."""
    folder = J.work_folder(t.spark, name)
    J.drain(stream.writeStream.format("parquet").option("path", f"{folder}/table").outputMode("append"), f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/table")


def activity(t):
    return t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("sm01_snapshot_ingestion", """SELECT CAST(l_suppkey AS VARCHAR) AS id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, CAST(arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS INTEGER) AS rooms_num,
    CAST(max(l_orderkey * 10 + l_linenumber) AS BIGINT) AS ingest_order FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""")
def _(t):
    folder = J.work_folder(t.spark, "statistics")
    table = U.statistics_table(t.spark, f"{folder}/table")
    q = F.col("l_quantity").cast("int")
    snapshots = J.file_stream(t.spark, t.folder, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("id"), F.to_date("l_shipdate").alias("date"), q.alias("rooms_num"), F.lit(0).alias("free_rooms_amount"),
        (F.col("l_discount") * 1000).alias("available_rooms_percent"), F.lit(1000).alias("min_price"), (q * 2).alias("max_capacity"),
        F.col("l_shipdate").cast("timestamp").alias("updated_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ingest_order"))
    J.drain(J.ingest_statistics(snapshots, table), f"{folder}/checkpoint")
    return t.spark.read.parquet(table.path).select("id", "date", "rooms_num", "ingest_order")


@query("sm02_event_ingestion", """SELECT o_orderstatus AS source_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_start, o_orderpriority AS title, CAST(max(o_orderkey) AS VARCHAR) AS event_id
    FROM orders GROUP BY 1, 2, 3""")
def _(t):
    folder = J.work_folder(t.spark, "events")
    table = U.events_table(t.spark, f"{folder}/table")
    text = lambda name: F.lit(None).cast("string").alias(name)
    rows = J.file_stream(t.spark, t.folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_orderpriority").alias("title"), text("description"), F.to_date("o_orderdate").alias("date_start"),
        F.lit(None).cast("date").alias("date_end"), text("event_type"), text("location"), F.col("o_orderstatus").alias("source_id"), text("url"), text("time_start"),
        F.lit(None).cast("int").alias("price_min"), F.lit(None).cast("int").alias("price_max"), text("image_url"), text("address"), text("age_restriction"),
        F.col("o_orderdate").cast("timestamp").alias("ingest_ts"), F.col("o_orderkey").alias("ingest_order"))
    J.drain(J.ingest_events(rows, table), f"{folder}/checkpoint")
    return t.spark.read.parquet(table.path).select("source_id", "date_start", "title", "event_id")


@query("sm03_late_snapshots", """SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, count(DISTINCT l_suppkey) AS hotels FROM lineitem GROUP BY 1""")
def _(t):
    """Two deliveries: the second brings older snapshots again, which must change nothing."""
    folder = J.work_folder(t.spark, "late")
    table = U.statistics_table(t.spark, f"{folder}/table")
    base = J.file_stream(t.spark, t.folder, "lineitem")
    row = lambda order: base.select(
        F.col("l_suppkey").cast("string").alias("id"), F.to_date("l_shipdate").alias("date"), order.cast("int").alias("rooms_num"), F.lit(0).alias("free_rooms_amount"), F.lit(0.0).alias("available_rooms_percent"),
        F.lit(0).alias("min_price"), F.lit(0).alias("max_capacity"), F.col("l_shipdate").cast("timestamp").alias("updated_at"), order.cast("bigint").alias("ingest_order"))
    J.drain(J.ingest_statistics(row(F.lit(2)), table), f"{folder}/first")
    J.drain(J.ingest_statistics(row(F.lit(1)), table), f"{folder}/second")
    return t.spark.read.parquet(table.path).filter("rooms_num = 2").groupBy("date").agg(F.count("*").alias("hotels"))


def decided(t, rows, time, operator, name):
    """Run a stream in event time until all its rows are decided: a closing row of no key, far in the future, moves the watermark past them."""
    closing = f"{J.work_folder(t.spark, name)}/closing"
    last = [F.lit("2200-01-01").cast("timestamp").alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    t.spark.range(1).select(*last).write.parquet(closing)
    folder = J.work_folder(t.spark, name)
    stream = operator(rows.unionByName(t.spark.readStream.schema(rows.schema).parquet(closing)))
    with TS.with_timers(t.spark):
        J.drain(stream.writeStream.format("parquet").option("path", f"{folder}/table").outputMode("append"), f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/table")


@query("sm04_rate_limit")
def _(t):
    requests = J.file_stream(t.spark, t.folder, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("event_time"))
    return decided(t, requests, "event_time", lambda r: TS.rate_limit(r, limit=2, period_seconds=7200.0, slot_seconds=14 * 86400.0), "limit")


# the mean moves at good runs only, by its share of all runs so far
HEALTH = f"""WITH RECURSIVE r AS (SELECT *, status = 'ok' AND items > 0 AS good, epoch(run_ts) AS secs FROM {RUNS}),
    g AS (SELECT *, CAST(sum(CAST(good AS INTEGER)) OVER w AS BIGINT) AS grp, row_number() OVER w AS total_runs, sum(CAST(NOT good AS INTEGER)) OVER w AS total_errors FROM r WINDOW w AS (PARTITION BY source ORDER BY run_ts, event_id)),
    f AS (SELECT *, sum(CAST(NOT good AS INTEGER)) OVER (PARTITION BY source, grp ORDER BY run_ts, event_id) AS consecutive_failures,
      coalesce(max(CASE WHEN good THEN items END) OVER (PARTITION BY source, grp), 0) AS last_count, max(CASE WHEN good THEN secs END) OVER (PARTITION BY source, grp) AS last_success FROM g),
    m AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS grp, CAST(0 AS DOUBLE) AS mean FROM r
      UNION ALL SELECT g.source, g.grp, (m.mean * (g.total_runs - 1) + g.items) / g.total_runs FROM m JOIN g ON g.source = m.source AND g.grp = m.grp + 1 AND g.good),
    s AS (SELECT f.*, m.mean, CASE WHEN consecutive_failures >= 3 THEN 'CRITICAL' WHEN consecutive_failures >= 1 THEN 'WARNING' WHEN last_count = 0 THEN 'EMPTY' ELSE 'OK' END AS now FROM f JOIN m ON m.source = f.source AND m.grp = f.grp),
    b AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY source ORDER BY run_ts, event_id), 'OK') AS before FROM s)
    SELECT source, event_id AS run_id, now AS status, consecutive_failures < 3 AND NOT coalesce(secs - last_success > 86400, false) AND NOT (mean > 0 AND last_count < mean * 0.3) AS healthy,
      total_runs, CAST(total_errors AS BIGINT) AS total_errors, CAST(consecutive_failures AS BIGINT) AS consecutive_failures, CAST(last_count AS BIGINT) AS last_count, round(mean, 6) AS avg_count,
      concat_ws(',', CASE WHEN now <> before AND now IN ('CRITICAL', 'WARNING') THEN now WHEN now <> before AND now = 'OK' AND before IN ('CRITICAL', 'WARNING') THEN 'RECOVERED' END,
        CASE WHEN good AND mean > 5 AND items < mean * 0.3 THEN 'LOW_DATA' END) AS alerts FROM b"""


@query("sm05_source_health", HEALTH)
def _(t):
    v = F.floor("value").cast("int")
    runs = J.file_stream(t.spark, t.folder, "events").select(
        F.col("event_type").alias("source"), F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("run_time"), (v % 5).alias("items"), (v % 3 == 0).alias("success"))
    return decided(t, runs, "run_time", lambda r: TS.source_health(r, slot_seconds=86400.0), "health")


@query("sm06_staleness_stream", f"""SELECT source, event_id AS run_id, status, CAST(items AS BIGINT) AS items, strftime(run_ts, '%Y-%m-%d %H:%M') AS last_run, CAST(30 AS DOUBLE) AS expected_minutes
    FROM (SELECT *, lead(run_ts) OVER (PARTITION BY source ORDER BY run_ts, event_id) AS next FROM {RUNS}) WHERE next IS NULL OR next > run_ts + INTERVAL 1 HOUR""")
def _(t):
    """Sources that are expected every half hour."""
    runs = J.file_stream(t.spark, t.folder, "events")
    v = F.floor("value").cast("int")
    runs = runs.select(F.col("event_type").alias("source"), F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("run_time"),
        F.when(v % 3 == 0, "ok").when(v % 3 == 1, "warn").otherwise("fail").alias("status"), (v % 5).alias("items"))
    found = decided(t, runs, "run_time", lambda r: TS.staleness(r, F.lit(0.5), slot_seconds=86400.0), "stale")
    return found.select("source", "run_id", "status", "items", F.date_format("last_run", "yyyy-MM-dd HH:mm").alias("last_run"), "expected_minutes")


@query("sm06_freshness", f"""WITH l AS (SELECT source, arg_max(status, run_ts) AS status, arg_max(items, run_ts) AS items, floor(epoch(max(run_ts))) AS e FROM {RUNS} GROUP BY source),
    a AS (SELECT *, (epoch(TIMESTAMP '2024-02-01 00:00:00') - e) / 60.0 AS age FROM l)
    SELECT source, status, items, round(CAST(age AS DOUBLE), 6) AS age_minutes, CAST(360 AS DOUBLE) AS expected_minutes, age > 720 AS is_stale, status = 'ok' AND items = 0 AS is_empty,
    strftime(make_timestamp(CAST((e + 21600) * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS next_expected_run FROM a""")
def _(t):
    runs = source_runs(t).withColumn("run_ts", F.col("run_ts").cast("timestamp"))
    return J.freshness(J.last_runs(runs), F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query("sm07_tumbling_counts", """SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def _(t):
    return J.tumbling_counts(activity(t))


@query("sm07_sliding_mean", """WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, sum(value) AS s, count(value) AS c FROM events GROUP BY 1, 2)
    SELECT strftime(day - CAST(i AS INTEGER), '%Y-%m-%d 00:00:00') AS window_start, event_type, round(sum(s) / sum(c), 6) AS mean_value FROM d, (SELECT unnest(range(0, 7)) AS i) GROUP BY 1, 2""")
def _(t):
    return J.sliding_mean(activity(t))


@query("sm07_sessions", """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
    x AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, floor(epoch(min(ts))) AS start_second, floor(epoch(max(ts) + INTERVAL 30 MINUTE)) AS end_second, count(*) AS n FROM x GROUP BY user_id, k""".replace("floor(epoch(min(ts)))", "CAST(floor(epoch(min(ts))) AS BIGINT)")
       .replace("floor(epoch(max(ts) + INTERVAL 30 MINUTE))", "CAST(floor(epoch(max(ts) + INTERVAL 30 MINUTE)) AS BIGINT)"))
def _(t):
    s = J.sessions(activity(t))
    return s.select("user_id", F.unix_timestamp("session_start").alias("start_second"), F.unix_timestamp("session_end").alias("end_second"), "n")


@query("sm08_relabel_stream", """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'concert' WHEN o_orderpriority = '2-HIGH' THEN 'event' ELSE 'other' END AS event_type FROM orders""")
def _(t):
    rows = J.file_stream(t.spark, t.folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "event").otherwise("other").alias("event_type"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Концерт").otherwise("Встреча").alias("title"))
    return stored(t, J.relabel_stream(rows, S.event_type("title", F.lit(""))).select("o_orderkey", "event_type"), "relabel")
