"""Ingestion and monitoring as Structured Streaming jobs.

Every job is a function of a streaming DataFrame, so the source (files that collectors land, a queue) and the cadence
(trigger) are the caller's. Tables are written by keyed merges inside foreachBatch: a micro-batch that is replayed after
a failure merges to the same content."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from staylens import model as M
from staylens.operators import upsert as U
from staylens.session import checkpoint_dir

STATISTICS_COLUMNS = ("id", "date", "rooms_num", "free_rooms_amount", "available_rooms_percent", "min_price", "max_capacity", "updated_at")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a job's table and checkpoint below the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def file_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Stream of the Parquet files of one landed table."""
    schema = spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def drain(writer, checkpoint: str) -> None:
    """Run a stream over everything that is available now, then stop."""
    query: StreamingQuery = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_statistics(snapshots: DataFrame, table: U.KeyedTable, order: str = "ingest_order"):
    """SM-01 / SM-03: hotel-day snapshots into the statistics table. Within a micro-batch the snapshot that sorts last
    counts; a later one replaces what is stored, an older late-comer does not. Both are one choice among stored and new rows."""
    schema = M.HOTEL_STATISTICS + f", {order} long"

    def merge(batch: DataFrame, _: int) -> None:
        table.merge_latest(U.valid_keys(batch, ["id", "date"]), schema, order)

    return snapshots.select(*STATISTICS_COLUMNS, order).writeStream.foreachBatch(merge)


def ingest_events(events: DataFrame, table: U.KeyedTable, order: str = "ingest_order"):
    """SM-02: event rows of many feeds. Of an id's versions in a micro-batch the one that sorts last counts; it is merged by
    (source, date, title): given values win, the id of the first insert stays. A later delivery of an id is merged again, so its
    changes arrive, and a repeated one changes nothing."""
    columns = [c.split()[0] for c in M.CAL_EVENTS.split(", ")]

    def merge(batch: DataFrame, _: int) -> None:
        table.merge(U.latest_version(batch, ["event_id"], [order]), M.CAL_EVENTS, lambda old, new: U.merge_events(old.select(*columns), new, order))

    return events.select(*columns, order).writeStream.foreachBatch(merge)


def relabel_stream(events: DataFrame, label: Column) -> DataFrame:
    """SM-08: stateless re-classification of arriving rows (SNK-11)."""
    return U.relabel(events, label)


# --- windows of the activity stream -----------------------------------------------------------------------------------
def tumbling_counts(events: DataFrame, size: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """SM-07: rows per type and hour. The same definition serves a stream and a batch."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sliding_mean(events: DataFrame, days: int = 7, delay: str = "2 days") -> DataFrame:
    """SM-07: mean value over the days before and including each day. Rows are added up per day first, so the
    overlapping windows copy one row per day and not every event."""
    daily = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("d"), "event_type").agg(
        F.sum("value").alias("s"), F.count("value").alias("c"))
    return daily.groupBy(F.window(F.window_time("d"), f"{days} days", "1 day").alias("w"), "event_type").agg(
        (F.sum("s") / F.sum("c")).alias("mean_value")).select(F.col("w.start").alias("window_start"), "event_type", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """SM-07: activity sessions per user."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "user_id", "n")


# --- fixed values: expected hours between runs of a source -------------------------------------------------------------
JOB_HOURS = {"events": 6.0, "hotels": 2.0, "hotels_full": 24.0, "weather": 3.0, "telegram": 1.0}
# ----------------------------------------------------------------------------------------------------------------------


def expected_hours(source: Column) -> Column:
    s = F.lower(source)
    exact = None
    for name, hours in JOB_HOURS.items():
        exact = F.when(s == name, hours) if exact is None else exact.when(s == name, hours)
    return (
        exact.when(F.startswith(s, F.lit("hotels")) | (s == "101hotels"), JOB_HOURS["hotels"])
        .when(F.startswith(s, F.lit("weather")) | (s == "openmeteo"), JOB_HOURS["weather"])
        .when(F.startswith(s, F.lit("telegram")), JOB_HOURS["telegram"]).otherwise(JOB_HOURS["events"])
    )


def freshness(last_runs: DataFrame, now: Column) -> DataFrame:
    """SM-06: age, expected interval, staleness beyond twice the interval, silent emptiness, next expected run. Takes the
    last run per source, from a batch or from a stream joined with nothing."""
    hours = expected_hours(F.col("source"))
    age = (F.unix_timestamp(now) - F.unix_timestamp("run_ts")) / 60.0
    return last_runs.select(
        "source", "status", "items", age.alias("age_minutes"), (hours * 60).alias("expected_minutes"), (age > hours * 120).alias("is_stale"),
        ((F.col("status") == "ok") & (F.coalesce("items", F.lit(0)) == 0)).alias("is_empty"),
        F.timestamp_seconds(F.unix_timestamp("run_ts") + (hours * 3600).cast("bigint")).alias("next_expected_run"))


def last_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source").agg(F.max_by(F.struct("status", "items", "run_ts"), F.col("run_ts")).alias("r")).select("source", "r.*")
