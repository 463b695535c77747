"""Keyed merges. The DataFrame functions give the merged content; `KeyedTable` applies them to a Parquet table by
rewriting only the partitions that the changes touch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.session import stored


def latest_version(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the one that sorts last. Combines map-side."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*rows.columns)


def valid_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all present and not blank."""
    ok = F.lit(True)
    for k in keys:
        ok = ok & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    return rows.filter(ok)


def overwrite(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """SNK-02 / SNK-03: new rows replace old ones with the same key; among new ones the greatest `order` wins."""
    cols = old.columns
    fresh = valid_keys(new, keys)
    ranks = [F.col("_gen")] + ([F.col(order)] if order else [])
    tagged = old.withColumn("_gen", F.lit(0))
    if order and order not in cols:
        tagged = tagged.withColumn(order, F.lit(None).cast(new.schema[order].dataType))
    both = tagged.unionByName(fresh.select(*[c for c in tagged.columns if c != "_gen"]).withColumn("_gen", F.lit(1)))
    rest = [c for c in cols if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*ranks)).alias("_row")
    return both.groupBy(*keys).agg(best).select(*keys, "_row.*").select(*cols)


def coalesce_merge(
    old: DataFrame, new: DataFrame, keys: Sequence[str], keep_old: Sequence[str] = (), prefer_new: Sequence[str] | None = None,
    order: str | None = None,
) -> DataFrame:
    """SNK-01 / SNK-04: full outer merge on the key. `prefer_new` columns take the new value unless it is NULL (default:
    every column not named in `keep_old`); `keep_old` columns keep the value of the first insert. Columns in neither list
    are overwritten. New rows are reduced to one per key first."""
    cols = old.columns
    fresh = valid_keys(new, keys)
    fresh = latest_version(fresh, keys, [order]) if order else fresh
    fresh = fresh.select(*cols)
    rest = [c for c in cols if c not in keys]
    if prefer_new is None:
        prefer_new = [c for c in rest if c not in keep_old]
    a = old.select(*keys, F.struct(*rest).alias("_old"))
    b = fresh.select(*keys, F.struct(*rest).alias("_new"))
    joined = a.join(b, list(keys), "full")

    def pick(c: str) -> Column:
        o, n = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        if c in keep_old:
            return F.coalesce(o, n)
        if c in prefer_new:
            return F.coalesce(n, o)
        return F.when(F.col("_new").isNotNull(), n).otherwise(o)

    return joined.select(*keys, *[pick(c).alias(c) for c in rest]).select(*cols)


def merge_hotels(old: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-01: everything is overwritten but picture and kind, which survive a NULL; rows without id or name are dropped."""
    return coalesce_merge(old, valid_keys(new, ["id", "name"]), ["id"], prefer_new=["image_url", "accommodation_type"])


def merge_events(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """SNK-04: new non-NULL values win, the id of the first insert survives."""
    return coalesce_merge(old, new, ["source_id", "date_start", "title"], keep_old=["event_id"], order=order)


def current_forecasts(forecasts: DataFrame) -> DataFrame:
    """SNK-05: the latest origin per district, date and model."""
    return latest_version(forecasts, ["district", "forecast_date", "model"], ["origin_date"])


def delete_matching(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """SNK-06: (remaining rows, one-row count of the removed)."""
    removed = table.join(keys.select(*on).distinct(), list(on), "left_semi").agg(F.count("*").alias("removed"))
    return table.join(keys.select(*on).distinct(), list(on), "left_anti"), removed


def patch(table: DataFrame, patches: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """SNK-07: only given values change; blank text is not a value, zero is."""
    p = patches.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_p_{c}") for c in columns])
    joined = table.join(p, F.col(key) == F.col("_k"), "left")

    def value(c: str) -> Column:
        given = F.col(f"_p_{c}")
        if dict(table.dtypes)[c] == "string":
            given = F.nullif(given, F.lit(""))
        return F.coalesce(given, F.col(c)).alias(c)

    return joined.select(*[value(c) if c in columns else F.col(c) for c in table.columns])


def relabel(events: DataFrame, label: Column) -> DataFrame:
    """SNK-11: rows of the catch-all type take the classifier's label unless that is the catch-all too."""
    hit = (F.col("event_type") == "event") & (label != "event")
    return events.withColumn("event_type", F.when(hit, label).otherwise(F.col("event_type")))


MOST_NAMED = 1000
PIECE = 500_000  # rows of a partition that one task brings together


@dataclass(frozen=True)
class KeyedTable:
    """A Parquet table merged by key, partitioned by an expression of its key.

    A merge reads the partitions that the changes fall into, merges them, and replaces exactly those (dynamic partition
    overwrite). Running the same merge again gives the same table, so a retry after a lost job is safe."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    partition: str  # column name of the partition
    expression: str  # SQL text that gives the partition value from a row

    def read(self, schema: str) -> DataFrame:
        try:
            return self.spark.read.parquet(self.path)
        except Exception as error:  # a table that does not exist yet is empty
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema).withColumn(self.partition, F.expr(self.expression))

    def merge(self, changes: DataFrame, schema: str, how) -> None:
        """`how(old, new)` returns the merged rows. The changes are evaluated once, and of the table only the partitions they fall into are listed and read.
        A partition is written by one task, or by several where it is large, so that its files follow its size and not the number of tasks."""
        new, old, _ = self.sides(changes, schema)
        merged = how(old.drop(self.partition), new.drop(self.partition)).withColumn(self.partition, F.expr(self.expression))
        self.replace(merged.hint("rebalance", self.partition))

    def merge_latest(self, changes: DataFrame, schema: str, order: str) -> None:
        """`merge` where of a key's rows, stored and new, the one that sorts last by `order` stays. Rows meet by partition and a piece of the key's hash, as many
        pieces as the largest partition has times `PIECE` rows: one shuffle and one sort choose the rows and leave them as they are written."""
        new, old, largest = self.sides(changes, schema)
        both = old.select(*new.columns).unionByName(new).withColumn("_piece", F.pmod(F.xxhash64(*self.keys), F.lit(-(-largest // PIECE) or 1)))
        keys = [self.partition, *self.keys, "_piece"]
        self.replace(latest_version(both.repartition(self.partition, "_piece"), keys, [order]).drop("_piece"))

    def sides(self, changes: DataFrame, schema: str) -> tuple[DataFrame, DataFrame, int]:
        """The changes, stored once; the partitions of the table that they fall into; at least the number of rows that one partition has of both."""
        new = stored(changes.withColumn(self.partition, F.expr(self.expression)))
        touched = new.groupBy(self.partition).agg(F.count("*").alias("n"))
        named = touched.limit(MOST_NAMED + 1).collect()
        old = self.read(schema)
        old = old.withColumn(self.partition, F.col(self.partition).cast(new.schema[self.partition].dataType))
        if len(named) <= MOST_NAMED:  # as literals they prune the listing
            old = old.filter(F.col(self.partition).isin([r[0] for r in named if r[0] is not None]) | (F.col(self.partition).isNull() & F.lit(None in [r[0] for r in named])))
        else:
            old = old.join(touched.select(self.partition), self.partition, "left_semi")
        most = [df.agg(F.max("n")).first()[0] or 0 for df in (touched, old.groupBy(self.partition).agg(F.count("*").alias("n")))]
        return new, old, sum(most)

    def replace(self, rows: DataFrame) -> None:
        """Write whole partitions in place of the stored ones."""
        (
            rows.sortWithinPartitions(self.partition, *self.keys)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(self.partition)
            .parquet(self.path)
        )


def hotels_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, ("id",), "bucket", "pmod(hash(id), 64)")


def statistics_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, ("id", "date"), "month", "date_format(date, 'yyyy-MM')")


def events_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, ("source_id", "date_start", "title"), "month", "date_format(date_start, 'yyyy-MM')")


def write_csv(rows: DataFrame, path: str) -> None:
    """SNK-08 / SNK-09: CSV parts with a header each. Spreadsheet byte-order marks belong to the download, not here."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """SNK-10."""
    rows.write.mode("overwrite").json(path)


def export_occupancy(
    stats: DataFrame, hotels: DataFrame, district: str | None = None, date_from: Column | None = None, date_to: Column | None = None, limit: int | None = None
) -> DataFrame:
    """SNK-08, occupancy: fixed columns, NULL as zero or blank. A caller may name a district and days, and take the newest rows."""
    zero, blank = F.lit(0), F.lit("")
    reg = hotels.select("id", F.col("name").alias("hotel_name"), "district", "city")
    if district is not None:
        reg = reg.filter(F.col("district") == district)
    if date_from is not None:
        stats = stats.filter(F.col("date") >= date_from)
    if date_to is not None:
        stats = stats.filter(F.col("date") <= date_to)
    rows = stats.join(reg, "id")
    if limit is not None:
        rows = rows.orderBy(F.desc("date"), "id").limit(limit)
    return rows.select(
        "date", F.col("id").alias("hotel_id"), F.coalesce("hotel_name", blank).alias("hotel_name"),
        F.coalesce("district", blank).alias("district"), F.coalesce("city", blank).alias("city"),
        F.coalesce("rooms_num", zero).alias("rooms_num"), F.coalesce("free_rooms_amount", zero).alias("free_rooms_amount"),
        F.coalesce("available_rooms_percent", F.lit(0.0)).alias("available_rooms_percent"),
        F.coalesce("min_price", zero).alias("min_price"),
    )


def export_events(events: DataFrame) -> DataFrame:
    """SNK-08, events."""
    blank = F.lit("")
    return events.select(
        "event_id", "title", "date_start", F.coalesce(F.col("date_end").cast("string"), blank).alias("date_end"),
        F.coalesce("event_type", blank).alias("event_type"), F.coalesce("location", blank).alias("location"),
        F.col("source_id").alias("source"),
    )


def export_hotels(hotels: DataFrame) -> DataFrame:
    """SNK-08, hotels."""
    blank, zero = F.lit(""), F.lit(0)
    return hotels.select(
        "id", "name", F.coalesce("city", blank).alias("city"), F.coalesce("district", blank).alias("district"), "lat", "lon",
        F.coalesce("rating", F.lit(0.0)).alias("rating"), F.coalesce("min_price", zero).alias("min_price"),
        F.coalesce("accommodation_type", blank).alias("accommodation_type"),
    )


def panel_dump(panel: DataFrame, event_days: DataFrame) -> DataFrame:
    """SNK-09: the panel with a per-row event flag."""
    flags = event_days.select("district", "date", F.lit(1).alias("_e"))
    return panel.join(flags, ["district", "date"], "left").select(
        "district", "date", "occupancy", F.coalesce("_e", F.lit(0)).alias("is_event")
    )


def normalise_import(raw: DataFrame, hotels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-12 / JN-02: typed rows of known hotels, plus (rows of unknown hotels, rows that do not parse)."""
    from staylens.functions import dates as D
    from staylens.functions import metrics as X

    typed = raw.select(
        F.col("id").cast("string").alias("id"), D.coerce_date("date_raw").alias("date"),
        F.col("rooms_raw").try_cast("int").alias("rooms_num"), F.col("free_raw").try_cast("int").alias("free_rooms_amount"),
        F.when(F.col("pct_raw").try_cast("double").isNotNull(), X.clip(F.col("pct_raw").try_cast("double"), 0.0, 100.0)).alias(
            "available_rooms_percent"),
        F.col("price_raw").try_cast("int").alias("min_price"),
    )
    ids = hotels.select("id")
    unknown = typed.filter(F.coalesce("id", F.lit("")) != "").join(ids, "id", "left_anti")
    known = typed.join(ids, "id", "left_semi")
    invalid = known.filter(F.col("date").isNull())
    return known.filter(F.col("date").isNotNull()), unknown, invalid
