"""Event calendar: scans, geography, day expansion, deduplication of listings from many sources.

First-wins and best-wins choices are min_by / max_by aggregates, which combine inside the scan tasks; a group that holds
a large share of all copies therefore sends one candidate per task instead of all its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from staylens.functions import text as S

EVENT_COLUMNS = (
    "event_id", "title", "description", "date_start", "date_end", "event_type", "location", "source_id", "url",
    "time_start", "price_min", "price_max", "image_url", "address", "age_restriction",
)
COMPLETENESS = ("description", "image_url", "address", "time_start", "price_min", "url")


def contains_ci(c: str | Column, needle: str) -> Column:
    """FLT-05: case-insensitive substring; wildcards in the needle are ordinary characters."""
    return F.contains(F.lower(F.col(c) if isinstance(c, str) else c), F.lit(needle.lower()))


def scan(
    events: DataFrame, date_from: Column | None = None, date_to: Column | None = None, source: str | None = None,
    city: str | None = None,
) -> DataFrame:
    """SRC-05, filters: all optional, all pushed to the scan where the storage allows."""
    out = events
    if date_from is not None:
        out = out.filter(F.col("date_start") >= date_from)
    if date_to is not None:
        out = out.filter(F.col("date_start") <= date_to)
    if source is not None:
        out = out.filter(F.col("source_id") == source)
    if city is not None:
        out = out.filter(contains_ci("location", city))
    return out


def nearest_first(events: DataFrame, today: Column, limit: int, skip: int = 0, shown: int | None = None) -> DataFrame:
    """ST-01 / SRC-05: nearest to today first, ties by id; the page is taken with a distributed top-k. `shown` cuts
    descriptions for a display."""
    out = events.withColumn("_d", F.abs(F.datediff("date_start", today))).orderBy("_d", "event_id")
    if skip:
        out = out.offset(skip)
    out = out.limit(limit).drop("_d")
    return out if shown is None else out.withColumn("description", F.left("description", F.lit(shown)))


def upcoming(events: DataFrame, today: Column, date_from: Column | None = None) -> DataFrame:
    """FLT-06: future events unless the caller names a start."""
    start = today if date_from is None else F.coalesce(date_from, today)
    return events.filter(F.col("date_start") >= start)


def gazetteer_array(places: DataFrame) -> Column:
    """(city, district) pairs as one array value, ordered by rank. The gazetteer is a reference table of settlements,
    tens of rows; `rank` keeps the priority of the first match."""
    pairs = places.select("rank", F.lower("city").alias("city"), "district")
    packed = F.array_sort(F.collect_list(F.struct("rank", "city", "district")))
    return pairs.agg(packed).scalar()


def place_text(location: str = "location", address: str = "address") -> Column:
    blank = F.lit("")
    return F.lower(F.concat_ws(" ", F.coalesce(F.col(location), blank), F.coalesce(F.col(address), blank)))


def with_district(events: DataFrame, places: DataFrame, default: str) -> DataFrame:
    """JN-06: adds the district of the first gazetteer entry that the location or address contains. The gazetteer is a
    constant inside the expression: the events are neither joined nor shuffled."""
    text = F.col("_place")
    hit = F.filter(F.col("_gazetteer"), lambda p: F.contains(text, p["city"]))
    marked = events.withColumn("_gazetteer", gazetteer_array(places)).withColumn("_place", place_text())
    found = F.try_element_at(hit, F.lit(1))["district"]
    return marked.withColumn("district", F.coalesce(found, F.lit(default))).drop("_gazetteer", "_place")


def by_district(events: DataFrame, places: DataFrame) -> DataFrame:
    """JN-05: each event with every district that its location or address names, by the district's own name or one of
    its cities; events with neither belong to all districts and are flagged as not inferred.

    The gazetteer travels inside the expression, so the events are neither shuffled nor joined."""
    names = places.select("district", F.lower("city").alias("p")).union(
        places.select("district", F.lower("district").alias("p"))
    ).distinct()
    packed = names.groupBy("district").agg(F.array_sort(F.collect_set("p")).alias("patterns"))
    districts = packed.agg(F.array_sort(F.collect_list(F.struct("district", "patterns")))).scalar()
    loc = F.lower(F.coalesce("location", F.lit("")))
    addr = F.lower(F.coalesce("address", F.lit("")))
    nowhere = F.col("location").isNull() & F.col("address").isNull()
    rows = events.withColumn("_loc", loc).withColumn("_addr", addr).withColumn("_nowhere", nowhere)
    rows = rows.withColumn("_districts", districts)
    hits = F.filter(
        F.col("_districts"),
        lambda d: F.col("_nowhere")
        | F.exists(d["patterns"], lambda p: F.contains(F.col("_loc"), p) | F.contains(F.col("_addr"), p)),
    )
    return (
        rows.select(*EVENT_COLUMNS, "_nowhere", F.explode(F.transform(hits, lambda d: d["district"])).alias("district"))
        .withColumn("geo_inferred", ~F.col("_nowhere"))
        .drop("_nowhere")
    )


def nearest_per_district(assigned: DataFrame, today: Column, limit: int) -> DataFrame:
    """JN-05 with its limit: the nearest events of each district. The rank filter lets Spark cut each task's rows to
    `limit` per district before the shuffle."""
    w = W.partitionBy("district").orderBy(F.abs(F.datediff("date_start", today)), "event_id")
    return assigned.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def event_days(events: DataFrame, district: Column) -> DataFrame:
    """JN-07: one row per district and day covered by any event."""
    end = F.greatest(F.coalesce("date_end", "date_start"), F.col("date_start"))
    return events.filter(F.col("date_start").isNotNull()).select(
        district.alias("district"), F.explode(F.sequence(F.col("date_start"), end)).alias("date")
    ).distinct()


def keep_first(rows: DataFrame, keys: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """SO-02 / SO-03: first row per key in an explicit order."""
    named = [(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]
    first = F.min_by(F.struct(*[F.col(c) for c in rows.columns]), F.struct(*order)).alias("_row")
    return rows.groupBy(*named).agg(first).select("_row.*")


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """SO-01: sources in fixed order, empty titles dropped, the first source keeps a (title, date)."""
    ranked = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(sources)]
    rows = ranked[0]
    for df in ranked[1:]:
        rows = rows.unionByName(df, allowMissingColumns=True)
    rows = rows.filter(F.trim("title") != "")
    return keep_first(rows, [F.lower(F.trim("title")), "date_start"], ["source_rank", "event_id"])


def completeness(cols: Sequence[str] = COMPLETENESS) -> Column:
    """Number of filled fields: neither NULL, nor blank, nor zero."""
    filled = None
    for c in cols:
        one = F.when(F.col(c).isNotNull() & ~F.col(c).cast("string").isin("", "0"), 1).otherwise(0)
        filled = one if filled is None else filled + one
    return filled


def merge_groups(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The most complete row of each group, ties by id, with the other sources in sorted `also_at`.

    Sources are reduced to the distinct ones per group, a handful of names, before they are put into a list."""
    cols = [F.col(c) for c in EVENT_COLUMNS]
    seen = [F.col("also_at")] if "also_at" in rows.columns else [F.array().cast("array<string>")]
    picked = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*cols), F.struct(-completeness(), F.col("event_id"))).alias("_best"),
        F.array_distinct(F.flatten(F.collect_set(F.array_union(F.array("source_id"), *seen)))).alias("_sources"),
    )
    others = F.filter(F.col("_sources"), lambda s: s.isNotNull() & (s != "") & (s != F.col("_best.source_id")))
    return picked.select(*keys, "_best.*", F.array_sort(others).alias("also_at"))


def exact_dedup(events: DataFrame, district: Column) -> DataFrame:
    """SO-04: one row per (title key, start date, district). A row without a usable title is a group of its own, so one
    aggregate over one scan serves both."""
    keyed = events.withColumn("title_key", S.title_key("title")).withColumn("district", district)
    alone = F.when(F.coalesce("title_key", F.lit("")) == "", F.col("event_id"))
    return merged_columns(merge_groups(keyed.withColumn("_alone", alone), ["title_key", "date_start", "district", "_alone"]))


def merged_columns(merged: DataFrame) -> DataFrame:
    """Group keys repeat columns of the chosen row; keep one of each."""
    rest = [c for c in EVENT_COLUMNS if c != "date_start"]
    keys = merged.columns[: merged.columns.index("event_id")]
    flat = merged.toDF(*[f"_{i}" for i in range(len(merged.columns))])
    at = lambda name, start=0: F.col(f"_{merged.columns.index(name, start)}")
    first = len(keys)
    return flat.select(
        at("district").alias("district"), at("title_key").alias("title_key"), at("date_start").alias("date_start"),
        *[at(c, first).alias(c) for c in rest], at("also_at").alias("also_at"),
    ).select("district", "title_key", *EVENT_COLUMNS, "also_at")


def token_search(events: DataFrame, query: str) -> DataFrame:
    """FLT-11: any token longer than three characters, by its first five; everything when nothing matches."""
    tokens = [t[:5] for t in query.lower().split() if len(t) > 3]
    if not tokens:
        return events
    text = F.lower(F.concat_ws(" ", "title", "event_type", "location"))
    hit = None
    for t in tokens:
        one = F.contains(text, F.lit(t))
        hit = one if hit is None else hit | one
    flagged = events.withColumn("_hit", hit)
    found = flagged.agg(F.coalesce(F.max(F.col("_hit").cast("int")), F.lit(0))).scalar()
    return flagged.filter(F.col("_hit") | (found == 0)).drop("_hit")


def cascade_search(hotels: DataFrame, city: str, district: str, limit: int) -> DataFrame:
    """FLT-12: hotels of the city, else of its district, else all; first rows by id."""
    level = F.when(F.col("city") == city, 1).when(F.col("district") == district, 2).otherwise(3)
    best = hotels.agg(F.min(level)).scalar()
    # a row of level 1 also belongs to the wider levels
    keep = F.when(best == 1, F.col("city") == city).when(best == 2, F.col("district") == district).otherwise(True)
    return hotels.filter(keep).orderBy("id").limit(limit)


def explorer(
    events: DataFrame, month_from: Column, month_to: Column, kinds: Sequence[str], sources: Sequence[str], needle: str
) -> DataFrame:
    """FLT-10."""
    text = contains_ci("title", needle) | contains_ci(F.coalesce("location", F.lit("")), needle) | contains_ci(
        F.coalesce("description", F.lit("")), needle)
    return events.filter(
        F.col("date_start").between(month_from, month_to) & F.col("event_type").isin(list(kinds))
        & F.col("source_id").isin(list(sources)) & text
    )


def not_past(docs: DataFrame, kind: str, day: str, today: Column) -> DataFrame:
    """FLT-09: other documents and undated events stay, past events go."""
    return docs.filter((F.col(kind) != "event") | F.col(day).isNull() | (F.col(day) >= today))


def to_event_rows(raw: DataFrame) -> DataFrame:
    """FLT-14: raw listings to typed event rows; a row without id or date is dropped."""
    from staylens.functions import dates as D

    return raw.select(
        "event_id", F.coalesce("title", F.lit("")).alias("title"), D.coerce_date("date_raw").alias("date_start"),
        S.clean_location("place").alias("location"), D.clock_time("time_text").alias("time_start"), "source_id",
    ).filter(F.col("event_id").isNotNull() & (F.col("event_id") != "") & F.col("date_start").isNotNull())


def source_counts(events: DataFrame, column: str) -> DataFrame:
    """AG-29 / AG-36."""
    return events.groupBy(column).agg(F.count("*").alias("n"))


def month_calendar(events: DataFrame, month_start: Column) -> DataFrame:
    """AG-29: the 42 cells of a month view, Monday first, with the number of events that start on each day."""
    spark = events.sparkSession
    first = F.date_sub(month_start, F.weekday(month_start))
    cells = spark.range(42).select(F.date_add(first, F.col("id").cast("int")).alias("date"))
    counts = events.filter(F.col("date_start").between(first, F.date_add(first, 41))).groupBy(
        F.col("date_start").alias("date")
    ).agg(F.count("*").alias("n"))
    return cells.join(counts, "date", "left").select(
        "date", F.coalesce("n", F.lit(0)).alias("events"), (F.trunc("date", "month") == month_start).alias("in_month")
    )


def nearby_counts(days: DataFrame, events: DataFrame, before: int = 3, after: int = 7) -> DataFrame:
    """JN-13: events in [-before, +after] days of each date. Daily counts first; a day's count then goes to the
    dates that have it in reach, so one row per day is copied and no event."""
    daily = events.groupBy(F.col("date_start").alias("date")).agg(F.count("*").alias("n"))
    reach = daily.select("date", "n", F.explode(F.sequence(F.lit(-after), F.lit(before))).alias("off"))
    counted = reach.groupBy(F.date_add("date", F.col("off")).alias("date")).agg(
        F.sum("n").alias("nearby"), F.sum(F.when(F.col("off") == 0, F.col("n"))).alias("on_day"))
    return days.select("date").distinct().join(counted, "date", "left").select("date", F.coalesce("on_day", F.lit(0)).alias("on_day"), F.coalesce("nearby", F.lit(0)).alias("nearby"))


def run_summary(runs: DataFrame, now: Column, stale_hours: int = 24) -> DataFrame:
    """AG-30: state of the sources by their last run. One row per source is kept before the lists are built."""
    last = runs.groupBy("source").agg(F.max_by(F.struct("status", "items", "run_ts"), F.col("run_ts")).alias("r")).select("source", "r.*")
    stale = F.unix_timestamp(now) - F.unix_timestamp("run_ts") > stale_hours * 3600
    names = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("source")))), ",")
    ok = F.col("status") == "ok"
    return last.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(F.col("status") == "warn").alias("warn"),
        F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(stale).alias("stale"),
        F.count_if(ok & (F.col("items") == 0)).alias("empty"),
        names(F.col("status") == "fail").alias("failed_sources"), names(stale).alias("stale_sources"),
    )
