"""Aggregations over the hotel-day facts: district series, snapshots, segments, prices, seasonality.

Facts are reduced by (district, date), (hotel) or (segment) with map-side partial aggregation before anything else
touches them, so one district holding most of the rows still spreads over all scan tasks. Whether the
hotel registry is broadcast is left to Spark, which knows its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from staylens import model as M
from staylens.functions import metrics as X


def latest_date(stats: DataFrame) -> Column:
    return stats.select(F.max("date")).scalar()


def with_hotel(stats: DataFrame, hotels: DataFrame, *cols: str) -> DataFrame:
    """JN-01: facts joined to the registry columns that are asked for."""
    return stats.join(hotels.select("id", *cols), "id")


def daily_series(stats: DataFrame, hotels: DataFrame) -> DataFrame:
    """AG-02: per district and day occupancy, median price, rooms and capacity of objects with rooms."""
    return (
        with_hotel(stats.filter(F.col("rooms_num") > 0), hotels, "district")
        .groupBy("district", "date")
        .agg(
            X.weighted_occupancy().alias("avg_occupancy"),
            X.median_price().alias("avg_price"),
            F.sum("rooms_num").alias("total_rooms"),
            F.sum("max_capacity").alias("total_capacity"),
        )
        .filter(F.col("avg_occupancy").isNotNull())
    )


def monthly_statistics(stats: DataFrame, year: int | None = None) -> DataFrame:
    """AG-03."""
    rows = stats.filter(F.col("date").isNotNull() & (F.col("rooms_num") > 0))
    if year is not None:
        rows = rows.filter(F.col("date").between(f"{year}-01-01", f"{year}-12-31"))
    return rows.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        X.weighted_occupancy().alias("avg_occupancy"),
        X.median_price().alias("avg_price"),
        F.sum("rooms_num").alias("total_rooms"),
        F.sum("free_rooms_amount").alias("free_rooms"),
        F.count("*").alias("records_count"),
        F.count_distinct("date").alias("days_count"),
    )


def events_by_month(events: DataFrame, year: int | None = None) -> DataFrame:
    """AG-04."""
    rows = events.filter(F.col("date_start").isNotNull())
    if year is not None:
        rows = rows.filter(F.col("date_start").between(f"{year}-01-01", f"{year}-12-31"))
    return rows.groupBy(F.year("date_start").alias("year"), F.month("date_start").alias("month")).agg(
        F.count("*").alias("events_count")
    )


def total_metrics(stats: DataFrame, hotels: DataFrame, events: DataFrame, latest: Column) -> DataFrame:
    """AG-05: one row; the counts are scalar subqueries next to the aggregate over the latest date."""
    snap = stats.filter(F.col("date") == latest).agg(
        F.coalesce(F.sum("rooms_num"), F.lit(0)).alias("total_rooms"),
        F.coalesce(F.sum("free_rooms_amount"), F.lit(0)).alias("free_rooms"),
        F.coalesce(X.weighted_occupancy(), F.lit(0.0)).alias("avg_occupancy"),
        F.max("date").alias("as_of_date"),
    )
    return snap.select(
        hotels.agg(F.count("*")).scalar().alias("total_hotels"),
        hotels.agg(F.count_distinct("city")).scalar().alias("total_cities"),
        events.agg(F.count("*")).scalar().alias("total_events"),
        "total_rooms", "free_rooms", "avg_occupancy", "as_of_date",
    )


def _district_aggregates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(
        X.weighted_occupancy().alias("avg_occupancy"),
        F.sum("free_rooms_amount").alias("free_rooms"),
        F.sum("rooms_num").alias("total_rooms"),
        X.median_price().alias("median_price"),
        F.max("date").alias("as_of_date"),
        F.count_distinct("id").alias("hotels_count"),
    )


def district_snapshot(stats: DataFrame, hotels: DataFrame, latest: Column, key: str = "district") -> DataFrame:
    """AG-06: aggregates of the latest global date. `key` may be any registry column (district, city)."""
    return _district_aggregates(with_hotel(stats.filter(F.col("date") == latest), hotels, key), key)


def district_period(
    stats: DataFrame, hotels: DataFrame, date_from: Column, date_to: Column, key: str = "district"
) -> DataFrame:
    """AG-07: aggregates of a period; rooms are per observation day, so a longer window does not multiply the stock.

    Days are counted as a set, which is bounded by the length of the period; a second distinct count next to the one of
    the hotels would copy every fact."""
    rows = with_hotel(stats.filter(F.col("date").between(date_from, date_to)), hotels, key)
    days = F.nullif(F.size(F.collect_set("date")), F.lit(0))
    return rows.groupBy(key).agg(
        X.weighted_occupancy().alias("avg_occupancy"),
        (F.sum("free_rooms_amount").cast("double") / days).alias("free_rooms"),
        (F.sum("rooms_num").cast("double") / days).alias("total_rooms"),
        X.median_price().alias("median_price"),
        F.count_distinct("id").alias("hotels_count"),
    )


def hotels_by_city(hotels: DataFrame) -> DataFrame:
    """AG-08."""
    return hotels.groupBy("city").agg(F.count("*").alias("hotels_count"))


def hotels_by_district(hotels: DataFrame) -> DataFrame:
    """AG-09."""
    return hotels.groupBy("district").agg(F.count("*").alias("hotels_count"), F.avg("rating").alias("avg_rating"))


def hotels_by_district_with_prices(hotels: DataFrame, snapshot: DataFrame, districts: Sequence[str]) -> DataFrame:
    """JN-04 with the FLT-01 whitelist."""
    counts = hotels_by_district(hotels.filter(F.col("district").isin(list(districts))))
    return counts.join(snapshot.select("district", "median_price"), "district", "left").select(
        "district", F.col("hotels_count").alias("count"), "median_price", "avg_rating"
    )


def weekday_heatmap(stats: DataFrame, hotels: DataFrame, by_district: bool = False) -> DataFrame:
    """AG-10: ISO weekday by month over rows with known availability, with the shared colour position 0..1.

    The scale window runs over at most 84 cells per district."""
    rows = stats.filter(F.col("available_rooms_percent").isNotNull())
    keys = ["district"] if by_district else []
    rows = with_hotel(rows, hotels, *keys)
    cells = rows.groupBy(
        *keys, F.extract(F.lit("DAYOFWEEK_ISO"), F.col("date")).alias("weekday"), F.month("date").alias("month")
    ).agg(X.weighted_occupancy().alias("occupancy"), F.count("*").alias("samples"))
    seen = F.when((F.col("samples") >= 5) & (F.col("occupancy") > 0), F.col("occupancy"))
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    low, high = F.coalesce(F.min(seen).over(w), F.lit(0.0)), F.coalesce(F.max(seen).over(w), F.lit(100.0))
    span = F.greatest(high - low, F.lit(1.0))
    return cells.withColumn("scale", X.clip((F.col("occupancy") - low) / span, 0.0, 1.0))


def daily_rooms(stats: DataFrame, hotels: DataFrame, since: Column, by: Sequence[str] = ()) -> DataFrame:
    """AG-11: rooms, free rooms and objects per day."""
    return (
        with_hotel(stats.filter(F.col("date") >= since), hotels, *by)
        .groupBy(*by, "date")
        .agg(
            F.coalesce(F.sum("rooms_num"), F.lit(0)).alias("total_rooms"),
            F.coalesce(F.sum("free_rooms_amount"), F.lit(0)).alias("free_rooms"),
            F.count_distinct("id").alias("hotels_count"),
        )
    )


SNAPSHOT_COLUMNS = ("rooms_num", "free_rooms_amount", "available_rooms_percent", "min_price", "max_capacity")


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """WN-01: the row with the greatest `order` per key. max_by combines map-side, so a hot key sends one row per task
    instead of all its rows, which a row_number window would."""
    best = F.max_by(F.struct(*cols), F.col(order)).alias("_best")
    return rows.groupBy(*keys).agg(best, F.max(order).alias(order)).select(*keys, order, "_best.*")


def recent_snapshots(stats: DataFrame, latest: Column, window_days: int = M.SEGMENT_WINDOW_DAYS) -> DataFrame:
    rows = stats.filter(F.col("date") >= F.date_sub(latest, window_days))
    return latest_per_key(rows, ["id"], "date", SNAPSHOT_COLUMNS)


def segments_by_size(stats: DataFrame, latest: Column) -> DataFrame:
    """AG-12: prices include zeros here, as the original report does."""
    rows = recent_snapshots(stats, latest).filter(F.col("rooms_num").isNotNull())
    return rows.groupBy(X.size_bucket().alias("size_bucket")).agg(
        F.count("*").alias("count"),
        X.weighted_occupancy().alias("avg_occupancy"),
        F.avg("min_price").alias("avg_price"),
    )


def segments_by_type(hotels: DataFrame) -> DataFrame:
    """AG-13."""
    return hotels.groupBy(F.coalesce("accommodation_type", F.lit("unknown")).alias("type")).agg(
        F.count("*").alias("count"), F.avg("min_price").alias("avg_price")
    )


def district_breakdown(stats: DataFrame, hotels: DataFrame, latest: Column) -> DataFrame:
    """AG-14: per district the split by size, the split by type and the total (objects with a known room count only),
    from one pass over the latest snapshots with grouping sets."""
    rows = with_hotel(recent_snapshots(stats, latest), hotels, "district", "accommodation_type").select(
        "district", "rooms_num", "available_rooms_percent",
        F.when(F.col("min_price") != 0, F.col("min_price")).alias("min_price"),
        X.size_bucket().alias("size"),
        F.coalesce("accommodation_type", F.lit("не указан")).alias("type"),
    )
    d, s, t = F.col("district"), F.col("size"), F.col("type")
    sets = rows.groupingSets([[d, s], [d, t], [d]], d, s, t).agg(
        F.grouping_id().alias("_gid"),
        F.count("*").alias("_rows"),
        F.count("rooms_num").alias("_sized"),
        X.weighted_occupancy().alias("avg_occupancy"),
        F.avg("min_price").alias("avg_min_price"),
    )
    split = F.when(F.col("_gid") == 1, "size").when(F.col("_gid") == 2, "type").otherwise("total")
    return (
        sets.filter(~((F.col("_gid") == 1) & F.col("size").isNull()))
        .select(
            "district",
            split.alias("split"),
            F.coalesce("size", "type", F.lit("all")).alias("segment"),
            F.when(F.col("_gid") == 3, F.col("_sized")).otherwise(F.col("_rows")).alias("count"),
            "avg_occupancy",
            "avg_min_price",
        )
        .withColumn(
            "revpar",
            F.when(
                (F.col("avg_min_price") != 0) & (F.col("avg_occupancy") != 0),
                X.revpar(F.col("avg_min_price"), F.col("avg_occupancy")),
            ),
        )
    )


def segment_benchmark(stats: DataFrame, hotels: DataFrame, latest: Column) -> DataFrame:
    """AG-15 and SC-50 for every hotel at once: own latest row against its district-and-size peers, itself excluded.

    The size filter applies before the latest row of a peer is chosen, so a hotel that changed size can be a peer in two
    segments. Peers are never paired up: segment sums minus the own contribution give the leave-one-out average."""
    recent = stats.filter(
        (F.col("date") >= F.date_sub(latest, M.SEGMENT_WINDOW_DAYS)) & F.col("rooms_num").between(0, 10000)
    ).withColumn("size_bucket", X.size_bucket())
    peers = with_hotel(
        latest_per_key(recent, ["id", "size_bucket"], "date", ("rooms_num", "available_rooms_percent", "min_price")),
        hotels.filter(F.col("district").isNotNull()), "district",
    ).select(
        "id", "district", "size_bucket", F.col("rooms_num").alias("_rooms"),
        (
            F.col("rooms_num") * (100.0 - X.clip(F.coalesce("available_rooms_percent", F.lit(0.0)), 0.0, 100.0))
        ).alias("_busy"),
        F.col("min_price").alias("_price"),
    )
    sums = peers.groupBy("district", "size_bucket").agg(
        F.count("*").alias("s_n"), F.sum("_rooms").alias("s_rooms"), F.sum("_busy").alias("s_busy"),
        F.count("_price").alias("s_priced"), F.sum("_price").alias("s_price"),
    )
    own = latest_per_key(stats, ["id"], "date", SNAPSHOT_COLUMNS)
    rooms = F.coalesce("rooms_num", F.lit(0))
    target = hotels.select("id", "district").join(own, "id", "left").select(
        "id", "district", "date", "min_price", X.own_occupancy().alias("occupancy"),
        F.when((rooms > 0) & (rooms <= 15), "mini").when((rooms > 0) & (rooms <= 50), "mid").otherwise("large").alias(
            "size_bucket"
        ),
    )
    mine = peers.drop("district")
    joined = target.join(sums, ["district", "size_bucket"], "left").join(mine, ["id", "size_bucket"], "left")
    n = F.coalesce(F.col("s_n"), F.lit(0)) - F.when(F.col("_rooms").isNotNull(), 1).otherwise(0)
    den = F.col("s_rooms") - F.coalesce("_rooms", F.lit(0))
    priced = F.col("s_priced") - F.when(F.col("_price").isNotNull(), 1).otherwise(0)
    out = joined.select(
        "id", "district", "size_bucket", "occupancy", "min_price", F.col("date").alias("as_of"),
        n.cast("bigint").alias("n"),
        F.when(n > 0, X.ratio(F.col("s_busy") - F.coalesce("_busy", F.lit(0.0)), den)).alias("seg_occupancy"),
        F.when(n > 0, X.ratio((F.col("s_price") - F.coalesce("_price", F.lit(0))).cast("double"), priced)).alias(
            "seg_price"
        ),
    )
    return out.select(
        "*",
        (F.col("occupancy") - F.col("seg_occupancy")).alias("occupancy_delta"),
        (F.col("min_price") - F.col("seg_price")).alias("price_delta"),
        (F.datediff(latest, F.col("as_of")) > 2).alias("is_stale"),
    )


def price_percentiles(stats: DataFrame, hotels: DataFrame, since: Column, approx: bool = False) -> DataFrame:
    """AG-16: interpolated percentiles of positive prices. The exact buffer counts distinct integer prices; `approx`
    switches to the mergeable sketch when even those are too many."""
    rows = with_hotel(stats.filter((F.col("date") >= since) & (F.col("min_price") > 0)), hotels, "district")
    points = (10, 25, 50, 75, 90)
    if approx:
        marks = F.percentile_approx("min_price", [p / 100 for p in points], 10000)
    else:
        marks = F.percentile("min_price", F.array(*[F.lit(p / 100) for p in points]))
    agg = rows.groupBy("district").agg(F.count("*").alias("samples"), marks.alias("_p"))
    return agg.select("district", "samples", *[F.col("_p")[i].cast("double").alias(f"p{p}") for i, p in enumerate(points)])


def compare_districts(series: DataFrame, percentiles: DataFrame, since: Column, districts: Sequence[str]) -> DataFrame:
    """AG-17: unweighted mean of daily occupancy next to the pooled median price."""
    occ = (
        series.filter((F.col("date") >= since) & F.col("district").isin(list(districts)))
        .groupBy("district")
        .agg(F.avg("avg_occupancy").alias("occupancy"), F.count("*").alias("samples"))
    )
    price = percentiles.select("district", F.col("p50").alias("adr_proxy"))
    return occ.join(price, "district", "left").withColumn("revpar_proxy", X.revpar(F.col("adr_proxy"), F.col("occupancy")))


def revenue_by_district(snapshot: DataFrame, districts: Sequence[str]) -> DataFrame:
    """AG-18, first level."""
    occ, adr = F.coalesce("avg_occupancy", F.lit(0.0)), F.coalesce("median_price", F.lit(0.0))
    return snapshot.filter(F.col("district").isin(list(districts))).select(
        "district", occ.alias("occupancy"), adr.alias("adr"), X.revpar(adr, occ).alias("revpar"), "hotels_count",
        X.confidence(F.col("hotels_count"), medium=3).alias("confidence"),
        F.coalesce("total_rooms", F.lit(0)).alias("total_rooms"), "as_of_date",
    )


def revenue_total(by_district: DataFrame) -> DataFrame:
    """AG-18, second level: weighted by rooms; a district without a price still weighs in."""
    rooms = F.when(F.col("total_rooms") > 0, F.col("total_rooms")).otherwise(0)
    agg = by_district.agg(
        X.ratio(F.sum(F.col("occupancy") * rooms), F.sum(rooms)).alias("occupancy"),
        X.ratio(F.sum(F.col("adr") * rooms), F.sum(rooms)).alias("adr"),
        F.max("as_of_date").alias("as_of_date"),
    )
    return agg.withColumn("revpar", X.revpar(F.col("adr"), F.col("occupancy")))


def kpi(totals: DataFrame, snapshot: DataFrame, today: Column) -> DataFrame:
    """AG-19: regional totals, the price weighted over priced districts only, and staleness."""
    priced = F.col("median_price") > 0
    price = snapshot.agg(
        X.ratio(
            F.sum(F.coalesce("median_price", F.lit(0.0)) * F.col("total_rooms")),
            F.sum(F.when(priced, F.col("total_rooms")).otherwise(0)),
        )
    ).scalar()
    age, stale = X.staleness(today, F.col("as_of_date"))
    return totals.select("*", price.alias("avg_price"), age.alias("data_age_days"), stale.alias("is_stale"))


def month_spine(spark) -> DataFrame:
    return spark.range(1, 13).select(F.col("id").cast("int").alias("month"))


def seasonality(monthly: DataFrame, event_months: DataFrame) -> DataFrame:
    """AG-20, rows: twelve months, each the mean over its (year, month) rows, with coverage flags."""
    stats = monthly.groupBy("month").agg(
        F.avg("avg_occupancy").alias("occupancy"),
        F.avg(F.coalesce("avg_price", F.lit(0.0))).alias("avg_price"),
        F.sum("days_count").alias("samples"),
    )
    events = event_months.groupBy("month").agg(F.sum("events_count").alias("events"))
    samples = F.coalesce("samples", F.lit(0))
    return (
        month_spine(monthly.sparkSession).join(stats, "month", "left").join(events, "month", "left")
        .select(
            "month",
            X.month_name(F.col("month")).alias("month_name"),
            X.season(F.col("month")).alias("season"),
            F.coalesce("occupancy", F.lit(0.0)).alias("occupancy"),
            F.coalesce("avg_price", F.lit(0.0)).alias("avg_price"),
            F.coalesce("events", F.lit(0)).alias("events"),
            samples.alias("samples"),
            (samples > 0).alias("has_data"),
            (samples < M.MIN_SAMPLES_PER_MONTH).alias("is_gap"),
            F.when(samples >= M.MIN_SAMPLES_FOR_HIGH_CONFIDENCE, "high").when(samples >= 1, "limited").otherwise("none")
            .alias("confidence"),
        )
    )


def seasonality_summary(months: DataFrame) -> DataFrame:
    """AG-20 / ML-20, summary: Pearson over covered months (three at least), extremes over confident months."""
    ok = ~F.col("is_gap")
    valid = ok & (F.col("occupancy") > 0)
    sure = valid & (F.col("confidence") == "high")
    key = F.struct(F.col("occupancy"), -F.col("month"))
    low_key = F.struct(F.col("occupancy"), F.col("month"))
    return months.agg(
        F.when(
            F.count_if(ok) >= 3,
            F.corr(F.when(ok, F.col("events").cast("double")), F.when(ok, F.col("occupancy"))),
        ).alias("correlation"),
        F.avg(F.when(valid, F.col("occupancy"))).alias("avg_occupancy"),
        F.max_by("month_name", F.when(sure, key)).alias("peak_month"),
        F.min_by("month_name", F.when(sure, low_key)).alias("low_month"),
        F.count_if(valid).alias("covered_months"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("has_data"), F.col("month")))), ",").alias(
            "missing_months"
        ),
    )


def season_insights(months: DataFrame) -> DataFrame:
    """AG-33, extremes over months with data (first month wins a tie)."""
    rows = months.filter("has_data")
    return rows.agg(
        F.min_by("month_name", F.struct("occupancy", "month")).alias("best_month"),
        F.max_by("month_name", F.struct("occupancy", "month")).alias("peak_month"),
        F.min_by("month_name", F.struct("avg_price", "month")).alias("cheapest_month"),
    )


def season_means(months: DataFrame) -> DataFrame:
    """AG-33, per season."""
    return months.filter("has_data").groupBy("season").agg(
        F.avg("occupancy").alias("occupancy"), F.avg("avg_price").alias("avg_price"), F.sum("samples").alias("days")
    )


def district_table(snapshot: DataFrame, hotels: DataFrame, districts: Sequence[str]) -> DataFrame:
    """AG-21: whitelisted districts above the sample floor; when the snapshot holds no row at all, registry counts with
    NULL metrics stand in."""
    gate = F.col("district").isin(list(districts)) & (F.col("hotels_count") >= M.DISTRICT_SAMPLE_MIN)
    live = snapshot.filter(gate).select(
        "district",
        F.coalesce("avg_occupancy", F.lit(0.0)).alias("occupancy"),
        F.coalesce(F.col("free_rooms").cast("double"), F.lit(0.0)).alias("free_rooms"),
        F.coalesce(F.col("total_rooms").cast("double"), F.lit(0.0)).alias("total_rooms"),
        F.coalesce("median_price", F.lit(0.0)).alias("median_price"),
        "hotels_count",
        X.confidence(F.col("hotels_count")).alias("confidence"),
    )
    seen = snapshot.agg(F.count("*")).scalar()
    null = F.lit(None).cast("double")
    fallback = hotels_by_district(hotels).filter(gate & (seen == 0)).select(
        "district", null.alias("occupancy"), null.alias("free_rooms"), null.alias("total_rooms"),
        null.alias("median_price"), "hotels_count", F.lit(None).cast("string").alias("confidence"),
    )
    return live.unionByName(fallback)


def recommendations(snapshot: DataFrame, monthly: DataFrame, districts: Sequence[str], current_month: Column) -> DataFrame:
    """AG-22: up to four rule rows from the emptiest and fullest district and month."""
    d = snapshot.filter(F.col("district").isin(list(districts)) & (F.col("avg_occupancy") > 0))
    quiet = d.agg(F.min_by(F.struct("district", "avg_occupancy"), F.struct("avg_occupancy", "district")).alias("b"))
    busy = d.agg(F.max_by(F.struct("district", "avg_occupancy"), F.struct("avg_occupancy", "district")).alias("b"))
    months = monthly.groupBy("month").agg(F.avg("avg_occupancy").alias("occ"))
    low = months.agg(F.min_by(F.struct("month", "occ"), F.struct("occ", "month")).alias("b"))
    peak = months.agg(F.max_by(F.struct("month", "occ"), F.struct(F.col("occ"), -F.col("month"))).alias("b"))

    def rule(df, order, audience, code, subject, occ, period, effect):
        return df.filter(F.col("b").isNotNull()).select(
            F.lit(order).alias("rank"), F.lit(audience).alias("type"), F.lit(code).alias("rule"),
            subject.alias("subject"), occ.alias("occupancy"), period.alias("period"), effect.alias("effect"),
        )

    when = (
        F.when(F.col("b.month") > current_month, "this_year")
        .when(F.col("b.month") == current_month, "now").otherwise("next_year")
    )
    name, occ = X.month_name(F.col("b.month")), F.col("b.occ")
    d_occ = F.col("b.avg_occupancy")
    return (
        rule(quiet, 1, "tourist", "quiet_district", F.col("b.district"), d_occ, F.lit("now"), 100 - F.bround(d_occ, 0))
        .unionByName(
            rule(busy.filter(d_occ > 50), 2, "hotelier", "busy_district", F.col("b.district"), d_occ, F.lit("now"),
                 F.bround(d_occ / 5, 0))
        )
        .unionByName(rule(low, 3, "tourist", "low_month", name, occ, when, F.bround(100 - occ, 0)))
        .unionByName(rule(peak, 4, "hotelier", "peak_month", name, occ, when, F.bround(occ / 4, 0)))
    )


def data_coverage(series: DataFrame) -> DataFrame:
    """AG-23, per district and month."""
    return series.groupBy("district", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("days_count"), F.avg("avg_occupancy").alias("avg_occupancy"),
        F.min("avg_occupancy").alias("min_occupancy"), F.max("avg_occupancy").alias("max_occupancy"),
    )


def missing_months(series: DataFrame) -> DataFrame:
    """AG-23 / SO-07: months inside each district's range without a single observation."""
    month = F.trunc("date", "month")
    observed = series.select("district", month.alias("month")).distinct()
    spine = series.groupBy("district").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select(
        "district",
        F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month"))).alias("month"),
    )
    return spine.join(observed, ["district", "month"], "left_anti")


def gaps(dates: DataFrame, min_days: int = 7, key: str | None = None) -> DataFrame:
    """WN-03: holes longer than `min_days` between consecutive observed dates, globally or per key.

    Only distinct dates reach the window, so its input is bounded by the calendar, not by the facts."""
    keys = [key] if key else []
    distinct = dates.select(*keys, "date").distinct()
    w = (W.partitionBy(key) if key else W.partitionBy(F.lit(0))).orderBy("date")
    nxt = F.lead("date").over(w)
    return (
        distinct.select(*keys, F.col("date").alias("gap_from"), nxt.alias("gap_to"))
        .withColumn("gap_days", F.datediff("gap_to", "gap_from"))
        .filter(F.col("gap_days") > min_days)
    )


def metadata(stats: DataFrame, hotels: DataFrame, events: DataFrame, today: Column, min_gap: int = 7) -> DataFrame:
    """AG-24: one row of counts, range, freshness and the number of gaps."""
    n_gaps = gaps(stats, min_gap).agg(F.count("*")).scalar()
    return stats.agg(
        F.min("date").alias("data_from"), F.max("date").alias("data_to"), F.max("updated_at").alias("last_refresh")
    ).select(
        "*",
        hotels.agg(F.count("*")).scalar().alias("hotels_count"),
        events.agg(F.count("*")).scalar().alias("events_count"),
        events.agg(F.count_if(F.col("date_start") >= today)).scalar().alias("upcoming_events"),
        n_gaps.alias("gap_count"),
    )


def price_history(series: DataFrame, since: Column, until: Column) -> DataFrame:
    """AG-25: per date the spread of district medians."""
    rows = series.filter(F.col("date").between(since, until) & (F.col("avg_price") > 0))
    return rows.groupBy("date").agg(
        F.avg("avg_price").alias("avg_price"), F.min("avg_price").alias("min_price"),
        F.max("avg_price").alias("max_price"), F.count("*").alias("samples"),
    )


def seven_day_trend(points: DataFrame, value: str, order: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    """WN-07: mean of the last seven points against the seven before; NULL below fourteen points, +-2 % is flat.

    The window sees one row per date."""
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(F.col(order).desc())
    ranked = points.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 14)
    agg = ranked.groupBy(*keys).agg(
        F.avg(F.when(F.col("_rn") <= 7, F.col(value))).alias("recent_avg"),
        F.avg(F.when(F.col("_rn") > 7, F.col(value))).alias("previous_avg"),
        F.count("*").alias("_n"),
    ).filter(F.col("_n") == 14)
    change = F.when(
        F.col("previous_avg") > 0, (F.col("recent_avg") - F.col("previous_avg")) / F.nullif("previous_avg", F.lit(0)) * 100
    ).otherwise(0.0)
    return agg.select(
        *keys, "recent_avg", "previous_avg", change.alias("change_percent"), X.trend_label(change, 2).alias("direction")
    )


def timeseries_summary(series: DataFrame, since: Column, until: Column) -> DataFrame:
    """AG-27."""
    return series.filter(F.col("date").between(since, until)).groupBy("district").agg(
        F.min("avg_occupancy").alias("min_occupancy"), F.max("avg_occupancy").alias("max_occupancy"),
        F.avg("avg_occupancy").alias("avg_occupancy"), F.count("*").alias("samples"),
    )


def selection_series(series: DataFrame, districts: Sequence[str]) -> DataFrame:
    """AG-28, merged series over chosen districts."""
    return series.filter(F.col("district").isin(list(districts))).groupBy("date").agg(
        F.avg("avg_occupancy").alias("occupancy"),
        F.avg(F.when(F.col("avg_price") > 0, F.col("avg_price"))).alias("price"),
        F.sum("total_rooms").alias("total_rooms"),
    )


def selection_kpi(map_rows: DataFrame) -> DataFrame:
    """AG-28, KPI over shown objects."""
    return map_rows.agg(
        F.count("*").alias("total_hotels"), F.sum("rooms_num").alias("total_rooms"),
        F.sum("free_rooms").alias("free_rooms"),
        X.ratio(100.0 * (F.sum("rooms_num") - F.sum("free_rooms")), F.sum("rooms_num")).alias("occupancy"),
    )


def rollup(stats: DataFrame, hotels: DataFrame, latest: Column) -> DataFrame:
    """AG-39: AG-01 for region, district, district by size and district by type in one pass."""
    rows = with_hotel(recent_snapshots(stats, latest), hotels, "district", "accommodation_type").select(
        "district", X.size_bucket().alias("size"), F.coalesce("accommodation_type", F.lit("unknown")).alias("type"),
        "rooms_num", "available_rooms_percent",
    )
    d, s, t = F.col("district"), F.col("size"), F.col("type")
    return rows.groupingSets([[d, s], [d, t], [d], []], d, s, t).agg(
        F.grouping_id().cast("int").alias("level"), X.weighted_occupancy().alias("occupancy"), F.count("*").alias("objects")
    )


def top_types(by_type: DataFrame, top: int = 10) -> DataFrame:
    """AG-31: the largest categories with the totals of the whole list beside them. The window holds one row per
    category."""
    w = W.partitionBy(F.lit(0))
    ranked = by_type.select(
        "type", "count",
        F.row_number().over(w.orderBy(F.col("count").desc(), "type")).alias("rank"),
        F.sum("count").over(w).alias("total"), F.count("*").over(w).alias("kinds"),
    ).filter(F.col("rank") <= top)
    return ranked.withColumn("shown", F.sum("count").over(w))


def statistics_card(snapshot: DataFrame) -> DataFrame:
    """AG-34, first variant: unweighted mean over districts with an occupancy."""
    return snapshot.agg(
        F.avg(F.when(F.col("avg_occupancy") > 0, F.col("avg_occupancy"))).alias("avg_occupancy"),
        F.sum("total_rooms").alias("total_rooms"), F.sum("free_rooms").alias("free_rooms"),
    )


def revenue_window(series: DataFrame, percentiles: DataFrame, since: Column, today: Column) -> DataFrame:
    """AG-34, second variant: per district over a window, stale when the last day is older than three days."""
    occ = series.filter(F.col("date") >= since).groupBy("district").agg(
        F.avg("avg_occupancy").alias("occupancy"), F.count("*").alias("days"), F.max("date").alias("last_date")
    )
    price = percentiles.select("district", F.col("p50").alias("adr"))
    return occ.join(price, "district", "left").select(
        "*", X.revpar(F.col("adr"), F.col("occupancy")).alias("revpar"),
        (F.datediff(today, F.col("last_date")) > 3).alias("is_stale"),
    )


# Official register figures for 2024 (fixed values).
REGISTER_TOTAL = 549
REGISTER_AVG_ROOMS = 27


def register_coverage(totals: DataFrame) -> DataFrame:
    """AG-35."""
    return totals.select(
        "total_hotels", F.lit(REGISTER_TOTAL).alias("register_total"),
        (F.col("total_hotels") / F.lit(REGISTER_TOTAL) * 100).alias("coverage_percent"),
    )


def revpar_delta(by_district: DataFrame) -> DataFrame:
    """AG-43: distance of each district to the room-weighted region."""
    region = revenue_total(by_district).select("revpar").scalar()
    delta = F.col("revpar") - F.col("region_revpar")
    return by_district.select("district", "revpar", region.alias("region_revpar")).select(
        "*", delta.alias("delta"),
        F.when(F.col("region_revpar") > 0, delta / F.nullif("region_revpar", F.lit(0)) * 100).otherwise(0.0).alias("delta_pct"),
    )


def top_candidates(stats: DataFrame, hotels: DataFrame, top: int, min_rooms: int = 20, min_points: int = 60) -> DataFrame:
    """ST-06: largest hotels with enough history. Aggregated by id before the registry is joined."""
    agg = (
        stats.filter(F.col("rooms_num") >= min_rooms).groupBy("id")
        .agg(F.max("rooms_num").alias("rooms_num"), F.count("date").alias("history_points"))
        .filter(F.col("history_points") >= min_points)
    )
    return agg.join(hotels.select("id", "name", "district"), "id").orderBy(
        F.desc("rooms_num"), F.desc("history_points"), "id"
    ).limit(top)


def map_rows(hotels: DataFrame, snapshot: DataFrame, district_stats: DataFrame, explicit_date: bool) -> DataFrame:
    """JN-03: objects with coordinates, their own occupancy and their district's. For an explicit date objects without a
    filled snapshot are left out."""
    here = hotels.filter((F.col("lat") != 0) & (F.col("lon") != 0)).withColumnRenamed("min_price", "hotel_price")
    snap = snapshot.select("id", "rooms_num", "free_rooms_amount", "max_capacity")
    if explicit_date:
        snap = snap.filter((F.coalesce("rooms_num", F.lit(0)) != 0) | (F.coalesce("free_rooms_amount", F.lit(0)) != 0))
    rows = here.join(snap, "id", "inner" if explicit_date else "left")
    rows = rows.join(district_stats.select("district", F.col("avg_occupancy").alias("district_occupancy")), "district", "left")
    r = F.coalesce("rooms_num", F.lit(0))
    return rows.select(
        "id", "name", "city", "district", "lat", "lon", "rating", F.col("hotel_price").alias("min_price"),
        r.alias("rooms_num"),
        F.least(F.greatest(F.coalesce("free_rooms_amount", F.lit(0)), F.lit(0)), r).alias("free_rooms"),
        X.own_occupancy().alias("occupancy"), "district_occupancy",
        F.coalesce("max_capacity", F.lit(0)).alias("max_capacity"),
    )


def snapshot_on(stats: DataFrame, target: Column, strict: bool = False) -> DataFrame:
    """JN-10 / SRC-14: rows of one date, exactly or the last date not after it."""
    day = target if strict else stats.filter(F.col("date") <= target).select(F.max("date")).scalar()
    zero = F.lit(0)
    return stats.filter(F.col("date") == day).select(
        "id", "date", F.coalesce("rooms_num", zero).alias("rooms_num"),
        F.coalesce("free_rooms_amount", zero).alias("free_rooms"), F.coalesce("max_capacity", zero).alias("max_capacity"),
    )


def as_of_per_hotel(stats: DataFrame, target: Column) -> DataFrame:
    """JN-10, per-key variant: each hotel's last row not after the date."""
    return latest_per_key(stats.filter(F.col("date") <= target), ["id"], "date", SNAPSHOT_COLUMNS)
