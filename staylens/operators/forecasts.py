"""Forecast tables: combining models, judging them, and what is read from them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from staylens.functions import metrics as X
from staylens.operators import blocks as B
from staylens.operators.timeseries import half_trend
from staylens.session import ship_package


# --- combination -----------------------------------------------------------------------------------------------------
def inverse_rmse_weights(metrics: DataFrame, keys: Sequence[str] = ("district",)) -> DataFrame:
    """ML-08: 1 / (rmse + 0.1), as shares per entity."""
    raw = 1.0 / (F.col("rmse") + 0.1)
    return metrics.withColumn("weight", raw / F.sum(raw).over(W.partitionBy(*keys)))


def simple_average(points: DataFrame) -> DataFrame:
    """ML-07, plain mean."""
    return points.groupBy("district", "forecast_date").agg(
        X.clip(F.avg("predicted_occupancy"), 0.0, 100.0).alias("occupancy"),
        X.clip(F.avg("confidence_lower"), 0.0, 100.0).alias("lower_bound"),
        X.clip(F.avg("confidence_upper"), 0.0, 100.0).alias("upper_bound"),
        F.count("*").alias("models"),
    )


def weighted_average(points: DataFrame, weights: DataFrame, default_weight: float = 0.33) -> DataFrame:
    """ML-07, weighted mean; the band is the mean half-width plus the spread between models. Weights are renormalised
    over the models that have a point for the date."""
    rows = points.join(weights.select("district", "model", "weight"), ["district", "model"], "left").withColumn(
        "w", F.coalesce("weight", F.lit(default_weight)))
    v, w = F.col("predicted_occupancy"), F.col("w")
    day = W.partitionBy("district", "forecast_date")  # one row per model
    centred = rows.withColumn("m", F.sum(v * w).over(day) / F.sum(w).over(day))
    agg = centred.groupBy("district", "forecast_date").agg(
        F.max("m").alias("m"), (F.sum(w * (v - F.col("m")) ** 2) / F.sum(w)).alias("variance"),
        (F.sum(w * (F.col("confidence_upper") - F.col("confidence_lower")) / 2) / F.sum(w)).alias("half"),
    )
    spread = F.sqrt("variance")
    band = F.col("half") + spread
    return agg.select(
        "district", "forecast_date", X.clip(F.col("m"), 0.0, 100.0).alias("occupancy"),
        F.greatest(F.lit(0.0), F.col("m") - band).alias("lower_bound"),
        F.least(F.lit(100.0), F.col("m") + band).alias("upper_bound"),
    )


def best_model(points: DataFrame, metrics: DataFrame) -> DataFrame:
    """ML-07, points of the model with the least error per district."""
    best = metrics.groupBy("district").agg(F.min_by("model", F.struct("rmse", "model")).alias("model"))
    return points.join(best, ["district", "model"], "left_semi")


# --- evaluation ------------------------------------------------------------------------------------------------------
def error_metrics(pairs: DataFrame, keys: Sequence[str], forecast: str = "forecast", actual: str = "actual") -> DataFrame:
    """ML-10: RMSE, MAE, R2 (NULL for a constant actual), MAPE over actuals of at least one, bias; one aggregation."""
    f, a = F.col(forecast), F.col(actual)
    err = f - a
    ss_tot = F.count("*") * F.var_pop(a)
    return pairs.filter(f.isNotNull() & a.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.when(F.max(a) > F.min(a), 1.0 - F.sum(err * err) / F.nullif(ss_tot, F.lit(0.0))).alias("r2"),
        F.avg(F.when(a >= 1.0, F.abs(err) / F.nullif(a, F.lit(0.0)) * 100)).alias("mape"),
        F.avg(err).alias("bias"),
    )


def forecast_vs_actual(forecasts: DataFrame, actuals: DataFrame, model: str | None = "ensemble") -> DataFrame:
    """JN-14 / SO-06: stored forecasts next to what happened, on the dates both have."""
    rows = forecasts if model is None else forecasts.filter(F.col("model") == model)
    act = actuals.select("district", F.col("date").alias("forecast_date"), F.col("occupancy").alias("actual"))
    return rows.join(act, ["district", "forecast_date"]).select(
        "district", "model", "forecast_date", "horizon", F.col("predicted_occupancy").alias("forecast"), "actual",
        F.coalesce("confidence_lower", F.col("predicted_occupancy") - 8.0).alias("lower"),
        F.coalesce("confidence_upper", F.col("predicted_occupancy") + 8.0).alias("upper"),
        (F.col("confidence_lower").isNotNull() & F.col("confidence_upper").isNotNull()).alias("has_interval"),
    )


def interval_coverage(pairs: DataFrame, keys: Sequence[str] = ("district",)) -> DataFrame:
    """ML-11: share of actuals inside the stored interval; three intervals needed."""
    hit = F.when(F.col("has_interval"), F.col("actual").between(F.col("lower"), F.col("upper")).cast("double"))
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.sqrt(F.avg((F.col("forecast") - F.col("actual")) ** 2)).alias("rmse"),
        F.avg(F.abs(F.col("forecast") - F.col("actual"))).alias("mae"),
        F.when(F.count(hit) >= 3, F.avg(hit)).alias("ci_coverage"),
    )


def rolling_origins(series: DataFrame, horizon: int, step: int, min_train: int) -> DataFrame:
    """ML-13: every origin with its targets: actual, last value, the value six days before the origin, and the value
    seven days before the target. `series` is (district, date, occupancy)."""
    w = W.partitionBy("district").orderBy("date")
    rows = series.select(
        "district", "date", "occupancy", (F.row_number().over(w) - 1).alias("_i"), F.count("*").over(W.partitionBy("district")).alias("_n"))
    chosen = (F.col("_i") >= min_train) & (F.col("_i") < F.col("_n") - horizon) & ((F.col("_i") - min_train) % step == 0)
    origins = rows.filter(chosen).select("district", F.col("date").alias("origin"), F.col("occupancy").alias("naive"))
    pairs = origins.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn("target", F.date_add("origin", F.col("h")))
    at = lambda name: series.select("district", F.col("date").alias("_d"), F.col("occupancy").alias(name))
    out = pairs.join(at("actual").withColumnRenamed("_d", "target"), ["district", "target"])
    out = out.withColumn("_d", F.date_sub("origin", 6)).join(at("seasonal_naive"), ["district", "_d"], "left").drop("_d")
    return out.withColumn("_d", F.date_sub("target", 7)).join(at("same_weekday"), ["district", "_d"], "left").drop("_d")


def backtest_report(observations: DataFrame, predictions: DataFrame, split: Column) -> DataFrame:
    """ML-13: errors per model, horizon and regime next to the naive ones on the same pairs."""
    pred = predictions.select(
        "district", "model", F.col("origin_date").alias("origin"), F.col("forecast_date").alias("target"), F.col("predicted_occupancy").alias("forecast"))
    rows = observations.join(pred, ["district", "origin", "target"]).withColumn(
        "regime", F.when(F.col("origin") < split, "before").otherwise("after"))
    a = F.col("actual")
    err = F.col("forecast") - a
    return rows.groupBy("model", "h", "regime").agg(
        F.count("*").alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(err).alias("bias"),
        F.avg(F.abs(F.col("naive") - a)).alias("mae_naive"), F.avg(F.abs(F.col("seasonal_naive") - a)).alias("mae_seasonal_naive"),
        F.avg(F.abs(F.col("same_weekday") - a)).alias("mae_same_weekday"),
    )


# --- fixed values: distribution function of a Poisson variable of mean one ------------------------------------------------
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940581, 0.99991676)
# ----------------------------------------------------------------------------------------------------------------------
REPLICATES, ROWS_AT_ONCE, KEYS_HELD = 1000, 512, 64


def poisson_weights(ids: np.ndarray, first: int, last: int) -> np.ndarray:
    """How often each row counts in the resamples first..last-1: independent Poisson draws of mean one from a hash of row id and number."""
    x = ids.astype(np.uint64)[:, None] + np.arange(first, last, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    out = np.zeros(x.shape, np.int8)
    for cut in POISSON:
        out += x >= np.uint64(int(cut * 2**64))
    return out


def paired_bootstrap(errors: DataFrame, keys: Sequence[str], model_error: str, naive_error: str, rounds: int = 10000, seed: int = 20260809) -> DataFrame:
    """ML-14: share of resamples in which the naive forecast is not worse. Each observation gets an independent Poisson
    weight per resample, drawn from a seeded hash of the row and its number among equal rows, so that the outcome does not depend on how rows are dealt.

    A task multiplies the weights of a batch of rows with their differences and passes on one sum per key and resample, as arrays of `REPLICATES`;
    these are added up across tasks. Nothing has a row per observation and resample."""
    ship_package(errors.sparkSession)
    diff = (F.abs(F.col(model_error)) - F.abs(F.col(naive_error))).cast("double")
    equal = errors.groupBy(*errors.columns).agg(F.count("*").alias("_n")).withColumn("_j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))))
    key = F.to_json(F.struct(*keys)).alias("_key")
    rows = equal.filter(diff.isNotNull()).select(key, diff.alias("_d"), F.xxhash64(F.lit(seed), *[F.col(c) for c in errors.columns], "_j").alias("_id"))
    named = errors.select(key, *keys).groupBy("_key").agg(*[F.first(k).alias(k) for k in keys])

    def parts(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        cut = [(k, i, v[i : i + REPLICATES].tobytes()) for k, v in held.items() for i in range(0, rounds, REPLICATES)]
        return pa.record_batch({"_key": pa.array([k for k, _, _ in cut], pa.string()), "_part": pa.array([i for _, i, _ in cut], pa.int32()), "_sums": pa.array([v for _, _, v in cut], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                code = part.column(0).dictionary_encode()
                names, code = code.dictionary.to_pylist(), code.indices.to_numpy()
                d, ids = part.column(1).to_numpy(), part.column(2).to_numpy()
                for name in names:
                    held.setdefault(name, np.zeros(rounds))
                of = (code == np.arange(len(names))[:, None]) * d  # a row for each key
                for lo in range(0, rounds, REPLICATES):
                    hi = min(lo + REPLICATES, rounds)
                    sums = of @ poisson_weights(ids, lo, hi)
                    for name, s in zip(names, sums):
                        held[name][lo:hi] += s
                if len(held) > KEYS_HELD:
                    yield parts(held)
                    held = {}
        yield parts(held)

    def total(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(v.as_py()) for v in table.column("_sums"))
        return pa.table({"_key": table.column("_key").slice(0, 1), "_kept": pa.array([int((sums >= 0).sum())], pa.int64()), "_rounds": pa.array([len(sums)], pa.int64())})

    sums = rows.mapInArrow(added, "_key string, _part int, _sums binary").groupBy("_key", "_part").applyInArrow(total, "_key string, _kept bigint, _rounds bigint")
    shares = sums.groupBy("_key").agg((F.sum("_kept") / F.sum("_rounds")).alias("p_naive_not_worse"), F.sum("_rounds").alias("rounds"))
    return named.join(shares, "_key").select(*keys, "p_naive_not_worse", "rounds")


def nearest_rank(values: DataFrame, keys: Sequence[str], columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """AG-38: nearest-rank percentiles, exact. Values are reduced to counts, the counts cut into ranges; what the ranges before hold
    tells in which range a rank lies, and only there rows are counted up. So neither a key nor the whole table is ranked in one task."""
    out = None
    for c in columns:
        one = _ranks(values.select(*keys, F.col(c).alias("_v")).filter(F.col("_v").isNotNull()), keys, shares)
        named = [F.col(f"_p{i}").alias(f"{c}_p{int(p * 100)}") for i, p in enumerate(shares)]
        one = one.select(*keys, *named)
        out = one if out is None else (out.join(one, list(keys)) if keys else out.select("*", *[one.select(n).scalar().alias(n) for n in one.columns]))
    return out


def _ranks(values: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Columns _p0, _p1, ... of one value column `_v`."""
    counts = B.in_blocks(values.groupBy(*keys, "_v").agg(F.count("*").alias("_n")), keys, ["_v"])
    sums = counts.groupBy(*keys, B.BLOCK).agg(F.sum("_n").alias("_n"))
    ranges = B.carried(sums, keys, "_n")
    total = sums.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.bround(F.lit(p) * (F.col("_all") - 1), 0).cast("bigint").alias("at")) for i, p in enumerate(shares)]))
    asked = total.select(*keys, wanted.alias("w")).select(*keys, "w.*")
    # the last range that begins at or before the rank
    last = F.max_by(F.struct(F.col(B.BLOCK), F.col("before")), F.col(B.BLOCK)).alias("b")
    hit = B.meet(asked, ranges, keys, also=F.col("before") <= F.col("at")).groupBy(*keys, "i", "at").agg(last)
    hit = hit.select(*keys, "i", (F.col("at") - F.col("b.before")).alias("_rest"), F.col(f"b.{B.BLOCK}").alias(B.BLOCK))
    upto = B.meet(counts, hit.select(*keys, B.BLOCK), [*keys, B.BLOCK], "left_semi").withColumn("_upto", F.sum("_n").over(B.within(keys, ["_v"])))
    found = B.meet(upto, hit, [*keys, B.BLOCK], also=F.col("_upto") > F.col("_rest"))
    return found.groupBy(*keys).agg(*[F.min(F.when(F.col("i") == i, F.col("_v"))).alias(f"_p{i}") for i in range(len(shares))])


# --- reading ---------------------------------------------------------------------------------------------------------
def horizon_card(points: DataFrame, keys: Sequence[str] = ("district",)) -> DataFrame:
    """AG-42."""
    return points.groupBy(*keys).agg(
        F.avg("predicted_occupancy").alias("avg_occupancy"), F.max("predicted_occupancy").alias("max_occupancy"),
        F.min("predicted_occupancy").alias("min_occupancy"))


def value_at(points: DataFrame, target: Column, keys: Sequence[str] = ("district", "model")) -> DataFrame:
    """SC-48: the point of the date, else the first point."""
    v = F.col("predicted_occupancy")
    return points.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("forecast_date") == target, v)), F.min_by(v, F.col("forecast_date"))).alias("occupancy"))


def nearest_in_time(series: DataFrame, target: Column, max_days: int = 7) -> DataFrame:
    """JN-11: the value of the date, else of the closest date within a week (the earlier on a tie), else none."""
    gap = F.abs(F.datediff("date", target))
    best = F.min_by(F.struct("date", "occupancy"), F.struct(gap, F.col("date"))).alias("b")
    return series.groupBy("district").agg(best, F.min(gap).alias("distance")).filter(F.col("distance") <= max_days).select(
        "district", F.col("b.date").alias("date"), F.col("b.occupancy").alias("occupancy"), "distance")


def merged_series(actuals: DataFrame, forecasts: DataFrame, today: Column, reserve: int = 14) -> DataFrame:
    """JN-15: fact, forecast and interval in one row per district and date; the days ahead exist even without data."""
    f = forecasts.select(
        "district", F.col("forecast_date").alias("date"), F.col("predicted_occupancy").alias("forecast"),
        F.col("confidence_lower").alias("lower"), F.col("confidence_upper").alias("upper"))
    a = actuals.select("district", "date", F.col("occupancy").alias("factual"))
    ahead = actuals.select("district").distinct().select(
        "district", F.explode(F.sequence(F.date_add(today, 1), F.date_add(today, reserve))).alias("date"))
    rows = a.unionByName(f, allowMissingColumns=True).unionByName(ahead, allowMissingColumns=True)
    return rows.groupBy("district", "date").agg(*[F.max(c).alias(c) for c in ("factual", "forecast", "lower", "upper")])


def wide_models(forecasts: DataFrame, models: Sequence[str]) -> DataFrame:
    """JN-15: one column per model."""
    return forecasts.groupBy("district", "forecast_date").pivot("model", list(models)).agg(F.max("predicted_occupancy"))


def best_dates(points: DataFrame, weather: DataFrame, events: DataFrame, today: Column, top: int = 5) -> DataFrame:
    """JN-18 / ST-02: dates scored by emptiness, warmth and events; the best few per district."""
    temp = weather.select(F.col("date").alias("forecast_date"), F.col("temperature_max").alias("temperature"))
    ev = events.groupBy(F.col("date_start").alias("forecast_date")).agg(F.count("*").alias("n_events"))
    rows = points.filter(F.col("forecast_date") >= today).join(temp, "forecast_date", "left").join(ev, "forecast_date", "left")
    n = F.coalesce("n_events", F.lit(0))
    scored = rows.select(
        "district", "forecast_date", F.col("predicted_occupancy").alias("occupancy"), "temperature", n.alias("n_events"),
        X.trip_score(F.col("predicted_occupancy"), F.col("temperature"), n).alias("score"))
    w = W.partitionBy("district").orderBy(F.desc("score"), "forecast_date")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def price_advice(snapshot: DataFrame, points: DataFrame) -> DataFrame:
    """SC-31: signed change and recommended price per district from the week's mean forecast."""
    mean = points.groupBy("district").agg(F.avg("predicted_occupancy").alias("_f"))
    forecast = F.coalesce("_f", "avg_occupancy")
    rows = snapshot.filter(F.col("median_price") > 0).join(mean, "district", "left").select(
        "district", F.col("median_price").alias("current_price"), F.col("avg_occupancy").alias("current_occupancy"), forecast.alias("forecast_occupancy"))
    pct = X.price_change_percent(F.col("forecast_occupancy"))
    return rows.withColumn("percent", pct).withColumn("recommended_price", F.col("current_price") * (1 + F.col("percent") / 100))


def trip_summary(points: DataFrame, events: DataFrame, snapshot: DataFrame, today: Column, days: int) -> DataFrame:
    """AG-40: level and trend of the forecast, events ahead, rooms and price, per district."""
    card = points.groupBy("district").agg(F.avg("predicted_occupancy").alias("forecast_occupancy"))
    trend = half_trend(points, ["district"], "predicted_occupancy", "forecast_date", 3).select("district", "trend")
    near = events.filter(F.col("date_start").between(today, F.date_add(today, days)))
    first = near.orderBy("date_start", "event_id").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date_start", "event_id", "title"))), lambda e: e["title"]), "; ")).scalar()
    level = F.when(F.col("forecast_occupancy") < 40, "low").when(F.col("forecast_occupancy") > 70, "high").otherwise("medium")
    return card.join(trend, "district").join(
        snapshot.select("district", F.col("free_rooms").alias("available_rooms"), F.col("median_price").alias("avg_price")), "district", "left"
    ).select(
        "district", "forecast_occupancy", level.alias("level"), "trend", near.agg(F.count("*")).scalar().alias("events_count"),
        first.alias("first_events"), F.coalesce("available_rooms", F.lit(0)).alias("available_rooms"), "avg_price")


def insights(occupancy: DataFrame, points: DataFrame, weather: DataFrame, events_count: Column, top: int = 4) -> DataFrame:
    """AG-37: rule rows in fixed order, the first few that apply. Every input is one row."""
    o = F.col("occ")
    band = F.when((o > 0) & (o < 40), "quiet").when((o >= 40) & (o <= 70), "moderate").when(o > 70, "busy")
    one = occupancy.select(F.lit(1).alias("rank"), band.alias("rule"), o.cast("double").alias("metric"))
    d = F.col("diff")
    two = half_trend(points.withColumn("_k", F.lit(1)), ["_k"], "predicted_occupancy", "forecast_date", 5).filter(F.col("points") >= 4).select(
        F.lit(2).alias("rank"), F.when(d > 5, "rising").when(d < -5, "falling").otherwise("steady").alias("rule"), d.alias("metric"))
    w = weather.agg(F.avg("temperature_max").alias("t"), F.count_if(F.col("precipitation") > 1).alias("rain"), F.count("*").alias("n"))
    three = w.select(F.lit(3).alias("rank"), F.when(F.col("t") > 20, "warm").when(F.col("t") < 0, "cold").alias("rule"), F.col("t").alias("metric"))
    four = w.select(F.lit(4).alias("rank"), F.when(F.col("rain") > F.col("n") / 2, "rainy").alias("rule"), F.col("rain").cast("double").alias("metric"))
    five = occupancy.select(F.lit(5).alias("rank"), F.when(events_count > 3, "many_events").alias("rule"), events_count.cast("double").alias("metric"))
    rows = one.unionByName(two).unionByName(three).unionByName(four).unionByName(five)
    return rows.filter(F.col("rule").isNotNull()).orderBy("rank").limit(top)


# --- fixed values: feature groups ------------------------------------------------------------------------------------
FEATURE_GROUPS = {
    "lag": ("lag_", "diff_", "rolling_"),
    "price": ("price",),
    "weather": ("temp", "precipitation", "is_good_weather"),
    "events": ("events_", "has_major"),
    "holidays": ("is_holiday", "days_to", "days_from", "is_long"),
}
# -------------------------------------------------------------------------------------------------------------------


def feature_group(name: Column) -> Column:
    out = None
    for group, prefixes in FEATURE_GROUPS.items():
        hit = name.rlike("^(" + "|".join(prefixes) + ")")
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise("calendar")


def importance_by_group(importance: DataFrame) -> DataFrame:
    """AG-32."""
    return importance.groupBy(feature_group(F.col("feature")).alias("group")).agg(F.sum("importance").alias("importance"))


def top_factors(importance: DataFrame, top: int = 5) -> DataFrame:
    """ST-07 / AG-32."""
    return importance.orderBy(F.desc("importance"), "feature").limit(top)


def fingerprint(series: DataFrame, weather: DataFrame, events: DataFrame, version: str) -> DataFrame:
    """ML-22: per district a hash of the history's length and edges, the weather's edge dates and the events' count and
    range. Depends on content only, never on row order."""
    w = W.partitionBy("district")
    rows = series.select(
        "district", "date", "occupancy", F.row_number().over(w.orderBy("date")).alias("_a"),
        F.row_number().over(w.orderBy(F.desc("date"))).alias("_z"), F.count("*").over(w).alias("_n"))
    item = F.concat_ws("=", F.col("date").cast("string"), F.format_string("%.4f", "occupancy"))
    edges = rows.filter((F.col("_a") <= 3) | (F.col("_z") <= 5))
    listed = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, item))), ",")
    hist = edges.groupBy("district").agg(
        F.max("_n").alias("n"), listed(F.col("_a") <= 3).alias("first"), listed(F.col("_z") <= 5).alias("last"))
    days = weather.agg(F.concat_ws("|", F.min("date").cast("string"), F.max("date").cast("string"))).scalar()
    ev = events.agg(F.concat_ws("|", F.count("*").cast("string"), F.min("date_start").cast("string"), F.max("date_start").cast("string"))).scalar()
    payload = F.concat_ws("#", F.col("n").cast("string"), "first", "last", days, ev, F.lit(version))
    return hist.select("district", F.left(F.sha2(payload, 256), F.lit(16)).alias("fingerprint"))


def fallback_forecast(series: DataFrame, horizon: int) -> DataFrame:
    """ML-23: the mean with a weekly saw-tooth and a band of fifteen points."""
    base = series.groupBy("district").agg(F.avg("occupancy").alias("_b"), F.max("date").alias("_d"))
    i = F.col("h")
    occ = X.clip(F.col("_b") + (i % 7 - 3) * 2, 0.0, 100.0)
    rows = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn("occupancy", occ)
    return rows.select(
        "district", F.date_add("_d", i).alias("forecast_date"), "h", "occupancy",
        F.greatest(F.lit(0.0), F.col("occupancy") - 15).alias("lower_bound"), F.least(F.lit(100.0), F.col("occupancy") + 15).alias("upper_bound"))
