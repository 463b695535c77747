"""Forecast models. Groups handed to Python hold one row per entity and day: their size is the length of the calendar,
whatever the number of facts behind a day, because the series is aggregated before it is grouped."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from staylens.functions import dates as D
from staylens.functions import metrics as X
from staylens.operators import forecasts as C
from staylens.operators import timeseries as T

YEARLY_ORDER, WEEKLY_ORDER = 6, 3


# --- additive model --------------------------------------------------------------------------------------------------
def additive_columns(df: DataFrame, date: str = "date", origin: Column | None = None) -> tuple[DataFrame, list[str]]:
    """Regressors of the additive model as columns: trend, yearly and weekly waves, holidays with two days either side.
    Event and weather columns are appended by the caller when it has them."""
    d = F.col(date)
    t = F.datediff(d, origin if origin is not None else F.lit("2000-01-01").cast("date")).cast("double")
    cols: dict[str, Column] = {"x_trend": t / 365.25}
    for period, order, name in ((365.25, YEARLY_ORDER, "y"), (7.0, WEEKLY_ORDER, "w")):
        for k in range(1, order + 1):
            angle = t * (2 * np.pi * k / period)
            cols[f"x_sin_{name}{k}"], cols[f"x_cos_{name}{k}"] = F.sin(angle), F.cos(angle)
    for offset in range(-2, 3):
        cols[f"x_holiday_{offset + 2}"] = D.is_holiday(F.date_add(d, offset)).cast("double")
    return df.withColumns(cols), list(cols)


def _ridge(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    beta = np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return beta / scale, mean, np.array([y.mean()])


def fit_predict(rows: DataFrame, keys: Sequence[str], regressors: Sequence[str], penalty: float = 5.0) -> DataFrame:
    """ML-03 / UD-03: one regularised linear fit per group on the rows that have y, predictions with an 80 % interval of
    the training residuals for the rows that do not. Input columns: keys, date, y, regressors."""
    names = list(regressors)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", date date, predicted double, lower double, upper double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf["y"].notna().to_numpy()
        ahead = pdf[~known]
        out = ahead[[*keys, "date"]].copy()
        if known.sum() < 2 or ahead.empty:
            return out.assign(predicted=np.nan, lower=np.nan, upper=np.nan).iloc[0:0]
        x = pdf[names].to_numpy(dtype=float)
        y = pdf.loc[known, "y"].to_numpy(dtype=float)
        beta, mean, base = _ridge(x[known], y, penalty)
        fitted = (x - mean) @ beta + base[0]
        low, high = np.quantile(y - fitted[known], [0.1, 0.9])
        value = fitted[~known]
        clip = lambda v: np.clip(v, 0.0, 100.0)
        return out.assign(predicted=clip(value), lower=clip(value + low), upper=clip(value + high))

    return rows.select(*keys, "date", "y", *names).groupBy(*keys).applyInPandas(fit, schema)


def additive_forecast(series: DataFrame, horizon: int, keys: Sequence[str] = ("district",), min_points: int = 30) -> DataFrame:
    """ML-03: forecast of every entity with enough history. `series` is (keys, date, y)."""
    n = F.count("y").over(W.partitionBy(*keys))
    enough = series.withColumn("_n", n).filter(F.col("_n") >= min_points).drop("_n")
    rows, names = additive_columns(T.with_future_dates(enough, horizon, keys))
    return fit_predict(rows, keys, names)


def holdout(series: DataFrame, keys: Sequence[str], test_days: int = 14, min_points: int = 30) -> DataFrame:
    """ML-12: forecast of the last observations of every entity from the earlier ones, next to what happened."""
    w = W.partitionBy(*keys)
    marked = series.withColumns({
        "_n": F.count("*").over(w), "_z": F.row_number().over(w.orderBy(F.desc("date")))
    }).filter(F.col("_n") >= min_points + test_days)
    hidden = marked.select(*keys, "date", F.when(F.col("_z") > test_days, F.col("y")).alias("y"))
    rows, names = additive_columns(hidden)
    actual = marked.filter(F.col("_z") <= test_days).select(*keys, "date", F.col("y").alias("actual"))
    return fit_predict(rows, keys, names).join(actual, [*keys, "date"]).withColumnRenamed("predicted", "forecast")


def walk_forward(series: DataFrame, keys: Sequence[str] = ("district",), folds: int = 5, step: int = 14, test_days: int = 14, warm_up: int = 30) -> DataFrame:
    """ML-09: rolling train/test splits of every entity, fewer for short histories; pairs per (entity, fold, date)."""
    w = W.partitionBy(*keys)
    rows = series.withColumns({"_i": F.row_number().over(w.orderBy("date")) - 1, "_n": F.count("*").over(w)})
    full = F.col("_n") >= test_days + warm_up + (folds - 1) * step
    n_folds = F.when(full, F.lit(folds)).otherwise(F.greatest(F.lit(1), F.floor((F.col("_n") - test_days - warm_up) / step) + 1).cast("int"))
    rows = rows.filter(F.col("_n") >= test_days + warm_up).select("*", F.explode(F.sequence(F.lit(1), n_folds)).alias("fold"), n_folds.alias("_k"))
    cut = F.col("_n") - (F.col("_k") - F.col("fold") + 1) * step
    split = rows.withColumn("_cut", cut).filter((F.col("_cut") >= 30) & (F.col("_i") < F.col("_cut") + test_days))
    is_test = F.col("_i") >= F.col("_cut")
    hidden, names = additive_columns(split.select(*keys, "fold", "date", F.when(~is_test, F.col("y")).alias("y")))
    actual = split.filter(is_test).select(*keys, "fold", "date", F.col("y").alias("actual"))
    group = [*keys, "fold"]
    return fit_predict(hidden, group, names).join(actual, [*group, "date"]).withColumnRenamed("predicted", "forecast")


def cross_validation_report(pairs: DataFrame, keys: Sequence[str] = ("district",)) -> DataFrame:
    """ML-09: mean and spread of the fold errors, R2 pooled over all pairs."""
    per_fold = C.error_metrics(pairs, [*keys, "fold"])
    pooled = C.error_metrics(pairs, list(keys)).select(*keys, "r2", F.col("n").alias("points"))
    return per_fold.groupBy(*keys).agg(
        F.avg("rmse").alias("rmse"), F.stddev_pop("rmse").alias("rmse_std"), F.avg("mae").alias("mae"), F.count("*").alias("fold_count")
    ).join(pooled, list(keys))


# --- tree models -----------------------------------------------------------------------------------------------------
ORIGIN_FEATURES = ("y", "lag_1", "lag_7", "lag_14", "lag_30", "lag_90", "diff_1", "diff_7", "rolling_mean_7", "rolling_mean_30",
                   "rolling_std_7", "rolling_min_7", "rolling_max_7", "price", "price_lag_7", "price_trend_7", "price_rolling_mean_7")
TARGET_FEATURES = ("day_of_week", "day_of_month", "month", "quarter", "week_of_year", "is_weekend", "is_month_start", "is_month_end",
                   "is_holiday", "days_to_holiday", "days_from_holiday", "is_long_weekend", "season")
DIRECT_FEATURES = ("h", *ORIGIN_FEATURES, *TARGET_FEATURES)


def direct_rows(features: DataFrame, horizon: int) -> DataFrame:
    """ML-06: one row per origin and horizon. What is known at the origin comes from the origin's row, the calendar from
    the target date, the label is the value of the target date (NULL when it lies ahead). All horizons are one training
    set, so a forecast of many days needs no chain of one-day forecasts."""
    origin = features.filter(F.col("y").isNotNull()).select("district", F.col("date").alias("origin"), *ORIGIN_FEATURES)
    pairs = origin.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn("date", F.date_add("origin", F.col("h")))
    label = features.select("district", "date", F.col("y").alias("label"))
    rows = pairs.join(label, ["district", "date"], "left")
    rows = T.holiday_features(T.calendar_features(rows))
    finite = {c: F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) < 1e9, F.coalesce(F.col(c).cast("double"), F.lit(0.0))).otherwise(0.0) for c in DIRECT_FEATURES}
    return rows.withColumns(finite)


class TreeForecaster:
    """ML-04: boosted trees and a random forest averaged, trained by Spark ML on all districts and horizons at once."""

    def __init__(self, trees: int = 300, depth: int = 5, learning_rate: float = 0.05, seed: int = 42):
        self.assembler = VectorAssembler(inputCols=list(DIRECT_FEATURES), outputCol="features", handleInvalid="keep")
        common = {"featuresCol": "features", "labelCol": "label", "maxDepth": depth, "seed": seed}
        self.boosted = GBTRegressor(maxIter=trees, stepSize=learning_rate, predictionCol="p_boosted", checkpointInterval=10, **common)
        self.forest = RandomForestRegressor(numTrees=max(20, trees // 10), predictionCol="p_forest", **common)

    def fit(self, rows: DataFrame) -> TreeForecaster:
        train = self.assembler.transform(rows.filter(F.col("label").isNotNull())).select("features", "label")
        self.boosted_model, self.forest_model = self.boosted.fit(train), self.forest.fit(train)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        scored = self.forest_model.transform(self.boosted_model.transform(self.assembler.transform(rows)))
        value = X.clip((F.col("p_boosted") + F.col("p_forest")) / 2, 0.0, 100.0)
        return scored.withColumn("predicted", value).drop("features", "p_boosted", "p_forest")

    def importance(self, spark) -> DataFrame:
        """ML-21: one row per feature and member; the vectors have as many entries as there are features."""
        rows = [
            (name, feature, float(v))
            for name, model in (("boosted", self.boosted_model), ("forest", self.forest_model))
            for feature, v in zip(DIRECT_FEATURES, model.featureImportances.toArray())
        ]
        return spark.createDataFrame(rows, "model string, feature string, importance double")


def residual_bands(scored: DataFrame, keys: Sequence[str] = ("h",), min_count: int = 20) -> DataFrame:
    """ML-05: 10 % and 90 % residual per horizon, +-1.28 RMSE where there are few. The quantile is the mergeable sketch,
    because residuals are real numbers and their exact buffer would grow with the data."""
    r = F.col("label") - F.col("predicted")
    rmse = F.sqrt(F.avg(r * r))
    q = F.percentile_approx(r, [0.1, 0.9], 10000)
    few = F.count("*") < min_count
    return scored.filter(F.col("label").isNotNull()).groupBy(*keys).agg(
        F.when(few, -1.28 * rmse).otherwise(q[0]).alias("low"), F.when(few, 1.28 * rmse).otherwise(q[1]).alias("high"), rmse.alias("rmse"))


def tree_forecast(features: DataFrame, horizon: int, holdout_days: int = 28, **settings) -> tuple[DataFrame, TreeForecaster]:
    """ML-04..06: fit on origins whose targets end before the hold-out, bands from the hold-out, forecast from the last
    origin of every district."""
    rows = direct_rows(features, horizon)
    last = features.filter(F.col("y").isNotNull()).select(F.max("date")).scalar()
    cut = F.date_sub(last, holdout_days)
    model = TreeForecaster(**settings).fit(rows.filter(F.col("date") <= cut))
    held = model.predict(rows.filter(F.col("date") > cut))
    bands = residual_bands(held).select("h", "low", "high")
    newest = rows.groupBy("district").agg(F.max("origin").alias("origin"))
    ahead = model.predict(rows.join(newest, ["district", "origin"], "left_semi"))
    out = ahead.join(bands, "h").select(
        "district", F.col("date").alias("forecast_date"), F.col("origin").alias("origin_date"), F.col("h").cast("int").alias("horizon"),
        F.lit("trees").alias("model"), F.col("predicted").alias("predicted_occupancy"),
        X.clip(F.col("predicted") + F.col("low"), 0.0, 100.0).alias("confidence_lower"),
        X.clip(F.col("predicted") + F.col("high"), 0.0, 100.0).alias("confidence_upper"))
    return out, model
