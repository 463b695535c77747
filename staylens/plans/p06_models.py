"""Models, their back-tests and what is read from them. Fits have no SQL counterpart; their inputs and roll-ups do."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.operators import forecasts as C
from staylens.operators import market as K
from staylens.operators import models as MO
from staylens.plans import p04_series as P4
from staylens.plans.registry import query
from staylens.session import materialise


def series(t):
    return t.district_daily.select("district", "date", F.col("occupancy").alias("y"))


def hotel_series(t):
    return t.stats.select("id", "date", (100 - F.coalesce("available_rooms_percent", F.lit(0.0))).alias("y"))


@query("ml03_additive_forecast")
def _(t):
    return MO.additive_forecast(series(t), 14)


@query("ud03_per_group_fit")
def _(t):
    return MO.additive_forecast(hotel_series(t), 7, ["id"])


@query("ml09_walk_forward_validation")
def _(t):
    return MO.cross_validation_report(MO.walk_forward(series(t)))


@query("ml12_hotel_holdout")
def _(t):
    return C.error_metrics(MO.holdout(hotel_series(t), ["id"]), ["id"])


@query("ag38_backtest_rollup")
def _(t):
    top = K.top_candidates(t.stats, t.hotels, 20)
    picked = hotel_series(t).join(top.select("id"), "id", "left_semi")
    metrics = C.error_metrics(MO.holdout(picked, ["id"]), ["id"])
    return C.nearest_rank(metrics, [], ["rmse", "mae", "r2"], [0.25, 0.5, 0.75])


@query("ag38_nearest_rank", """WITH r AS (SELECT district, occupancy, row_number() OVER (PARTITION BY district ORDER BY occupancy) - 1 AS i, count(*) OVER (PARTITION BY district) AS n FROM district_daily)
    SELECT district, """ + ", ".join(f"round(max(occupancy) FILTER (WHERE i = round_even({p} * (n - 1), 0)), 6) AS occupancy_p{int(p * 100)}" for p in (0.25, 0.5, 0.75)) + " FROM r GROUP BY district")
def _(t):
    return C.nearest_rank(t.district_daily, ["district"], ["occupancy"], [0.25, 0.5, 0.75])


def trees(t):
    features = materialise(P4.features(t))
    return MO.tree_forecast(features, 7, trees=10)


@query("ml04_tree_forecast")
def _(t):
    return trees(t)[0]


@query("ml05_residual_bands")
def _(t):
    rows = t.forecasts.join(t.district_daily.select("district", F.col("date").alias("forecast_date"), F.col("occupancy").alias("label")), ["district", "forecast_date"])
    return MO.residual_bands(rows.withColumn("predicted", F.col("predicted_occupancy")), ["horizon"])


@query("ml06_direct_rows", """SELECT a.district, CAST(a.date AS VARCHAR) AS origin, CAST(h AS DOUBLE) AS h, CAST(a.date + CAST(h AS INTEGER) AS VARCHAR) AS date, round(a.occupancy, 6) AS y, round(b.occupancy, 6) AS label
    FROM district_daily a, (SELECT unnest(range(1, 4)) AS h) LEFT JOIN district_daily b ON b.district = a.district AND b.date = a.date + CAST(h AS INTEGER)""")
def _(t):
    return MO.direct_rows(P4.features(t), 3).select("district", "origin", "h", "date", "y", "label")


@query("ml21_feature_importance")
def _(t):
    return trees(t)[1].importance(t.spark)
