"""The effect queries take the days of every event, as the reference does."""

from pyspark.sql import functions as F

import __spark_entry__ as entrypoint


def test_effect_queries_take_all_event_days(spark):
    sf = "/root/testdata/sf0.01"
    queries = entrypoint.queries()
    kept = queries["ml15_informative_cells_all_events"](spark, sf)
    days = queries["jn07_event_days"](spark, sf).select("district", "date", F.lit(1).alias("e"))
    flagged = kept.join(days, ["district", "date"], "left")
    assert flagged.where(F.coalesce("e", F.lit(0)) != F.col("is_event")).count() == 0
    want = {r.district: r.n for r in kept.groupBy("district").agg(F.sum("is_event").alias("n")).collect() if r.n}
    got = queries["wn21_shifted_calendars"](spark, sf).groupBy("district").agg(F.max("days").alias("n")).collect()
    assert got and all(0 < r.n <= want[r.district] for r in got)
    star = {r.scope: r.n_obs for r in queries["ml16_cross_products_all_events"](spark, sf).collect()}
    assert star["*"] == kept.count()
    assert {r.scope: r.n_obs for r in queries["ml17_effect_with_clustered_errors"](spark, sf).collect()}["*"] == star["*"]
