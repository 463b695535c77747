"""All thirteen named questions, from Python and, where they read stored rows only, the same from SQL."""

import pytest
from pyspark.sql import functions as F

from staylens import catalog
from staylens.operators import effect as FX
from staylens.plans import p02_events as P2
from staylens.session import materialise
from staylens.sources.adapters import Tables


@pytest.fixture(scope="module")
def t(spark, sf_dir):
    return Tables(spark, sf_dir)


def test_every_question_has_an_answer(t):
    c = catalog.Catalog(t, F.lit("1997-06-28").cast("date"))
    answers = {
        "hotels": c.search_hotels("ASIA"), "events": c.search_events("urgent"), "weather": c.get_weather(7), "forecast": c.forecast_occupancy(3), "statistics": c.get_statistics(),
        "revenue": c.get_revenue_metrics(90), "effect": c.get_event_effect(rounds=3), "pace": c.get_booking_pace(), "districts": c.compare_districts(["ASIA", "EUROPE"], 365),
        "models": c.compare_forecast_models(), "series": c.get_occupancy_timeseries(30), "prices": c.get_price_distribution(365), "segments": c.get_segment_benchmark()}
    assert len(answers) == 13
    rows = {name: df.collect() for name, df in answers.items()}
    assert {r["district"] for r in rows["districts"]} <= {"ASIA", "EUROPE"}
    assert all(r["date"].isoformat() >= "1997-05-29" for r in rows["series"]) and rows["series"]
    assert all(rows[k] for k in ("statistics", "forecast", "models", "prices"))


def test_functions_agree_with_the_questions(spark, t):
    c = catalog.Catalog(t, F.lit("1997-06-28").cast("date"))
    effect = materialise(FX.verdict(FX.event_effect(t.district_daily, P2.event_days(t, "festival"), 3)))
    catalog.register(spark, t, effect)
    assert spark.sql("SELECT * FROM event_effect(NULL)").collect() == effect.collect()
    verdict = effect.first()["verdict"]
    assert {r["verdict"] for r in spark.sql(f"SELECT * FROM event_effect('{verdict}')").collect()} == {verdict}
    assert spark.sql("SELECT * FROM event_effect('nothing of the kind')").collect() == []
    models = {r["model"]: r["mae"] for r in c.compare_forecast_models().filter("district = 'ASIA'").collect()}
    assert {r["model"]: r["mae"] for r in spark.sql("SELECT * FROM compare_forecast_models('ASIA')").collect()} == pytest.approx(models)
    series = {r["date"]: r["avg_occupancy"] for r in c.get_occupancy_timeseries(60).filter("district = 'ASIA'").collect()}
    assert {r["date"]: r["occupancy"] for r in spark.sql("SELECT * FROM occupancy_timeseries('ASIA', date_sub(DATE'1997-06-28', 60))").collect()} == pytest.approx(series)
