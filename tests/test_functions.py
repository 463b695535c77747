"""Golden values of the text, date and metric functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from staylens.functions import dates as D
from staylens.functions import metrics as X
from staylens.functions import stats
from staylens.functions import text as S
from staylens.functions.similarity import token_set_ratio



def today():
    return F.lit("2026-02-10").cast("date")


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn("v").alias("r")).first()[0]


@pytest.mark.parametrize("text,want", [
    ("от 500 руб.", 500), ("от 1500₽", 1500), ("Бесплатно", None), ("от 100 р.", 100), ("от 250 рублей", 250)])
def test_price_from(spark, text, want):
    assert one(spark, text, S.price_from) == want


@pytest.mark.parametrize("text,want", [("16+", "16+"), ("0+", None), ("45+", None), ("для 6 + лет", "6+"), ("всем", None)])
def test_age_limit(spark, text, want):
    assert one(spark, text, S.age_limit) == want


@pytest.mark.parametrize("text,want", [("12-99", "12+"), ("0-99", None), ("18+", "18+")])
def test_age_range(spark, text, want):
    assert one(spark, text, S.age_range) == want


@pytest.mark.parametrize("text,want", [
    ("15 февраля", "2026-02-15"), ("3 марта 2026", "2026-03-03"), ("15.02.2026", "2026-02-15"), ("5 января", "2027-01-05"),
    ("7.3.25", "2025-03-07"), ("31 февраля", None), ("скоро", None)])
def test_russian_date(spark, text, want):
    got = one(spark, text, lambda v: D.russian_date(v, today()))
    assert (got and got.isoformat()) == want


def test_russian_range(spark):
    a = spark.createDataFrame([("15-22 марта",), ("с 1 апреля по 7 мая",), ("22-15 марта",)], "v string")
    s, e = D.russian_range("v", today())
    rows = [(str(r[0]), str(r[1])) for r in a.select(s, e).collect()]
    assert rows == [("2026-03-15", "2026-03-22"), ("2026-04-01", "2026-05-07"), ("2026-03-22", "None")]


@pytest.mark.parametrize("text,want", [("18:00", "18:00:00"), ("18:00:30", "18:00:30"), ("junk", None), ("25:00", None)])
def test_clock_time(spark, text, want):
    assert one(spark, text, D.clock_time) == want


def test_title_key(spark):
    assert one(spark, "  «Маштаков».  Концерт!! ", S.title_key) == "маштаков концерт"


def test_redaction(spark):
    got = one(spark, "x://u:p@h password=1 api_key=2 token = 3", S.redact)
    assert got == "x[REDACTED]h [REDACTED] [REDACTED] [REDACTED]"


def test_event_types(spark):
    df = spark.createDataFrame([("Лекторий вечером", ""), ("Встреча", "большой концерт"), ("Сбор", "")], "t string, d string")
    assert [r[0] for r in df.select(S.event_type("t", "d")).collect()] == ["lecture", "concert", "event"]


def test_holidays(spark):
    df = spark.createDataFrame([(dt.date(2026, 5, 8),), (dt.date(2026, 11, 5),), (dt.date(2026, 1, 7),)], "d date")
    rows = df.select(D.days_to_holiday(F.col("d"), 60), D.is_holiday(F.col("d")), D.days_since_holiday(F.col("d"))).collect()
    assert [tuple(r) for r in rows] == [(1, False, 7), (57, False, 1), (0, True, 0)]


def test_percentiles(spark):
    values = [10, 20, 30, 40, 50, 60, 70, 80, 90, 100]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    assert df.select(F.percentile("v", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.1), F.lit(1.0), F.lit(0.0)))).first()[0] == pytest.approx([55, 91, 19, 100, 10])


def test_unknown_availability_counts_as_full(spark):
    df = spark.createDataFrame([(10, None), (10, 50.0), (20, 150.0)], "rooms_num int, available_rooms_percent double")
    assert df.select(X.weighted_occupancy()).first()[0] == pytest.approx(100 * (10 + 5 + 0) / 40)


def test_token_set_ratio():
    assert token_set_ratio("маштаков концерт", "концерт маштакова") > 88
    assert token_set_ratio("концерт", "концерт группы х") == 100
    assert token_set_ratio("", "x") == 0
    assert token_set_ratio("abcd", "wxyz") == 0
    assert token_set_ratio("концерт", "концерты") == pytest.approx(100 * (1 - 1 / 15))


def test_student_quantile():
    assert stats.student_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert stats.student_quantile(0.975, 1) == pytest.approx(12.7062, abs=1e-3)


def test_texts_are_not_cut(spark):
    from staylens.functions import text as S
    from pyspark.sql import functions as F

    long = "слово " * 400
    df = spark.createDataFrame([(long + "конец один",), (long + "конец два",)], "t string")
    r = df.select(S.title_key("t").alias("k"), S.clean_text("t").alias("c"), S.clean_html("t").alias("h"), S.redact("t").alias("r"), S.clean_text("t", 20).alias("s")).collect()
    assert r[0].k != r[1].k and all(x.c.endswith(("один", "два")) and x.h == x.c and len(x.r) > 2000 for x in r)
    assert all(len(x.s) == 20 and x.s.endswith("...") for x in r)


def test_slug_table_and_places(spark):
    from staylens.functions import text as S
    from staylens.operators import extraction as X
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Щёлково, объезд-2 №1", "Где: ул. Ленина 5\nтеатр", "📍 Дом кино\nМесто: парк", "Приходите. В большой театр «Муза» сегодня")], "a string, b string, c string, d string")
    r = df.select(S.ascii_slug("a").alias("a"), S.location_from_block("b").alias("b"), X.post_location(F.col("c")).alias("c"), X.post_location(F.col("d")).alias("d")).first()
    assert (r.a, r.b, r.c) == ("schyolkovo_obezd_2_1", "ул. Ленина 5", "Дом кино")
    assert r.d == "большой театр «Муза»"
