"""Date expressions. Reference dates are parameters; nothing reads the clock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens import model as M
from staylens.functions.metrics import col
from staylens.functions.text import extract

# --- fixed values: month names in the genitive and the nominative ----------------------------------------------------
MONTHS_GENITIVE = (
    "января", "февраля", "марта", "апреля", "мая", "июня",
    "июля", "августа", "сентября", "октября", "ноября", "декабря",
)
# -------------------------------------------------------------------------------------------------------------------
_NAMES = MONTHS_GENITIVE + M.MONTH_NAMES


def month_number(name: Column) -> Column:
    """1..12 for a Russian month name in either case, NULL otherwise."""
    pos = F.array_position(F.array(*[F.lit(m) for m in _NAMES]), name)
    return F.when(pos > 0, (pos - 1) % 12 + 1).cast("int")


def make(year: Column, month: Column, day: Column) -> Column:
    """A date, or NULL when the parts do not name one."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), two(month), two(day)), "yyyy-MM-dd")


def rolled_year(month: Column, day: Column, today: Column) -> Column:
    """This year, or the next when month and day have passed."""
    passed = (month < F.month(today)) | ((month == F.month(today)) & (day < F.dayofmonth(today)))
    return F.year(today) + F.when(passed, 1).otherwise(0)


def date_parts(text: str | Column) -> dict[str, Column]:
    """What `russian_date` reads of a text: numbers and names of both ways to write a date."""
    c = F.lower(F.trim(col(text)))
    named = r"(\d{1,2})\s+([\p{L}\p{N}_]+)(?:\s+(\d{4}))?"
    dotted = r"(\d{1,2})\.(\d{1,2})(?:\.(\d{2,4}))?"
    whole = lambda pattern, i: extract(c, pattern, i).try_cast("int")
    return {"_day": whole(named, 1), "_month": month_number(extract(c, named, 2)), "_year": whole(named, 3),
            "_d2": whole(dotted, 1), "_m2": whole(dotted, 2), "_y2": whole(dotted, 3)}


def date_of(parts: dict[str, Column], today: Column) -> Column:
    day, month, d2, m2, y2 = (parts[c] for c in ("_day", "_month", "_d2", "_m2", "_y2"))
    year = F.coalesce(parts["_year"], rolled_year(month, day, today))
    y2 = F.when(y2 < 100, y2 + 2000).otherwise(F.coalesce(y2, F.year(today)))
    return F.when(month.isNotNull(), make(year, month, day)).otherwise(make(y2, m2, d2))


def russian_date(text: str | Column, today: Column) -> Column:
    """SC-17: 'D month [YYYY]' with the year rolled forward when it is not given, else 'D.M[.YY[YY]]'. The result names each part several times;
    over many rows, compute `date_parts` as columns first and take `date_of` them."""
    return date_of(date_parts(text), today)


def russian_range(text: str | Column, today: Column) -> tuple[Column, Column]:
    """SC-18: 'с 1 апреля по 7 мая' or '15-22 марта'; an end not after the start is dropped."""
    c = F.lower(col(text))
    names = "|".join(MONTHS_GENITIVE)
    two = rf"с\s+(\d{{1,2}})\s+({names})\s+(?:по|до)\s+(\d{{1,2}})\s+({names})"
    one = rf"(?:с\s+)?(\d{{1,2}})\s*[-–—]\s*(\d{{1,2}})\s+({names})"
    d1, m1 = extract(c, two, 1).try_cast("int"), month_number(extract(c, two, 2))
    d2, m2 = extract(c, two, 3).try_cast("int"), month_number(extract(c, two, 4))
    y = rolled_year(m1, d1, today)
    a, b, m = extract(c, one, 1).try_cast("int"), extract(c, one, 2).try_cast("int"), month_number(extract(c, one, 3))
    z = rolled_year(m, a, today)
    start = F.when(m1.isNotNull(), make(y, m1, d1)).otherwise(make(z, m, a))
    end = F.when(m1.isNotNull(), make(y, m2, d2)).when(b > a, make(z, m, b))
    return start, end


# --- fixed values: relative phrases in the order they are tried, as days from the post date or the next weekday ------
RELATIVE_DAYS = {"послезавтра": 2, "завтра": 1, "через неделю": 7, "через 2 дня": 2, "через два дня": 2,
                 "через три дня": 3, "на этой неделе": 0, "на следующей неделе": 7, "сегодня": 0}
RELATIVE_WEEKDAYS = {"в субботу": "SAT", "в воскресенье": "SUN", "в пятницу": "FRI", "в четверг": "THU", "в среду": "WED",
                     "во вторник": "TUE", "в понедельник": "MON", "в эти выходные": "SAT"}
# -------------------------------------------------------------------------------------------------------------------


def relative_date(text: str | Column, posted: Column) -> Column:
    """SC-21: 'завтра', 'в субботу' and the like against the post date; the nearest future day wins for weekdays."""
    low = F.lower(col(text))
    tries = [F.when(F.contains(low, F.lit(p)), F.date_add(posted, n)) for p, n in RELATIVE_DAYS.items()]
    tries += [F.when(F.contains(low, F.lit(p)), F.next_day(posted, d)) for p, d in RELATIVE_WEEKDAYS.items()]
    return F.coalesce(*tries)


def clock_time(text: str | Column) -> Column:
    """SC-19: 'HH:MM[:SS]' as 'HH:mm:ss', anything else NULL."""
    c = F.trim(col(text))
    p = r"^(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?$"
    h, m, s = (F.regexp_extract(c, p, i) for i in (1, 2, 3))
    ok = c.rlike(p) & (h.try_cast("int") < 24) & (m.try_cast("int") < 60) & (F.coalesce(s.try_cast("int"), F.lit(0)) < 60)
    two = lambda x: F.lpad(x, 2, "0")
    return F.when(ok, F.concat_ws(":", two(h), two(m), two(s)))


def coerce_date(text: str | Column) -> Column:
    """SC-20: ISO text (first ten characters) or whole days since 1970-01-01."""
    c = F.trim(col(text))
    return F.coalesce(
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.left(c, F.lit(10)), "yyyy-MM-dd")),
        F.when(c.rlike(r"^-?\d{1,7}$"), F.date_add(F.lit("1970-01-01").cast("date"), c.try_cast("int"))),
    )


def iso_parts(start: str | Column, end: str | Column) -> tuple[Column, Column, Column]:
    """SC-22: (date, HH:MM, end date when it differs) of ISO date-time texts."""
    s, e = col(start), col(end)
    day, last = coerce_date(s), coerce_date(e)
    return day, extract(s, r"T(\d{2}:\d{2})"), F.nullif(last, day)


def season_range(focus: Column, season: str) -> tuple[Column, Column]:
    """SC-24: the most recent run of a season that has begun by the focus date."""
    y, m = F.year(focus), F.month(focus)
    if season == "winter":
        start_year = F.when(m < 4, y - 1).otherwise(y)
        return make(start_year, F.lit(12), F.lit(1)), make(start_year + 1, F.lit(3), F.lit(31))
    first, last = min(M.SEASON_MONTHS[season]), max(M.SEASON_MONTHS[season])
    year = F.when(m < first, y - 1).otherwise(y)
    return make(year, F.lit(first), F.lit(1)), F.last_day(make(year, F.lit(last), F.lit(1)))


def period_range(focus: Column, days: int) -> tuple[Column, Column]:
    """SC-24: the trailing period that ends on the focus date."""
    return F.date_sub(focus, days - 1), focus


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """SC-24."""
    return (a_from <= b_to) & (a_to >= b_from)


def calendar_columns(day: str | Column) -> dict[str, Column]:
    """SC-25: calendar features; weekday 0 is Monday."""
    d = col(day)
    return {
        "day_of_week": F.weekday(d),
        "day_of_month": F.dayofmonth(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "week_of_year": F.weekofyear(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_month_end": (d == F.last_day(d)).cast("int"),
    }


# --- fixed values: public holidays by month and day, school breaks by start and end ----------------------------------
PUBLIC_HOLIDAYS = (
    (1, 1, "Новогодние каникулы"), (1, 2, "Новогодние каникулы"), (1, 3, "Новогодние каникулы"),
    (1, 4, "Новогодние каникулы"), (1, 5, "Новогодние каникулы"), (1, 6, "Новогодние каникулы"),
    (1, 7, "Рождество Христово"), (1, 8, "Новогодние каникулы"), (2, 23, "День защитника Отечества"),
    (3, 8, "Международный женский день"), (5, 1, "Праздник Весны и Труда"), (5, 9, "День Победы"),
    (6, 12, "День России"), (11, 4, "День народного единства"),
)
SCHOOL_BREAKS = (
    ("2024-10-26", "2024-11-03", "Осенние каникулы"),
    ("2024-12-28", "2025-01-08", "Зимние каникулы"),
    ("2025-03-22", "2025-03-30", "Весенние каникулы"),
    ("2025-05-26", "2025-08-31", "Летние каникулы"),
    ("2025-10-25", "2025-11-04", "Осенние каникулы"),
    ("2025-12-31", "2026-01-11", "Зимние каникулы"),
    ("2026-02-21", "2026-03-01", "Дополнительные каникулы (1 класс)"),
    ("2026-03-28", "2026-04-05", "Весенние каникулы"),
    ("2026-05-27", "2026-08-31", "Летние каникулы"),
)
# -------------------------------------------------------------------------------------------------------------------


def holiday_name(day: Column) -> Column:
    """Name of the public holiday on a date, NULL on ordinary days. The rule needs no table and no join."""
    key = F.date_format(day, "MM-dd")
    pairs = [F.lit(x) for m, d, n in PUBLIC_HOLIDAYS for x in (f"{m:02d}-{d:02d}", n)]
    return F.try_element_at(F.create_map(*pairs), key)


def is_holiday(day: Column) -> Column:
    return F.date_format(day, "MM-dd").isin([f"{m:02d}-{d:02d}" for m, d, _ in PUBLIC_HOLIDAYS])


def days_to_holiday(day: Column, limit: int = 30) -> Column:
    """Days to the next public holiday, 0 on one, capped; each holiday is tried this year and the next."""
    tries = []
    for m, d, _ in PUBLIC_HOLIDAYS:
        this = F.make_date(F.year(day), F.lit(m), F.lit(d))
        nxt = F.make_date(F.year(day) + 1, F.lit(m), F.lit(d))
        tries.append(F.datediff(F.when(this >= day, this).otherwise(nxt), day))
    return F.least(F.lit(limit), *tries)


def days_since_holiday(day: Column, limit: int = 30) -> Column:
    tries = []
    for m, d, _ in PUBLIC_HOLIDAYS:
        this = F.make_date(F.year(day), F.lit(m), F.lit(d))
        prev = F.make_date(F.year(day) - 1, F.lit(m), F.lit(d))
        tries.append(F.datediff(day, F.when(this <= day, this).otherwise(prev)))
    return F.least(F.lit(limit), *tries)


def is_long_weekend(day: Column) -> Column:
    """A holiday on a Monday or Friday within three days either side."""
    near = [F.date_add(day, i) for i in range(-3, 4)]
    return reduce(lambda a, b: a | b, [is_holiday(d) & F.weekday(d).isin(0, 4) for d in near])


def is_school_break(day: Column) -> Column:
    return reduce(lambda a, b: a | b, [day.between(F.lit(s).cast("date"), F.lit(e).cast("date")) for s, e, _ in SCHOOL_BREAKS])


def days_to_school_break(day: Column, limit: int = 30) -> Column:
    starts = [F.when(F.lit(s).cast("date") > day, F.datediff(F.lit(s).cast("date"), day)) for s, _, _ in SCHOOL_BREAKS]
    return F.when(is_school_break(day), 0).otherwise(F.least(F.lit(limit), *starts))


def holiday_columns(day: str | Column) -> dict[str, Column]:
    """SC-26."""
    d = col(day)
    return {
        "is_holiday": is_holiday(d),
        "holiday_name": holiday_name(d),
        "days_to_holiday": days_to_holiday(d),
        "is_long_weekend": is_long_weekend(d),
        "is_pre_holiday": is_holiday(F.date_add(d, 1)),
        "is_post_holiday": is_holiday(F.date_sub(d, 1)),
        "is_school_holiday": is_school_break(d),
        "days_to_school_holiday": days_to_school_break(d),
    }
