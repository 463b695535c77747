"""Table schemas and the fixed values of the domain."""

from __future__ import annotations

# Schemas are DDL text, which every reader accepts and which needs no running session.
HOTELS = (
    "id string not null, name string not null, city string, district string, lat double, lon double, rating double,"
    " min_price int, accommodation_type string, tripadvisor_rating double, tripadvisor_reviews int,"
    " tripadvisor_url string, image_url string, created_at timestamp, updated_at timestamp"
)
HOTEL_STATISTICS = (
    "id string not null, date date not null, rooms_num int, free_rooms_amount int, available_rooms_percent double,"
    " min_price int, max_capacity int, updated_at timestamp"
)
CAL_EVENTS = (
    "event_id string not null, title string not null, description string, date_start date not null, date_end date,"
    " event_type string, location string, source_id string not null, url string, time_start string, price_min int,"
    " price_max int, image_url string, address string, age_restriction string"
)
FORECASTS = (
    "district string, forecast_date date, origin_date date, horizon int, model string, predicted_occupancy double,"
    " confidence_lower double, confidence_upper double"
)
WEATHER = (
    "date date, temperature_max double, temperature_min double, precipitation double, wind_speed double,"
    " weather_code int"
)

# --- fixed values: geography ---------------------------------------------------------------------------------------
CITY_TO_DISTRICT = {
    "иркутск": "Иркутский",
    "листвянка": "Иркутский",
    "никола": "Иркутский",
    "хужир": "Ольхонский",
    "сахюрта": "Ольхонский",
    "куркут": "Ольхонский",
    "сарма": "Ольхонский",
    "бугульдейка": "Ольхонский",
    "байкальск": "Слюдянский",
    "слюдянка": "Слюдянский",
    "утулик": "Слюдянский",
    "мурино": "Слюдянский",
    "мангутай": "Слюдянский",
    "выдрино": "Кабанский",
    "горячинск": "Прибайкальский",
    "турка": "Прибайкальский",
    "гремячинск": "Прибайкальский",
    "максимиха": "Баргузинский",
    "усть-баргузин": "Баргузинский",
    "энхалук": "Кабанский",
    "сухая": "Кабанский",
    "талое": "Кабанский",
    "ангарск": "Ангарский",
    "шелехов": "Шелеховский",
    "братск": "Братский",
    "нижнеудинск": "Нижнеудинский",
    "усть-кут": "Усть-Кутский",
    "саянск": "Зиминский",
    "северобайкальск": "Северобайкальский",
    "улан-удэ": "Улан-Удэ",
    "аршан": "Тункинский",
    "агалуй": "Слюдянский",
}
DISTRICT_CENTERS = {
    "Иркутский": (52.2978, 104.2964),
    "Ольхонский": (53.1947, 107.3386),
    "Слюдянский": (51.6600, 103.7100),
    "Ангарский": (52.5437, 103.8880),
    "Прибайкальский": (52.9800, 108.2500),
    "Кабанский": (52.0500, 106.6000),
    "Баргузинский": (53.4230, 109.0190),
    "Северобайкальский": (55.6350, 109.3210),
    "Тункинский": (51.9100, 102.4300),
    "Братский": (56.1325, 101.6140),
    "Шелеховский": (52.2147, 104.1006),
    "Нижнеудинский": (54.9070, 99.0280),
    "Усть-Кутский": (56.7940, 105.7580),
    "Зиминский": (53.9220, 102.0480),
    "Улан-Удэ": (51.8340, 107.5930),
}
DISTRICTS = tuple(DISTRICT_CENTERS)
DEFAULT_DISTRICT = "Иркутский"
DEFAULT_COORDS = (52.2978, 104.2964)
CITY_SLUGS = {
    "irkutsk": "Иркутск",
    "leestvyanka": "Листвянка",
    "huzhir": "Хужир",
    "baikalsk": "Байкальск",
    "angarsk": "Ангарск",
    "nikola": "Никола",
    "sahyurta": "Сахюрта",
    "goryachinsk": "Горячинск",
    "turka": "Турка",
    "suhaya": "Сухая",
    "enheluk": "Энхалук",
    "severobaykalsk": "Северобайкальск",
    "ust-barguzin": "Усть-Баргузин",
    "buguldeyka": "Бугульдейка",
    "sarma": "Сарма",
    "kurkut": "Куркут",
    "maksimiha": "Максимиха",
    "vidrino": "Выдрино",
    "mangutay": "Мангутай",
    "taloe": "Талое",
    "murino_1": "Мурино",
    "ulan-ude": "Улан-Удэ",
    "agaluy": "Агалуй",
    "bratsk": "Братск",
    "nizhneudinsk": "Нижнеудинск",
    "ust-kut": "Усть-Кут",
    "sayansk": "Саянск",
    "shelehov": "Шелехов",
    "gremyachinsk": "Гремячинск",
    "utulik": "Утулик",
    "arshan": "Аршан",
}

# --- fixed values: seasons, weather, thresholds --------------------------------------------------------------------
SEASON_MONTHS = {"winter": (12, 1, 2, 3), "spring": (4, 5), "summer": (6, 7, 8, 9), "autumn": (10, 11)}
HIGH_SEASON_MONTHS = (6, 7, 8)
WINTER_SEASON_MONTHS = (12, 1, 2, 3)
OFFSEASON_MONTHS = (10, 11)
MONTH_NAMES = (
    "январь", "февраль", "март", "апрель", "май", "июнь",
    "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь",
)
MONTH_MEAN_TEMPERATURE = (-18, -15, -6, 3, 10, 16, 19, 16, 10, 2, -8, -15)
MIN_SAMPLES_PER_MONTH = 1
MIN_SAMPLES_FOR_HIGH_CONFIDENCE = 3
DISTRICT_SAMPLE_MIN = 4
DISTRICT_SAMPLE_HIGH = 10
MIN_EVENT_EPISODES = 10
PLACEBO_ROUNDS = 2000
SEGMENT_WINDOW_DAYS = 14
MAX_FORECAST_HORIZON_DAYS = 14
WARM_TEMPERATURE = 15.0
COLD_TEMPERATURE = -15.0
LOW_PRECIPITATION = 5.0
EVENT_SEARCH_RANGE_DAYS = (-3, 7)
HOLIDAY_SEARCH_RANGE_DAYS = 14
MAJOR_EVENT_TYPES = ("concert", "festival", "sport")
LAG_DAYS = (1, 7, 14, 30, 90)
DIFF_DAYS = (1, 7)
IMPACT = {
    "holiday": 15.0,
    "weekend": 8.0,
    "high_season": 20.0,
    "winter_season": 10.0,
    "offseason": -10.0,
    "event_nearby": 5.0,
    "good_weather": 5.0,
    "cold_weather": -5.0,
}
# -------------------------------------------------------------------------------------------------------------------
