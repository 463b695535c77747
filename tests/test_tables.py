"""Merges, streams and history features."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from staylens import model as M
from staylens.operators import models as MO
from staylens.operators import timeseries as T
from staylens.operators import upsert as U
from staylens.streaming import jobs as J
from staylens.streaming import state as ST

DAY = dt.date(2026, 1, 1)


def test_hotel_merge_keeps_picture_and_kind(spark):
    schema = "id string, name string, min_price int, accommodation_type string, image_url string"
    old = spark.createDataFrame([("1", "a", 5, "hotel", "p"), ("2", "b", 6, None, None)], schema)
    new = spark.createDataFrame([("1", "a2", None, None, None), ("3", "c", 7, "hostel", "q"), ("", "x", 1, None, None), ("4", None, 1, None, None)], schema)
    got = {tuple(r) for r in U.merge_hotels(old, new).collect()}
    assert got == {("1", "a2", None, "hotel", "p"), ("2", "b", 6, None, None), ("3", "c", 7, "hostel", "q")}


def test_event_merge_is_idempotent_and_keeps_first_id(spark):
    schema = "source_id string, date_start date, title string, event_id string, description string, ord int"
    old = spark.createDataFrame([("s", DAY, "t", "e1", "text", 0)], schema)
    new = spark.createDataFrame([("s", DAY, "t", "e2", None, 1), ("s", DAY, "t", "e3", "newer", 2), ("s", DAY, "u", "e4", None, 1)], schema)
    once = U.merge_events(old.drop("ord"), new, "ord")
    twice = U.merge_events(once, new, "ord")
    want = {("s", DAY, "t", "e1", "newer"), ("s", DAY, "u", "e4", None)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def test_stored_table_rewrites_only_touched_partitions(spark, tmp_path):
    table = U.statistics_table(spark, str(tmp_path / "stats"))
    row = lambda i, d, rooms: (i, d, rooms, 0, 0.0, 1, 1, None)
    how = lambda old, new: U.overwrite(old, new, ["id", "date"])
    df = lambda rows: spark.createDataFrame(rows, M.HOTEL_STATISTICS)
    table.merge(df([row("a", dt.date(2026, 1, 1), 5), row("a", dt.date(2026, 2, 1), 6)]), M.HOTEL_STATISTICS, how)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "stats" / "month=2026-01").iterdir() if p.suffix == ".parquet"}
    for _ in range(2):
        table.merge(df([row("a", dt.date(2026, 2, 1), 9), row("b", dt.date(2026, 2, 2), 1)]), M.HOTEL_STATISTICS, how)
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "stats" / "month=2026-01").iterdir() if p.suffix == ".parquet"}
    assert before == after
    got = {(r["id"], str(r["date"]), r["rooms_num"]) for r in spark.read.parquet(table.path).collect()}
    assert got == {("a", "2026-01-01", 5), ("a", "2026-02-01", 9), ("b", "2026-02-02", 1)}


def test_quarantine(spark):
    from staylens.sources.tables import check_rows, hotel_rules

    rows = spark.createDataFrame([("a", 5.0, 10), ("b", 11.0, 10), ("", 5.0, 10), ("c", None, -1)], "name string, rating double, min_price int")
    good, bad = check_rows(rows, hotel_rules())
    assert [r["name"] for r in good.collect()] == ["a"]
    assert sorted(r["reason"] for r in bad.collect()) == ["name", "price", "rating"]


def stream_of(spark, tmp_path, df, name):
    df.write.parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def run(spark, tmp_path, stream, name):
    J.drain(stream.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")), str(tmp_path / f"{name}-cp"))
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def test_rate_limit_equals_replay(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(k, i, rnd.random() * 300) for i, k in enumerate(rnd.choice([1, 1, 1, 2, 3]) for _ in range(200))]
    df = spark.createDataFrame(rows, "key long, request_id long, s double").select("key", "request_id", F.timestamp_seconds(F.col("s") + 1e9).alias("event_time"))
    got = {r["request_id"]: r["allowed"] for r in run(spark, tmp_path, ST.rate_limit(stream_of(spark, tmp_path, df.coalesce(1), "req"), 5, 60.0), "req").collect()}
    want = {}
    for key in {r[0] for r in rows}:
        kept = []
        for _, i, at in sorted((r for r in rows if r[0] == key), key=lambda r: r[2]):
            kept = [t for t in kept if t > at - 60]
            want[i] = len(kept) < 5
            if want[i]:
                kept.append(at)
    assert got == want and not all(want.values())


def test_source_health_transitions():
    state, seen = ST.START, []
    for count, ok in [(10, True), (0, False), (0, False), (0, False), (10, True), (2, True), (0, True)]:
        state, alerts = ST.step(state, count, ok, 0.0)
        seen.append((ST.status_of(state[2], state[3], state[0]), alerts))
    assert seen == [("OK", []), ("WARNING", ["WARNING"]), ("WARNING", []), ("CRITICAL", ["CRITICAL"]), ("OK", ["RECOVERED"]), ("OK", ["LOW_DATA"]), ("WARNING", ["WARNING"])]


def test_streamed_windows_equal_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    late = events.agg(F.max("ts")).first()[0]
    end = events.limit(1).withColumn("ts", F.lit(late) + F.expr("interval 30 days"))
    events.write.parquet(str(tmp_path / "ev"))
    end.write.mode("append").parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    got = run(spark, tmp_path, J.tumbling_counts(stream), "win")
    want = J.tumbling_counts(events)
    key = lambda df: sorted((str(r["window_start"]), r["event_type"], r["n"]) for r in df.collect())
    assert key(got) == key(want)


def test_holdout_features_see_no_test_value(spark):
    rows = [("d", DAY + dt.timedelta(days=i), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "district string, date date, y double")
    full = T.holdout_features(T.rolling_features(T.lag_features(df)), 14)
    got = {r["date"]: r for r in full.collect()}
    last = got[DAY + dt.timedelta(days=59)]
    assert last["is_test"] and last["lag_1"] == 45.0 and last["lag_14"] == 45.0 and last["diff_1"] == 0.0
    first = got[DAY + dt.timedelta(days=46)]
    assert first["lag_1"] == 45.0 and first["lag_7"] == 39.0 and first["rolling_mean_7"] == pytest.approx(sum(range(38, 45)) / 7)
    assert not got[DAY + dt.timedelta(days=45)]["is_test"]


def test_additive_model_follows_weekly_pattern(spark):
    rows = [("d", DAY + dt.timedelta(days=i), 50.0 + (20.0 if (DAY + dt.timedelta(days=i)).weekday() >= 5 else 0.0)) for i in range(140)]
    df = spark.createDataFrame(rows, "district string, date date, y double")
    out = {r["date"]: r["predicted"] for r in MO.additive_forecast(df, 7).collect()}
    assert len(out) == 7
    assert all(abs(v - (70 if d.weekday() >= 5 else 50)) < 6 for d, v in out.items())


def test_walk_forward_folds(spark):
    rows = [("d", DAY + dt.timedelta(days=i), float(50 + i % 7)) for i in range(150)]
    df = spark.createDataFrame(rows, "district string, date date, y double")
    pairs = MO.walk_forward(df)
    folds = {r["fold"]: (r["n"], r["lo"]) for r in pairs.groupBy("fold").agg(F.count("*").alias("n"), F.min("date").alias("lo")).collect()}
    assert {k: v[0] for k, v in folds.items()} == {1: 14, 2: 14, 3: 14, 4: 14, 5: 14}
    assert folds[5][1] == DAY + dt.timedelta(days=136) and folds[1][1] == DAY + dt.timedelta(days=80)
    assert MO.cross_validation_report(pairs).first()["fold_count"] == 5


def test_rate_limit_orders_a_key_over_arrow_batches(spark, tmp_path):
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rnd = random.Random(4)
        rows = [(1, i, rnd.random() * 500) for i in range(100)]
        df = spark.createDataFrame(rows, "key long, request_id long, s double").select("key", "request_id", F.timestamp_seconds(F.col("s") + 1e9).alias("event_time"))
        got = {r["request_id"]: r["allowed"] for r in run(spark, tmp_path, ST.rate_limit(stream_of(spark, tmp_path, df.coalesce(1), "many"), 3, 60.0), "many").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    order = sorted(rows, key=lambda r: r[2])
    decided, _ = ST.allowed_instants([r[2] for r in order], [], 3, 60.0)
    assert got == {r[1]: d for r, d in zip(order, decided)}


def test_health_verdict():
    good = (5, 0, 0, 10, 10.0, 0.0)
    assert ST.healthy(good, 3600.0) and not ST.healthy(good, 25 * 3600.0)
    assert not ST.healthy((5, 3, 3, 10, 10.0, 0.0), 1.0) and not ST.healthy((5, 0, 0, 2, 10.0, 0.0), 1.0)


def test_gaps_and_missing_months(spark):
    from staylens.operators import market as K

    df = spark.sql("SELECT explode(sequence(DATE '1997-01-01', DATE '1997-12-31')) AS date, 'A' AS district").filter("date NOT BETWEEN '1997-06-24' AND '1997-10-25'")
    assert [tuple(map(str, r)) for r in K.gaps(df, 7).collect()] == [("1997-06-23", "1997-10-26", "125")]


def test_changed_event_arrives_later(spark, tmp_path):
    """A later version of an id, in a later delivery, reaches the table."""
    from staylens import model as M
    from staylens.operators import upsert as U

    table = U.events_table(spark, str(tmp_path / "table"))
    columns = [c.split()[0] for c in M.CAL_EVENTS.split(", ")]
    for n, price in enumerate((100, 250)):
        row = spark.sql(f"SELECT 'e1' AS event_id, 'T' AS title, DATE '2024-05-01' AS date_start, 'src' AS source_id, {price} AS price_min, timestamp'2024-04-01' AS ingest_ts, {n}L AS ingest_order")
        for f in spark.createDataFrame([], M.CAL_EVENTS).schema.fields:
            if f.name not in row.columns:
                row = row.withColumn(f.name, F.lit(None).cast(f.dataType))
        stream = stream_of(spark, tmp_path, row.select(*columns, "ingest_ts", "ingest_order"), f"d{n}")
        J.drain(J.ingest_events(stream, table), str(tmp_path / f"cp{n}"))
    assert [(r.event_id, r.price_min) for r in spark.read.parquet(table.path).collect()] == [("e1", 250)]


def test_statistics_files_follow_rows_not_tasks(spark, tmp_path):
    """Two deliveries in months of few rows: a month is one file whatever the number of tasks, and the newest snapshot of a key stays."""
    table = U.statistics_table(spark, str(tmp_path / "table"))
    day = lambda i: dt.date(2026, 1 + i % 3, 1 + i % 28)
    def frame(orders):
        rows = [(f"h{i % 50}", day(i), o, 0, 0.0, 0, 0, o * 1000 + i) for i in range(840) for o in orders]
        rows += [(None, day(1), 9, 0, 0.0, 0, 0, 1), ("", day(1), 9, 0, 0.0, 0, 0, 1), ("h1", None, 9, 0, 0.0, 0, 0, 1)]
        df = spark.createDataFrame(rows, "id string, date date, rooms_num int, free_rooms_amount int, available_rooms_percent double, min_price int, max_capacity int, ingest_order long")
        return df.withColumn("updated_at", F.lit(None).cast("timestamp"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        for n, orders in enumerate([(3, 2), (1,), (4,)]):
            J.drain(J.ingest_statistics(stream_of(spark, tmp_path, frame(orders), f"s{n}"), table), str(tmp_path / f"scp{n}"))
            got = {(r["id"], r["date"]): (r["rooms_num"], r["ingest_order"]) for r in spark.read.parquet(table.path).collect()}
            best = 4 if n == 2 else 3
            want = {}
            for i in range(840):
                want[(f"h{i % 50}", day(i))] = (best, best * 1000 + i)
            assert got == want and spark.read.parquet(table.path).count() == len(want)
            assert [len(list(m.glob("*.parquet"))) for m in (tmp_path / "table").glob("month=*")] == [1, 1, 1]
    finally:
        spark.conf.unset(coalesce)
