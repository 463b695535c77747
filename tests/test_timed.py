"""Keyed state in event time: order of the events, not of files and batches; timers that fire when nothing arrives."""

import random

import pytest
from pyspark.sql import functions as F

from staylens.streaming import jobs as J
from staylens.streaming import state as ST
from staylens.streaming import timed as TS

T0 = 1_000_000_000.0
FAR = float(T0 + 10_000_000)


def land(spark, folder, rows, schema, name):
    """One more file of a landed table; the first column in seconds becomes a timestamp."""
    time = schema.split()[0]
    df = spark.createDataFrame(rows, schema).withColumn(time, F.timestamp_seconds(F.col(time)))
    df.coalesce(1).write.parquet(str(folder / name))
    return df.schema


def drain(spark, folder, schema, operator, name, per_trigger=None):
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    stream = (stream.option("maxFilesPerTrigger", per_trigger) if per_trigger else stream).parquet(str(folder))
    with TS.with_timers(spark):
        J.drain(operator(stream).writeStream.format("parquet").option("path", str(folder.parent / f"{name}-out")), str(folder.parent / f"{name}-cp"))
    return spark.read.parquet(str(folder.parent / f"{name}-out"))


REQUESTS = "event_time double, key long, request_id long"


def replay(rows, limit, period):
    want = {}
    for key in {r[1] for r in rows}:
        order = sorted((t, i) for t, k, i in rows if k == key)
        for (_, i), ok in zip(order, ST.allowed_instants([t for t, _ in order], [], limit, period)[0]):
            want[i] = ok
    return want


def test_hot_key_of_one_file(spark, tmp_path):
    """Most rows of a file belong to one key and are in no order: each is decided as a replay in event order decides it."""
    rnd = random.Random(2)
    rows = [(T0 + rnd.randrange(4_000_000) / 100, 1 if i % 4 else rnd.randint(2, 4), i) for i in range(12_000)]
    (tmp_path / "in").mkdir()
    schema = land(spark, tmp_path / "in", rows + [(FAR, -1, -1)], REQUESTS, "a")
    got = {r["request_id"]: r["allowed"] for r in drain(spark, tmp_path / "in", schema, lambda s: TS.rate_limit(s, 5, 60.0), "hot").collect()}
    assert got == replay(rows, 5, 60.0) and not all(got.values()) and any(got.values())


def test_files_out_of_order(spark, tmp_path):
    """The second file is older than the first, within the delay: the decisions are those of one ordered file; what is too late is dropped."""
    rnd = random.Random(3)
    rows = [(T0 + 100 * rnd.random(), rnd.choice([1, 2]), i) for i in range(300)]
    (tmp_path / "in").mkdir()
    schema = land(spark, tmp_path / "in", [r for r in rows if r[0] > T0 + 50], REQUESTS, "a")
    drain(spark, tmp_path / "in", schema, lambda s: TS.rate_limit(s, 3, 20.0, delay="200 seconds", slot_seconds=10), "two")
    land(spark, tmp_path / "in", [r for r in rows if r[0] <= T0 + 50] + [(FAR, -1, -1)], REQUESTS, "b")
    got = drain(spark, tmp_path / "in", schema, lambda s: TS.rate_limit(s, 3, 20.0, delay="200 seconds", slot_seconds=10), "two")
    assert {r["request_id"]: r["allowed"] for r in got.collect()} == replay(rows, 3, 20.0)
    land(spark, tmp_path / "in", [(T0 + 1, 1, 999)], REQUESTS, "c")
    got = drain(spark, tmp_path / "in", schema, lambda s: TS.rate_limit(s, 3, 20.0, delay="200 seconds", slot_seconds=10), "two")
    assert got.filter("request_id = 999").count() == 0 and got.count() == 300


def test_many_keys_of_a_bucket_and_rows_without_a_key(spark, tmp_path):
    """Many keys share the state of a bucket, each is limited on its own. A row without a key in the same batch leaves the other keys what they are, exact beyond 2^53."""
    big = (1 << 60) + 1
    rows = [(T0 + i % 40, big + i % 500, big + i) for i in range(2000)] + [(T0 + i, None, i) for i in range(6)] + [(T0 + 3, big, None)]
    (tmp_path / "in").mkdir()
    schema = land(spark, tmp_path / "in", rows + [(FAR, None, None)], REQUESTS, "a")
    got = drain(spark, tmp_path / "in", schema, lambda s: TS.rate_limit(s, 2, 60.0, buckets=8), "buckets").collect()
    found = sorted((r["key"] is None, r["key"] or 0, r["ts"], r["request_id"] is None, r["request_id"] or 0, r["allowed"]) for r in got)
    want = []
    for key in {r[1] for r in rows}:
        order = sorted((t, i is None, i or 0) for t, k, i in rows if k == key)
        want += [(key is None, key or 0, *o, ok) for o, ok in zip(order, ST.allowed_instants([o[0] for o in order], [], 2, 60.0)[0])]
    assert found == sorted(want)


def test_kept_instants_reach_over_slots(spark, tmp_path):
    """Requests of many slots and deliveries: what is kept of a key between slots decides the next, and goes after the period."""
    rnd = random.Random(7)
    rows = [(T0 + rnd.randrange(60_000) / 100, rnd.randint(1, 9), i) for i in range(900)]
    (tmp_path / "in").mkdir()
    limited = lambda s: TS.rate_limit(s, 3, 25.0, delay="1 second", slot_seconds=10, buckets=2)
    for n, (low, high) in enumerate([(0, 200), (200, 400), (400, 600)]):
        part = [r for r in rows if T0 + low <= r[0] < T0 + high] + ([(FAR, -1, -1)] if high == 600 else [])
        schema = land(spark, tmp_path / "in", part, REQUESTS, f"p{n}")
        got = drain(spark, tmp_path / "in", schema, limited, "kept")
    assert {r["request_id"]: r["allowed"] for r in got.collect()} == replay(rows, 3, 25.0)


RUNS = "run_time double, source string, run_id long, items int, success boolean"


def test_health_equals_replay(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(T0 + rnd.random() * 9e5, rnd.choice("ab"), i, rnd.choice([0, 1, 30, 40]), rnd.random() < 0.7) for i in range(400)]
    (tmp_path / "in").mkdir()
    schema = land(spark, tmp_path / "in", rows + [(float(FAR), "zz", -1, 0, False)], RUNS, "a")
    got = {(r["source"], r["run_id"]): tuple(r)[2:] for r in drain(spark, tmp_path / "in", schema, TS.source_health, "health").collect()}
    want = {}
    for source in "ab":
        state = ST.START
        for at, _, i, items, ok in sorted(r for r in rows if r[1] == source):
            state, alerts = ST.step(state, items, ok, at)
            want[(source, i)] = (ST.status_of(state[2], state[3], state[0]), ST.healthy(state, at), *state[:4], pytest.approx(state[4]), ",".join(alerts))
    assert got == want and any("LOW_DATA" in w[7] for w in want.values()) and any("RECOVERED" in w[7] for w in want.values())


SEEN = "run_time double, source string, run_id long, status string, items int"


def test_silence_is_noticed_without_a_run(spark, tmp_path):
    """Sources are expected every hour. While b goes on, a falls silent: the timer raises it though no run of a arrives, once; then a comes back."""
    hours = lambda s: TS.staleness(s, F.lit(1.0))
    step = lambda name, rows: (land(spark, tmp_path / "in", rows, SEEN, name), sorted((r["source"], r["run_id"]) for r in drain(spark, tmp_path / "in", schema, hours, "s").collect()))[1]
    (tmp_path / "in").mkdir()
    schema = land(spark, tmp_path / "in", [(float(T0), "a", 1, "ok", 5), (float(T0), "b", 2, "ok", 5)], SEEN, "first")
    assert step("second", [(T0 + 3600.0 * i, "b", 2 + i, "ok", 0) for i in range(1, 3)]) == []
    assert step("third", [(T0 + 3600.0 * 3, "b", 20, "warn", None)]) == [("a", 1)]
    assert step("fourth", [(T0 + 3600.0 * 4, "b", 21, "ok", 1), (T0 + 3600.0 * 4, "a", 22, "ok", 1)]) == [("a", 1)]
    # b falls silent within one delivery: its next run comes four hours later, and may be decided with a later one
    assert step("fifth", [(T0 + 3600.0 * 5, "a", 23, "ok", 1), (T0 + 3600.0 * 6, "a", 24, "ok", 1), (T0 + 3600.0 * 8, "b", 25, "ok", 1)]) in ([("a", 1)], [("a", 1), ("b", 21)])
    assert step("last", [(float(FAR), "z", 99, "ok", 1)]) == [("a", 1), ("a", 24), ("b", 21), ("b", 25)]
    row = spark.read.parquet(str(tmp_path / "s-out")).filter("run_id = 1").first()
    assert row["expected_minutes"] == 60.0 and (row["stale_since"] - row["last_run"]).total_seconds() == 7200


def test_session_setting_stays(spark):
    before = spark.conf.get(TS.PROVIDER)
    with TS.with_timers(spark):
        assert spark.conf.get(TS.PROVIDER) == TS.ROCKS
    assert spark.conf.get(TS.PROVIDER) == before
