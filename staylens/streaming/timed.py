"""Keyed state in event time: rows wait in slots of state until the watermark has passed them, then they are decided in order.

The rows of a key are never gathered in a frame: each Arrow batch is dealt to slots of `slot_seconds`, which lie in the state store, and a timer per slot
fires when no earlier row can arrive any more. So the order is that of the events, not of files or triggers, and what a task holds of a key is
one slot. What arrives for a slot is put beside what waits there, not written again with it. Where keys are many and have few rows each (request limits),
the state is that of a bucket of keys: calls to the store follow the buckets, not the keys, and what a task holds is one slot of a bucket. Rows later than the watermark are dropped, as everywhere in event time, and so are rows without a time. A null count is 0, a null success a failure, a null
status an empty one; a null id stays one and comes last among equal times. The state store must be one with
timers (`with_timers` sets it for a query that starts, and leaves the session as it was)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from staylens.streaming import state as ST

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_timers(spark: SparkSession):
    """A query started in this block keeps its state in the store that has timers."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


NOTHING = -(1 << 63)  # a null whole number in state, whose arrays take none


def number(s: pd.Series) -> list[float]:
    return s.astype("float64").tolist()


def whole(s: pd.Series) -> list[int]:
    return s.fillna(NOTHING).astype("int64").tolist()


def text(s: pd.Series) -> list[str]:
    return ["" if pd.isna(v) else str(v) for v in s]


def yes(s: pd.Series) -> list[bool]:
    return [not pd.isna(v) and bool(v) for v in s]


class Slots(StatefulProcessor):
    """Rows (`ts` in seconds and other columns) that wait for the watermark; `decide` gets those of one slot in order of `order`."""

    columns, casts, order, kinds = ("ts",), (number,), ("ts",), "ts array<double>"

    def __init__(self, slot_seconds: float):
        self.width = max(1, int(slot_seconds * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "slot long", "n int")
        self.waiting = handle.getMapState("waiting", "slot long, part int", self.kinds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            end = ((pdf["ts"] * 1000) // self.width + 1).astype("int64") * self.width
            for slot, part in pdf.groupby(end.to_numpy()):
                n = self.parts.getValue((int(slot),))
                if n is None:
                    self.handle.registerTimer(int(slot))
                n = 0 if n is None else n[0]
                self.waiting.updateValue((int(slot), n), tuple(cast(part[c]) for c, cast in zip(self.columns, self.casts)))
                self.parts.updateValue((int(slot),), (n + 1,))
        return iter(())

    def taken(self, slot: int, n: int) -> pd.DataFrame:
        """All that waits in a slot, which is empty afterwards."""
        parts = []
        for i in range(n):
            parts.append(self.waiting.getValue((slot, i)))
            self.waiting.removeKey((slot, i))
        self.parts.removeKey((slot,))
        out = {}
        for c, cast, held in zip(self.columns, self.casts, zip(*parts)):
            values = [v for h in held for v in h]
            out[c] = pd.Series(values, dtype="Int64").replace(NOTHING, pd.NA) if cast is whole else values
        return pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slot = expiredTimerInfo.getExpiryTimeInMs()
        n = self.parts.getValue((slot,))
        if n is not None:
            yield from self.decide(key[0], self.taken(slot, n[0]).sort_values(list(self.order), kind="stable"), timerValues.getCurrentWatermarkInMs())
        else:
            yield from self.silent(key[0], slot)

    def decide(self, key, pdf: pd.DataFrame, watermark_ms: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def silent(self, key, at_ms: int) -> Iterator[pd.DataFrame]:
        """A timer of the processor's own."""
        return iter(())

    def close(self) -> None:
        pass


class RequestLimit(Slots):
    """The requests of a bucket of keys; what is kept of each key lies in one record of the bucket."""

    columns, casts, order = ("key", "ts", "request_id"), (whole, number, whole), ("key", "ts", "request_id")
    kinds = "key array<long>, ts array<double>, request_id array<long>"

    def __init__(self, limit: int, period: float, slot_seconds: float):
        super().__init__(slot_seconds)
        self.limit, self.period = limit, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("kept", "key array<long>, at array<double>")

    def keep(self, kept: dict[int, list[float]], after: float) -> None:
        """Store the instants that a request later than `after` by the period can still meet."""
        rows = [(k, t) for k, times in kept.items() for t in times if t > after]
        if rows:
            self.kept.update(tuple(map(list, zip(*rows))))
        else:
            self.kept.clear()

    def instants(self) -> dict[int, list[float]]:
        kept: dict[int, list[float]] = {}
        for k, t in zip(*self.kept.get()) if self.kept.exists() else ():
            kept.setdefault(k, []).append(t)
        return kept

    def decide(self, bucket, pdf: pd.DataFrame, watermark_ms: int) -> Iterator[pd.DataFrame]:
        kept, decisions = self.instants(), []
        for key, rows in groupby(zip(whole(pdf["key"]), pdf["ts"].tolist()), key=itemgetter(0)):
            allowed, kept[key] = ST.allowed_instants([t for _, t in rows], kept.get(key, []), self.limit, self.period)
            decisions += allowed
        first, last = pdf["ts"].min(), pdf["ts"].max()
        self.keep(kept, first // (self.width / 1000) * (self.width / 1000) - self.period)
        # odd, so that it is no slot's own timer
        self.handle.registerTimer(int((last + self.period) * 1000) // self.width * self.width + self.width + 1)
        yield pdf[["key", "request_id", "ts"]].assign(allowed=decisions)

    def silent(self, bucket, at_ms: int) -> Iterator[pd.DataFrame]:
        if self.kept.exists():
            self.keep(self.instants(), at_ms / 1000 - self.period)
        return iter(())


def rate_limit(requests: DataFrame, limit: int = 10, period_seconds: float = 60.0, delay: str = "10 seconds", slot_seconds: float = 60.0, buckets: int = 2048) -> DataFrame:
    """SM-04 in event time: allowed or refused per request once the watermark has passed it. `requests` has key, request_id and event_time. The
    state of a key goes when the watermark has passed its last request by the period. Keys are dealt to `buckets` by their hash; more buckets hold fewer
    requests of a slot each."""
    whole_or_nothing = [F.coalesce(F.col(c).cast("long"), F.lit(NOTHING)).alias(c) for c in ("key", "request_id")]  # a null would make floats of a batch's numbers in Python
    timed = requests.select(*whole_or_nothing, "event_time", (F.unix_micros("event_time") / 1000000).alias("ts")).filter("event_time IS NOT NULL").withWatermark("event_time", delay)
    return timed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(
        RequestLimit(limit, period_seconds, slot_seconds), "key long, request_id long, ts double, allowed boolean", "Append", "EventTime")


class Health(Slots):
    columns, casts, order = ("ts", "run_id", "items", "success"), (number, whole, whole, yes), ("ts", "run_id")
    kinds = "ts array<double>, run_id array<long>, items array<long>, success array<boolean>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counters = handle.getValueState("counters", "runs long, errors long, failures long, last_count long, mean double, last_success double")

    def decide(self, key, pdf: pd.DataFrame, watermark_ms: int) -> Iterator[pd.DataFrame]:
        current, rows = tuple(self.counters.get()) if self.counters.exists() else ST.START, []
        for ts, run_id, items, success in pdf.itertuples(index=False):
            current, alerts = ST.step(current, 0 if pd.isna(items) else int(items), success, float(ts))
            rows.append((key, None if pd.isna(run_id) else run_id, ST.status_of(current[2], current[3], current[0]), ST.healthy(current, float(ts)), *current[:5], ",".join(alerts)))
        self.counters.update(current)
        yield pd.DataFrame(rows, columns=["source", "run_id", "status", "healthy", "total_runs", "total_errors", "consecutive_failures", "last_count", "avg_count", "alerts"])


HEALTH = "source string, run_id long, status string, healthy boolean, total_runs long, total_errors long, consecutive_failures long, last_count long, avg_count double, alerts string"


def source_health(runs: DataFrame, delay: str = "10 minutes", slot_seconds: float = 3600.0) -> DataFrame:
    """SM-05 in event time: status and health of a source after every run, with the alerts the run raised. `runs` has source, run_id, run_time
    (timestamp), items and success."""
    timed = runs.select("source", "run_id", "run_time", "items", "success", (F.unix_micros("run_time") / 1000000).alias("ts")).filter("run_time IS NOT NULL").withWatermark("run_time", delay)
    return timed.groupBy("source").transformWithStateInPandas(Health(slot_seconds), HEALTH, "Append", "EventTime")


class Silence(Slots):
    """The last run of a source, and a timer at which its absence has lasted too long."""

    columns, casts, order = ("ts", "run_id", "status", "items", "hours"), (number, whole, text, whole, number), ("ts", "run_id")
    kinds = "ts array<double>, run_id array<long>, status array<string>, items array<long>, hours array<double>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "ts double, run_id long, status string, items int, hours double, raised boolean")

    def decide(self, key, pdf: pd.DataFrame, watermark_ms: int) -> Iterator[pd.DataFrame]:
        last, rows = tuple(self.last.get()) if self.last.exists() else None, []
        for ts, run_id, status, items, hours in pdf.itertuples(index=False):
            if last is not None and not last[5] and ts > self.stale(last):
                rows.append(self.row(key, last))
            last = (float(ts), None if pd.isna(run_id) else int(run_id), status, None if pd.isna(items) else int(items), float(hours), False)
        at = int(self.stale(last) * 1000) + 1
        if at < watermark_ms and next(self.parts.keys(), None) is None:  # nothing waits that could have come in time
            rows.append(self.row(key, last))
            last = (*last[:5], True)
        else:
            self.handle.registerTimer(at + (at % self.width == 0))  # never a slot's own timer
        self.last.update(last)
        yield from self.table(rows)

    def silent(self, key, at_ms: int) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get())
        if not last[5] and at_ms > self.stale(last) * 1000:
            self.last.update((*last[:5], True))
            yield from self.table([self.row(key, last)])

    @staticmethod
    def stale(last: tuple) -> float:
        """Beyond twice the interval."""
        return last[0] + 2 * last[4] * 3600

    def row(self, key, last: tuple) -> tuple:
        return key, last[1], last[2], last[3], round(last[0] * 1e6), round(self.stale(last) * 1e6), last[4] * 60

    @staticmethod
    def table(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            out = pd.DataFrame(rows, columns=["source", "run_id", "status", "items", "last_run_us", "stale_since_us", "expected_minutes"])
            yield out.astype({"items": "Int64", "run_id": "Int64"})


STALE = "source string, run_id long, status string, items long, last_run_us long, stale_since_us long, expected_minutes double"


def staleness(runs: DataFrame, hours: Column, delay: str = "10 minutes", slot_seconds: float = 3600.0) -> DataFrame:
    """SM-06 as a stream: a row each time a source has been silent for more than twice its interval (`hours`), with its last run. If no run arrives
    at all, a timer raises it as soon as the watermark passes that instant; a run that arrives later starts anew. `runs` has source, run_id, run_time,
    status and items."""
    timed = runs.select("source", "run_id", "run_time", "status", F.col("items").cast("int").alias("items"), hours.cast("double").alias("hours"), (F.unix_micros("run_time") / 1000000).alias("ts")).filter("run_time IS NOT NULL").withWatermark("run_time", delay)
    found = timed.groupBy("source").transformWithStateInPandas(Silence(slot_seconds), STALE, "Append", "EventTime")
    return found.select("source", "run_id", "status", "items", F.timestamp_micros("last_run_us").alias("last_run"), F.timestamp_micros("stale_since_us").alias("stale_since"), "expected_minutes")
