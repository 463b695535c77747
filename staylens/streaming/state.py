"""Keyed state over arriving rows: request limits and the health of sources.

The state of a key is bounded (at most `limit` instants, one record of counters). The rows of one key in one micro-batch come in several
Arrow batches without an order; their instants and ids, not whole rows, are brought into event order first, so the
source's files or offsets per trigger bound what a task holds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

def in_order(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """All rows of a key in this micro-batch, in event order."""
    return pd.concat(list(batches), ignore_index=True).sort_values(by, kind="stable")


def allowed_instants(times: list[float], kept: list[float], limit: int, period: float) -> tuple[list[bool], list[float]]:
    """Decide requests in time order: one is allowed while fewer than `limit` allowed ones lie within the period before
    it. Only allowed requests count. Returns the decisions and the instants still inside the period."""
    out = []
    for now in times:
        kept = [t for t in kept if t > now - period]
        ok = len(kept) < limit
        if ok:
            kept.append(now)
        out.append(ok)
    return out, kept


def rate_limit(requests: DataFrame, limit: int = 10, period_seconds: float = 60.0, delay: str = "10 seconds") -> DataFrame:
    """SM-04: allowed or refused per request; `requests` has key, request_id and event_time. The state of a key goes when
    the watermark has passed its last request by the period."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        pdf = in_order((b[["ts", "request_id"]] for b in batches), ["ts", "request_id"])
        decisions, kept = allowed_instants(pdf["ts"].tolist(), kept, limit, period_seconds)
        last = float(pdf["ts"].iloc[-1])
        yield pd.DataFrame({"key": key[0], "request_id": pdf["request_id"], "ts": pdf["ts"], "allowed": decisions})
        state.update((kept,))
        state.setTimeoutTimestamp(max(int((last + period_seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    timed = requests.select("key", "request_id", "event_time").withWatermark("event_time", delay).withColumn("ts", F.unix_micros("event_time") / 1000000)
    return timed.groupBy("key").applyInPandasWithState(
        decide, "key long, request_id long, ts double, allowed boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def status_of(failures: int, last_count: int, runs: int) -> str:
    if failures >= 3:
        return "CRITICAL"
    if failures >= 1:
        return "WARNING"
    return "EMPTY" if last_count == 0 and runs > 0 else "OK"


def step(state: tuple, count: int, success: bool, at: float) -> tuple[tuple, list[str]]:
    """One run of a source: (counters after it, alerts it raises)."""
    runs, errors, failures, last_count, mean, last_success = state
    before = status_of(failures, last_count, runs)
    runs += 1
    if success and count > 0:
        last_success, last_count, failures = at, count, 0
        mean = (mean * (runs - 1) + count) / runs
    else:
        errors, failures = errors + 1, failures + 1
    after = status_of(failures, last_count, runs)
    alerts = []
    if after != before:
        if after in ("CRITICAL", "WARNING"):
            alerts.append(after)
        elif after == "OK" and before in ("CRITICAL", "WARNING"):
            alerts.append("RECOVERED")
    if success and count > 0 and mean > 5 and count < mean * LOW_SHARE:
        alerts.append("LOW_DATA")
    return (runs, errors, failures, last_count, mean, last_success), alerts


START = (0, 0, 0, 0, 0.0, None)
DAY_SECONDS, LOW_SHARE = 24 * 3600.0, 0.3


def healthy(state: tuple, now: float) -> bool:
    """Fewer than three failures in a row, a success within a day if there ever was one, and not far fewer items than usual."""
    _, _, failures, last_count, mean, last_success = state
    late = last_success is not None and now - last_success > DAY_SECONDS
    return failures < 3 and not late and not (mean > 0 and last_count < mean * LOW_SHARE)


def source_health(runs: DataFrame) -> DataFrame:
    """SM-05: status and health of a source after every run, with the alerts the run raised. `runs` has source, run_id, run_ts
    (seconds, double), items and success."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, rows = tuple(state.get) if state.exists else START, []
        pdf = in_order(batches, ["run_ts", "run_id"])
        for run_id, ts, items, success in zip(pdf["run_id"], pdf["run_ts"], pdf["items"], pdf["success"]):
            current, alerts = step(current, int(items), bool(success), float(ts))
            rows.append((key[0], run_id, status_of(current[2], current[3], current[0]), healthy(current, float(ts)), *current[:5], ",".join(alerts)))
        yield pd.DataFrame(rows, columns=["source", "run_id", "status", "healthy", "total_runs", "total_errors", "consecutive_failures", "last_count", "avg_count", "alerts"])
        state.update(current)

    return runs.select("source", "run_id", "run_ts", "items", "success").groupBy("source").applyInPandasWithState(
        follow,
        "source string, run_id long, status string, healthy boolean, total_runs long, total_errors long, consecutive_failures long, last_count long, avg_count double, alerts string",
        "runs long, errors long, failures long, last_count long, mean double, last_success double",
        "append", GroupStateTimeout.NoTimeout)
