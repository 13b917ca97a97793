"""Author behaviour as it arrives: windows, rate limits, profiles, deliveries.

Every operator takes a streaming or a batch DataFrame of events (event_id, ts,
user_id, event_type, value). Stateful ones process a key's events in the order
of (ts, event_id) within a micro-batch, so batch and stream agree when events
arrive in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import Folds

EVENTS = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())]
)
LATE = "1 hour"
#: tier -> (events, seconds)
TIERS = {"anonymous": (10, 60), "token": (60, 60), "app": (20, 60), "share": (3, 3600)}
FAILED_BELOW = 70


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Events per type and tumbling or sliding window; rows later than the
    watermark are dropped from a stream."""
    by = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = events.withWatermark("ts", late).groupBy(by.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select("w.start", "w.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("w.start", "w.end", "user_id", "n")


def first_deliveries(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each delivery once: repeats within the watermark are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["ts", "event_id"])


LIMITED = "user_id long, event_id long, allowed boolean, remaining int"


def limit_step(times: list[int], now: int, most: int, seconds: int) -> tuple[list[int], bool, int]:
    """Sliding log: times of allowed events within the window, then whether
    this one is allowed and how many were left before it. A denied event is
    not recorded."""
    times = [t for t in times if t > now - seconds * 1_000_000]
    left = most - len(times)
    return (times + [now] if left > 0 else times), left > 0, max(left, 0)


def rate_limited(events: DataFrame, tier: str = "anonymous") -> DataFrame:
    """Whether each event passes its user's limit. Stateful per user."""
    most, seconds = TIERS[tier]

    def run(key, frames, state):
        times = list(state.get[0]) if state.exists else []
        rows = []
        for ts, event_id in _ordered(frames)[["ts", "event_id"]].itertuples(index=False):
            times, ok, left = limit_step(times, ts.value // 1000, most, seconds)
            rows.append((key[0], event_id, ok, left))
        state.update((times,))
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "allowed", "remaining"])

    if events.isStreaming:
        return events.groupBy("user_id").applyInPandasWithState(run, LIMITED, "times array<long>", "append", "NoTimeout")

    def step(times, at, event_id):
        times, ok, left = limit_step(times, at, most, seconds)
        return times, (ok, left)

    rows = events.select("user_id", F.unix_micros("ts").alias("at"), "event_id")
    folds = Folds(rows, "user_id", ["at", "event_id"], ["at", "event_id"], [], step)
    return folds.rows(["event_id"], "allowed boolean, remaining int")


PROFILE = "user_id long, scans int, mean_value int, failures int, suspicion double"


def profile_step(p: tuple, value: float) -> tuple:
    """(scans, rounded mean, failures in a row, suspicion) after one event."""
    scans, mean, failures, suspicion = p
    mean = int((mean * scans + value) / (scans + 1) + 0.5)
    failures = 0 if value >= FAILED_BELOW else failures + 1
    change = min(3 * failures, 12) / 2 if failures >= 3 else -5
    return scans + 1, mean, failures, min(100.0, max(0.0, suspicion + change))


def profiles(events: DataFrame) -> DataFrame:
    """Author profiles: in a stream the profile after each micro-batch, in a
    batch the final one. The mean is rounded after every event."""

    def run(key, frames, state):
        p = tuple(state.get) if state.exists else (0, 0, 0, 0.0)
        for value in _ordered(frames)["value"]:
            p = profile_step(p, value)
        state.update(p)
        yield pd.DataFrame([(key[0], *p)], columns=["user_id", "scans", "mean_value", "failures", "suspicion"])

    if events.isStreaming:
        return events.groupBy("user_id").applyInPandasWithState(run, PROFILE, "scans int, mean int, failures int, suspicion double", "update", "NoTimeout")

    rows = events.select("user_id", F.unix_micros("ts").alias("at"), "event_id", "value")
    folds = Folds(rows, "user_id", ["at", "event_id"], ["value"], (0, 0, 0, 0.0), lambda p, value: (profile_step(p, value), ()))
    return folds.states("scans int, mean_value int, failures int, suspicion double")


# fixed values: credits of a period, its length, and what they buy
FREE, PERIOD_DAYS = 30, 30
#: What a reason costs; any other costs DEFAULT_COST.
COSTS, DEFAULT_COST = {"ai_judge": 2, "ai_assisted": 2, "full_ai": 3}, 2


def ledger_step(state: tuple | None, at: int, cost: int, free: int, period: int) -> tuple[tuple, tuple]:
    """(balance, end of the period, used in all) after one request, and
    (allowed, balance, reset, amount). The first request opens an account; one
    after the end of a period starts a new one. A request that costs more than
    is left changes nothing."""
    balance, end, used = state or (free, at + period, 0)
    reset = at > end
    if reset:
        balance, end = free, at + period
    allowed = cost <= balance
    if allowed:
        balance, used = balance - cost, used + cost
    return (balance, end, used), (allowed, balance, reset, -cost if allowed else 0)


LEDGER = "allowed boolean, balance int, reset boolean, amount int"


def ledger(events: DataFrame, reason: str = "event_type", costs: dict[str, int] = COSTS, free: int = FREE, days: float = PERIOD_DAYS) -> DataFrame:
    """(user_id, event_id, allowed, balance, reset, amount): credits of users
    who get ``free`` of them for each period of ``days``. Stateful per user in a
    stream, a fold in order over ranges of events in a batch."""
    period = int(days * 86_400_000_000)
    cost = F.coalesce(*(F.when(F.col(reason) == r, c) for r, c in costs.items()), F.lit(DEFAULT_COST))
    rows = events.select("user_id", F.unix_micros("ts").alias("at") if not events.isStreaming else "ts", "event_id", cost.alias("cost"))
    if not events.isStreaming:
        folds = Folds(rows, "user_id", ["at", "event_id"], ["at", "cost", "event_id"], None, lambda state, at, cost, event_id: ledger_step(state, at, cost, free, period))
        return folds.rows(["event_id"], LEDGER)

    def run(key, frames, state):
        held, out = (tuple(state.get) if state.exists else None), []
        for ts, event_id, cost in _ordered(frames)[["ts", "event_id", "cost"]].itertuples(index=False):
            held, row = ledger_step(held, ts.value // 1000, cost, free, period)
            out.append((key[0], event_id, *row))
        state.update(held)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed", "balance", "reset", "amount"])

    return rows.groupBy("user_id").applyInPandasWithState(run, f"user_id long, event_id long, {LEDGER}", "balance int, period_end long, used long", "append", "NoTimeout")


def running_mean(events: DataFrame) -> DataFrame:
    """(user_id, n, mean) of values, the mean rounded after every event."""

    def step(state, value):
        n, mean = state
        return (n + 1, float(math.floor((mean * n + value) / (n + 1) + 0.5))), ()

    rows = events.select("user_id", F.unix_micros("ts").alias("at"), "event_id", "value")
    return Folds(rows, "user_id", ["at", "event_id"], ["value"], (0, 0.0), step).states("n long, mean double")


LEASE = 120
STATUS = "delivery_id string, event_id long, status string"


def lease_step(state: tuple | None, at: int, done: bool, lease: int) -> tuple[tuple | None, str]:
    """(begun, completed) of a delivery after one event, and its status: an
    arrival is accepted once; while that one is at work others wait, after its
    lease they may try again, and once it has completed they are skipped."""
    if done:
        return (state and (state[0], True)), "completed" if state and not state[1] else "ignored"
    if state is None:
        return (at, False), "accepted"
    if state[1]:
        return state, "skipped"
    return state, "processing" if at - state[0] < lease * 1_000_000 else "retried"


def leases(events: DataFrame, lease: int = LEASE, late: str = LATE) -> DataFrame:
    """(delivery_id, event_id, status) of the arrivals and completions (``done``)
    of deliveries. The lease runs from the first arrival and is not renewed.

    A stream keeps a timer per delivery that is at work: when the watermark
    passes the end of its lease, a row ``stale`` without an event says so. Rows
    later than the watermark are dropped. Within a micro-batch events are taken
    in order. The batch has no timers: there a delivery is stale where an
    arrival after its lease, or no completion within it, shows it.
    """
    if not events.isStreaming:
        rows = events.select("delivery_id", F.unix_micros("ts").alias("at"), "event_id", "done")
        return Folds(rows, "delivery_id", ["at", "event_id"], ["at", "done", "event_id"], None, lambda s, at, done, event_id: (lambda t: (t[0], (t[1],)))(lease_step(s, at, done, lease))).rows(["event_id"], "status string")

    def run(key, frames, state):
        if state.hasTimedOut:
            begun, completed = state.get
            state.update((begun, completed))
            yield pd.DataFrame([(key[0], None, "stale")], columns=["delivery_id", "event_id", "status"])
            return
        held, out = (tuple(state.get) if state.exists else None), []
        for ts, event_id, done in _ordered(frames)[["ts", "event_id", "done"]].itertuples(index=False):
            held, status = lease_step(held, ts.value // 1000, done, lease)
            out.append((key[0], event_id, status))
        if held is not None:
            state.update(held)
            ends = held[0] // 1000 + lease * 1000
            if not held[1] and ends > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(ends)
        frame = pd.DataFrame(out, columns=["delivery_id", "event_id", "status"])
        yield frame.astype({"event_id": "Int64"})

    rows = events.withWatermark("ts", late).select("delivery_id", "ts", "event_id", "done")
    return rows.groupBy("delivery_id").applyInPandasWithState(run, STATUS, "begun long, completed boolean", "append", "EventTimeTimeout")
