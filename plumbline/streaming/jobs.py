"""Event-stream jobs. Where the semantics allow, one function serves streams and tables alike."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.longform import to_long
from plumbline.operators.sequences import place

# Requests per window, failures until the lock and its length, weight of the newest feedback.
RATE_LIMIT = 100
RATE_WINDOW_SECONDS = 60
MAX_FAILURES = 5
LOCK_MINUTES = 15
ALPHA = 0.1


# ---------------------------------------------------------------- plain aggregates


def column_statistics(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mergeable statistics per column; on a stream they grow with every batch."""
    v = F.col("val")
    return to_long(df, cols).groupBy("col").agg(
        F.count("*").alias("count"), F.sum(v).alias("sum"), F.sum(v * v).alias("squares"), F.min(v).alias("min"), F.max(v).alias("max"))


def finished_statistics(sums: DataFrame) -> DataFrame:
    n, mean = F.col("count"), F.col("sum") / F.col("count")
    return sums.select("col", "count", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / n - mean * mean)).alias("std"), "min", "max")


def request_counters(events: DataFrame, width: str = "1 minute") -> DataFrame:
    """Requests per user, endpoint and fixed window."""
    return events.groupBy("user_id", "event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("request_count")).select(
        "user_id", "event_type", F.col("w.start").alias("window_start"), "request_count")


def sliding_rates(events: DataFrame, width: str = "5 minutes", step: str = "1 minute", seconds: int = 300) -> DataFrame:
    """Requests and errors per second over sliding windows."""
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(
        (F.count("*") / F.lit(float(seconds))).alias("request_rate"), (F.count_if(F.col("event_type") == "error") / F.lit(float(seconds))).alias("error_rate")
    ).select(F.col("w.start").alias("window_start"), "request_rate", "error_rate")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions per user with last use and expiry."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select(
        "user_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("expires_at"), "events")


def sessions_stream(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Stream form: late rows merge into their session until the watermark passes its expiry; then it is sent once and forgotten."""
    return sessions(timed(events, delay), gap)


def throttled(events: DataFrame, width: str = "10 seconds") -> DataFrame:
    """The last report of every run in every window."""
    return events.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("r")).select(
        "user_id", F.col("w.start").alias("window_start"), "r.event_id", "r.value")


def stage_status(events: DataFrame) -> DataFrame:
    """First start, last completion and current state of every stage."""
    return events.groupBy("user_id", "event_type").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("completed_at"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


def first_tokens(events: DataFrame) -> DataFrame:
    """Table form of first-wins: the earliest event of every token."""
    return events.groupBy("token").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def first_tokens_stream(events: DataFrame, keep: str = "60 days") -> DataFrame:
    """Stream form: a token counts again only after it has expired."""
    return events.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["token"]).select("token", "event_id")


# ---------------------------------------------------------------- sequences


def _inside() -> Window:
    """Rows of one user in one bucket of times, in order."""
    return Window.partitionBy("user_id", "_b").orderBy("ts", "event_id")


def _ahead() -> Window:
    """The buckets of a user before this one: a row for each, however many events they hold."""
    return Window.partitionBy("user_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)


def failure_streaks(events: DataFrame, limit: int = MAX_FAILURES, minutes: int = LOCK_MINUTES) -> DataFrame:
    """Table form of the lockout: failures since the last success, and the lock a full streak brings.

    Events are placed in buckets of time once. Each bucket counts its failures and how many of them came before its last
    success; from the buckets before it comes the streak it starts with. So one busy user is spread over many tasks.
    """
    tries = events.select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("failed"), F.col("event_type").isin("signup", "purchase").alias("ok")).filter("failed OR ok")
    upto = _inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = place(tries, "ts").withColumn("fails", F.sum(F.col("failed").cast("bigint")).over(upto))
    known = counted.withColumn("base", F.last(F.when(F.col("ok"), F.col("fails")), ignorenulls=True).over(upto))
    ends = known.groupBy("user_id", "_b").agg(F.max("fails").alias("all"), F.max("base").alias("settled"))
    before = F.coalesce(F.sum("all").over(_ahead()), F.lit(0))
    ends = ends.withColumn("before", before).withColumn("settled", F.col("before") + F.col("settled"))
    ends = ends.select("user_id", "_b", (F.col("before") - F.coalesce(F.last("settled", ignorenulls=True).over(_ahead()), F.lit(0))).alias("start"))
    joined = known.join(ends, ["user_id", "_b"])
    streak = F.when(F.col("base").isNull(), F.col("start") + F.col("fails")).otherwise(F.col("fails") - F.col("base"))
    lock = F.when(F.col("failed") & (F.col("streak") >= limit), F.col("ts") + F.make_dt_interval(mins=F.lit(minutes)))
    return joined.withColumn("streak", streak.cast("bigint")).select("user_id", "event_id", "streak", lock.alias("locked_until"))


def rate_limited(events: DataFrame, limit: int = RATE_LIMIT, seconds: int = RATE_WINDOW_SECONDS) -> DataFrame:
    """Table form of the exact rate limit: ``(user_id, event_id, allowed)``.

    A pause of a whole window clears the limiter, so runs between pauses are independent and spread over tasks; a run is
    named by the time it starts. Events are placed in buckets of time once: starts inside a bucket need only the row
    before, the run a bucket begins in comes from the buckets before it. Inside a run rows stream through in time order
    with at most ``limit`` timestamps in memory.
    """
    e = events.select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    pause = seconds * 1_000_000
    upto = _inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = place(e, "ts").withColumn("gap", F.col("us") - F.lag("us").over(_inside()))
    rows = rows.withColumn("run", F.last(F.when(F.col("gap") >= pause, F.col("us")), ignorenulls=True).over(upto))
    ends = rows.groupBy("user_id", "_b").agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.max("run").alias("inner"))
    prev = F.lag("hi").over(Window.partitionBy("user_id").orderBy("_b"))
    ends = ends.withColumn("fresh", F.when(prev.isNull() | (F.col("lo") - prev >= pause), F.col("lo")))
    ends = ends.withColumn("latest", F.coalesce("inner", "fresh"))
    ends = ends.select("user_id", "_b", F.coalesce("fresh", F.last("latest", ignorenulls=True).over(_ahead())).alias("entry"))
    runs = rows.join(ends, ["user_id", "_b"]).withColumn("run", F.coalesce("run", "entry"))
    ordered = runs.select("user_id", "run", "event_id", "us").repartition("user_id", "run").sortWithinPartitions("user_id", "run", "us", "event_id")

    def limiter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, accepted = None, deque()
        for pdf in batches:
            allowed = []
            for user, run, us in zip(pdf["user_id"], pdf["run"], pdf["us"]):
                if (user, run) != key:
                    key, accepted = (user, run), deque()
                allowed.append(admit(accepted, us, limit, seconds))
            yield pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "allowed": allowed})

    return ordered.mapInPandas(limiter, "user_id long, event_id long, allowed boolean")


def admit(accepted: deque, now: int, limit: int, seconds: int) -> bool:
    """Whether a request is let through; ``accepted`` holds the times of the last window. Refused requests leave no trace."""
    while accepted and now - accepted[0] >= seconds * 1_000_000:
        accepted.popleft()
    if len(accepted) >= limit:
        return False
    accepted.append(now)
    return True


def rate_limited_stream(events: DataFrame, limit: int = RATE_LIMIT, seconds: int = RATE_WINDOW_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Stream form: accepted times are the state of a key; a key that falls silent is evicted."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = deque(state.get[0]) if state.exists else deque()
        new = pd.concat(list(batches)).sort_values(["us", "event_id"])  # one key's share of one micro-batch
        allowed = []
        for us in new["us"]:
            allowed.append(admit(accepted, int(us), limit, seconds))
        state.update((list(accepted),))
        latest = max(int(new["us"].max()) // 1000, state.getCurrentWatermarkMs()) + seconds * 1000
        state.setTimeoutTimestamp(latest + 1)
        yield pd.DataFrame({"user_id": new["user_id"], "event_id": new["event_id"], "allowed": allowed})

    e = timed(events, delay).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return e.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, allowed boolean", "accepted array<long>", "append", GroupStateTimeout.EventTimeTimeout)


class Expiry(StatefulProcessor):
    """One entry per key: first and last use and the number of uses; a timer at its expiry reports and removes it."""

    def __init__(self, seconds: int):
        self.keep = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "first_us long, last_us long, uses long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, last, uses = self.entry.get() if self.entry.exists() else (None, None, 0)
        expired = []
        for us in np.sort(np.concatenate([f["us"].to_numpy() for f in rows])).tolist():
            if last is not None and us // 1000 >= last // 1000 + self.keep:
                expired.append((key[0], first, last, uses))
                first, last, uses = None, None, 0
            # a late row belongs to the entry that is there
            first, last, uses = us if first is None else min(first, us), us if last is None else max(last, us), uses + 1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.entry.update((first, last, uses))
        self.handle.registerTimer(last // 1000 + self.keep)
        yield self.frame(expired)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = [(key[0], *self.entry.get())] if self.entry.exists() else []
        self.entry.clear()
        yield self.frame(gone)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(k, f, x, (x // 1000 + self.keep) * 1000, n) for k, f, x, n in rows], columns=["user_id", "first_us", "last_us", "gone_us", "uses"])

    def close(self) -> None:
        pass


def expired_entries(events: DataFrame, seconds: int = RATE_WINDOW_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Stream: entries of keys that were silent for ``seconds``, reported once when event time passes their expiry.

    Needs the RocksDB state store (``run.timer_store``). What is left in the state are the keys used within the horizon.
    """
    e = timed(events, delay).select("user_id", "ts", F.unix_micros("ts").alias("us"))
    out = e.groupBy("user_id").transformWithStateInPandas(
        Expiry(seconds), "user_id long, first_us long, last_us long, gone_us long, uses long", "append", "EventTime")
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return out.select("user_id", time("first_us").alias("first_used"), time("last_us").alias("last_used"), time("gone_us").alias("expired_at"), "uses")


def lockout_stream(events: DataFrame, limit: int = MAX_FAILURES, minutes: int = LOCK_MINUTES) -> DataFrame:
    """Stream form of the lockout: the streak is the state of a user."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        new = pd.concat(list(batches)).sort_values(["us", "event_id"])
        streaks = []
        for failed in new["failed"]:
            streak = streak + 1 if failed else 0
            streaks.append(streak)
        state.update((streak,))
        lock = new["us"] + minutes * 60_000_000
        yield pd.DataFrame({
            "user_id": new["user_id"], "event_id": new["event_id"], "streak": streaks,
            "lock_us": [int(t) if n >= limit else None for t, n in zip(lock, streaks)]}).astype({"lock_us": "Int64"})

    e = events.filter(F.col("event_type").isin("error", "signup", "purchase")).select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_type") == "error").alias("failed"))
    out = e.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, streak long, lock_us long", "streak long", "append", GroupStateTimeout.NoTimeout)
    return out.select("user_id", "event_id", "streak", F.timestamp_micros("lock_us").cast("timestamp_ntz").alias("locked_until"))


def feedback_stream(events: DataFrame, start: float = 0.5, alpha: float = ALPHA) -> DataFrame:
    """Stream form of the usage-feedback average: accuracy and use count are the state of a signature."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accuracy, used = state.get if state.exists else (start, 0)
        for f in pd.concat(list(batches)).sort_values("event_id")["feedback"]:
            accuracy, used = alpha * f + (1 - alpha) * accuracy, used + 1
        state.update((accuracy, used))
        yield pd.DataFrame({"user_id": [key[0]], "usage_count": [used], "accuracy": [accuracy]})

    return events.select("user_id", "event_id", "feedback").groupBy("user_id").applyInPandasWithState(
        step, "user_id long, usage_count long, accuracy double", "accuracy double, usage_count long", "update", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- late data


def timed(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Event time with a watermark; rows later than the delay no longer change a closed window."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def windowed_counts(events: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    return timed(events, delay).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")
