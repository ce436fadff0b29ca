"""Event-stream queries: table forms and, next to them, the same job run as a stream over the event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import roles
from plumbline.operators.signatures import feedback_average
from plumbline.plans.profile import rounded
from plumbline.registry import query
from plumbline.streaming import jobs
from plumbline.streaming.run import latest_updates, run_to_table, table_stream, timer_store

STATS = """SELECT col, count(*) AS count, round(avg(val), 6) AS mean, round(stddev_pop(val), 6) AS std, min(val) AS min, max(val) AS max
FROM (SELECT 'value' AS col, value AS val FROM events UNION ALL SELECT 'user_id', CAST(user_id AS DOUBLE) FROM events) GROUP BY col"""


def events(spark, sf):
    return roles.security_events(spark, sf)


def live(spark, sf):
    return table_stream(spark, sf, "events")


def plain_times(df):
    """Event-time columns as the given tables have them, without a zone."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def both_forms(name: str, sql: str | None, job, keys: list[str] | None, finish=lambda df: df):
    """Register a job as a table query and as a stream.

    With ``keys`` the stream carries a watermark, sends only rows that changed and forgets closed windows; the newest row
    of every key is the result. Without, its state is one row per column and is sent whole.
    """

    @query(name, sql)
    def table_form(spark, sf):
        return finish(job(events(spark, sf)))

    @query(f"{name}_stream", sql)
    def stream_form(spark, sf):
        if keys is None:
            return finish(run_to_table(job(live(spark, sf)), "complete"))
        return finish(plain_times(latest_updates(run_to_table(job(jobs.timed(live(spark, sf))), "update"), keys)))

    return table_form


both_forms("str_01_column_statistics", STATS, lambda e: jobs.column_statistics(e, ["value", "user_id"]), ["col"], finish=lambda d: rounded(jobs.finished_statistics(d)))

both_forms("str_03_request_counters", "SELECT user_id, event_type, date_trunc('minute', ts) AS window_start, count(*) AS request_count FROM events GROUP BY ALL", jobs.request_counters,
           ["user_id", "event_type", "window_start"])

both_forms("str_04_sliding_rates", """
SELECT window_start, round(count(*) / 300.0, 6) AS request_rate, round(count(*) FILTER (event_type = 'error') / 300.0, 6) AS error_rate
FROM (SELECT event_type, date_trunc('minute', ts) - to_minutes(CAST(i AS INTEGER)) AS window_start FROM events, (SELECT unnest(range(5)) AS i)) GROUP BY window_start""",
           jobs.sliding_rates, ["window_start"], finish=rounded)

SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g),
sessions AS (SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 30 MINUTE AS expires_at, count(*) AS events FROM s GROUP BY user_id, n)
SELECT * FROM sessions"""


@query("str_06_sessions", SESSIONS)
def str_06(spark, sf):
    return jobs.sessions(events(spark, sf))


@query("str_06_sessions_stream", SESSIONS)
def str_06_stream(spark, sf):
    """Every session, those still open when the events end too: without a watermark no event comes too late, and the state is one row per session."""
    with timer_store(spark):
        return plain_times(run_to_table(jobs.sessions(live(spark, sf)), "complete"))


@query("str_09_expired_entries", """
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 3600000 THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g),
entries AS (SELECT user_id, n, min(ts) AS first_used, max(ts) AS last_used, count(*) AS uses, max(n) OVER (PARTITION BY user_id) AS latest FROM s GROUP BY user_id, n)
SELECT user_id, first_used, last_used, date_trunc('millisecond', last_used) + INTERVAL 1 HOUR AS expired_at, uses FROM entries
WHERE n < latest OR epoch_ms(last_used) + 3600000 < (SELECT epoch_ms(max(ts)) - 600000 FROM events)""")
def str_09(spark, sf):
    """Keys silent for an hour, reported by a timer in event time and removed from the state."""
    with timer_store(spark):
        return run_to_table(jobs.expired_entries(live(spark, sf), 3600))


both_forms("str_08_throttled_reports", """
SELECT user_id, window_start, event_id, value FROM (SELECT *, time_bucket(INTERVAL 10 SECOND, ts) AS window_start,
  row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 10 SECOND, ts) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""", jobs.throttled, ["user_id", "window_start"])

both_forms("str_11_stage_status", """
SELECT user_id, event_type, min(ts) AS started_at, max(ts) AS completed_at, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY user_id, event_type""", jobs.stage_status, ["user_id", "event_type"])


LIMITED = """
WITH RECURSIVE placed AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (SELECT user_id, event_id, rn, [us] AS accepted, true AS allowed FROM placed WHERE rn = 1
  UNION ALL SELECT user_id, event_id, rn, CASE WHEN len(live) < 2 THEN list_append(live, us) ELSE live END, len(live) < 2
  FROM (SELECT p.user_id, p.event_id, p.rn, p.us, list_filter(w.accepted, lambda t: p.us - t < 3600000000) AS live FROM walk w JOIN placed p ON p.user_id = w.user_id AND p.rn = w.rn + 1))
SELECT user_id, event_id, allowed FROM walk"""


@query("str_02_rate_limit", LIMITED)
def str_02(spark, sf):
    return jobs.rate_limited(events(spark, sf), limit=2, seconds=3600)


@query("str_02_rate_limit_stream", LIMITED)
def str_02_stream(spark, sf):
    return run_to_table(jobs.rate_limited_stream(live(spark, sf), limit=2, seconds=3600))


STREAKS = """
WITH t AS (SELECT user_id, event_id, ts, event_type = 'error' AS failed FROM events WHERE event_type IN ('error', 'signup', 'purchase')),
s AS (SELECT *, count(*) FILTER (NOT failed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM t),
k AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS streak FROM s)
SELECT user_id, event_id, streak, CASE WHEN failed AND streak >= 5 THEN ts + INTERVAL 15 MINUTE END AS locked_until FROM k"""


@query("str_05_failure_streaks", STREAKS)
def str_05(spark, sf):
    return jobs.failure_streaks(events(spark, sf))


@query("str_05_failure_streaks_stream", STREAKS)
def str_05_stream(spark, sf):
    return run_to_table(jobs.lockout_stream(live(spark, sf)))


TOKENS = "SELECT token, arg_min(event_id, (ts, event_id)) AS event_id FROM (SELECT *, user_id || '-' || event_type AS token FROM events) GROUP BY token"


def tokens(e):
    return e.withColumn("token", F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")))


@query("str_07_first_tokens", TOKENS)
def str_07(spark, sf):
    return jobs.first_tokens(tokens(events(spark, sf)))


@query("str_07_first_tokens_stream")
def str_07_stream(spark, sf):
    timed = tokens(live(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp"))
    return run_to_table(jobs.first_tokens_stream(timed))


FEEDBACK = """
WITH f AS (SELECT user_id, value / 500 AS feedback, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS age, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, max(n) AS usage_count, round(sum(feedback * 0.1 * 0.9 ** age) + 0.5 * 0.9 ** max(n), 6) AS accuracy FROM f GROUP BY user_id"""


@query("str_10_feedback_average", FEEDBACK)
def str_10(spark, sf):
    return rounded(feedback_average(events(spark, sf).select("user_id", "event_id", (F.col("value") / 500).alias("feedback")), "user_id", ["event_id"], 0.5))


@query("str_10_feedback_average_stream", FEEDBACK)
def str_10_stream(spark, sf):
    out = run_to_table(jobs.feedback_stream(live(spark, sf).withColumn("feedback", F.col("value") / 500)), "update")
    return rounded(latest_updates(out, ["user_id"]))


WINDOWS = "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n FROM events GROUP BY 1"


@query("str_12_windowed_counts_stream", WINDOWS)
def str_12_stream(spark, sf):
    """With a watermark: late events change their window until it is closed, closed windows are forgotten."""
    return plain_times(latest_updates(run_to_table(jobs.windowed_counts(live(spark, sf)), "update"), ["window_start"]))


@query("str_12_windowed_counts", WINDOWS)
def str_12(spark, sf):
    return jobs.windowed_counts(events(spark, sf)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
