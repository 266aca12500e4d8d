"""Queries that run streams over the events table to their end and give the result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import table
from marginalia.streaming import ledger as lg

_TEXT = "yyyy-MM-dd HH:mm:ss"


def _utc(c: str):
    """An instant as text in UTC, whatever the zone of the session."""
    return F.date_format(F.expr(f"convert_timezone(current_timezone(), 'UTC', cast({c} as timestamp_ntz))"), _TEXT)


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of several files, in the order they came in; one file is one batch."""
    events = table(spark, d, "events")
    return lg.events_stream(spark, lg.split_by_time(events, "ts", 5), "*.parquet", events.schema).withColumn("at", F.expr("cast(convert_timezone('UTC', current_timezone(), ts) as timestamp)")).withColumn("amount", F.floor(F.col("value")).cast("bigint"))


def latest(spark: SparkSession, d: str) -> DataFrame:
    s = _events(spark, d).where("user_id is not null").selectExpr("user_id as proposal_id", "ts as decided_at", "event_id as seq", "event_type as decision")
    return lg.run_to_table(lg.latest_by_key(s, "proposal_id", "decided_at", "seq", "decision"), "update", ["proposal_id"]).withColumn("decided_at", F.date_format("decided_at", _TEXT))


def tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = lg.run_to_table(lg.windowed_counts(_events(spark, d), "at", "1 day", "1 day", None, "event_type"), "update", ["window_start", "event_type"])
    return out.withColumn("window_start", _utc("window_start"))


def sliding(spark: SparkSession, d: str) -> DataFrame:
    out = lg.run_to_table(lg.windowed_counts(_events(spark, d), "at", "1 day", "2 hours", "1 hour"), "update", ["window_start"])
    return out.withColumn("window_start", _utc("window_start"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    out = lg.run_to_table(lg.sessions(_events(spark, d).where("user_id is not null"), "at", "1 day", "6 hours", "user_id"), "complete")
    return out.withColumns({c: _utc(c) for c in ("session_start", "session_end")})


QUERIES = {"stream_latest_decision": latest, "stream_tumbling_counts": tumbling, "stream_sliding_counts": sliding, "stream_sessions": sessions}
_F = "'%Y-%m-%d %H:%M:%S'"
ORACLES = {
    "stream_latest_decision": f"SELECT user_id AS proposal_id, strftime(ts, {_F}) AS decided_at, event_id AS seq, event_type AS decision, n_records FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n_records FROM events WHERE user_id IS NOT NULL) WHERE rn = 1",
    "stream_tumbling_counts": f"SELECT strftime(date_trunc('day', ts), {_F}) AS window_start, event_type, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS amount FROM events GROUP BY 1, 2",
    "stream_sliding_counts": f"SELECT strftime(date_trunc('hour', ts) - k * INTERVAL 1 HOUR, {_F}) AS window_start, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS amount FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1",
    "stream_sessions": f"WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), {_F}) AS session_start, strftime(max(ts) + INTERVAL 6 HOUR, {_F}) AS session_end, count(*) AS n FROM s GROUP BY user_id, k",
}
