"""Registered streaming queries: the events table drained as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.registry import query
from quarry.streaming import streams as S


def _events(spark, sf):
    # a glob: the stream source watches the folder for matching files
    return S.event_stream(spark, f"{sf.rstrip('/')}/events*.parquet")


@query("stream_tool_health", sql="""
SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end,
       event_type AS tool, count(*) AS n, CAST(count_if(event_type = 'error') AS BIGINT) AS n_error,
       round(1 - count_if(event_type = 'error') / count(*), 6) AS success_rate
FROM events GROUP BY ALL""", category="streaming")
def q_stream_tool_health(spark, sf):
    """Hourly tumbling-window tool health (complete mode = batch twin)."""
    return S.run_available_now(S.tool_health(_events(spark, sf)), "tool_health", "complete")


@query("stream_sessions", sql="""
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 minute
                                    THEN 0 ELSE 1 END AS st FROM events),
s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 minute AS session_end, count(*) AS n_events
FROM s GROUP BY user_id, sid""", category="streaming")
def q_stream_sessions(spark, sf):
    """30-minute session windows per user (complete mode)."""
    return S.run_available_now(S.sessions(_events(spark, sf)), "sessions", "complete")


@query("stream_new_traces", sql="SELECT DISTINCT user_id, event_type FROM events", category="streaming")
def q_stream_new_traces(spark, sf):
    """First arrival ever per (user, event type); keys seen by earlier batches or runs are skipped."""
    e = _events(spark, sf).select("event_id", "ts", "user_id", "event_type")
    return S.new_items(e, "new_traces", ["user_id", "event_type"]).select("user_id", "event_type")


@query("stream_cache", sql="""
WITH r AS (SELECT md5(concat_ws('|', props, event_type)) AS hash, event_id, value AS result,
                  CAST(epoch_us(ts) // 1000000 AS BIGINT) AS timestamp FROM events)
SELECT hash, event_id, result, timestamp FROM (
  SELECT *, row_number() OVER (PARTITION BY hash ORDER BY timestamp DESC, event_id DESC) AS rn FROM r) WHERE rn = 1""",
       category="streaming")
def q_stream_cache(spark, sf):
    """T4: last-write-wins request cache maintained by micro-batch upserts."""
    e = _events(spark, sf)
    req = e.select(F.md5(F.concat_ws("|", "props", "event_type")).alias("hash"), "event_id",
                   F.col("value").alias("result"), F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("timestamp"))
    return S.cache_upsert_stream(req, "cache")
