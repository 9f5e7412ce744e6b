"""Window queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.sources.tables import load
from corpuslens.streaming import windows


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _ntz(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.col(c).cast("timestamp_ntz"))


def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type."""
    return _ntz(windows.tumbling(_events(spark, d)), "window_start")


def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Events by two hours, every hour."""
    return _ntz(windows.sliding(_events(spark, d)), "window_start")


def events_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user, closed by 30 minutes of silence."""
    return _ntz(windows.sessions(_events(spark, d)), "session_start")


QUERIES = {f.__name__: f for f in (events_tumbling, events_sliding, events_session)}
SQL = {
    "events_tumbling": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_sliding": """SELECT w AS window_start, count(*) AS n FROM (
        SELECT unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS w FROM events) GROUP BY 1""",
    "events_session": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS f FROM events),
        s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
        SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
}
