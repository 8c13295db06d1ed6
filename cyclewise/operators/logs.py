"""Log statistics, re-aimed at a request-log table
``(ts, method, path, status_code, response_time)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import attach_row

RECENT_REQUESTS = 1000  # latency stats cover the last 1000 requests
ERROR_STATUS = 400


def request_stats(log: DataFrame, order: tuple[str, ...] = ("ts", "request_id"), recent: int = RECENT_REQUESTS) -> DataFrame:
    """Total and failed (status ≥ 400) requests over the whole log;
    mean / median / max latency over the last ``recent`` requests (a bounded
    top-N, then an aggregate)."""
    totals = log.agg(F.count(F.lit(1)).alias("total_requests"),
                     F.count_if(F.col("status_code") >= ERROR_STATUS).alias("error_requests"))
    last = log.orderBy(*[F.col(c).desc() for c in order]).limit(recent)
    lat = last.agg(F.coalesce(F.avg("response_time"), F.lit(0.0)).alias("avg_response_time"),
                   F.coalesce(F.median("response_time"), F.lit(0.0)).alias("median_response_time"),
                   F.coalesce(F.max("response_time"), F.lit(0.0)).alias("max_response_time"))
    return attach_row(totals, lat)


def level_stats(log: DataFrame, level: str = "level", ts: str = "ts") -> DataFrame:
    """Total records, errors (level ≥ ERROR), warnings (WARNING ≤ level
    < ERROR) and records per second over the log's time span (≥ 1 s)."""
    rank = (F.when(F.col(level) == "CRITICAL", 50).when(F.col(level) == "ERROR", 40)
            .when(F.col(level) == "WARNING", 30).when(F.col(level) == "INFO", 20).otherwise(10))
    secs = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    s = log.agg(F.count(F.lit(1)).alias("total_logs"), F.count_if(rank >= 40).alias("errors"),
                F.count_if((rank >= 30) & (rank < 40)).alias("warnings"), (F.max(secs) - F.min(secs)).alias("uptime_seconds"))
    return s.withColumn("logs_per_second", F.col("total_logs") / F.greatest(F.lit(1.0), F.col("uptime_seconds")))


def request_log_from_events(events: DataFrame) -> DataFrame:
    """The driver's ``events`` as an API request log: one request per event,
    errors are HTTP 500, latency = value / 1000 seconds."""
    err = F.col("event_type") == "error"
    return events.select(
        "ts", F.col("event_id").alias("request_id"),
        F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/"), F.col("event_type")).alias("path"),
        F.when(err, 500).otherwise(200).alias("status_code"),
        (F.col("value") / 1000.0).alias("response_time"),
        F.when(err, "ERROR").otherwise("INFO").alias("level"),
    )
