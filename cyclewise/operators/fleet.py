"""Fleet views (SURVEY §2.6 A2–A5, A12, A15, A16; §2.7 J1–J4; §2.8 K2–K4,
K6; §2.9 D1–D2).

Topics are plain tables with a ``timestamp`` and a tie-breaking id. Latest-N
reads are ``orderBy(desc).limit(n)``, which Spark plans as a per-partition
top-N plus a merge of at most ``n × partitions`` rows, so the bound holds at
any table size. Per-engine views are partial aggregates (skew-safe).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import attach_row, safe_div
from ..schema import CYCLE, ENGINE
from .ordering import DEFAULT_CHUNK_ROWS, engine_aggregates

TOPIC_BOUND = 1000  # each topic keeps its latest 1000 messages
RECENT_SECONDS = 60.0


def latest(df: DataFrame, n: int, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """K2: the newest ``n`` records (non-destructive read)."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def oldest(df: DataFrame, n: int, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """K3: the ``n`` oldest records (what a draining read returns)."""
    return df.orderBy(*[F.col(c).asc() for c in order]).limit(n)


def engine_status_v1(readings: DataFrame, s1: str = "sensor_1") -> DataFrame:
    """A2: total cycles, max / min RUL, mean sensor_1 per engine. RUL counts
    down to 0 at the engine's last cycle, so its range is known from the first
    and last cycle and no reading needs its own."""
    return readings.groupBy(ENGINE).agg(
        F.count(F.lit(1)).alias("total_cycles"), (F.max(CYCLE) - F.min(CYCLE)).alias("max_rul"),
        F.when(F.max(CYCLE).isNotNull(), 0).alias("min_rul"), F.avg(s1).alias("avg_sensor_1"),
    )


def engine_status_v2(readings: DataFrame, progress: DataFrame) -> DataFrame:
    """A3 + J3: totals per engine, left-joined to the replay progress
    (``engine_id, current_index``) of the engines being streamed."""
    base = readings.groupBy(ENGINE).agg(
        F.count(F.lit(1)).alias("total_cycles"), F.max(CYCLE).alias("max_cycle"), F.min(CYCLE).alias("min_cycle"),
    )
    joined = base.join(progress, ENGINE, "left")
    streaming = F.col("current_index").isNotNull()
    live = streaming & (F.col("current_index") < F.col("total_cycles"))
    return joined.select(
        ENGINE, "total_cycles", "max_cycle", "min_cycle", streaming.alias("is_streaming"),
        F.when(live, F.col("min_cycle") + F.col("current_index")).alias("current_cycle"),
        F.when(live, F.col("current_index").cast("double") / F.col("total_cycles") * 100.0)
         .otherwise(F.lit(0.0)).alias("completion_percent"),
    )


def replay_progress(readings: DataFrame, engines: DataFrame, as_of: Column) -> DataFrame:
    """Readings delivered so far per streamed engine (batch stand-in for the
    replay cursor): count of readings with ``ts < as_of``."""
    return (readings.join(engines, ENGINE, "left_semi")
            .groupBy(ENGINE).agg(F.count_if(F.col("ts") < as_of).alias("current_index")))


def fleet_summary_v1(readings: DataFrame, alerts: DataFrame, preds: DataFrame, total_engines: DataFrame,
                     now: Column | None = None) -> DataFrame:
    """A4: engines, readings newer than 60 s among the latest 100, alerts
    whose type contains ``anomaly`` among the latest 20, mean predicted RUL
    of the latest 50, and the recent counts."""
    r = latest(readings, 100, ("timestamp", "event_id"))
    a = latest(alerts, 20, ("timestamp", "event_id", "alert_ord"))
    p = latest(preds, 50, ("timestamp", "event_id"))
    ref = now if now is not None else F.col("_now")
    rs = r.agg(F.count(F.lit(1)).alias("sensor_readings"), F.max("timestamp").alias("_now"),
               F.collect_list(F.struct("timestamp", ENGINE)).alias("_r"))
    rs = rs.select(
        "sensor_readings",
        F.size(F.filter("_r", lambda x: ref - x["timestamp"] < RECENT_SECONDS)).alias("active_engines"),
        F.size(F.array_distinct(F.transform(F.filter("_r", lambda x: ref - x["timestamp"] < RECENT_SECONDS),
                                            lambda x: x[ENGINE]))).alias("active_engine_count"),
    )
    al = a.agg(F.count(F.lit(1)).alias("alerts"), F.count_if(F.col("alert_type").contains("anomaly")).alias("critical_alerts"))
    pr = p.agg(F.count(F.lit(1)).alias("predictions"),
               F.coalesce(F.avg("predicted_rul"), F.lit(0.0)).alias("avg_predicted_rul"))
    return attach_row(attach_row(attach_row(total_engines, rs), al), pr)


def fleet_summary_v2(status: DataFrame, alerts: DataFrame, preds: DataFrame, stream_stats: DataFrame) -> DataFrame:
    """A5: active engines, alerts by severity, confidence-weighted mean RUL
    of the latest 50 predictions (0 when the weights sum to 0), error rate."""
    st = status.agg(F.count(F.lit(1)).alias("total_engines"), F.count_if("is_streaming").alias("active_engines"))
    a = latest(alerts, 20, ("timestamp", "event_id", "alert_ord")).agg(
        F.count_if(F.col("severity") == "high").alias("critical_alerts"),
        F.count_if(F.col("severity") == "medium").alias("medium_alerts"), F.count(F.lit(1)).alias("total_alerts"))
    p = latest(preds, 50, ("timestamp", "event_id")).agg(
        F.sum(F.col("predicted_rul") * F.col("confidence")).alias("_w"), F.sum("confidence").alias("_c"),
        F.count(F.lit(1)).alias("predictions"))
    wavg = F.when(F.col("_c") > 0, F.col("_w") / F.col("_c")).otherwise(F.lit(0.0))
    out = attach_row(attach_row(attach_row(st, a), p), stream_stats)
    return out.select("total_engines", "active_engines", "critical_alerts", "medium_alerts", "total_alerts",
                      F.round(wavg, 1).alias("avg_predicted_rul"), "predictions", "total_streamed", "errors",
                      (F.col("errors").cast("double") / F.greatest(F.lit(1), F.col("total_streamed"))).alias("error_rate"),
                      "uptime", "streaming_rate")


def stream_stats(validated: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Totals, errors, uptime (first → last reading), rate, error rate."""
    s = validated.agg(F.count(F.lit(1)).alias("total_streamed"), F.count_if(~F.col("is_valid")).alias("errors"),
                      (F.max(ts) - F.min(ts)).alias("uptime"), F.max(ts).alias("last_activity"))
    return s.select("total_streamed", "errors", "uptime", "last_activity",
                    F.coalesce(safe_div(F.col("total_streamed").cast("double"), F.col("uptime")), F.lit(0.0)).alias("streaming_rate"))


def topic_stats(topics: DataFrame, bound: int = TOPIC_BOUND) -> DataFrame:
    """Per topic, messages published, last activity, buffered size."""
    return topics.groupBy("topic").agg(
        F.count(F.lit(1)).alias("published"), F.max("timestamp").alias("last_activity"),
    ).withColumn("size", F.least(F.col("published"), F.lit(bound)))


def engine_history(readings: DataFrame, limit: int = 100, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """K4: the last ``limit`` readings of every engine with the engine's total
    and returned counts (positions are dense, so "last n" is a filter on the
    engine length — no per-engine sort)."""
    w = engine_aggregates(readings, [F.count(F.lit(1)).alias("total_records")], chunk_rows=chunk_rows)
    return (w.where(F.col(CYCLE) > F.col("total_records") - limit)
            .withColumn("returned_records", F.least(F.col("total_records"), F.lit(limit))))


def merge_settings(sensors: Column | str, settings: Column | str) -> Column:
    """Settings merged into the sensor map, later keys win."""
    a = F.col(sensors) if isinstance(sensors, str) else sensors
    b = F.col(settings) if isinstance(settings, str) else settings
    b = F.coalesce(b, F.create_map().cast("map<string,double>"))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def best_model(results: DataFrame, name: str = "model", metric: str = "rmse") -> DataFrame:
    """K6: lowest metric wins; failed runs (NULL metric) count as +inf."""
    m = F.coalesce(F.col(metric), F.lit(float("inf")))
    return results.agg(F.min_by(name, m).alias("best_model"), F.min(m).alias(f"best_{metric}"))


def engine_split(df: DataFrame, train_percent: int = 80, seed: int = 42, key: str = ENGINE) -> tuple[DataFrame, DataFrame]:
    """Repeatable split by engine (no engine in both parts): a hash of
    (seed, engine) decides, independent of partitioning."""
    label = split_label(train_percent, seed, key)
    return df.where(label == "train"), df.where(label == "test")


def split_bucket(seed: int = 42, key: str = ENGINE) -> Column:
    """0..99 from the md5 of seed and engine: any engine can compute it."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100


def split_label(train_percent: int = 80, seed: int = 42, key: str = ENGINE) -> Column:
    return F.when(split_bucket(seed, key) < train_percent, "train").otherwise("test")
