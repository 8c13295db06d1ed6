"""Registered queries: the live path on Structured Streaming (T1–T9, S10,
S11). Each query streams the files of the reading table (derived from
``events`` and written in parallel, several files a micro-batch, in no order of
time) with ``availableNow`` to the end and returns what the sinks hold. The
result does not depend on how the input was cut into micro-batches, so it must
equal the batch query, and the batch oracle SQL is reused."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as lb
from ..operators import quality as qa
from ..operators.stats import feature_stats
from ..session import table_version
from ..sources.tables import event_readings, with_timestamp
from ..streaming import sequence as sq
from ..streaming import stream as sm
from .common import with_readings
from .feature_queries import ROLL_SPEC, SENSORS, _rolling_sql
from .fleet_queries import ALERT_SPEC, ALERTS_SQL, PREDS_SQL, Z_SQL
from .quality_queries import RAW_SQL, validated
from .registry import REGISTRY, register

COUNTERS = ("total_validated", "validation_errors", "corrections_made")


def _readings(spark, sf_dir):
    r = with_timestamp(lb.add_rul(event_readings(spark, sf_dir)))
    return r.select("event_id", "engine_id", "cycle", "ts", "timestamp", F.col("ts").cast("timestamp").alias("event_time"),
                    *SENSORS, "setting_1", "RUL")


_SOURCES: dict = {}


def _source(spark, sf_dir, df=None):
    """A stream of the reading table's files (written once per session and
    input), or of another derived table's, and the written table."""
    if df is not None:
        return sm.stream_table(df, sm.shared_dir(spark, "source"))
    key = (spark.sparkContext.applicationId, *table_version(spark, f"{sf_dir.rstrip('/')}/events.parquet"))
    if key not in _SOURCES:
        path = sm.shared_dir(spark, "source")
        _readings(spark, sf_dir).write.parquet(path)
        _SOURCES[key] = path
    batch = spark.read.parquet(_SOURCES[key])
    return sm.archive_stream(batch, _SOURCES[key]), batch


def _lateness(batch) -> str:
    """Files of an archive come in no order of time, so that a reading may be
    late by all the time the table spans."""
    lo, hi = batch.agg(F.unix_seconds(F.min("event_time")), F.unix_seconds(F.max("event_time"))).first()
    return f"{(hi or 0) - (lo or 0) + 1} seconds"


_TOPIC_RUNS: dict = {}


def _run_topics(spark, sf_dir):
    """Run the fan-out stream once per session and input; the topic tables it
    leaves behind serve every query that reads a topic."""
    key = (spark.sparkContext.applicationId, *table_version(spark, f"{sf_dir.rstrip('/')}/events.parquet"))
    if key not in _TOPIC_RUNS:
        _TOPIC_RUNS[key] = _fan_out_stream(spark, sf_dir)
    return _TOPIC_RUNS[key]


def _fan_out_stream(spark, sf_dir):
    stream, batch = _source(spark, sf_dir)
    stats = feature_stats(batch, SENSORS)  # offline normalisation stats (one row)
    root = sm.shared_dir(spark, "topics")
    q = (stream.writeStream.foreachBatch(sm.fan_out(root, topics=sm.live_outputs(stats, SENSORS)))
         .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    sm.run_available(q)
    return root


@register("stream_alerts", ALERT_SPEC, with_readings("SELECT * FROM alerts", ALERTS_SQL), "T1 T2 S10 S11 R4")
def stream_alerts(spark, sf_dir):
    """T1 + T2: alerts raised on the stream and published to their topic
    (equal to the batch alert query)."""
    root = _run_topics(spark, sf_dir)
    return sm.topic_log(spark, root, "anomaly_alerts").drop("batch_id")


@register("stream_predictions",
          "event_id:l engine_id:l cycle:l timestamp:d predicted_rul:d confidence:d model_version:s features_used:s",
          with_readings("SELECT * FROM preds", Z_SQL, PREDS_SQL), "T1 T2")
def stream_predictions(spark, sf_dir):
    """T1 + T2: live RUL estimates from the prediction topic."""
    root = _run_topics(spark, sf_dir)
    return sm.topic_log(spark, root, "rul_predictions").drop("batch_id")


@register("stream_latest_alerts", ALERT_SPEC, with_readings(
    "SELECT * FROM alerts ORDER BY timestamp DESC, event_id DESC, alert_ord DESC LIMIT 20", ALERTS_SQL), "T3 K2")
def stream_latest_alerts(spark, sf_dir):
    """The bounded (1000) alert buffer after the stream, read latest 20."""
    root = _run_topics(spark, sf_dir)
    buf = sm.latest_version(spark, f"{root}/anomaly_alerts/latest")
    return buf.orderBy(F.col("timestamp").desc(), F.col("event_id").desc(), F.col("alert_ord").desc()).limit(20)


@register("stream_alert_buffer", ALERT_SPEC, with_readings(
    "SELECT * FROM alerts ORDER BY timestamp DESC, event_id DESC, alert_ord DESC LIMIT 100", ALERTS_SQL), "T3")
def stream_alert_buffer(spark, sf_dir):
    """T3 with a bound of 100, far fewer than the alerts, read whole."""
    stream, batch = _source(spark, sf_dir)
    alerts = {"anomaly_alerts": sm.live_outputs(feature_stats(batch, SENSORS), SENSORS)["anomaly_alerts"]}
    root = sm.shared_dir(spark, "buffer")
    write = sm.fan_out(root, bound=100, topics=alerts, order=("timestamp", "event_id", "alert_ord"))
    sm.run_available(stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/_checkpoint")
                     .trigger(availableNow=True).start())
    return sm.latest_version(spark, f"{root}/anomaly_alerts/latest")


def _upsert_run(spark, agg_stream, keys, name):
    root = sm.shared_dir(spark, name)
    q = (agg_stream.writeStream.outputMode("update").foreachBatch(sm.upsert_log(root, keys, every=2))
         .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    sm.run_available(q)
    return sm.read_upserts(spark, root, keys)


@register("stream_topic_counters", "topic:s published:l last_activity:d size:l", with_readings(
    """SELECT topic, count(*) AS published, max(timestamp) AS last_activity, least(count(*), 1000) AS size FROM (
  SELECT 'sensor_data' AS topic, timestamp FROM z UNION ALL SELECT 'anomaly_alerts', timestamp FROM alerts
  UNION ALL SELECT 'rul_predictions', timestamp FROM preds) t GROUP BY topic""", ALERTS_SQL, PREDS_SQL), "T4 A15")
def stream_topic_counters(spark, sf_dir):
    """T4: live published / last-activity counters per topic."""
    stream, batch = _source(spark, sf_dir)
    outs = sm.live_outputs(feature_stats(batch, SENSORS), SENSORS)
    published = None
    for topic, derive in outs.items():
        part = derive(stream).select(F.lit(topic).alias("topic"), "timestamp")
        published = part if published is None else published.unionByName(part)
    counters = _upsert_run(spark, sm.topic_counters(published), ["topic"], "counters")
    return counters.withColumn("size", F.least(F.col("published"), F.lit(sm.TOPIC_BOUND)))


@register("stream_engine_progress", "engine_id:l readings_seen:l max_cycle:l", with_readings(
    "SELECT engine_id, count(*) AS readings_seen, max(cycle) AS max_cycle FROM readings GROUP BY engine_id"), "T5")
def stream_engine_progress(spark, sf_dir):
    """T5: per-engine position in its life, kept in the state store."""
    stream, _ = _source(spark, sf_dir)
    return _upsert_run(spark, sm.engine_progress(stream), ["engine_id"], "progress")


@register("stream_staleness", "engine_id:l last_seen:d issue:s", with_readings(
    """SELECT engine_id, epoch_us(ts) / 1e6 AS last_seen, 'No streaming activity in last 60 seconds' AS issue
FROM (SELECT engine_id, ts, lead(ts) OVER (PARTITION BY engine_id ORDER BY cycle) AS nxt,
             max(ts) OVER () AS t_end FROM readings) t
WHERE (nxt IS NOT NULL AND epoch_us(nxt) / 1e6 - epoch_us(ts) / 1e6 > 60)
   OR (nxt IS NULL AND epoch_ms(t_end) > epoch_ms(ts) + 60000)"""), "T6 R9")
def stream_staleness(spark, sf_dir):
    """Staleness events — one per silence of more than 60 s of event
    time, from gaps between readings, event-time timers and, for engines that
    are silent when the table ends, the stream's state."""
    stream, batch = _source(spark, sf_dir)
    root = sm.shared_dir(spark, "stale")
    _to_end(sq.staleness_events(stream, watermark=_lateness(batch)), root)
    now = batch.agg(F.max("timestamp")).first()[0]
    told = spark.read.schema(sq.STALE_SCHEMA).parquet(f"{root}/out")
    return told.unionByName(sq.open_silences(spark, f"{root}/_checkpoint", now)) if now is not None else told


def _to_end(out, root):
    """Run an append-mode stream into ``root/out`` until its input ends."""
    sm.run_available(out.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
                     .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())


def _validated_readings(spark, sf_dir):
    """Numeric ids + text measures with the fault rules of the validation
    queries; validity from Q1–Q5 (ids are numeric here, so only their
    presence is checked), plus a sensor outage on every 7th engine."""
    from .quality_queries import learned_ranges_df, raw_records

    raw = raw_records(spark, sf_dir)
    rng = learned_ranges_df(spark, sf_dir)
    base = _readings(spark, sf_dir).select("event_id", "engine_id", "cycle", "event_time")
    text = raw.select("event_id", "timestamp", "sensor_1", "sensor_2", "setting_1")
    v = qa.validate(base.join(text, "event_id"), rng, sensors=["sensor_1", "sensor_2"], settings=["setting_1"])
    outage = (F.col("engine_id") % 7 == 0) & F.col("cycle").between(10, 16)
    return v.select("event_id", "engine_id", "cycle", "event_time", (F.col("is_valid") & ~outage).alias("is_valid"))


VALID_SQL = f"""vt AS (
  SELECT r.event_id, r.engine_id, r.cycle, r.ts,
         NOT (raw.timestamp IS NULL OR TRY_CAST(raw.timestamp AS DOUBLE) IS NULL
              OR TRY_CAST(raw.sensor_1 AS DOUBLE) IS NULL OR TRY_CAST(raw.sensor_2 AS DOUBLE) IS NULL
              OR TRY_CAST(raw.setting_1 AS DOUBLE) IS NULL)
         AND NOT (r.engine_id % 7 = 0 AND r.cycle BETWEEN 10 AND 16) AS is_valid
  FROM readings r JOIN raw ON r.event_id = raw.event_id)"""

GUARD_SQL = """runs AS (SELECT *, cycle - row_number() OVER (PARTITION BY engine_id, is_valid ORDER BY cycle) AS grp FROM vt),
rl AS (SELECT *, CASE WHEN NOT is_valid THEN row_number() OVER (PARTITION BY engine_id, is_valid, grp ORDER BY cycle) END AS run
       FROM runs),
cut AS (SELECT engine_id, min(cycle) AS drop_cycle FROM rl WHERE run > 5 GROUP BY engine_id)"""


@register("stream_error_guard", "event_id:l engine_id:l cycle:l is_valid:b delivered:b", with_readings(
    """SELECT rl.event_id, rl.engine_id, rl.cycle, rl.is_valid,
       rl.is_valid AND (cut.drop_cycle IS NULL OR rl.cycle < cut.drop_cycle) AS delivered
FROM rl LEFT JOIN cut ON rl.engine_id = cut.engine_id""", RAW_SQL, VALID_SQL, GUARD_SQL), "T7 Q7")
def stream_error_guard(spark, sf_dir):
    """Engines stop after more than five consecutive invalid readings."""
    stream, batch = _source(spark, sf_dir, _validated_readings(spark, sf_dir))
    root = sm.shared_dir(spark, "guard")
    out = sq.error_run_guard(stream, watermark=_lateness(batch))
    _to_end(out, root)
    return spark.read.schema(out.schema).parquet(f"{root}/out").select("event_id", "engine_id", "cycle", "is_valid", "delivered")


@register("stream_health_windows", "window_start:d total:l errors:l issue:s", with_readings(
    """SELECT epoch_us(date_trunc('day', ts)) / 1e6 AS window_start, count(*) AS total,
       count(*) FILTER (WHERE NOT is_valid) AS errors,
       CASE WHEN CAST(count(*) FILTER (WHERE NOT is_valid) AS DOUBLE) / greatest(1, count(*)) > 0.05
            THEN 'High error rate: ' || printf('%.2f', CAST(count(*) FILTER (WHERE NOT is_valid) AS DOUBLE) / greatest(1, count(*)) * 100) || '%'
       END AS issue
FROM vt GROUP BY 1""", RAW_SQL, VALID_SQL), "T8 R8")
def stream_health_windows(spark, sf_dir):
    """Health issues (error rate > 5 %) per day of event time."""
    stream, batch = _source(spark, sf_dir, _validated_readings(spark, sf_dir))
    out = _upsert_run(spark, sm.health_windows(stream, watermark=_lateness(batch)), ["window_start"], "health")
    return out.withColumn("window_start", F.unix_micros("window_start") / 1e6)


@register("stream_rolling_features", ROLL_SPEC, _rolling_sql(), "T9 W1 W2 W3 W4")
def stream_rolling_features(spark, sf_dir):
    """Rolling features computed on the stream with bounded per-engine
    state (equal to the batch windows)."""
    return _rolling_run(spark, sf_dir)


DEG_STREAM_SPEC = "engine_id:l cycle:l " + " ".join(f"{s}_trend:d {s}_diff:d" for s in SENSORS)


@register("stream_degradation", DEG_STREAM_SPEC, with_readings(
    "SELECT engine_id, cycle, " + ", ".join(
        f"{s} - first_value({s}) OVER (PARTITION BY engine_id ORDER BY cycle) AS {s}_trend, "
        f"coalesce({s} - lag({s}) OVER (PARTITION BY engine_id ORDER BY cycle), 0.0) AS {s}_diff" for s in SENSORS)
    + " FROM readings"), "T9 W7 W8")
def stream_degradation(spark, sf_dir):
    """Trend (vs. first reading) and first difference on the stream."""
    return _rolling_run(spark, sf_dir)


def _rolling_run(spark, sf_dir):
    stream, batch = _source(spark, sf_dir)
    root = sm.shared_dir(spark, "rolling")
    out = sq.rolling_stream(stream, SENSORS, watermark=_lateness(batch))
    _to_end(out, root)
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@register("stream_validation_counters", "total_validated:l validation_errors:l corrections_made:l", REGISTRY["validation_counters"].sql, "Q7 A16")
def stream_validation_counters(spark, sf_dir):
    """Q7 on a stream: counters observed on the way to the sink and taken from
    the query's progress (equal to the batch counters)."""
    stream, _ = _source(spark, sf_dir, validated(spark, sf_dir).select("event_id", "is_valid", "n_corrections"))
    root = sm.shared_dir(spark, "observed")
    q = (sm.observed(stream).writeStream.format("noop").option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start())
    sm.run_available(q)
    t = sm.Progress().update(q).totals
    return spark.createDataFrame([tuple(int(t.get(c, 0)) for c in COUNTERS)], ", ".join(f"{c} long" for c in COUNTERS))
