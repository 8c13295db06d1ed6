"""Registered queries: rules (R), fleet views and topics (A2–A5, A12, A15,
A16, J3, K2–K4, K6), statistics (A6–A14), logs (A17, A18), evaluation (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import attach_row

from ..operators import evaluate as ev
from ..operators import fleet as fl
from ..operators import labels as lb
from ..operators import logs as lg
from ..operators import rules as ru
from ..operators import stats as st
from ..operators.clean import chosen_engines
from ..operators.stats import zscore
from ..sources.tables import event_base, event_readings, table, with_timestamp
from .common import WE, dbl, with_readings
from .quality_queries import RANGES_SQL, RAW_SQL, VALIDATED_BODY, VALIDATED_SQL, faulty_readings, FAULTY_SQL, validated
from .registry import register

SENSORS = ["sensor_1", "sensor_2", "sensor_3"]
AS_OF = "2024-01-20"


def normalised(spark, sf_dir):
    """Readings with epoch timestamp and z-scored sensors: what the alert rules
    read. No per-engine value, so no shuffle."""
    r = with_timestamp(event_readings(spark, sf_dir))
    return zscore(r, SENSORS, st.feature_stats(event_base(spark, sf_dir), SENSORS))


def scored(spark, sf_dir):
    """:func:`normalised` with RUL."""
    return lb.add_rul(normalised(spark, sf_dir))


def scored_ends(spark, sf_dir, take):
    """RUL for the few readings that ``take`` picks: the lengths of their
    engines only (an engine list no longer than the pick)."""
    some = take(normalised(spark, sf_dir))
    lengths = event_readings(spark, sf_dir, columns=[]).join(some.select("engine_id").distinct(), "engine_id", "left_semi")
    lengths = lengths.groupBy("engine_id").agg(F.max("cycle").alias("_last"))
    return some.join(lengths, "engine_id", "left").withColumn("RUL", F.col("_last") - F.col("cycle")).drop("_last")


def prediction_rows(df):
    p = ru.predictions(df, base="RUL", sensors=SENSORS)
    return p.withColumn("features_used", F.array_join("features_used", ","))


Z_SQL = f"""stats AS (SELECT
   avg(sensor_1) AS m1, CASE WHEN stddev_pop(sensor_1) > 0 THEN stddev_pop(sensor_1) ELSE 1.0 END AS sd1,
   avg(sensor_2) AS m2, CASE WHEN stddev_pop(sensor_2) > 0 THEN stddev_pop(sensor_2) ELSE 1.0 END AS sd2,
   avg(sensor_3) AS m3, CASE WHEN stddev_pop(sensor_3) > 0 THEN stddev_pop(sensor_3) ELSE 1.0 END AS sd3
 FROM readings),
z AS (SELECT event_id, engine_id, cycle, ts, event_type, epoch_us(ts) / 1e6 AS timestamp, setting_1,
             max(cycle) OVER ({WE}) - cycle AS RUL,
             (sensor_1 - m1) / sd1 AS sensor_1, (sensor_2 - m2) / sd2 AS sensor_2, (sensor_3 - m3) / sd3 AS sensor_3
      FROM readings CROSS JOIN stats)"""


def _alert_branch(ordexpr: str, where: str, kind: str, sensor: str | None, value: str | None, sensors: str | None,
                  score: str | None) -> str:
    thr = "3.0" if kind == "threshold_exceeded" else "NULL"
    return (f"SELECT event_id, engine_id, cycle, timestamp, {ordexpr} AS alert_ord, '{kind}' AS alert_type, "
            f"'medium' AS severity, 'Anomaly detected: {kind}' AS message, "
            f"{repr(sensor) if sensor else 'NULL'} AS sensor, {value or 'NULL'} AS value, {thr} AS threshold, "
            f"{repr(sensors) if sensors else 'NULL'} AS sensors, {score or 'NULL'} AS correlation_score "
            f"FROM flags WHERE {where}")


ALERTS_SQL = Z_SQL + """,
flags AS (SELECT *, CAST(abs(sensor_1) > 3.0 AS INT) AS f1, CAST(abs(sensor_2) > 3.0 AS INT) AS f2,
                 CAST(abs(sensor_3) > 3.0 AS INT) AS f3, CAST(abs(sensor_1 - sensor_2) > 2.5 AS INT) AS fp FROM z),
alerts AS (
""" + "\nUNION ALL\n".join([
    _alert_branch("0", "f1 = 1", "threshold_exceeded", "sensor_1", "sensor_1", None, None),
    _alert_branch("f1", "f2 = 1", "threshold_exceeded", "sensor_2", "sensor_2", None, None),
    _alert_branch("f1 + f2", "f3 = 1", "threshold_exceeded", "sensor_3", "sensor_3", None, None),
    _alert_branch("f1 + f2 + f3", "fp = 1", "correlation_anomaly", None, None, "sensor_1,sensor_2",
                  "abs(sensor_1 - sensor_2)"),
]) + ")"

PREDS_SQL = """preds AS (SELECT event_id, engine_id, cycle, timestamp,
   greatest(0.0, CAST(RUL AS DOUBLE) * (1.0 - greatest(0.0, (cycle - 1) / 100.0))) AS predicted_rul,
   greatest(0.5, 1.0 - greatest(0.0, (cycle - 1) / 100.0)) AS confidence,
   'improved_v1.0' AS model_version, 'sensor_1,sensor_2,sensor_3' AS features_used FROM z)"""


def alert_table(spark, sf_dir):
    a = ru.alerts(normalised(spark, sf_dir), SENSORS)
    return a.select("event_id", "engine_id", "cycle", "timestamp", "alert_ord", "alert_type", "severity", "message",
                    F.col("details.sensor").alias("sensor"), F.col("details.value").alias("value"),
                    F.col("details.threshold").alias("threshold"),
                    F.array_join("details.sensors", ",").alias("sensors"),
                    F.col("details.correlation_score").alias("correlation_score"))


def prediction_table(spark, sf_dir):
    return prediction_rows(scored(spark, sf_dir))


ALERT_SPEC = ("event_id:l engine_id:l cycle:l timestamp:d alert_ord:l alert_type:s severity:s message:s sensor:s "
              "value:d threshold:d sensors:s correlation_score:d")


@register("sensor_alerts", ALERT_SPEC, with_readings("SELECT * FROM alerts", ALERTS_SQL), "R2 R3 R4 S8")
def sensor_alerts(spark, sf_dir):
    """Per-sensor threshold alerts and the pair-gap alert over
    normalised readings, one row per alert."""
    return alert_table(spark, sf_dir)


@register("pair_alerts", "event_id:l engine_id:l cycle:l alert_type:s details:s", with_readings(
    """SELECT event_id, engine_id, cycle, 'sensor_anomaly' AS alert_type,
       'Sensor values outside normal range: sensor_1=' || printf('%.3f', sensor_1) || ', sensor_2=' || printf('%.3f', sensor_2) AS details
FROM z WHERE abs(sensor_1) > 2.0 OR abs(sensor_2) > 2.0""", Z_SQL), "R1 F9")
def pair_alerts(spark, sf_dir):
    """The v1 two-sensor alert with fixed-decimal detail text."""
    return ru.pair_alert(normalised(spark, sf_dir)).select("event_id", "engine_id", "cycle", "alert_type", "details")


@register("rul_predictions",
          "event_id:l engine_id:l cycle:l timestamp:d predicted_rul:d confidence:d model_version:s features_used:s",
          with_readings("SELECT * FROM preds", Z_SQL, PREDS_SQL), "R5 R6")
def rul_predictions(spark, sf_dir):
    """R5 + R6: rule estimate of remaining life and its confidence."""
    return prediction_table(spark, sf_dir)


@register("engine_history",
          "engine_id:l cycle:l total_records:l returned_records:l sensor_1:d anomaly_score:d is_anomaly:b",
          with_readings(f"""SELECT engine_id, cycle, count(*) OVER ({WE}) AS total_records,
       least(count(*) OVER ({WE}), 25) AS returned_records, sensor_1,
       0.1 + abs(sensor_1) * 0.1 AS anomaly_score, 0.1 + abs(sensor_1) * 0.1 > 0.5 AS is_anomaly
FROM z QUALIFY cycle > count(*) OVER ({WE}) - 25""", Z_SQL), "K4 R7")
def engine_history(spark, sf_dir):
    """K4 + R7: last 25 readings of every engine with totals and the
    history anomaly score."""
    h = fl.engine_history(normalised(spark, sf_dir), limit=25)
    return h.select("engine_id", "cycle", "total_records", "returned_records", "sensor_1",
                    ru.history_score("sensor_1").alias("anomaly_score"),
                    ru.history_flag(ru.history_score("sensor_1")).alias("is_anomaly"))


@register("latest_alerts", ALERT_SPEC, with_readings(
    "SELECT * FROM alerts ORDER BY timestamp DESC, event_id DESC, alert_ord DESC LIMIT 20", ALERTS_SQL), "K2")
def latest_alerts(spark, sf_dir):
    """K2: the newest 20 alerts (top-N, not a sort of the topic)."""
    return fl.latest(alert_table(spark, sf_dir), 20, ("timestamp", "event_id", "alert_ord"))


@register("oldest_predictions",
          "event_id:l engine_id:l cycle:l timestamp:d predicted_rul:d confidence:d model_version:s features_used:s",
          with_readings("SELECT * FROM preds ORDER BY timestamp, event_id LIMIT 10", Z_SQL, PREDS_SQL), "K3")
def oldest_predictions(spark, sf_dir):
    """K3: the 10 oldest predictions — what a draining consumer reads first."""
    return prediction_rows(scored_ends(spark, sf_dir, lambda r: fl.oldest(r, 10, ("timestamp", "event_id"))))


@register("engine_status", "engine_id:l total_cycles:l max_rul:l min_rul:l avg_sensor_1:d", with_readings(
    "SELECT engine_id, count(*) AS total_cycles, max(RUL) AS max_rul, min(RUL) AS min_rul, avg(sensor_1) AS avg_sensor_1 "
    "FROM z GROUP BY engine_id", Z_SQL), "A2")
def engine_status(spark, sf_dir):
    """A2: per-engine totals, RUL range and mean sensor_1."""
    return fl.engine_status_v1(normalised(spark, sf_dir))


PROGRESS_SQL = f"""prog AS (SELECT engine_id, count(*) FILTER (WHERE ts < TIMESTAMP '{AS_OF}') AS current_index FROM readings
  WHERE engine_id IN (SELECT DISTINCT engine_id FROM readings ORDER BY engine_id LIMIT 5) GROUP BY engine_id),
status AS (SELECT b.engine_id, total_cycles, max_cycle, min_cycle, current_index IS NOT NULL AS is_streaming,
   CASE WHEN current_index IS NOT NULL AND current_index < total_cycles THEN min_cycle + current_index END AS current_cycle,
   CASE WHEN current_index IS NOT NULL AND current_index < total_cycles
        THEN CAST(current_index AS DOUBLE) / total_cycles * 100.0 ELSE 0.0 END AS completion_percent
 FROM (SELECT engine_id, count(*) AS total_cycles, max(cycle) AS max_cycle, min(cycle) AS min_cycle
       FROM readings GROUP BY engine_id) b LEFT JOIN prog p ON b.engine_id = p.engine_id)"""


def status_table(spark, sf_dir):
    r = event_readings(spark, sf_dir, columns=[])
    progress = fl.replay_progress(r, chosen_engines(r).select("engine_id").distinct(),
                                  F.lit(AS_OF).cast("timestamp_ntz"))
    return fl.engine_status_v2(r, progress)


@register("engine_status_live",
          "engine_id:l total_cycles:l max_cycle:l min_cycle:l is_streaming:b current_cycle:l completion_percent:d",
          with_readings("SELECT * FROM status", PROGRESS_SQL), "A3 J3")
def engine_status_live(spark, sf_dir):
    """A3 + J3: engine status joined to the replay progress of the five
    streamed engines as of 2024-01-20."""
    return status_table(spark, sf_dir)


@register("fleet_summary",
          "total_engines:l sensor_readings:l active_engines:l active_engine_count:l alerts:l critical_alerts:l "
          "predictions:l avg_predicted_rul:d",
          with_readings("""SELECT (SELECT count(DISTINCT engine_id) FROM z) AS total_engines,
  (SELECT count(*) FROM r100) AS sensor_readings,
  (SELECT count(*) FROM r100 WHERE (SELECT max(timestamp) FROM r100) - timestamp < 60) AS active_engines,
  (SELECT count(DISTINCT engine_id) FROM r100 WHERE (SELECT max(timestamp) FROM r100) - timestamp < 60) AS active_engine_count,
  (SELECT count(*) FROM a20) AS alerts,
  (SELECT count(*) FROM a20 WHERE alert_type LIKE '%anomaly%') AS critical_alerts,
  (SELECT count(*) FROM p50) AS predictions,
  (SELECT coalesce(avg(predicted_rul), 0.0) FROM p50) AS avg_predicted_rul""",
              ALERTS_SQL, PREDS_SQL,
              "r100 AS (SELECT * FROM z ORDER BY timestamp DESC, event_id DESC LIMIT 100)",
              "a20 AS (SELECT * FROM alerts ORDER BY timestamp DESC, event_id DESC, alert_ord DESC LIMIT 20)",
              "p50 AS (SELECT * FROM preds ORDER BY timestamp DESC, event_id DESC LIMIT 50)"), "A4 A12")
def fleet_summary(spark, sf_dir):
    """A4: dashboard summary v1 over the latest-N topic reads."""
    engines = event_base(spark, sf_dir).agg(F.count_distinct("engine_id").alias("total_engines"))
    preds = prediction_rows(scored_ends(spark, sf_dir, lambda r: fl.latest(r, 50, ("timestamp", "event_id"))))
    return fl.fleet_summary_v1(normalised(spark, sf_dir), alert_table(spark, sf_dir), preds, engines)


@register("fleet_summary_v2",
          "total_engines:l active_engines:l critical_alerts:l medium_alerts:l total_alerts:l avg_predicted_rul:d "
          "predictions:l total_streamed:l errors:l error_rate:d uptime:d streaming_rate:d",
          with_readings("""SELECT total_engines, active_engines, critical_alerts, medium_alerts, total_alerts,
  round(CASE WHEN c > 0 THEN w / c ELSE 0.0 END, 1) AS avg_predicted_rul, predictions, total_streamed, errors,
  CAST(errors AS DOUBLE) / greatest(1, total_streamed) AS error_rate, uptime,
  coalesce(total_streamed / nullif(uptime, 0), 0.0) AS streaming_rate
FROM (SELECT count(*) AS total_engines, count(*) FILTER (WHERE is_streaming) AS active_engines FROM status) s,
     (SELECT count(*) FILTER (WHERE severity = 'high') AS critical_alerts, count(*) FILTER (WHERE severity = 'medium') AS medium_alerts,
             count(*) AS total_alerts FROM a20) a,
     (SELECT sum(predicted_rul * confidence) AS w, sum(confidence) AS c, count(*) AS predictions FROM p50) p,
     (SELECT count(*) AS total_streamed, count(*) FILTER (WHERE NOT is_valid) AS errors,
             max(timestamp) - min(timestamp) AS uptime FROM vd) x""",
              ALERTS_SQL, PREDS_SQL, PROGRESS_SQL, RAW_SQL, RANGES_SQL, VALIDATED_SQL,
              "vd AS (" + VALIDATED_BODY + ")",
              "a20 AS (SELECT * FROM alerts ORDER BY timestamp DESC, event_id DESC, alert_ord DESC LIMIT 20)",
              "p50 AS (SELECT * FROM preds ORDER BY timestamp DESC, event_id DESC LIMIT 50)"), "A5 A16")
def fleet_summary_v2(spark, sf_dir):
    """A5: dashboard summary v2 (severity counts, confidence-weighted RUL,
    stream error rate and throughput)."""
    return fl.fleet_summary_v2(status_table(spark, sf_dir), alert_table(spark, sf_dir),
                               prediction_rows(scored_ends(spark, sf_dir, lambda r: fl.latest(r, 50, ("timestamp", "event_id")))),
                               fl.stream_stats(validated(spark, sf_dir)))


@register("topic_stats", "topic:s published:l last_activity:d size:l", with_readings(
    """SELECT topic, count(*) AS published, max(timestamp) AS last_activity, least(count(*), 1000) AS size FROM (
  SELECT 'sensor_data' AS topic, timestamp FROM z UNION ALL SELECT 'anomaly_alerts', timestamp FROM alerts
  UNION ALL SELECT 'rul_predictions', timestamp FROM preds) t GROUP BY topic""", ALERTS_SQL, PREDS_SQL), "A15 T4")
def topic_stats(spark, sf_dir):
    """Messages published, last activity and bounded size per topic."""
    # one estimate a reading: what it says is not needed to count it, nor the RUL it comes from
    s = normalised(spark, sf_dir)
    estimates = ru.predictions(s.withColumn("RUL", F.lit(None).cast("long")), base="RUL", sensors=SENSORS)
    topics = (s.select(F.lit("sensor_data").alias("topic"), "timestamp")
              .unionByName(alert_table(spark, sf_dir).select(F.lit("anomaly_alerts").alias("topic"), "timestamp"))
              .unionByName(estimates.select(F.lit("rul_predictions").alias("topic"), "timestamp")))
    return fl.topic_stats(topics)


@register("system_health",
          "total_streamed:l errors:l uptime:d streaming_rate:d error_rate:d error_issue:s idle_issue:s status:s",
          with_readings("""SELECT total_streamed, errors, uptime, coalesce(total_streamed / nullif(uptime, 0), 0.0) AS streaming_rate,
  CAST(errors AS DOUBLE) / greatest(1, total_streamed) AS error_rate,
  CASE WHEN CAST(errors AS DOUBLE) / greatest(1, total_streamed) > 0.05
       THEN 'High error rate: ' || printf('%.2f', CAST(errors AS DOUBLE) / greatest(1, total_streamed) * 100) || '%' END AS error_issue,
  CASE WHEN now - last_activity > 60.0 THEN 'No streaming activity in last 60 seconds' END AS idle_issue,
  CASE WHEN CAST(errors AS DOUBLE) / greatest(1, total_streamed) > 0.05 OR now - last_activity > 60.0
       THEN 'degraded' ELSE 'healthy' END AS status
FROM (SELECT count(*) AS total_streamed, count(*) FILTER (WHERE NOT is_valid) AS errors,
             max(timestamp) - min(timestamp) AS uptime, max(timestamp) AS last_activity FROM vd) s,
     (SELECT epoch_us(max(ts)) / 1e6 AS now FROM events) n""",
              RAW_SQL, RANGES_SQL, VALIDATED_SQL, "vd AS (" + VALIDATED_BODY + ")"), "A16 R8 R9 R10")
def system_health(spark, sf_dir):
    """A16 + R8–R10: stream statistics, health issues and system status,
    evaluated at the time of the last event."""
    s = fl.stream_stats(validated(spark, sf_dir))
    now = table(spark, sf_dir, "events").agg((F.unix_micros(F.max("ts").cast("timestamp")) / 1e6).alias("now"))
    s = attach_row(s, now)
    err = ru.error_rate_issue(F.col("errors"), F.col("total_streamed"))
    idle = ru.idle_issue(F.col("last_activity"), F.col("now"))
    return s.select("total_streamed", "errors", "uptime", "streaming_rate",
                    (F.col("errors").cast("double") / F.greatest(F.lit(1), F.col("total_streamed"))).alias("error_rate"),
                    err.alias("error_issue"), idle.alias("idle_issue"), ru.system_status(err, idle).alias("status"))


@register("engine_staleness", "engine_id:l last_seen:d idle_seconds:d idle_issue:s", with_readings(
    """SELECT engine_id, last_seen, now - last_seen AS idle_seconds,
       CASE WHEN now - last_seen > 60.0 THEN 'No streaming activity in last 60 seconds' END AS idle_issue
FROM (SELECT engine_id, epoch_us(max(ts)) / 1e6 AS last_seen FROM readings GROUP BY engine_id) e,
     (SELECT epoch_us(max(ts)) / 1e6 AS now FROM readings) n"""), "R9 T6")
def engine_staleness(spark, sf_dir):
    """R9 per engine (batch form of T6): idle time of each engine at the
    table's last reading."""
    r = with_timestamp(event_readings(spark, sf_dir, columns=[]))
    last = r.groupBy("engine_id").agg(F.max("timestamp").alias("last_seen"))
    now = r.agg(F.max("timestamp").alias("now"))
    out = attach_row(last, now)
    return out.select("engine_id", "last_seen", (F.col("now") - F.col("last_seen")).alias("idle_seconds"),
                      ru.idle_issue(F.col("last_seen"), F.col("now")).alias("idle_issue"))


# ---------------------------------------------------------------- statistics


@register("class_counts", "healthy:l degraded:l", with_readings(
    f"""SELECT count(*) FILTER (WHERE is_anomaly = 0) AS healthy, count(*) FILTER (WHERE is_anomaly = 1) AS degraded FROM (
  SELECT CAST(coalesce(RUL / nullif(CAST(max(RUL) OVER ({WE}) AS DOUBLE), 0) < {dbl(1 - 0.8)}, false) AS INT) AS is_anomaly
  FROM (SELECT engine_id, max(cycle) OVER ({WE}) - cycle AS RUL FROM readings) t) u"""), "A6")
def class_counts(spark, sf_dir):
    """Healthy / degraded reading counts."""
    r = lb.rul_and_life_fraction(event_readings(spark, sf_dir, columns=[]))
    return r.agg(F.count_if(F.col("is_anomaly") == 0).alias("healthy"), F.count_if(F.col("is_anomaly") == 1).alias("degraded"))


DESCRIBE = "count:l mean:d std:d min:d p25:d p50:d p75:d max:d"


def _describe_sql(x: str) -> str:
    return (f"count({x}) AS count, avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS min, "
            f"quantile_cont({x}, 0.25) AS p25, quantile_cont({x}, 0.5) AS p50, quantile_cont({x}, 0.75) AS p75, "
            f"max({x}) AS max")


@register("lifecycle_stats", DESCRIBE, with_readings(
    "SELECT " + _describe_sql("life") + " FROM (SELECT max(cycle) AS life FROM readings GROUP BY engine_id) t"), "A7")
def lifecycle_stats(spark, sf_dir):
    """describe() of engine lifetimes (max cycle per engine)."""
    life = event_readings(spark, sf_dir, columns=[]).groupBy("engine_id").agg(F.max("cycle").alias("life"))
    return life.agg(*st.describe(life, "life"))


@register("rul_stats", DESCRIBE, with_readings(
    "SELECT " + _describe_sql("RUL") + f" FROM (SELECT max(cycle) OVER ({WE}) - cycle AS RUL FROM readings) t"), "A8")
def rul_stats(spark, sf_dir):
    """describe() of the RUL target."""
    r = lb.add_rul(event_readings(spark, sf_dir, columns=[]))
    return r.agg(*st.describe(r, "RUL"))


def _hist_sql(x: str, src: str, n: int) -> str:
    return (f"""SELECT CAST(least(floor(coalesce(({x} - lo) / nullif(hi - lo, 0), 0.0) * {n}), {n - 1}) AS BIGINT) AS bin,
       lo + CAST(least(floor(coalesce(({x} - lo) / nullif(hi - lo, 0), 0.0) * {n}), {n - 1}) AS BIGINT) * (hi - lo) / {n} AS bin_start,
       count(*) AS n
FROM {src} CROSS JOIN (SELECT min({x}) AS lo, max({x}) AS hi FROM {src}) r WHERE {x} IS NOT NULL GROUP BY ALL""")


@register("sensor_histogram", "bin:l bin_start:d n:l", with_readings(
    _hist_sql("sensor_1", "readings", 20)), "A9")
def sensor_histogram(spark, sf_dir):
    """20 equal-width bins of sensor_1."""
    return st.histogram(event_readings(spark, sf_dir, columns=["sensor_1"]), "sensor_1", 20)


@register("rul_histogram", "bin:l bin_start:d n:l", with_readings(
    _hist_sql("RUL", "rr", 50), f"rr AS (SELECT CAST(max(cycle) OVER ({WE}) - cycle AS DOUBLE) AS RUL FROM readings)"), "A9")
def rul_histogram(spark, sf_dir):
    """50 equal-width bins of RUL."""
    r = lb.add_rul(event_readings(spark, sf_dir, columns=[])).withColumn("RUL", F.col("RUL").cast("double"))
    return st.histogram(r, "RUL", 50)


CORR_COLS = ["sensor_1", "sensor_2", "sensor_3", "setting_1"]


@register("sensor_correlation", "feature_a:s feature_b:s corr:d", with_readings(
    " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS corr FROM readings"
                       for a in CORR_COLS for b in CORR_COLS)), "A10")
def sensor_correlation(spark, sf_dir):
    """A10: Pearson correlation matrix (long form), one aggregate pass."""
    return st.correlation_long(event_readings(spark, sf_dir), CORR_COLS)


@register("missing_counts", "feature:s missing:l", with_readings(
    """SELECT 'sensor_1' AS feature, count(*) FILTER (WHERE sensor_1 IS NULL OR isnan(sensor_1)) AS missing FROM faulty
UNION ALL SELECT 'RUL', count(*) FILTER (WHERE RUL IS NULL) FROM faulty""", FAULTY_SQL), "A11")
def missing_counts(spark, sf_dir):
    """Missing values per column of the fault-injected readings."""
    return st.missing_counts(faulty_readings(spark, sf_dir), ["sensor_1", "RUL"])


@register("record_counts", "total_engines:l total_records:l", """
SELECT count(DISTINCT user_id) AS total_engines, count(*) AS total_records FROM events""", "A12 D1")
def record_counts(spark, sf_dir):
    """Number of engines and readings."""
    return table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("total_engines"),
                                               F.count(F.lit(1)).alias("total_records"))


@register("score_percentiles", "p95_nearest_rank:d p95_linear:d", with_readings(
    """SELECT (SELECT s FROM (SELECT s, row_number() OVER (ORDER BY s) AS rn FROM sc) t
           WHERE rn = least(CAST(floor((SELECT count(*) FROM sc) * 0.95) AS BIGINT) + 1, (SELECT count(*) FROM sc))) AS p95_nearest_rank,
       (SELECT quantile_cont(s, 0.95) FROM sc) AS p95_linear""", Z_SQL, "sc AS (SELECT abs(sensor_1) AS s FROM z)"),
    "A13 A14")
def score_percentiles(spark, sf_dir):
    """A13 + A14: 95th percentile of |z(sensor_1)|, nearest rank and linear."""
    s = normalised(spark, sf_dir).select(F.abs("sensor_1").alias("s"))
    nr = st.nearest_rank_percentile(s, "s", 0.95).withColumnRenamed("p", "p95_nearest_rank")
    li = st.linear_percentile(s, "s", 0.95).withColumnRenamed("p", "p95_linear")
    return attach_row(nr, li)


# ---------------------------------------------------------------- logs


REQ_SQL = """req AS (SELECT ts, event_id AS request_id, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
   value / 1000.0 AS response_time, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level FROM events)"""


@register("request_stats",
          "total_requests:l error_requests:l avg_response_time:d median_response_time:d max_response_time:d",
          "WITH " + REQ_SQL + """, last AS (SELECT * FROM req ORDER BY ts DESC, request_id DESC LIMIT 1000)
SELECT (SELECT count(*) FROM req) AS total_requests, (SELECT count(*) FROM req WHERE status_code >= 400) AS error_requests,
       (SELECT avg(response_time) FROM last) AS avg_response_time,
       (SELECT median(response_time) FROM last) AS median_response_time,
       (SELECT max(response_time) FROM last) AS max_response_time""", "A17")
def request_stats(spark, sf_dir):
    """Request-log totals and latency over the last 1000 requests."""
    return lg.request_stats(lg.request_log_from_events(table(spark, sf_dir, "events")))


@register("log_level_stats", "total_logs:l errors:l warnings:l uptime_seconds:d logs_per_second:d",
          "WITH " + REQ_SQL + """
SELECT count(*) AS total_logs, count(*) FILTER (WHERE level = 'ERROR') AS errors, 0 AS warnings,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS uptime_seconds,
       count(*) / greatest(1.0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS logs_per_second FROM req""", "A18")
def log_level_stats(spark, sf_dir):
    """Log level counts and records per second."""
    return lg.level_stats(lg.request_log_from_events(table(spark, sf_dir, "events")))


# ---------------------------------------------------------------- evaluation


EST_SQL = """est AS (SELECT event_id, engine_id, RUL,
   greatest(0.0, 100.0 * (1.0 - greatest(0.0, (cycle - 1) / 100.0))) AS pred FROM z)"""


def rule_estimates(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("event_id", "engine_id", "RUL", ru.rul_estimate(None).alias("pred"))


REG_SPEC = ("mse:d rmse:d mae:d r2:d mape:d2 num_samples:l accuracy_within_10:d accuracy_within_20:d "
            "accuracy_within_50:d")


@register("rul_estimate_metrics", REG_SPEC, with_readings(
    """SELECT avg((RUL - pred) * (RUL - pred)) AS mse, sqrt(avg((RUL - pred) * (RUL - pred))) AS rmse,
       avg(abs(RUL - pred)) AS mae,
       CASE WHEN var_pop(RUL) * count(*) > 0 THEN 1.0 - sum((RUL - pred) * (RUL - pred)) / (var_pop(RUL) * count(*)) ELSE 0.0 END AS r2,
       avg(abs((RUL - pred) / (RUL + 1e-8))) * 100 AS mape, count(*) AS num_samples,
       avg(CASE WHEN abs(RUL - pred) <= 10 THEN 1.0 ELSE 0.0 END) AS accuracy_within_10,
       avg(CASE WHEN abs(RUL - pred) <= 20 THEN 1.0 ELSE 0.0 END) AS accuracy_within_20,
       avg(CASE WHEN abs(RUL - pred) <= 50 THEN 1.0 ELSE 0.0 END) AS accuracy_within_50
FROM est""", Z_SQL, EST_SQL), "E4 E5 E6 E7")
def rul_estimate_metrics(spark, sf_dir):
    """Error metrics of the rule estimate (no known RUL) vs. true RUL."""
    return ev.regression_metrics(rule_estimates(spark, sf_dir), "RUL", "pred")


FLAG_SQL = f"""fl AS (SELECT event_id, 0.1 + abs(sensor_1) * 0.1 AS score, 0.1 + abs(sensor_1) * 0.1 > 0.5 AS flag,
   coalesce(RUL / nullif(CAST(max(RUL) OVER ({WE}) AS DOUBLE), 0) < {dbl(1 - 0.8)}, false) AS truth FROM z)"""


def flag_table(spark, sf_dir):
    s = lb.rul_and_life_fraction(normalised(spark, sf_dir))
    score = ru.history_score("sensor_1")
    return s.select("event_id", score.alias("score"), ru.history_flag(score).alias("flag"),
                    (F.col("is_anomaly") == 1).alias("truth"))


@register("anomaly_flag_metrics", "tp:l tn:l fp:l fn:l accuracy:d precision:d recall:d f1:d", with_readings(
    """SELECT tp, tn, fp, fn, coalesce((tp + tn) / nullif(CAST(tp + tn + fp + fn AS DOUBLE), 0), 0.0) AS accuracy,
       prec AS precision, rec AS recall, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0.0) AS f1
FROM (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS prec,
             coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS rec FROM (
  SELECT count(*) FILTER (WHERE truth AND flag) AS tp, count(*) FILTER (WHERE NOT truth AND NOT flag) AS tn,
         count(*) FILTER (WHERE NOT truth AND flag) AS fp, count(*) FILTER (WHERE truth AND NOT flag) AS fn FROM fl) c) d""",
    Z_SQL, FLAG_SQL), "E1 E2")
def anomaly_flag_metrics(spark, sf_dir):
    """E1 + E2: confusion counts and rates of the history flag vs. the
    life-fraction label."""
    return ev.confusion(flag_table(spark, sf_dir), "truth", "flag")


@register("anomaly_auc", "auc:d positives:l negatives:l", with_readings(
    """SELECT (sum(CASE WHEN truth THEN r ELSE 0 END) - p * (p + 1) / 2.0) / (p * (n - p)) AS auc,
       p AS positives, n - p AS negatives
FROM (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r,
             count(*) FILTER (WHERE truth) OVER () AS p, count(*) OVER () AS n FROM fl) t GROUP BY p, n""",
    Z_SQL, FLAG_SQL), "E3")
def anomaly_auc(spark, sf_dir):
    """ROC AUC of the history score against the life-fraction label."""
    return ev.roc_auc(flag_table(spark, sf_dir), "truth", "score", "event_id")


@register("best_estimator", "best_model:s best_rmse:d", with_readings(
    """SELECT arg_min(model, rmse) AS best_model, min(rmse) AS best_rmse FROM (
  SELECT 'rule' AS model, sqrt(avg((RUL - pred) * (RUL - pred))) AS rmse FROM est
  UNION ALL SELECT 'mean', sqrt(avg((RUL - m) * (RUL - m))) FROM est, (SELECT avg(RUL) AS m FROM est) a
  UNION ALL SELECT 'zero', sqrt(avg(CAST(RUL AS DOUBLE) * RUL)) FROM est) t""", Z_SQL, EST_SQL), "K6 M11")
def best_estimator(spark, sf_dir):
    """K6 + M11: compare three baseline estimators by RMSE, keep the best."""
    e = rule_estimates(spark, sf_dir)
    mean = e.agg(F.avg("RUL").alias("m"))
    e = attach_row(e, mean)
    res = e.agg(F.sqrt(F.avg((F.col("RUL") - F.col("pred")) ** 2)).alias("rule"),
                F.sqrt(F.avg((F.col("RUL") - F.col("m")) ** 2)).alias("mean"),
                F.sqrt(F.avg(F.col("RUL").cast("double") * F.col("RUL"))).alias("zero"))
    long = res.select(F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.col(k).alias("rmse"))
                                          for k in ("rule", "mean", "zero")])).alias("r")).select("r.*")
    return fl.best_model(long)
