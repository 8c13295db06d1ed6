"""Registered queries over faulty or partly unknown readings: the same faults
go in by rule on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import labels as lb
from ..operators.clean import select_features
from ..operators.fleet import split_label
from ..operators.ordering import number_rows
from ..operators.stats import feature_stats, robust_scale, stats_long, zscore
from ..sources import sinks as sk
from ..sources.tables import READINGS_SQL, event_base, event_readings
from ..streaming.stream import shared_dir
from .common import W, WE, with_readings
from .feature_queries import ENG_SPEC, SENSORS, _engine_features_sql
from .fleet_queries import AS_OF, alert_table, ALERTS_SQL
from .registry import register

FAULTS_SQL = """faulty AS (SELECT engine_id, event_id, ts, event_type, cycle, setting_1, sensor_3,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE sensor_1 END AS sensor_1,
    CASE WHEN event_id % 13 = 0 THEN -CAST(1e-8 AS DOUBLE) ELSE sensor_2 END AS sensor_2 FROM readings)"""


@register("engine_features_faulty", ENG_SPEC, with_readings("", FAULTS_SQL).rstrip() + ",\n"
          + _engine_features_sql()[len("WITH " + READINGS_SQL.strip() + ",\n"):].replace("FROM readings)", "FROM faulty)"),
          "F1 F2 F3 F5 F6 F7 W5 W6 W7 P6")
def engine_features_faulty(spark, sf_dir):
    """The engine features over readings with missing sensors and zero
    divisors, so that P6 has values to carry."""
    r = event_readings(spark, sf_dir)
    eid = F.col("event_id")
    r = r.withColumn("sensor_1", F.when(eid % 11 != 0, F.col("sensor_1"))).withColumn(
        "sensor_2", F.when(eid % 13 == 0, F.lit(-1e-8)).otherwise(F.col("sensor_2")))
    return fe.add_engine_features(r.select("engine_id", "cycle", *SENSORS, "setting_1"))


@register("filled_over_chunks", "event_id:l sensor_1:d sensor_2:d", with_readings(f"""
SELECT event_id, coalesce(last_value(s1 IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS sensor_1,
       coalesce(last_value(s2 IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS sensor_2
FROM (SELECT engine_id, event_id, cycle, CASE WHEN event_id % 9 = 0 THEN sensor_1 END AS s1,
             CASE WHEN event_id % 40 = 0 THEN sensor_2 END AS s2 FROM readings) f"""), "P6")
def filled_over_chunks(spark, sf_dir):
    """P6 where engines span many chunks and blocks of chunks: gaps longer than
    either, so that values are carried over both."""
    r = event_readings(spark, sf_dir).select("engine_id", "cycle", "event_id", "sensor_1", "sensor_2")
    eid = F.col("event_id")
    r = r.withColumns({"sensor_1": F.when(eid % 9 == 0, F.col("sensor_1")), "sensor_2": F.when(eid % 40 == 0, F.col("sensor_2"))})
    return fe.forward_fill(r, ["sensor_1", "sensor_2"], chunk_rows=4, carry_block=3)


@register("unknown_engine_readings", "event_id:l engine_id:l cycle:l RUL:l rate:d", f"""
WITH {READINGS_SQL.strip().replace("CAST(user_id AS BIGINT) AS engine_id", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS BIGINT) END AS engine_id").replace("PARTITION BY user_id", "PARTITION BY CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END")}
SELECT event_id, engine_id, cycle, max(cycle) OVER ({WE}) - cycle AS RUL,
       coalesce(sensor_1 - lag(sensor_1) OVER ({W}), 0.0) AS rate FROM readings""", "K1 J1 L1 W7")
def unknown_engine_readings(spark, sf_dir):
    """K1, L1 and W7 when a third of the readings has no engine id: they are
    one group of their own, and none is lost."""
    base = event_base(spark, sf_dir).withColumn("engine_id", F.when(F.col("event_id") % 3 != 0, F.col("engine_id")))
    r = lb.add_rul(number_rows(base, "engine_id", ["ts", "event_id"]))
    out = fe.add_degradation_features(r.select("event_id", "engine_id", "cycle", "RUL", "sensor_1"), ["sensor_1"])
    return out.withColumnRenamed("sensor_1_diff", "rate")


@register("robust_scaled", "event_id:l sensor_1:d sensor_2:d setting_1:d", with_readings("""
SELECT event_id, (sensor_1 - m1) / CASE WHEN i1 <> 0 THEN i1 ELSE 1 END AS sensor_1,
       (sensor_2 - m2) / CASE WHEN i2 <> 0 THEN i2 ELSE 1 END AS sensor_2,
       (setting_1 - m3) / CASE WHEN i3 <> 0 THEN i3 ELSE 1 END AS setting_1
FROM readings CROSS JOIN (SELECT
  quantile_cont(sensor_1, 0.5) AS m1, quantile_cont(sensor_1, 0.75) - quantile_cont(sensor_1, 0.25) AS i1,
  quantile_cont(sensor_2, 0.5) AS m2, quantile_cont(sensor_2, 0.75) - quantile_cont(sensor_2, 0.25) AS i2,
  quantile_cont(setting_1, 0.5) AS m3, quantile_cont(setting_1, 0.75) - quantile_cont(setting_1, 0.25) AS i3
  FROM readings) q"""), "M2")
def robust_scaled(spark, sf_dir):
    """M2: exact robust scaling (median, interquartile range)."""
    return robust_scale(event_base(spark, sf_dir).select("event_id", "sensor_1", "sensor_2", "setting_1"),
                        ["sensor_1", "sensor_2", "setting_1"])


SPLIT_SQL = "CASE WHEN CAST('0x' || left(md5('42:' || CAST(engine_id AS VARCHAR)), 8) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END"


@register("prepared_new_readings", "event_id:l sensor_1:d sensor_2:d", with_readings("""
SELECT event_id, (sensor_1 - m1) / s1 AS sensor_1, (sensor_2 - m2) / s2 AS sensor_2
FROM (SELECT * FROM sides WHERE split = 'test') t CROSS JOIN (SELECT
  avg(sensor_1) AS m1, CASE WHEN stddev_pop(sensor_1) > 0 THEN stddev_pop(sensor_1) ELSE 1 END AS s1,
  avg(sensor_2) AS m2, CASE WHEN stddev_pop(sensor_2) > 0 THEN stddev_pop(sensor_2) ELSE 1 END AS s2
  FROM sides WHERE split = 'train') f""", f"sides AS (SELECT *, {SPLIT_SQL} AS split FROM readings)"), "S5 M1 F8 D2")
def prepared_new_readings(spark, sf_dir):
    """A new table prepared with saved statistics: fitted on the training
    engines, written, read again and applied to the others."""
    r = event_base(spark, sf_dir).select("engine_id", "event_id", "sensor_1", "sensor_2").withColumn("split", split_label())
    cols = ["sensor_1", "sensor_2"]
    path = shared_dir(spark, "scaler")
    sk.save_stats(stats_long(feature_stats(r.where("split = 'train'"), cols), cols), path)
    saved = sk.load_stats(spark, path)
    return zscore(r.where("split = 'test'"), cols, sk.stats_wide(saved, cols)).select("event_id", *cols)


@register("dashboard_tiers", "engine_id:l critical:l active:l alert_tier:s activity_tier:s", with_readings(f"""
SELECT r.engine_id, coalesce(c, 0) AS critical, active, CASE WHEN coalesce(c, 0) = 0 THEN 'good' ELSE 'critical' END AS alert_tier,
       CASE WHEN active > 0 THEN 'good' ELSE 'warning' END AS activity_tier
FROM (SELECT engine_id, count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}') AS active FROM readings GROUP BY engine_id) r
LEFT JOIN (SELECT engine_id, count(*) AS c FROM alerts GROUP BY engine_id) a ON r.engine_id = a.engine_id""", ALERTS_SQL), "L4")
def dashboard_tiers(spark, sf_dir):
    """L4: alert tier (no alert: good) and activity tier (recent readings:
    good) of every engine."""
    alerts = alert_table(spark, sf_dir).groupBy("engine_id").agg(F.count(F.lit(1)).alias("critical"))
    recent = F.count_if(F.col("ts") >= F.lit(AS_OF).cast("timestamp_ntz"))
    r = event_base(spark, sf_dir).groupBy("engine_id").agg(recent.alias("active"))
    out = r.join(alerts, "engine_id", "left").withColumn("critical", F.coalesce("critical", F.lit(0)))
    return out.withColumns({"alert_tier": lb.alert_tier("critical"), "activity_tier": lb.activity_tier("active")})


@register("selected_features", "sensor_1:d sensor_2:d sensor_3:d setting_1:d", with_readings(
    "SELECT sensor_1, sensor_2, sensor_3, setting_1 FROM readings"), "P1")
def selected_features(spark, sf_dir):
    """The model's inputs of a processed table: no ids, no target, no
    trend columns."""
    r = lb.add_rul(event_readings(spark, sf_dir)).drop("event_id", "ts", "event_type")
    return select_features(fe.add_degradation_features(r, ["sensor_1"]).drop("cycle_norm", "sensor_1_diff"), drop_suffixes=("_trend",))
