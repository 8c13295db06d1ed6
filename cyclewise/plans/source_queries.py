"""Registered queries: sources, sinks, records and joins on feature keys
(S1–S5, S7–S9, J2, J4). Round trips write data Spark derived from the
driver's tables to the shared checkpoint folder and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe
from ..operators import fleet as fl
from ..operators import labels as lb
from ..operators.stats import feature_stats, stats_long
from ..sources import readers as rd
from ..sources import records as rc
from ..sources import sinks as sk
from ..sources.tables import event_base, event_readings, with_timestamp
from ..streaming.stream import shared_dir
from .common import WE, with_readings
from .registry import REGISTRY, register

SENSORS = ["sensor_1", "sensor_2", "sensor_3"]
LOG_COLUMNS = ["engine_id", "cycle", "setting_1"] + SENSORS
AS_OF = "2024-01-20"


@register("sensor_log_roundtrip", "engine_id:l cycle:l setting_1:d sensor_1:d sensor_2:d sensor_3:d", with_readings(
    "SELECT engine_id, cycle, setting_1, sensor_1, sensor_2, sensor_3 FROM readings"), "S1 S4")
def sensor_log_roundtrip(spark, sf_dir):
    """S4 → S1: readings written as whitespace text, read back by position."""
    path = shared_dir(spark, "sensor-log")
    sk.write_sensor_log(event_readings(spark, sf_dir), path, LOG_COLUMNS)
    return rd.read_sensor_log(spark, path, LOG_COLUMNS)


@register("rul_truth_roundtrip", "engine_id:l rul:d", with_readings(
    f"""SELECT row_number() OVER (ORDER BY engine_id) AS engine_id, CAST(total - seen AS DOUBLE) AS rul FROM (
  SELECT engine_id, count(*) AS total, count(*) FILTER (WHERE ts < TIMESTAMP '{AS_OF}') AS seen
  FROM readings GROUP BY engine_id) t"""), "S2")
def rul_truth_roundtrip(spark, sf_dir):
    """True remaining readings per engine after the 2024-01-20 cut,
    written one line per engine in engine order, read back with the line
    number as the engine."""
    r = event_readings(spark, sf_dir, columns=[])
    truth = r.groupBy("engine_id").agg(
        (F.count(F.lit(1)) - F.count_if(F.col("ts") < F.lit(AS_OF).cast("timestamp_ntz"))).alias("rul"))
    path = shared_dir(spark, "rul-truth")
    # one line per engine, in engine order within and across the files
    truth.repartitionByRange("engine_id").sortWithinPartitions("engine_id").select(
        F.col("rul").cast("string").alias("value")).write.mode("overwrite").text(path)
    return rd.read_rul_truth(spark, path, value="rul")


@register("processed_csv_roundtrip", "engine_id:l cycle:l RUL:l sensor_1:d sensor_2:d", with_readings(
    f"SELECT engine_id, cycle, max(cycle) OVER ({WE}) - cycle AS RUL, sensor_1, sensor_2 FROM readings"), "S3 S4")
def processed_csv_roundtrip(spark, sf_dir):
    """S4 (CSV with header) → S3: the processed table through CSV."""
    r = lb.add_rul(event_readings(spark, sf_dir, columns=["sensor_1", "sensor_2"]))
    path = shared_dir(spark, "processed-csv")
    sk.write_table(r.select("engine_id", "cycle", "RUL", "sensor_1", "sensor_2"), path, fmt="csv")
    return rd.read_processed_csv(spark, path)


@register("stats_roundtrip", "feature:s mean:d std:d", REGISTRY["feature_stats"].sql, "S5 A1")
def stats_roundtrip(spark, sf_dir):
    """Normalisation stats saved and reloaded."""
    from ..sources.tables import event_readings_unnumbered, table

    r = event_readings_unnumbered(table(spark, sf_dir, "events"))
    cols = ["sensor_1", "sensor_2", "setting_1"]
    path = shared_dir(spark, "stats")
    sk.save_stats(stats_long(feature_stats(r, cols), cols), path)
    return sk.load_stats(spark, path)


@register("sequences_roundtrip", REGISTRY["sequence_windows"].spec, REGISTRY["sequence_windows"].sql, "S7 W10")
def sequences_roundtrip(spark, sf_dir):
    """Sequence tensors written as Parquet ``array<struct>`` rows and
    read back."""
    r = lb.add_rul(event_readings(spark, sf_dir, columns=SENSORS))
    seq = fe.sequence_windows(r, ["cycle", "sensor_1", "sensor_2"], length=30, target="RUL")
    path = shared_dir(spark, "sequences")
    sk.write_sequences(seq, path)
    back = spark.read.parquet(path)
    return back.select(
        "engine_id", "start_cycle", "end_cycle", F.size("steps").alias("n_steps"),
        F.aggregate("steps", F.lit(0.0), lambda acc, s: acc + s["sensor_1"]).alias("steps_sensor_1_sum"),
        F.col("steps")[0]["sensor_2"].alias("steps_first_sensor_2"), "target",
    )


@register("nested_records",
          "engine_id:l cycle:l timestamp:d n_sensors:l n_settings:l n_raw_sensors:l sensor_1:d setting_1:d "
          "meta_rul:s meta_event_type:s",
          with_readings(f"""SELECT engine_id, cycle, epoch_us(ts) / 1e6 AS timestamp, 3 AS n_sensors, 1 AS n_settings,
       3 AS n_raw_sensors, sensor_1, setting_1, CAST(max(cycle) OVER ({WE}) - cycle AS VARCHAR) AS meta_rul,
       event_type AS meta_event_type FROM readings"""), "S8 S9")
def nested_records(spark, sf_dir):
    """S8 + S9: readings nested into sensor / setting / metadata maps,
    encoded as JSON and decoded again."""
    r = with_timestamp(lb.add_rul(event_readings(spark, sf_dir)))
    flat = r.select("engine_id", "cycle", "timestamp", *SENSORS, "setting_1", "RUL", "event_type")
    back = rc.from_json_records(rc.to_json_records(rc.nest_reading(flat)))
    return back.select(
        "engine_id", "cycle", "timestamp", F.size("sensors").alias("n_sensors"), F.size("settings").alias("n_settings"),
        F.size(rc.raw_sensor_names(F.col("sensors"))).alias("n_raw_sensors"),
        F.col("sensors")["sensor_1"].alias("sensor_1"), F.col("settings")["setting_1"].alias("setting_1"),
        F.col("metadata")["RUL"].alias("meta_rul"), F.col("metadata")["event_type"].alias("meta_event_type"),
    )


ZCOLS = SENSORS + ["setting_1"]


@register("feature_zscore_long", "event_id:l feature:s value:d zscore:d", with_readings(
    """SELECT event_id, l.feature, value, (value - s.mean) / s.std AS zscore FROM (
""" + "\nUNION ALL\n".join(f"  SELECT event_id, '{c}' AS feature, {c} AS value FROM readings" for c in ZCOLS)
    + ") l JOIN st s ON l.feature = s.feature",
    "st AS (" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, avg({c}) AS mean, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS std "
        f"FROM readings" for c in ZCOLS) + ")"), "J2 A1")
def feature_zscore_long(spark, sf_dir):
    """Readings unpivoted to (feature, value) and joined to the
    per-feature stats table (broadcast: one row per feature)."""
    r = event_base(spark, sf_dir)  # no positions needed
    stats = stats_long(feature_stats(r, ZCOLS), ZCOLS)
    long = r.unpivot(["event_id"], ZCOLS, "feature", "value")
    j = long.join(F.broadcast(stats), "feature")
    return j.select("event_id", "feature", "value", ((F.col("value") - F.col("mean")) / F.col("std")).alias("zscore"))


@register("merged_maps", "event_id:l n_keys:l sensor_1:d sensor_2:d setting_1:d", with_readings(
    "SELECT event_id, 3 AS n_keys, sensor_1, sensor_3 AS sensor_2, setting_1 FROM readings"), "J4")
def merged_maps(spark, sf_dir):
    """Request settings merged into the sensor map, later keys win
    (the settings carry a ``sensor_2`` override)."""
    r = event_base(spark, sf_dir)
    sensors = F.create_map(F.lit("sensor_1"), F.col("sensor_1"), F.lit("sensor_2"), F.col("sensor_2"))
    settings = F.create_map(F.lit("setting_1"), F.col("setting_1"), F.lit("sensor_2"), F.col("sensor_3"))
    m = r.select("event_id", fl.merge_settings(sensors, settings).alias("m"))
    return m.select("event_id", F.size("m").alias("n_keys"), F.col("m")["sensor_1"].alias("sensor_1"),
                    F.col("m")["sensor_2"].alias("sensor_2"), F.col("m")["setting_1"].alias("setting_1"))
