"""Registered queries: labels, scalar features and windows (L, F, W) and the
flagship engine-health summary."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import fixed_decimals, non_negative
from ..operators import features as fe
from ..operators import labels as lb
from ..operators.ordering import engine_windows, rows_back
from ..operators.stats import feature_stats, zscore
from ..sources.tables import event_base, event_readings
from .common import W, WE, dbl, frame, with_readings
from .registry import register

SENSORS = ["sensor_1", "sensor_2", "sensor_3"]

# ---------------------------------------------------------------- flagship

FLAGSHIP_SPEC = ("engine_id:l total_cycles:l max_rul:l min_rul:l avg_sensor_1:d avg_rolling_mean_5:d "
                 "n_alerts:l health:s")


def engine_health_summary(spark: SparkSession, sf_dir: str, alert_threshold: float = 2.0):
    """Slice 1: readings → RUL (L1) → 5-row rolling mean (W1) → z-scores
    (A1 + F8) → two-sensor alert (R1) → per-engine status (A2) with alert
    count and health tier (L4)."""
    r = event_readings(spark, sf_dir, columns=["sensor_1", "sensor_2"])
    feats = engine_windows(
        r, lambda w: [F.avg("sensor_1").over(rows_back(w, 5)).alias("sensor_1_rolling_mean_5")],
        halo=4, engine_aggs=[F.max("cycle").alias("_max_cycle")],
    ).withColumn("RUL", F.col("_max_cycle") - F.col("cycle"))
    stats = feature_stats(event_base(spark, sf_dir), ["sensor_1", "sensor_2"])  # needs no ordering
    z = zscore(feats, ["sensor_1", "sensor_2"], stats, suffix="_z")
    alert = (F.abs("sensor_1_z") > alert_threshold) | (F.abs("sensor_2_z") > alert_threshold)
    out = z.groupBy("engine_id").agg(
        F.count(F.lit(1)).alias("total_cycles"), F.max("RUL").alias("max_rul"), F.min("RUL").alias("min_rul"),
        F.avg("sensor_1").alias("avg_sensor_1"), F.avg("sensor_1_rolling_mean_5").alias("avg_rolling_mean_5"),
        F.count_if(alert).alias("n_alerts"),
    )
    return out.withColumn("health", lb.health_tier("max_rul"))


FLAGSHIP_SQL = with_readings(
    f"""
SELECT engine_id, count(*) AS total_cycles, max(RUL) AS max_rul, min(RUL) AS min_rul,
       avg(sensor_1) AS avg_sensor_1, avg(rm5) AS avg_rolling_mean_5,
       count(*) FILTER (WHERE abs((sensor_1 - m1) / sd1) > 2.0 OR abs((sensor_2 - m2) / sd2) > 2.0) AS n_alerts,
       CASE WHEN max(RUL) > 100 THEN 'good' WHEN max(RUL) > 50 THEN 'warning' ELSE 'critical' END AS health
FROM feat CROSS JOIN stats
GROUP BY engine_id""",
    """stats AS (SELECT avg(sensor_1) AS m1,
                 CASE WHEN stddev_pop(sensor_1) > 0 THEN stddev_pop(sensor_1) ELSE 1.0 END AS sd1,
                 avg(sensor_2) AS m2,
                 CASE WHEN stddev_pop(sensor_2) > 0 THEN stddev_pop(sensor_2) ELSE 1.0 END AS sd2
          FROM readings)""",
    f"""feat AS (SELECT *, avg(sensor_1) OVER {frame(5)} AS rm5,
                 max(cycle) OVER ({WE}) - cycle AS RUL FROM readings)""",
)

register("engine_health_summary", FLAGSHIP_SPEC, FLAGSHIP_SQL, "L1 W1 A1 F8 R1 A2 L4")(engine_health_summary)

# ---------------------------------------------------------------- labels


@register("rul_label", "engine_id:l cycle:l RUL:l", with_readings(
    f"SELECT engine_id, cycle, max(cycle) OVER ({WE}) - cycle AS RUL FROM readings"), "L1 K1")
def rul_label(spark, sf_dir):
    """L1: remaining useful life per reading."""
    return lb.add_rul(event_readings(spark, sf_dir, columns=[]))


@register("life_fraction_label", "engine_id:l cycle:l RUL:l max_rul:l is_anomaly:l", with_readings(
    f"""SELECT engine_id, cycle, RUL, max(RUL) OVER ({WE}) AS max_rul,
       CAST(coalesce(RUL / nullif(CAST(max(RUL) OVER ({WE}) AS DOUBLE), 0) < {dbl(1 - 0.8)}, false) AS BIGINT) AS is_anomaly
FROM (SELECT engine_id, cycle, max(cycle) OVER ({WE}) - cycle AS RUL FROM readings) t"""), "L2 W9 J1")
def life_fraction_label(spark, sf_dir):
    """L2: degraded when RUL / engine max RUL < 1 - 0.8."""
    return lb.rul_and_life_fraction(event_readings(spark, sf_dir, columns=[]))


@register("fixed_rul_label", "engine_id:l cycle:l RUL:l is_anomaly:l", with_readings(
    f"""SELECT engine_id, cycle, max(cycle) OVER ({WE}) - cycle AS RUL,
       CAST(max(cycle) OVER ({WE}) - cycle < 50 AS BIGINT) AS is_anomaly FROM readings"""), "L3")
def fixed_rul_label(spark, sf_dir):
    """L3: degraded when RUL < 50."""
    return lb.add_rul(event_readings(spark, sf_dir, columns=[])).withColumn("is_anomaly", lb.fixed_label())


@register("health_tiers", "engine_id:l cycle:l RUL:l tier:s life_percent:d", with_readings(
    f"""SELECT engine_id, cycle, RUL,
       CASE WHEN RUL > 100 THEN 'good' WHEN RUL > 50 THEN 'warning' ELSE 'critical' END AS tier,
       least(100.0, CAST(RUL AS DOUBLE) / 300.0 * 100.0) AS life_percent
FROM (SELECT engine_id, cycle, max(cycle) OVER ({WE}) - cycle AS RUL FROM readings) t"""), "L4 L5")
def health_tiers(spark, sf_dir):
    """L4 + L5: health tier and remaining-life percent per reading."""
    r = lb.add_rul(event_readings(spark, sf_dir, columns=[]))
    return r.select("engine_id", "cycle", "RUL", lb.health_tier("RUL").alias("tier"),
                    lb.life_percent("RUL").alias("life_percent"))


# ---------------------------------------------------------------- scalar features


@register("cycle_transforms",
          "engine_id:l cycle:l cycle_norm:d cycle_squared:l cycle_sqrt:d cycle_log:d cycle_inv:d",
          with_readings("""SELECT engine_id, cycle, CAST(cycle AS DOUBLE) / max(cycle) OVER () AS cycle_norm,
       cycle * cycle AS cycle_squared, sqrt(cycle) AS cycle_sqrt, ln(1 + cycle) AS cycle_log,
       1.0 / (cycle + 1) AS cycle_inv FROM readings"""), "F1 F2")
def cycle_transforms(spark, sf_dir):
    """F1 + F2: cycle transforms and cycle / global max cycle."""
    r = fe.add_global_cycle_norm(event_readings(spark, sf_dir, columns=[]))
    return r.select("engine_id", "cycle", "cycle_norm", *fe.cycle_transforms())


@register("engine_cycle_position",
          "engine_id:l cycle:l max_cycle:l remaining_cycles:l cycle_ratio:d cycle_norm:d completion_percent:d",
          with_readings(f"""SELECT engine_id, cycle, max(cycle) OVER ({WE}) AS max_cycle,
       max(cycle) OVER ({WE}) - cycle AS remaining_cycles,
       CAST(cycle AS DOUBLE) / max(cycle) OVER ({WE}) AS cycle_ratio,
       (cycle - min(cycle) OVER ({WE})) / (max(cycle) OVER ({WE}) - min(cycle) OVER ({WE}) + {dbl(1e-8)}) AS cycle_norm,
       CAST(cycle - 1 AS DOUBLE) / count(*) OVER ({WE}) * 100.0 AS completion_percent
FROM readings"""), "F3 F4 F5 W9 W11")
def engine_cycle_position(spark, sf_dir):
    """Where each reading sits in its engine's life."""
    from ..operators.ordering import engine_aggregates

    r = event_readings(spark, sf_dir, columns=[])
    r = engine_aggregates(r, [F.max("cycle").alias("max_cycle"), F.min("cycle").alias("_min"),
                              F.count(F.lit(1)).alias("_n")])
    c = F.col("cycle")
    return r.select(
        "engine_id", "cycle", "max_cycle", (F.col("max_cycle") - c).alias("remaining_cycles"),
        (c.cast("double") / F.col("max_cycle")).alias("cycle_ratio"),
        ((c - F.col("_min")) / (F.col("max_cycle") - F.col("_min") + F.lit(fe.NORM_EPS))).alias("cycle_norm"),
        ((c - 1).cast("double") / F.col("_n") * 100.0).alias("completion_percent"),
    )


@register("sensor_ratios",
          "engine_id:l cycle:l sensor_1_sensor_2_ratio:d sensor_1_sensor_3_ratio:d sensor_2_sensor_3_ratio:d "
          "setting_1_squared:d",
          with_readings(f"""SELECT engine_id, cycle,
       sensor_1 / nullif(sensor_2 + {dbl(1e-8)}, 0) AS sensor_1_sensor_2_ratio,
       sensor_1 / nullif(sensor_3 + {dbl(1e-8)}, 0) AS sensor_1_sensor_3_ratio,
       sensor_2 / nullif(sensor_3 + {dbl(1e-8)}, 0) AS sensor_2_sensor_3_ratio,
       setting_1 * setting_1 AS setting_1_squared FROM readings"""), "F6 F7")
def sensor_ratios(spark, sf_dir):
    """F6 + F7: neighbour sensor ratios and squared settings."""
    r = event_readings(spark, sf_dir)
    return r.select("engine_id", "cycle", *fe.ratio_columns(SENSORS), *fe.setting_squares(["setting_1"]))


@register("zscore_readings", "engine_id:l cycle:l sensor_1:d sensor_2:d sensor_3:d setting_1:d",
          with_readings("""SELECT engine_id, cycle,
       (sensor_1 - m1) / sd1 AS sensor_1, (sensor_2 - m2) / sd2 AS sensor_2,
       (sensor_3 - m3) / sd3 AS sensor_3, (setting_1 - m4) / sd4 AS setting_1
FROM readings CROSS JOIN stats""", """stats AS (SELECT
   avg(sensor_1) AS m1, CASE WHEN stddev_pop(sensor_1) > 0 THEN stddev_pop(sensor_1) ELSE 1.0 END AS sd1,
   avg(sensor_2) AS m2, CASE WHEN stddev_pop(sensor_2) > 0 THEN stddev_pop(sensor_2) ELSE 1.0 END AS sd2,
   avg(sensor_3) AS m3, CASE WHEN stddev_pop(sensor_3) > 0 THEN stddev_pop(sensor_3) ELSE 1.0 END AS sd3,
   avg(setting_1) AS m4, CASE WHEN stddev_pop(setting_1) > 0 THEN stddev_pop(setting_1) ELSE 1.0 END AS sd4
 FROM readings)"""), "A1 F8 M1")
def zscore_readings(spark, sf_dir):
    """A1 + F8 (= M1 with population std): standard scaling of all measures."""
    r = event_readings(spark, sf_dir)
    cols = SENSORS + ["setting_1"]
    return zscore(r.select("engine_id", "cycle", *cols), cols, feature_stats(event_base(spark, sf_dir), cols))


@register("feature_stats", "feature:s mean:d std:d", """
SELECT 'sensor_1' AS feature, avg(value) AS mean,
       CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1.0 END AS std FROM events
UNION ALL
SELECT 'sensor_2', avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)),
       CASE WHEN stddev_pop(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) > 0
            THEN stddev_pop(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) ELSE 1.0 END FROM events
UNION ALL
SELECT 'setting_1', avg(CAST(hour(ts) AS DOUBLE)),
       CASE WHEN stddev_pop(CAST(hour(ts) AS DOUBLE)) > 0 THEN stddev_pop(CAST(hour(ts) AS DOUBLE)) ELSE 1.0 END
FROM events""", "A1 S5")
def feature_stats_query(spark, sf_dir):
    """The normalisation-stats table (feature, mean, std)."""
    from ..operators.stats import stats_long
    from ..sources.tables import event_readings_unnumbered, table

    r = event_readings_unnumbered(table(spark, sf_dir, "events"))
    cols = ["sensor_1", "sensor_2", "setting_1"]
    return stats_long(feature_stats(r, cols), cols)


# ---------------------------------------------------------------- windows

ROLL_SPEC = "engine_id:l cycle:l " + " ".join(
    f"{s}_rolling_{st}_{n}:d" for n in fe.ROLLING_WINDOWS for s in SENSORS for st in fe.ROLLING_STATS)


def _rolling_sql() -> str:
    fn = {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min"}
    cols = []
    for n in fe.ROLLING_WINDOWS:
        for s in SENSORS:
            for st in fe.ROLLING_STATS:
                cols.append(f"coalesce({fn[st]}({s}) OVER {frame(n)}, 0.0) AS {s}_rolling_{st}_{n}")
    return with_readings("SELECT engine_id, cycle,\n       " + ",\n       ".join(cols) + "\nFROM readings")


@register("rolling_features", ROLL_SPEC, _rolling_sql(), "W1 W2 W3 W4")
def rolling_features(spark, sf_dir):
    """Rolling mean / sample std / max / min over 5, 10, 20 rows for
    every sensor — 36 columns from one exchange and one sort."""
    r = event_readings(spark, sf_dir, columns=SENSORS).select("engine_id", "cycle", *SENSORS)
    return fe.add_rolling_features(r, SENSORS)


DEG_SPEC = "engine_id:l cycle:l cycle_norm:d " + " ".join(f"{s}_trend:d" for s in SENSORS) + " " + " ".join(
    f"{s}_diff:d" for s in SENSORS)


@register("degradation_features", DEG_SPEC, with_readings(
    "SELECT engine_id, cycle, "
    f"(cycle - min(cycle) OVER ({WE})) / (max(cycle) OVER ({WE}) - min(cycle) OVER ({WE}) + {dbl(1e-8)}) AS cycle_norm, "
    + ", ".join(f"{s} - first_value({s}) OVER ({W}) AS {s}_trend" for s in SENSORS) + ", "
    + ", ".join(f"coalesce({s} - lag({s}) OVER ({W}), 0.0) AS {s}_diff" for s in SENSORS)
    + " FROM readings"), "F4 W7 W8")
def degradation_features(spark, sf_dir):
    """Min-max cycle, difference from first reading, first difference."""
    r = event_readings(spark, sf_dir, columns=SENSORS).select("engine_id", "cycle", *SENSORS)
    return fe.add_degradation_features(r, SENSORS)


ENG_COLS = (["cycle_norm:d", "cycle_squared:l", "cycle_sqrt:d", "cycle_log:d", "cycle_inv:d"]
            + [f"{s}_{k}:d" for s in SENSORS for k in ("rolling_mean", "rolling_std", "trend", "rate")]
            + ["remaining_cycles:l", "cycle_ratio:d", "sensor_1_sensor_2_ratio:d", "sensor_1_sensor_3_ratio:d",
               "sensor_2_sensor_3_ratio:d", "setting_1_squared:d"])
ENG_SPEC = "engine_id:l cycle:l " + " ".join(ENG_COLS)


def _engine_features_sql() -> str:
    wo = "PARTITION BY engine_id ORDER BY cycle"
    raw = []
    for s in SENSORS:
        raw += [f"avg({s}) OVER {frame(5)} AS {s}_rolling_mean",
                f"coalesce(stddev_samp({s}) OVER {frame(5)}, 0.0) AS {s}_rolling_std",
                f"{s} - avg({s}) OVER {frame(5)} AS {s}_trend",
                f"coalesce({s} - lag({s}) OVER ({wo}), 0.0) AS {s}_rate"]
    raw += [f"CAST(cycle AS DOUBLE) / max(cycle) OVER () AS cycle_norm",
            "cycle * cycle AS cycle_squared", "sqrt(cycle) AS cycle_sqrt", "ln(1 + cycle) AS cycle_log",
            "1.0 / (cycle + 1) AS cycle_inv",
            f"max(cycle) OVER ({WE}) - cycle AS remaining_cycles",
            f"CAST(cycle AS DOUBLE) / max(cycle) OVER ({WE}) AS cycle_ratio",
            f"sensor_1 / nullif(sensor_2 + {dbl(1e-8)}, 0) AS sensor_1_sensor_2_ratio",
            f"sensor_1 / nullif(sensor_3 + {dbl(1e-8)}, 0) AS sensor_1_sensor_3_ratio",
            f"sensor_2 / nullif(sensor_3 + {dbl(1e-8)}, 0) AS sensor_2_sensor_3_ratio",
            "setting_1 * setting_1 AS setting_1_squared"]
    names = [c.split(":")[0] for c in ENG_COLS]
    dbl_names = [c.split(":")[0] for c in ENG_COLS if c.endswith(":d")]
    filled = [
        (f"coalesce(CASE WHEN isinf({n}) OR isnan({n}) THEN NULL ELSE {n} END, "
         f"last_value(CASE WHEN isinf({n}) OR isnan({n}) THEN NULL ELSE {n} END IGNORE NULLS) OVER "
         f"({wo} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS {n}") if n in dbl_names else n
        for n in names]
    return with_readings(
        "SELECT engine_id, cycle, " + ", ".join(filled) + " FROM raw",
        "raw AS (SELECT engine_id, cycle, " + ", ".join(raw) + " FROM readings)")


@register("engine_features", ENG_SPEC, _engine_features_sql(), "F1 F2 F3 F5 F6 F7 W5 W6 W7 P6")
def engine_features(spark, sf_dir):
    """The remaining-life feature builder per engine, with ±inf → ffill → 0."""
    r = event_readings(spark, sf_dir).select("engine_id", "cycle", *SENSORS, "setting_1")
    return fe.add_engine_features(r)


@register("sequence_windows",
          "engine_id:l start_cycle:l end_cycle:l n_steps:l steps_sensor_1_sum:d steps_first_sensor_2:d target:l",
          with_readings(f"""SELECT engine_id, cycle - 29 AS start_cycle, cycle AS end_cycle, 30 AS n_steps,
       s1 AS steps_sensor_1_sum, f2 AS steps_first_sensor_2, RUL AS target
FROM (SELECT engine_id, cycle, max(cycle) OVER ({WE}) - cycle AS RUL,
             count(*) OVER {frame(30)} AS n, sum(sensor_1) OVER {frame(30)} AS s1,
             first_value(sensor_2) OVER {frame(30)} AS f2 FROM readings) t
WHERE n = 30"""), "W10 S7")
def sequence_windows(spark, sf_dir):
    """30-step sequences per engine with end-of-window RUL target
    (checked through per-sequence size, sum and first element)."""
    r = lb.add_rul(event_readings(spark, sf_dir, columns=SENSORS))
    seq = fe.sequence_windows(r, ["cycle", "sensor_1", "sensor_2"], length=30, target="RUL")
    return seq.select(
        "engine_id", "start_cycle", "end_cycle", F.size("steps").alias("n_steps"),
        F.aggregate("steps", F.lit(0.0), lambda acc, s: acc + s["sensor_1"]).alias("steps_sensor_1_sum"),
        F.col("steps")[0]["sensor_2"].alias("steps_first_sensor_2"), "target",
    )


@register("stream_time", "event_id:l engine_id:l cycle:l stream_time:d", with_readings(
    "SELECT event_id, engine_id, cycle, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6 AS stream_time FROM readings"),
    "W12")
def stream_time_query(spark, sf_dir):
    """Seconds since the first reading (batch form of ``stream_time``)."""
    r = event_readings(spark, sf_dir, columns=[])
    return fe.stream_time(r).select("event_id", "engine_id", "cycle", "stream_time")


@register("formatted_readings", "engine_id:l cycle:l message:s score:d rul_estimate:d", with_readings(
    f"""SELECT engine_id, cycle,
       'Sensor anomaly: sensor_1=' || printf('%.3f', sensor_1) || ', sensor_2=' || printf('%.3f', sensor_2) AS message,
       greatest(0.0, least(5.0, sensor_1 / 50.0)) AS score,
       round(greatest(0.0, CAST(max(cycle) OVER ({WE}) - cycle AS DOUBLE) - 10.0), 1) AS rul_estimate
FROM readings"""), "F9 F10")
def formatted_readings(spark, sf_dir):
    """F9 + F10: fixed-decimal message text, score clipped to [0, 5],
    non-negative estimate rounded to 1 dp."""
    r = lb.add_rul(event_readings(spark, sf_dir, columns=["sensor_1", "sensor_2"]))
    msg = F.concat(F.lit("Sensor anomaly: sensor_1="), fixed_decimals("sensor_1"), F.lit(", sensor_2="),
                   fixed_decimals("sensor_2"))
    return r.select("engine_id", "cycle", msg.alias("message"),
                    fe.clip_score(F.col("sensor_1") / 50.0).alias("score"),
                    F.round(non_negative(F.col("RUL").cast("double") - 10.0), 1).alias("rul_estimate"))


# ---------------------------------------------------------------- wide variant (lineitem)

LI_SENSORS = ["sensor_1", "sensor_2", "sensor_3", "sensor_4"]
LI_SPEC = "engine_id:l cycle:l RUL:l " + " ".join(f"{s}_rolling_{st}_5:d" for s in LI_SENSORS for st in ("mean", "std"))


@register("supplier_rolling_features", LI_SPEC, f"""
WITH li AS (
  SELECT CAST(l_suppkey AS BIGINT) AS engine_id, l_quantity AS sensor_1, l_extendedprice AS sensor_2,
         l_discount AS sensor_3, l_tax AS sensor_4,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_partkey, l_linenumber, l_quantity,
                            l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS cycle
  FROM lineitem)
SELECT engine_id, cycle, max(cycle) OVER ({WE}) - cycle AS RUL, """ + ", ".join(
    f"avg({s}) OVER {frame(5)} AS {s}_rolling_mean_5, coalesce(stddev_samp({s}) OVER {frame(5)}, 0.0) AS {s}_rolling_std_5"
    for s in LI_SENSORS) + " FROM li", "L1 W1 W2 K1")
def supplier_rolling_features(spark, sf_dir):
    """Wide variant: suppliers as units, line items as readings in ship-date
    order (ties broken by every column) — RUL and 5-row rolling mean / std
    of four measures."""
    from ..sources.tables import lineitem_readings

    r = lineitem_readings(spark, sf_dir).select("engine_id", "cycle", *LI_SENSORS)
    out = engine_windows(r, lambda w: fe.rolling_columns(w, LI_SENSORS, (5,), ("mean", "std")), halo=4,
                         engine_aggs=[F.max("cycle").alias("_max")])
    return out.withColumn("RUL", F.col("_max") - F.col("cycle"))


# ---------------------------------------------------------------- batch preparation (entry 1)

PREP_FEATURES = (["setting_1"] + SENSORS
                 + [f"{s}_rolling_{st}_{n}" for n in fe.ROLLING_WINDOWS for s in SENSORS for st in fe.ROLLING_STATS]
                 + ["cycle_norm"] + [f"{s}_trend" for s in SENSORS] + [f"{s}_diff" for s in SENSORS])
PREP_SPEC = "engine_id:l cycle:l RUL:l " + " ".join(f"{c}:d" for c in PREP_FEATURES) + " max_rul:l is_anomaly:l"


def _prep_sql() -> str:
    fn = {"mean": "avg", "std": "stddev_samp", "max": "max", "min": "min"}
    roll = [f"coalesce({fn[st]}({s}) OVER {frame(n)}, 0.0) AS {s}_rolling_{st}_{n}"
            for n in fe.ROLLING_WINDOWS for s in SENSORS for st in fe.ROLLING_STATS]
    deg = [f"(cycle - min(cycle) OVER ({WE})) / (max(cycle) OVER ({WE}) - min(cycle) OVER ({WE}) + {dbl(1e-8)}) AS cycle_norm"]
    deg += [f"{s} - first_value({s}) OVER ({W}) AS {s}_trend" for s in SENSORS]
    deg += [f"coalesce({s} - lag({s}) OVER ({W}), 0.0) AS {s}_diff" for s in SENSORS]
    f = ("f AS (SELECT engine_id, cycle, max(cycle) OVER (" + WE + ") - cycle AS RUL, setting_1, "
         + ", ".join(SENSORS) + ", " + ", ".join(roll + deg) + " FROM readings)")
    stats = ("st AS (SELECT " + ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS s_{c}"
        for c in PREP_FEATURES) + " FROM f)")
    scaled = ("sc AS (SELECT engine_id, cycle, RUL, " + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in PREP_FEATURES)
              + " FROM f CROSS JOIN st)")
    body = (f"""SELECT sc.*, max(RUL) OVER ({WE}) AS max_rul,
       CAST(coalesce(RUL / nullif(CAST(max(RUL) OVER ({WE}) AS DOUBLE), 0) < {dbl(1 - 0.8)}, false) AS BIGINT) AS is_anomaly
FROM sc""")
    return with_readings(body, f, stats, scaled)


@register("training_preparation", PREP_SPEC, _prep_sql(), "L1 L2 W1 W2 W3 W4 W7 W8 F4 P5 M1 A1 S4")
def training_preparation(spark, sf_dir):
    """The reference's batch preparation as one lazy plan: RUL, 36 rolling
    statistics, cycle_norm, trends and differences (one exchange), inf/NaN → 0,
    standard scaling of all 47 features, life-fraction labels."""
    from .preparation import prepare_training_tables

    r = event_readings(spark, sf_dir).select("engine_id", "cycle", "setting_1", *SENSORS)
    return prepare_training_tables(r).anomaly
