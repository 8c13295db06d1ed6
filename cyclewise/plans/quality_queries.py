"""Registered queries: cleaning (P) and validation (Q).

Faults are injected by the same deterministic rules on both sides (FIXTURES
§4): text ``bad`` / ``n/a`` / ``unit-…`` in fields, missing values, ±inf."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as cl
from ..operators import labels as lb
from ..operators import quality as qa
from ..sources.tables import event_base, event_readings
from .common import WE, dbl, with_readings
from .registry import register

RANGED = ["sensor_1", "sensor_2", "sensor_3", "setting_1"]


def history(spark, sf_dir):
    """What ranges are learned from: every reading, before faults go in."""
    return event_base(spark, sf_dir).select(*RANGED)


def raw_records(spark, sf_dir):
    """Readings as text fields (what a CSV reader yields) with faults."""
    r = event_readings(spark, sf_dir, columns=["sensor_1", "sensor_2", "setting_1"])
    eid = F.col("event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ts_text = F.concat(F.floor(micros / 1_000_000).cast("bigint").cast("string"), F.lit("."),
                       F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0"))
    return r.select(
        "event_id", "ts",
        F.when(eid % 37 == 0, F.concat(F.lit("unit-"), F.col("engine_id").cast("string")))
         .when(eid % 59 == 0, F.lit("nan")).when(eid % 61 == 0, F.lit("inf"))
         .otherwise(F.col("engine_id").cast("string")).alias("engine_id"),
        F.col("cycle").cast("string").alias("cycle"),
        F.when(eid % 23 == 0, F.lit(None).cast("string")).otherwise(ts_text).alias("timestamp"),
        F.when(eid % 17 == 0, F.lit("bad")).when(eid % 53 == 0, (F.col("sensor_1") * 10 + 1000).cast("string"))
         .otherwise(F.col("sensor_1").cast("string")).alias("sensor_1"),
        F.when(eid % 41 == 0, F.lit(None).cast("string"))
         .otherwise(F.col("sensor_2").cast("bigint").cast("string")).alias("sensor_2"),
        F.when(eid % 19 == 0, F.lit("n/a")).otherwise(F.col("setting_1").cast("bigint").cast("string")).alias("setting_1"),
    )


RAW_SQL = """raw AS (
  SELECT event_id, ts,
         CASE WHEN event_id % 37 = 0 THEN 'unit-' || CAST(engine_id AS VARCHAR)
              WHEN event_id % 59 = 0 THEN 'nan' WHEN event_id % 61 = 0 THEN 'inf' ELSE CAST(engine_id AS VARCHAR) END AS engine_id,
         CAST(cycle AS VARCHAR) AS cycle,
         CASE WHEN event_id % 23 = 0 THEN NULL
              ELSE CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END AS timestamp,
         CASE WHEN event_id % 17 = 0 THEN 'bad' WHEN event_id % 53 = 0 THEN CAST(sensor_1 * 10 + 1000 AS VARCHAR)
              ELSE CAST(sensor_1 AS VARCHAR) END AS sensor_1,
         CASE WHEN event_id % 41 = 0 THEN NULL ELSE CAST(CAST(sensor_2 AS BIGINT) AS VARCHAR) END AS sensor_2,
         CASE WHEN event_id % 19 = 0 THEN 'n/a' ELSE CAST(CAST(setting_1 AS BIGINT) AS VARCHAR) END AS setting_1
  FROM readings)"""

RANGES_SQL = f"""mm AS (
  SELECT min(sensor_1) AS mn1, max(sensor_1) AS mx1, min(sensor_2) AS mn2, max(sensor_2) AS mx2,
         min(sensor_3) AS mn3, max(sensor_3) AS mx3, min(setting_1) AS mn4, max(setting_1) AS mx4 FROM readings),
rng AS (
  SELECT mn1 - (mx1 - mn1) * {dbl(0.1)} AS lo1, mx1 + (mx1 - mn1) * {dbl(0.1)} AS hi1,
         mn2 - (mx2 - mn2) * {dbl(0.1)} AS lo2, mx2 + (mx2 - mn2) * {dbl(0.1)} AS hi2,
         mn3 - (mx3 - mn3) * {dbl(0.1)} AS lo3, mx3 + (mx3 - mn3) * {dbl(0.1)} AS hi3,
         mn4 - (mx4 - mn4) * {dbl(0.1)} AS lo4, mx4 + (mx4 - mn4) * {dbl(0.1)} AS hi4 FROM mm)"""


def learned_ranges_df(spark, sf_dir):
    return qa.learn_ranges(history(spark, sf_dir), RANGED)


@register("learned_ranges", "feature:s lo:d hi:d", with_readings(
    "SELECT 'sensor_1' AS feature, lo1 AS lo, hi1 AS hi FROM rng UNION ALL SELECT 'sensor_2', lo2, hi2 FROM rng "
    "UNION ALL SELECT 'sensor_3', lo3, hi3 FROM rng UNION ALL SELECT 'setting_1', lo4, hi4 FROM rng",
    RANGES_SQL), "Q6 J2")
def learned_ranges(spark, sf_dir):
    """Q6: ranges of all sensors and settings over the whole history, widened
    by 10 % of the span."""
    return qa.ranges_long(learned_ranges_df(spark, sf_dir), RANGED)


def validated(spark, sf_dir):
    raw = raw_records(spark, sf_dir)
    out = qa.validate(raw.drop("ts"), learned_ranges_df(spark, sf_dir),
                      sensors=["sensor_1", "sensor_2"], settings=["setting_1"])
    return out


def _issue(cond: str, msg: str) -> str:
    return f"CASE WHEN {cond} THEN {msg} END"


def _range_msg(s: str, v: str, lo: str, hi: str) -> str:
    return (f"'Sensor {s} value ' || printf('%.6f', {v}) || ' outside expected range [' || printf('%.6f', {lo}) "
            f"|| ', ' || printf('%.6f', {hi}) || ']'")


_CONDS = [
    ("engine_id IS NULL", "'Missing required field: engine_id'"),
    ("engine_id IS NOT NULL AND e_i IS NULL", "'Invalid type for engine_id: <class ''str''>'"),
    ("cycle IS NULL", "'Missing required field: cycle'"),
    ("cycle IS NOT NULL AND c_d IS NULL", "'Invalid type for cycle: <class ''str''>'"),
    ("timestamp IS NULL", "'Missing required field: timestamp'"),
    ("timestamp IS NOT NULL AND t_d IS NULL", "'Invalid timestamp: ' || timestamp"),
    ("s1_d IS NULL", "'Invalid sensor value for sensor_1: ' || coalesce(sensor_1, 'None')"),
    ("NOT (s1_v >= lo1 AND s1_v <= hi1)", _range_msg("sensor_1", "s1_v", "lo1", "hi1")),
    ("s2_d IS NULL", "'Invalid sensor value for sensor_2: ' || coalesce(sensor_2, 'None')"),
    ("NOT (s2_v >= lo2 AND s2_v <= hi2)", _range_msg("sensor_2", "s2_v", "lo2", "hi2")),
    ("g1_d IS NULL", "'Invalid setting value for setting_1: ' || coalesce(setting_1, 'None')"),
]
_CORR = ["engine_id IS NOT NULL AND e_i IS NOT NULL", "cycle IS NOT NULL AND c_d IS NOT NULL",
         "timestamp IS NOT NULL AND t_d IS NOT NULL", "s1_d IS NOT NULL", "NOT (s1_v >= lo1 AND s1_v <= hi1)",
         "s2_d IS NOT NULL", "NOT (s2_v >= lo2 AND s2_v <= hi2)", "g1_d IS NOT NULL"]
_INVALID = [c for i, (c, _) in enumerate(_CONDS) if i not in (7, 9)]

VALIDATED_SQL = (
    "v AS (SELECT p.*, rng.*, coalesce(s1_d, 0.0) AS s1_v, coalesce(s2_d, 0.0) AS s2_v FROM (\n"
    "  SELECT raw.*, CASE WHEN isfinite(TRY_CAST(engine_id AS DOUBLE)) THEN TRY_CAST(engine_id AS DOUBLE) END AS e_i, TRY_CAST(cycle AS DOUBLE) AS c_d,\n"
    "         TRY_CAST(timestamp AS DOUBLE) AS t_d, TRY_CAST(sensor_1 AS DOUBLE) AS s1_d,\n"
    "         TRY_CAST(sensor_2 AS DOUBLE) AS s2_d, TRY_CAST(setting_1 AS DOUBLE) AS g1_d FROM raw) p CROSS JOIN rng)"
)

VALIDATED_BODY = (
    "SELECT event_id, CAST(trunc(e_i) AS BIGINT) AS engine_id, CAST(trunc(c_d) AS BIGINT) AS cycle, t_d AS timestamp,\n"
    "  CASE WHEN s1_v >= lo1 AND s1_v <= hi1 THEN s1_v ELSE greatest(lo1, least(hi1, s1_v)) END AS sensor_1,\n"
    "  CASE WHEN s2_v >= lo2 AND s2_v <= hi2 THEN s2_v ELSE greatest(lo2, least(hi2, s2_v)) END AS sensor_2,\n"
    "  coalesce(g1_d, 0.0) AS setting_1,\n"
    "  NOT (" + " OR ".join(f"({c})" for c in _INVALID) + ") AS is_valid,\n"
    "  " + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c, _ in _CONDS) + " AS n_issues,\n"
    "  " + " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in _CORR) + " AS n_corrections,\n"
    "  concat_ws(' | ', " + ", ".join(_issue(c, m) for c, m in _CONDS) + ") AS issues\n"
    "FROM v"
)


@register("validated_readings",
          "event_id:l engine_id:l cycle:l timestamp:d sensor_1:d sensor_2:d setting_1:d is_valid:b n_issues:l "
          "n_corrections:l issues:s",
          with_readings(VALIDATED_BODY, RAW_SQL, RANGES_SQL, VALIDATED_SQL), "Q1 Q2 Q3 Q4 Q5")
def validated_readings(spark, sf_dir):
    """Q1–Q5: validate text readings: required fields, type coercion,
    sensor coercion + clamping to learned ranges, setting coercion."""
    return validated(spark, sf_dir).withColumn("issues", F.array_join("issues", " | "))


@register("validation_counters", "total_validated:l validation_errors:l corrections_made:l", with_readings(
    "SELECT count(*) AS total_validated, count(*) FILTER (WHERE NOT is_valid) AS validation_errors, "
    "sum(n_corrections) AS corrections_made FROM (" + VALIDATED_BODY + ") x",
    RAW_SQL, RANGES_SQL, VALIDATED_SQL), "Q7 A16")
def validation_counters(spark, sf_dir):
    """Q7: validation counters over the whole table."""
    return qa.validation_counters(validated(spark, sf_dir))


@register("latest_500_per_engine", "engine_id:l cycle:l", with_readings(
    f"SELECT engine_id, cycle FROM readings QUALIFY cycle > max(cycle) OVER ({WE}) - 500"), "Q8")
def latest_500_per_engine(spark, sf_dir):
    """Q8: keep at most the last 500 readings of each engine."""
    return qa.keep_latest_per_engine(event_readings(spark, sf_dir, columns=[])).select("engine_id", "cycle")


@register("latest_20_per_engine", "engine_id:l cycle:l", with_readings(
    f"SELECT engine_id, cycle FROM readings QUALIFY cycle > max(cycle) OVER ({WE}) - 20"), "Q8")
def latest_20_per_engine(spark, sf_dir):
    """Q8 with a bound below the engines' lengths, so that readings go."""
    return qa.keep_latest_per_engine(event_readings(spark, sf_dir, columns=[]), n=20).select("engine_id", "cycle")


# ---------------------------------------------------------------- cleaning


@register("healthy_rows", "engine_id:l cycle:l RUL:l", with_readings(
    f"""SELECT engine_id, cycle, RUL FROM (
  SELECT engine_id, cycle, RUL,
         CAST(coalesce(RUL / nullif(CAST(max(RUL) OVER ({WE}) AS DOUBLE), 0) < {dbl(1 - 0.8)}, false) AS BIGINT) AS is_anomaly
  FROM (SELECT engine_id, cycle, max(cycle) OVER ({WE}) - cycle AS RUL FROM readings) t) u
WHERE is_anomaly < 0.5"""), "P2")
def healthy_rows(spark, sf_dir):
    """Readings labelled healthy (training set of the anomaly detector)."""
    r = lb.rul_and_life_fraction(event_readings(spark, sf_dir, columns=[]))
    return cl.healthy_rows(r).select("engine_id", "cycle", "RUL")


@register("chosen_engines", "engine_id:l cycle:l", with_readings(
    "SELECT engine_id, cycle FROM readings WHERE engine_id IN "
    "(SELECT DISTINCT engine_id FROM readings ORDER BY engine_id LIMIT 5)"), "P3 D1")
def chosen_engines(spark, sf_dir):
    """P3 + D1: with no engines chosen, the first five (lowest ids)."""
    r = event_readings(spark, sf_dir, columns=[])
    return cl.require_rows(cl.chosen_engines(r)).select("engine_id", "cycle")


@register("chosen_engines_listed", "engine_id:l n:l", """
SELECT user_id AS engine_id, count(*) AS n FROM events WHERE user_id IN (1, 2, 3, 99999) GROUP BY user_id""", "P3")
def chosen_engines_listed(spark, sf_dir):
    """Explicit choice 1, 2, 3 and an unknown id (dropped)."""
    from ..sources.tables import event_readings_unnumbered, table

    r = event_readings_unnumbered(table(spark, sf_dir, "events"))
    return cl.chosen_engines(r, [1, 2, 3, 99999]).groupBy("engine_id").agg(F.count(F.lit(1)).alias("n"))


def faulty_readings(spark, sf_dir):
    """Numeric readings with ±inf / missing sensor values and bad targets."""
    r = lb.add_rul(event_readings(spark, sf_dir, columns=["sensor_1"]))
    eid = F.col("event_id")
    s1 = (F.when(eid % 29 == 0, F.lit(float("inf"))).when(eid % 31 == 0, F.lit(float("-inf")))
          .when(eid % 23 == 0, F.lit(None).cast("double")).otherwise(F.col("sensor_1")))
    rul = F.when(eid % 43 == 0, F.lit(None)).when(eid % 47 == 0, F.lit(-1)).otherwise(F.col("RUL"))
    return r.select("event_id", "engine_id", "cycle", s1.alias("sensor_1"), rul.alias("RUL"))


FAULTY_SQL = f"""faulty AS (
  SELECT event_id, engine_id, cycle,
         CASE WHEN event_id % 29 = 0 THEN CAST('inf' AS DOUBLE) WHEN event_id % 31 = 0 THEN CAST('-inf' AS DOUBLE)
              WHEN event_id % 23 = 0 THEN NULL ELSE sensor_1 END AS sensor_1,
         CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 47 = 0 THEN -1
              ELSE max(cycle) OVER ({WE}) - cycle END AS RUL
  FROM readings)"""


@register("target_cleaning", "event_id:l engine_id:l cycle:l RUL:l sensor_1_zero:d sensor_1_median:d",
          with_readings("""SELECT event_id, engine_id, cycle, RUL,
       coalesce(CASE WHEN isinf(sensor_1) OR isnan(sensor_1) THEN NULL ELSE sensor_1 END, 0.0) AS sensor_1_zero,
       coalesce(CASE WHEN isinf(sensor_1) OR isnan(sensor_1) THEN NULL ELSE sensor_1 END, med) AS sensor_1_median
FROM faulty CROSS JOIN (SELECT quantile_cont(CASE WHEN isinf(sensor_1) OR isnan(sensor_1) THEN NULL ELSE sensor_1 END, 0.5) AS med
                        FROM faulty) m
WHERE RUL IS NOT NULL AND RUL >= 0""", FAULTY_SQL), "P4 P5 P7")
def target_cleaning(spark, sf_dir):
    """P4 (valid target), P5 (±inf → 0), P7 (median imputation)."""
    f = faulty_readings(spark, sf_dir)
    both = f.withColumns({"sensor_1_zero": F.col("sensor_1"), "sensor_1_median": F.col("sensor_1")})
    both = cl.median_impute(cl.inf_to_zero(both, ["sensor_1_zero"]), ["sensor_1_median"])
    return cl.valid_target(both)


@register("constant_columns", "feature:s is_constant:b", """
SELECT 'sensor_1' AS feature, stddev_pop(value) = 0 AS is_constant FROM events
UNION ALL SELECT 'sensor_2', stddev_pop(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) = 0 FROM events
UNION ALL SELECT 'setting_1', stddev_pop(CAST(hour(ts) AS DOUBLE)) = 0 FROM events
UNION ALL SELECT 'setting_2', stddev_pop(CAST(year(ts) AS DOUBLE)) = 0 FROM events""", "P8")
def constant_columns(spark, sf_dir):
    """Which features never vary (``setting_2`` = year is constant here)."""
    from ..sources.tables import event_readings_unnumbered, table

    ev = table(spark, sf_dir, "events")
    r = event_readings_unnumbered(ev).withColumn("setting_2", F.year("ts").cast("double"))
    return cl.constant_columns(r, ["sensor_1", "sensor_2", "setting_1", "setting_2"])


@register("scoring_frame", "engine_id:l cycle:l sensor_1:d sensor_2:d sensor_4:d setting_1:d setting_2:d",
          with_readings("""SELECT engine_id, cycle, coalesce(sensor_1, 0.0) AS sensor_1, 0.0 AS sensor_2,
       0.0 AS sensor_4, coalesce(setting_1, 0.0) AS setting_1, 0.0 AS setting_2 FROM readings"""), "P9")
def scoring_frame(spark, sf_dir):
    """Sparse request rows (sensor_1, setting_1 only) completed to the
    model's feature list with zeros."""
    r = event_readings(spark, sf_dir, columns=["sensor_1", "setting_1"]).select("engine_id", "cycle", "sensor_1",
                                                                                "setting_1")
    return cl.fill_missing_features(r, ["sensor_1", "sensor_2", "sensor_4", "setting_1", "setting_2"])
