"""Alert and estimate rules. Pure projections — no
shuffle — so the same functions run on batch tables and inside streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import fixed_decimals
from ..schema import ALERT_DETAILS, CYCLE, SensorSchema

# Rule thresholds and labels.
PAIR_ALERT_LIMIT = 2.0  # two-sensor alert (v1)
SENSOR_LIMIT = 3.0  # per-sensor threshold alert
PAIR_GAP_LIMIT = 2.5  # sensor_1 / sensor_2 gap alert
DEFAULT_SEVERITY = "medium"
BASE_RUL = 100.0  # estimate base when no RUL is known
DEGRADATION_CYCLES = 100.0
MIN_CONFIDENCE = 0.5
MODEL_VERSION = "improved_v1.0"
HISTORY_SCORE_BASE = 0.1
HISTORY_SCORE_SLOPE = 0.1
HISTORY_SCORE_LIMIT = 0.5
ERROR_RATE_LIMIT = 0.05
IDLE_SECONDS = 60.0


def pair_alert(df: DataFrame, s1: str = "sensor_1", s2: str = "sensor_2", limit: float = PAIR_ALERT_LIMIT) -> DataFrame:
    """One ``sensor_anomaly`` row when either sensor is beyond ±limit."""
    hit = (F.abs(F.coalesce(F.col(s1), F.lit(0.0))) > limit) | (F.abs(F.coalesce(F.col(s2), F.lit(0.0))) > limit)
    text = F.concat(F.lit(f"Sensor values outside normal range: {s1}="), fixed_decimals(s1), F.lit(f", {s2}="),
                    fixed_decimals(s2))
    return df.where(hit).select("*", F.lit("sensor_anomaly").alias("alert_type"), text.alias("details"))


def _detail(kind: str, sensor=None, value=None, threshold=None, sensors=None, score=None) -> Column:
    def lit(x, t):
        return x if isinstance(x, Column) else F.lit(x).cast(t)

    return F.struct(
        F.lit(kind).alias("type"), lit(sensor, "string").alias("sensor"), lit(value, "double").alias("value"),
        lit(threshold, "double").alias("threshold"), lit(sensors, "array<string>").alias("sensors"),
        lit(score, "double").alias("correlation_score"),
    )


def alert_candidates(sensors: Sequence[str], pair: tuple[str, str] = ("sensor_1", "sensor_2"),
                     limit: float = SENSOR_LIMIT, gap: float = PAIR_GAP_LIMIT) -> Column:
    """R2 + R3 as one array of nullable detail structs (one per possible alert)."""
    items = [F.when(F.abs(F.col(s)) > limit, _detail("threshold_exceeded", s, F.col(s), limit)) for s in sensors]
    a, b = pair
    score = F.abs(F.col(a) - F.col(b))
    items.append(F.when(score > gap, _detail("correlation_anomaly", sensors=F.array(F.lit(a), F.lit(b)), score=score)))
    return F.array(*items)


def alerts(df: DataFrame, sensors: Sequence[str] | None = None, severity: str = DEFAULT_SEVERITY,
           keep: Sequence[str] = ("event_id", "engine_id", CYCLE, "timestamp")) -> DataFrame:
    """The combined alert stream — per-sensor threshold alerts for raw
    sensors (``^sensor_\\d+$``) and the pair-gap alert, each with severity,
    message and details. ``alert_ord`` orders alerts raised by one reading."""
    sensors = list(sensors or SensorSchema.of(df).sensors)
    cand = alert_candidates(sensors)
    keep = [c for c in keep if c in df.columns]
    exploded = df.select(*keep, F.posexplode(F.filter(cand, lambda x: x.isNotNull())).alias("alert_ord", "details"))
    return exploded.select(
        *keep, "alert_ord", F.col("details.type").alias("alert_type"), F.lit(severity).alias("severity"),
        F.concat(F.lit("Anomaly detected: "), F.col("details.type")).alias("message"),
        F.col("details").cast(ALERT_DETAILS).alias("details"),
    )


def degradation(cycle: Column | str = CYCLE) -> Column:
    c = F.col(cycle) if isinstance(cycle, str) else cycle
    return F.greatest(F.lit(0.0), (c - 1).cast("double") / F.lit(DEGRADATION_CYCLES))


def rul_estimate(base: Column | None = None, cycle: Column | str = CYCLE) -> Column:
    """max(0, base · (1 − g)); base = known RUL, else 100 (noise dropped)."""
    b = F.coalesce(base.cast("double"), F.lit(BASE_RUL)) if base is not None else F.lit(BASE_RUL)
    return F.greatest(F.lit(0.0), b * (F.lit(1.0) - degradation(cycle)))


def confidence(cycle: Column | str = CYCLE) -> Column:
    """max(0.5, 1 − g)."""
    return F.greatest(F.lit(MIN_CONFIDENCE), F.lit(1.0) - degradation(cycle))


def predictions(df: DataFrame, base: str | None = "RUL", sensors: Sequence[str] | None = None,
                keep: Sequence[str] = ("event_id", "engine_id", CYCLE, "timestamp")) -> DataFrame:
    """R5 + R6: one prediction record per reading."""
    sensors = list(sensors or SensorSchema.of(df).sensors)
    keep = [c for c in keep if c in df.columns]
    b = F.col(base) if base and base in df.columns else None
    return df.select(
        *keep, rul_estimate(b).alias("predicted_rul"), confidence().alias("confidence"),
        F.lit(MODEL_VERSION).alias("model_version"), F.array(*[F.lit(s) for s in sensors]).alias("features_used"),
    )


def history_score(s1: Column | str = "sensor_1") -> Column:
    """0.1 + 0.1 · |sensor_1|."""
    x = F.col(s1) if isinstance(s1, str) else s1
    return F.lit(HISTORY_SCORE_BASE) + F.abs(F.coalesce(x, F.lit(0.0))) * F.lit(HISTORY_SCORE_SLOPE)


def history_flag(score: Column | str) -> Column:
    x = F.col(score) if isinstance(score, str) else score
    return x > F.lit(HISTORY_SCORE_LIMIT)


def error_rate_issue(errors: Column, total: Column) -> Column:
    """``High error rate: x.xx%`` when errors / max(1, total) > 5 %."""
    rate = errors.cast("double") / F.greatest(F.lit(1), total)
    return F.when(rate > ERROR_RATE_LIMIT, F.concat(F.lit("High error rate: "), F.format_string("%.2f", rate * 100),
                                                    F.lit("%")))


def idle_issue(last_activity: Column, now: Column, limit: float = IDLE_SECONDS) -> Column:
    """No activity within ``limit`` seconds of ``now``."""
    return F.when(now - last_activity > limit, F.lit(f"No streaming activity in last {int(limit)} seconds"))


def system_status(*issues: Column) -> Column:
    """Healthy when no health issue is raised."""
    none = F.coalesce(*issues).isNull() if issues else F.lit(True)
    return F.when(none, "healthy").otherwise("degraded")
