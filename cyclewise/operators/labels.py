"""Labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import safe_div
from ..schema import CYCLE, ENGINE, TARGET
from .ordering import DEFAULT_CHUNK_ROWS, engine_aggregates

# Health tiers and the fixed anomaly cut.
GOOD_RUL = 100
WARNING_RUL = 50
FIXED_ANOMALY_RUL = 50
LIFE_PERCENT_SPAN = 300


def add_rul(df: DataFrame, key: str = ENGINE, seq: str = CYCLE, out: str = TARGET,
            chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """L1: RUL = max(cycle) of the engine − cycle."""
    withmax = engine_aggregates(df, [F.max(seq).alias("_max_cycle")], key=key, seq=seq, chunk_rows=chunk_rows)
    return withmax.withColumn(out, F.col("_max_cycle") - F.col(seq)).drop("_max_cycle")


def life_fraction_label(df: DataFrame, healthy_threshold: float = 0.8, key: str = ENGINE, seq: str = CYCLE,
                        rul: str = TARGET, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """L2: ``max_rul`` per engine and ``is_anomaly = RUL / max_rul < 1 - threshold``.

    A single-cycle engine has 0/0, which the reference treats as not degraded.
    """
    cut = 1 - healthy_threshold  # same double as the reference computes
    out = engine_aggregates(df, [F.max(rul).alias("max_rul")], key=key, seq=seq, chunk_rows=chunk_rows)
    flag = F.coalesce(safe_div(F.col(rul).cast("double"), F.col("max_rul").cast("double")) < F.lit(cut), F.lit(False))
    return out.withColumn("is_anomaly", flag.cast("int"))


def rul_and_life_fraction(df: DataFrame, healthy_threshold: float = 0.8, key: str = ENGINE, seq: str = CYCLE,
                          rul: str = TARGET, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """L1 and L2 with one attach: the largest RUL of an engine is its last
    cycle less its first."""
    ends = [F.min(seq).alias("_first"), F.max(seq).alias("_last")]
    out = engine_aggregates(df, ends, key=key, seq=seq, chunk_rows=chunk_rows)
    left, life = F.col("_last") - F.col(seq), F.col("_last") - F.col("_first")
    flag = F.coalesce(safe_div(left.cast("double"), life.cast("double")) < F.lit(1 - healthy_threshold), F.lit(False))
    return out.select(*[c for c in df.columns if c not in (rul, "max_rul", "is_anomaly")], left.alias(rul), life.alias("max_rul"), flag.cast("int").alias("is_anomaly"))


def fixed_label(rul: str = TARGET, cut: int = FIXED_ANOMALY_RUL) -> Column:
    """L3: ``RUL < 50`` as 0/1."""
    return (F.col(rul) < F.lit(cut)).cast("int")


def health_tier(rul: Column | str) -> Column:
    """L4: >100 good, >50 warning, else critical."""
    r = F.col(rul) if isinstance(rul, str) else rul
    return F.when(r > GOOD_RUL, "good").when(r > WARNING_RUL, "warning").otherwise("critical")


def alert_tier(n_critical: Column | str) -> Column:
    c = F.col(n_critical) if isinstance(n_critical, str) else n_critical
    return F.when(c == 0, "good").otherwise("critical")


def activity_tier(n_active: Column | str) -> Column:
    c = F.col(n_active) if isinstance(n_active, str) else n_active
    return F.when(c > 0, "good").otherwise("warning")


def life_percent(rul: Column | str) -> Column:
    """min(100, RUL / 300 · 100)."""
    r = F.col(rul) if isinstance(rul, str) else rul
    return F.least(F.lit(100.0), r.cast("double") / F.lit(float(LIFE_PERCENT_SPAN)) * F.lit(100.0))
