"""Nested stream records and their JSON form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CYCLE, ENGINE, READING_SCHEMA, RAW_SENSOR, RAW_SETTING


def _map(cols: Sequence[str], cast: str) -> Column:
    if not cols:
        return F.create_map().cast(f"map<string,{cast}>")
    return F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(c).cast(cast) for c in cols]))


def nest_reading(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Split flat columns by prefix into ``sensors`` / ``settings`` maps;
    everything else but the ids and timestamp goes to ``metadata`` as text."""
    cols = df.columns
    sensors = [c for c in cols if c.startswith("sensor_")]
    settings = [c for c in cols if c.startswith("setting_")]
    meta = [c for c in cols if c not in sensors + settings + [ENGINE, CYCLE, ts]]
    return df.select(
        F.col(ENGINE).cast("int").alias(ENGINE), F.col(CYCLE).cast("int").alias(CYCLE),
        F.col(ts).cast("double").alias("timestamp"), _map(sensors, "double").alias("sensors"),
        _map(settings, "double").alias("settings"), _map(meta, "string").alias("metadata"),
    )


def raw_sensor_names(m: Column) -> Column:
    """Keys of a sensor map that are raw sensors (``^sensor_\\d+$``)."""
    return F.filter(F.map_keys(m), lambda k: k.rlike(RAW_SENSOR.pattern))


def raw_setting_names(m: Column) -> Column:
    return F.filter(F.map_keys(m), lambda k: k.rlike(RAW_SETTING.pattern))


def to_json_records(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON document per record."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def from_json_records(df: DataFrame, col: str = "json", schema=READING_SCHEMA) -> DataFrame:
    return df.select(F.from_json(col, schema).alias("r")).select("r.*")
