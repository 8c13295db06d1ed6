"""Column resolution for reading tables: ids, settings and sensors
are found by name, once, from ``df.columns``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ENGINE = "engine_id"
CYCLE = "cycle"
TARGET = "RUL"

# Raw reading layout (engine, cycle, 3 settings, 21 sensors).
N_SETTINGS = 3
N_SENSORS = 21
RAW_COLUMNS = [ENGINE, CYCLE] + [f"setting_{i}" for i in range(1, N_SETTINGS + 1)] + [
    f"sensor_{i}" for i in range(1, N_SENSORS + 1)
]

RAW_SENSOR = re.compile(r"^sensor_\d+$")
RAW_SETTING = re.compile(r"^setting_\d+$")


def _index(name: str) -> int:
    return int(name.rsplit("_", 1)[1])


@dataclass(frozen=True)
class SensorSchema:
    sensors: tuple[str, ...]
    settings: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame | list[str]) -> "SensorSchema":
        cols = df.columns if isinstance(df, DataFrame) else list(df)
        sensors = sorted((c for c in cols if RAW_SENSOR.match(c)), key=_index)
        settings = sorted((c for c in cols if RAW_SETTING.match(c)), key=_index)
        return cls(tuple(sensors), tuple(settings))

    @property
    def measures(self) -> tuple[str, ...]:
        return self.settings + self.sensors


def raw_schema() -> T.StructType:
    fields = [T.StructField(ENGINE, T.IntegerType()), T.StructField(CYCLE, T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType()) for c in RAW_COLUMNS[2:]]
    return T.StructType(fields)


def feature_columns(cols: list[str], exclude: tuple[str, ...] = (ENGINE, CYCLE, TARGET)) -> list[str]:
    """Model inputs are every column but ids and the target."""
    return [c for c in cols if c not in exclude]


# Stream record shapes (FIXTURES §2).
READING_SCHEMA = T.StructType([
    T.StructField(ENGINE, T.IntegerType()),
    T.StructField(CYCLE, T.IntegerType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("sensors", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("settings", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

ALERT_DETAILS = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("sensor", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("sensors", T.ArrayType(T.StringType())),
    T.StructField("correlation_score", T.DoubleType()),
])
