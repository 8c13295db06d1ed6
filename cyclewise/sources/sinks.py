"""Writers. Output goes to shared storage; folders
are written whole by Spark's commit protocol, so a retried task or job
leaves no partial files behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite", header: bool = True) -> None:
    """Processed / anomaly tables as Parquet (default) or CSV."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", header).csv(path)
    else:
        w.format(fmt).save(path)


def write_sensor_log(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """The whitespace text layout read by ``read_sensor_log`` (no header)."""
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode(
        "overwrite").text(path)


def save_stats(stats_long: DataFrame, path: str) -> None:
    """Normalisation stats ``feature, mean, std``."""
    stats_long.write.mode("overwrite").parquet(path)


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stats_wide(stats_long: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long stats back to the one-row ``{c}__mean / {c}__std`` form used by
    ``zscore`` (a pivot over at most one row per feature)."""
    aggs = []
    for c in features:
        aggs += [F.max(F.when(F.col("feature") == c, F.col("mean"))).alias(f"{c}__mean"),
                 F.max(F.when(F.col("feature") == c, F.col("std"))).alias(f"{c}__std")]
    return stats_long.agg(*aggs)


def write_sequences(seq: DataFrame, path: str) -> None:
    """Sequence tensors as Parquet rows with an ``array<struct>`` column."""
    seq.write.mode("overwrite").parquet(path)
