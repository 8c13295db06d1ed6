"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` would also change other alphabets, but
    for text without any (as many bytes as characters) it is the same and
    much faster than ``translate``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def text_key(c: Column, salt: str = "k") -> list[Column]:
    """Two longs that stand for a text: a 128-bit key, so that chance
    collisions stay out of reach at any corpus size. Null and empty differ."""
    return [F.xxhash64(c), F.xxhash64(F.lit(salt), c)]


ARROW_ROWS = 800


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most ``ARROW_ROWS``
    rows: a batch is in memory whole on both sides, and rows here are texts.
    (A session setting, as Spark reads it when the plan runs.)"""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return df


#: bytes of text that are worked on at once
SLICE = 2 << 20


def byte_slices(batch: pa.RecordBatch, column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Runs of rows of ``batch`` whose texts in ``column`` have at most ``most``
    bytes together; a longer text comes alone."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, size[at] + (most or SLICE), "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
