"""File readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import running_sum
from ..schema import ENGINE, RAW_COLUMNS
from ..session import materialise


def read_sensor_log(spark: SparkSession, path: str, columns: Sequence[str] = RAW_COLUMNS,
                    int_columns: Sequence[str] = (ENGINE, "cycle")) -> DataFrame:
    """Whitespace-separated readings, no header, fields by position
    (trailing blanks tolerated, blank lines skipped). Unparseable fields
    become NULL."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    cols = []
    for i, c in enumerate(columns):
        # a short line has no such field; a NaN or huge number is no integer
        v = F.get(parts, F.lit(i)).try_cast("double")
        cols.append((v.try_cast("int") if c in int_columns else v).alias(c))
    return lines.select(*cols)


def read_rul_truth(spark: SparkSession, path: str, key: str = ENGINE, value: str = "rul") -> DataFrame:
    """One number per line; the 1-based line number is the engine. Blank
    lines have no number; several files follow each other by name.

    A line's place is its file, the block of the file that it was read in, and
    its place in the block; running counts over the blocks, a table of one row
    a block, make that the line number."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.where(F.length(F.trim("value")) > 0).withColumn("id", F.monotonically_increasing_id())
    # ids are read off once: the lines of a block have successive ones
    lines = materialise(lines, "lines")
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0))
    upto = running_sum(blocks, "all", ["file", "block"], "n", out="upto").select("file", "block", "first", (F.col("upto") - F.col("n")).alias("before"))
    number = F.col("before") + F.col("id") - F.col("first") + 1
    return lines.join(upto, ["file", "block"]).select(number.cast("long").alias(key), F.trim("value").try_cast("double").alias(value))


def read_processed_csv(spark: SparkSession, path: str, numeric: bool = True) -> DataFrame:
    """S3: a processed table written as CSV with a header. Like the
    reference's row readers, lines with fewer fields than the header are
    skipped and extra trailing fields are ignored (numeric files, no quoting).
    The header is read once (one line); every part file's header line is
    dropped."""
    text = spark.read.text(path)
    header = text.first()["value"]
    names = header.split(",")
    fields = F.split("value", ",")
    rows = text.where((F.col("value") != header) & (F.size(fields) >= len(names)))
    cast = (lambda c: c.try_cast("double")) if numeric else (lambda c: c)
    return rows.select(*[cast(fields.getItem(i)).alias(n) for i, n in enumerate(names)])
