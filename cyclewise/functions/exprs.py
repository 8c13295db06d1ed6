"""Column-expression helpers. Everything here builds JVM-side expressions
(no Python UDFs), so plans stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Division that yields NULL on a zero divisor (ANSI mode stays on)."""
    return F.try_divide(col(num), col(den))


def is_bad_number(c: ColumnOrName) -> Column:
    """True for NaN, +inf and -inf (the reference's missing markers)."""
    x = col(c)
    return F.isnan(x) | (x == F.lit(float("inf"))) | (x == F.lit(float("-inf")))


def inf_to_null(c: ColumnOrName) -> Column:
    """±inf and NaN → NULL; pandas ``replace([inf, -inf], nan)`` then treats
    NaN as missing, which in Spark is NULL."""
    x = col(c)
    return F.when(is_bad_number(x), F.lit(None).cast("double")).otherwise(x.cast("double"))


def clamp(c: ColumnOrName, lo: ColumnOrName | float, hi: ColumnOrName | float) -> Column:
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.greatest(lo_c, F.least(hi_c, col(c)))


def non_negative(c: ColumnOrName) -> Column:
    return F.greatest(F.lit(0.0), col(c).cast("double"))


def out_double(c: ColumnOrName, digits: int = 6) -> Column:
    """Output form for floating results: rounded, and ``-0.0`` folded to ``0.0``
    so that results hash the same on every engine."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def out_long(c: ColumnOrName) -> Column:
    return col(c).cast("bigint")


def epoch_seconds(ts: ColumnOrName) -> Column:
    """Epoch seconds (double) of a TIMESTAMP or TIMESTAMP_NTZ column (session
    zone UTC for NTZ), the reference's float ``timestamp``."""
    return F.unix_micros(col(ts).cast("timestamp")) / F.lit(1_000_000.0)


def fixed_decimals(c: ColumnOrName, digits: int = 3) -> Column:
    """``f'{x:.3f}'`` text."""
    return F.format_string(f"%.{digits}f", col(c))


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table to every row of ``df``. The row
    goes through a global aggregate, which makes it one row whatever comes in
    and fails unless exactly one came in; so the broadcast is one row, the
    result has ``len(df)`` rows and ``df`` is not shuffled."""
    names = one_row.columns
    row = one_row.agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in names])
    refuse = F.raise_error(F.lit("attach_row needs a table of exactly one row"))
    row = row.select(*[F.when(F.col("_rows") == 1, F.col(c)).otherwise(refuse).alias(c) for c in names])
    return df.crossJoin(F.broadcast(row))
