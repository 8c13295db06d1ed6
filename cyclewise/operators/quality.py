"""Reading validation. One projection per reading — the
same function serves batch tables and streams.

Input fields may be text (as read from CSV) or numeric. Per reading:

* Q1 required fields present, else ``Missing required field: f`` (invalid);
* Q2 ids / timestamp coerced from text (``int(float(v))`` / ``float(v)``):
  success counts a correction, failure is an issue (invalid);
* Q3 sensors coerced; failure → 0.0, issue, invalid;
* Q4 sensors outside the learned range are clamped: issue + correction, the
  reading stays valid;
* Q5 settings coerced like sensors, without a range check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import attach_row
from ..schema import CYCLE, ENGINE, SensorSchema
from .ordering import DEFAULT_CHUNK_ROWS, engine_aggregates

REQUIRED = (ENGINE, CYCLE, "timestamp")
RANGE_MARGIN = 0.1  # learned ranges widen by 10 % of the span
KEEP_PER_ENGINE = 500


def _is_text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def _shown(c: str) -> Column:
    """The source value as text, ``None`` when missing (Python's ``str``)."""
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def _num(x: Column | str, digits: int = 6) -> Column:
    return F.format_string(f"%.{digits}f", x if isinstance(x, Column) else F.col(x))


def learn_ranges(df: DataFrame, cols: Sequence[str], margin: float = RANGE_MARGIN) -> DataFrame:
    """Q6: one row with ``{c}__lo`` / ``{c}__hi`` = min/max of the parseable
    values widened by ``margin`` of the span (one aggregate pass)."""
    aggs = []
    for c in cols:
        v = F.col(c).try_cast("double")
        aggs += [F.min(v).alias(f"_mn{c}"), F.max(v).alias(f"_mx{c}")]
    wide = df.agg(*aggs)
    out = []
    for c in cols:
        mn, mx = F.col(f"_mn{c}"), F.col(f"_mx{c}")
        pad = (mx - mn) * F.lit(margin)
        out += [(mn - pad).alias(f"{c}__lo"), (mx + pad).alias(f"{c}__hi")]
    return wide.select(*out)


def ranges_long(ranges: DataFrame, cols: Sequence[str]) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}__lo").alias("lo"), F.col(f"{c}__hi").alias("hi"))
            for c in cols]
    return ranges.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def validate(df: DataFrame, ranges: DataFrame | None = None, required: Sequence[str] = REQUIRED,
             sensors: Sequence[str] | None = None, settings: Sequence[str] | None = None) -> DataFrame:
    """Validate and correct readings. Adds ``issues`` (array of messages),
    ``n_issues``, ``n_corrections`` and ``is_valid``; replaces the checked
    columns by their corrected values."""
    schema = SensorSchema.of(df)
    sensors = list(sensors if sensors is not None else schema.sensors)
    settings = list(settings if settings is not None else schema.settings)
    src = attach_row(df, ranges) if ranges is not None else df
    ranged = {c for c in sensors if ranges is not None and f"{c}__lo" in ranges.columns}

    issues: list[Column] = []
    corrections: list[Column] = []
    invalid: list[Column] = []
    fixed: dict[str, Column] = {}

    for f in required:
        if f not in df.columns:
            issues.append(F.lit(f"Missing required field: {f}"))
            invalid.append(F.lit(True))
            continue
        raw = F.col(f)
        missing = raw.isNull()
        parsed = raw.try_cast("double")
        # the text "nan" or "inf" is a number, but no id
        value = parsed.try_cast("bigint") if f in (ENGINE, CYCLE) else parsed
        fixed[f] = value
        if _is_text(df, f):
            bad = ~missing & value.isNull()
            label = (F.lit(f"Invalid type for {f}: <class 'str'>") if f in (ENGINE, CYCLE)
                     else F.concat(F.lit("Invalid timestamp: "), raw))
            issues += [F.when(missing, F.lit(f"Missing required field: {f}")), F.when(bad, label)]
            corrections.append((~missing & ~bad).cast("int"))
            invalid += [missing, bad]
        else:
            missing = missing | value.isNull()
            issues.append(F.when(missing, F.lit(f"Missing required field: {f}")))
            invalid.append(missing)

    for group, kind in ((sensors, "sensor"), (settings, "setting")):
        for c in group:
            raw = F.col(c)
            parsed = raw.try_cast("double")
            text = _is_text(df, c)
            failed = parsed.isNull() if text else raw.isNull()
            value = F.coalesce(parsed, F.lit(0.0))
            issues.append(F.when(failed, F.concat(F.lit(f"Invalid {kind} value for {c}: "), _shown(c))))
            invalid.append(failed)
            if text:
                corrections.append((~failed).cast("int"))
            if kind == "sensor" and c in ranged:
                lo, hi = F.col(f"{c}__lo"), F.col(f"{c}__hi")
                inside = (value >= lo) & (value <= hi)
                out_msg = F.concat(F.lit(f"Sensor {c} value "), _num(value), F.lit(" outside expected range ["),
                                   _num(lo), F.lit(", "), _num(hi), F.lit("]"))
                issues.append(F.when(~F.coalesce(inside, F.lit(False)), out_msg))
                corrections.append((~F.coalesce(inside, F.lit(False))).cast("int"))
                value = F.when(F.coalesce(inside, F.lit(False)), value).otherwise(F.greatest(lo, F.least(hi, value)))
            fixed[c] = value

    issue_arr = F.filter(F.array(*issues), lambda x: x.isNotNull()) if issues else F.array().cast("array<string>")
    n_corr = sum(corrections[1:], corrections[0]) if corrections else F.lit(0)
    bad_any = F.greatest(*[F.coalesce(x, F.lit(False)).cast("int") for x in invalid]) if len(invalid) > 1 else (
        F.coalesce(invalid[0], F.lit(False)).cast("int") if invalid else F.lit(0))
    cols = [fixed[c].alias(c) if c in fixed else F.col(c) for c in df.columns]
    return src.select(
        *cols, issue_arr.alias("issues"), F.size(issue_arr).alias("n_issues"),
        n_corr.cast("int").alias("n_corrections"), (bad_any == 0).alias("is_valid"),
    )


def validation_counters(validated: DataFrame) -> DataFrame:
    """Q7: total readings, invalid readings, corrections made."""
    return validated.agg(
        F.count(F.lit(1)).alias("total_validated"),
        F.count_if(~F.col("is_valid")).alias("validation_errors"),
        F.coalesce(F.sum("n_corrections"), F.lit(0)).alias("corrections_made"),
    )


def keep_latest_per_engine(df: DataFrame, n: int = KEEP_PER_ENGINE, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Q8: at most the last ``n`` readings (by cycle) of every engine. Uses
    the engine length from a partial aggregate, so no engine is gathered."""
    withn = engine_aggregates(df, [F.max(CYCLE).alias("_last")], chunk_rows=chunk_rows)
    return withn.where(F.col(CYCLE) > F.col("_last") - n).drop("_last")
