"""Projection, filtering and cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import attach_row, inf_to_null
from ..schema import CYCLE, ENGINE, TARGET, feature_columns
from .quantiles import linear_quantiles

DEFAULT_ENGINE_COUNT = 5  # engines replayed when none are chosen


def select_features(df: DataFrame, exclude: Sequence[str] = (ENGINE, CYCLE, TARGET),
                    drop_suffixes: Sequence[str] = ()) -> DataFrame:
    """Every column but ids / target (and optionally derived suffixes)."""
    cols = [c for c in feature_columns(df.columns, tuple(exclude)) if not any(c.endswith(s) for s in drop_suffixes)]
    return df.select(*cols)


def healthy_rows(df: DataFrame, label: str = "is_anomaly") -> DataFrame:
    """Rows labelled healthy (``is_anomaly < 0.5``)."""
    return df.where(F.col(label) < 0.5)


def chosen_engines(df: DataFrame, engines: Sequence[int] | None = None, default_count: int = DEFAULT_ENGINE_COUNT,
                   key: str = ENGINE) -> DataFrame:
    """Keep the chosen engines; unknown ids are dropped. With no choice,
    the ``default_count`` lowest engine ids (a bounded top-k, not a collect).

    The chosen list is small by contract (a request parameter), so it is
    matched with ``isin``; the default list is a left-semi join against a
    5-row table.
    """
    if engines:
        return df.where(F.col(key).isin(list(engines)))
    first = df.select(key).distinct().orderBy(key).limit(default_count)
    return df.join(F.broadcast(first), key, "left_semi")


def require_rows(df: DataFrame, what: str = "engines") -> DataFrame:
    """P3's guard: raise when nothing is left (one bounded probe)."""
    if df.limit(1).count() == 0:
        raise ValueError(f"No valid {what} found")
    return df


def valid_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Target present, not NaN and ≥ 0."""
    t = F.col(target)
    return df.where(t.isNotNull() & ~F.isnan(t.cast("double")) & (t >= 0))


def inf_to_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P5: ±inf/NaN → missing → 0."""
    return df.select(*[F.coalesce(inf_to_null(c), F.lit(0.0)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def median_impute(df: DataFrame, cols: Sequence[str], medians: DataFrame | None = None) -> DataFrame:
    """±inf → missing, then missing → column median (exact). ``medians``:
    one row of earlier fitted ``_med_0``, ``_med_1``, ..."""
    clean = df.select(*[inf_to_null(c).alias(c) if c in cols else F.col(c) for c in df.columns])
    if medians is None:
        fitted = linear_quantiles(clean, cols, (0.5,))
        out = clean.withColumns({f"_med_{i}": F.lit(fitted[c][0]).cast("double") for i, c in enumerate(cols)})
    else:
        out = attach_row(clean, medians)
    idx = {c: i for i, c in enumerate(cols)}
    return out.select(*[F.coalesce(F.col(c), F.col(f"_med_{idx[c]}")).alias(c) if c in idx else F.col(c)
                        for c in df.columns])


def constant_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column with ``is_constant`` (population std = 0)."""
    wide = df.agg(*[F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("feature"), (F.col(f"_s{i}") == 0).alias("is_constant"))
            for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def fill_missing_features(df: DataFrame, features: Sequence[str], default: float = 0.0) -> DataFrame:
    """Make ``df`` carry exactly ``features`` (in order) for scoring;
    absent columns become ``default``, missing values too."""
    have = set(df.columns)
    keep = [c for c in df.columns if c not in set(features)]
    cols = [F.coalesce(F.col(f).cast("double"), F.lit(default)).alias(f) if f in have else F.lit(default).alias(f)
            for f in features]
    return df.select(*keep, *cols)
