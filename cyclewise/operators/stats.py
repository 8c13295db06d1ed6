"""Column statistics and scaling.

Every statistic is one aggregate pass (map-side partial aggregation, so hot
keys cost nothing extra); the results are one row, or one row per feature,
and are attached back by a broadcast cross join — the broadcast side is
bounded by the number of columns, never by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import attach_row, safe_div
from .quantiles import linear_quantiles, rank_quantile


def _safe(name: str) -> str:
    return name.replace(".", "_")


def feature_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A1: one row with ``{c}__mean`` and ``{c}__std`` (population std; zero
    or undefined variance → 1)."""
    aggs = []
    for c in cols:
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{_safe(c)}__mean"),
                 F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias(f"{_safe(c)}__std")]
    return df.agg(*aggs)


def stats_long(stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A1/S5 long form ``feature, mean, std`` (one row per feature)."""
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"{_safe(c)}__mean").alias("mean"),
                     F.col(f"{_safe(c)}__std").alias("std")) for c in cols]
    return stats.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def zscore(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """F8 / M1: ``(x - mean) / std`` with stored (or freshly fitted) stats;
    std of 0 was already replaced by 1."""
    stats = stats if stats is not None else feature_stats(df, cols)
    joined = attach_row(df, stats)
    scaled = {f"{c}{suffix}": (F.col(c) - F.col(f"{_safe(c)}__mean")) / F.col(f"{_safe(c)}__std") for c in cols}
    keep = [F.col(c) for c in df.columns if c not in scaled]
    return joined.select(*keep, *[v.alias(k) for k, v in scaled.items()])


def robust_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M2 fit: exact median and IQR per column, one row; IQR 0 → 1."""
    qs = linear_quantiles(df, cols, (0.25, 0.5, 0.75))
    out = []
    for c in cols:
        low, mid, high = qs[c]
        iqr = None if low is None else (high - low) or 1.0
        out += [F.lit(mid).cast("double").alias(f"{_safe(c)}__median"), F.lit(iqr).cast("double").alias(f"{_safe(c)}__iqr")]
    return df.sparkSession.range(1).select(*out)


def robust_scale(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """M2 transform: ``(x - median) / IQR``."""
    stats = stats if stats is not None else robust_stats(df, cols)
    joined = attach_row(df, stats)
    scaled = {c: (F.col(c) - F.col(f"{_safe(c)}__median")) / F.col(f"{_safe(c)}__iqr") for c in cols}
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def describe(df: DataFrame, c: str, prefix: str = "") -> list[Column]:
    """Count, mean, sample std, min, 25/50/75 % (linear), max."""
    x = F.col(c)
    q = [F.lit(v).cast("double") for v in linear_quantiles(df, [c], (0.25, 0.5, 0.75))[c]]
    return [
        F.count(x).alias(f"{prefix}count"), F.avg(x).alias(f"{prefix}mean"), F.stddev_samp(x).alias(f"{prefix}std"),
        F.min(x).alias(f"{prefix}min"), q[0].alias(f"{prefix}p25"), q[1].alias(f"{prefix}p50"),
        q[2].alias(f"{prefix}p75"), F.max(x).alias(f"{prefix}max"),
    ]


def histogram(df: DataFrame, c: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max]; the max lands in the last bin."""
    rng = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    b = F.least(F.floor(F.coalesce(safe_div(F.col(c) - F.col("_lo"), width), F.lit(0.0)) * bins), F.lit(bins - 1))
    return (attach_row(df.where(F.col(c).isNotNull()), rng).groupBy(b.cast("bigint").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.first("_lo").alias("lo"), F.first("_hi").alias("hi"))
            .select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"), "n"))


def correlation_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A10: Pearson correlation for every pair, in one aggregate pass."""
    cols = list(cols)
    # upper triangle; the other half is the same, the diagonal is 1 where defined
    pairs = {(a, b): f"_c{i}_{j}" for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j}
    wide = df.agg(*[F.corr(a, b).alias(n) for (a, b), n in pairs.items()])
    rows = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(pairs.get((a, b)) or pairs[(b, a)]).alias("corr"))
            for a in cols for b in cols]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def missing_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column, rows that are NULL or NaN."""
    aggs = []
    for c in cols:
        miss = F.col(c).isNull()
        if dict(df.dtypes)[c] in ("double", "float"):
            miss = miss | F.isnan(c)
        aggs.append(F.count_if(miss).alias(f"_m{len(aggs)}"))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"_m{i}").alias("missing")) for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def nearest_rank_percentile(df: DataFrame, c: str, q: float = 0.95) -> DataFrame:
    """Element ⌊q·n⌋ (0-based) of the ascending values, i.e. the
    ``(k - 0.5)/n`` discrete percentile with k = ⌊q·n⌋ + 1, clamped to the
    last element."""
    return df.sparkSession.createDataFrame([(rank_quantile(df, c, q),)], "p double")


def linear_percentile(df: DataFrame, c: str, q: float = 0.95) -> DataFrame:
    """Linear-interpolation percentile (exact)."""
    return df.sparkSession.createDataFrame([(linear_quantiles(df, [c], (q,))[c][0],)], "p double")
