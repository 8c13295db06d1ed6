"""Scalar and windowed features.

All per-engine windows go through :func:`engine_windows` (bounded chunks with
a halo), all whole-engine values through partial aggregates; global values
(max cycle, first timestamp) are one-row aggregates broadcast by a cross
join — one row, so the broadcast size is fixed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exprs import attach_row, clamp, epoch_seconds, inf_to_null, safe_div
from ..schema import CYCLE, ENGINE, SensorSchema
from .ordering import DEFAULT_CHUNK_ROWS, KEYS, engine_windows, rows_back, with_keys

# Fixed values used by the reference's feature builders.
ROLLING_WINDOWS = (5, 10, 20)
ROLLING_STATS = ("mean", "std", "max", "min")
SHORT_WINDOW = 5
NORM_EPS = 1e-8
RATIO_EPS = 1e-8
RATIO_SENSORS = 10  # only the first ten sensors pair up
RATIO_REACH = 2  # each sensor pairs with the next two
CARRY_BLOCK = 4096  # chunks per block in the two-level forward-fill carry


def _stat(stat: str, x: Column, frame: WindowSpec) -> Column:
    if stat == "mean":
        return F.avg(x).over(frame)
    if stat == "std":
        return F.stddev_samp(x).over(frame)
    if stat == "max":
        return F.max(x).over(frame)
    if stat == "min":
        return F.min(x).over(frame)
    raise ValueError(stat)


def _skip_nan(s: str) -> Column:
    """NaN → NULL, so window aggregates skip it like pandas' rolling does."""
    return F.nanvl(F.col(s).cast("double"), F.lit(None).cast("double"))


def _difference(s: str, w: WindowSpec) -> Column:
    """Difference from the reading before; 0 where there is none or a side
    is missing (NULL or NaN)."""
    x = F.col(s).cast("double")
    return F.coalesce(F.nanvl(x - F.lag(x).over(w), F.lit(None).cast("double")), F.lit(0.0))


def rolling_columns(w: WindowSpec, sensors: Sequence[str], windows: Sequence[int] = ROLLING_WINDOWS,
                    stats: Sequence[str] = ROLLING_STATS) -> list[Column]:
    """``{sensor}_rolling_{stat}_{n}`` over the last n rows (min_periods 1,
    missing values skipped); empty or single-row std becomes 0 as in the
    reference's ``fillna(0)``."""
    cols = []
    for n in windows:
        frame = rows_back(w, n)
        for s in sensors:
            for st in stats:
                cols.append(F.coalesce(_stat(st, _skip_nan(s), frame), F.lit(0.0)).alias(f"{s}_rolling_{st}_{n}"))
    return cols


def add_rolling_features(df: DataFrame, sensors: Sequence[str] | None = None,
                         windows: Sequence[int] = ROLLING_WINDOWS, stats: Sequence[str] = ROLLING_STATS,
                         chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """W1–W4 for every sensor: all frames share one partition/order spec, so
    the whole family costs one exchange and one sort."""
    sensors = list(sensors or SensorSchema.of(df).sensors)
    return engine_windows(df, lambda w: rolling_columns(w, sensors, windows, stats),
                          halo=max(windows) - 1, chunk_rows=chunk_rows)


def add_degradation_features(df: DataFrame, sensors: Sequence[str] | None = None,
                             chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """F4 ``cycle_norm`` (min-max per engine, 1e-8 in the divisor), W8
    ``{s}_trend`` (difference from the engine's first reading) and W7
    ``{s}_diff`` (first difference, first row 0)."""
    sensors = list(sensors or SensorSchema.of(df).sensors)
    aggs = [F.min(CYCLE).alias("_cmin"), F.max(CYCLE).alias("_cmax")]
    aggs += [F.min_by(s, CYCLE).alias(f"_first_{s}") for s in sensors]
    out = engine_windows(
        df,
        lambda w: [_difference(s, w).alias(f"{s}_diff") for s in sensors],
        halo=1, engine_aggs=aggs, chunk_rows=chunk_rows,
    )
    cols = [c for c in out.columns if not c.startswith("_") and not c.endswith("_diff")]
    norm = ((F.col(CYCLE) - F.col("_cmin")) / (F.col("_cmax") - F.col("_cmin") + F.lit(NORM_EPS))).alias("cycle_norm")
    trends = [(F.col(s) - F.col(f"_first_{s}")).alias(f"{s}_trend") for s in sensors]
    diffs = [F.col(f"{s}_diff") for s in sensors]
    return out.select(*cols, norm, *trends, *diffs)


def cycle_transforms(cycle: str = CYCLE) -> list[Column]:
    """squared, sqrt, log1p and 1/(c+1)."""
    c = F.col(cycle)
    return [
        (c * c).alias("cycle_squared"),
        F.sqrt(c.cast("double")).alias("cycle_sqrt"),
        F.log1p(c.cast("double")).alias("cycle_log"),
        (F.lit(1.0) / (c + F.lit(1))).alias("cycle_inv"),
    ]


def add_global_cycle_norm(df: DataFrame, cycle: str = CYCLE, out: str = "cycle_norm") -> DataFrame:
    """cycle / global max cycle (one-row aggregate, broadcast)."""
    top = df.agg(F.max(cycle).alias("_gmax"))
    return attach_row(df, top).withColumn(out, safe_div(F.col(cycle).cast("double"), F.col("_gmax"))).drop("_gmax")


def ratio_pairs(sensors: Sequence[str]) -> list[tuple[str, str]]:
    """among the first ten sensors, each with the next two."""
    first = list(sensors)[:RATIO_SENSORS]
    return [(a, b) for i, a in enumerate(first) for b in first[i + 1:i + 1 + RATIO_REACH]]


def ratio_columns(sensors: Sequence[str]) -> list[Column]:
    return [safe_div(F.col(a), F.col(b) + F.lit(RATIO_EPS)).alias(f"{a}_{b}_ratio") for a, b in ratio_pairs(sensors)]


def setting_squares(settings: Sequence[str]) -> list[Column]:
    """F7."""
    return [(F.col(s) * F.col(s)).alias(f"{s}_squared") for s in settings]


def short_window_columns(w: WindowSpec, sensors: Sequence[str], n: int = SHORT_WINDOW) -> list[Column]:
    """W5 rolling mean/std (std NaN → 0), W6 deviation from the rolling mean,
    W7 rate of change (first row 0)."""
    cols = []
    frame = rows_back(w, n)
    for s in sensors:
        mean = F.avg(_skip_nan(s)).over(frame)
        cols += [
            mean.alias(f"{s}_rolling_mean"),
            F.coalesce(F.stddev_samp(_skip_nan(s)).over(frame), F.lit(0.0)).alias(f"{s}_rolling_std"),
            (F.col(s) - mean).alias(f"{s}_trend"),
            _difference(s, w).alias(f"{s}_rate"),
        ]
    return cols


def add_engine_features(df: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS, fill: bool = True) -> DataFrame:
    """The remaining-life feature builder: F1, F2, F3, F5, F6, F7, W5–W7 per
    engine (the reference's engine-boundary leak is not reproduced), then
    ±inf → missing → forward fill per engine → 0 (P6)."""
    schema = SensorSchema.of(df)
    sensors, settings = list(schema.sensors), list(schema.settings)
    top = df.agg(F.max(CYCLE).alias("_gmax"))
    out = engine_windows(
        df, lambda w: short_window_columns(w, sensors), halo=SHORT_WINDOW - 1,
        engine_aggs=[F.max(CYCLE).alias("_emax")], chunk_rows=chunk_rows,
    )
    out = attach_row(out, top)
    c = F.col(CYCLE)
    derived = (
        [safe_div(c.cast("double"), F.col("_gmax")).alias("cycle_norm")]
        + cycle_transforms()
        + [(F.col("_emax") - c).alias("remaining_cycles"),
           safe_div(c.cast("double"), F.col("_emax")).alias("cycle_ratio")]
        + ratio_columns(sensors)
        + setting_squares(settings)
    )
    base = [x for x in out.columns if not x.startswith("_")]
    out = out.select(*base, *derived)
    if not fill:
        return out
    fill_cols = [x for x in out.columns if x not in (ENGINE, CYCLE, "RUL") and dict(out.dtypes)[x] in ("double", "float")]
    return forward_fill(out, fill_cols, chunk_rows=chunk_rows, longest=df.agg(F.max(CYCLE)).first()[0] or 0)


def forward_fill(df: DataFrame, cols: Sequence[str], key: str = ENGINE, seq: str = CYCLE, default: float = 0.0,
                 chunk_rows: int = DEFAULT_CHUNK_ROWS, carry_block: int = CARRY_BLOCK,
                 longest: int | None = None) -> DataFrame:
    """±inf/NaN → missing → last seen value of the engine → ``default``.

    The carry can reach arbitrarily far back, so it is done in two bounded
    steps: inside each chunk a running ``last(ignorenulls)``; across chunks the
    last non-missing value of every earlier chunk, found on the small
    (engine, chunk) table and joined back on the chunk key. ``longest`` is the
    greatest position, if the caller knows it: with one chunk per engine there
    is no earlier chunk to carry from.
    """
    cols = list(cols)
    if not cols:
        return df
    clean = with_keys(df.select(*[inf_to_null(c).alias(c) if c in cols else F.col(c) for c in df.columns]), key)
    pos = F.col(seq) - 1
    staged = clean.withColumn("_chunk", F.floor(pos / F.lit(chunk_rows)).cast("bigint"))
    w = Window.partitionBy(*KEYS, "_chunk").orderBy(seq)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = staged.select("*", *[F.last(c, ignorenulls=True).over(running).alias(f"_in_{c}") for c in cols])
    if longest is not None and longest <= chunk_rows:
        return inner.select(*[F.coalesce(F.col(f"_in_{c}"), F.lit(default)).alias(c) if c in cols else F.col(c)
                              for c in df.columns])
    # last non-missing value per chunk, then carried over earlier chunks in two
    # levels (chunks inside a block of CARRY_BLOCK chunks, then earlier blocks),
    # so no window sees more than CARRY_BLOCK rows of one engine
    per_chunk = staged.groupBy(*KEYS, "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_end_{c}") for c in cols]
    ).withColumn("_block", F.floor(F.col("_chunk") / carry_block).cast("bigint"))
    in_block = Window.partitionBy(*KEYS, "_block").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_chunk.groupBy(*KEYS, "_block").agg(
        *[F.max_by(f"_end_{c}", F.when(F.col(f"_end_{c}").isNotNull(), F.col("_chunk"))).alias(f"_bend_{c}")
          for c in cols])
    earlier = Window.partitionBy(*KEYS).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    block_carry = per_block.select(*KEYS, "_block", *[F.last(f"_bend_{c}", ignorenulls=True).over(earlier)
                                                      .alias(f"_bc_{c}") for c in cols])
    carry = per_chunk.select(*KEYS, "_chunk", "_block", *[F.last(f"_end_{c}", ignorenulls=True).over(in_block)
                                                           .alias(f"_cc_{c}") for c in cols])
    carry = carry.join(block_carry, [*KEYS, "_block"], "left").select(
        *KEYS, "_chunk", *[F.coalesce(f"_cc_{c}", f"_bc_{c}").alias(f"_carry_{c}") for c in cols])
    joined = inner.join(carry, [*KEYS, "_chunk"], "left")
    filled = [F.coalesce(F.col(c), F.col(f"_in_{c}"), F.col(f"_carry_{c}"), F.lit(default)).alias(c) if c in cols else F.col(c)
              for c in df.columns]
    return joined.select(*filled)


def sequence_windows(df: DataFrame, features: Sequence[str], length: int = 50, target: str = "RUL",
                     chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Sliding fixed-length sequences per engine (default 50; the
    reference's preparation asks for 30), one per end row; the target is the end
    row's target; engines shorter than ``length`` give none."""
    step = F.struct(*[F.col(c).cast("double").alias(c) for c in features])
    out = engine_windows(
        df,
        lambda w: [F.collect_list(step).over(rows_back(w, length)).alias("steps")],
        halo=length - 1, chunk_rows=chunk_rows,
    )
    return out.where(F.size("steps") == length).select(
        ENGINE, (F.col(CYCLE) - F.lit(length - 1)).alias("start_cycle"), F.col(CYCLE).alias("end_cycle"),
        "steps", F.col(target).alias("target"),
    )


def completion_percent(df: DataFrame, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Position inside the engine / engine length · 100."""
    from .ordering import engine_aggregates

    out = engine_aggregates(df, [F.count(F.lit(1)).alias("_n")], chunk_rows=chunk_rows)
    return out.withColumn("completion_percent", (F.col(CYCLE) - 1).cast("double") / F.col("_n") * 100.0).drop("_n")


def stream_time(df: DataFrame, ts: str = "ts", out: str = "stream_time") -> DataFrame:
    """W12 (batch form): seconds since the first reading of the table."""
    first = df.agg(F.min(epoch_seconds(ts)).alias("_t0"))
    return attach_row(df, first).withColumn(out, epoch_seconds(ts) - F.col("_t0")).drop("_t0")


def clip_score(score: Column | str, lo: float = 0.0, hi: float = 5.0) -> Column:
    """score clipped to [0, 5]."""
    return clamp(score, lo, hi)


def add_preprocessing_features(df: DataFrame, sensors: Sequence[str] | None = None,
                               windows: Sequence[int] = ROLLING_WINDOWS,
                               chunk_rows: int = DEFAULT_CHUNK_ROWS,
                               healthy_threshold: float | None = None) -> DataFrame:
    """W1–W4 rolling statistics, F4 ``cycle_norm``, W8 trends and W7
    differences in one pass: every frame shares the chunk window, so the
    whole family costs one exchange and one sort.

    With ``healthy_threshold`` the same pass also yields L1 ``RUL``, the
    engine's ``max_rul`` (= max cycle − min cycle) and the L2 label."""
    sensors = list(sensors or SensorSchema.of(df).sensors)
    aggs = [F.min(CYCLE).alias("_cmin"), F.max(CYCLE).alias("_cmax")]
    aggs += [F.min_by(s, CYCLE).alias(f"_first_{s}") for s in sensors]

    def cols(w: WindowSpec) -> list[Column]:
        return rolling_columns(w, sensors, windows) + [
            _difference(s, w).alias(f"{s}_diff") for s in sensors]

    out = engine_windows(df, cols, halo=max(windows) - 1, engine_aggs=aggs, chunk_rows=chunk_rows)
    keep = [c for c in out.columns if not c.startswith("_") and not c.endswith("_diff")]
    norm = ((F.col(CYCLE) - F.col("_cmin")) / (F.col("_cmax") - F.col("_cmin") + F.lit(NORM_EPS))).alias("cycle_norm")
    trends = [(F.col(s) - F.col(f"_first_{s}")).alias(f"{s}_trend") for s in sensors]
    extra = []
    if healthy_threshold is not None:
        rul = F.col("_cmax") - F.col(CYCLE)
        max_rul = F.col("_cmax") - F.col("_cmin")
        flag = F.coalesce(safe_div(rul.cast("double"), max_rul.cast("double")) < F.lit(1 - healthy_threshold), F.lit(False))
        extra = [rul.alias("RUL"), max_rul.alias("max_rul"), flag.cast("int").alias("is_anomaly")]
    return out.select(*keep, *extra, norm, *trends, *[F.col(f"{s}_diff") for s in sensors])
