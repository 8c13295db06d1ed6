"""Skew-safe per-engine ordering: the core primitive under every window
operator (SURVEY §2.5).

The reference works engine by engine. The naive Spark form,
``Window.partitionBy('engine_id')``, sends a whole engine to one task, so an
engine holding a third of all readings becomes one task holding a third of the
data. Here no step ever gathers an unbounded engine:

* :func:`number_rows` — ``row_number() over (partition by key order by …)``
  computed inside ``(key, bucket)`` groups, where sampled split points cut a
  hot key into row-balanced buckets, plus a running offset per bucket from a
  table of at most ``buckets + keys`` rows.
* :func:`engine_windows` — ROWS-frame windows of bounded reach evaluated over
  fixed-size chunks ``(key, (seq-1) div chunk_rows)``; the last ``halo`` rows
  of a chunk are copied into the next chunk so frames that reach back across
  the boundary stay exact, then the copies are dropped.
* Whole-engine values (max cycle, count, first reading) are partial
  aggregates over ``key`` (map-side combine, so a hot key costs one row per
  task) joined back on ``(key, chunk)`` — the same hash partitioning the
  chunk windows already use, so the big side is not shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CYCLE, ENGINE
from ..session import shuffle_partitions

# Rows per chunk. Bounded frames reach back at most a few dozen rows, so the
# halo overhead is halo/chunk_rows (< 0.1 %).
DEFAULT_CHUNK_ROWS = 65536
# Rows sampled (at most) to place split points for :func:`number_rows`.
DEFAULT_SAMPLE_ROWS = 100_000
# Split points per segment of the two-step bucket lookup.
SEGMENT = 64

_CHUNK = "_chunk"
_HALO = "_halo"
#: the key without NULL, and whether it was: joins on these lose no row, and
#: they keep the hash partitioning that a null-safe join condition would not
KEYS = ("_key", "_nokey")


def with_keys(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``KEYS``; rows with a NULL key are one group of their own."""
    stand_in = F.lit(0).cast(df.schema[key].dataType)
    return df.withColumns({KEYS[0]: F.coalesce(F.col(key), stand_in), KEYS[1]: F.col(key).isNull()})


def number_rows(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    out: str = CYCLE,
    buckets: int | None = None,
    sample_rows: int = DEFAULT_SAMPLE_ROWS,
    split_key: tuple | None = None,
) -> DataFrame:
    """Add ``out`` = 1-based position of each row within ``key`` by ``order``.

    ``order`` (column names) must be a total order inside a key (end with a
    unique id) so the numbering is repeatable. See :func:`running_sum`.
    """
    return running_sum(df, key, order, None, out, buckets, sample_rows, split_key)


def running_sum(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    weight: str | None,
    out: str,
    buckets: int | None = None,
    sample_rows: int = DEFAULT_SAMPLE_ROWS,
    split_key: tuple | None = None,
    segment: int = SEGMENT,
) -> DataFrame:
    """Running sum of ``weight`` (1 per row when ``None``) within ``key`` in
    ``order``, inclusive of the current row.

    Split points come from a bounded sample (at most ``sample_rows`` rows
    reach the driver) cut into ``buckets`` equal-row ranges; a key that spans
    split points is cut there. Each row's bucket is a pure function of its
    own values (a broadcast lookup of at most ``buckets`` split points), so a
    recomputed task lands every row in the same bucket. The sum runs inside
    ``(key, bucket)`` — groups of about ``rows / buckets`` — and is shifted by
    the total of the key's earlier buckets, taken from a table of
    ``keys + buckets`` rows. ``split_key`` names the input for memoising the
    split points across queries over the same source.

    A row's bucket is found in two steps — among every ``segment``-th split
    point of its key, then inside one segment — so a hot key with m split
    points costs about m / segment + segment comparisons per row, not m.
    """
    spark = df.sparkSession
    order = list(order)
    names = df.columns
    df = with_keys(df, key)
    n_buckets = buckets or shuffle_partitions(spark)
    bounds = _split_points(df, key, order, n_buckets, sample_rows, split_key)
    if bounds is None:
        staged = df.withColumn("_bucket", F.lit(0).cast("bigint"))
    else:
        here = F.struct(*[F.col(c) for c in order])
        staged = (
            df.join(F.broadcast(_with_coarse(bounds, segment)), list(KEYS), "left")
            .withColumn("_bucket", F.coalesce(_bucket_of(here, segment), F.lit(0)).cast("bigint"))
            .drop("_bounds", "_coarse")
        )
    w = F.col(weight) if weight else F.lit(1)
    local = Window.partitionBy(*KEYS, "_bucket").orderBy(*order)
    if weight:
        local = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = F.sum(w).over(local)
    else:
        inside = F.row_number().over(local)
    summed = staged.withColumn("_in", inside)
    sizes = staged.groupBy(*KEYS, "_bucket").agg(F.sum(w).alias("_tot"))
    before = Window.partitionBy(*KEYS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*KEYS, "_bucket", F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_offset"))
    return (
        summed.join(offsets, [*KEYS, "_bucket"])
        .withColumn(out, (F.col("_in") + F.col("_offset")).cast("bigint" if not weight else "double"))
        .select(*[c for c in names if c != out], out)
    )


def _with_coarse(bounds: DataFrame, segment: int) -> DataFrame:
    """Add ``_coarse``: every ``segment``-th split point (first one included)."""
    n = F.size("_bounds")
    idx = F.sequence(F.lit(0), F.floor((n - 1) / segment).cast("int"))
    return bounds.withColumn("_coarse", F.transform(idx, lambda i: F.element_at("_bounds", i * segment + 1)))


def _bucket_of(here, segment: int):
    """Number of the key's split points ≤ ``here`` (the bucket), by a coarse
    count over ``_coarse`` and a fine count inside one segment."""
    c = F.size(F.filter("_coarse", lambda b: b <= here))
    start = (c - 1) * segment
    fine = F.size(F.filter(F.slice("_bounds", F.greatest(start, F.lit(0)) + 1, F.lit(segment)), lambda b: b <= here))
    return F.when(c == 0, F.lit(0)).otherwise(start + fine)


_SPLITS: dict = {}


def _split_points(df: DataFrame, key: str, order: list[str], n_buckets: int, sample_rows: int,
                  split_key: tuple | None = None) -> DataFrame | None:
    """Per key (as ``KEYS``), the sorted split points (structs of ``order``) that fall inside
    it; ``None`` when nothing needs splitting.

    Split points only steer balance — any set gives the same numbering — so
    they are memoised per (session, input plan) and reused by later queries
    over the same input."""
    if n_buckets <= 1:
        return None
    source = split_key if split_key is not None else df.semanticHash()
    memo = (df.sparkSession.sparkContext.applicationId, source, key, tuple(order), n_buckets, sample_rows)
    if memo not in _SPLITS:
        _SPLITS[memo] = _sample_split_points(df, key, order, n_buckets, sample_rows)
    return _SPLITS[memo]


def _sample_split_points(df: DataFrame, key: str, order: list[str], n_buckets: int, sample_rows: int):
    cols = [*KEYS, *order]
    total = df.count()
    if total <= n_buckets:
        return None
    fraction = min(1.0, sample_rows / total)
    sample = df.select(*cols).sample(False, fraction, seed=7).collect()
    if len(sample) < 2:
        return None
    sample.sort(key=lambda r: tuple((v is None, v) for v in r))
    step = len(sample) / n_buckets
    picks = sorted({int(i * step) for i in range(1, n_buckets)} - {0})
    points = [sample[i] for i in picks if 0 < i < len(sample)]
    if not points:
        return None
    fields = {f.name: f for f in df.schema.fields}
    schema = T.StructType([fields[c] for c in cols])
    pts = spark_rows(df.sparkSession, points, schema)
    return pts.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order]))).alias("_bounds")
    )


def spark_rows(spark, rows, schema):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def with_positions(df: DataFrame, key: str = ENGINE, order: Sequence[str] = (CYCLE,), out: str = "_pos") -> DataFrame:
    """Dense 1-based positions for a table whose ``cycle`` may have gaps or
    duplicates (e.g. files read with S1). Ties are broken by a hash of the
    whole row, so the numbering is repeatable (equal rows are
    interchangeable)."""
    tie = F.xxhash64(*[F.col(c) for c in df.columns])
    staged = df.withColumn("_tie", tie)
    return number_rows(staged, key, list(order) + ["_tie"], out=out).drop("_tie")


def chunk_window(seq: str = CYCLE) -> WindowSpec:
    """Window over one bounded chunk of one engine, ordered by position."""
    return Window.partitionBy(*KEYS, _CHUNK).orderBy(seq)


def rows_back(w: WindowSpec, n: int) -> WindowSpec:
    """ROWS BETWEEN n-1 PRECEDING AND CURRENT ROW (pandas ``rolling(n, min_periods=1)``)."""
    return w.rowsBetween(-(n - 1), Window.currentRow)


def engine_windows(
    df: DataFrame,
    window_cols: Callable[[WindowSpec], list[Column]] | None = None,
    *,
    key: str = ENGINE,
    seq: str = CYCLE,
    halo: int = 0,
    engine_aggs: Sequence[Column] = (),
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
    dense: bool = True,
) -> DataFrame:
    """Evaluate bounded per-engine windows and whole-engine aggregates.

    ``window_cols(w)`` returns aliased window expressions over ``w`` (ordered by
    ``seq`` inside the engine); none of them may look back more than ``halo``
    rows or forward at all. ``engine_aggs`` are aliased aggregate expressions
    over the whole engine; their values are attached to every row.
    ``seq`` must be the dense 1-based position (see :func:`number_rows`);
    with ``dense=False`` positions are derived first (:func:`with_positions`).
    """
    if halo >= chunk_rows:
        raise ValueError("halo must be smaller than chunk_rows")
    if not dense:
        pos = with_positions(df, key, [seq])
        out = engine_windows(pos, window_cols, key=key, seq="_pos", halo=halo, engine_aggs=engine_aggs,
                             chunk_rows=chunk_rows)
        return out.drop("_pos")
    base_cols = [*df.columns, *KEYS]
    df = with_keys(df, key)
    pos = F.col(seq) - 1
    chunk = F.floor(pos / F.lit(chunk_rows)).cast("bigint")
    own = F.struct(chunk.alias("c"), F.lit(False).alias("h"))
    if halo > 0:
        tail = F.pmod(pos, F.lit(chunk_rows)) >= F.lit(chunk_rows - halo)
        copies = F.when(tail, F.array(own, F.struct((chunk + 1).alias("c"), F.lit(True).alias("h")))).otherwise(
            F.array(own)
        )
        staged = df.select("*", F.explode(copies).alias("_ch"))
    else:
        staged = df.select("*", own.alias("_ch"))
    staged = staged.select(*base_cols, F.col("_ch.c").alias(_CHUNK), F.col("_ch.h").alias(_HALO))

    w = chunk_window(seq)
    extra = window_cols(w) if window_cols else []
    out = staged.select("*", *extra) if extra else staged

    if engine_aggs:
        per_engine = df.groupBy(*KEYS).agg(F.max(seq).alias("_max_seq"), *engine_aggs)
        per_chunk = per_engine.select(
            "*",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_max_seq") - 1) / F.lit(chunk_rows)).cast("bigint"))).alias(_CHUNK),
        ).drop("_max_seq")
        out = out.join(per_chunk, [*KEYS, _CHUNK], "left")

    return out.where(~F.col(_HALO)).drop(_CHUNK, _HALO, *KEYS)


def engine_aggregates(df: DataFrame, aggs: Sequence[Column], key: str = ENGINE, seq: str = CYCLE,
                      chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Attach whole-engine aggregates to each row (pandas ``transform``), via a
    partial aggregate and a join on ``(key, chunk)`` — never a whole-engine
    window."""
    return engine_windows(df, None, key=key, seq=seq, halo=0, engine_aggs=aggs, chunk_rows=chunk_rows)
