"""Uniform sharding with exact shard sizes.

The table's partitions send rows to shards. How many rows partition p sends to
shard s is not left to chance per row: the whole matrix is one draw from the
multivariate hypergeometric law whose row sums are the partitions' counts and
whose column sums are the wanted sizes, which is the law of a uniform shuffle.
Then rows are permuted within partitions, exchanged, and permuted again.

* ``rows`` law: the sizes of the shards differ by one at most.
* A shard is cut into blocks of at most ``block_rows`` rows, and the matrix has
  a column per block; so the second permutation never holds a whole shard, and
  the slot of a row is the block's offset (known beforehand) plus its place in
  the block.
* No matrix is held anywhere. The partitions are halved again and again; at
  each node of that tree the counts of the left half are one hypergeometric
  draw from the node's column counts, with the node's own seed. Each task walks
  from the root to its leaf and gets its row of the matrix: about log2(partitions)
  draws per block column. All that is shared is one count per partition.
* The draws and both orders depend on seed, partition and row contents only, so
  a task that runs again after a lost executor sends the same rows to the same
  places. A partition that does not hold the rows that were counted raises.

The input must be read from files or tables (partitions stay as they are
between the count and the exchange); ``stable=False`` writes it first.

Repeated rows are places like any other: equal rows may swap, which cannot be
seen. Null ids and texts are values like any other, an empty table gives none.
All columns come back; ``shard`` and ``slot`` replace columns of those names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, shuffle_partitions
from .common import bounded_batches


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without replacement. numpy's generator takes
    populations below 1e9; above, a ratio-of-uniforms rejection on the same law."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    n = good + bad
    if draws == n:
        return good
    if n < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    lg = math.lgamma
    low, high = max(0, draws - bad), min(good, draws)
    mode = int((draws + 1) * (good + 1) / (n + 2))
    mode = min(max(mode, low), high)

    def log_p(k: int) -> float:
        return -(lg(k + 1) + lg(good - k + 1) + lg(draws - k + 1) + lg(bad - draws + k + 1))

    mean = draws * good / n
    var = mean * (bad / n) * (n - draws) / (n - 1)
    # hat width of the ratio-of-uniforms method for unimodal discrete laws
    centre, width, top = mean + 0.5, 1.7155277699214135 * math.sqrt(var + 0.5) + 0.8989161620588988, log_p(mode)
    while True:
        u, v = rng.random(), rng.random()
        if u == 0:
            continue
        x = centre + width * (v - 0.5) / u
        if not low <= x < high + 1:
            continue
        k = int(x)
        if 2 * math.log(u) <= log_p(k) - top:
            return k


def split_counts(rng: np.random.Generator, columns: np.ndarray, draws: int) -> np.ndarray:
    """How many of each column fall among ``draws`` of all rows."""
    out = np.zeros_like(columns)
    rest = int(columns.sum())
    for j, c in enumerate(columns.tolist()):
        if draws == 0:
            break
        rest -= c
        out[j] = x = hypergeometric(rng, c, rest, draws)
        draws -= x
    return out


def matrix_row(counts: np.ndarray, columns: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the communication matrix: rows of partition p by column."""
    before = np.concatenate([[0], np.cumsum(counts)])
    low, high = 0, len(counts)
    while high - low > 1:
        mid = (low + high) // 2
        left = split_counts(np.random.default_rng([seed, low, high]), columns, int(before[mid] - before[low]))
        if p < mid:
            columns, high = left, mid
        else:
            columns, low = columns - left, mid
    return columns


def block_sizes(total: int, shards: int, block_rows: int) -> list[tuple[int, int, int]]:
    """(shard, offset in it, rows) of every block."""
    out = []
    for s in range(shards):
        size = total // shards + (s < total % shards)
        blocks = max(1, -(-size // block_rows))
        at = 0
        for b in range(blocks):
            rows = size // blocks + (b < size % blocks)
            out.append((s, at, rows))
            at += rows
    return out


def shuffle_shards(df: DataFrame, shards: int = 40, seed: int = 7, block_rows: int = 50_000, stable: bool = True) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0)."""
    spark = df.sparkSession
    if not stable:
        df = materialise(df, "shard-input")
    found = {r["p"]: r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    counts = np.array([found.get(p, 0) for p in range(max(found, default=-1) + 1)], np.int64)
    blocks = block_sizes(int(counts.sum()), shards, block_rows)
    shared = spark.sparkContext.broadcast((counts, np.array([b[2] for b in blocks], np.int64)))

    names = [c for c in df.columns if c not in ("shard", "slot")]
    row = F.struct(*names)
    keyed = df.select(row.alias("row"), F.xxhash64(F.lit(seed), row).alias("a"), F.xxhash64(F.lit(~seed), row).alias("b"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        n, sizes = shared.value
        at, to = 0, None
        for b in batches:
            if to is None:
                if p >= len(n):
                    raise RuntimeError("the partitions changed since they were counted: write the input first (stable=False)")
                to = np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(n, sizes, p, seed))
                np.random.default_rng([seed, p]).shuffle(to)
            if at + b.num_rows > len(to):
                raise RuntimeError("the partitions changed since they were counted: write the input first (stable=False)")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to[at : at + b.num_rows])], ["row", "b", "block"])
            at += b.num_rows
        if at != (n[p] if p < len(n) else 0):
            raise RuntimeError("the partitions changed since they were counted: write the input first (stable=False)")

    schema = T.StructType([T.StructField("row", keyed.schema["row"].dataType), T.StructField("b", T.LongType()), T.StructField("block", T.IntegerType())])
    sent = bounded_batches(keyed).sortWithinPartitions("a").select("row", "b").mapInArrow(send, schema)
    # blocks are few and even: hashing their numbers would put several into one task
    sent = sent.repartition(shuffle_partitions(spark), "block")
    place = F.row_number().over(Window.partitionBy("block").orderBy("b", F.xxhash64("row"))) - 1
    table = spark.createDataFrame([(i, s, at) for i, (s, at, _) in enumerate(blocks)], "block int, shard int, offset long")
    out = sent.withColumn("place", place).join(F.broadcast(table), "block")
    return out.select(*[F.col("row")[c].alias(c) for c in names], "shard", (F.col("offset") + F.col("place")).alias("slot"))
