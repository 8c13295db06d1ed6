"""Exact quantiles without a task that holds all values, in two scans.

``percentile`` gathers every distinct value of a group in one task. Here the
first scan counts the rows and takes one ``percentile_approx`` sketch a column, a
grid of ``GRID`` steps whose rank error is at most one in ``accuracy``; it gives
the brackets of all quantiles. The second scan counts rows per distinct value
inside a bracket and per gap between brackets, so the running sum of these counts
is the rank in the whole column. Only scalars reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .ordering import running_sum

ACCURACY = 1000
GRID = 500


def _value(c: str):
    """Values that count: NULL and NaN do not."""
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def _brackets(grid: Sequence[float], n: int, ranks: Sequence[int], step: float) -> list[list[float]]:
    """Disjoint intervals of values, ascending, that hold the ranks."""
    out: list[list[float]] = []
    last = len(grid) - 1
    for r in sorted(ranks):
        p = (r + 0.5) / n
        low, high = math.floor((p - step) * last), math.ceil((p + step) * last)
        a = grid[low] if low > 0 else -math.inf
        b = grid[high] if high < last else math.inf
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _counts_and_values(df: DataFrame, cols: Sequence[str], wanted, accuracy: int) -> tuple[list[int], list[dict[int, float]]]:
    probe = df.select(*[_value(c).alias(f"v{i}") for i, c in enumerate(cols)])
    steps = F.array(*[F.lit(j / GRID) for j in range(GRID + 1)])
    first = probe.agg(*[F.count(f"v{i}") for i in range(len(cols))], *[F.percentile_approx(f"v{i}", steps, accuracy) for i in range(len(cols))]).first()
    counts, grids = list(first[: len(cols)]), first[len(cols) :]
    ranks = {i: sorted({r for r in wanted(n) if 0 <= r < n}) for i, n in enumerate(counts) if n}
    ranks = {i: rs for i, rs in ranks.items() if rs}
    values: list[dict[int, float]] = [{} for _ in cols]
    if not ranks:
        return counts, values
    placed = []
    for i, rs in ranks.items():
        v, part = F.col(f"v{i}"), F.lit(0)
        # even parts are gaps, odd ones brackets
        for a, b in _brackets(grids[i], counts[i], rs, 2.0 / accuracy):
            part = part + (v >= F.lit(a)).cast("int") + (v > F.lit(b)).cast("int")
        placed.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("k"), part.alias("part"), F.when(part % 2 == 1, v).alias("v"))))
    each = probe.select(F.explode(F.filter(F.array(*placed), lambda x: x.isNotNull())).alias("h"))
    per = materialise(each.groupBy("h.k", "h.part", "h.v").agg(F.count(F.lit(1)).alias("n")), "quantile-counts")
    upto = running_sum(per, "k", ["part", "v"], "n", "upto")
    asked = F.element_at(F.create_map(*[x for i, rs in ranks.items() for x in (F.lit(i), F.array(*[F.lit(r).cast("long") for r in rs]))]), F.col("k"))
    reached = upto.select("k", "part", "v", "upto", F.explode(asked).alias("r")).where(F.col("upto") > F.col("r"))
    for row in reached.groupBy("k", "r").agg(F.min(F.struct("part", "v")).alias("s")).collect():  # one row a rank
        if row["s"]["part"] % 2 == 0:
            raise ValueError(f"the bracket of rank {row['r']} of {cols[row['k']]} does not hold it")
        values[row["k"]][row["r"]] = row["s"]["v"]
    return counts, values


def values_at(df: DataFrame, cols: Sequence[str], wanted, accuracy: int = ACCURACY) -> dict[str, dict[int, float]]:
    """For every column the values at the ascending 0-based ranks that
    ``wanted(n)`` asks for, n being the column's count; {} without values."""
    return dict(zip(cols, _counts_and_values(df, cols, wanted, accuracy)[1], strict=True))


def linear_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between neighbouring values."""
    def wanted(n: int) -> list[int]:
        return [f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)]

    out = {}
    for c, n, at in zip(cols, *_counts_and_values(df, cols, wanted, ACCURACY), strict=True):
        places = [p * (n - 1) for p in probs]
        out[c] = [None if not n else at[math.floor(x)] + (at[math.ceil(x)] - at[math.floor(x)]) * (x - math.floor(x)) for x in places]
    return out


def rank_quantile(df: DataFrame, c: str, q: float) -> float | None:
    """Element floor(q * n), 0-based, of the ascending values."""
    got = values_at(df, [c], lambda n: [min(int(n * q), n - 1)])[c]
    return next(iter(got.values()), None)
