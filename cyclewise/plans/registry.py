"""Registered queries: each is a Spark builder plus (when SQL can say it) the
equivalent DuckDB SQL, sharing one output spec so names, types and float
rounding agree on both sides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import out_double

# kind codes: l = BIGINT, d = DOUBLE rounded to 6 dp (dN: N dp, for values
# whose magnitude leaves fewer stable decimals), s = string, b = boolean,
# r = raw (left as built; only for rows-only queries)
KINDS = {"l", "d", "s", "b", "r"}


def parse_spec(spec: str) -> list[tuple[str, str]]:
    out = []
    for item in spec.split():
        name, kind = item.rsplit(":", 1)
        if kind[0] not in KINDS or (len(kind) > 1 and not (kind[0] == "d" and kind[1:].isdigit())):
            raise ValueError(f"bad kind {kind} for {name}")
        out.append((name, kind))
    return out


def _digits(kind: str) -> int:
    return int(kind[1:]) if len(kind) > 1 else 6


def conform(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for name, kind in parse_spec(spec):
        c = F.col(f"`{name}`")
        if kind == "l":
            cols.append(c.cast("bigint").alias(name))
        elif kind[0] == "d":
            cols.append(out_double(c, _digits(kind)).alias(name))
        elif kind == "s":
            cols.append(c.cast("string").alias(name))
        elif kind == "b":
            cols.append(c.cast("boolean").alias(name))
        else:
            cols.append(c.alias(name))
    return df.select(*cols)


def wrap_sql(inner: str, spec: str) -> str:
    cols = []
    for name, kind in parse_spec(spec):
        q = f'q."{name}"'
        if kind == "l":
            cols.append(f'CAST({q} AS BIGINT) AS "{name}"')
        elif kind[0] == "d":
            cols.append(f'round(CAST({q} AS DOUBLE), {_digits(kind)}) + 0.0 AS "{name}"')
        elif kind == "s":
            cols.append(f'CAST({q} AS VARCHAR) AS "{name}"')
        elif kind == "b":
            cols.append(f'CAST({q} AS BOOLEAN) AS "{name}"')
        else:
            cols.append(f'{q} AS "{name}"')
    return "SELECT " + ",\n       ".join(cols) + f"\nFROM (\n{inner.strip()}\n) AS q"


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    spec: str
    sql: str | None  # inner SQL; None = rows-only
    ops: tuple[str, ...]  # SURVEY §2 ids covered
    doc: str = ""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return conform(self.build(spark, sf_dir), self.spec)

    def oracle(self) -> str | None:
        return wrap_sql(self.sql, self.spec) if self.sql else None


REGISTRY: dict[str, Query] = {}


def register(name: str, spec: str, sql: str | None, ops: str):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, spec, sql, tuple(ops.split()), (fn.__doc__ or "").strip())
        return fn

    return deco
