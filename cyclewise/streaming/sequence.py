"""Per-engine operators on streams whose readings arrive in any order (T6, T7,
T9), on ``transformWithStateInPandas``.

Readings of an engine are numbered 1, 2, 3 ... by their cycle. A reading whose
predecessors have all been seen is released at once; one that comes early waits
in a list state. What is missing is given up when the watermark passes the
waiting readings: an event-time timer then releases them in cycle order. So the
results do not depend on how the input is cut into files, tasks and
micro-batches as long as no reading is later than the watermark allows (those
Spark drops), and equal the batch operators.

Chunks of an engine's rows are worked on as they come, as arrays; no engine's
batch is held as a whole, only its early readings. State per engine: the next
cycle, a carry of fixed size (a step's own), the early readings. Most engines
have few readings a micro-batch, so what counts is the cost of an engine: rows
wait and leave in runs, one state entry and one output row for many readings,
which Spark takes apart again. Where ``expire`` is given, an
engine without any reading for so long loses its state by a timer; readings that
come later still wait for a cycle that is gone and leave with the watermark.

A cycle that was released before counts as delivered twice and is left out.
Readings without an engine or cycle have no place in any sequence and are left
out; one without an event time waits no longer than any other.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.features import ROLLING_STATS, ROLLING_WINDOWS
from ..schema import CYCLE, ENGINE

IDLE_SECONDS = 60
MAX_CONSECUTIVE_ERRORS = 5
#: event time in milliseconds, beside the rows (Spark renames a leading underscore)
MILLIS = "event_ms"
#: rows that are released at once from the waiting ones
CHUNK = 10_000

#: rows as one array per column
Rows = dict[str, np.ndarray]
Step = Callable[[tuple | None, Rows], tuple[tuple, Rows]]


class InSequence(StatefulProcessor):
    """Applies ``step(carry, rows)`` to each engine's readings in cycle order.
    What a step gives (columns ``out``) leaves as one row, see :func:`packed`."""

    def __init__(self, row_schema: T.StructType, carry_schema: T.StructType, step: Step, out: T.StructType, expire_ms: int = 0,
                 silence: Callable[[tuple], tuple[tuple, Rows] | None] | None = None, silence_ms: int = 0):
        self.row_schema, self.carry_schema, self.step, self.out = row_schema, carry_schema, step, out
        self.expire_ms, self.silence, self.silence_ms = expire_ms, silence, silence_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, newest long, waiting boolean")
        self.carry = handle.getValueState("carry", self.carry_schema)
        self.early = handle.getListState("early", T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in self.row_schema.fields]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, iter(()), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def _advance(self, key, chunks: Iterator[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        at, newest, stored = self.place.get() or (1, 0, False)
        carry = self.carry.get()

        def release(ready: Rows):
            nonlocal carry, at
            for k in range(0, len(ready[CYCLE]), CHUNK):
                part = {c: v[k : k + CHUNK] for c, v in ready.items()}
                carry, out = self.step(carry, part)
                at = int(part[CYCLE][-1]) + 1
                yield from packed(key[0], out, self.out)

        fresh: list[Rows] = []
        for chunk in chunks:
            rows = {f.name: column(chunk[f.name].to_numpy(), f.dataType) for f in self.row_schema.fields}
            newest = max(newest, int(rows[MILLIS].max()))
            ready, rest = run_of(in_order(rows, at), at)
            yield from release(ready)
            if len(rest[CYCLE]):
                fresh.append(rest)
        waiting = bool(stored or fresh)
        if waiting:
            parts = [{f.name: column(v, f.dataType) for f, v in zip(self.row_schema.fields, run, strict=True)} for run in (self.early.get() if stored else ())]
            every = in_order({f.name: np.concatenate([p[f.name] for p in (*parts, *fresh)]) for f in self.row_schema.fields})
            left = {c: v[every[CYCLE] >= at] for c, v in every.items()}
            # what the watermark has passed cannot be preceded any more, nor what leads up to it
            passed = np.flatnonzero(left[MILLIS] <= watermark)
            sure = int(passed[-1]) + 1 if len(passed) else 0
            yield from release({c: v[:sure] for c, v in left.items()})
            ready, left = run_of({c: v[sure:] for c, v in left.items()}, at)
            yield from release(ready)
            waiting = len(left[CYCLE]) > 0
            if len(left[CYCLE]) < len(every[CYCLE]):
                self.early.put([plain(left)]) if waiting else self.early.clear() if stored else None
            elif fresh:
                self.early.appendList([plain(rows) for rows in fresh])
            if waiting and (fresh or sure):
                self.handle.registerTimer(int(left[MILLIS].min()) + 1)
        if carry is not None and self.silence and watermark >= newest + self.silence_ms and not waiting:
            told = self.silence(carry)
            if told:
                carry, out = told
                yield from packed(key[0], out, self.out)
        if self.expire_ms and watermark >= newest + self.expire_ms and not waiting:
            for state in (self.place, self.carry):
                if state.exists():
                    state.clear()
            return
        self.place.update((at, newest, waiting))
        if carry is not None:
            self.carry.update(carry)
        for wait in (self.silence_ms if self.silence else 0, self.expire_ms):
            if wait and newest + wait > watermark:
                self.handle.registerTimer(newest + wait)


def column(values, kind: T.DataType) -> np.ndarray:
    """Values of a data frame or of the state as an array: NaN for missing
    doubles, None for other missing values."""
    if isinstance(kind, T.DoubleType):
        return np.asarray(values, float)
    if isinstance(values, np.ndarray) and values.dtype.kind in "ib":
        return values
    if isinstance(kind, T.IntegralType):
        # integers beside missing ones come as floating-point numbers
        values = [None if v is None or v != v else int(v) for v in values]
        return np.array(values, object if None in values else "int64")
    out = np.empty(len(values), object)
    out[:] = [None if v is None or v != v else v for v in values]
    return out


def in_order(rows: Rows, at: int | None = None) -> Rows:
    """By cycle, each once, the first that came; none before ``at``."""
    order = np.argsort(rows[CYCLE], kind="stable")
    cycles = rows[CYCLE][order]
    keep = np.concatenate([[True], cycles[1:] != cycles[:-1]])
    order = order[keep if at is None else keep & (cycles >= at)]
    return {c: v[order] for c, v in rows.items()}


def run_of(rows: Rows, at: int) -> tuple[Rows, Rows]:
    """The rows (sorted, distinct, none before ``at``) that follow each other
    from ``at`` on, and the others that are still to come."""
    same = rows[CYCLE] == at + np.arange(len(rows[CYCLE]))
    n = len(same) if same.all() else int(np.argmin(same))
    return {c: v[:n] for c, v in rows.items()}, {c: v[n:] for c, v in rows.items()}


def plain(rows: Rows) -> tuple:
    """Rows as one state entry: a list per column."""
    return tuple(v.tolist() for v in rows.values())


def _kinds(out: T.StructType) -> dict[T.DataType, list[str]]:
    kinds: dict[T.DataType, list[str]] = {}
    for f in out.fields:
        kinds.setdefault(f.dataType, []).append(f.name)
    return kinds


def packed_schema(engine: T.StructField, out: T.StructType) -> T.StructType:
    arrays = [T.StructField(f"values_{k}", T.ArrayType(kind)) for k, kind in enumerate(_kinds(out))]
    return T.StructType([engine, T.StructField("n", T.IntegerType()), *arrays])


def packed(engine, rows: Rows, out: T.StructType) -> Iterator[pd.DataFrame]:
    """``rows`` (none: nothing) as a data frame of one row, for which a worker
    pays by column and not by reading: the columns of a type follow each other
    in one array."""
    n = len(rows[out.fields[0].name])
    if n:
        arrays = [np.concatenate([rows[c] for c in names]) for names in _kinds(out).values()]
        yield pd.DataFrame({ENGINE: [engine], "n": [n], **{f"values_{k}": [v] for k, v in enumerate(arrays)}})


def unpacked(df: DataFrame, out: T.StructType) -> DataFrame:
    """The rows that :func:`packed` has put together."""
    each = df.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    found = {}
    for k, (kind, names) in enumerate(_kinds(out).items()):
        for j, c in enumerate(names):
            v = F.get(f"values_{k}", F.lit(j) * F.col("n") + F.col("i"))
            # a missing double is a NaN in an array
            found[c] = F.when(~F.isnan(v), v) if isinstance(kind, T.DoubleType) else v
    return each.select(ENGINE, *(found[f.name].alias(f.name) for f in out.fields))


def in_sequence(readings: DataFrame, columns: Sequence[str], carry: T.StructType, step: Step, out: T.StructType, ts: str, watermark: str, expire: int | None = None, **silence) -> DataFrame:
    """``out`` rows of ``step`` over ``readings`` (a stream) in cycle order."""
    rows = readings.where(F.col(ENGINE).isNotNull() & F.col(CYCLE).isNotNull()).withWatermark(ts, watermark)
    named = dict.fromkeys([CYCLE, *columns])
    rows = rows.select(ENGINE, ts, *named, F.coalesce(F.unix_millis(F.col(ts).cast("timestamp")), F.lit(0)).alias(MILLIS))
    schema = T.StructType([rows.schema[c] for c in [*named, MILLIS]])
    processor = InSequence(schema, carry, step, out, 1000 * (expire or 0), **silence)
    done = rows.groupBy(ENGINE).transformWithStateInPandas(processor, packed_schema(rows.schema[ENGINE], out), "Append", "EventTime")
    return unpacked(done, out)


# ---------------------------------------------------------------- T6: staleness

STALE_SCHEMA = T.StructType([T.StructField(ENGINE, T.LongType()), T.StructField("last_seen", T.DoubleType()), T.StructField("issue", T.StringType())])


def _issue(limit_s: int) -> str:
    return f"No streaming activity in last {limit_s} seconds"


def staleness_events(readings: DataFrame, ts: str = "event_time", limit_s: int = IDLE_SECONDS, expire: int | None = None, *, watermark: str) -> DataFrame:
    """One event per silence of more than ``limit_s`` seconds of event time
    after a reading, told by the next reading or, when none comes, by a timer
    once the watermark says that none will. :func:`open_silences` adds what is
    silent when a stream stands still. Carry: the time of the last reading."""

    def step(carry, rows):
        t = rows["timestamp"]
        before = np.concatenate([[np.nan if carry is None or carry[1] else carry[0]], np.maximum.accumulate(t)[:-1]])
        if carry is not None:
            before[1:] = np.maximum(before[1:], carry[0])
        last = float(max(t.max(), t[0] if carry is None else carry[0]))
        silent = before[t - before > limit_s]
        return (last, False), told(silent)

    def told(silent):
        return {"last_seen": np.asarray(silent, float), "issue": np.full(len(silent), _issue(limit_s), object)}

    def silence(carry):
        return None if carry[1] else ((carry[0], True), told([carry[0]]))

    carry = T.StructType([T.StructField("last", T.DoubleType()), T.StructField("told", T.BooleanType())])
    return in_sequence(readings, ["timestamp"], carry, step, T.StructType(STALE_SCHEMA.fields[1:]), ts, watermark, expire, silence=silence, silence_ms=1000 * limit_s + 1)


def open_silences(spark: SparkSession, checkpoint: str, now: float, limit_s: int = IDLE_SECONDS) -> DataFrame:
    """T6 / R9 while a stream stands still: engines whose last reading, as the
    state of the stream that wrote ``checkpoint`` knows it, is more than
    ``limit_s`` seconds before ``now`` and that no timer has told of."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "carry").load()
    state = state.select(F.col(f"key.{ENGINE}").alias(ENGINE), F.col("value.last").alias("last_seen"), F.col("value.told").alias("told"))
    # whole milliseconds, as timers count
    late = F.floor(F.lit(now) * 1000) > F.floor(F.col("last_seen") * 1000) + 1000 * limit_s
    return state.where(~F.col("told") & late).select(ENGINE, "last_seen", F.lit(_issue(limit_s)).alias("issue"))


# ---------------------------------------------------------------- T7: error-run guard


def guard_schema(columns: T.StructType) -> T.StructType:
    return T.StructType([*columns.fields, T.StructField("delivered", T.BooleanType())])


def error_run_guard(readings: DataFrame, columns: Sequence[str] = ("event_id", "is_valid"), max_errors: int = MAX_CONSECUTIVE_ERRORS, flag: str = "is_valid", ts: str = "event_time", expire: int | None = None, *, watermark: str) -> DataFrame:
    """Stop an engine after more than ``max_errors`` consecutive invalid
    readings (a valid one resets the count). Every reading comes out with its
    ``columns`` and ``delivered``: valid, and the engine still live. Carry: the
    length of the run and whether the engine is stopped."""
    names = [CYCLE, *(c for c in columns if c != CYCLE)]

    def step(carry, rows):
        run, stopped = carry or (0, False)
        ok = rows[flag].astype(bool)
        place = np.arange(1, len(ok) + 1)
        # invalid readings since the last valid one, which may lie before this chunk
        runs = np.where(ok, 0, place - np.maximum.accumulate(np.where(ok, place, -run)))
        over = np.logical_or.accumulate(runs > max_errors) | stopped
        return (int(runs[-1]), bool(over[-1])), {**{c: rows[c] for c in names}, "delivered": ok & ~over}

    carry = T.StructType([T.StructField("run", T.LongType()), T.StructField("stopped", T.BooleanType())])
    out = guard_schema(T.StructType([readings.schema[c] for c in names]))
    return in_sequence(readings, [*names, flag], carry, step, out, ts, watermark, expire)


# ---------------------------------------------------------------- T9: rolling features


def rolling_schema(sensors: Sequence[str], windows=ROLLING_WINDOWS, stats=ROLLING_STATS) -> T.StructType:
    names = [f"{s}_rolling_{st}_{n}" for n in windows for s in sensors for st in stats]
    names += [f"{s}_{k}" for k in ("trend", "diff") for s in sensors]
    return T.StructType([T.StructField(ENGINE, T.LongType()), T.StructField(CYCLE, T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names)])


def window_stats(values: np.ndarray, n: int, last: int) -> dict[str, np.ndarray]:
    """Trailing-window mean / sample std / max / min with min_periods 1 at the
    ``last`` rows (NaN = missing, skipped), each column by itself; std of fewer
    than two values is 0, the others of none are 0."""
    reach = values[-(last + n - 1) :]
    lead = np.full((last + n - 1 - len(reach), values.shape[1]), np.nan)
    win = np.lib.stride_tricks.sliding_window_view(np.concatenate([lead, reach]), n, axis=0)
    valid = ~np.isnan(win)
    cnt = valid.sum(axis=-1)
    some = cnt > 0
    mean = np.where(valid, win, 0.0).sum(axis=-1) / np.maximum(cnt, 1)
    dev = np.where(valid, win - mean[..., None], 0.0)
    std = np.where(cnt > 1, np.sqrt((dev * dev).sum(axis=-1) / np.maximum(cnt - 1, 1)), 0.0)
    high, low = np.where(valid, win, -np.inf).max(axis=-1), np.where(valid, win, np.inf).min(axis=-1)
    return {"mean": np.where(some, mean, 0.0), "std": std, "max": np.where(some, high, 0.0), "min": np.where(some, low, 0.0)}


def rolling_stream(readings: DataFrame, sensors: Sequence[str], windows=ROLLING_WINDOWS, ts: str = "event_time", expire: int | None = None, *, watermark: str) -> DataFrame:
    """W1–W4, W7 and W8 on a stream. Carry: the last ``max(windows) - 1``
    values and the first value of each sensor, so that each reading comes out
    as the batch windows give it."""
    sensors, keep = list(sensors), max(windows) - 1
    out = rolling_schema(sensors, windows)

    def step(carry, rows):
        new = np.column_stack([rows[s] for s in sensors])
        if carry is None:
            tail, first = new[:0], new[0]
        else:
            tail = np.column_stack([np.array(list(t), float) for t in carry[: len(sensors)]])
            first = np.array(carry[len(sensors) :], float)
        full = np.concatenate([tail, new])
        got = {CYCLE: rows[CYCLE]}
        for n in windows:
            for st, v in window_stats(full, n, len(new)).items():
                got |= {f"{s}_rolling_{st}_{n}": v[:, k] for k, s in enumerate(sensors)}
        diff = np.diff(full, axis=0, prepend=np.nan)[len(tail) :]
        diff = np.where(np.isnan(diff), 0.0, diff)
        got |= {f"{s}_{kind}": v[:, k] for kind, v in (("trend", new - first), ("diff", diff)) for k, s in enumerate(sensors)}
        return (*full[-keep:].T.tolist(), *first.tolist()), got

    carry = T.StructType([*(T.StructField(f"tail_{s}", T.ArrayType(T.DoubleType())) for s in sensors), *(T.StructField(f"first_{s}", T.DoubleType()) for s in sensors)])
    return in_sequence(readings, sensors, carry, step, T.StructType(out.fields[1:]), ts, watermark, expire)


# Stateful functions run in Python workers; ship this module's code with them
# so executors do not need the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
