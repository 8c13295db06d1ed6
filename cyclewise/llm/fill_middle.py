"""Fill-in-middle transformation by displacement scatter.

A text is cut into n lines (``[^\\n]*\\n|[^\\n]+``). Two draws between 0 and n,
taken from a hash of the row's id and ``seed``, say where the middle begins and
ends. ``psm`` puts ``<P>``prefix``<S>``suffix``<M>``middle, ``spm``
``<S>``suffix``<P>``prefix``<M>``middle; ``plain`` keeps the text, as do all
texts that are empty or hold one of the three marks.

All texts of a batch lie in one byte buffer. A scan finds newlines, hence cuts;
a difference array holds at each segment's first byte by how much its shift
differs from the shift before it, so that one cumulative sum gives every byte
its place in the output, and one scatter puts all bytes there. Restoring finds
the marks in the output, builds the same kind of array over the text and
gathers. Marks have no border with themselves or each other, so none can arise
where a segment meets a mark: the three that are found are the three put in.

Batches are worked on in slices of about ``SLICE`` bytes; a text longer than
that is a slice of its own and takes some 20 bytes of memory a byte. Whole
texts are used. Null text counts as empty; a null id counts as an empty one in
the hash. Rows are independent, so repeated rows give repeated results, and
rows of one id draw the same numbers. An empty table gives none. ``split``
carries only the id along and ``restore`` replaces a column of its output's
name, so no names can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, byte_slices

MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
P, S, M = (np.frombuffer(m.encode(), np.uint8) for m in MARKS.values())
FORMS = np.array(["plain", "psm", "spm"])
PLAIN, PSM, SPM = range(3)


def text_bytes(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins (and the last
    ends). Null counts as empty."""
    c = c.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1] if len(c) else np.zeros(1, np.int64)
    data = np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    return data, at - at[0]


def text_column(data: np.ndarray, at: np.ndarray) -> pa.Array:
    c = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data))
    return c.cast(pa.string())


def marks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where marks begin, in order, and the text each lies in."""
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i = np.flatnonzero(data == P[0])
    i = i[i < len(data) - 2]
    i = i[(data[i + 2] == P[2]) & np.isin(data[i + 1], [P[1], S[1], M[1]])]
    row = np.searchsorted(at, i, "right") - 1
    inside = i + 2 < at[row + 1]  # not across two texts
    return i[inside], row[inside]


def places(n: int, points: list[np.ndarray], shifts: list[np.ndarray]) -> np.ndarray:
    """For each of n bytes its own position plus the shift in force, where
    ``shifts[k]`` holds from ``points[k]`` to the next point of the row. Points
    may coincide: what is added there sums up to the last."""
    kind = np.int32 if n + max((int(s.max(initial=0)) for s in shifts), default=0) < 2**31 - 1 else np.int64
    step = np.ones(n + 1, kind)
    step[0] = 0
    before = np.zeros(len(points[0]), np.int64)
    for at, shift in zip(points, shifts, strict=True):
        np.add.at(step, at, (shift - before).astype(kind))
        before = shift
    # the next row's first point starts from no shift
    return np.cumsum(step, out=step, dtype=kind)[:n]


def scatter(data: np.ndarray, at: np.ndarray, draws: list[np.ndarray], rate: int, spm: int):
    """(n, form, prefix characters, middle characters, output bytes, output
    offsets) of the texts ``data[at[r] : at[r + 1]]``."""
    starts, ends = at[:-1], at[1:]
    cuts = np.flatnonzero(data == 10) + 1
    open_ = ends[(ends > starts) & (data[np.maximum(ends, 1) - 1] != 10)] if len(data) else ends[:0]
    cuts = np.sort(np.concatenate([cuts, open_]))
    first = np.searchsorted(cuts, starts, "right")
    n = np.searchsorted(cuts, ends, "right") - first

    def cut(k: np.ndarray) -> np.ndarray:
        return np.where(k > 0, np.append(cuts, 0)[first + k - 1], starts)

    one, two = draws[0] % (n + 1), draws[1] % (n + 1)
    p, q = cut(np.minimum(one, two)), cut(np.maximum(one, two))
    form = np.where(draws[3] % 100 < spm, SPM, PSM)
    form[(ends == starts) | (draws[2] % 100 >= rate)] = PLAIN
    form[marks(data, at)[1]] = PLAIN
    moved, ps = form != PLAIN, form == PSM

    to = np.concatenate([[0], np.cumsum(ends - starts + 9 * moved)])
    o, pre, mid, suf = to[:-1], p - starts, q - p, ends - q
    # where each segment's mark, if any, begins in the output
    at_p = np.where(ps, o, o + 3 + suf)
    at_s = np.where(ps, o + 3 + pre, o)
    at_m = o + 6 + pre + suf
    shift_p, shift_m, shift_s = (np.where(moved, m + 3, o + off) - src for m, off, src in ((at_p, 0, starts), (at_m, pre, p), (at_s, pre + mid, q)))
    place = places(len(data), [starts, p, q, ends], [shift_p, shift_m, shift_s, np.zeros(len(n), np.int64)])
    out = np.empty(to[-1], np.uint8)
    out[place] = data
    for m, where in ((P, at_p), (S, at_s), (M, at_m)):
        for k in range(3):
            out[where[moved] + k] = m[k]
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    return n, form, heads[p] - heads[starts], heads[q] - heads[p], out, to


def gather(data: np.ndarray, at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts that ``scatter`` made ``data`` of."""
    moved = np.flatnonzero(form != PLAIN)
    i, row = marks(data, at)
    i, row = i[form[row] != PLAIN], row[form[row] != PLAIN]
    if not np.array_equal(row, np.repeat(moved, 3)):
        raise ValueError("an output that is not plain holds other than three marks")
    one, two, three = (np.append(i, 0)[k : len(i) + k : 3] for k in range(3))
    ps = form[moved] == PSM
    a, end = at[:-1], at[1:]
    pre_at, suf_at, mid_at = a.copy(), end.copy(), end.copy()  # plain: all is prefix
    pre_end, suf_end = end.copy(), end.copy()
    pre_at[moved], pre_end[moved] = np.where(ps, one, two) + 3, np.where(ps, two, three)
    suf_at[moved], suf_end[moved] = np.where(ps, two, one) + 3, np.where(ps, three, two)
    mid_at[moved] = three + 3
    if not (np.array_equal(data[one + 1], np.where(ps, P[1], S[1])) and np.array_equal(data[two + 1], np.where(ps, S[1], P[1])) and (data[three + 1] == M[1]).all() and np.array_equal(one, a[moved])):
        raise ValueError("marks in another order than the form's")
    pre, mid, suf = pre_end - pre_at, end - mid_at, suf_end - suf_at
    to = np.concatenate([[0], np.cumsum(pre + mid + suf)])
    t = to[:-1]
    points = [t, t + pre, t + pre + mid, to[1:]]
    source = places(int(to[-1]), points, [pre_at - t, mid_at - points[1], suf_at - points[2], np.zeros(len(t), np.int64)])
    return data[source], to


def split(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """One row per row of ``df``: the id column, ``n`` (lines), ``form``,
    ``prefix_chars``, ``middle_chars`` (code points; null if plain) and
    ``output``. ``rate`` percent of rows are transformed, ``spm`` percent of
    those as spm. Draws are the first four 8-digit groups of the hexadecimal
    sha256 of ``seed``, a colon and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, 1):
                h = [b.column(2 + k).to_numpy() for k in range(4)]
                n, form, pre, mid, out, to = scatter(*text_bytes(b.column(1)), h, rate, spm)
                plain = form == PLAIN
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(FORMS[form], pa.string()), pa.array(pre, pa.int64(), mask=plain), pa.array(mid, pa.int64(), mask=plain), text_column(out, to)],
                    [id_col, "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    fields = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    schema = T.StructType([df.schema[id_col], *(T.StructField(*f) for f in fields)])
    # the id is cut off again by position, so it may be named like a draw
    return bounded_batches(df.select(F.col(id_col), F.col(text_col), *draws)).mapInArrow(run, schema)


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form", into: str = "restored") -> DataFrame:
    """All columns of ``df`` and ``into``: the text that ``output_col`` was made
    of, from it and its form alone."""
    kept = [c for c in df.columns if c != into]
    text_at, form_at = kept.index(output_col), kept.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, text_at):
                form = np.searchsorted(FORMS, np.array(b.column(form_at).to_pylist(), FORMS.dtype))
                back = text_column(*gather(*text_bytes(b.column(text_at)), form))
                yield pa.RecordBatch.from_arrays([*b.columns, back], [*kept, into])

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(into, T.StringType())])
    return bounded_batches(df.select(*kept)).mapInArrow(run, schema)
