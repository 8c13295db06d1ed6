"""Line dedup: which lines of which documents repeat elsewhere.

A line's key is the line without white space at its ends and with A-Z in lower
case. Keys of at least ``min_chars`` code points that occur in at least
``min_docs`` documents lose all their lines except in the largest id that
holds them (there, every occurrence stays).

1. One narrow row per eligible line: 128-bit key hash, document, position.
2. These rows are range-partitioned and sorted by (hash, document descending,
   position). The range key holds the document too, so a line that a third of
   all documents share is spread over many tasks.
3. Each task streams its sorted rows: the first document of a run of equal
   hashes is the one that keeps the line, and the rest go as soon as the fifth
   document is seen; at most four documents of one run wait in memory. A run
   that touches the edge of its range may go on in the next one, so its rows
   are handed on undecided with one summary per edge. Summaries number at most
   twice the partitions, which bounds what is broadcast to settle them.
4. Decisions come back as one compressed keep bitmap per document that loses
   lines (bit i: line i stays). Text is joined with them only by
   :func:`apply_bitmaps`.

Null and empty text is one empty line. A null id is a document smaller than
any other. Rows with equal id and equal text are one document with the same
result; rows with equal id but other text count as one document for a key, and
each has a bitmap of its own. An empty table gives an empty result. Documents
are known by hashes of id and text, all other columns ride along in a struct,
so extra columns cannot clash; ``n_lines`` and ``n_dropped`` replace columns of
those names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise, shuffle_partitions
from .common import ascii_lower, bounded_batches, text_key

WHITE = " \t\n\x0b\f\r"
DROP, OPEN, EDGE = 0, 1, 2
_STREAM = "kind int, h1 long, h2 long, dk long, th long, pos int, part int, n long, first_dk long, last_dk long"
_STREAM_ARROW = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("dk", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("first_dk", pa.int64()), ("last_dk", pa.int64())])


def _document(id_col: str, text_col: str) -> list:
    return [F.xxhash64(F.col(id_col)).alias("dk"), F.xxhash64(F.col(text_col)).alias("th")]


def line_rows(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, id, dk, th, pos) of the lines that are long enough."""
    rows = df.select(F.col(id_col).alias("id"), *_document(id_col, text_col), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    key = ascii_lower(F.btrim("line", F.lit(WHITE)))
    rows = rows.where(F.octet_length("line") >= min_chars).withColumn("line", key).where(F.char_length("line") >= min_chars)
    h1, h2 = text_key(F.col("line"), "line")
    return rows.select(h1.alias("h1"), h2.alias("h2"), "id", "dk", "th", "pos")


class _Run:
    """The run of equal hashes that the end of a batch has cut."""

    def __init__(self, key: tuple[int, int], is_first: bool):
        self.key, self.is_first = key, is_first
        self.first = self.last = None
        self.n = 0
        self.waiting: list[np.ndarray] = []


def _decide(min_docs: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        run: _Run | None = None

        def rows(kind: int, m: np.ndarray) -> pa.RecordBatch:
            n = m.shape[1]
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(np.ascontiguousarray(m[i])) for i in range(4)), pa.array(m[4].astype(np.int32)), pa.array(np.full(n, part, np.int32)), none, none, none], schema=_STREAM_ARROW)

        def edge(r: _Run) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([EDGE, *r.key, None, None, None, part, r.n, r.first, r.last], _STREAM_ARROW, strict=True)], schema=_STREAM_ARROW)

        def extend(r: _Run, m: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Rows of one run, a few or a whole batch of them."""
            dk = m[2]
            r.n += int((dk[1:] != dk[:-1]).sum()) + (r.last is None or int(dk[0]) != r.last)
            r.first = int(dk[0]) if r.first is None else r.first
            r.last = int(dk[-1])
            if r.is_first:
                yield rows(OPEN, m)
                return
            r.waiting.append(m)
            if r.n >= min_docs:
                for w in r.waiting:
                    if (w := w[:, w[2] != r.first]).shape[1]:
                        yield rows(DROP, w)
                r.waiting = []

        for b in batches:
            m = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            if not m.shape[1]:
                continue
            new = np.flatnonzero((m[0, 1:] != m[0, :-1]) | (m[1, 1:] != m[1, :-1])) + 1
            starts = np.concatenate([[0], new])
            head, tail = m[:, : new[0] if len(new) else m.shape[1]], None
            key = (int(m[0, 0]), int(m[1, 0]))
            if run is None or run.key != key:
                if run is not None and run.is_first:
                    yield edge(run)
                run = _Run(key, run is None)
            yield from extend(run, head)
            if not len(new):
                continue
            if run.is_first:
                yield edge(run)
            # runs that begin and end within this batch, all at once
            mid, tail = m[:, new[0] : new[-1]], m[:, new[-1] :]
            if mid.shape[1]:
                begin = starts[1:-1] - new[0]
                sizes = np.diff(np.append(begin, mid.shape[1]))
                fresh = np.concatenate([[True], mid[2, 1:] != mid[2, :-1]])
                fresh[begin] = True
                docs = np.add.reduceat(fresh.astype(np.int64), begin)
                gone = np.repeat(docs >= min_docs, sizes) & (mid[2] != np.repeat(mid[2][begin], sizes))
                if gone.any():
                    yield rows(DROP, mid[:, gone])
            run = _Run((int(tail[0, 0]), int(tail[1, 0])), False)
            yield from extend(run, tail)
        if run is not None:
            yield edge(run)
            for w in run.waiting:
                yield rows(OPEN, w)

    return stream


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(dk, th, keep): compressed keep bitmaps of the documents that lose
    lines, under the hashes of their id and text. Bits after the last stand for
    lines that stay."""
    spark = df.sparkSession
    order = ["h1", "h2", F.col("id").desc_nulls_last(), "th", "pos"]
    lines = line_rows(df, id_col, text_col, min_chars).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    done = materialise(lines.select("h1", "h2", "dk", "th", "pos").mapInArrow(_decide(min_docs), _STREAM), "line-runs")
    # a run that spans ranges: documents in all, less those counted on both sides of an edge
    w = Window.partitionBy("h1", "h2").orderBy("part")
    edges = done.where(F.col("kind") == EDGE).withColumn("twice", (F.col("first_dk") == F.lag("last_dk").over(w)).cast("int"))
    keys = edges.groupBy("h1", "h2").agg((F.sum("n") - F.coalesce(F.sum("twice"), F.lit(0))).alias("docs"), F.min_by("first_dk", "part").alias("keeper")).where(F.col("docs") >= min_docs)
    settled = done.where(F.col("kind") == OPEN).join(F.broadcast(keys), ["h1", "h2"]).where(F.col("dk") != F.col("keeper"))
    dropped = done.where(F.col("kind") == DROP).select("dk", "th", "pos").unionByName(settled.select("dk", "th", "pos"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = []
            for positions in b.column(2):
                p = positions.values.to_numpy()
                bits = np.ones(int(p.max()) // 8 * 8 + 8, np.uint8)
                bits[p] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary())], ["dk", "th", "keep"])

    return dropped.groupBy("dk", "th").agg(F.collect_set("pos").alias("pos")).mapInArrow(pack, "dk long, th long, keep binary")


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the kept lines as its text, ``n_lines`` (before) and
    ``n_dropped``."""
    others = [c for c in df.columns if c not in (text_col, "n_lines", "n_dropped")]
    rows = df.select(F.struct(*others).alias("row"), F.coalesce(text_col, F.lit("")).alias("text"), *_document(id_col, text_col))
    rows = rows.join(bitmaps, ["dk", "th"], "left").select("row", "text", "keep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, total, gone = [], [], []
            for t, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k is None:
                    total.append(t.count("\n") + 1)
                    gone.append(0)
                else:
                    lines = t.split("\n")
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8))[: len(lines)].astype(bool).tolist()
                    kept = [x for x, stays in zip(lines, bits, strict=False) if stays] + lines[len(bits) :]
                    t = "\n".join(kept)
                    total.append(len(lines))
                    gone.append(len(lines) - len(kept))
                texts.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["row", "text", "n_lines", "n_dropped"])

    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    out = bounded_batches(rows).mapInArrow(cut, schema)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns if c == text_col or c in others], "n_lines", "n_dropped")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    return apply_bitmaps(df, keep_bitmaps(df, id_col, text_col, min_chars, min_docs), id_col, text_col)
