"""Alignment of the tokens of two tokenizers by sparse incidence matrices.

Each text is encoded by a byte-level BPE vocabulary (A, over a space and the
text) and by a merge-type SentencePiece vocabulary (B, which adds that space).
Both tile the same bytes, or the text has no tokens here.

*Links.* Token-byte incidence matrices A and B are built by hand in compressed
rows (row pointers, column indices). Gustavson's row products give A·Bᵀ: for
each token of A, the rows of Bᵀ at its bytes are added up, which yields every
pair of tokens that share bytes, with how many. Pairs whose byte ranges end
together are the links. Bytes where they end cut the tokens into groups; with
the group-incidence matrices, (A·G)·(1ᵀ·B·G)ᵀ counts the shared-group pairs,
and ``shared_group`` lists them for callers that want them (they can be many).

*Counts.* A text's links are kept as distinct id pairs with multiplicity. Spark
sums them over the corpus, finds each B id's highest count, and joins counts
back: by broadcast if there are at most ``BROADCAST`` distinct pairs, else by a
shuffle join, which adaptive execution splits at hot pairs. Both give the same.

Encoding. A: the merges of the vocabulary file, applied by ``tiktoken`` (the
file is refused unless ids follow the merge order, on which that rests). B: as
no piece crosses a place before ``▁`` or at a newline (checked on the
vocabulary), texts are cut there and distinct segments are encoded by the
``sentencepiece`` library, kept in a bounded memo per task.

Whole texts are used; a slice of texts of about 2 MB is worked on at once, a
longer text alone. A text that is null or empty, or whose joined A or B bytes
differ from a space and the text, has no tokens: zeros, an empty ``groups`` and
no links. Rows are independent but for corpus counts, in which each repeated
row counts. Null ids are kept. An empty table gives no rows. Only the id column
is carried along.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import bounded_batches, byte_slices
from .sentencepiece_codec import library_segments

#: distinct id pairs up to which their counts are broadcast (some 100 MB)
BROADCAST = 1_000_000
#: segments in a task's memo
MEMO = 200_000
SPACE = "▁"

# fixed value: the pattern that splits text before byte-level merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Csr:
    """A sparse matrix in compressed rows: entries ``cols[ptr[r] : ptr[r + 1]]``
    of row r with ``vals``."""

    def __init__(self, ptr: np.ndarray, cols: np.ndarray, vals: np.ndarray, width: int):
        self.ptr, self.cols, self.vals, self.width = ptr, cols, vals, width

    @classmethod
    def tiles(cls, ends: np.ndarray) -> Csr:
        """Tokens against bytes, for tokens that follow each other."""
        n = int(ends[-1]) if len(ends) else 0
        return cls(np.concatenate([[0], ends]), np.arange(n), np.ones(n, np.int64), n)

    @classmethod
    def of_rows(cls, col: np.ndarray, width: int) -> Csr:
        """One entry a row."""
        return cls(np.arange(len(col) + 1), col, np.ones(len(col), np.int64), width)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))

    def transpose(self) -> Csr:
        rows = self.rows()
        order = slice(None) if (self.cols[1:] >= self.cols[:-1]).all() else np.argsort(self.cols, kind="stable")
        ptr = np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=self.width))])
        return Csr(ptr, rows[order], self.vals[order], len(self.ptr) - 1)

    def times(self, other: Csr) -> Csr:
        """Gustavson's product: row r of the result is the sum of the rows of
        ``other`` at r's entries, weighted by them."""
        take = np.diff(other.ptr)[self.cols]
        row = np.repeat(self.rows(), take)
        # positions in ``other`` of all entries that are added
        first = np.repeat(other.ptr[:-1][self.cols] - (np.cumsum(take) - take), take)
        at = first + np.arange(len(first))
        col, val = other.cols[at], np.repeat(self.vals, take) * other.vals[at]
        key = row * other.width + col
        if len(key) and not (key[1:] >= key[:-1]).all():
            order = np.argsort(key, kind="stable")
            key, val = key[order], val[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        key, val = key[new], np.add.reduceat(val, new) if len(new) else val
        row, col = np.divmod(key, max(1, other.width))
        return Csr(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(self.ptr) - 1))]), col, val, other.width)


def grouped(at: np.ndarray, n: int) -> Csr:
    """Tokens against groups, where group g ends with token ``at[g]``."""
    return Csr.of_rows(np.repeat(np.arange(len(at)), np.diff(np.concatenate([[-1], at]))), len(at))


def shared_group(i: np.ndarray, j: np.ndarray, n_a: int, n_b: int) -> Csr:
    """All token pairs in one group, as a matrix of n_a x n_b."""
    return grouped(i, n_a).times(grouped(j, n_b).transpose())


def shared_group_count(i: np.ndarray, j: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """For each token of A the number of B tokens in its group, without the
    pairs: the group-incidence matrix times the groups' sizes in B."""
    g = grouped(i, n_a)
    sizes = np.bincount(grouped(j, n_b).cols, minlength=g.width)
    return np.add.reduceat(g.vals * sizes[g.cols], g.ptr[:-1]) if n_a else np.zeros(0, np.int64)


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the
    others, in order, from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


class Vocabulary:
    """Bytes of ids, as a table for whole arrays of ids."""

    def __init__(self, entries: dict[int, bytes], size: int):
        self.size = size
        each = [entries.get(i, b"") for i in range(size)]
        self.table, self.length = pa.array(each, pa.large_binary()), np.fromiter(map(len, each), np.int64, size)

    def joined(self, ids: np.ndarray) -> bytes:
        out = self.table.take(pa.array(ids))
        return out.buffers()[2].to_pybytes()[: int(self.length[ids].sum())] if len(ids) else b""


class ByteLevel(Vocabulary):
    """A: ids of a space and each text."""

    def __init__(self, data: bytes):
        import tiktoken

        spec = json.loads(data)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        of = byte_alphabet()
        entries = {i: bytes(of[c] for c in e) for e, i in spec["model"]["vocab"].items() if e not in special}
        ranks = {b: i for i, b in entries.items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        made = [ranks[bytes(of[c] for c in a + b)] for a, b in merges]
        if len(ranks) != len(entries) or made != sorted(made) or sorted(set(entries) - set(made)) != list(range(256)):
            raise ValueError("ids don't follow the order of merges")
        super().__init__(entries, max(entries) + 1)
        self.of = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [self.of(" " + t) if t else [] for t in texts]
        n = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(chain.from_iterable(each), np.int32, int(n.sum())), n

    def forget(self) -> None:
        pass


class Pieces(Vocabulary):
    """B: ids of texts by segments. A key stands for a segment: the key itself
    if it begins with a newline, else ``▁`` and the key."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [lib.id_to_piece(i) for i in range(lib.vocab_size())]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("pieces cross word or line boundaries; segments would not be independent")
        entries = {i: bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces) if not lib.is_control(i)}
        super().__init__(entries, len(pieces))
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*").findall
        self.memo: dict[str, bytes] = {}

    def keys(self, text: str) -> list[str]:
        if "  " in text or SPACE in text or text[:1] == " ":
            return [s if s[0] == "\n" else s[1:] for s in self.cut(SPACE + text.replace(" ", SPACE))]
        return text.replace("\n", " \n").split(" ")

    def learn(self, wanted: set[str]) -> None:
        """Ids (int32, as bytes) of all wanted keys, in the memo."""
        new = [k for k in wanted if k not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = {}, list(wanted)
        self.memo.update(library_segments(self.library, new))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [self.keys(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(each)))
        flat = [b"".join(map(self.memo.__getitem__, k)) for k in each]
        return np.frombuffer(b"".join(flat), np.int32), np.fromiter((len(x) // 4 for x in flat), np.int64, len(flat))

    def forget(self) -> None:
        self.memo = {}


class Aligner:
    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        most = max(self.a.size, self.b.size)
        #: ids as text with what follows them, at 4 * id + 0 to 3
        self.shown = pa.array([f"{i}{sep}" for i in range(most) for sep in (",", "|", ";", "")])

    def align(self, texts: list[str]) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, n_overlaps, n_shared, groups, pairs and
        times of each text."""
        rows = len(texts)
        (a, na), (b, nb) = self.a.encode(texts), self.b.encode(texts)
        sure = self._equal(texts, self.a, a, na) & self._equal(texts, self.b, b, nb)
        if not sure.all():
            a, b = a[np.repeat(sure, na)], b[np.repeat(sure, nb)]
            na, nb = na * sure, nb * sure
        row = np.repeat(np.arange(rows), na)
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        both = Csr.tiles(end_a).times(Csr.tiles(end_b).transpose())
        of = both.rows()
        last = end_a[of] == end_b[both.cols]
        i, j = of[last], both.cols[last]
        per_row = lambda r, w=None: pa.array(np.bincount(r, w, rows).astype(np.int64))
        n = per_row(row[i])
        shared = per_row(row, shared_group_count(i, j, len(a), len(b)))
        pair = a[i].astype(np.int64) * self.b.size + b[j]
        area = self.a.size * self.b.size
        each, times = np.unique(row[i] * area + pair, return_counts=True)
        at, pair = np.divmod(each, area)
        ptr = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=rows))]), pa.int32())
        lists = [pa.ListArray.from_arrays(ptr, pa.array(x, pa.int32() if x is times or area < 2**31 else pa.int64())) for x in (pair, times)]
        return [pa.array(na), pa.array(nb), n, n, per_row(row[of]), shared, self._shown(a, b, na, nb, i, j, row), *lists]

    @staticmethod
    def _equal(texts: list[str], vocabulary: Vocabulary, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        joined, to = vocabulary.joined(ids), np.concatenate([[0], np.cumsum(vocabulary.length[ids])])
        ends = to[np.cumsum(n)].tolist()
        return np.array([joined[s:e] == (" " + t).encode() for t, s, e in zip(texts, [0, *ends], ends, strict=False)], bool)

    def _shown(self, a, b, na, nb, i, j, row) -> pa.Array:
        """Groups as text: A ids, a bar, B ids; semicolons between groups."""
        x, y = 4 * a, 4 * b
        x[i] += 1
        y[j] += 2
        y[j[np.append(row[i[1:]] != row[i[:-1]], True)] if len(j) else j] += 1
        flat = np.empty(len(a) + len(b), np.int32)
        # a token comes after all tokens of the groups before its own, and B's after A's
        flat[np.arange(len(a)) + np.append(0, j + 1)[grouped(i, len(a)).cols]] = x
        flat[np.arange(len(b)) + (i + 1)[grouped(j, len(b)).cols]] = y
        ptr = pa.array(np.concatenate([[0], np.cumsum(na + nb)]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(ptr, self.shown.take(pa.array(flat))), "")


_ALIGNERS: dict[int, Aligner] = {}
LONGS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared")


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id column; numbers of tokens, groups,
    links, overlapping pairs and shared-group pairs; ``groups`` (A ids, a bar,
    B ids; groups by semicolons); and the links as ``pairs`` (A id times the
    size of B's vocabulary plus B id, distinct) with ``times``. Both files (under
    3 MB) are read on the driver and broadcast."""
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            files.append(f.read())
    sent = df.sparkSession.sparkContext.broadcast(files)
    sizes = pair_sizes(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sent.value
        key = hash((a, b))
        own = _ALIGNERS.get(key) or _ALIGNERS.setdefault(key, Aligner(a, b))
        for whole in batches:
            for part in byte_slices(whole, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), *own.align(part.column(1).fill_null("").to_pylist())], [id_col, *LONGS, "groups", "pairs", "times"])
        own.b.forget()  # a worker serves other stages after this task

    pair = T.IntegerType() if sizes[0] * sizes[1] < 2**31 else T.LongType()
    fields = [*(T.StructField(c, T.LongType()) for c in LONGS), T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(pair)), T.StructField("times", T.ArrayType(T.IntegerType()))]
    return bounded_batches(df).select(id_col, text_col).mapInArrow(run, T.StructType([df.schema[id_col], *fields]))


def pair_sizes(a_path: str, b_path: str) -> tuple[int, int]:
    """Sizes of both vocabularies, as ``pairs`` are numbered."""
    with open(a_path, "rb") as f, open(b_path, "rb") as g:
        own = Aligner(f.read(), g.read())
    return own.a.size, own.b.size


def with_counts(aligned: DataFrame, b_size: int, most: int = BROADCAST) -> DataFrame:
    """``aligned`` without ``pairs`` and ``times``, with ``n_best`` and
    ``count_sum`` from the counts of id pairs in all rows."""
    kept = materialise(aligned.withColumn("rid", F.monotonically_increasing_id()), "token-links")
    each = kept.select("rid", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    counts = materialise(each.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair") % b_size), "token-pairs")
    best = counts.groupBy("b").agg(F.max("count").alias("most"))
    marked = counts.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    if counts.count() <= most:
        marked = F.broadcast(marked)
    sums = each.join(marked, "pair").groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = kept.drop("pairs", "times").join(sums, "rid", "left").drop("rid")
    return out.fillna(0, ["n_best", "count_sum"])
