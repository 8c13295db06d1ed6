"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols (one per character, white space as ``▁``); an agenda
holds every adjacent pair of symbols whose concatenation is a piece, ordered
by the piece's score and then by position; the best pair is merged until no
pair is left. A symbol that is no piece is spelled in byte pieces.

A merge can only ever make a piece, so no merge crosses a place where no piece
does: before a ``▁`` that follows another character, and around a newline when
no piece holds one (both are checked on the vocabulary). The text is cut there
and the ids of each segment are kept in a bounded memo per task.
Decoding works on the ids alone, over a whole Arrow batch at once.

Results are checked against the ``sentencepiece`` library in Arrow batches, all
of them unless ``check_every`` says otherwise: whole texts, encoded and decoded.
A difference raises.

Null text counts as empty; empty text has no ids and decodes to empty. Rows
are independent, so ties and repeated rows need no rule. Only the id column
is carried along; other columns are dropped, so no name can clash.
"""

from __future__ import annotations

import heapq
import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches

SPACE = "▁"
#: segments in the younger half of a worker's memo (some 30 MB a half)
MEMO = 120_000
#: segments up to this length are merged in arrays, so many at a time
LANE, ROWS = 40, 8192
NONE = np.iinfo(np.int32).max


class BpeCodec:
    def __init__(self, model: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown = lib.unk_id()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.byte_of: dict[int, int] = {}
        self.piece: list[str] = []
        for i in range(lib.vocab_size()):
            p = lib.id_to_piece(i)
            self.piece.append(p)
            if lib.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            elif not (lib.is_control(i) or lib.is_unknown(i)):
                self.ids[p] = i
                self.score[p] = -lib.get_score(i)
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("pieces cross word or line boundaries; segments would not be independent")
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*").findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # every way to make a piece of two pieces, for the agendas in arrays
        order = {x: r for r, x in enumerate(sorted(set(self.score.values())))}
        pairs = sorted(
            (a * len(self.piece) + b, i, order[self.score[p]])
            for p, i in self.ids.items()
            for k in range(1, len(p))
            if (a := self.ids.get(p[:k])) is not None and (b := self.ids.get(p[k:])) is not None
        )
        key, made, rank = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.table_pairs(key, made.astype(np.int32), rank.astype(np.int32))
        self.closed = all(c in self.ids for p in self.ids for c in p)
        self.of_char = np.arange(-2, -2 - sys.maxunicode - 1, -1, np.int32)  # an unknown character is -2 less its code point
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        # for decoding; bytes of 128 and above need their neighbours
        self.shown = pa.array([chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else "" if self.library.is_control(i) else p.replace(SPACE, " ") for i, p in enumerate(self.piece)])
        self.high = np.array([self.byte_of.get(i, 0) > 127 or self.library.is_unknown(i) for i in range(len(self.piece))])

    def table_pairs(self, key: np.ndarray, made: np.ndarray, rank: np.ndarray) -> None:
        """A hash table of pairs in arrays: open addressing, so that one gather
        finds most pairs, and empty places end a search."""
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(key))))) + 3)
        size = 1 << self.bits
        self.pair_key, self.pair_id, self.pair_rank = np.full(size, -1, np.int64), np.full(size, -1, np.int32), np.full(size, NONE, np.int32)
        left, at = np.arange(len(key)), self.place(key)
        self.tries = 0
        while len(left):
            self.tries += 1
            # of keys at one free place the first takes it
            free = np.flatnonzero(self.pair_key[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            for table, of in ((self.pair_key, key), (self.pair_id, made), (self.pair_rank, rank)):
                table[at[won]] = of[left[won]]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, at = left[stay], (at[stay] + 1) & (size - 1)
        self.empty = int(np.flatnonzero(self.pair_key < 0)[0])

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of the pairs in the table; an empty one if they make no piece."""
        key = a.astype(np.int64) * len(self.piece) + b
        key[(a < 0) | (b < 0)] = -2
        at = self.place(key)
        got = self.pair_key[at]
        miss = np.flatnonzero(((got != key) & (got >= 0)).ravel())
        for _ in range(self.tries):
            if not len(miss):
                break
            at.flat[miss] = to = (at.flat[miss] + 1) & (len(self.pair_key) - 1)
            got = self.pair_key[to]
            miss = miss[(got != key.flat[miss]) & (got >= 0)]
        # whoever is not found after all tries is at a place of another pair
        at.flat[miss] = self.empty
        return at

    def encode_many(self, segments: list[str]) -> list[bytes]:
        """Ids of segments of up to LANE characters: one agenda a row, all rows
        in step. A row holds its symbols and the rank of each adjacent pair;
        the best pair, the leftmost of equals, is merged, so that the row loses
        one symbol, and the two pairs beside it are ranked anew."""
        n, width = len(segments), max(map(len, segments)) + 1
        length = np.fromiter(map(len, segments), np.int32, n)
        sym = np.full((n, width), -1, np.int32)
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        sym[np.arange(width) < length[:, None]] = self.of_char[codes]
        rank = self.pair_rank[self.pair(sym[:, :-1], sym[:, 1:])]
        live, done = np.arange(n), [None] * n
        while len(live):
            k = np.arange(len(live))
            best = rank.argmin(axis=1)
            more = rank[k, best] < NONE
            if not more.all():
                ended, step = sym[~more], 4 * sym.shape[1]
                raw, odd = ended.tobytes(), (ended < -1).any(axis=1).tolist()
                for r, (i, size) in enumerate(zip(live[~more].tolist(), (ended != -1).sum(axis=1).tolist(), strict=True)):
                    done[i] = self.spelled(ended[r, :size].tolist()) if odd[r] else raw[r * step : r * step + 4 * size]
                live, sym, rank, best = live[more], sym[more], rank[more], best[more]
                k = np.arange(len(live))
                if not len(live):
                    break
            sym[k, best] = self.pair_id[self.pair(sym[k, best], sym[k, best + 1])]
            width = sym.shape[1]
            sym = sym[np.arange(width) != best[:, None] + 1].reshape(len(live), width - 1)
            rank = rank[np.arange(width - 1) != best[:, None]].reshape(len(live), width - 2)
            for j, ok in ((best - 1, best > 0), (best, best < width - 2)):
                r, c = k[ok], j[ok]
                rank[r, c] = self.pair_rank[self.pair(sym[r, c], sym[r, c + 1])]
        return done

    def spelled(self, ids: list[int]) -> bytes:
        return np.array([y for z in ids for y in ([z] if z >= 0 else [self.bytes[c] for c in chr(-2 - z).encode("utf-8")])], np.int32).tobytes()

    def encode_segment(self, segment: str) -> list[int]:
        """Ids of one segment: the agenda loop."""
        n, score, ids = len(segment), self.score, self.ids
        sym: list[str] = list(segment)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            if (s := score.get(segment[i : i + 2])) is not None:
                agenda.append((s, i, 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            a, j = sym[i], right[i]
            # an entry is stale once either symbol has been merged into another
            if not a or j >= n or len(a) + len(sym[j]) != size:
                continue
            sym[i] = a = a + sym[j]
            sym[j] = ""
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (s := score.get(a + sym[k])) is not None:
                    heapq.heappush(agenda, (s, i, size + len(sym[k])))
            if (h := left[i]) >= 0 and (s := score.get(sym[h] + a)) is not None:
                heapq.heappush(agenda, (s, h, len(sym[h]) + size))
        out = []
        for p in sym:
            if p:
                if (x := ids.get(p)) is not None:
                    out.append(x)
                else:
                    out += [self.bytes[b] for b in p.encode("utf-8")]
        return out

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids: the pieces joined, ``▁`` as a space, less the
        space that encoding puts first. Runs of byte pieces above 127 make
        characters together; the rows that have them are joined in Python."""
        flat = ids.values.to_numpy()
        pieces = pa.ListArray.from_arrays(ids.offsets, self.shown.take(ids.values))
        out = pc.binary_join(pieces, "")
        out = pc.if_else(pc.starts_with(out, " "), pc.utf8_slice_codeunits(out, 1), out)
        ends = ids.offsets.to_numpy()
        rows = np.unique(np.searchsorted(ends, np.flatnonzero(self.high[flat]), "right") - 1)
        if len(rows):
            texts = out.to_pylist()
            for r in rows.tolist():
                texts[r] = self.decode_one(flat[ends[r] : ends[r + 1]].tolist())
            out = pa.array(texts, pa.string())
        return out

    def decode_one(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            out.append(run.decode("utf-8", "replace"))
            run.clear()
            out.append(" \u2047 " if i == self.unknown else "" if self.library.is_control(i) else self.piece[i])
        text = "".join([*out, run.decode("utf-8", "replace")]).replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text

    def keys(self, text: str) -> list[str]:
        """A text's segments by their keys: a key stands for itself if it begins
        with a newline, else for ``▁`` and itself."""
        if "  " in text or SPACE in text or text[:1] == " ":
            return [s if s[0] == "\n" else s[1:] for s in self.cut(SPACE + text.replace(" ", SPACE))]
        return text.replace("\n", " \n").split(" ") if text else []

    def learn(self, wanted: set[str]) -> dict[str, bytes]:
        """Ids (int32, as bytes) of all wanted segments, from the memo or encoded
        and held against the library. The memo has two halves; a segment that is
        used moves to the younger one, and the older one goes when the younger
        is full."""
        old, young = self.old, self.young
        got = {s: e for s in wanted if (e := young.get(s) or old.get(s)) is not None}
        new = [s for s in wanted if s not in got]
        whole = {k: k if k[:1] == "\n" else SPACE + k for k in new}
        short = sorted((k for k in new if len(k) < LANE), key=len) if self.closed else []
        for at in range(0, len(short), ROWS):
            part = short[at : at + ROWS]
            got.update(zip(part, self.encode_many([whole[k] for k in part]), strict=True))
        for k in new if len(short) < len(new) else ():
            if k not in got:
                got[k] = np.array(self.encode_segment(whole[k]), np.int32).tobytes()
        lines: list[list[int]] = []
        for k, ids in library_segments(self.library, new, lines):
            if ids != got[k]:
                raise ValueError(f"agenda and library encode otherwise: {whole[k][:2000]!r}")
        self.check_decoded(pa.array(lines, pa.list_(pa.int32())))
        if len(young) > MEMO:
            self.old, self.young = young, {}
        self.young.update(got)
        return got

    def forget(self) -> None:
        self.old, self.young = {}, {}

    def encode(self, texts: list[str]) -> pa.ListArray:
        cut = [self.keys(t) for t in texts]
        ids_of = self.learn(set(chain.from_iterable(cut))).__getitem__
        flat = [b"".join(map(ids_of, segs)) for segs in cut]
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in flat], dtype=np.int64)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(flat), np.int32)))

    def check(self, texts: list[str], ids: pa.ListArray) -> None:
        """Whole texts against the library."""
        for t, a, b in zip(texts, self.library.encode(texts, num_threads=1), ids.to_pylist(), strict=True):
            if a != b:
                raise ValueError(f"agenda and library encode otherwise: {t[:2000]!r}")
        self.check_decoded(ids)

    def check_decoded(self, ids: pa.ListArray) -> None:
        if len(ids):
            for a, b in zip(self.library.decode(ids.to_pylist()), self.decode(ids).to_pylist(), strict=True):
                if a != b:
                    raise ValueError(f"library decodes to {a[:2000]!r}, not {b[:2000]!r}")


def library_segments(library, keys: list[str], whole: list | None = None, together: int = 50) -> Iterator[tuple[str, bytes]]:
    """Each key with the library's ids of its segment (int32, as bytes), for a
    vocabulary without pieces across words or lines: segments stand on lines of
    one text, and a key's own newline is the line break before it. The ids of
    these texts are added to ``whole``."""
    newline = library.encode("\n")[-1]
    own = np.int32(newline).tobytes()
    for at in range(0, len(keys), together):
        part = keys[at : at + together]
        lines = "".join("\n" + (k[1:] if k[:1] == "\n" else " " + k.replace(SPACE, " ")) for k in part)
        each = library.encode(lines)
        if whole is not None:
            whole.append(each)
        ids = np.array(each, np.int32)
        raw, breaks = ids.tobytes(), np.append(np.flatnonzero(ids == newline), len(ids)).tolist()
        if len(breaks) != len(part) + 1:
            raise ValueError("the library does not keep line breaks apart")
        for k, i, j in zip(part, breaks, breaks[1:], strict=False):
            yield k, (own if k[:1] == "\n" else b"") + raw[4 * i + 4 : 4 * j]


_CODEC: dict[int, BpeCodec] = {}


def encode_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", batch_rows: int = 400, check_every: int = 32) -> DataFrame:
    """One row per row of ``df``: the id column, ``ids`` (array<int>) and
    ``decoded`` (string). ``model_path`` is read on the driver and its bytes
    (under 1 MB) are broadcast. All segments are checked against the
    library, whole texts in every ``check_every``-th batch of ``batch_rows`` texts
    as well."""
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = model.value
        codec = _CODEC.get(hash(data)) or _CODEC.setdefault(hash(data), BpeCodec(data))
        parts = (whole.slice(at, batch_rows) for whole in batches for at in range(0, whole.num_rows, batch_rows))
        for k, b in enumerate(parts):
            texts = b.column(1).fill_null("").to_pylist()
            ids = codec.encode(texts)
            decoded = codec.decode(ids)
            if k % check_every == 0:
                codec.check(texts, ids)
            yield pa.RecordBatch.from_arrays([b.column(0), ids, decoded], [id_col, "ids", "decoded"])
        codec.forget()  # a worker serves other stages after this task

    schema = T.StructType([df.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType(), True)), T.StructField("decoded", T.StringType())])
    return bounded_batches(df).select(id_col, text_col).mapInArrow(run, schema)
