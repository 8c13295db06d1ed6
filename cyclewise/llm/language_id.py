"""Language identification with a linear-chain conditional random field.

Words (runs of letters) carry affix, n-gram and lexicon features: hashed
character n-grams of the word framed by boundary marks (those that touch a
mark are its affixes) and the whole word. Weights per feature and language give
a word its scores; learned transition scores tie neighbouring words together.
Forward-backward gives each word its probability of each language, also in text
that switches languages; a document's language is the one with the largest mean
probability over its words, and that mean is the score.

*Fit.* On a bounded sample of labelled texts: up to ``sample_docs`` distinct ones
per label, those with the least hashes, of each up to ``sample_words``
consecutive words from a place given by the hash. Sequences are pieced together from runs of
different labels, so that transitions are learned as well. Weights follow the
gradient of the log-likelihood (Adagrad), on the driver, in arrays.

*Predict.* Each Arrow batch of whole texts is cut into words; emission scores
are kept per distinct word in a bounded memo; forward and backward run over all
documents of a batch in step, longest first, so a long text costs time and
memory in proportion to its words.

Null text and text without letters is ``und`` with score 0, as is everything if
no labelled row exists. Empty label strings count as null. Rows are independent.
Only the id column is carried along, so no names can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import bounded_batches, text_key

BITS = 16  # n-gram features; as many again for whole words
GRAMS = (1, 2, 3, 4)
MEMO = 150_000
CELLS = 1 << 21
words_of = re.compile(r"[^\W\d_]+").findall
spans_of = re.compile(r"[^\W\d_]+").finditer


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (2 << BITS, labels)
    transitions: np.ndarray  # (from, to)
    start: np.ndarray


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature, value) triples of words of like length."""
    n, width = len(words), max(map(len, words)) + 2
    length = np.fromiter(map(len, words), np.int64, n)
    codes = np.zeros((n, width), np.uint64)
    codes[:, 0] = 2
    codes[np.arange(n), length + 1] = 3
    inner = np.arange(width)
    inside = (inner >= 1) & (inner <= length[:, None])
    codes[inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32) + np.uint32(4)
    rows, cols, values = [], [], []
    whole = np.zeros(n, np.uint64)
    for j in range(width):
        whole = np.where(j <= length + 1, whole * np.uint64(0x100000001B3) + codes[:, j], whole)
    for k in GRAMS:
        if width < k:
            continue
        h = np.full((n, width - k + 1), k, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + codes[:, j : width - k + 1 + j]
        ok = inner[: width - k + 1] + k <= length[:, None] + 2
        if k == 1:
            ok &= inside[:, : width - k + 1]
        count = np.maximum(1, ok.sum(axis=1))
        r, _ = np.nonzero(ok)
        h = (h[ok] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        rows.append(r)
        cols.append(h.astype(np.int64))
        values.append(1 / np.sqrt(count[r]))
    rows.append(np.arange(n))
    cols.append(((whole * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS))
    values.append(np.full(n, 2.0))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), weights.shape[1]), np.float32)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    at = 0
    while at < len(order):
        # as many words as fit the bound, whatever their length
        end = at + 1
        while end < len(order) and (end - at) * (len(words[order[end]]) + 2) * len(GRAMS) < CELLS:
            end += 1
        part = order[at:end]
        r, c, v = features([words[i] for i in part])
        for label in range(weights.shape[1]):
            out[part, label] = np.bincount(r, weights[c, label] * v, len(part))
        at = end
    return out


def posteriors(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word by word probabilities of labels (documents one after another, as in
    ``scores``) and each document's log partition. All documents in step."""
    n, labels = len(lengths), scores.shape[1]
    total = int(lengths.sum())
    lane = np.empty(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    lane[order] = np.arange(n)
    steps = int(lengths.max(initial=0))
    active = n - np.searchsorted(np.sort(lengths), np.arange(steps), "right")
    offset = np.concatenate([[0], np.cumsum(active)])
    doc = np.repeat(np.arange(n), lengths)
    t = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = offset[t] + lane[doc]
    top = scores.max(axis=1)
    e = np.empty((total, labels))
    e[place] = np.exp(scores - top[:, None])
    move = np.exp(transitions)
    a = np.empty((total, labels))
    scale = np.empty(total)
    for s in range(steps):
        k = active[s]
        lo = offset[s]
        x = e[lo : lo + k] * (np.exp(start) if s == 0 else a[offset[s - 1] : offset[s - 1] + k] @ move)
        z = x.sum(axis=1)
        a[lo : lo + k] = x / z[:, None]
        scale[lo : lo + k] = z
    b = np.ones((int(active[0]) if steps else 0, labels))
    for s in range(steps - 2, -1, -1):
        k, lo = active[s + 1], offset[s + 1]
        b[:k] = (e[lo : lo + k] * b[:k] / scale[lo : lo + k, None]) @ move.T
        a[offset[s] : offset[s] + k] *= b[:k]
    a /= a.sum(axis=1, keepdims=True)
    logz = np.bincount(doc, np.log(scale[place]) + top, n)
    return a[place], logz


def fit(sample: list[tuple[str, list[str]]], seed: int = 3, run_words: int = 20, sequence: int = 60, epochs: int = 6, batch: int = 256) -> Model:
    """Model from (label, words) pairs."""
    labels = sorted({label for label, _ in sample})
    index = {x: i for i, x in enumerate(labels)}
    vocabulary = {w: i for i, w in enumerate(sorted(set(chain.from_iterable(w for _, w in sample))))}
    names = list(vocabulary)
    # features of all distinct words, as rows of one sparse matrix
    order = sorted(range(len(names)), key=lambda i: len(names[i]))
    triples = []
    for at in range(0, len(order), 20_000):
        part = np.array(order[at : at + 20_000])
        r, c, v = features([names[i] for i in part])
        triples.append((part[r], c, v))
    rows, cols, vals = (np.concatenate(x) for x in zip(*triples, strict=True))
    by_word = np.argsort(rows, kind="stable")
    rows, cols, vals = rows[by_word], cols[by_word], vals[by_word]
    first = np.searchsorted(rows, np.arange(len(names) + 1))
    # sequences of runs of the same label, from all over the sample
    rng = np.random.default_rng(seed)
    runs = [(index[label], [vocabulary[w] for w in words[i : i + run_words]]) for label, words in sample for i in range(0, len(words), run_words)]
    # labels count alike, however many rows they have
    sizes = np.bincount([r[0] for r in runs], minlength=len(labels))
    weight = np.array([1 / sizes[r[0]] for r in runs])
    picked = rng.choice(len(runs), len(runs), p=weight / weight.sum())
    flat_w = np.concatenate([np.array(runs[i][1]) for i in picked])
    flat_y = np.concatenate([np.full(len(runs[i][1]), runs[i][0]) for i in picked])
    starts = np.arange(0, len(flat_w), sequence)
    k = len(labels)
    w = np.zeros((2 << BITS, k))
    tr, st = np.zeros((k, k)), np.zeros(k)
    squares = [np.full_like(x, 1e-6) for x in (w, tr, st)]
    for epoch in range(epochs):
        deal = rng.permutation(len(starts))
        rate = 0.5 / (1 + epoch)
        for at in range(0, len(deal), batch):
            seqs = [(flat_w[s : s + sequence], flat_y[s : s + sequence]) for s in starts[deal[at : at + batch]]]
            lengths = np.array([len(x) for x, _ in seqs])
            x, y = np.concatenate([s[0] for s in seqs]), np.concatenate([s[1] for s in seqs])
            kinds, x = np.unique(x, return_inverse=True)
            span = np.concatenate([np.arange(first[i], first[i + 1]) for i in kinds])
            local = np.repeat(np.arange(len(kinds)), first[kinds + 1] - first[kinds])
            c, v = cols[span], vals[span]
            em = np.stack([np.bincount(local, w[c, j] * v, len(kinds)) for j in range(k)], axis=1)
            scores = em[x]
            p, _ = posteriors(scores, lengths, tr, st)
            # expected less observed counts
            gap = p.copy()
            gap[np.arange(len(y)), y] -= 1
            ends = np.cumsum(lengths)
            inner = np.ones(len(y), bool)
            inner[ends - 1] = False
            i = np.flatnonzero(inner)
            pair = _pairs(p, i, tr)
            np.subtract.at(pair, (y[i], y[i + 1]), 1)
            g_kind = np.stack([np.bincount(x, gap[:, j], len(kinds)) for j in range(k)], axis=1)
            used, back = np.unique(c, return_inverse=True)
            g_w = np.stack([np.bincount(back, g_kind[local, j] * v, len(used)) for j in range(k)], axis=1)
            g_st = gap[ends - lengths].sum(axis=0)
            g_w += 0.01 * w[used]
            squares[0][used] += g_w**2
            w[used] -= rate * g_w / np.sqrt(squares[0][used])
            for theta, g, sq in ((tr, pair + 0.01 * tr, squares[1]), (st, g_st + 0.01 * st, squares[2])):
                sq += g**2
                theta -= rate * g / np.sqrt(sq)
    return Model(labels, w.astype(np.float32), tr, st)


def _pairs(p: np.ndarray, i: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """Expected transitions between words i and i + 1. The joint probability of
    two neighbours is u(a) * exp(transition) * v(b); the only such table with
    both words' marginals is the limit of proportional scaling."""
    q = np.exp(tr)[None] * p[i][:, :, None] * p[i + 1][:, None, :] + 1e-300
    for _ in range(8):
        q *= (p[i] / q.sum(axis=2))[:, :, None]
        q *= (p[i + 1] / q.sum(axis=1))[:, None, :]
    return q.sum(axis=0)


def learn(df: DataFrame, learn_from: Column, text_col: str = "text", label_col: str = "lang", sample_docs: int = 400, sample_words: int = 150) -> Model | None:
    """Fit on a bounded sample of the labelled rows for which ``learn_from``
    holds: at most ``sample_docs`` distinct texts with letters a label, one row
    each, reach the driver, and every label that has such a text is learned."""
    rows = df.where(learn_from & F.col(label_col).isNotNull() & (F.col(label_col) != "") & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), *(k.alias(x) for x, k in zip(("h", "h2"), text_key(F.col(text_col), "sample"), strict=True)))
    # copies count once, however many rows they have
    keys = materialise(rows.select("label", "h", "h2").distinct(), "language-keys")
    counts = {r["label"]: r["n"] for r in keys.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a label
    if not counts:
        return None
    # a share by hash that yields a little more than is wanted, so that no task ranks a whole label; then the least hashes
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, 1.2 * sample_docs / n + 20 / n))])
    place = F.pmod(F.col("h"), F.lit(1 << 60))
    near = keys.where((F.element_at(share, F.col("label")) >= 1) | (place < F.element_at(share, F.col("label")) * float(1 << 60)))
    least = near.withColumn("at", F.row_number().over(Window.partitionBy("label").orderBy(place, "h", "h2"))).where(F.col("at") <= sample_docs)
    picked = rows.join(F.broadcast(least.drop("at")), ["label", "h", "h2"]).select("label", "text", "h", "h2")

    # cut in the tasks: only the words that are learned from come back, once a task of all copies
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            new, out = [], []
            for i, key in enumerate(zip(*(b.column(j).to_pylist() for j in (0, 2, 3)), strict=True)):
                if key in seen:
                    continue
                seen.add(key)
                words = [w for w in words_of(b.column(1)[i].as_py().lower()) if w.isalpha() or any(map(str.isalpha, w))]
                at = key[1] % max(1, len(words) - sample_words + 1)
                words = words[at : at + sample_words]
                new.append(i)
                out.append([w for w in words if len(w) <= 100] or [w[:100] for w in words])
            kept = [b.column(j).take(pa.array(new, pa.int64())) for j in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.list_(pa.string()))], ["label", "h", "h2", "words"])

    got = bounded_batches(picked).mapInArrow(cut, "label string, h long, h2 long, words array<string>").dropDuplicates(["label", "h", "h2"]).collect()
    pairs = [(r["label"], r["words"]) for r in sorted(got, key=lambda r: (r["label"], r["h"] % (1 << 60), r["h"], r["h2"])) if r["words"]]
    return fit(pairs) if pairs else None


_SPANS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, whole_rows: bool = False, batch_rows: int = 800) -> DataFrame:
    """One row per row of ``df``: the id column, ``lang_pred``, ``score`` and,
    if asked, ``spans``: runs of words of one language as (lang, start, end) in
    code points of the text. With ``whole_rows`` a struct ``row`` of all columns
    stands in place of the id."""
    inner = df.columns.index(text_col) if whole_rows else None
    df = df.select(F.struct("*").alias("row")) if whole_rows else df.select(id_col, text_col)
    id_col = df.columns[0]
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([df.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *([T.StructField("spans", _SPANS)] if spans else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        memo: dict[str, int] = {}
        known = np.zeros((0, len(m.labels) if m else 1), np.float32)
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                b = whole.slice(at, batch_rows)
                texts = (b.column(1) if inner is None else b.column(0).field(inner)).fill_null("").to_pylist()
                if spans:
                    found = [[x for x in spans_of(t) if any(map(str.isalpha, x.group()))] for t in texts]
                    words = [[x.group().lower() for x in f] for f in found]
                else:
                    words = [words_of(t.lower()) for t in texts]
                lang, score, out = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
                if m:
                    if len(memo) > MEMO:
                        memo, known = {}, known[:0]
                    new = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in memo]
                    # digits of other kinds match the pattern but are no letters
                    letters = [w for w in new if w.isalpha() or any(map(str.isalpha, w))]
                    memo.update(dict.fromkeys(new, -1))
                    memo.update((w, len(known) + i) for i, w in enumerate(letters))
                    known = np.concatenate([known, emissions(letters, m.weights)]) if letters else known
                    sizes = np.fromiter(map(len, words), np.int64, len(words))
                    place = np.fromiter(map(memo.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
                    if not spans:
                        words = [None] * len(words)  # no longer needed
                    doc = np.repeat(np.arange(len(words)), sizes)[place >= 0]
                    place = place[place >= 0]
                    lengths = np.bincount(doc, minlength=len(words))
                    p, _ = posteriors(known[place], lengths, m.transitions, m.start)
                    mean = np.stack([np.bincount(doc, p[:, j], len(words)) for j in range(p.shape[1])], axis=1) / np.maximum(lengths, 1)[:, None]
                    best = mean.argmax(axis=1)
                    score = np.clip(mean[np.arange(len(words)), best], 0, 1)
                    lang = [m.labels[i] if n else "und" for i, n in zip(best.tolist(), lengths.tolist(), strict=True)]
                    if spans:
                        ends = np.cumsum(lengths)
                        for i, f in enumerate(found):
                            for x, y in zip(f, p[ends[i] - lengths[i] : ends[i]].argmax(axis=1).tolist(), strict=True):
                                if out[i] and out[i][-1]["lang"] == m.labels[y]:
                                    out[i][-1]["end"] = x.end()
                                else:
                                    out[i].append({"lang": m.labels[y], "start": x.start(), "end": x.end()})
                columns = [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
                if spans:
                    columns.append(pa.array(out, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return bounded_batches(df).mapInArrow(run, schema)
