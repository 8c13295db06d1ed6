"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

*Folding* lower-cases, maps look-alike letters and digits or signs inside words
to plain letters, drops invisible characters, and makes everything that is no
letter or digit one space; a text begins and ends with a space, so a pattern
`` abc`` is the beginning of a word and `` abc `` a word.

*Learning*, from labelled rows only:

1. Labels are made one per id (the larger), at most about ``sample_rows`` ids a
   label are taken by a hash of the id. Copies and near copies, which say the
   same, count once a label: of texts whose least hash of three words in
   sequence is the same the first in alphabetical order stays.
2. Words and beginnings of words are counted once a text and label, on Spark.
   Those that stand out towards toxic texts against all chance (a likelihood
   ratio beyond the logarithm of the number of candidates) are candidates. Of a
   chain of beginnings the longest of equal support stays, and a longer one
   that a shorter one covers goes.
3. *Exception phrases*: a hit's whole word, and that word with its neighbour to
   the left or right, counted in the same way. Phrases that lean as clearly to
   clean texts switch off the hits inside them.
4. Weights are smoothed log odds of a text with a hit that no exception covers.
   A text's weighted hits, per word and in total (logarithms), are two features
   of a logistic score with a ridge, fitted on the sample.

At most ``sample_rows`` texts a label take part in learning, at most
``CANDIDATES`` beginnings and as many phrases come to the driver, and the
lexicon has at most ``lexicon_size`` entries and as many exceptions: all that is
broadcast. Scoring reads every whole text once.

Null text counts as empty; a text without hits, also an empty one, has the score
of no hits. Without labels of both kinds there is no lexicon and every score is
the smoothed share of toxic labels (0 without any label). Rows are independent;
repeated rows give repeated results; null ids are scored, not learned from. An
empty table gives no rows. Only the id column is carried along.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import bounded_batches

# fixed values: letters that look like plain ones, and signs and digits read as letters
LOOKALIKES = {
    "a": "аɑαᴀ", "b": "ЬƄʙ", "c": "сϲᴄ", "d": "ԁɗᴅ", "e": "еҽεᴇ", "f": "ƒ", "g": "ɡց", "h": "һհ", "i": "іıɩι", "j": "јʝ", "k": "кκᴋ",
    "l": "ӏⅼ", "m": "мᴍ", "n": "ոηɴ", "o": "оοσօᴏ", "p": "рρ", "q": "ԛգ", "r": "гᴦʀ", "s": "ѕʂ", "t": "тτᴛ", "u": "υսᴜ", "v": "ѵνᴠ",
    "w": "ԝωᴡ", "x": "хχ", "y": "уγүʏ", "z": "ᴢʐ",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
INVISIBLE = "­​‌‍⁠﻿"

#: beginnings of words that are counted, shortest and longest
SHORT, LONG = 3, 12
CANDIDATES = 20_000
#: log odds that an entry must have against the sample's own odds
LEAN = math.log(3)

_inside = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])").sub
_hidden = re.compile(f"[{INVISIBLE}]").sub


class _Fold(dict):
    """Characters as folded, filled in as they are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c).lower() if code > 127 else c
        if len(plain) == 1 and plain != c:
            out = self[ord(plain)]
        else:
            out = plain if plain.isalnum() else "" if unicodedata.combining(c) else " "
        self[code] = out
        return out


FOLD = _Fold({ord(c): letter for letter, cs in LOOKALIKES.items() for c in cs.lower()} | {ord(d): c for d, c in DIGITS.items()})


def fold(text: str) -> str:
    t = text.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFC", _hidden("", t))
    if any(s in t for s in SIGNS):
        t = _inside(lambda m: SIGNS[m.group()], t)
    return f" {' '.join(t.translate(FOLD).split())} "


def beginnings(word: str) -> Iterator[str]:
    """`` abc`` for each beginning, and `` word `` itself."""
    for k in range(SHORT, min(LONG, len(word)) + 1):
        yield " " + word[:k]
    if len(word) <= LONG:
        yield f" {word} "


class Lexicon:
    """Entries with weights, exception phrases, and the logistic score."""

    def __init__(self, weights: dict[str, float], exceptions: set[str], score: tuple[float, float, float]):
        import ahocorasick

        self.weights, self.exceptions, self.score = weights, exceptions, score
        self.automaton = ahocorasick.Automaton()
        for p in {*weights, *exceptions}:
            self.automaton.add_word(p, (len(p), weights.get(p), p in exceptions))
        if self.automaton:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of entries that no exception covers; of entries
        that begin at one place the longest."""
        if not len(self.automaton):
            return []
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for last, (size, weight, spare) in self.automaton.iter(folded):
            at = last + 1 - size
            if spare:
                spared.append((at, last + 1))
            if weight is not None:
                best[at] = (last + 1, weight)
        # the longest exception that begins at or before a hit decides
        out, reach, k = [], 0, 0
        spared.sort()
        for at, (end, weight) in sorted(best.items()):
            while k < len(spared) and spared[k][0] <= at:
                reach = max(reach, spared[k][1])
                k += 1
            if end > reach:
                out.append((at, end, weight))
        return out

    def features(self, folded: str, hits: list[tuple[int, int, float]]) -> tuple[float, float]:
        total = sum(w for _, _, w in hits)
        return math.log1p(100 * total / max(1, folded.count(" ") - 1)), math.log1p(total)

    def judge(self, text: str) -> tuple[float, list[str]]:
        """The score of a text, and the entries found in it, in order."""
        folded = fold(text)
        hits = self.hits(folded)
        u, v = self.features(folded, hits)
        z = self.score[0] + self.score[1] * u + self.score[2] * v
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z)))), [folded[a:e].strip() for a, e, _ in hits]

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions, self.score)


def _least_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and labels with the least hash of three words in sequence."""
    for b in batches:
        least = []
        for t in b.column(0).to_pylist():
            w = fold(t or "").encode().split()
            least.append(min(map(zlib.crc32, map(b" ".join, zip(w, w[1:], w[2:], strict=False))), default=zlib.crc32(b" ".join(w))))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least, pa.int64())], ["text", "y", "least"])


def _counted(sample: DataFrame, keys) -> DataFrame:
    """(entry, clean, toxic): texts with the entry, by label; ``keys(text)``
    gives a text's entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count = (Counter(), Counter())
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                count[y].update(keys(t or ""))
            every = list({**count[0], **count[1]})
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c[e] for e in every], pa.int64()) for c in count)], ["entry", "clean", "toxic"])

    out = bounded_batches(sample).select("text", "y").mapInArrow(run, "entry string, clean long, toxic long")
    return out.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _standing_out(counts: DataFrame, base: float, side) -> list:
    """Entries whose share of toxic texts differs from ``base`` by more than
    chance among all entries could make it, if ``side(share)`` holds."""
    chance = math.log(max(2, counts.count())) + 2
    n, share = F.col("clean") + F.col("toxic"), F.col("toxic") / (F.col("clean") + F.col("toxic"))
    gain = F.when(F.col("toxic") > 0, F.col("toxic") * F.log(share / base)).otherwise(0.0) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return counts.withColumn("gain", gain).where(side(share) & (F.col("gain") >= chance) & (n >= 3)).orderBy(F.desc("gain"), "entry").limit(CANDIDATES).collect()


def choose(rows: list, base: float) -> list[str]:
    """Of chains of beginnings: the shortest that leans far enough, lengthened
    as long as no support is lost; longer ones only if they lean much further."""
    support = {r["entry"]: (r["toxic"], r["clean"]) for r in rows}
    odds = {e: math.log((toxic + 0.5) / (clean + 0.5)) - math.log(base / (1 - base)) for e, (toxic, clean) in support.items()}
    kept: set[str] = set()
    for e in sorted((e for e in support if odds[e] >= LEAN), key=lambda e: (len(e), e)):
        cover = next((e[:k] for k in range(len(e) - 1, 1, -1) if e[:k] in kept), None)
        same = cover is not None and support[e] == support[cover]
        if same and not e.endswith(" "):
            kept.remove(cover)
            kept.add(e)
        elif cover is None or not same and odds[e] > odds[cover] + LEAN:
            kept.add(e)
    return sorted(kept, key=lambda e: (-support[e][0], e))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """Newton steps for a logistic score with weights of at least 0."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        penalty = ridge * np.array([0.01, 1, 1])
        grad = a.T @ (y - p) - penalty * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty) + 1e-9 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0)), float(max(w[2], 0))


def learn(docs: DataFrame, labels: DataFrame, wanted: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 20_000, lexicon_size: int = 2_000) -> Lexicon:
    """A lexicon from the texts of ``docs`` whose id has a label in ``labels``
    and meets ``wanted`` (a condition on ``labels``)."""
    each = labels.where(wanted & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    n = {r["y"]: r["n"] for r in each.groupBy("y").agg(F.count("*").alias("n")).collect()}
    taken = None
    for y in sorted(n):
        share = min(1.0, sample_rows / n[y])
        part = each.where((F.col("y") == y) & (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1))
        taken = part if taken is None else taken.unionByName(part)
    if taken is None:
        return Lexicon({}, set(), (-math.inf, 0.0, 0.0))
    # two times sample_rows ids at most, but for chance: small enough for each task
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(taken), "id")
    sample = materialise(bounded_batches(texts.select("text", "y")).mapInArrow(_least_hashes, "text string, y int, least long").groupBy("least", "y").agg(F.min("text").alias("text")).select("text", "y"), "toxic-sample")
    clean, toxic = sample.agg(F.count(F.when(F.col("y") == 0, 1)), F.count(F.when(F.col("y") == 1, 1))).first()
    base = (toxic + 0.5) / (clean + toxic + 1)
    prior = math.log(base / (1 - base))
    if not clean or not toxic:
        return Lexicon({}, set(), (prior if clean + toxic else -math.inf, 0.0, 0.0))

    counts = _counted(sample, lambda t: {e for w in set(fold(t).split()) for e in beginnings(w)})
    entries = choose(_standing_out(materialise(counts, "toxic-counts"), base, lambda share: share > base), base)[:lexicon_size]
    first = Lexicon(dict.fromkeys(entries, 1.0), set(), (0.0, 0.0, 0.0))
    found = materialise(_counted(sample, lambda t: phrases(first, fold(t))), "toxic-counts")
    c, t = found.agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    # a phrase is an exception if it leans to clean against other hits and against all texts
    spare = {r["entry"] for r in _standing_out(found, (t + 0.5) / (c + t + 1), lambda share: share < base)[:lexicon_size]} - set(entries)
    second = Lexicon(dict.fromkeys(entries, 1.0), spare, (0.0, 0.0, 0.0))

    def own(t: str) -> set[str]:
        f = fold(t)
        return {f[a:b] for a, b, _ in second.hits(f)}

    odds = {r["entry"]: math.log((r["toxic"] + 0.5) / (r["clean"] + 0.5)) - prior for r in _counted(sample, own).collect()}
    third = Lexicon({e: w for e, w in odds.items() if w >= LEAN}, spare, (0.0, 0.0, 0.0))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folded = [fold(t or "") for t in b.column(0).to_pylist()]
            x = [third.features(f, third.hits(f)) for f in folded]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), b.column(1)], ["u", "v", "y"])

    rows = bounded_batches(sample).select("text", "y").mapInArrow(measured, "u double, v double, y int").collect()
    a = np.array([(r["u"], r["v"], r["y"]) for r in rows], float).reshape(-1, 3)
    return Lexicon(third.weights, spare, logistic(a[:, :2], a[:, 2]))


def phrases(lexicon: Lexicon, folded: str) -> set[str]:
    """The whole word of each hit, alone and with either neighbour."""
    out = set()
    for at, _, _ in lexicon.hits(folded):
        end = folded.index(" ", at + 1)
        out.add(folded[at : end + 1])
        if at:
            out.add(folded[folded.rindex(" ", 0, at) : end + 1])
        if end + 1 < len(folded):
            out.add(folded[at : folded.index(" ", end + 1) + 1])
    return out


def score(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id column, ``score`` (0 to 1) and ``hits``
    (the entries found in the folded text, in order)."""
    parts = df.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.exceptions, lexicon.score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(*parts.value)
        for b in batches:
            judged = [own.judge(t or "") for t in b.column(1).to_pylist()]
            scores, hits = ([x[k] for x in judged] for k in range(2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(hits, pa.list_(pa.string()))], [id_col, "score", "hits"])

    schema = T.StructType([df.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("hits", T.ArrayType(T.StringType()))])
    return bounded_batches(df).select(id_col, text_col).mapInArrow(run, schema)
