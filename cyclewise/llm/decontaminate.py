"""Benchmark decontamination by a prefix-filtered set join.

Words are runs of letters and digits (every character above ASCII counts as a
letter), A-Z lower-cased. A window is ``window`` consecutive words of an item, or
the whole item if it is shorter. A document word inside any occurrence of a
window is hit.

1. Documents are scanned once: every shingle (``shingle`` consecutive words)
   that also occurs in the benchmark is kept as (row, position, shingle id).
   The join is on the shingle itself, so ids are exact. Each document adds one
   row of its own (shingle -1), so nothing is lost and texts are not read
   again. This table is written once.
2. Shingles are ordered by rarity in the whole corpus. All shingles of a window
   must occur, so its prefix is its rarest shingle alone: documents without it
   are never looked at.
3. Prefix matches give candidates (row, item, diagonal) within the positional
   and length bounds: the window must begin and end inside the document.
4. Candidates are verified over item-sized windows: on a diagonal, the
   consecutive shingles of a window must all be there.

The benchmark is broadcast only if its bytes stay under ``broadcast_bytes``;
beyond that the same joins shuffle. Built-in expressions throughout.

Null text has no words. Items without words have no windows; items with equal
ids are one item in the list, items with null ids hit words but are not listed.
Rows are told apart by a row number of the written table, so repeated rows each
get their result. Only the id column is carried along. An empty benchmark hits
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import ascii_lower

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """Words joined by one space."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))


def shingles(words: Column, k: int) -> Column:
    """All runs of k words, in order: the look-ahead takes k words, the match
    itself moves on by one."""
    return F.regexp_extract_all(words, F.lit(rf"(?=([^ ]++(?: [^ ]++){{{k - 1}}}))[^ ]++"), F.lit(1))


def _n_words(words: Column) -> Column:
    return F.when(words == "", 0).otherwise(F.size(F.split(words, " ")))


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, shingle: int = 5, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """One row per row of ``df``: the id column, ``dk`` and ``th`` (hashes of id
    and text, to join decisions back), ``n_words``, ``hits`` (merged word
    intervals, end exclusive) and ``items`` (ids as strings, sorted)."""
    items = materialise(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("string").alias("item_id"), normalised(F.col(item_text_col)).alias("words")), "bench-items")
    items = items.withColumn("n", _n_words(F.col("words"))).where(F.col("n") > 0)
    shortest, size = items.agg(F.min("n"), F.sum(F.octet_length("words"))).first()
    k = max(1, min(shingle, window, shortest or 1))
    # an item of B bytes has fewer than B/2 + 1 words, its shingles less than k * B bytes
    small = (size or 0) * k <= broadcast_bytes
    hint = F.broadcast if small else (lambda x: x)

    occ = items.select("item", "n", F.posexplode(shingles(F.col("words"), k)).alias("ipos", "shingle"))
    vocab = materialise(occ.select("shingle").distinct().select("shingle", F.monotonically_increasing_id().alias("sid")), "bench-shingles")
    occ = materialise(occ.join(vocab, "shingle").select("item", "n", "ipos", "sid"), "bench-places")

    own = vocab.sparkSession.createDataFrame([("", -1)], "shingle string, sid long")
    words = df.select(F.col(id_col), F.xxhash64(F.col(id_col)).alias("dk"), F.xxhash64(F.col(text_col)).alias("th"), F.monotonically_increasing_id().alias("row"), normalised(F.col(text_col)).alias("words"))
    cut = words.withColumn("sh", shingles(F.col("words"), k))
    n_words = F.when(F.size("sh") > 0, F.size("sh") + (k - 1)).otherwise(_n_words(F.col("words")))
    each = cut.select(id_col, "dk", "th", "row", n_words.alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "sh")).alias("pos", "shingle"))
    found = materialise(each.join(hint(vocab.unionByName(own)), "shingle").select(id_col, "dk", "th", "row", "n_words", (F.col("pos") - 1).alias("pos"), "sid"), "bench-hits")
    places = found.where(F.col("sid") >= 0).select("row", "n_words", "pos", "sid")

    # the rarest shingle of every window
    span = F.least(F.lit(window), F.col("n"))
    rarity = places.groupBy("sid").agg(F.count("*").alias("f"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("ipos") - span + k), F.least(F.col("ipos"), F.col("n") - span))
    windows = occ.join(rarity, "sid", "left").select("item", "n", "ipos", "sid", F.coalesce("f", F.lit(0)).alias("f"), F.explode(starts).alias("w"))
    prefix = windows.groupBy("item", "n", "w").agg(F.min(F.struct("f", "sid", "ipos")).alias("p")).where(F.col("p.f") > 0)
    prefix = prefix.groupBy("item", "n", F.col("p.sid").alias("sid"), F.col("p.ipos").alias("ipos")).agg(F.min("w").alias("w_min"), F.max("w").alias("w_max"))
    diagonal = F.col("pos") - F.col("ipos")
    candidates = places.join(hint(prefix), "sid").where((diagonal + F.col("w_max") >= 0) & (diagonal + F.col("w_min") + span <= F.col("n_words"))).select("row", "item", diagonal.alias("diagonal")).distinct()

    on_line = places.join(hint(occ), "sid").select("row", "item", "n", "pos", diagonal.alias("diagonal")).join(candidates, ["row", "item", "diagonal"], "left_semi")
    run = F.col("pos") - F.row_number().over(Window.partitionBy("row", "item", "diagonal").orderBy("pos"))
    runs = on_line.withColumn("run", run).groupBy("row", "item", "n", "diagonal", "run").agg(F.min("pos").alias("start"), F.count("*").alias("c"))
    runs = runs.where(F.col("c") >= span - k + 1).select("row", "item", "start", (F.col("start") + F.col("c") + (k - 1)).cast("int").alias("end"))
    named = runs.join(hint(items.select("item", "item_id")), "item")

    # merge overlapping intervals of a document
    w = Window.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = runs.select("row", "start", "end").distinct().withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("start")).cast("int")).withColumn("g", F.sum("new").over(w))
    merged = merged.groupBy("row", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    hits = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hits"))
    listed = named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    docs = found.where(F.col("sid") == -1).select(id_col, "dk", "th", "row", "n_words")
    out = docs.join(hits, "row", "left").join(listed, "row", "left")
    return out.select(
        id_col,
        "dk",
        "th",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("hits", F.array().cast("array<struct<start:int,end:int>>")).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def n_hit() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])


def contaminated(share: int = 20) -> Column:
    """At least one word hit, and one word in ``share`` or more."""
    return (n_hit() > 0) & (n_hit() * share >= F.col("n_words"))
