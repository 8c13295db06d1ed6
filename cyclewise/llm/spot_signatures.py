"""Document fingerprints from spot signatures.

A signature is a common word (the anchor) with the chain of the next
``CHAIN`` content words after it; common words in between are skipped. The
fingerprint of a text is the set of its signatures, as sorted 32-bit hashes;
likeness is the Jaccard similarity of two such sets. A text without a single
chain takes its distinct words as signatures, so that texts without common words
still differ; a text without words has the empty fingerprint, which is like
another empty one (1) and unlike all others (0).

:func:`similar_pairs` finds all pairs of fingerprints of a given likeness.
Fingerprints are partitioned by set length, in classes so wide that a partner
lies in the same class or the next; within them, an inverted index over the
rarest signatures (as many as a likeness of ``threshold`` can miss, and one)
gives candidates, the length bound prunes them, and full sets decide. Equal
fingerprints are one entry, so copies are never paired with each other.

:func:`with_next` puts each document beside the next in order of descending
id (the first follows the last). Ids are ordered in ranges, only their edges
are ordered across ranges; texts are shuffled once, and of the next document only
the head that is needed and its signatures travel to their target.

Built-in expressions throughout. Null text counts as empty. Null ids come last;
rows with equal id are ordered by a hash of the text; rows equal in both are one
document, its result repeated. A lone document is its own next. Only the id is
carried along, so no names can clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, shuffle_partitions
from .decontaminate import normalised

#: frequent function words of English, French, German and Spanish
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec dans de des du elle en est et il la le les ne pas pour que qui sur un une "
    "auf das dem den der die ein eine im ist mit nicht sich und von zu "
    "con del el los las no para por se su una y"
).split()
CHAIN = 2


def any_of(words: tuple | list) -> str:
    """A pattern for any of the words, by common beginnings: a matcher tries
    some twenty first letters instead of every word."""

    def node(rest: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in rest:
            if w:
                heads.setdefault(w[0], []).append(w[1:])
        parts = [re.escape(c) + node(tails) for c, tails in sorted(heads.items())]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
        return f"(?:{body})?" if "" in rest else body

    return node(sorted(set(words)))


def signatures(df: DataFrame, text_col: str, out: str, anchors: tuple | list = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """``df`` with the sorted, distinct signature hashes of a text as ``out``.

    A text is cut once into units, a content word with the run of common words
    before it; the runs are never looked through again, so the work is in
    proportion to the text however many common words follow each other."""
    # common words that end a text belong to no content word: a last word of no text closes them
    units = F.regexp_extract_all(F.concat("_words", F.lit(" \n")), F.lit(rf"(?:{any_of(anchors)} )*+[^ ]++"), F.lit(0))
    last = F.transform("_units", lambda u: F.nullif(F.substring_index(u, " ", -1), F.lit("\n")))
    follow = F.col("_content")
    for i in range(1, chain):
        # a null from beyond the end makes the whole chain null
        follow = F.zip_with(follow, F.slice("_content", i + 1, F.greatest(F.size("_content"), F.lit(1))), lambda x, y: F.concat(x, F.lit(" "), y))

    def of_unit(u: Column, c: Column) -> Column:
        run = F.split(u, " ")
        spots = F.transform(F.array_distinct(F.slice(run, 1, F.size(run) - 1)), lambda w: F.hash(F.concat(w, F.lit(" "), c)))
        return F.when(c.isNotNull() & F.contains(u, F.lit(" ")), spots).otherwise(F.array().cast("array<int>"))

    plain = F.transform(F.filter(F.split("_words", " "), lambda w: w != ""), lambda w: F.hash(w))
    # one step each, so that no step is evaluated twice
    df = df.withColumn("_words", normalised(F.col(text_col))).withColumn("_units", units).withColumn("_content", last)
    df = df.withColumn("_spots", F.array_distinct(F.flatten(F.zip_with("_units", follow, of_unit))))
    found = F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(F.array_distinct(plain))
    return df.withColumn(out, F.array_sort(found)).drop("_words", "_units", "_content", "_spots")


def fingerprint(sigs: Column) -> Column:
    return F.concat_ws(",", sigs.cast("array<string>"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures."""
    common = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - common
    return F.when(both == 0, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / both)


def similar_pairs(prints: DataFrame, key: str, sigs: str, threshold: float) -> DataFrame:
    """(a, b, likeness) of pairs of entries with likeness of ``threshold`` or
    more, a the lesser key; ``prints`` has one row per distinct fingerprint.
    Empty fingerprints have no partners."""
    base = prints.select(F.col(key).alias("key"), F.col(sigs).alias("sigs"), F.size(sigs).alias("n")).where(F.col("n") > 0)
    # class c holds the lengths from t**-c up to t**-(c+1): a partner is at most one class away
    base = base.withColumn("class", F.floor(-F.log("n") / F.log(F.lit(threshold)) + F.lit(1e-9)).cast("int"))
    each = base.select("key", "n", "class", F.explode("sigs").alias("sig"))
    rarity = each.groupBy("sig").agg(F.count("*").alias("f"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("f", "sig"))
    prefix = each.join(rarity, "sig").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    left = prefix.select("sig", F.col("key").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"))
    right = prefix.select("sig", F.col("key").alias("b"), F.col("n").alias("nb"), "class")
    ordered = ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") >= threshold * F.col("nb") - 1e-9)
    met = left.join(right, ["sig", "class"]).where(ordered).select("a", "b").distinct()
    side = base.select("key", "sigs")
    out = met.join(side.toDF("a", "sa"), "a").join(side.toDF("b", "sb"), "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb"))).where(F.col("likeness") >= threshold)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def next_documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dk, th, n, ndk, nth): every document, its length, and the next."""
    ids = df.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("dk"), F.xxhash64(text_col).alias("th"), F.coalesce(F.char_length(text_col), F.lit(0)).alias("n")).dropDuplicates(["dk", "th"])
    order = [F.col("id").desc_nulls_last(), F.col("th")]
    ids = materialise(ids.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("part", F.spark_partition_id()), "spot-ids")
    w = Window.partitionBy("part").orderBy(*order)
    ids = ids.withColumn("next", F.lead(F.struct("dk", "th")).over(w)).withColumn("rank", F.row_number().over(w))
    # one row per range: the first of the next range, after the last that of the first
    across = Window.orderBy("part")
    edges = ids.where(F.col("rank") == 1).select("part", F.struct("dk", "th").alias("first"))
    edges = edges.withColumn("after", F.coalesce(F.lead("first").over(across), F.first("first").over(across))).select("part", "after")
    ids = ids.join(edges, "part").withColumn("next", F.coalesce("next", "after"))
    return materialise(ids.select("id", "dk", "th", "n", F.col("next.dk").alias("ndk"), F.col("next.th").alias("nth")), "spot-next")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id column, ``text``, ``edited`` (the last
    third of its characters replaced by as many of the next document's first),
    and the signatures ``sigs``, ``edited_sigs`` and ``next_sigs``."""
    following = next_documents(df, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the same columns on both paths, so that the texts are shuffled once
    texts = signatures(df.select(F.xxhash64(id_col).alias("dk"), F.xxhash64(text_col).alias("th"), text.alias("text")), "text", "sigs")
    third = F.floor(F.col("n") / 3).cast("int")
    wanted = following.select(F.col("ndk").alias("dk"), F.col("nth").alias("th"), F.col("dk").alias("to_dk"), F.col("th").alias("to_th"), "n")
    heads = texts.join(wanted, ["dk", "th"]).select(F.col("to_dk").alias("dk"), F.col("to_th").alias("th"), F.substring("text", F.lit(1), third).alias("head"), F.col("sigs").alias("next_sigs"))
    heads = heads.dropDuplicates(["dk", "th"])
    own = texts.join(following.select("dk", "th", "id", "n"), ["dk", "th"]).join(heads, ["dk", "th"])
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - third), F.col("head"))
    out = own.select(F.col("id").alias(id_col), "text", "n", edited.alias("edited"), "sigs", "next_sigs")
    return signatures(out, "edited", "edited_sigs")
