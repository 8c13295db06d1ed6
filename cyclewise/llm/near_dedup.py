"""Near-duplicate documents: SetSketch registers, bands, likelihood, proof.

A document's set holds its distinct runs of ``shingle`` words (A-Z lower-cased,
ASCII white space between words); a shorter text is one run, a text without
words has an empty set and is linked with nothing. Two documents are linked if
their Jaccard similarity is at least ``threshold``; components are what links
reach.

1. *Sketch.* Each of ``BANDS * ROWS`` registers keeps the smallest of the set's
   exponentially distributed hash values on an exponential scale, truncated to
   a byte: K = clip(floor(1 - log_b(min h)), 0, 255). Registers merge by
   maximum and agree with a probability close to the similarity.
2. *Copies* (equal word sequences) become one vertex, known by a 128-bit hash.
3. *Bands.* Vertices that agree in all registers of a band share a bucket. A
   bucket is not expanded into pairs: each member meets only the bucket's
   smallest set, its centre, and its hub, the member with most company over all
   its buckets. An original is closer to its copies than they are to each other,
   so it shares most buckets and becomes their hub; most of a group of copies is
   thus one component at once, and what is left for the later levels is small.
4. *Likelihood.* For a bucket of two, the similarity is estimated jointly from
   the numbers of larger, smaller and equal registers and the set sizes; a
   pair for which ``threshold`` is less likely than the best estimate by a
   factor of e^16 or more is dropped.
5. *Proof.* All other pairs are compared on full sets.
6. *No lost links.* Let c be a centre, x a member with J(x, c) < t and y another
   member. As |y| >= |c|, a link between x and y needs a shingle that both have
   and c has not: else |x & y| <= |x & c| and so J(x, y) <= J(x, c) < t. It even
   needs t / (1 + t) * (|x| + |c|) - |x & c| such extra shingles. So only extras
   that members of different components share count; a member with fewer of them
   than it needs is done with c, and of the others only a prefix in order of
   rarity is kept, as in a prefix-filtered join. (centre, extra) is the bucket
   of the next level; of a centre's buckets with the same members (known by
   count and a 128-bit hash) one is enough. Where a bucket of m members holds at most ``MEET`` * m pairs
   of different components, these meet; other buckets get their smallest set as
   centre again, which then leaves. So a bucket costs a bounded number of pairs a
   member whatever its size, and a group of g near copies about g comparisons a
   band, not g * g. Levels go on until no pair is left.
7. *Components* by repeated minimum labels over the links. Links of later levels
   are kept as links between labels, and only where those differ, so that the
   links of one group of copies are not carried from level to level.

Sets are compared as 64-bit hashes of shingles. Nothing but table sizes and
counts of changed labels reaches the driver; joins on hot vertices are plain
equi-joins, which adaptive execution splits.

Null ids take part; a component of null ids alone has a null id and keeps its
rows. Rows equal in id and text are one document with repeated results. An
empty table gives none. Only the id is carried along, with ``dk`` and ``th``
(hashes of id and text) to join decisions back, so no names can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import bounded_batches

BANDS, ROWS = 40, 6
#: scale and rate of the registers
BASE, RATE = 1.1, 20.0
#: factor (as a logarithm) by which a similarity must be unlikelier to be ruled out
MARGIN = 16.0
#: pairs a member up to which the components of a bucket meet at the second,
#: third and every later level, as fewer members are left
MEET = (2, 16, 128)
#: buckets of a member that are looked back on for one where a pair has met
BEFORE = 16
MEMO = 150_000
_M = np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(29)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """Word hashes, remembered per Python worker within a bound."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def hashes(self, text: bytes) -> np.ndarray:
        import xxhash

        words = text.lower().split()  # of bytes: A-Z and ASCII white space only
        got = list(map(self.memo.get, words))
        if None in got:
            if len(self.memo) > MEMO:
                self.memo.clear()
            for i, g in enumerate(got):
                if g is None:
                    got[i] = self.memo[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        return np.array(got, np.uint64)

    def shingles(self, text: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes, and the sorted set of shingle hashes."""
        w = self.hashes(text)
        if not len(w):
            return w, w
        k = min(k, len(w))
        n = len(w) - k + 1
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h = _mix(h * _M + w[i : i + n])
        return w, np.unique(h)


@cache
def _functions(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 2**63, m, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, m, np.uint64)


def set_sketch(shingles: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    a, b = _functions(m)
    low = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] * a
        part += b
        np.minimum(low, part.min(axis=0), out=low)
    u = (low.astype(np.float64) + 0.5) / 2.0**64
    h = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, 255).astype(np.uint8)


def likely(more: np.ndarray, less: np.ndarray, same: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a similarity of ``threshold`` or more can't be ruled out, from
    the registers that are larger, smaller and equal, jointly with set sizes."""
    u = (na / (na + nb))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :]

    def loglik(j: np.ndarray) -> np.ndarray:
        def p(x):
            return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)

        up, down = p(u - v * j), p(v - u * j)
        equal = np.clip(1 - up - down, 1e-9, 1)
        return more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(equal)

    best = loglik(grid * top).max(axis=1)
    above = loglik(threshold + np.linspace(0, 1, 31)[None, :] * np.maximum(0, top - threshold)).max(axis=1)
    return (best - above < MARGIN) & (top[:, 0] >= threshold * 0.999)


def sketches(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, dk, th, h1, h2, n, registers) per row; no hash for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words = Words()
        done: dict[bytes, tuple] = {}
        for b in batches:
            out = []
            for t in b.column(3).cast(pa.binary()).to_pylist():
                w, s = words.shingles(t or b"", shingle)
                if not len(w):
                    out.append((None, None, 0, None))
                    continue
                key = xxhash.xxh3_128_digest(b" ".join(t.lower().split()))
                if key not in done:
                    if len(done) > 2000:
                        done.clear()
                    done[key] = (int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True), len(s), set_sketch(s).tobytes())
                out.append(done[key])
            h1, h2, n, r = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.binary())], ["id", "dk", "th", "h1", "h2", "n", "registers"])

    c = df.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("dk"), F.xxhash64(text_col).alias("th"), F.col(text_col))
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in ("dk", "th", "h1", "h2", "n")), T.StructField("registers", T.BinaryType())])
    return bounded_batches(c).mapInArrow(run, schema)


_PROVEN = "a long, b long, crowd long, n long, linked boolean, need long, extras array<long>"


def prove(pairs: DataFrame, vertices: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Compare (a, b, crowd) on full sets: whether they are linked, and what a
    has and b has not, where more than two met."""
    side = vertices.select("vid", "n", "registers", "text")
    a = pairs.join(side.toDF("a", "na", "ra", "ta"), "a")
    # rows of one centre come together, as this join sorts by it
    both = a.join(side.toDF("b", "nb", "rb", "tb"), "b").select("a", "b", "crowd", "na", "nb", "ra", "rb", "ta", "tb")
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        centre: tuple = (None, None)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                r = whole.slice(at, 512)
                ids_a, ids_b, crowd, na, nb = (r.column(i).to_numpy() for i in range(5))
                ra, rb = (np.frombuffer(b"".join(r.column(i).to_pylist()), np.uint8).reshape(r.num_rows, -1).astype(np.int16) for i in (5, 6))
                open_ = likely((ra > rb).sum(1), (ra < rb).sum(1), (ra == rb).sum(1), na.astype(float), nb.astype(float), threshold)
                keep = np.flatnonzero(open_ | (crowd > 2))
                rows = []
                for i in keep.tolist():
                    if centre[0] != ids_b[i]:
                        centre = (ids_b[i], words.shingles(r.column(8)[i].as_py().encode(), shingle)[1])
                    sa, sb = words.shingles(r.column(7)[i].as_py().encode(), shingle)[1], centre[1]
                    extras = np.setdiff1d(sa, sb, assume_unique=True)
                    common = len(sa) - len(extras)
                    linked = 100 * common >= percent * (len(sa) + len(sb) - common)
                    # shared extras that a link to another member takes, whose set is no smaller than b
                    need = max(1, -(-percent * len(sa) // 100) - common, -(-percent * (len(sa) + len(sb)) // (100 + percent)) - common)
                    rows.append((linked, need, extras.astype(np.int64) if crowd[i] > 2 else None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids_a[keep]), pa.array(ids_b[keep]), pa.array(crowd[keep]), pa.array(na[keep]), pa.array([x[0] for x in rows], pa.bool_()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.list_(pa.int64()))],
                    ["a", "b", "crowd", "n", "linked", "need", "extras"],
                )

    return materialise(bounded_batches(both).mapInArrow(run, _PROVEN), "near-proven")


def centre_pairs(members: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(a, b, crowd): each member of a bucket with the bucket's centre, its
    smallest set, and as a pair of its own (crowd 2) with the bucket's hub, the
    member that has most company over all its buckets. The same pair from
    several buckets is one. Among the smallest the one with most company is
    centre."""
    crowds = members.groupBy(*keys).agg(F.count("*").alias("crowd")).where("crowd > 1")
    placed = materialise(members.select("vid", "n", *keys).join(crowds, keys), "near-placed")
    company = placed.where("crowd > 2").groupBy("vid").agg(F.sum("crowd").alias("company"))
    placed = placed.join(company, "vid", "left").withColumn("company", F.coalesce("company", F.lit(0)))
    best = [F.min(F.struct("n", -F.col("company"), "vid"))["vid"].alias("centre"), F.max(F.struct("company", "vid"))["vid"].alias("hub")]
    placed = placed.join(placed.groupBy(*keys).agg(*best), keys)
    # at a later level a bucket keeps its extras even when a pair is left of it
    to_centre = placed.select(F.col("vid").alias("a"), F.col("centre").alias("b"), F.greatest("crowd", F.lit(least)).alias("crowd"))
    to_hub = placed.where("crowd > 2").select(F.col("vid").alias("a"), F.col("hub").alias("b"), F.lit(2).cast("long").alias("crowd"))
    return to_centre.unionByName(to_hub).where("a != b").groupBy("a", "b").agg(F.max("crowd").alias("crowd"))


def meeting(placed: DataFrame) -> DataFrame:
    """Pairs of members of different components in the buckets that have few.
    Members that share many shingles share many buckets of a centre; they meet in
    the first of them (by ``extra``), and in a later one only if no bucket they
    share is among the last ``BEFORE`` of both."""
    own = Window.partitionBy("b", "vid").orderBy("extra").rowsBetween(-BEFORE, -1)
    few = placed.where("few").withColumn("before", F.collect_list("extra").over(own))
    # one side without the bucket's largest component, so that its members don't even meet
    one = few.where("comp != major").select("b", "extra", "major", F.col("vid").alias("x"), F.col("comp").alias("cx"), F.col("before").alias("bx"))
    two = few.select("b", "extra", F.col("vid").alias("y"), F.col("comp").alias("cy"), F.col("before").alias("by"))
    met = one.join(two, ["b", "extra"]).where("cx != cy AND (cy = major OR x < y) AND NOT arrays_overlap(bx, by)")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(2).cast("long").alias("crowd"))


def next_pairs(crowded: DataFrame, label: DataFrame, meet_most: int) -> DataFrame:
    """Pairs that a level leaves open, as (a, b, crowd), from the members that
    were compared with its centres."""
    crowded = crowded.join(label.toDF("a", "comp"), "a", "left").select(F.col("a").alias("vid"), "n", "b", F.coalesce("comp", "a").alias("comp"), "need", "extras")
    two_comps = [F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")]
    apart = crowded.groupBy("b").agg(*two_comps).where("low < high").select("b")
    each = materialise(crowded.join(apart, "b", "left_semi").select("vid", "n", "comp", "need", "b", F.explode("extras").alias("extra")), "near-extras")
    shared = each.groupBy("b", "extra").agg(*two_comps).where("low < high").select("b", "extra", "size")
    own = Window.partitionBy("b", "vid")
    members = each.join(shared, ["b", "extra"]).withColumn("have", F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("size", "extra")))
    members = materialise(members.where(F.col("rank") <= F.col("have") - F.col("need") + 1).select("vid", "n", "comp", "b", "extra", "size"), "near-members")
    one, two = F.bit_xor(F.xxhash64("vid")), F.bit_xor(F.xxhash64(F.lit("k"), "vid"))
    per = members.groupBy("b", "extra", "comp").agg(F.count("*").alias("k"), one.alias("x"), two.alias("y"))
    bucket = per.groupBy("b", "extra").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("same"), F.max(F.struct("k", "comp"))["comp"].alias("major"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("low < high")
    # shingles of one passage have the same members: one of them stands for all
    bucket = bucket.groupBy("b", "all", "x", "y").agg(F.min(F.struct("extra", "same", "major")).alias("s")).select("b", "all", "s.*")
    placed = members.drop("size").join(bucket.select("b", "extra", "major", (F.col("all") * F.col("all") - F.col("same") <= 2 * meet_most * F.col("all")).alias("few")), ["b", "extra"])
    many = centre_pairs(placed.where("NOT few"), ["b", "extra"], least=3)
    return meeting(placed).unionByName(many).groupBy("a", "b").agg(F.max("crowd").alias("crowd"))


def _neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of the links, and each vertex beside itself."""
    ways = [edges.select(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")]
    return materialise(ways[0].unionByName(ways[1]).unionByName(ways[2]).unionByName(ways[3]).distinct(), "near-edges")


def _two_hops(beside: DataFrame, label: DataFrame) -> DataFrame:
    for _ in range(2):
        label = beside.join(label.toDF("b", "comp"), "b").groupBy(F.col("a").alias("vid")).agg(F.min("comp").alias("comp"))
    return label


def group_labels(edges: DataFrame) -> DataFrame:
    """(vid, comp): vertices of one label are connected, though one component
    may still have several labels. Enough to leave pairs out."""
    beside = _neighbours(edges)
    return materialise(_two_hops(beside, beside.groupBy(F.col("a").alias("vid")).agg(F.min("b").alias("comp"))), "near-labels")


def contracted(links: DataFrame, label: DataFrame) -> DataFrame:
    """New links between what they connect: labels that differ, each pair once.
    A vertex without a label yet stands for itself."""
    for v in ("a", "b"):
        links = links.join(label.select(F.col("vid").alias(v), F.col("comp").alias("to")), v, "left").withColumn(v, F.coalesce("to", v)).drop("to")
    return links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vid, comp) of all vertices with an edge: the least vertex reachable."""
    beside = _neighbours(edges)
    label = beside.groupBy(F.col("a").alias("vid")).agg(F.min("b").alias("comp"))
    total = None
    while True:
        near = _two_hops(beside, label)
        jump = near.select(F.col("vid").alias("comp"), F.col("comp").alias("root"))
        label = materialise(near.join(jump, "comp").select("vid", F.col("root").alias("comp")), "near-labels")
        # labels only ever fall, so an equal sum means that none has changed
        before, total = total, label.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return label


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per row of ``df``: the id column, ``dk``, ``th``, ``n_shingles``,
    ``component_id`` (least id), and ``first_dk``, ``first_th`` (the row to keep
    of the component)."""
    rows = materialise(sketches(df, id_col, text_col, shingle), "near-sketches")
    copies = rows.where(F.col("n") > 0).groupBy("h1", "h2").agg(F.min(F.struct(F.col("id").isNull(), "id", "dk", "th")).alias("least"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    copies = materialise(copies.select("h1", "h2", "least", "n", "registers", F.monotonically_increasing_id().alias("vid")), "near-vertices")

    band = F.xxhash64("band", F.substring("registers", F.col("band") * ROWS + 1, F.lit(ROWS)))
    members = copies.select("vid", "n", "registers", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")).select("vid", "n", band.alias("bucket"))
    pairs = materialise(centre_pairs(members, ["bucket"]), "near-pairs")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("vid")).distinct()
    wanted = copies.join(wanted, "vid").select("vid", "n", "registers", F.col("least.dk").alias("dk"), F.col("least.th").alias("th"))
    texts = df.select(F.xxhash64(id_col).alias("dk"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    vertices = materialise(texts.join(wanted, ["dk", "th"]).dropDuplicates(["vid"]).select("vid", "n", "registers", "text"), "near-texts")

    proven = prove(pairs, vertices, shingle, threshold)
    seen = pairs.select("a", "b", F.col("crowd").alias("met"))
    crowded = proven.where(F.col("crowd") > 2)
    edges = proven.where("linked").select("a", "b")
    label = group_labels(edges)
    for level in count():
        # a pair met in a bucket of two has no extras yet
        fresh = next_pairs(crowded, label, MEET[min(level, len(MEET) - 1)]).join(seen, ["a", "b"], "left").where(F.col("met").isNull() | ((F.col("met") == 2) & (F.col("crowd") > 2)))
        pairs = materialise(fresh.select("a", "b", "crowd"), "near-pairs")
        left, centres = pairs.agg(F.count("*"), F.count(F.when(F.col("crowd") > 2, 1))).first()
        if left:
            found = prove(pairs, vertices, shingle, threshold)
            proven = proven.unionByName(found)
            seen = materialise(seen.unionByName(pairs.select("a", "b", F.col("crowd").alias("met"))).groupBy("a", "b").agg(F.max("met").alias("met")), "near-seen")
            edges = materialise(edges.unionByName(contracted(found.where("linked").select("a", "b"), label)), "near-links")
        if not centres:  # every bucket was small: all its pairs have met
            break
        label = group_labels(edges)
        # all members that were ever compared with the centres of this level
        crowded = proven.where(F.col("crowd") > 2).join(pairs.where(F.col("crowd") > 2).select("b").distinct(), "b", "left_semi")
    label = components(edges)

    first = copies.join(label, "vid").groupBy("comp").agg(F.min("least").alias("first"))
    leads = copies.join(label.join(first, "comp").select("vid", "first"), "vid", "left").select("h1", "h2", F.coalesce("first", "least").alias("first"))
    out = rows.drop("registers").join(leads, ["h1", "h2"], "left")
    return out.select(
        F.col("id").alias(id_col),
        "dk",
        "th",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("first.dk")).otherwise(F.col("dk")).alias("first_dk"),
        F.when(F.col("n") > 0, F.col("first.th")).otherwise(F.col("th")).alias("first_th"),
    )
