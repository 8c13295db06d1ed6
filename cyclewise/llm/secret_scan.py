"""Secrets, with multipart credentials linked across a document.

Base kinds, as leftmost non-overlapping matches per kind: ``assign`` (a
password-like name, a separator and a value of 6 characters or more),
``access`` (``AKIA`` ..., 20 or more), ``hex`` (24 or more lower-case
hexadecimal digits). A match that fails its length is dropped.

Weak candidates are parts that mean little alone: ``id`` (a client or account
identifier with a cue), ``key`` (a run of 40 base64 characters of mixed kinds)
and ``endpoint`` (a service URL or host with a cue). They are reported, as
``weak_id``, ``weak_key`` and ``weak_endpoint``, only if parts of the other two
roles start within ``scope`` code points: an identifier needs a secret, a
secret needs an identifier or an endpoint, an endpoint needs a secret. Base
matches take part as identifiers (access) and secrets (assign, hex).

The link is an interval join: documents are cut into intervals of ``scope``
code points; per document, interval and role only the first and last start are
kept, and each part meets its own interval and the two beside it. Two parts of
one interval are always in reach; of a neighbour the last (or first) start
decides. So a document with any number of parts costs three small rows per
part, and no pairs are made.

Everything is built-in expressions. Texts are read once; each of the six
patterns tests a text, and goes over it twice or three times more if it holds a
match. Positions are blocked running sums of lengths, so a text may hold any
number of matches. The parts, a small table, are written before they are joined, under a row number of that table, so
repeated rows and null ids stay apart. Null text counts as empty and has no
spans. Only the id column is carried along, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BASE = ("assign", "access", "hex")
WEAK = ("weak_id", "weak_key", "weak_endpoint")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: runs of one character class are maximal, so the length can stand in the pattern
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
WEAK_ID = r"(?i:client|account|access|tenant|user)[_-]?(?i:id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_-]{6,}"
WEAK_KEY = r"(?<![A-Za-z0-9/+_=-])(?=[A-Za-z0-9/+]{0,39}[a-z])(?=[A-Za-z0-9/+]{0,39}[A-Z])(?=[A-Za-z0-9/+]{0,39}[0-9])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+_=-])"
WEAK_ENDPOINT = r"(?i:endpoint|host|base_?url|server)[\"']?\x20*[:=]\x20*[\"']?(?:https?://)?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++(?::[0-9]+)?"
ROLES = {"assign": "secret", "hex": "secret", "weak_key": "secret", "access": "identifier", "weak_id": "identifier", "weak_endpoint": "endpoint"}
NEEDS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}

LEAST_VALUE = 6
#: matches whose positions are added up at once
BLOCK = 64
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def lengths(text: Column, pattern: str) -> Column:
    """(gap, size) of each match: its length, and that of the text before it
    back to the match before. Empty without a match."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(gaps, found, lambda g, m: F.struct(F.char_length(g).cast("long").alias("gap"), F.char_length(m).cast("long").alias("size")))
    # what follows the last match has no size
    return F.when(text.rlike(pattern), F.filter(both, lambda x: x["size"].isNotNull())).otherwise(F.array().cast("array<struct<gap:bigint,size:bigint>>"))


def running(values: Column) -> Column:
    """0 and the running sums of an array of longs. Each step of ``aggregate``
    copies what it has, so this is for short arrays."""
    return F.aggregate(values, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def with_spans(df: DataFrame, text: Column, patterns: dict[str, str]) -> DataFrame:
    """``df`` with the spans of all matches of each kind as ``_<kind>``.
    Positions are running sums of the lengths, taken in blocks of ``BLOCK``
    matches and then over the blocks, so that many matches cost little more
    than few. One step each, so that no step is evaluated twice."""

    def block(k: str) -> Column:
        starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(f"_l_{k}") - 1, F.lit(0)) / BLOCK).cast("int"))
        each = F.transform(starts, lambda i: F.slice(f"_l_{k}", i * BLOCK + 1, BLOCK))
        return F.transform(each, lambda b: F.struct(b.alias("b"), running(F.transform(b, lambda x: x["gap"] + x["size"])).alias("ends")))

    def spans(k: str) -> Column:
        before = running(F.transform(f"_b_{k}", lambda b: F.element_at(b["ends"], -1)))

        def of_block(b: Column, at: Column) -> Column:
            ends = F.slice(b["ends"], 2, BLOCK)
            return F.zip_with(b["b"], ends, lambda x, e: F.struct(F.lit(k).alias("kind"), (at + e - x["size"]).alias("start"), (at + e).alias("end")))

        # one more sum than blocks: what lies before a block that is not there
        return F.flatten(F.filter(F.zip_with(f"_b_{k}", before, lambda b, at: F.when(b.isNotNull(), of_block(b, at))), lambda s: s.isNotNull())).cast(SPAN)

    df = df.withColumns({f"_l_{k}": lengths(text, p) for k, p in patterns.items()})
    df = df.withColumns({f"_b_{k}": block(k) for k in patterns})
    return df.withColumns({f"_{k}": spans(k) for k in patterns})


def parts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    df = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")
    df = with_spans(df, text, {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "weak_id": WEAK_ID, "weak_key": WEAK_KEY, "weak_endpoint": WEAK_ENDPOINT})
    # a name with a short value is no secret
    sizes = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)), F.char_length)
    long = F.filter(F.zip_with("_assign", sizes, lambda s, n: F.struct(s.alias("s"), n.alias("n"))), lambda x: x["n"] >= LEAST_VALUE)
    assign = F.when(F.size("_assign") > 0, F.transform(long, lambda x: x["s"])).otherwise(F.col("_assign"))
    return df.select(F.col(id_col), F.monotonically_increasing_id().alias("_row"), F.concat(assign, "_access", "_hex").alias("_base"), F.concat(*(f"_{k}" for k in WEAK)).alias("_weak"))


def _role(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), kind)


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """One row per row of ``df``: the id column and ``spans``, an array of
    (kind, start, end): base kinds and linked weak ones by start, then kind."""
    found = materialise(parts(df, id_col, text_col), "secret-parts")
    # only documents with a weak candidate have anything to link
    each = (
        found.where(F.size("_weak") > 0)
        .select("_row", F.explode(F.concat("_base", "_weak")).alias("s"))
        .select("_row", "s", _role(F.col("s.kind")).alias("role"), F.floor(F.col("s.start") / scope).alias("bin"))
    )
    ends = each.groupBy("_row", "role", "bin").agg(F.min("s.start").alias("first"), F.max("s.start").alias("last"))
    weak = each.where(F.col("s.kind").isin(*WEAK))
    needs = F.create_map(*[x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asked = weak.select("_row", "s", F.explode(F.element_at(needs, F.col("role"))).alias("role"), "bin").select("_row", "s", "role", F.col("bin").alias("own"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    near = asked.join(ends, ["_row", "role", "bin"])
    start = F.col("s.start")
    reach = (F.col("bin") == F.col("own")) | ((F.col("bin") < F.col("own")) & (F.col("last") >= start - scope)) | ((F.col("bin") > F.col("own")) & (F.col("first") <= start + scope))
    linked = near.where(reach).groupBy("_row").agg(F.array_sort(F.collect_set("s")).alias("_linked"))
    out = found.join(linked, "_row", "left")
    order = F.create_map(*[x for i, k in enumerate((*BASE, *WEAK)) for x in (F.lit(k), F.lit(i))])

    def by_start(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("o"), s["end"].alias("end"), s["kind"].alias("kind"))

    def sort(c: Column) -> Column:
        return F.transform(F.array_sort(F.transform(c, by_start)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return out.select(id_col, sort(F.concat("_base", F.coalesce("_linked", F.array().cast(SPAN)))).alias("spans"))
