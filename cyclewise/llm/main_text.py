"""Main text of web pages, with boilerplate found by host suffix arrays.

1. *Parse.* A page becomes blocks of text in page order. Scripts, styles,
   comments in the markup and form controls are no text. A block is *marked* if
   it stands in an element that is boilerplate by its name (nav, header, footer,
   aside, form ...) or by a word of its class, id or role (ad, menu, sidebar,
   cookie, comments ...; inside an article only by a whole class or role, or an
   id that is such a word); *main* if it stands in ``article`` or ``main`` and is
   not marked; else *open*. A page with main blocks has no open ones: what is
   outside its article is marked. An element that is never closed ends where
   its parent does, or as HTML has it (a paragraph at the next block, an item at
   the next item), so that it takes no more of the page with it.
2. *Host suffix arrays.* What is not main is, as a stream of tokens (the
   element, then the words of each block), put together with the streams of
   other pages of its host, a separator after each page. A suffix array with
   longest common prefixes (prefix doubling, numpy) gives all substrings of at
   least ``min_tokens`` tokens that occur in at least ``min_pages`` distinct
   pages; their tokens are covered.
3. *Keep.* Main blocks stay, as repeated passages of articles are text all the
   same. Open blocks that are covered go, others lose their covered runs of
   ``min_tokens`` words or more; unique runs stay.

A host's pages are dealt by hash into groups of about ``group_pages`` pages, so
a host with a third of all pages is many groups, each with its own array. Pages
count over the whole host: the groups' counts per substring of ``min_tokens``
tokens are summed in a shuffle by the substring's key, and each group covers what
repeats in the host as well. The result does not depend on the groups. Only
streams and these counts are shuffled. On pages whose markup
names the article, the markup alone decides about text, and the suffix arrays
show in ``n_repeated`` (covered tokens).

Character references are decoded, white space inside a block is one space,
blocks are joined by one newline. Null html is empty text; a page without
blocks has empty text. A null url is the host ''. Pages are told apart by a row
number of the parsed table, so repeated rows each have their result. Only id
and url are carried along.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import bounded_batches

# raw text elements first: what looks like a tag inside them is none
_piece = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|textarea|iframe|title)\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[/!?][^>]*>",
    re.S | re.I,
)
_named = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_word = re.compile(r"[a-z]+")
BOILERPLATE = frozenset("nav header footer aside form menu dialog head".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header "
    "cookie cookies consent notice popup modal newsletter subscribe signup login share sharing social related comment comments disqus pagination pager search skip toolbar widget".split()
)
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("svg button select object noscript template".split())
# start tags that end open elements: which, and what they do not reach beyond
_P = (frozenset(["p"]), frozenset("table caption td th template".split()))
_ITEM = frozenset("ul ol dl menu table td th template article main section nav aside header footer form fieldset blockquote details dialog figure".split())
ENDS = {
    **dict.fromkeys("p address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre search section summary table ul".split(), _P),
    "li": (frozenset(["li"]), _ITEM),
    **dict.fromkeys(("dt", "dd"), (frozenset(["dt", "dd"]), _ITEM)),
    **dict.fromkeys(("td", "th"), (frozenset(["td", "th"]), frozenset("tr table template".split()))),
    "tr": (frozenset(["tr"]), frozenset("table template".split())),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset("tbody thead tfoot caption".split()), frozenset("table template".split()))),
    **{x: (frozenset([x]), frozenset(["template"])) for x in ("button", "select")},
    "body": (frozenset(["head"]), frozenset()),
}
# an end tag does not end what is beyond these
_TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
WALLS = {**dict.fromkeys(("article", "main"), frozenset(["template"])), **dict.fromkeys(_TABLE, frozenset("article main template".split()))}
WALL = frozenset("article main td th caption template".split())
# start tags that cannot stand in svg and so end it
HTML_ONLY = ENDS.keys() | frozenset(["br", "img"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN, OPEN, MARKED, SKIP = 0, 1, 2, 3


def _is_marked(name: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element is boilerplate by its name or attributes. Inside an
    article words of a name are no proof (``social-impact``): only whole tokens
    of a class or role count, and ids and labels that are a mark."""
    if name in BOILERPLATE:
        return True
    if not attributes or "=" not in attributes or name in ("body", "html"):
        return False
    for attribute, a, b, c in _named.findall(attributes):
        value = (a or b or c).lower()
        if inside or name in ("article", "main"):
            tokens = value.split() if attribute.lower() in ("class", "role") else [value.strip()]
        else:
            tokens = _word.findall(value)
        if not MARKS.isdisjoint(tokens):
            return True
    return False


def parse(page: str) -> list[tuple[int, str, str]]:
    """(kind, element, text) of the blocks of a page, in page order."""
    blocks: list[tuple[int, str, str]] = []
    text: list[str] = []
    # open elements, as (name, kind); a kind holds until its element ends, which
    # is at the end of its parent at the latest
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    element, any_main = "body", False

    def flush() -> None:
        nonlocal any_main
        if text:
            t = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if t:
                kind = next((k for _, k in reversed(stack) if k != SKIP), OPEN)
                any_main |= kind == MAIN
                blocks.append((kind, element, t))

    def push(name: str, kind: int) -> None:
        stack.append((name, kind))
        opened[name] += 1

    def leave(i: int) -> None:
        opened.subtract(n for n, _ in stack[i:])
        del stack[i:]

    def end(names: frozenset[str], walls: frozenset[str]) -> bool:
        """End the innermost open element of these names, and what is open inside it."""
        if not any(opened[n] for n in names):
            return False
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                if stack[i][1] != SKIP:
                    flush()
                leave(i)
                return True
            if stack[i][0] in walls:
                break
        return False

    at = 0
    for m in _piece.finditer(page):
        if m.start() > at and not (stack and stack[-1][1] == SKIP):
            text.append(page[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name, closing, attributes = name.lower(), m.group(2), m.group(4)
        skipped = bool(stack) and stack[-1][1] == SKIP
        if closing:
            # an end tag without a start still ends a block of text
            if not end(frozenset([name]), WALLS.get(name, WALL)) and name not in INLINE and name not in SKIPPED and not skipped:
                flush()
            continue
        if skipped and opened["svg"] and name in HTML_ONLY:
            # svg ends where a page's own elements begin
            inner = next(i for i in range(len(stack) - 1, -1, -1) if i == 0 or stack[i - 1][1] != SKIP)
            if any(n == "svg" for n, _ in stack[inner:]) and not any(n.lower() in ("foreignobject", "template") for n, _ in stack[inner:]):
                leave(next(i for i in range(inner, len(stack)) if stack[i][0] == "svg"))
        if name in ("article", "main") and not opened["template"]:
            # an element that was never closed does not swallow the article
            while stack and stack[-1][1] == SKIP:
                leave(len(stack) - 1)
        if name in ENDS:
            end(*ENDS[name])
        skipped = bool(stack) and stack[-1][1] == SKIP
        if name in SKIPPED or skipped:
            if name not in VOID and not attributes.endswith("/"):
                push(name, SKIP)
            continue
        inherited = stack[-1][1] if stack else OPEN
        marked = _is_marked(name, attributes, inherited == MAIN)
        if name in INLINE:
            if name == "br":
                text.append(" ")
            if name in VOID or not marked and not opened[name]:
                continue
        flush()
        if name in VOID or attributes.endswith("/"):
            continue
        element = name
        if name in ("body", "html"):
            continue
        if name in ("article", "main"):
            if inherited == MARKED and not marked and not opened["article"] and not opened["main"]:
                leave(0)
                inherited = OPEN
            push(name, MARKED if inherited == MARKED or marked else MAIN)
        elif marked and not (name == "header" and inherited == MAIN):
            push(name, MARKED)
        else:
            push(name, inherited)
    if not (stack and stack[-1][1] == SKIP):
        text.append(page[at:])
    flush()
    return [(MARKED if any_main and k == OPEN else k, e, t) for k, e, t in blocks]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    n, k = len(s), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - k] = rank[k:] if k < n else 0
        order = np.lexsort((after, rank))
        a, b = rank[order], after[order]
        step = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank = np.empty(n, np.int64)
        rank[order] = step
        k *= 2
        if step[-1] == n - 1 or k >= n:
            return order


_NONE = np.empty(0, np.dtype([("g1", np.int64), ("g2", np.int64)]))


def _passages(streams: list[np.ndarray], min_tokens: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All substrings of ``min_tokens`` tokens: where they start in the streams
    put together with a separator after each, the number of the substring at
    each start, and per substring its 128-bit key and number of streams."""
    sizes = np.array([len(x) for x in streams])
    # separators are all different, so nothing repeats across a page's end
    raw = np.concatenate([np.append(x, -1 - i) for i, x in enumerate(streams)])
    _, s = np.unique(raw, return_inverse=True)
    owner = np.repeat(np.arange(len(streams)), sizes + 1)
    ends = np.cumsum(sizes + 1)
    order = suffix_array(s)
    # neighbours in the array that agree in their first min_tokens tokens form a group
    same = np.ones(len(order) - 1, bool)
    for j in range(min_tokens):
        i = np.minimum(order + j, len(s) - 1)
        same &= (s[i[1:]] == s[i[:-1]]) & (order[1:] + j < len(s)) & (order[:-1] + j < len(s))
    group = np.concatenate([[0], np.cumsum(~same)])
    whole = order + min_tokens < ends[owner[order]]
    starts = order[whole]
    _, first, number = np.unique(group[whole], return_index=True, return_inverse=True)
    pages = np.bincount(np.unique(number * len(streams) + owner[starts]) // len(streams), minlength=len(first))
    keys = np.empty(len(first), _NONE.dtype)
    for name, factor in (("g1", 0x100000001B3), ("g2", 0x9E3779B97F4A7C15)):
        h = np.full(len(first), salt & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for j in range(min_tokens):
            h = (h ^ raw[starts[first] + j].astype(np.uint64)) * np.uint64(factor)
            h ^= h >> np.uint64(29)
        keys[name] = h.view(np.int64)
    return starts, number, keys, pages


def passages(streams: list[np.ndarray], min_tokens: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the distinct substrings of ``min_tokens`` tokens, salted with
    what they are counted within, and in how many streams each occurs."""
    return _passages(streams, min_tokens, salt)[2:] if streams else (_NONE, np.empty(0, np.int64))


def covered(streams: list[np.ndarray], min_tokens: int, min_pages: int, salt: int = 0, elsewhere: np.ndarray = _NONE) -> list[np.ndarray]:
    """Which tokens lie in a substring of ``min_tokens`` tokens or more that
    occurs in at least ``min_pages`` distinct streams, or whose parts of
    ``min_tokens`` tokens have keys in ``elsewhere``."""
    if not streams:
        return []
    starts, number, keys, pages = _passages(streams, min_tokens, salt)
    many = pages >= min_pages
    likely = np.flatnonzero(~many & np.isin(keys["g1"], elsewhere["g1"]))
    many[likely] = np.isin(keys[likely], elsewhere)
    starts = starts[many[number]]
    sizes = np.array([len(x) for x in streams])
    ends = np.cumsum(sizes + 1)
    edge = np.zeros(ends[-1] + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + min_tokens, -1)
    flags = np.cumsum(edge[:-1]) > 0
    return [flags[e - n - 1 : e - 1] for e, n in zip(ends, sizes, strict=True)]


def unique_runs(words: list[str], flags: np.ndarray, min_tokens: int) -> list[str]:
    """Words of a block outside its covered runs; a short covered run stays
    unless it is the whole block."""
    if flags.all():
        return []
    out, i = [], 0
    while i < len(words):
        j = i
        while j < len(words) and flags[j] == flags[i]:
            j += 1
        if not flags[i] or j - i < min_tokens:
            out += words[i:j]
        i = j
    return out


def _hash(words: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(w) >> 1 for w in words]


_BLOCKS = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("text", T.StringType())]))
_BLOCKS_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("text", pa.string())]))


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_tokens: int = 6, min_pages: int = 3, group_pages: int = 1000) -> DataFrame:
    """One row per row of ``df``: id, url, ``text`` and ``n_repeated``."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, streams, spans = [], [], []
            for page in b.column(4):
                stay, stream, span = [], [], []
                for kind, element, t in parse(page.as_py() or ""):
                    if kind != MARKED:
                        stay.append({"kind": kind, "text": t})
                    if kind != MAIN:
                        stream += _hash([f"<{element}>"])
                        if kind == OPEN:
                            span.append(len(stream))
                        stream += _hash(t.split(" "))
                kept.append(stay)
                streams.append(stream)
                spans.append(span)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(kept, _BLOCKS_ARROW), pa.array(streams, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.int32()))], ["id", "url", "host", "row", "blocks", "stream", "spans"])

    host = F.lower(F.coalesce(F.regexp_extract(url_col, "//([^/?#]*)", 1), F.lit("")))
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.monotonically_increasing_id().alias("row"), F.col(html_col).alias("html"))
    fields = [T.StructField("id", df.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("host", T.StringType()), T.StructField("row", T.LongType())]
    schema = T.StructType([*fields, T.StructField("blocks", _BLOCKS), T.StructField("stream", T.ArrayType(T.LongType())), T.StructField("spans", T.ArrayType(T.IntegerType()))])
    parsed = materialise(bounded_batches(pages).mapInArrow(blocks, schema), "page-blocks")

    streams = parsed.where(F.size("stream") > 0).select("host", "row", "stream")
    groups = streams.groupBy("host").agg(F.ceil(F.count("*") / group_pages).alias("groups"))
    group = F.xxhash64("host", F.pmod(F.xxhash64("row"), F.col("groups"))).alias("group")
    dealt = streams.join(groups, "host").select("row", "stream", "groups", F.xxhash64("host").alias("salt"), group)

    def unpacked(table: pa.Table) -> list[np.ndarray]:
        return [x.values.to_numpy() for x in table.column("stream").combine_chunks()]

    def flagged(table: pa.Table, elsewhere: np.ndarray = _NONE) -> pa.Table:
        salt = table.column("salt")[0].as_py() if table.num_rows else 0
        found = covered(unpacked(table), min_tokens, min_pages, salt, elsewhere)
        return pa.table({"row": table.column("row"), "n_repeated": pa.array([int(f.sum()) for f in found], pa.int64()), "flags": pa.array([np.packbits(f).tobytes() for f in found], pa.binary())})

    def repeats(table: pa.Table) -> pa.Table:
        return flagged(table)

    # hosts of several groups: what each group counts is summed over the host,
    # and a group hears of the passages that only the sum makes repeated
    def counts(table: pa.Table) -> pa.Table:
        keys, n = passages(unpacked(table), min_tokens, table.column("salt")[0].as_py())
        return pa.table({"group": pa.array(np.full(len(n), table.column("group")[0].as_py(), np.int64)), "g1": pa.array(keys["g1"]), "g2": pa.array(keys["g2"]), "n": pa.array(n.astype(np.int64))})

    def together(table: pa.Table, heard: pa.Table) -> pa.Table:
        elsewhere = np.empty(heard.num_rows, _NONE.dtype)
        for name in ("g1", "g2"):
            elsewhere[name] = heard.column(name).to_numpy()
        return flagged(table, elsewhere)

    flag_schema = "row long, n_repeated long, flags binary"
    one, several = dealt.where(F.col("groups") == 1), dealt.where(F.col("groups") > 1)
    found = several.groupBy("group").applyInArrow(counts, "group long, g1 long, g2 long, n long")
    found = found.withColumn("total", F.sum("n").over(Window.partitionBy("g1", "g2")))
    heard = found.where((F.col("total") >= min_pages) & (F.col("n") < min_pages)).select("group", "g1", "g2")
    flags = one.groupBy("group").applyInArrow(repeats, flag_schema)
    flags = flags.unionByName(several.groupBy("group").cogroup(heard.groupBy("group")).applyInArrow(together, flag_schema))
    # only pages with open blocks wait for their flags as text; the others need the count alone
    has_open = F.exists("blocks", lambda x: x["kind"] == OPEN)
    text = F.concat_ws("\n", F.transform("blocks", lambda x: x["text"]))
    flags = materialise(flags, "page-repeats")
    sure = parsed.where(~has_open).select("id", "url", "row", text.alias("text")).join(flags.select("row", "n_repeated"), "row", "left").drop("row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for blocks_, spans, flag in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                bits = np.unpackbits(np.frombuffer(flag or b"", np.uint8))
                lines, k = [], 0
                for x in blocks_:
                    t = x["text"]
                    if x["kind"] == OPEN:
                        words = t.split(" ")
                        t = " ".join(unique_runs(words, bits[spans[k] : spans[k] + len(words)], min_tokens))
                        k += 1
                    if t:
                        lines.append(t)
                out.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), b.column(5)], ["id", "url", "text", "n_repeated"])

    unsure = parsed.where(has_open).select("id", "url", "row", "blocks", "spans").join(flags, "row", "left").select("id", "url", "blocks", "spans", "flags", "n_repeated")
    unsure = unsure.mapInArrow(cut, T.StructType([*fields[:2], T.StructField("text", T.StringType()), T.StructField("n_repeated", T.LongType())]))
    out = sure.unionByName(unsure)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.coalesce("n_repeated", F.lit(0)).cast("long").alias("n_repeated"))
