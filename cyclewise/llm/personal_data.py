"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
``://`` and identifier cues (IBAN, SSN, account ...). From each anchor a local
parser walks left and right to the boundaries of the candidate and validates
it. Work is linear in the text: an anchor inside what a parser of the same
kind has consumed is skipped, and no parser looks beyond the run of characters
that its kind allows.

Base kinds, as leftmost non-overlapping matches: ``email``, ``ip`` (parts up to
255), ``card`` (16 to 19 digits that pass the Luhn check), ``phone`` (``+`` and
8 to 15 digits). A match that fails its check is dropped and not retried.
Added kinds, which never replace base ones: ``login`` (a URL with user
information), ``iban`` (after its cue, remainder 1 by 97), ``account`` (6 to 17
digits after its cue), ``ssn`` (after its cue, no void area).

Spans are in code points, end exclusive, ordered by kind as listed and start.
Null text counts as empty and has no spans; rows are independent, repeated rows
give repeated results. Only the id column is carried along, so extra columns
cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account", "ssn")
CUES = {"iban": ("iban",), "ssn": ("ssn", "social security"), "account": ("account", "acct")}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DIGITS = frozenset("0123456789")

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_ip = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)").match
_chain = re.compile(r"[0-9](?:[\x20-]?[0-9])+").match
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").match
_digits = re.compile(r"[0-9]+").match
_userinfo = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]+:[A-Za-z0-9._~%!$&'*+,;=:-]+@[A-Za-z0-9.-]+").match
_iban = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?))?\x20*[:#=]?\x20*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])").match
_ssn = re.compile(r"(?:\x20?(?:number|no\.?))?\x20*[:#=]?\x20*((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])").match
_account = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?))?\x20*[:#=]?\x20*([0-9](?:[\x20-]?[0-9]){5,16})(?![A-Za-z0-9])").match


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for key, kind in (("@", "email"), ("+", "phone"), ("://", "login"), *((d, "digit") for d in DIGITS)):
        a.add_word(key, (kind, len(key)))
    for kind, cues in CUES.items():
        for cue in cues:
            for key in (cue, cue.upper(), cue.title(), cue.capitalize()):
                a.add_word(key, (kind, len(key)))
    a.make_automaton()
    return a


def find(text: str, anchors) -> list[tuple[str, int, int]]:
    """All spans of a text, in order."""
    found: dict[str, list[tuple[int, int]]] = {}
    email_end = ip_end = card_end = phone_end = run_end = 0

    def add(kind: str, start: int, end: int) -> None:
        found.setdefault(kind, []).append((start, end))

    for last, (kind, size) in anchors.iter(text):
        at = last - size + 1
        if kind == "digit":
            if at < run_end:
                continue
            run_end = _digits(text, at).end()
            if at >= ip_end and (m := _ip(text, at)):
                ip_end = m.end()
                # compared by length first: a part may have any number of digits
                if all(len(p := g.lstrip("0")) < 4 and int(p or 0) <= 255 for g in m.groups()):
                    add("ip", at, ip_end)
            if at >= card_end and (m := _chain(text, at)):
                card_end = m.end()
                digits = m.group().replace(" ", "").replace("-", "") if card_end - at < 40 else ""
                if 16 <= len(digits) <= 19 and luhn(digits):
                    add("card", at, card_end)
        elif kind == "email":
            start = at
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := _domain(text, at + 1)):
                email_end = m.end()
                add("email", start, email_end)
        elif kind == "phone":
            if at >= phone_end and (m := _phone(text, at)):
                phone_end = m.end()
                if 8 <= sum(c in DIGITS for c in m.group()) <= 15:
                    add("phone", at, phone_end)
        elif kind == "login":
            start = at
            while start > 0 and text[start - 1] in SCHEME:
                start -= 1
            if start < at and (m := _userinfo(text, at + 3)):
                add("login", start, m.end())
        else:
            m = (_iban if kind == "iban" else _ssn if kind == "ssn" else _account)(text, last + 1)
            if m and (kind != "iban" or _mod97(m.group(1))):
                add(kind, m.start(1), m.end(1))
    return [(k, s, e) for k in KINDS if k in found for s, e in found[k]]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_SPAN_ARROW = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id column and ``spans``, an array of
    (kind, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t, anchors)] if (t := v.as_py()) else [] for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(_SPAN_ARROW))], [id_col, "spans"])

    return bounded_batches(df).select(id_col, text_col).mapInArrow(run, T.StructType([df.schema[id_col], T.StructField("spans", T.ArrayType(SPAN))]))
