"""Fill-in-middle against a plain version, on awkward texts and by slices."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cyclewise.llm import fill_middle as M
from cyclewise.llm.common import byte_slices


def plainly(doc_id, text, rate=100, spm=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, t
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


PIECES = ["\n", "\n\n", "word ", "é", "😀", "<", "P>", "<P", ">", "<S", "<M", "S>", "\r\n", " ", "\x00", "<X>", "long " * 40]


def test_byte_slices_cover_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["aaaa", None, "", "bb", "c" * 50, "d", "e"])], ["i", "t"])
    parts = list(byte_slices(b, 1, 5))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3], [4], [5, 6]]
    # a slice keeps its offset into the batch
    assert [bytes(M.text_bytes(p.column(1))[0]) for p in parts] == [b"aaaa", b"bb", b"c" * 50, b"de"]


def test_equals_plain_version(frame):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    texts += [None, "", "\n", "a", "<P>", "x<M>y\nz", "a\n" * 20000, "b" * 300000, "<", "<P", "P>"]
    for rate, spm in ((100, 50), (40, 0)):
        out = M.restore(M.split(frame(list(enumerate(texts))), rate=rate, spm=spm)).collect()
        assert len(out) == len(texts)
        for r in out:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(r.doc_id, texts[r.doc_id], rate, spm)
            assert r.restored == (texts[r.doc_id] or "")
    assert {plainly(i, t)[1] for i, t in enumerate(texts)} == {"plain", "psm", "spm"}


def test_edges(frame):
    rows = [(None, None), (None, "a\nb"), (1, "a\nb\n"), (1, "a\nb\n"), (2, "")]
    out = M.restore(M.split(frame(rows))).collect()
    assert sorted((r.doc_id or 0, r.restored) for r in out) == [(0, ""), (0, "a\nb"), (1, "a\nb\n"), (1, "a\nb\n"), (2, "")]
    assert len({r.output for r in out if r.doc_id == 1}) == 1
    assert M.restore(M.split(frame([]))).count() == 0


def test_restore_refuses_other_marks():
    data = np.frombuffer(b"<P>a<S>b<M>c<M>", np.uint8)
    with pytest.raises(ValueError):
        M.gather(data, np.array([0, len(data)]), np.array([M.PSM]))
    data = np.frombuffer(b"<S>a<P>b<M>c", np.uint8)
    with pytest.raises(ValueError):
        M.gather(data, np.array([0, len(data)]), np.array([M.PSM]))
