"""Token alignment against the libraries and a plain version."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from cyclewise.llm import align_tokens as A
from cyclewise.llm import queries as Q

FILES = [P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def own():
    with open(FILES[0], "rb") as f, open(FILES[1], "rb") as g:
        return A.Aligner(f.read(), g.read())


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILES[0])
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def groups_of(text, own, libraries):
    """Groups of (A ids, B ids), token by token."""
    if not text:
        return []
    a = libraries[0].encode(" " + text, add_special_tokens=False).ids
    b = libraries[1].encode(text)
    whole = (" " + text).encode()
    spell = [[v.table[i].as_py() for i in ids] for v, ids in ((own.a, a), (own.b, b))]
    if b"".join(spell[0]) != whole or b"".join(spell[1]) != whole:
        return []
    ends = [np.cumsum([len(x) for x in s]).tolist() for s in spell]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out, i, j = [], 0, 0
    for c in cuts:
        ga, gb = [], []
        while i < len(a) and ends[0][i] <= c:
            ga.append(a[i])
            i += 1
        while j < len(b) and ends[1][j] <= c:
            gb.append(b[j])
            j += 1
        out.append((ga, gb))
    return out


PIECES = [" ", "  ", "\n", "word", "straße", "日本", "😀", "ﷺ", "<s>", "<|endoftext|>", "▁", "\t", "don't", "1234", "...", "x" * 60, "\x00", "é", " \n", "The", "\r"]


def awkward(n=250):
    rng = random.Random(4)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(n)] + [None, "", " ", "\n", "a " * 30000, "b" * 50000, " " * 20000]


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_equals_plain_version(frame, own, libraries, broadcast):
    texts = awkward()
    texts += texts[:50] + ["the same words again and again"] * 300
    plain = [groups_of(t, own, libraries) for t in texts]
    assert sum(map(bool, plain)) > 100 and any(t and not g for t, g in zip(texts, plain, strict=True))
    count = Counter((ga[-1], gb[-1]) for g in plain for ga, gb in g)
    top = Counter()
    for (_, b), c in count.items():
        top[b] = max(top[b], c)
    out = {r.doc_id: r for r in A.with_counts(A.align(frame(list(enumerate(texts))), *FILES), own.b.size, broadcast).collect()}
    assert len(out) == len(texts)
    for k, g in enumerate(plain):
        r, links = out[k], [(ga[-1], gb[-1]) for ga, gb in g]
        assert r.groups == ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in g)
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (sum(len(x) for x, _ in g), sum(len(x) for _, x in g), len(g), len(links))
        assert (r.n_best, r.count_sum) == (sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links))
        assert r.n_shared == sum(len(x) * len(y) for x, y in g)


def test_products_match_dense_ones():
    rng = np.random.default_rng(6)
    for _ in range(40):
        x, y = rng.integers(0, 2, (rng.integers(1, 7), 5)), rng.integers(0, 3, (5, rng.integers(1, 7)))
        sparse = [A.Csr(np.concatenate([[0], np.cumsum((m > 0).sum(1))]), np.nonzero(m)[1], m[m > 0], m.shape[1]) for m in (x, y)]
        got = sparse[0].times(sparse[1])
        dense = np.zeros((x.shape[0], y.shape[1]), int)
        dense[got.rows(), got.cols] = got.vals
        assert np.array_equal(dense, x @ y)
        flipped = sparse[0].transpose()
        dense = np.zeros(x.T.shape, int)
        dense[flipped.rows(), flipped.cols] = flipped.vals
        assert np.array_equal(dense, x.T)


def test_overlaps_and_shared_groups():
    both = A.Csr.tiles(np.array([2, 3, 6])).times(A.Csr.tiles(np.array([1, 3, 6])).transpose())
    assert list(zip(both.rows().tolist(), both.cols.tolist(), both.vals.tolist(), strict=True)) == [(0, 0, 1), (0, 1, 1), (1, 1, 1), (2, 2, 3)]
    pairs = A.shared_group(np.array([1, 2]), np.array([1, 2]), 3, 3)
    assert list(zip(pairs.rows().tolist(), pairs.cols.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)]
    assert A.shared_group_count(np.array([1, 2]), np.array([1, 2]), 3, 3).tolist() == [2, 2, 1]


def test_edges(frame, own):
    rows = [(None, None), (None, "a b"), (1, "a b"), (1, "a b"), (2, "")]
    out = A.with_counts(A.align(frame(rows), *FILES), own.b.size).collect()
    assert sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in out) == [(0, 0, 0), (0, 2, 6), (1, 2, 6), (1, 2, 6), (2, 0, 0)]
    assert A.with_counts(A.align(frame([]), *FILES), own.b.size).count() == 0


def test_query_digest(spark, own, libraries):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = Q.op13_align(spark, sf).orderBy(F.rand(1)).collect()
    assert len(out) == len(texts)
    for r in out:
        g = groups_of(texts[r.doc_id], own, libraries)
        shown = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in g)
        assert r.groups_sha256 == (hashlib.sha256(shown.encode()).hexdigest() if g else "")
