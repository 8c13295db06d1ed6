"""Languages, lines, pages, tokens."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cyclewise.llm import language_id as L
from cyclewise.llm import main_text as M
from cyclewise.llm import queries as Q
from cyclewise.llm.line_dedup import dedup_lines
from cyclewise.llm.sentencepiece_codec import BpeCodec, encode_decode


def test_crf_matches_enumeration():
    rng = np.random.default_rng(0)
    scores, lengths = rng.normal(size=(9, 3)), np.array([4, 0, 3, 2])
    tr, st = rng.normal(size=(3, 3)), np.zeros(3)
    p, logz = L.posteriors(scores, lengths, tr, st)
    at = 0
    for d, n in enumerate(lengths):
        if not n:
            continue
        s = scores[at : at + n]
        weight = {}
        for path in np.ndindex(*[3] * n):
            weight[path] = np.exp(sum(s[i, y] for i, y in enumerate(path)) + sum(tr[a, b] for a, b in zip(path, path[1:], strict=False)))
        z = sum(weight.values())
        expect = np.array([[sum(w for path, w in weight.items() if path[i] == y) / z for y in range(3)] for i in range(n)])
        assert np.allclose(p[at : at + n], expect)
        assert np.isclose(logz[d], np.log(z))
        at += n


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = Q.op3_language(spark, sf).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_language_edges(spark, frame):
    english, german = "the house of the king and that is it " * 9, "der hund und das haus ist nicht mit dem mann " * 9
    docs = frame([(i, english if i % 2 else german, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    m = L.learn(docs, Q.fold() != 1)
    asked = frame([(1, None), (2, ""), (3, "12 ½ _"), (None, english), (5, german), (5, german), (6, english * 3000), (7, "z" * 50_000), (8, english + german)])
    got = {(r.doc_id, r.lang_pred) for r in L.identify(asked, m, spans=True).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "de"), (6, "en")} <= got and len(got) == 8
    mixed = next(r for r in L.identify(asked, m, spans=True).collect() if r.doc_id == 8)
    assert [s.lang for s in mixed.spans] == ["en", "de"]
    assert {r.lang_pred for r in L.identify(asked, L.learn(docs.limit(0), Q.fold() != 1)).collect()} == {"und"}


def test_language_sample_holds_every_label(frame, monkeypatch):
    rng = random.Random(5)
    text = lambda words, k: " ".join([rng.choice(words) for _ in range(30)]) + f" {chr(97 + k // 26)}{chr(97 + k % 26)}"
    english, german = "the house of king and that is it".split(), "der hund und das haus ist nicht mit".split()
    # copies: few texts in many rows, one of them a third of all, and a label that is mostly letterless
    rows = [(text(english, k), "en") for k in range(60) for _ in range(10)] + [("la casa del rey", "es")] * 600
    rows += [(t, "de") for t in (text(german, k) for k in range(3)) for _ in range(200)]
    rows += [(f"{i} {i}", "fr") for i in range(600)] + [("le roi et la maison", "fr"), ("x" * 500, "long")]
    docs = frame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    got = []
    monkeypatch.setattr(L, "fit", lambda pairs: got.extend(pairs) or pairs)
    L.learn(docs, Q.F.lit(True), sample_docs=25)
    sample = {}
    for label, words in got:
        sample.setdefault(label, []).append(" ".join(words))
    assert {k: len(v) for k, v in sample.items()} == {"en": 25, "es": 1, "de": 3, "fr": 1, "long": 1}
    assert all(len(set(v)) == len(v) for v in sample.values())


def brute_lines(docs, min_chars=40, min_docs=5):
    white = " \t\n\x0b\f\r"
    key = lambda x: x.strip(white).translate({i: i + 32 for i in range(65, 91)})
    holders = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in docs:
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(holders.get(key(x), ())) < min_docs or i == max(holders[key(x)], key=lambda v: (v is not None, v or 0))]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_lines_match_brute_force(spark, frame, partitions):
    rng = random.Random(partitions)
    pool = [f"{'Line' if k % 2 else 'ligne É'} number {k} " + "x" * 30 for k in range(12)]
    docs = [(i, "\n".join(rng.choice([" \t", ""]) + rng.choice([*pool, "short", "", f"own {i} " + "y" * 40]) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    docs += [(i, pool[0]) for i in range(100, 400)] + [(None, pool[1]), (None, None), (7000, ""), (7001, "\n".join([pool[0].upper()] * 50)), (3, pool[2])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = dedup_lines(frame(docs))
        got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_lines(docs)
    assert dedup_lines(frame([])).count() == 0


def test_pages_parse():
    page = '<body><header>H</header><div id=menu>m</div><div>open <b>bold</b> x<br>y</div><p>q &lt;a&gt; &amp;amp;</p><script>a="<p>"</script><aside>s</aside><div class="comments"><div>c</div><p>d</p></div>z<footer>f'
    assert [(k, t) for k, _, t in M.parse(page) if k == M.OPEN] == [(1, "open bold x y"), (1, "q <a> &amp;"), (1, "z")]
    page = '<nav>a<article><h1>t</h1><p>x<aside>no</aside>y</p><section class="comments">c</section></article> out'
    assert [t for k, _, t in M.parse(page) if k == M.MAIN] == ["t", "x", "y"]
    # what is never closed, and names that only sound like boilerplate
    main = lambda x: " ".join(t for k, _, t in M.parse(f"<article>{x}</article><div>out</div>") if k == M.MAIN)
    for name in ("svg", "button", "select", "object", "noscript"):
        assert main(f"<p>a</p><div><{name} class=x>no</div><p>b</p>") == "a b", name
        assert main(f"<p>a<{name}><i>no</i></{name}> b</p>c") == "a b c", name
        assert main(f"<p>a<{name}>no<p>b<p>c") == "a b c", name
    assert main('<svg width="1" /><p>a</p><svg><path d=""/><title>no</title></svg><p>b</p><svg><g><p>c</p>') == "a b c"
    assert main('a<p class="ad">no<p>b<ul><li class="share">no<li>c<li>d</ul><p class="ad">no<h2>e</h2><div><a class="share">no</div>f') == "a b c d e f"
    assert main('<h2 id="social-impact">a</h2><section id="search-methods" aria-label="Share of ads">b</section><div class="post no-sidebar">c</div>') == "a b c"
    assert main("<table><tr><td>a</div>b<tr><td class=ad>no<td>c</table>d</div>e") == "a b c d e"
    assert [t for k, _, t in M.parse("<main><article><p>a</main><p>out") if k == M.MAIN] == ["a"]
    assert main('a<div class="x share">no</div><div id=comments>no</div><div role="navigation">no</div><p>b</div>c') == "a b c"
    assert [t for k, _, t in M.parse('<article class="post has-comments"><p>a</article>') if k == M.MAIN] == ["a"]
    assert [t for k, _, t in M.parse("<head><title>no</title><body>a<div class=ad>no<p>no</div>b") if k == M.OPEN] == ["a", "b"]
    assert M.parse("") == [] and M.parse("a < b") == [(1, "body", "a < b")]


def test_suffix_array_cover_matches_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        streams = [np.array([rng.randint(0, 2) for _ in range(rng.randint(0, 14))], np.int64) for _ in range(rng.randint(1, 6))]
        size, pages, where = rng.randint(1, 4), rng.randint(1, 3), {}
        for i, x in enumerate(streams):
            for a in range(len(x) - size + 1):
                where.setdefault(tuple(x[a : a + size]), set()).add(i)
        for x, flags in zip(streams, M.covered(streams, size, pages), strict=True):
            expect = np.zeros(len(x), bool)
            for a in range(len(x) - size + 1):
                if len(where[tuple(x[a : a + size])]) >= pages:
                    expect[a : a + size] = True
            assert (expect == flags).all()


def test_pages_operator(spark):
    bar = "<div>home about contact all the same words here</div>"
    rows = [(i, "http://a.org/x", f"{bar}<div>unique story number {i} of the day &amp; more</div>") for i in range(8)]
    rows += [(8, None, None), (9, "http://b.org", ""), (9, "http://b.org", ""), (10, "http://a.org/y", f"{bar}<article><p>home about contact all the same words here</p>two\n words</article>")]
    rows += [(11, "http://a.org/z", "<p>" + "w " * 50_000)]
    out = {r.page_id: r for r in M.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumnsRenamed({})).collect()}
    assert all(out[i].text == f"unique story number {i} of the day & more" for i in range(8))
    assert out[8].text == out[9].text == ""
    assert out[10].text == "home about contact all the same words here\ntwo words"
    assert len(out[11].text) == 99_999
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert M.main_text(empty).count() == 0


def test_pages_repeat_across_groups(spark):
    bar = "<div>home about contact all the same words here</div>"
    story = lambda i: f"<div>unique story {i} of day {i} and more {i}</div>"
    rows = [(i, f"http://{'ab'[i % 2]}.org/x", (bar if i < 16 else "") + story(i) + ("<div>only two pages have these words here</div>" if i < 4 else "")) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = sorted(M.main_text(pages.repartition(1)).collect())
    for group_pages, parts in ((4, 1), (4, 7), (1, 3)):
        assert sorted(M.main_text(pages.repartition(parts), group_pages=group_pages).collect()) == whole
    assert all(r.text.startswith("unique story") and (r.n_repeated > 0) == (r.page_id < 16) for r in whole)


def test_all_segments_are_checked(frame, monkeypatch):
    import public_tokenizers

    from cyclewise.llm import sentencepiece_codec as S

    docs = frame([(1, "x")])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: run)
    path = public_tokenizers.path("piece_bpe_32k.model")
    checked, whole = [], []
    each, check = S.library_segments, BpeCodec.check
    monkeypatch.setattr(S, "library_segments", lambda lib, keys, *more: (checked.extend(keys), each(lib, keys, *more))[1])
    monkeypatch.setattr(BpeCodec, "check", lambda self, texts, ids: (whole.extend(texts), check(self, texts, ids))[1])
    texts = [f"text number {i}\nand  line {i}" for i in range(1000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": texts})
    out = list(encode_decode(docs, path, check_every=2)(iter([batch])))
    assert sum(b.num_rows for b in out) == 1000 and whole == texts[:400] + texts[800:]
    assert sorted(checked) == sorted({"text", "number", "and", "▁line", "\nand"} - {"and"} | {str(i) for i in range(1000)}) and len(checked) == 1004
    # a difference anywhere raises
    monkeypatch.setattr(BpeCodec, "encode_many", lambda self, segments: [np.int32([5]).tobytes()] * len(segments))
    with pytest.raises(ValueError, match="otherwise"):
        list(encode_decode(docs, path, check_every=10**9)(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["new words"]})])))


def test_tokens_equal_library(spark, frame):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    pieces = [" ", "  ", "\n", "\t", "▁", "the", "ing", "é", "日本", "😀", "<s>", "<0x0A>", "0", "​", "ﬁ", "x" * 60, "\r\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 20))) for _ in range(500)] + [None, "", "▁", " ", "word " * 20_000, "a" * 5000]
    rows = encode_decode(frame(list(enumerate(texts))), path, check_every=1).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "")
        assert r.ids == ids and r.decoded == library.decode(ids)
    assert encode_decode(frame([]), path).count() == 0
    # the two forms of the agenda agree
    with open(path, "rb") as f:
        codec = BpeCodec(f.read())
    words = sorted({s for t in texts for k in codec.keys(t or "") for s in [k if k[:1] == "\n" else "▁" + k] if len(s) <= 40}, key=len)
    assert [np.frombuffer(x, np.int32).tolist() for x in codec.encode_many(words)] == [codec.encode_segment(w) for w in words]
