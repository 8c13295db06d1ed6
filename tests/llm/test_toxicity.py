"""The toxicity lexicon: folding, matching, exceptions, held-out accuracy."""

import random

import pytest
from pyspark.sql import functions as F

from cyclewise.llm import queries as Q
from cyclewise.llm import toxicity as X


@pytest.mark.parametrize(
    "text, folded",
    [
        ("An ID10T, really!", " an idiot really "),
        ("іdіоt", " idiot "),  # Cyrillic letters
        ("ｉｄｉｏｔ 1d1０t", " idiot idiot "),
        ("id​iot", " idiot "),
        ("st@nd! $$$ a$k", " stand ask "),
        ("géant", " géant "),
        ("", "  "),
        ("...", "  "),
    ],
)
def test_fold(text, folded):
    assert X.fold(text) == folded


def test_hits_match_brute_force():
    rng = random.Random(1)
    lex = X.Lexicon({" ab": 1.0, " abc": 2.0, " cd ": 3.0, " b": 0.5}, {" abc d ", " x ab "}, (0.0, 1.0, 1.0))
    for _ in range(300):
        f = X.fold(" ".join(rng.choice(["ab", "abc", "abcd", "cd", "cdx", "d", "x", "b", "yab"]) for _ in range(rng.randint(0, 9))))
        spared = [(i, i + len(e)) for e in lex.exceptions for i in range(len(f)) if f.startswith(e, i)]
        expect = []
        for i in range(len(f)):
            own = [e for e in lex.weights if f.startswith(e, i)]
            if own:
                e = max(own, key=len)
                if not any(a <= i and i + len(e) <= b for a, b in spared):
                    expect.append((i, i + len(e), lex.weights[e]))
        assert lex.hits(f) == expect


def test_chains_of_beginnings():
    row = lambda e, t, c: {"entry": e, "toxic": t, "clean": c}
    rows = [row(" idi", 40, 0), row(" idiot", 40, 0), row(" idiot ", 30, 0), row(" low", 90, 0), row(" lowei", 90, 0), row(" loweix", 20, 0), row(" the", 90, 900), row(" tra", 50, 50), row(" trash", 49, 1)]
    assert X.choose(rows, 0.1) == [" lowei", " tra", " trash", " idiot"]


def corpus():
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(["the", "house", "stands", "over", "river", "and", "of", "green", "can"]) for _ in range(rng.randint(5, 60))]
        y = int(i % 6 == 0)
        if y:
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), rng.choice(["trash", "Tr4sh", "blargs", "bl@rgly", "blarg"]))
        elif i % 15 == 1:
            k = rng.randint(0, len(words))
            words[k:k] = ["trash", "can"]
        docs.append((i, " ".join(words)))
        labels.append((i, y))
    return docs, labels


def test_learns_entries_and_exceptions(spark, frame):
    docs, labels = corpus()
    lex = X.learn(frame(docs), spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 3 != 2)
    assert any(e.startswith(" bla") for e in lex.weights)
    assert any("trash can" in e for e in lex.exceptions)
    out = {r.doc_id: r.score for r in X.score(frame(docs), lex).collect()}
    assert len(out) == len(docs)
    wrong = [i for i, y in labels if (out[i] >= 0.7) != bool(y)]
    assert len(wrong) <= 0.03 * len(docs)


def test_edges(spark, frame):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = frame([(None, None), (1, ""), (1, "ab " * 200000), (2, "ab"), (2, "ab")])
    out = X.score(docs, X.learn(docs, none, F.lit(True))).collect()
    assert len(out) == 5 and all(r.score < 1e-9 and r.hits == [] for r in out)
    # one kind of label only, a null id and a null label among them
    one = spark.createDataFrame([(1, 0), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    assert all(0 < r.score < 0.5 for r in X.score(docs, X.learn(docs, one, F.lit(True))).collect())
    assert X.score(docs.limit(0), X.learn(docs.limit(0), one, F.lit(True))).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = Q.op12_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert len(out) > 80
    assert sum(r.predicted == r.toxic for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in out)
