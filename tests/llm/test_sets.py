"""Near duplicates, decontamination, fingerprints, shards."""

import random
import time
from itertools import pairwise

import numpy as np

from cyclewise.llm import near_dedup as N
from cyclewise.llm import shard as H
from cyclewise.llm import spot_signatures as G
from cyclewise.llm.decontaminate import contaminated, decontaminate, n_hit


def shingles(text, k=3):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_components(rows, percent, k=3):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def test_near_duplicates_match_brute_force(frame):
    """Groups of copies of copies, many pairs close to the threshold."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(2):
        base = [rng.choice(words) for _ in range(100)]
        group = [base]
        for _ in range(90):
            t = list(rng.choice(group) if rng.random() < 0.5 else base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                k, r = rng.randrange(len(t)), rng.random()
                if r < 0.5:
                    t[k] = rng.choice(words)
                elif r < 0.75:
                    del t[k]
                else:
                    t.insert(k, rng.choice(words))
            group.append(t)
        texts += [" ".join(t) for t in group]
    texts += ["", None, "one", "one two", "One \t two", " \n"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(frame(rows), shingle=3, threshold=0.85).collect()}
    assert got == brute_components(rows, 85)


def test_members_that_share_many_buckets_meet_once(spark):
    rng = random.Random(5)
    rows = []
    for b in range(3):
        comp = {v: v // 2 for v in range(12 * b, 12 * b + 12)}
        for extra in range(40):
            # most buckets hold most members, the last ones any two
            own = rng.sample(sorted(comp), 2 if extra > 35 else 11)
            comps = [comp[v] for v in own]
            rows += [(b, extra, v, comp[v], max(set(comps), key=lambda c: (comps.count(c), c)), extra % 9 != 3) for v in own]
    got = [tuple(r) for r in N.meeting(spark.createDataFrame(rows, "b long, extra long, vid long, comp long, major long, few boolean")).select("a", "b").collect()]
    want = set()
    for b, extra, x, cx, _, few in rows:
        want |= {(x, y) for c, e, y, cy, _, _ in rows if few and (b, extra) == (c, e) and cx != cy and x < y}
    assert set(got) == want
    assert len(got) <= 1.2 * len(want)  # before: once a bucket, some thirty times


def test_near_duplicates_edges(frame):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = N.near_duplicates(frame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (9, long), (8, long + " tail"), (None, None), (7, "")])).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.component_id) for r in rows if r.n_shingles) == [(False, 5, 5), (False, 5, 5), (False, 8, 8), (False, 9, 8), (True, None, 5)]
    assert N.near_duplicates(frame([])).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for overlap, ok in ((0.95, True), (0.86, True), (0.2, False)):
        both = rng.integers(0, 2**63, 2000, np.uint64)
        n = int(2000 * overlap)
        a, b = both, np.concatenate([both[:n], rng.integers(0, 2**63, 2000 - n, np.uint64)])
        x, y = N.set_sketch(a).astype(int), N.set_sketch(b).astype(int)
        one = lambda v: np.array([v.sum()])
        assert N.likely(one(x > y), one(x < y), one(x == y), np.array([2000.0]), np.array([2000.0]), 0.75)[0] == ok
        union = np.union1d(a, b)
        assert (N.set_sketch(union) == np.maximum(x, y)).all()


def test_decontaminate_matches_brute_force(frame, spark):
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(12)] + ["é"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, words(rng.choice([0, 1, 2, 6, 12, 13, 14, 30]))) for i in range(12)] + [(3, words(20)), (None, words(15))]
    docs = []
    for i in range(120):
        w = words(rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items)[1]
            a = rng.randint(0, len(item))
            w[rng.randint(0, len(w)) : 0] = item[a : a + rng.randint(0, 30)]
        docs.append((i, w))
    clean = [(i, (rng.choice([" ", "--", "\n"])).join(x.upper() if rng.random() < 0.3 and x != "é" else x for x in w)) for i, w in docs] + [(500, None), (500, None), (None, "")]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(77, None)], "item_id long, text string")
    expect = {}
    for i, w in docs:
        hit, names = set(), set()
        for item, x in items:
            n = min(13, len(x))
            wins = {tuple(x[a : a + n]) for a in range(len(x) - n + 1)} if n else set()
            for a in range(len(w) - n + 1):
                if n and tuple(w[a : a + n]) in wins:
                    hit |= set(range(a, a + n))
                    names |= {str(item)} if item is not None else set()
        expect[i] = (len(w), len(hit), sorted(names))
    for limit in (32 << 20, 0):  # broadcast, and the way beyond its bound
        out = decontaminate(frame(clean), bench, broadcast_bytes=limit).withColumn("hit", n_hit()).withColumn("bad", contaminated()).collect()
        assert len(out) == len(clean)
        for r in out:
            n, hit, names = expect.get(r.doc_id, (0, 0, []))
            assert (r.n_words, r.hit, r.items, r.bad) == (n, hit, names, hit > 0 and 20 * hit >= n), r
    nothing = decontaminate(frame(clean), bench.limit(0)).withColumn("hit", n_hit()).collect()
    assert len(nothing) == len(clean) and not any(r.hit for r in nothing)


def brute_signatures(text):
    w = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (text or "").translate({i: i + 32 for i in range(65, 91)})).split(" ")
    w = [x for x in w if x]
    out = set()
    for i, x in enumerate(w):
        chain = [y for y in w[i + 1 :] if y not in G.ANCHORS][: G.CHAIN]
        if x in G.ANCHORS and len(chain) == G.CHAIN:
            out.add(" ".join([x, *chain]))
    return out or set(w)


def test_signatures_of_long_runs(spark):
    n = 200_000
    before = time.time()
    rows = spark.createDataFrame([(0, "the " * n + "one two"), (1, "one " + "the of " * n), (2, "of the " * n + "one " + "to " * n + "two")], "doc_id long, text string")
    found = {r.doc_id: r for r in G.signatures(rows, "text", "sigs").selectExpr("doc_id", "sigs", "hash('the one two') a", "hash('of one two') b").collect()}
    assert found[0].sigs == [found[0].a]
    # a lone content word makes no chain: the distinct words stand for the text
    assert len(found[1].sigs) == 3
    assert sorted(found[2].sigs) == sorted([found[2].a, found[2].b])
    assert time.time() - before < 60


def test_signatures_and_next(frame, spark):
    texts = ["The cat of the big house, is on a red mat and the dog", "no anchors here at all", "", None, "the", "der Hund ist im Haus und die Katze", "the cat of the big house is on a mat", "x", "the the the a", "l'été est là dans la rue"]
    rows = [(i * 3 % 11, t) for i, t in enumerate(texts)] + [(None, "the last of them all"), (3, "same id the other text here"), (4, "dup the big cat")] * 2
    out = G.with_next(frame(rows)).collect()
    assert len(out) == len(rows)
    every = {x for _, t in rows for x in brute_signatures(t)}
    code = {x: h for x, h in spark.createDataFrame([(x,) for x in every], "x string").selectExpr("x", "hash(x)").collect()}
    distinct = sorted({(r.doc_id is None, -(r.doc_id or 0)) for r in out})
    assert len(distinct) == 11
    for r in out:
        assert set(r.sigs) == {code[x] for x in brute_signatures(r.text)}
        assert r.edited[: r.n - r.n // 3] == r.text[: r.n - r.n // 3]
    # ids without ties: the next in descending order, then round
    plain = [(i, f"the text number {i} of the set " * (i + 1)) for i in range(50)]
    for r in G.with_next(frame(plain)).collect():
        follows = plain[(r.doc_id - 1) % 50][1]
        assert r.edited == r.text[: r.n - r.n // 3] + follows[: r.n // 3]
    assert G.with_next(frame([])).count() == 0 and G.with_next(frame([(1, "a b")])).collect()[0].next_sigs is not None


def test_similar_pairs_match_brute_force(spark):
    rng = random.Random(6)
    sets = {}
    for i in range(150):
        base = set(rng.sample(range(60), rng.randint(1, 25))) if i % 3 == 0 or not sets else set(rng.choice(list(sets.values())))
        for _ in range(rng.randint(0, 2)):
            base ^= {rng.randrange(60)}
        sets[i] = base
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "key long, sigs array<int>")
    got = {(r.a, r.b) for r in G.similar_pairs(df, "key", "sigs", 0.7).collect()}
    assert got == {(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j]) - 1e-9}


def test_matrix_has_exact_sums():
    counts = np.array([5, 0, 7, 100])
    blocks = H.block_sizes(112, 3, 10)
    columns = np.array([b[2] for b in blocks])
    m = np.stack([H.matrix_row(counts, columns, p, 1) for p in range(4)])
    assert (m.sum(0) == columns).all() and (m.sum(1) == counts).all() and (m >= 0).all()
    for (s, at, n), (s2, at2, _) in pairwise(blocks):
        assert at2 == (at + n if s == s2 else 0)


def test_large_populations_follow_the_law():
    rng = np.random.default_rng(0)
    x = np.array([H.hypergeometric(rng, 3_000_000_000, 7_000_000_000, 4_000_000_000) for _ in range(2000)])
    assert abs(x.mean() - 1.2e9) < 3000 and 0.9 < x.std() / (4e9 * 0.3 * 0.7 * 0.6) ** 0.5 < 1.1


def test_shards_are_exact_and_stable(frame):
    rows = [(i, f"text {i % 5}") for i in range(997)] + [(None, None), (1, "text 1"), (2, "")]
    one = sorted(((r.doc_id, r.text, r.shard, r.slot) for r in H.shuffle_shards(frame(rows), shards=7, block_rows=50, stable=False).collect()), key=str)
    two = sorted(((r.doc_id, r.text, r.shard, r.slot) for r in H.shuffle_shards(frame(rows), shards=7, block_rows=50, stable=False).collect()), key=str)
    assert one == two
    assert sorted(x[:2] for x in one if x[0] is not None) == sorted(x for x in rows if x[0] is not None)
    for s in range(7):
        slots = sorted(x[3] for x in one if x[2] == s)
        assert slots == list(range(len(slots))) and len(slots) in (142, 143)
    # a shuffle leaves no trace of the order
    ids = np.array([x[0] for x in one if x[0] is not None])
    places = np.array([x[2] for x in one if x[0] is not None])
    assert abs(np.corrcoef(ids, places)[0, 1]) < 0.12
    assert H.shuffle_shards(frame([]), shards=3, stable=False).count() == 0
