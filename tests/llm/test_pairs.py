"""Operators on pairs, held against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lodestack.llm import ann, embed_dedup, jaccard
from lodestack.llm._shared import connected_components


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets_ = [(i, shingle_set(t)) for i, t in rows if i is not None]
    links = [(a, b) for (a, x), (b, y) in combinations(sets_, 2) if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return components({i for i, _ in sets_}, links)


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.45:
            w = list(rng.choice(out)[1].split())
            for _ in range(rng.randrange(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                w = w[: max(1, len(w) - rng.randrange(3))]
        else:
            w = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 7, 8, 9, 12, 16, 25, 60, 120]))]
            if kind > 0.8:
                w += passage
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("seed,often", [(1, 64), (2, 3), (3, 1), (4, 2)])
def test_jaccard_equals_brute_force(spark, monkeypatch, seed, often):
    monkeypatch.setattr(jaccard, "LIST", often)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = corpus(seed)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingle_set(t)) for i, t in rows}


def test_jaccard_edges(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST", 2)
    long = " ".join(f"x{i % 700}" for i in range(30_000))
    rows = [(9, long), (8, long + " end"), (7, None), (6, ""), (5, " \n\t "), (4, "one two"), (3, "ONE two"), (2, "two one"), (1, "a b c d e"), (11, "É b c d e"), (12, "é b c d e"), (None, "one two"), (4, "one two"), (20, "p q r s t u"), (20, "k l m n o p"), (21, "k l m n o p")]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, component_id int, node string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()), key=str)
    by = {(i, c) for i, _, c in got}
    assert len(got) == len(rows)
    assert {(9, 8), (8, 8), (7, 7), (6, 6), (5, 5), (4, 3), (3, 3), (2, 2), (1, 1), (11, 11), (12, 12), (None, None), (20, 20), (21, 20)} == by
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_jaccard_rows_follow_a_group_not_its_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w)))
    made = {}
    old, texts = jaccard.written, jaccard.written_texts
    note = lambda f: lambda df, name: made.setdefault(name, []).append((out := f(df, name)).count()) or out
    monkeypatch.setattr(jaccard, "written", note(old))
    monkeypatch.setattr(jaccard, "written_texts", note(texts))
    for most in (64, 1000):  # a long list, a short one
        made.clear()
        monkeypatch.setattr(jaccard, "LIST", most)
        got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.component_id for r in got} == {0}
        assert max(made["jaccard-close"]) <= 3 * 300 and max(made["jaccard-rest"]) <= 300 and max(made["jaccard-dense-links"]) <= 300


def test_lists_longer_than_the_bound_pass_through():
    key = np.repeat(np.array([5, 7, 9, 11]), [1, 10, 2, 3])
    doc = np.arange(len(key)) + 100
    n = np.full(len(key), 8, np.int32)
    whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(n)], ["key", "doc", "n"])
    for step in (1, 2, 3, 16):
        got = [r for b in jaccard.leaders(4)(iter([whole.slice(i, step) for i in range(0, len(key), step)])) for r in b.to_pylist()]
        assert [(r["leader"], r["doc"], r["c"]) for r in got] == [(101, d, 5) for d in range(102, 111)] + [(111, 112, 2)] + [(113, 114, 3), (113, 115, 3)]


def test_small_boundary_follows_cost():
    assert jaccard.small_boundary({}) == jaccard.MOST_SMALL
    assert 0 < jaccard.small_boundary({s: 10 for s in range(1, 13)}) < jaccard.MOST_SMALL


def test_sketch_bound():
    rng = np.random.default_rng(0)
    for n, m in [(5, 9), (40, 70), (100, 130), (1000, 900)]:
        pool = np.unique(rng.integers(0, 1 << 63, 2 * (n + m)).astype(np.uint64))
        a, b = np.sort(rng.choice(pool, n, False)), np.sort(rng.choice(pool, m, False))
        assert jaccard.parities_apart(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_components_of_a_chain_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 150), (150, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 150: 150, 200: 150}


def vectors(seed=0, n=300, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(n // 2, n):
        x[i] = x[i - n // 2] * rng.uniform(0.5, 2) + rng.normal(size=d) * rng.choice([0, 0.05, 0.12, 0.3])
    return x.astype(np.float32)


def test_embedding_links_equal_brute_force(spark):
    x = vectors()
    rows = [(i, [float(v) for v in x[i]], None if i % 50 == 7 else i % 3) for i in range(len(x))]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [], 1), (905, rows[0][1], 0), (906, rows[0][1], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, 0.98, tile=64).collect()}
    good = [(i, np.array(v, np.float64), label) for i, v, label in rows if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for (a, x, p), (b, y, q) in combinations(good, 2) if p == q and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98]
    comp = components({r[0] for r in rows if r[0] is not None}, links)
    want = {i: (sum(i in p for p in links), c, i == c) for i, c in comp.items()}
    assert links and {k: v for k, v in got.items() if k is not None} == want
    assert got[None] == (0, None, True)
    tiny = [(i, [v * f for v in (1.0, 2.0, -3.0, 0.5)], 1) for i, f in enumerate([1e-200, 1e200, 1.0, 3e-200])]
    far = spark.createDataFrame([*tiny, (9, [3.0, 1.0, 1.0, 9.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.near_duplicates(far).collect()) == [(0, 3, 0), (1, 3, 0), (2, 3, 0), (3, 3, 0), (9, 0, 9)]
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_tiles_that_pivots_keep_apart_are_not_compared(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = np.eye(12)[rng.integers(12, size=600)]
    x = centre + 0.02 * rng.normal(size=centre.shape)
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    met = {}
    old = embed_dedup.written
    monkeypatch.setattr(embed_dedup, "written", lambda d, name: met.update({name: (out := old(d, name)).count()}) or out)
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, 0.98, tile=9).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {i: int((row >= 0.98).sum() - 1) for i, row in enumerate(u @ u.T)}
    assert met["dedup-meetings"] < met["dedup-tiles"] ** 2 / 4


def test_quantised_bound_holds():
    x, y = vectors(1, 200, 64), vectors(2, 200, 64)
    i, j = embed_dedup.linked_pairs(x.astype(np.float64), y.astype(np.float64), 0.2)
    n = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.argwhere(n(x.astype(np.float64)) @ n(y.astype(np.float64)).T >= 0.2)
    assert sorted(zip(i, j)) == sorted(map(tuple, want))


def test_nearest_recall_ties_and_edges(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(60, 24))[rng.integers(60, size=1500)] + 0.4 * rng.normal(size=(1500, 24))).astype(np.float32)
    x[40:80] = x[40]  # forty equal vectors
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("inf")] * 24), (None, [1.0] * 24), (5003, [1.0])]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "vec_id long, embedding array<float>, score double")
    out = ann.nearest(df, df.where("vec_id % 20 = 0"), 20, leaf=32, enough=3000).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    x = x.astype(np.float64)
    hits = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        top = np.lexsort((np.arange(len(s)), -s))[:20]
        assert sorted(got[q]) == list(range(1, 21)) and q not in [v for v, _ in got[q].values()]
        assert all(abs(s[v] - sc) < 1e-9 for v, sc in got[q].values())
        hits += len(set(top) & {v for v, _ in got[q].values()})
    assert hits / (75 * 20) >= 0.9
    assert 5000 not in got and 5001 not in got
    other = spark.createDataFrame([(7000, [1.0, 2.0]), (7001, [2.0, 1.0]), (7002, [0.5] * 24)], "vec_id long, embedding array<double>")
    assert {r.query_id for r in ann.nearest(df.drop("score"), other, 5, leaf=32, enough=500).collect()} == {7002}
    few = ann.nearest(df.where("vec_id < 5"), df.where("vec_id = 0"), 20).collect()
    assert len(few) == 4
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def recall_at(ann_, df, x):
    """Recall of every hundredth vector's 20 nearest."""
    got = {}
    for r in ann_.nearest(df, df.where("vec_id % 100 = 0"), 20, leaf=64).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in got:
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & got[q])
    return [hits / (20 * len(got))]


def test_nearest_searches_as_much_as_the_recall_needs(spark, monkeypatch):
    monkeypatch.setattr(ann, "SEARCH", 500)  # as small a share of the postings as 40,000 is of a large table's
    x = np.random.default_rng(5).normal(size=(3000, 48))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)})).cache()

    def recall(enough):
        got, hits = {}, 0
        for r in ann.nearest(df, df.where("vec_id % 50 = 0"), 20, leaf=64, enough=enough).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        for q in range(0, len(x), 50):
            s = x @ x[q]
            s[q] = -np.inf
            hits += len(set(np.argsort(-s)[:20].tolist()) & got[q])
        return hits / (60 * 20)

    assert recall(500) < 0.9 <= recall(None)
    df = df.where("vec_id < 1000").cache()
    x = x[:1000]
    assert min(recall_at(ann, df, x)) >= 0.9
    assert ann.nearest(df, df.limit(0), 20, leaf=64).count() == 0
