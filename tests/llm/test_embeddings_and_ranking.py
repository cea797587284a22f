"""Embedding duplicates, hard negatives and ranked search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sessionlake.llm import embdedup, lexical, negatives

VECTORS = "vec_id long, label int, embedding array<double>, score string, g int, rank int, c string, h long"


def vectors(spark, rows):
    """With extra columns whose names clash with those that operators add."""
    return spark.createDataFrame([(*r, "s", 1, 2, "c", 3) for r in rows], VECTORS)


def sane(x):
    return x is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x)


# near duplicates among embeddings


def cosine(a, b):
    a, b = (np.array(x) / max(map(abs, x)) for x in (a, b))
    return float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))


def brute_classes(rows, least=0.93):
    """(vec_id, n_links, component_id, kept), each vector once."""
    nodes = sorted({(i, y, None if x is None else tuple(x)) for i, y, x in rows}, key=repr)
    root, links = list(range(len(nodes))), Counter()

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    def takes_part(n):
        return n[0] is not None and n[1] is not None and sane(n[2]) and any(n[2])

    for p, a in enumerate(nodes):
        for q in range(p):
            b = nodes[q]
            if takes_part(a) and takes_part(b) and a[1] == b[1] and len(a[2]) == len(b[2]) and cosine(a[2], b[2]) >= least:
                links[p] += 1
                links[q] += 1
                root[find(p)] = find(q)
    low = {}
    for k, n in enumerate(nodes):
        r = find(k)
        low[r] = n[0] if low.get(r) is None else min(low[r], n[0])
    return sorted(((n[0], links[k], low[find(k)], n[0] == low[find(k)]) for k, n in enumerate(nodes)), key=repr)


def classes_of(df, **options):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicates(df, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"shard": 12, "block": 7, "guests": 9, "task_rows": 50}])
def test_embedding_classes_against_all_pairs(spark, options):
    """Copies, near copies in chains, a label of a third of all rows; small shards, tiles and tasks give the same."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(70):
        x = rng.normal(size=24)
        label = 0 if i % 3 == 0 else int(rng.integers(1, 6))
        rows.append((10_000 - i, label, x.tolist()))
        for k in range(int(rng.integers(0, 5))):
            x = x + rng.choice([0.0, 0.2, 0.35]) * rng.normal(size=24) if k else x
            rows.append((int(rng.integers(0, 9000)), label, (x * 10.0 ** rng.integers(-3, 3)).tolist()))
    rows += [(9_500 + i, 0, rows[0][2]) for i in range(30)]  # one vector many times
    assert classes_of(vectors(spark, rows), **options) == brute_classes(rows)


def test_embedding_classes_of_odd_rows(spark):
    a, b = [1.0, 2.0, 3.0], [-1.0, 0.5, 0.25]
    rows = [(1, 0, a), (1, 0, a), (2, 0, a), (2, 1, a), (2, 0, b), (3, None, a), (4, 0, None), (5, 0, [0.0] * 3), (6, 0, []), (7, 0, [1.0, None, 3.0]), (8, 0, [1.0, math.nan, 3.0]), (9, 0, [1.0, math.inf, 3.0]), (None, 0, a), (10, 0, [1.0, 2.0]), (11, 0, [2.0, 4.0]), (12, 0, [1e300, 2e300, 3e300]), (13, 0, [1e-300, 2e-300, 3e-300]), (14, 1, [7.0]), (15, 1, [-7.0])]
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 0, 2, True), (2, 0, 2, True), *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)), (None, 0, None, True), (10, 1, 10, True), (11, 1, 10, False), (12, 3, 1, False), (13, 3, 1, False), (14, 0, 14, True), (15, 0, 15, True)]
    assert classes_of(vectors(spark, rows)) == sorted(want, key=repr)
    assert embdedup.near_duplicates(vectors(spark, rows).limit(0)).count() == 0
    floats = vectors(spark, rows[:5]).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert classes_of(floats) == sorted([(1, 1, 1, True), (2, 1, 1, False), (2, 0, 2, True), (2, 0, 2, True)], key=repr)


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(5)
    for dim in (24, 64, 200):
        o = rng.normal(size=dim)
        errors = []
        for c in (0.0, 0.5, 0.93, 0.99):
            e = rng.normal(size=dim)
            e -= (e @ o) / (o @ o) * o
            q = c * o / np.linalg.norm(o) + math.sqrt(1 - c * c) * e / np.linalg.norm(e)
            got, low = [], []
            for seed in range(300):
                y = embdedup.rotated(np.array([o, q]), seed)
                assert y[0] @ y[1] == pytest.approx(c, abs=1e-9)
                code, f = embdedup.encode(y[:1])
                got.append(float(embdedup.estimates(y[1:], code, f)[0, 0]))
                spread = math.sqrt(1 - f[0] ** 2) / f[0] / math.sqrt(y.shape[1] - 1) * math.sqrt(1 - c * c)
                errors.append((got[-1] - c) / spread)
                low.append(got[-1] >= embdedup.least_estimate(f, y.shape[1], c, 4.5)[0])
            assert all(low) and np.mean(got) == pytest.approx(c, abs=4 * np.std(got) / math.sqrt(300) + 1e-3)
        assert 0.85 < np.std(errors) < 1.15


def test_shards_that_are_visited_hold_the_partners():
    """Pairs right at the threshold: all but a thousandth of them meet, and few shards are visited."""
    rng = np.random.default_rng(6)
    n, dim, s = 3000, 64, 8
    x, e = rng.normal(size=(n, dim)), rng.normal(size=(n, dim))
    x = embdedup.unit(x)
    e = embdedup.unit(e - (e * x).sum(1)[:, None] * x)
    z = 0.93 * x + math.sqrt(1 - 0.93**2) * e
    y, w = embdedup.rotated(x, 1), embdedup.rotated(z, 1)
    row, shard = embdedup.visited(y, s, 0.93, 0.001)
    assert len({*zip(row.tolist(), shard.tolist(), strict=True)}) == len(row)
    there = {*zip(row.tolist(), shard.tolist(), strict=True)}
    assert all((i, h) in there for i, h in enumerate(embdedup.homes(y, s).tolist()))
    missed = sum((i, h) not in there for i, h in enumerate(embdedup.homes(w, s).tolist()))
    assert missed <= 12 and len(row) / n < 2**s / 3


# hard negatives


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 70), st.integers(1, 70), st.integers(1, 70), st.integers(1, 20), st.integers(0, 2**32))
def test_strassen_is_exact(m, k, n, leaf, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(2**62), 2**62, (m, k)), rng.integers(-(2**62), 2**62, (k, n))
    exact = a.astype(object) @ b.astype(object)
    assert ((exact + 2**63) % 2**64 - 2**63 == negatives.strassen(a, b, leaf)).all()


def brute_negatives(rows, anchor, label=lambda i, y: y):
    standing = {}
    for i, y, x in rows:
        if i is not None and y is not None and sane(x):
            standing[i] = min(standing.get(i, (label(i, y), x)), (label(i, y), x))
    whole = {i: [math.floor(256 * v) if abs(v) < 2**53 else 256 * int(v) for v in x] for i, (_, x) in standing.items()}
    out = []
    for a in filter(anchor, standing):
        found = []
        for i in standing:
            if i != a and len(whole[i]) == len(whole[a]):
                s = sum(p * q for p, q in zip(whole[a], whole[i], strict=True))
                if abs(s) <= negatives.LIMIT:
                    found.append((-s, i))
        found.sort()
        for ps, p in [f for f in found if standing[f[1]][0] == standing[a][0]][:5]:
            hard = [f for f in found if standing[f[1]][0] != standing[a][0] and 80 * -ps <= 100 * -f[0] <= 100 * -ps][:5]
            out += [(a, p, k, i, -ps, -s) for k, (s, i) in enumerate(hard, 1)]
    return sorted(out)


def mined(df, anchor, **options):
    got = negatives.mine(df, anchor, **options).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


@pytest.mark.parametrize("tile", [8192, 40])
def test_negatives_against_all_pairs(spark, tile):
    """Many ties, a third of all rows one vector, positive and negative scores."""
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(0, 3)), (rng.integers(-3, 9, 19) / 4).tolist()) for i in range(260)]
    for i in range(0, 260, 3):
        rows[i] = (i, rows[i][1], rows[0][2])
    label = lambda i, y: (y + 1) % 10 if i % 7 == 0 else y
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    want = brute_negatives(rows, lambda i: i % 20 == 0, label)
    assert len(want) > 100
    assert mined(vectors(spark, rows), F.col("vec_id") % 20 == 0, label=moved, tile=tile) == want


def test_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    x = lambda: rng.random(3).tolist()
    rows = [(i, i % 2, x()) for i in range(20)] + [(0, 0, x()), (4, 1, x()), (4, 1, x()), (7, 1, x()), (7, 1, x())]
    rows += [(30, None, x()), (31, 0, None), (32, 0, []), (33, 1, [1.0, None, 2.0]), (34, 1, [1.0, math.nan, 2.0]), (35, 1, [1.0, -math.inf, 2.0]), (None, 0, x()), (40, 0, [1.0, 1.0]), (41, 1, [1.0, 1.2]), (42, 0, [1.5, 1.0])]
    rows += [(50, 0, [1e9, 1.0, 1e9]), (51, 1, [3e9, -1e9, 0.5]), (52, 1, [1e30, 0.0, 0.0]), (53, 0, [-0.0, 1e6, 0.0]), (60, 5, x())]
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert {r[0] for r in want} >= {0, 10, 40}
    assert mined(vectors(spark, rows), F.col("vec_id") % 10 == 0) == want
    assert negatives.mine(vectors(spark, rows).limit(0), F.col("vec_id") % 10 == 0).count() == 0
    floats = vectors(spark, rows[:20]).withColumn("embedding", F.col("embedding").cast("array<float>"))
    held = [(r.vec_id, r.label, r.embedding) for r in floats.collect()]
    assert mined(floats, F.col("vec_id") % 10 == 0) == brute_negatives(held, lambda i: i % 10 == 0)


# ranked search


def terms_of(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_ranks(docs, items, k=10):
    held = [(d, terms_of(t)) for d, t in docs]
    n, total = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    out = []
    for item, text in sorted(set(items), key=repr):
        found = []
        for row, (d, t) in enumerate(held):
            tf, score = Counter(t), 0
            for w in terms_of(text):
                if tf[w]:
                    m = 25 + 75 * len(t) * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, row))
        out += [(item, r, None if none else d, -s) for r, (s, none, d, _) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def ranks_of(docs, items, **options):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(docs, items, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"segment": 50, "short": 0.1}, {"block_terms": 40, "short": 0.0}])
def test_ranked_search_against_all_documents(spark, make, odd, options):
    rng = np.random.default_rng(9)
    words = ["the", "of", *(f"w{i}" for i in range(120)), "Über", "ÄRGER", "naïve", "日本", "x1"]
    chance = 1 / np.arange(1, len(words) + 1)
    chance /= chance.sum()
    text = lambda n: "".join(w + rng.choice([" ", ", ", "\n", "-", "_"]) for w in rng.choice(words, n, p=chance))
    docs = [*odd, *((1000 - i, text(int(rng.integers(0, 60)))) for i in range(300)), *((3000 + i, "the same text") for i in range(150))]
    docs += [(5000, docs[20][1] + " THE of"), (5001, docs[21][1].upper())]
    items = [(i, text(int(rng.integers(1, 25)))) for i in range(25)] + [(90, None), (91, ""), (92, "the the THE same"), (93, "unseen words only"), (94, "word1 word2 word996"), (94, "word1 word2 word996"), (None, "of w1 w2")]
    found = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string")
    want = brute_ranks(docs, items)
    assert len(want) > 200
    assert ranks_of(make(docs).repartition(3), found, **options) == want
    if not options:
        assert ranks_of(make(docs).limit(0), found) == [] and ranks_of(make(docs), found.limit(0)) == []


@settings(deadline=None, max_examples=200)
@given(st.lists(st.none() | st.text(st.sampled_from("aZ09 .é日\x00@[`{\x7f\U0001f600"), max_size=12), max_size=8))
def test_terms_of_any_text(texts):
    doc, terms = lexical.split(pa.array(texts, pa.string()))
    got = [[] for _ in texts]
    for d, t in zip(doc.tolist(), terms.to_pylist(), strict=True):
        got[d].append(t.decode())
    assert got == [terms_of(t) for t in texts]
    sliced = lexical.split(pa.array(["x y", *texts], pa.string())[1:])
    assert sliced[0].tolist() == doc.tolist() and sliced[1].equals(terms)


def test_long_lists_are_skipped():
    """A good document by its rare terms: of the long list, only its own posting is looked at."""
    n = 5 * lexical.WINDOW
    rng = np.random.default_rng(10)
    doc = np.concatenate([np.arange(n), rng.choice(n, 40, replace=False)])
    term = np.concatenate([np.zeros(n, np.int64), np.ones(40, np.int64)])
    seg = lexical.Segment(np.arange(n), np.zeros(n, bool), np.full(n, 10), doc, term, np.ones(len(doc), np.int64), np.array([5, 6000]), n, 10 * n)
    best = lexical.Best(10)
    seen = seg.search([(0, 1), (1, 1)], best, short=64)
    assert seen <= 40 and len(best.doc) == 10
    assert best.doc.tolist() == sorted(doc[n:].tolist())[:10]
