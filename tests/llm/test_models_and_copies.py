"""Language model, classifiers, fingerprints, near-duplicates and the pipeline against brute force or held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sessionlake.llm import fingerprints, langid, ngram, quality, simhash, toxicity
from sessionlake.llm.common import crc_mod

DATA = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


# language model


def test_lm_base_and_backoff(make, odd):
    rows = [*odd, *[(100 + i, f"the cat sat on the mat {i % 4}") for i in range(40)]]
    learn = crc_mod("doc_id", 7) != 2
    got = {}
    for r in ngram.score(make(rows), learn, block_bytes=2000, shard_words=300, shard_tokens=2000).collect():
        got.setdefault(r.doc_id, []).append(r)
    count = Counter()
    held = {}
    for doc, text, *_ in rows:
        held[doc] = zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2
        if not held[doc]:
            count.update([*(text or "").encode().lower().split(), b"\n"])
    n, v = sum(count.values()), len(count)
    for doc, text, *_ in rows:
        words = [*(text or "").encode().lower().split(), b"\n"]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        r = got[doc][0]
        assert (r.learns, r.n_tokens, r.n_known, r.train_tokens) == (not held[doc], len(words), sum(count[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert got[101][0].score > got[101][0].base_score
    assert sum(map(len, got.values())) == len(rows)
    assert ngram.score(make(rows).limit(0), learn).count() == 0
    assert {r.train_tokens for r in ngram.score(make(rows), F.lit(False)).collect()} == {0}


def test_lm_scores_do_not_depend_on_the_layout(make):
    """Frequent contexts, pairs and lines learn from the whole corpus, however texts are cut into blocks and shards."""
    rng = np.random.default_rng(2)
    words = [f"w{int(k)}" for k in rng.zipf(1.3, 6000) % 300]
    rows = [(i, " ".join(["the of", *words[20 * i : 20 * i + 20], "of the"][: 22 - i % 3])) for i in range(300)] + [(300 + i, "one very common line") for i in range(60)]
    rows += [(400, "the only pair the only pair"), (401, None), (None, "the of w1")]
    found = []
    for block_bytes, shard_tokens in ((1 << 23, 700_000), (1 << 23, 100), (700, 1000), (700, 100)):
        got = ngram.score(make(rows), crc_mod("doc_id", 7) != 2, block_bytes=block_bytes, shard_words=500, shard_tokens=shard_tokens).collect()
        found.append(sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.score) for r in got))
    assert len(found[0]) == len(rows) and all(f == found[0] for f in found)


def brute_trigram(train, base, d=ngram.DISCOUNT):
    """log10 p(w3 | w1, w2) straight from counts."""
    c3, c2, c12, c1 = Counter(train), Counter((b, c) for _, b, c in train), Counter((a, b) for a, b, _ in train), Counter(b for _, b, _ in train)
    kept2 = {g: n for g, n in c2.items() if n > 1 and g[1] != 0}

    def p2(b, c):
        mass = sum(n - d for g, n in kept2.items() if g[0] == b)
        if not mass:
            return base(c)
        return ((kept2[b, c] - d) / c1[b] if (b, c) in kept2 else 0) + (1 - mass / c1[b]) * base(c)

    def p3(a, b, c):
        if a == 0 or not any(g[0] == b for g in kept2):
            return p2(b, c)
        mine = {g: n for g, n in c3.items() if g[:2] == (a, b) and n > 1 and (b, g[2]) in kept2}
        mass = sum(n - d for n in mine.values())
        if not mass:
            return p2(b, c)
        return ((mine[a, b, c] - d) / c12[a, b] if (a, b, c) in mine else 0) + (1 - mass / c12[a, b]) * p2(b, c)

    return p3


def test_trie_against_counts_and_pointwise():
    rng = np.random.default_rng(2)
    triples = [tuple(int(x) for x in t) for t in rng.zipf(1.7, (4000, 3)) % 30]
    base = lambda c: 1 / (c + 2)
    w1, w2, w3 = np.array(triples, np.uint32).T
    codes = ngram.code(np.array([base(c) for c in w3]))
    trie = ngram.Trie(w1, w2, w3, codes)
    got = trie.score(w1[:400], w2[:400], w3[:400], codes[:400])
    p = brute_trigram(triples, base)
    for i in range(400):
        assert got[i] == pytest.approx(math.log10(p(*triples[i])), abs=2e-3)
    unknown = (np.array([x], np.uint32) for x in (5, 99, 1, 100))
    assert trie.score(*unknown)[0] == -100 / ngram.STEP


def test_lm_whole_against_counts(make):
    """Scores of whole texts, from words to sums, against a model straight from the counts of all training texts."""
    rng = np.random.default_rng(4)
    words = [f"w{int(k)}" for k in rng.zipf(1.4, 5000) % 400]
    rows = [(i, " ".join(words[12 * i : 12 * i + 12 - i % 5])) for i in range(400)] + [(400 + i, f"a common line w{i % 3}") for i in range(30)] + [(500, None)]
    learns = {d: zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in rows}
    tokens = {d: [*(t or "").split(), "\n"] for d, t in rows}
    count = Counter(w for d in tokens if learns[d] for w in tokens[d])
    n, v = sum(count.values()), len(count)
    number = {w: i + 2 for i, w in enumerate(w for w in count if count[w] > 1)}
    name = {i: w for w, i in number.items()}

    def triples(d):
        w = [0, 1, *(number.get(x, 0) for x in tokens[d])]
        return list(zip(w, w[1:], w[2:], strict=False))

    now = [""]
    p = brute_trigram([t for d in tokens if learns[d] for t in triples(d)], lambda c: (count[name.get(c, now[0])] + 1) / (n + v + 1))
    want = {}
    for d in tokens:
        total = 0.0
        for (a, b, c), w in zip(triples(d), tokens[d], strict=True):
            now[0] = w
            total += math.log10((count[w] + 1) / (n + v + 1) if b == 0 else p(a, b, c))
        want[d] = total
    for shard_tokens in (700_000, 200):
        for r in ngram.score(make(rows), crc_mod("doc_id", 7) != 2, block_bytes=3000, shard_words=100, shard_tokens=shard_tokens).collect():
            assert r.score == pytest.approx(want[r.doc_id], abs=3e-4 * r.n_tokens)


def test_elias_fano():
    v = np.sort(np.random.default_rng(0).integers(0, 10**9, 5000)).astype(np.uint64)
    e = ngram.EliasFano(v)
    assert np.array_equal(e.decode(), v) and np.array_equal(e.get(np.array([0, 77, 4999])), v[[0, 77, 4999]])
    asked = np.concatenate([v.astype(np.int64), v.astype(np.int64) + 1, [-1, 0, 10**9 + 5, 1 << 50]])
    for values in (v, np.arange(300, dtype=np.uint64), np.full(70, 3, np.uint64), np.zeros(5, np.uint64), np.array([1 << 40], np.uint64)):
        f, have = ngram.EliasFano(values), set(values.tolist())
        places = f.find(asked)
        assert all((i >= 0) == (a in have) and (i < 0 or values[i] == a) for a, i in zip(asked.tolist(), places.tolist(), strict=True))
    assert len(ngram.EliasFano(v[:0]).decode()) == 0 and len(e.low) + len(e.high) < 8 * len(v) / 2


# classifiers


def auc(score, label):
    order = np.argsort(np.argsort(score))
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_held_out(tables):
    docs, labels = tables
    learn = crc_mod("doc_id", 4) != 2
    net = quality.fit(docs, labels, learn)
    got = quality.score(docs, net, ["doc_id"]).join(labels, "doc_id").where(~learn).toPandas()
    assert auc(got.score.to_numpy(), got.quality.to_numpy()) > 0.9
    assert got.score.between(0, 1).all()


def test_filters_see_the_whole_text():
    net = quality.ConvNet(np.zeros((6, 256, 1), np.float32), np.zeros(1, np.float32), np.array([0, 1], np.float32), 0.0)
    net.filters[0, ord("$"), 0] = 50
    assert net.score(b"a" * 70_000) == 0.5
    for at in (0, 511, 512, 40_001, 69_990):
        assert net.score(b"a" * at + b"$" + b"a" * (70_000 - at)) > 0.99


def test_the_network_against_plain_loops():
    rng = np.random.default_rng(12)
    net = quality.ConvNet(rng.normal(size=(3, 256, 4)).astype(np.float32), rng.normal(size=4).astype(np.float32), rng.normal(size=8).astype(np.float32), 0.3)
    for n in (0, 1, 2, 3, 40, 511, 515, 1100, 9000):
        text = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        x = text.ljust(3, b"\0")
        z = np.array([[sum(float(net.filters[j, x[i + j], f]) for j in range(3)) for f in range(4)] for i in range(len(x) - 2)])
        blocks = [z[i : i + quality.BLOCK].max(0) for i in range(0, len(z), quality.BLOCK)]
        chunks = [np.maximum(a, b) for a, b in zip(blocks, blocks[1:], strict=False)] or blocks
        chunks = [np.maximum(c + net.bias, 0) for c in chunks]
        f = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)])
        assert net.score(text) == pytest.approx(1 / (1 + math.exp(-float(f @ net.out + net.out_bias))), abs=1e-4)


def test_noisy_or_against_plain_loops():
    bag = toxicity.Bag({"bad": 2.0, "worse": 3.5, "^worse": 0.5, "^horri": 1.5, "mild": -1.0}, -2.5)
    texts = ["", "Bad. Worse! mild bad?\nHorribly mild.", "nothing here. at all", "worse " * 50 + ". " + "bad\n" * 9]
    for t in texts:
        clean, spans = 1.0, []
        for a, b, z in bag.sentences(t):
            words = {w.lower() for w in re.findall(r"[^\W\d_]+", t[a:b])}
            held = words | {"^" + w[:5] for w in words if len(w) > 5}
            p = 1 / (1 + math.exp(-(bag.bias + sum(bag.weights.get(w, 0) for w in held))))
            clean *= 1 - p
            assert 1 / (1 + math.exp(-z)) == pytest.approx(p)
            spans += [(a, b)] if p >= 0.5 else []
        score, found = bag.score(t)
        assert score == pytest.approx(1 - clean, abs=1e-9) and [(a, b) for a, b, _ in found] == spans


def test_toxicity_learns_and_locates(make, spark):
    rng = np.random.default_rng(4)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows, marks = [], []
    for i in range(400):
        sents = [" ".join(rng.choice(words, 8)) for _ in range(6)]
        if i % 5 == 0:
            sents[3] += " vile"
        rows.append((i, ". ".join(sents)))
        marks.append((i, 1, int(i % 5 == 0)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    bag = toxicity.fit(make(rows), labels, crc_mod("doc_id", 5) != 0)
    got = {r.doc_id: r for r in toxicity.score(make(rows), bag, ["doc_id"]).collect()}
    for i, text in rows:
        assert (got[i].score >= 0.5) == (i % 5 == 0)
        assert ["vile" in text[o.start : o.start + o.length] for o in got[i].offending] == [True] * (i % 5 == 0)


def test_langid_held_out_and_exact(tables, make):
    docs, _ = tables
    learn = crc_mod("doc_id", 4) != 2
    model = langid.fit(docs, learn)
    got = langid.predict(docs, model, ["doc_id", "lang"]).where(crc_mod("doc_id", 4) == 2).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert [r.lang_pred for r in langid.predict(make([(1, None), (2, ""), (3, "12 !?")]), model, ["doc_id"]).collect()] == ["und"] * 3


def test_scores_of_odd_rows(make, odd, spark):
    docs, labels = make(odd), spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    learn = F.lit(True)
    for frame in (quality.score(docs, quality.fit(docs, labels, learn), ["doc_id"]), toxicity.score(docs, toxicity.fit(docs, labels, learn), ["doc_id"])):
        got = frame.collect()
        assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    none = docs.limit(0)
    assert quality.score(none, quality.fit(none, labels, learn), ["doc_id"]).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels, learn), ["doc_id"]).count() == 0
    assert langid.predict(docs, langid.fit(none, learn), ["doc_id"]).count() == len(odd)


def brute_bits(texts, text, order):
    """Code length of a text, byte by byte, from counts of plain dictionaries."""
    counts = {}
    for t in texts:
        b = b"\n" * order + t.lower().encode()
        for i in range(order, len(b)):
            for d in range(order + 1):
                counts.setdefault(b[i - d : i], Counter())[b[i]] += 1
    b, bits = b"\n" * order + text, 0.0
    for i in range(order, len(b)):
        for d in range(order, -1, -1):
            c = counts.get(b[i - d : i])
            if c and b[i] in c:
                bits -= math.log2(c[b[i]] / (sum(c.values()) + len(c)))
                break
            if c:
                bits -= math.log2(len(c) / (sum(c.values()) + len(c)))
        else:
            bits += 8
    return bits


def test_code_lengths_against_counts(monkeypatch):
    """Whole texts, all bytes and pieces of any size."""
    rng = np.random.default_rng(9)
    rows = [(k, "".join(rng.choice(list(letters), int(rng.integers(1, 400))))) for k, letters in (("x", "abcd é\n"), ("y", "cdef ß漢"), ("z", "abgh")) for _ in range(6)]
    asked = [rows[0][1], "abcabc Ω\x00 zzz", "漢漢 éß", "a", "".join(rng.choice(list("abcdefgh é漢q"), 700))]
    for order in (0, 2, 4):
        model = langid.train(rows, order)
        for piece in (1 << 17, 7):
            monkeypatch.setattr(langid, "PIECE", piece)
            for t in asked:
                want = [brute_bits([u for j, u in rows if j == k], t.encode(), order) for k in "xyz"]
                assert model.bits(t.encode()) == pytest.approx(want, rel=1e-5)


# fingerprints


def jaccard(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def test_fingerprints(make, odd):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice([f"t{i}" for i in range(120)], 150)) for _ in range(120)]
    rows = [*odd, *[(50 + i, t) for i, t in enumerate(texts)]]
    got = fingerprints.fingerprints(make(rows), rows_per_range=10).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want, near = Counter(), []
    for i, (doc, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want[doc, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
        near.append((doc, jaccard(text, edited), jaccard(text, after)))
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    big = [(by[d], e, n) for d, e, n in near if d and d >= 50]
    for real, name in ((1, "near_edited"), (2, "near_next")):
        err = np.array([r[name] for r, *_ in big]) - np.array([x[real] for x in big])
        assert abs(err.mean()) < 0.04 and np.sqrt((err**2).mean()) < 0.12
    same = {r.fingerprint for r in got if r.doc_id in (1, 7)}
    assert len(same) == 1 and by[3].fingerprint == by[4].fingerprint == by[2].fingerprint
    # likeness is the share of equal samples, of which fingerprints hold 8 digits each
    cut = lambda f: [f[i : i + 8] for i in range(0, len(f), 8)]
    for r in got:
        a, b = cut(r.fingerprint), cut(r.edited_fingerprint)
        assert len(a) == len(b) == 32 and r.near_edited == np.mean([x == y for x, y in zip(a, b, strict=True)])
    assert {(by[d].near_edited, by[d].near_next) for d in (3,)} == {(1.0, 1.0)}
    assert fingerprints.fingerprints(make(rows).limit(0)).count() == 0


def test_samples_collide_at_the_generalised_jaccard_rate(spark):
    """Many samples of a few weighted bags, with weights far apart: the collision rate is sum(min) / sum(max)."""
    bags = {"a": {1: 1, 2: 5, 3: 40, 4: 2}, "b": {1: 3, 2: 5, 3: 20, 5: 7}, "c": {3: 1}, "d": {3: 400, 1: 1}}
    rows = [(k, w, float(n)) for k, bag in bags.items() for w, n in bag.items()]
    drawn = {k: [] for k in bags}
    for lo in range(0, 640, 32):
        one = [F.min(fingerprints.sample(F.xxhash64("w"), F.log("n"), k)).alias(f"s{k}") for k in range(lo, lo + 32)]
        for r in spark.createDataFrame(rows, "k string, w long, n double").coalesce(1).groupBy("k").agg(*one).collect():
            drawn[r.k] += list(r)[1:]
    for x in bags:
        for y in bags:
            words = {*bags[x], *bags[y]}
            j = sum(min(bags[x].get(w, 0), bags[y].get(w, 0)) for w in words) / sum(max(bags[x].get(w, 0), bags[y].get(w, 0)) for w in words)
            rate = np.mean([a == b for a, b in zip(drawn[x], drawn[y], strict=True)])
            assert abs(rate - j) < 4 * math.sqrt(j * (1 - j) / 640) + 1e-9


# near-duplicates


def brute_print(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(make, odd, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 4)
    rng = np.random.default_rng(7)
    rows = list(odd)
    for i in range(150):
        words = rng.choice([f"v{i}" for i in range(400)], 120).tolist()
        rows.append((1000 - 5 * i, " ".join(words)))
        for c in range(3):
            words[int(rng.integers(120))] = "new"
            rows.append((1000 - 5 * i - 1 - c, "  ".join(words).upper()))
    docs = make(rows)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits().alias("f"), "component_id").collect()
    prints = [brute_print(r[1]) for r in rows]
    comp = brute_components(prints)
    least = {}
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            least[c] = min(least.get(c, 10**9), rows[i][0])
    assert Counter((r.doc_id, r.f, r.component_id) for r in got) == Counter((rows[i][0], f"{prints[i]:016x}", least.get(comp[i])) for i in range(len(rows)))
    assert len(set(comp)) < len(rows) - 100
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def brute_sets(rows, k=5):
    out = []
    for text in rows:
        words = (text or "").lower().split()
        out.append({" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} or ({" ".join(words)} if words else set()))
    return out


def brute_groups(sets, least=0.8):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= least * len(a | b)):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("group", [20_000, 40])
def test_similar_groups_and_keep_one(make, odd, group):
    """Against all pairs by exact Jaccard; with groups of 40, large views are cut into parts."""
    rng = np.random.default_rng(8)
    rows = list(odd)
    vocabulary = [f"v{i}" for i in range(3000)]
    for i in range(60):
        words = rng.choice(vocabulary, int(rng.integers(30, 400))).tolist()
        rows.append((1000 - 5 * i, " ".join(words)))
        for c in range(4):
            words[int(rng.integers(len(words)))] = "new"
            rows.append((1000 - 5 * i - 1 - c, "  ".join(words).upper()))
    family = rng.choice(vocabulary, 200).tolist()
    for i in range(150):  # one large group of near copies
        words = list(family)
        for _ in range(int(rng.integers(1, 4))):
            words[int(rng.integers(200))] = f"x{i}"
        rows.append((2000 + i, " ".join(words)))
    rows += [(50, "alpha beta gamma delta"), (50, "z z z"), (None, "another keyless text"), (None, "one more of them")]
    docs = make(rows)
    sets = brute_sets([r[1] for r in rows])
    comp = brute_groups(sets)
    found = {(r.doc_id, r.h1): r.component for r in simhash.similar_groups(docs, group=group).collect()}
    hashes = docs.select("doc_id", simhash.text_hash()[0]).collect()
    got = [found[r.doc_id, r.h1] for r in hashes]
    assert len(set(zip(got, comp))) == len(set(comp)) == len(set(got))
    kept = simhash.keep_one(docs, group=group)
    assert kept.columns == docs.columns
    texts = Counter((r.doc_id, r.text or "") for r in kept.collect())
    want = {}
    for r, c in zip(rows, comp, strict=True):
        want.setdefault(c, []).append((r[0] is None, r[0] or 0))
    assert Counter(d for d, _ in texts.elements()) == Counter(None if min(v)[0] else min(v)[1] for v in want.values())
    assert max(texts.values()) == 1 and texts[50, "z z z"] == texts[50, "alpha beta gamma delta"] == 1
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_where_the_nearest_pair_fails_the_next_one_is_tried(make):
    """b and c are near copies, a is like c and not like b, but by the estimate it is nearer to b."""
    rng, rows, want = np.random.default_rng(3), [], []
    while len(rows) < 12:
        w = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        a, b, c = " ".join([f"n{x}" for x in rng.integers(0, 10**6, 21)] + w[21:-2]), " ".join(w), " ".join(w[:-2])
        prints = [np.frombuffer(simhash.sketch(simhash.shingles(t, 5))[0], np.uint64) for t in (a, b, c)]
        if simhash.apart(prints[0], prints[1]) < simhash.apart(prints[0], prints[2]):
            k = len(rows)
            rows += [(k, a), (k + 1, b), (k + 2, c)]
            want.append(k)
    sets = brute_sets([t for _, t in rows])
    for k in want:
        assert len(sets[k] & sets[k + 1]) < 0.8 * len(sets[k] | sets[k + 1]) and len(sets[k] & sets[k + 2]) >= 0.8 * len(sets[k] | sets[k + 2])
    groups = {r.doc_id: r.component for r in simhash.similar_groups(make(rows)).collect()}
    for k in want:
        assert groups[k] == groups[k + 1] == groups[k + 2]
    assert len(set(groups.values())) == len(want)


def test_label_links_against_all_pairs():
    """Sets of random sizes: the labels that links join are those that all alike pairs join, and each link is one."""
    rng = np.random.default_rng(4)
    base = [rng.choice(5000, 80, replace=False) for _ in range(6)]
    sets = []
    for i in range(200):
        s = base[i % 6].copy()
        s[rng.choice(80, int(rng.integers(0, 14)), replace=False)] = rng.integers(5000, 10**6)
        sets.append(np.unique(s[: int(rng.integers(60, 81))]).astype(np.uint64))
    label = rng.integers(0, 120, 200)
    fp = np.stack([np.frombuffer(simhash.sketch(s)[0], np.uint64) for s in sets])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(0, 200, 2), np.arange(200), indexing="ij"))
    a, b = a[label[a] != label[b]], b[label[a] != label[b]]
    similar = lambda x, y: len(np.intersect1d(sets[x], sets[y])) / len(np.union1d(sets[x], sets[y])) >= 0.8 - 1e-9
    got = simhash.label_links(a, b, simhash.apart(fp[a], fp[b]), sets, label, simhash.Forest(200), 0.8, run=3)
    assert got and all(similar(x, y) for x, y in got)
    every, some = simhash.Forest(200), simhash.Forest(200)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if similar(x, y):
            every.link(label[[x]], label[[y]])
    some.link(*(label[list(z)] for z in zip(*got, strict=True)))
    assert [every.find(i) for i in range(200)] == [some.find(i) for i in range(200)]
    assert len(got) == 200 - len({every.find(i) for i in range(200)})


@pytest.mark.parametrize("group", [60, 1_000_000])
def test_hot_nodes(spark, group):
    """Stars of many leaves, chained: nodes over the limit take the broadcast."""
    edges = [(0, i) for i in range(1, 400)] + [(399, 1000 + i) for i in range(400)] + [(5000, 5001)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long"), group=group).collect()}
    assert got == {**{i: 0 for i in (*range(1, 400), *range(1000, 1400))}, 5001: 5000}


@pytest.mark.parametrize("group", [40, 1_000_000])
def test_long_chain(spark, group):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges, group=group).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


# pipeline


def test_pipeline(spark, tables):
    docs, labels = tables
    made, now = [], docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(DATA)).cache()
        made.append((name, now))
        if name != "packing":
            assert now.columns == docs.columns
    (_, good), (_, clean), (_, single), (_, mixed), (_, packed) = made
    truth = {r.doc_id: r for r in labels.collect()}
    kept = {r.doc_id for r in good.collect()}
    ids = {r.doc_id for r in docs.collect()}
    assert sum(i in kept for i, t in truth.items() if t.quality == 1) > 0.9 * sum(t.quality == 1 for t in truth.values())
    assert sum(i in kept for i, t in truth.items() if t.quality == 0) < 0.2 * sum(t.quality == 0 for t in truth.values())
    assert {r.doc_id for r in clean.collect()} <= kept <= ids
    rows = clean.collect()
    comp = brute_groups(brute_sets([r.text for r in rows]))
    least = {}
    for r, c in zip(rows, comp, strict=True):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in single.collect()) == sorted(least.values())
    text = {r.doc_id: r.text for r in single.collect()}
    taken = Counter()
    for r in mixed.collect():
        assert text[r.doc_id].startswith(r.text)
        taken[r.source] += len(r.text.split())
    words = sum(len(t.split()) for t in text.values())
    assert sum(taken.values()) == pytest.approx(1.5 * words, rel=0.01)
    assert Counter(r.doc_id for r in packed.where("piece = 0").collect()) == Counter(r.doc_id for r in mixed.collect())
    run = corpus_pipeline.run(spark, str(DATA))
    assert sorted(run.select("doc_id", "piece", "ids_crc32").collect()) == sorted(packed.select("doc_id", "piece", "ids_crc32").collect())


def test_pipeline_stages_on_odd_rows(spark, make, odd):
    """Every stage takes nulls, empty and long texts, repeated rows and keys, an empty table, and columns whose names clash."""
    odd = [*odd, (9, "same key, one text of some words"), (9, "same key and quite another text here"), (None, "no key, more words than before")]
    names = ["doc_id", "text", "lang", "source", "n_chars", "offending", "score", "block", "size", "row", "key", "c", "__score", "same key"]
    docs = make(odd).select("doc_id", "text", "lang", "source", "n_chars", *(F.lit("x").alias(n) for n in names[5:]))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(DATA))
        rows = got.collect()
        assert stage(spark, docs.limit(0), str(DATA)).count() == 0
        if name == "packing":
            assert sum(r.piece == 0 for r in rows) == len(odd)
            continue
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        keys = Counter((r.doc_id, r.text) for r in rows)
        if name == "toxicity":
            assert sum(keys.values()) == len(odd)
        elif name == "near_duplicates":
            assert keys[9, odd[-3][1]] == keys[9, odd[-2][1]] == keys[None, "no key here"] == keys[None, odd[-1][1]] == 1 and keys[1, "a b c d e f"] == 1
        elif name == "mixing":
            # one source: its target is one and a half times its words, of which each row gives at most twice its own
            total = sum(len((t or "").split()) for _, t, *_ in odd)
            assert sum(len(r.text.split()) for r in rows) == pytest.approx(1.5 * total, abs=1)
            assert {d for d, _ in keys} >= {d for d, t, *_ in odd if t and t.split()} and all(r.n_chars == len(r.text) for r in rows)
