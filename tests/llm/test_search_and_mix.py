"""Nearest neighbours, mixing, packing and chat against brute force."""

import hashlib
import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sessionlake.llm import ann, chat, mixing, packing

# nearest neighbours


def exact(vecs, queries, k):
    out = set()
    for q in queries:
        d = sorted((float(np.sqrt(((np.array(vecs[q]) - np.array(v)) ** 2).sum())), i) for i, v in vecs.items() if i != q)
        out |= {(q, i) for _, i in d[:k]}
    return out


def test_ann_repeated_rows_leave_room_for_other_ids(spark):
    rows = [(1, [1.0, 2.0])] * 40 + [(i, [1.0, 2.0]) for i in range(2, 6)] + [(9, [5.0, 5.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 9, k=3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3]


def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 16))
    vecs = {i: (centres[i % 5] + 0.4 * rng.normal(size=16)).tolist() for i in range(800)}
    for i in range(0, 800, 3):
        vecs[i] = vecs[0]  # a third of all rows are one vector
    df = spark.createDataFrame([(i, v) for i, v in vecs.items()], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 50 == 0).collect()
    queries = [i for i in vecs if i % 50 == 0]
    assert Counter(r.query_id for r in got) == {q: 10 for q in queries}
    found = {(r.query_id, r.vec_id) for r in got}
    assert len(found & exact(vecs, queries, 10)) / len(found) >= 0.9
    same = [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0]
    assert same == [3, 6, 9, 12, 15, 18, 21, 24, 27, 30]
    for r in got:
        assert r.score == pytest.approx(float(np.linalg.norm(np.array(vecs[r.query_id]) - np.array(vecs[r.vec_id]))), abs=1e-12)


def test_ann_ties_at_the_edge_go_to_smaller_ids():
    # points of a grid, many of them equally far; whatever their order, the smaller ids win
    rng = np.random.default_rng(5)
    grid = np.array([(x, y, z) for x in range(-4, 5) for y in range(-4, 5) for z in range(-4, 5)], dtype=float)
    for _ in range(5):
        ids = rng.permutation(len(grid))
        q = grid[rng.integers(0, len(grid), 7)] * 1.0
        left = pa.table({"key": np.zeros(len(grid), np.int64), "x": pa.array(grid.tolist()), "ids": pa.array([[int(i)] for i in ids])})
        right = pa.table({"key": np.zeros(7, np.int64), "vec_id": np.arange(1000, 1007), "x": pa.array(q.tolist())})
        got = ann.nearest_in(10, left, right).to_pandas()
        for n in range(7):
            d = np.sqrt(((grid - q[n]) ** 2).sum(1))
            want = sorted(zip(d, ids))[:10]
            mine = got[got.query_id == 1000 + n].sort_values(["score", "vec_id"])
            assert list(zip(mine.score, mine.vec_id)) == [(a, b) for a, b in want]


def test_ann_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (None, [1.0, 2.0]), (6, []), (100, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 1.0), (0, 2, 100, 1.0), (100, 1, 0, 1.0), (100, 2, 5, pytest.approx(2**0.5))]
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_ann_components_of_any_size(spark):
    """Squares of these components overflow, or vanish."""
    rng = np.random.default_rng(6)
    vecs = {i: (rng.normal(size=4) * (1e200 if i < 20 else 1e-200)).tolist() for i in range(40)}
    df = spark.createDataFrame([*vecs.items()], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 10 == 0, k=3).collect()

    for q in (0, 10, 20, 30):
        far = lambda i, q=q: math.dist(vecs[q], vecs[i])
        want = sorted((far(i), i) for i in vecs if i != q)[:3]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [i for _, i, _ in mine] == [i for _, i in want]
        assert [s for *_, s in mine] == pytest.approx([d for d, _ in want], rel=1e-12)


def test_draws_of_any_size():
    """Beyond numpy's limit: sums, bounds and moments of the draws."""
    good, bad, take = 3 * 10**9, 10**9, 10**6
    x = np.array([mixing.hypergeometric(good, bad, take, np.random.default_rng(i)) for i in range(400)])
    assert abs(x.mean() - 0.75 * take) < 5 * math.sqrt(take * 0.1875 / 400) and 0.85 < x.std() / math.sqrt(take * 0.1875) < 1.15
    quotas = np.array([4 * 10**10, 1, 0, 5 * 10**9])
    for seed in range(5):
        left = mixing.split(quotas, 2 * 10**10, np.random.default_rng(seed))
        assert left.sum() == 2 * 10**10 and (left >= 0).all() and (left <= quotas).all()
    start, n = mixing.leaf(quotas, 10**8, 77, 1)
    again, after = mixing.leaf(quotas, 10**8, 78, 1)
    assert (start + n <= quotas).all() and abs(int(n.sum()) - 450) <= 1 and (again >= start + n).all() and after.sum() > 0
    small = mixing.hypergeometric(5, 10**9, 10**9 + 5, np.random.default_rng(1)), mixing.hypergeometric(0, 10**9, 7, np.random.default_rng(1))
    assert small == (5, 0)


def test_probe_order():
    sets = ann.perturbations(4, 30)
    assert sets[0] == [0] and len({tuple(s) for s in sets}) == 30
    assert all(len({min(j, 7 - j) for j in s}) == len(s) for s in sets)


# mixing


def water_fill(sizes, weights, share, most):
    """Brute force: reshare the excess by weight until no target is above its cap."""
    left, open_, target = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


def test_mixing(spark, make):
    rng = np.random.default_rng(3)
    names = ["a", "B", "é", "z", None]
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), "en", "a" if i % 3 == 0 else names[int(rng.integers(5))]) for i in range(1500)]
    planned = mixing.plan(make(rows), shard_blocks=8).collect()
    order = ["B", "a", "z", "é", None]
    size = {n: sum(len(r[1].split()) for r in rows if r[3] == n) for n in order}
    target = water_fill([size[n] for n in order], [5, 2, 1, 5, 2], 1.5, 2.0)
    assert len(planned) == 1500
    for n, t in zip(order, target, strict=True):
        mine = [r for r in planned if r.row.source == n]
        assert mine[0].target == pytest.approx(t) and mine[0].source_size == size[n]
        assert abs(sum(r.first + r.second for r in mine) - t) <= 1
    assert all(r.first + r.second <= 2 * r.size for r in planned)
    assert all((r.first > 0) <= (r.first_shard is not None) and (r.second > 0) <= (r.second_shard is not None) for r in planned)
    again = mixing.plan(make(rows).repartition(7), shard_blocks=8).collect()
    assert sorted(map(str, planned)) == sorted(map(str, again))
    mixed = mixing.mix(mixing.plan(make(rows), shard_blocks=8)).collect()
    assert sum(r.words for r in mixed) == sum(r.first + r.second for r in planned)
    shards = Counter(r.shard for r in mixed)
    assert len(shards) > 4
    # each shard is one run in the order of its places, which is not the order of documents
    runs = [r.shard for i, r in enumerate(mixed) if i == 0 or mixed[i - 1].shard != r.shard]
    assert len(runs) == len(shards) and all(a.place <= b.place for a, b in zip(mixed, mixed[1:]) if a.shard == b.shard)
    # a row's takings lie where the splitting tree has put the draws of its block
    where = {(r.row.doc_id, s) for r in planned for s, n in ((r.first_shard, r.first), (r.second_shard, r.second)) if n}
    assert {(r.row.doc_id, r.shard) for r in mixed} == where


def test_splitting_tree_gives_each_draw_once():
    q = np.array([50, 0, 7, 300], np.int64)
    leaves = [mixing.leaf(q, 13, s, 5) for s in range(13)]
    assert np.array_equal(sum(n for _, n in leaves), q)
    for k in range(4):
        seen = sorted(d for start, n in leaves for d in range(start[k], start[k] + n[k]))
        assert seen == list(range(q[k]))
    assert max(int(n.sum()) for _, n in leaves) - min(int(n.sum()) for _, n in leaves) <= 4


def test_mixing_odd_rows(make, odd):
    got = mixing.plan(make(odd)).collect()
    assert len(got) == len(odd) and sum(r.first + r.second for r in got) == pytest.approx(got[0].target, abs=1)
    assert mixing.plan(make(odd).limit(0)).count() == 0


# packing


@lru_cache(maxsize=1)
def contract():
    return Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def brute_ids(text):
    return [*contract().encode(text or "", add_special_tokens=False).ids, 2]


def test_packing_round_trip(make, odd):
    got = packing.packed(make(odd), open_bins=4).collect()
    expected = Counter()
    for doc, text, *_ in odd:
        ids = np.array(brute_ids(text), "<u4")
        first = (len(ids) - 1) % 1024 + 1
        at = 0
        for piece, stop in enumerate(range(first, len(ids) + 1, 1024)):
            expected[(doc, piece, at, stop - at, zlib.crc32(ids[at:stop].tobytes()))] += 1
            at = stop
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.packed(make(odd).limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 'sé\x1c\n\t\r\x0b 　.1Ω漢<|>"), max_size=40))
def test_ids_by_word_are_ids_of_text(text):
    words = packing.tokens(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    words.forget()
    assert [*words.encode(pa.array([text]))[0].tolist(), 2] == brute_ids(text)
    ids, ends = words.encode(pa.array(["x", text, None, "", text + " y"]))
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [brute_ids(t)[:-1] for t in ("x", text, "", "", text + " y")]


def test_ids_of_all_texts_of_the_tables():
    """Every text of sf0.01, in one batch and in two orders, against the contract's tokenizer."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks()
    t = contract()
    want = [x.ids for x in t.encode_batch([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
    words = packing.Tokens(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), most=20_000)
    for order in (np.arange(len(texts)), np.arange(len(texts))[::-1]):
        for lo in range(0, len(order), 300):
            pick = order[lo : lo + 300]
            ids, ends = words.encode(texts.take(pa.array(pick)))
            assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [want[i] for i in pick]


def test_ids_of_added_tokens(make):
    """The contract's tokenizer, with its default setting, reads added tokens in a text."""
    t = contract()
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b ", "<|endoftext|", "no mark", " <|endoftext|>  x"]
    words = packing.tokens(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    ids, ends = words.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert words.encode(pa.array(texts[:1]))[0].tolist() == [64, 220, 50256, 275]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.packed(make(list(enumerate(texts)))).collect()}
    assert got == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in enumerate(t.encode(y, add_special_tokens=False).ids for y in texts)}


def test_best_fit_and_fullest_closes_first():
    p = packing.Packer(10, 2)
    assert [p.put(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    p = packing.Packer(10, 2)
    assert [p.put(n) for n in (5, 6, 8, 5)] == [(0, 0), (1, 0), (2, 0), (0, 5)]  # bin 1 was the fuller one


# chat


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))


def test_chat_round_trip(spark):
    rng = np.random.default_rng(5)
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (9, 1, "assistant", None), (9, 0, None, "<|end|>\n<|user|>\n\\<"), (None, 0, "user", ""), (10, 0, "od|>\nd\\", "a"), (10, 1, "|>\n<|x|>\n", "b|>\n"), (10, 2, "|\\|", "c")]
    for c in range(6):
        n = [1, 5, 40, 400, 8, 3000][c]
        for t in range(n):
            role = "system" if t == 0 and c % 2 else ["user", "assistant"][t % 2]
            rows.append((c, t, role, "<\\[é|> x" * int(rng.integers(0, 60 if c != 4 else 900))))
    made = chat.windows(turns(spark, rows), section=512).cache()
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == conv], key=lambda r: r[1])
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        target = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(target), hashlib.sha256(target.encode()).hexdigest())
    for w in made.collect():
        assert "</s>" not in w.formatted and "[INST]" not in w.formatted
        own = w.formatted.split("<|end|>\n")[w.repeated : -1]
        tokens = [len(chat_text(x).encode()) // -4 * -1 + 4 for x in own]
        assert len(own) == 1 or sum(tokens) <= 1024 - 256 - 256
        if w.conv_id in (1, 3, 5):
            assert w.formatted.startswith("<|system|>\n") or sum(tokens) > 0
    assert chat.read_back(chat.windows(turns(spark, rows).limit(0))).count() == 0


def chat_text(piece):
    body = piece.split("|>\n", 1)[1]
    out, i = [], 0
    while i < len(body):
        out.append(body[i])
        i += 2 if body[i] in "<[\\" else 1
    return "".join(out)


def test_chat_keeps_the_system_turn_and_history(spark):
    """Every window has the system turn, however long, and the turns before it, also across sections and where turn numbers are sparse."""
    rule = "rule " + "s" * 1600
    rows = [(1, 0, "system", rule), *((1, t, ["user", "assistant"][t % 2], f"{t} " + "x" * 300) for t in range(1, 12))]
    rows += [(2, 1_700_000_000 + 5000 * t, ["user", "assistant"][t % 2], f"{t} .") for t in range(40)]
    rows += [(3, 0, "system", "s" * 9000), (3, 1, "user", "a"), (3, 2, "assistant", "b")]
    made = chat.windows(turns(spark, rows), section=16).collect()
    for w in made:
        said = [chat_text(x) for x in w.formatted.split("<|end|>\n")[:-1]]
        tokens = sum(-(-len(x.encode()) // 4) + 4 for x in said)
        assert tokens <= 1024 or w.conv_id == 3
        if w.conv_id != 2:
            assert w.formatted.startswith("<|system|>\n") and w.formatted.count("<|system|>") == 1
        elif w.section:
            assert w.repeated == 3 and said[:3] == [f"{16 * w.section - k} ." for k in (3, 2, 1)]
    assert len([w for w in made if w.conv_id == 2]) == 3
    back = {r.conv_id: r.n_turns for r in chat.read_back(spark.createDataFrame(made)).collect()}
    assert back == {1: 12, 2: 40, 3: 3}


def test_chat_masks_what_it_repeats(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"{t} " + "x" * 300) for t in range(12)]
    got = chat.windows(turns(spark, rows), budget=600, history=200, system=0).orderBy("window").collect()
    assert len(got) > 2 and any(w.repeated for w in got[1:])
    assert sorted(w.formatted[s.start : s.start + s.length].split()[0] for w in got for s in w.loss) == sorted(str(t) for t in range(1, 12, 2))
