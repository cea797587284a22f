"""The positional index against the scan, and what a search reads."""

import math
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from sessionlake.operators import search, textindex
from sessionlake.operators.textindex import TextIndex, build

WORDS = ["a", "b", "ab", "abc", "ba", "Éa", "x1", "x12", "the", "of"]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(4)
    rows = [(f"s{i % 7}", i, " ".join(r.choice(WORDS) + r.choice(["", "", ",", "-", " \n"]) for _ in range(r.randrange(0, 14))), "user_message") for i in range(150)]
    rows += [("odd", 900, None, "user_message"), ("odd", 901, "", "user_message"), ("odd", 902, " ... ", "x"), ("long", 903, "a b " * 20_000 + "the end", "x")]
    return spark.createDataFrame(rows, "session_id string, seq int, text string, kind string")


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "here")
    build(texts, path, parts=8)
    return TextIndex(spark, path, parts=8)


QUERIES = ["a", "A B", '"a b"', '"a b a"', "ab*", "a-b", "a-b*", '"the of" OR "of the"', "a NOT b", "NOT a", 'NOT "a b" ab', "a OR NOT of", "zzz", "éa", '"" a', "NOT NOT a", "a AND x1*", "the end OR x12"]


@pytest.mark.parametrize("query", QUERIES)
def test_index_finds_what_the_scan_finds(texts, index, query):
    want = texts.where(search.predicate(F.coalesce("text", F.lit("")), query)).select("session_id", "seq").collect()
    assert sorted(index.matching(query).collect()) == sorted(want)


def test_ranking(index, texts):
    got = index.ranked('a OR "of the"', limit=None).collect()
    assert [(-r.score, r.session_id, r.seq) for r in got] == sorted((-r.score, r.session_id, r.seq) for r in got)
    docs = {(r.session_id, r.seq): [t for t in search_tokens(r.text)] for r in texts.collect()}
    mean = sum(map(len, docs.values())) / len(docs)
    tf = {k: (t.count("a"), sum(t[i : i + 2] == ["of", "the"] for i in range(len(t)))) for k, t in docs.items()}
    df = [sum(v[i] > 0 for v in tf.values()) for i in (0, 1)]
    idf = [math.log((len(docs) - d + 0.5) / (d + 0.5) + 1) for d in df]
    want = {k: sum(idf[i] * v[i] * 2.2 / (v[i] + 1.2 * (0.25 + 0.75 * len(docs[k]) / mean)) for i in (0, 1)) for k, v in tf.items() if any(v)}
    assert {(r.session_id, r.seq): r.score for r in got} == pytest.approx(want, abs=1e-4)
    assert len(index.ranked("a", limit=3).collect()) == 3


def search_tokens(text):
    return [t for t in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if t]


def test_a_search_reads_only_its_terms(index):
    rows = index.postings([("x1", True), ("of", False)])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan) and "StartsWith(term,x1)" in plan and "EqualTo(term,of)" in plan
    assert {r.term for r in rows.collect()} == {"x1", "x12", "of"}
    assert {r.part for r in rows.select("part").distinct().collect()} < set(range(8)) and rows.inputFiles()


def test_search_through_the_index_shows_the_same(spark, texts, index):
    sessions = texts.select("session_id").distinct().withColumns({"source": F.lit("s"), "project": F.lit("p")})
    for kind in (None, "x"):
        want = search.search(texts, sessions, '"a b"', kind=kind, limit=None).collect()
        assert search.search(texts, sessions, '"a b"', kind=kind, limit=None, index=index).select(*want[0].asDict()).collect() == want


def test_an_index_of_nothing(spark, tmp_path):
    build(spark.createDataFrame([("s", 1, None)], "session_id string, seq int, text string"), str(tmp_path / "i"))
    empty = TextIndex(spark, str(tmp_path / "i"))
    assert empty.matching("a").count() == 0 and empty.matching("NOT a").count() == 1
    assert empty.ranked("a OR b").count() == 0


def test_postings_take_no_shuffle(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, [])], "id int, terms array<string>")
    got = textindex.postings(rows, ["id"], 8)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.term, r.id, r.places, r.n) for r in got.collect()) == [("a", 1, [1], 3), ("b", 1, [0, 2], 3)]
