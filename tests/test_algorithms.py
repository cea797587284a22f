"""Interval owners, exact medians and names in texts against loops over random data."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from sessionlake.functions.intervals import with_owner
from sessionlake.functions.medians import medians
from sessionlake.operators import experiments
from sessionlake.operators.experiments import held_names


def owner(t, spans):
    """By the rule: the first that holds it, else the first that ends later, else the last."""
    order = sorted(spans)
    holds = [i for i, a, b in order if a <= t <= b]
    later = [i for i, _, b in order if b >= t]
    return holds[0] if holds else later[0] if later else order[-1][0] if order else None


def owners(spark, points, spans):
    p = spark.createDataFrame(points, "s string, n int, t long")
    q = spark.createDataFrame(spans, "s string, i int, a long, b long")
    return {(r.s, r.n): r.i for r in with_owner(p, "t", q, "a", "b", "i", "s", "own").select("s", "n", "own.i").collect()}


def test_owner_of_a_point(spark):
    r = random.Random(8)
    points, spans, want = [], [], {}
    for k in range(60):
        s, wild = f"s{k}", k % 3 == 0
        mine, t = [], 0
        for i in range(r.randrange(0, 12)):
            a = r.randrange(0, 60) if wild else t + r.randrange(0, 4)  # in the others, turns follow each other, with gaps
            b = a + r.randrange(-3 if wild else 0, 25 if wild else 6)
            mine.append((i, a, b))
            t = b
        spans += [(s, *m) for m in mine]
        for n in range(12):
            at = r.randrange(-5, 80)
            points.append((s, n, at))
            want[s, n] = owner(at, mine)
    assert owners(spark, points, spans) == want


def test_owners_in_a_session_of_many_turns(spark):
    n = 100_000
    spans = spark.range(n).select(F.lit("s").alias("s"), F.col("id").cast("int").alias("i"), (F.col("id") * 10).alias("a"), (F.col("id") * 10 + 8).alias("b"))
    points = spark.range(n).select(F.lit("s").alias("s"), F.col("id").cast("int").alias("n"), (F.col("id") * 10 + F.col("id") % 10).alias("t"))
    got = with_owner(points, "t", spans, "a", "b", "i", "s", "own")
    late = F.when((F.col("n") % 10 == 9) & (F.col("n") < n - 1), F.col("n") + 1).otherwise(F.col("n"))
    assert got.where(F.col("own.i") != late).count() == 0 and got.count() == n


@pytest.mark.parametrize("most", [5, 100_000])
def test_median_of_any_group(spark, most):
    r = random.Random(9)
    groups = {"even": [r.random() for _ in range(400)], "odd": [r.gauss(0, 1e6) for _ in range(401)], "one": [3.5], "two": [1.0, 2.0], "tied": [7.0] * 300 + [r.random() for _ in range(290)], "halves": [0.0] * 200 + [1.0] * 200, "wide": [10.0 ** r.randrange(-300, 300) * r.choice((-1, 1)) for _ in range(333)], "all": [2.0] * 50}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("none", float("nan")), ("two", None), (None, 4.0), (None, 6.0)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {x.g: x.m for x in medians(df, ["g"], "v", "m", most=most, cuts=4).collect()}
    assert got == pytest.approx({g: statistics.median(vs) for g, vs in groups.items()} | {None: 5.0})
    assert [x.m for x in medians(df, [], "v", "m", most=most).collect()] == [pytest.approx(statistics.median([v for vs in groups.values() for v in vs] + [4.0, 6.0]))]
    assert medians(df.where("g = 'none'"), ["g"], "v", "m").count() == 0


def test_names_in_texts(spark):
    r = random.Random(10)
    part = lambda n: "".join(r.choice("ab.É ") for _ in range(n))
    names = [(f"s{r.randrange(4)}", part(r.randrange(0, 6))) for _ in range(120)] + [("s9", "lost.py"), ("s1", None)]
    texts = [(f"s{r.randrange(5)}", part(r.randrange(0, 40))) for _ in range(60)] + [("s0", None), ("s1", "")]
    want = {(s, b) for s, b in names if b and any(t and s == o and b in t for o, t in texts)}
    n, t = spark.createDataFrame(names, "session_id string, base string"), spark.createDataFrame(texts, "session_id string, text string")
    for piece in (4, 65_536):
        assert {tuple(x) for x in held_names(n, t, piece=piece).collect()} == want


@pytest.mark.parametrize("few", [0, 3, 4_096])
def test_names_of_rich_and_long_sessions(spark, few):
    """Sessions on both sides of `few`, long ones dealt into parts, names with white space in them and words that repeat."""
    r = random.Random(15)
    part = lambda n: "".join(r.choice("ab.É \n") for _ in range(n))
    names = [(f"s{min(r.randrange(9), 5)}", part(r.randrange(0, 5))) for _ in range(90)] + [("s7", "a"), (None, "a")]
    texts = [(f"s{r.randrange(7)}", part(r.randrange(0, 30))) for _ in range(80)] + [("s8", "a"), (None, "a"), ("s1", None)]
    want = {(s, b) for s, b in names if s and b and any(t and s == o and b in t for o, t in texts)}
    n, t = spark.createDataFrame(names, "session_id string, base string"), spark.createDataFrame(texts, "session_id string, text string").repartition(3)
    got = [tuple(x) for x in held_names(n, t, few=few, share=50, piece=7).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_few_names_need_no_grams(spark, monkeypatch):
    """Texts of sessions with few names are not taken apart: rows grow with the texts, not with their characters."""
    monkeypatch.setattr(experiments, "grams", lambda *_: pytest.fail("texts were cut into grams"))
    n = spark.createDataFrame([("s", "lib.rs"), ("s", "gone.rs")], "session_id string, base string")
    t = spark.createDataFrame([("s", "see lib.rs, then " * 50)], "session_id string, text string")
    assert [tuple(x) for x in held_names(n, t).collect()] == [("s", "lib.rs")]
