"""Kept sums and findings against scans from scratch, and functions in SQL."""

import random
import re

from pyspark.sql import functions as F
from test_lake import LATER, talk

from sessionlake.functions import sql
from sessionlake.operators import cost, review, sessions, totals
from sessionlake.sources.lake import Lake
from sessionlake.streaming.ingest import one_pass, rebuild


def rows(df):
    return sorted(map(str, df.collect()))


def same(spark, lake):
    """Kept sums give what the tables give."""
    prices = cost.prices_frame(spark, cost.price_book({"alpha": (3, 15)}))
    s, t = lake.read("sessions"), lake.read("turns")
    sums, usage = lake.sums("session_sums"), lake.sums("usage_sums")
    if s is None:
        assert sums is None or sums.count() == 0
        return
    want = sessions.overview(s, 9)
    assert rows(totals.overview(sums, 9).select(want.columns)) == rows(want)
    assert rows(totals.by_source(sums)) == rows(sessions.by_source(s))
    assert rows(totals.cost(usage, prices, "day", as_model="alpha-x")) == rows(cost.cost(t, s, prices, "day", as_model="alpha-x"))


def test_sums_follow_replacements_deletions_and_rebuilds(spark, tmp_path):
    src, lake = tmp_path / "in", Lake(spark, str(tmp_path / "lake"), buckets=3)
    for k in range(5):
        talk(src / f"s{k}.jsonl", k + 1)
    one_pass(spark, lake, "claude-code", [str(src)], now_ns=LATER)
    talk(src / "s2.jsonl", 7)
    one_pass(spark, lake, "claude-code", [str(src)], now_ns=LATER + 1)
    same(spark, lake)
    assert totals.overview(lake.sums("session_sums")).first().turns == 1 + 2 + 7 + 4 + 5
    lake.delete_sessions(lake.read("sessions").where("session_id in ('s0', 's3')"))
    same(spark, lake)
    wrong = lake.pinned(lake.read("sessions").withColumn("pipeline_version", F.lit(1)))
    lake.overwrite("sessions", wrong, None, "bucket")
    rebuild(spark, lake, "claude-code", [str(src)], now_ns=LATER + 2)
    assert totals.overview(lake.sums("session_sums"), 4).first().stale == 0
    # a run that was lost between tables and sums
    lake.forget(lake.read("sessions").select("source", "bucket").distinct().limit(1))
    same(spark, lake)
    lake.delete_sessions(lake.read("sessions"))
    same(spark, lake)


def test_a_refresh_reads_only_its_buckets(spark, tmp_path, monkeypatch):
    src, lake = tmp_path / "in", Lake(spark, str(tmp_path / "lake"), buckets=4)
    for k in range(8):
        talk(src / f"s{k}.jsonl", 1)
    one_pass(spark, lake, "claude-code", [str(src)], now_ns=LATER)
    made = {}
    monkeypatch.setattr(lake, "overwrite", lambda table, df, *_: made.setdefault(table, df))
    one = lake.read("sessions").select("source", "bucket").distinct().orderBy("bucket").limit(1)
    lake.refresh(one)
    (bucket,) = [r.bucket for r in one.collect()]
    assert set(made) == {"session_sums", "usage_sums"}
    for df in made.values():
        filters = re.findall(r"PartitionFilters: \[(.*?)\],", df._jdf.queryExecution().executedPlan().toString())
        assert filters and all(re.search(rf"bucket#\d+ = {bucket}\)", f) for f in filters)


def test_findings_from_a_snapshot_and_the_runs_since(spark, tmp_path):
    r, lake, log = random.Random(2), Lake(spark, str(tmp_path / "lake")), []
    assert lake.findings() is None

    def run(at):
        found = [(at, k, f"f{r.randrange(4)}{k}", 1, float(r.randrange(9)), f"said at {at}") for k in ("a", "b")]
        log[:] = [x for x in log if x[0] != at] + found
        lake.log_findings(spark.createDataFrame(found, "run_ns long, kind string, fingerprint string, severity int, metric double, title string"))

    def check():
        want = review.merged(spark.createDataFrame(log, "run_ns long, kind string, fingerprint string, severity int, metric double, title string"))
        assert rows(lake.findings().select(want.columns)) == rows(want)

    for at in (10, 20, 30):
        run(at)
    check()
    lake.compact_findings()
    assert lake.snapshots() == [30]
    check()
    run(40)
    run(40)  # the same run again takes its own place
    check()
    assert re.search(r"PartitionFilters: \[isnotnull\(run#\d+L?\), \(.*run#\d+L?.* > 30\)\]", lake.findings()._jdf.queryExecution().executedPlan().toString())
    lake.compact_findings()
    assert lake.snapshots() == [40]
    run(35)  # a late run: the snapshot no longer holds
    assert lake.snapshots() == []
    check()
    lake.compact_findings(delete_runs=True)
    assert lake.read("finding_runs") is None
    check()
    run(50)
    check()


def test_functions_of_sql_give_what_the_columns_give(spark):
    names = ["mcp__linear__save", "mcp__", "Bash", "Read", "Edit", "exec_command", "other", None]
    calls = spark.createDataFrame([(s, n, a, k) for s in ("claude-code", "codex", "harness", "else") for n in names for k, a in enumerate(['{"command": "cat x"}', '{"file_path": "/a/b.py"}', None])], "source string, name string, args_preview string, result_chars long")
    texts = spark.createDataFrame([("/home/me/Code/a/b", "2026-01-02T03:04:05Z", 10**18, "import os import re Counter(x)", "/x/y.py", 1.0, 3.0), (None, "no", None, None, None, 0.0, None)], "cwd string, iso string, ns long, text string, path string, previous double, now double")
    assert len(sql.register(spark)) == len(sql.register(spark)) == len(sql.functions())
    for name, (parameters, expression) in sql.functions().items():
        df = calls if set(parameters) <= set(calls.columns) else texts.withColumn("value", F.col("text"))
        got = df.select(F.expr(f"{name}({', '.join(parameters)})").alias("x"))
        assert rows(got) == rows(df.select(expression.alias("x"))), name
