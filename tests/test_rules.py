"""Column functions, thresholds and reports on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from sessionlake.functions import columns as c
from sessionlake.functions.intervals import with_latest
from sessionlake.functions.periods import duration_ns, since_ns
from sessionlake.operators import cost, experiments, hooks, insights, maintain, navtime, review, search, sessions

S = 10**9


def test_durations():
    assert [duration_ns(x) for x in ("30d", "2w", "12h")] == [30 * 86_400 * S, 14 * 86_400 * S, 12 * 3600 * S]
    with pytest.raises(ValueError):
        duration_ns("30 days")
    assert since_ns("1970-01-02", 0) == 86_400 * S and since_ns("1h", 3600 * S) == 0 and since_ns(None, 5) is None


def test_projects(spark):
    cases = {"/Users/me/Code/lab/app": "lab/app", "/home/me": "~", "/home/me/x": "x", "/srv/a/b/c": "b/c", "/home/me/lab/app/.claude/worktrees/y": "lab/app", "": None}
    df = spark.createDataFrame([(k,) for k in cases], "cwd string")
    assert {r.cwd: r.p for r in df.select("cwd", c.project_of(F.col("cwd")).alias("p")).collect()} == cases


def test_classes_and_kinds(spark):
    rows = [("Bash", "cargo test", "claude-code", "bash-other"), ("Bash", '{"command": "cat x"}', "claude-code", "navigation"), ("exec_command", '{"cmd":"rg -n x"}', "codex", "navigation"), ("apply_patch", "", "codex", "editing"), ("Task", None, "claude-code", "subagent"), ("Read", None, "harness", "other"), ("any", "ls -l", "unheard of", "navigation")]
    df = spark.createDataFrame(rows, "name string, args_preview string, source string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", c.tool_class()).collect())
    kinds = spark.createDataFrame([("mcp__linear__save",), ("mcpXX",), (None,)], "name string").select(c.tool_kind(), c.tool_vendor()).collect()
    assert [tuple(r) for r in kinds] == [("mcp", "linear"), ("other", None), ("other", None)]


def test_prices(spark):
    book = cost.price_book({"gamma": [7, 31], "gamma-5": {"input": 1.0, "output": 2.0}})
    with pytest.raises(ValueError):
        cost.price_book({"x": {"input": 1.0}})
    turns = spark.createDataFrame([("s", "gamma-1", 40_000, 9_000, 3_000_000, 200_000, 0), ("s", "gamma-5.6", 10**6, 0, 0, 0, 0), ("s", "none", 0, 0, 0, 0, 0), ("s", "none2", 1, 0, 0, 0, 0)], "session_id string, model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, started_at_ns long")
    one = spark.createDataFrame([("s", "p", 0, "codex")], "session_id string, project string, started_at_ns long, source string")
    got = {r.key: r for r in cost.cost(turns, one, cost.prices_frame(spark, book)).collect()}
    g = got["gamma-1"]
    # cache reads cost a tenth of the input price, cache writes five quarters
    want = [40_000 * 7e-6, 3_000_000 * 0.7e-6, 200_000 * 8.75e-6, 9_000 * 31e-6]
    assert [g.input_usd, g.cache_read_usd, g.cache_write_usd, g.output_usd] == pytest.approx(want) and g.usd == pytest.approx(sum(want))
    assert got["gamma-5.6"].usd == 1.0 and (got["none"].unpriced, got["none2"].unpriced) == (0, 1)
    with pytest.raises(ValueError):
        cost.cost(turns, one, cost.prices_frame(spark, book), as_model="zeta")


def random_sessions(seed, sessions=25, longest=60):
    """Turn starts and calls (start, tool name, arguments) of each session, in whole seconds with ties and long pauses."""
    rng = random.Random(seed)
    out = {}
    for k in range(sessions):
        at, turns = rng.randrange(1000), []
        for _ in range(rng.randrange(1, longest)):
            at += rng.choice([0, 3, 17, 60, 299, 300, 301, 4000])
            turns.append(at)
        calls = [(rng.randrange(turns[0] - 50, turns[-1] + 50), rng.choice(["Read", "Edit", "Bash", "Grep", "Task"]), rng.choice(["", "ls -l", "make all"])) for _ in range(rng.randrange(longest))]
        out[f"session {k}"] = (turns, calls)
    return out


def frames(spark, data):
    one = spark.createDataFrame([(k, "claude-code", "p", 0) for k in data], "session_id string, source string, project string, is_subagent int")
    t = spark.createDataFrame([(k, f"t{i}", x * S) for k, (turns, _) in data.items() for i, x in enumerate(turns)], "session_id string, span_id string, started_at_ns long")
    c = spark.createDataFrame([(k, f"c{i}", x * S, n, a) for k, (_, calls) in data.items() for i, (x, n, a) in enumerate(calls)], "session_id string, span_id string, started_at_ns long, name string, args_preview string")
    return one, t, c


def test_nav_shares_against_loops(spark):
    data = random_sessions(11)
    classes = {(r.name, r.args_preview): r.k for r in spark.createDataFrame([(n, a, "claude-code") for n in ("Read", "Edit", "Bash", "Grep", "Task") for a in ("", "ls -l", "make all")], "name string, args_preview string, source string").withColumn("k", c.tool_class()).collect()}
    got = {r.session_id: r for r in navtime.nav_shares(*frames(spark, data)).collect()}
    for k, (turns, calls) in data.items():
        active = nav = alone = n = 0.0
        starts = sorted(set(turns))
        for b, e in zip(starts, starts[1:]):
            if e - b > 300:
                continue
            mine = [classes[name, args] for x, name, args in calls if b <= x < e]
            active += e - b
            alone += 0 if mine else e - b
            nav += (e - b) * mine.count("navigation") / len(mine) if mine else 0
            n += mine.count("navigation")
        if not active:
            assert k not in got
            continue
        r = got[k]
        assert (r.active_s, r.nav_calls, r.generation_s) == (active, n, alone) and r.nav_s == pytest.approx(nav, abs=0.051) and r.nav_share == pytest.approx(nav / active, abs=1e-4)


def test_one_long_session_is_sorted_not_multiplied(spark):
    """100,000 turns and as many calls of one session: no operator makes more rows than it reads."""
    n = 100_000
    one = spark.createDataFrame([("s", "claude-code", "p", 0)], "session_id string, source string, project string, is_subagent int")
    t = spark.range(n).select(F.lit("s").alias("session_id"), F.concat(F.lit("t"), "id").alias("span_id"), (F.col("id") * 2 * S).alias("started_at_ns"))
    k = spark.range(n).select(F.lit("s").alias("session_id"), F.concat(F.lit("c"), "id").alias("span_id"), ((F.col("id") * 2 + 1) * S).alias("started_at_ns"), F.lit("Read").alias("name"), F.lit("").alias("args_preview"))
    r = navtime.nav_shares(one, t, k).first()
    assert (r.active_s, r.nav_s, r.nav_calls) == (2.0 * (n - 1), 2.0 * (n - 1), n - 1)
    said = spark.range(0, n, 1000).select(F.lit("s").alias("session_id"), F.lit("user_message").alias("kind"), F.lit("do it").alias("text"), (F.col("id") * 2 * S).alias("ts_ns"), F.col("id").alias("seq"))
    spent = t.withColumns({x: F.lit(1) for x in sessions.TOKENS}).withColumn("ended_at_ns", F.col("started_at_ns") + S)
    rows = sessions.prompts(said, spent, k).collect()
    assert len(rows) == n // 1000 and {(r.turns, r.tool_calls, r.duration_ms) for r in rows} == {(1000, 1000, 1_999_000)}


def test_nav_shares_sorts_once(spark):
    """What a task holds is one sort of short rows: no join, no second sort. Odd rows change nothing."""
    one, t, k = frames(spark, random_sessions(14))
    got = navtime.nav_shares(one, t, k)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Join" not in plan
    odd = navtime.nav_shares(
        one.union(spark.createDataFrame([("alone", "codex", "p", 0), ("under", "codex", "p", 1), (None, "codex", "p", 0)], one.schema)),
        t.union(t).union(spark.createDataFrame([("session 1", "x", None), ("under", "x", 0), ("under", "y", S), (None, "x", 0), (None, "y", S), ("lost", "x", 0), ("lost", "y", S)], t.schema)),
        k.union(spark.createDataFrame([("session 1", "x", None, "Read", ""), ("under", "x", 0, "Read", ""), (None, "x", 0, "Read", ""), ("lost", "x", 0, "Read", "")], k.schema)),
    )
    assert sorted(odd.collect()) == sorted(got.collect())


def test_navigation_bits_are_those_of_the_class(spark):
    names = sorted({n for of in c.CLASSES.values() for group in of.values() for n in group} | {"mcp__x__y"})
    rows = [(s, n, a) for s in (*c.CLASSES, "other", None) for n in (*names, None) for a in ("", "ls -l", "make all", None)]
    df = spark.createDataFrame(rows, "source string, name string, args_preview string").withColumns({"bits": c.navigation_bits(), "bit": c.source_bit()})
    assert df.where((F.getbit("bits", F.col("bit")) == 1) != (c.tool_class() == "navigation")).count() == 0


def test_latest_mark_against_loops(spark):
    rng = random.Random(5)
    marks = {(k, x): f"{k}{x}" for k in "abc" for x in rng.sample(range(100), 12)}
    rows = [(rng.choice("abcd"), rng.randrange(110), i) for i in range(300)]
    m = spark.createDataFrame([(k, x, v) for (k, x), v in marks.items()], "key string, since long, v string")
    got = with_latest(spark.createDataFrame(rows, "key string, at long, i long"), "at", m, "since", "key", "mark").collect()
    assert len(got) == 300
    for r in got:
        before = [x for k, x in marks if k == r.key and x <= r.at]
        assert (r.mark.v if r.mark else None) == (marks[r.key, max(before)] if before else None)


def test_active_time_against_loops(spark):
    """Sessions without durations count the pauses up to the limit; others count their durations."""
    data = random_sessions(12)
    spent = {k: (i % 3 == 0) * 1000 * (i + 1) for i, k in enumerate(data)}
    t = spark.createDataFrame([(k, f"t{i:03}", x * S, spent[k]) for k, (turns, _) in data.items() for i, x in enumerate(turns)], "session_id string, span_id string, started_at_ns long, duration_ms long")
    for limit in (17_000, 300_000):
        got = {r.session_id: r.active_ms for r in sessions.active_time(t, limit).collect()}
        gaps = {k: sum(1000 * (b - a) for a, b in zip(turns, turns[1:]) if 1000 * (b - a) <= limit) for k, (turns, _) in data.items()}
        assert got == {k: spent[k] * len(data[k][0]) if spent[k] else gaps[k] for k in data}


def test_read_used_against_loops(spark):
    rng = random.Random(13)
    files = [f"/srv/{d}/{n}.{e}" for d in ("core", "web", "_docnav") for n in ("parse", "index", "x1") for e in ("rs", "ts")]
    calls = [(f"s{rng.randrange(12)}", rng.choice(["Read", "Read", "Edit", "Write"]), rng.choice(files)) for _ in range(120)]
    said = [(f"s{rng.randrange(12)}", rng.choice(["assistant_message", "user_message"]), f"so {rng.choice(files).split('/')[-1]} and that") for _ in range(30)]
    got = {r.session_id: (r.reads, r.used) for r in experiments.read_used(spark.createDataFrame([(s, n, f'{{"file_path": "{f}"}}') for s, n, f in calls], "session_id string, name string, args_preview string"), spark.createDataFrame(said, "session_id string, kind string, text string")).collect()}
    want = {}
    for s in {s for s, n, f in calls if n == "Read" and "_docnav" not in f}:
        read = {f for s2, n, f in calls if s2 == s and n == "Read" and "_docnav" not in f}
        used = {f for f in read if any(s2 == s and n != "Read" and g == f for s2, n, g in calls) or any(s2 == s and k == "assistant_message" and f.split("/")[-1] in t for s2, k, t in said)}
        want[s] = (len(read), len(used))
    assert got == want and any(0 < u < r for r, u in want.values())


def test_read_used_looks_for_unedited_files(spark, monkeypatch):
    """Only files that were read and not edited are looked for in messages, each once; a base name in two folders counts for both."""
    asked = []
    search = experiments.held_names
    monkeypatch.setattr(experiments, "held_names", lambda names, texts: asked.extend(tuple(x) for x in names.collect()) or search(names, texts))
    calls = [("s", "Read", "/a/one.rs"), ("s", "Read", "/b/one.rs"), ("s", "Read", "/a/two.rs"), ("s", "Edit", "/a/two.rs"), ("s", "Write", "/a/three.rs"), ("s", "Read", "/a/two.rs"), ("s", "Read", "/c/")]
    df = spark.createDataFrame([(s, n, f'{{"file_path": "{f}"}}') for s, n, f in calls], "session_id string, name string, args_preview string")
    said = spark.createDataFrame([("s", "assistant_message", "one.rs is fine, three.rs too")], "session_id string, kind string, text string")
    r = experiments.read_used(df, said).collect()
    assert [(x.session_id, x.reads, x.used, x.share) for x in r] == [("s", 4, 3, 0.75)]
    assert sorted(asked) == [("s", ""), ("s", "one.rs"), ("s", "one.rs")]



def test_hooks(spark):
    mark = "PreToolUse:Read hook error: [python3 /h/reread-guard.py]: you already read /r/a.py this session"
    rows = spark.createDataFrame([("s", "x", "Read", 5, mark), ("s", "y", "Bash", 6, "quoted " + mark), ("u", "z", "Read", 5, mark)], "session_id string, span_id string, tool_name string, ts_ns long, text string")
    calls = spark.createDataFrame([("s", "Read", 0, 9, '{"file_path": "/r/a.py"}'), ("u", "Read", 0, 4, '{"file_path": "/r/a.py"}')], "session_id string, name string, is_error int, started_at_ns long, args_preview string")
    assert {r.span_id: (r.outcome, r.hook) for r in hooks.hook_events(rows, calls).collect()} == {"x": ("bypassed", "reread-guard.py"), "z": ("heeded", "reread-guard.py")}


def test_new_and_grown_against_loops(spark):
    rng = random.Random(14)
    make = lambda: {(rng.choice("pqr"), f"print {rng.randrange(40)}"): (rng.randrange(1, 5), float(rng.randrange(0, 50))) for _ in range(70)}
    now, old = make(), make()
    frame = lambda d: spark.createDataFrame([(*k, *v) for k, v in d.items()], "kind string, fingerprint string, severity int, metric double")
    want = {}
    for k, (severity, metric) in now.items():
        was = old[k][1] if k in old else None
        if severity <= 2 and was is None:
            want[k] = "new"
        elif severity <= 2 and was and (metric - was) / was >= 0.5:
            want[k] = "grown"
    got = {(r.kind, r.fingerprint): r.status for r in review.new_and_grown(frame(now), frame(old), least_growth=0.5).collect() if r.previous_metric != 0}
    assert got == want and set(want.values()) == {"new", "grown"}


def test_experiments(spark):
    none = spark.createDataFrame([], experiments.EXPERIMENT)
    e = experiments.created(experiments.created(none, "wide", 10), "narrow", 20, 30, scope="p", source="y")
    with pytest.raises(ValueError):
        experiments.created(e, "wide", 5)
    with pytest.raises(ValueError):
        experiments.created(e, "back", 5, 4)
    with pytest.raises(ValueError):
        experiments.stopped(e, "nothing", 5)
    rows = [(f"{src}{proj}{at}", src, proj, at, 0) for src in "xy" for proj in "pq" for at in (9, 10, 25, 31)]
    one = spark.createDataFrame(rows, "session_id string, source string, project string, started_at_ns long, is_subagent int")
    got = {r.session_id: r.tags for r in experiments.tagged(one, e).collect()}
    assert got == {s: sorted((["wide"] if at >= 10 else []) + (["narrow"] if (src, proj, at) == ("y", "p", 25) else [])) for s, src, proj, at, _ in rows}
    ended = experiments.stopped(experiments.stopped(e, "wide", 25), "wide", 99)
    assert experiments.got(ended, "wide").first().end_ns == 25
    assert {r.session_id for r in experiments.members(experiments.tagged(one, ended), "wide").collect()} == {s for s, _, _, at, _ in rows if 10 <= at <= 25}
    before = experiments.baseline(experiments.tagged(one, e), "narrow", 20, "p", source="y")
    assert {r.session_id for r in before.collect()} == {"yp9", "yp10"}


def test_times_do_not_follow_the_session_zone(spark):
    rows = spark.createDataFrame([("2024-03-01T23:30:00Z",), ("2024-03-01T23:30:00",), ("2024-03-01 23:30:00.5",), ("2024-03-01T23:30:00+02:00",), ("2024-03-01",), ("no time",), (None,)], "t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    found = []
    for z in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", z)
        found.append([(r.n, str(r.d)) for r in rows.select(c.ns_of(F.col("t")).alias("n")).select("n", c.day_of("n").alias("d")).collect()])
    spark.conf.set("spark.sql.session.timeZone", zone)
    at = 1709335800 * S
    assert found[0] == found[1] == [(at, "2024-03-01"), (at, "2024-03-01"), (at + S // 2, "2024-03-01"), (at - 7200 * S, "2024-03-01"), (1709251200 * S, "2024-03-01"), (None, "None"), (None, "None")]


def test_search_syntax(spark):
    df = spark.createDataFrame([(1, "The quick-brown fox"), (2, "brown the bear"), (3, "Foxes run")], "id int, text string")
    hit = lambda q: sorted(r.id for r in df.where(search.predicate(F.col("text"), q)).collect())
    assert [hit(q) for q in ("brown", '"quick brown"', "fox*", "brown NOT bear", "bear OR run", "the fox")] == [[1, 2], [1], [1, 3], [1], [2, 3], [1]]
    assert df.where("id = 1").select(search.snippet(F.col("text"), "fox")).first()[0] == "The quick-brown [fox]"


def test_decisions(spark):
    inv = spark.createDataFrame([("new", "f", 60.0), ("active", "f", 1.0), ("same", "f", 60.0), ("changed", "g", 60.0), ("failed", "f", 60.0), ("tired", "f", 60.0), ("empty", "f", 60.0)], "path string, fingerprint string, age_s double")
    state = spark.createDataFrame([("same", "f", "ingested", 1), ("changed", "f", "failed", 3), ("failed", "f", "failed", 1), ("tired", "f", "failed", 3), ("empty", "f", "empty", 1), ("gone", "f", "ingested", 1)], "path string, fingerprint string, status string, attempts long")
    got = {r.path: (r.action, r.attempts) for r in maintain.decide(inv, state, max_attempts=3).collect()}
    assert got == {"new": ("ingest", 1), "active": ("active", 0), "same": ("unchanged", 1), "changed": ("ingest", 1), "failed": ("ingest", 2), "tired": ("unchanged", 3), "empty": ("unchanged", 1), "gone": ("vanished", 1)}
    assert {r.path: r.action for r in maintain.decide(inv, state).collect()}["tired"] == "ingest"


def test_repeat_waste_counts_every_group(spark):
    """More groups than any list of the most frequent holds; the frequent ones have results that differ, or lack one."""
    rng = random.Random(7)
    calls, contents, want = [], [], {}
    for g in range(700):
        name, n = rng.choice(["Read", "Bash", "Task"]), rng.randrange(1, 6)
        kind = "same" if n < 3 else rng.choice(["same", "differ", "lack"])
        for k in range(n):
            span, ms = f"{g}-{k}", rng.randrange(1000)
            calls.append((f"s{g % 90}", name, f"h{g}", span, ms, "{}"))
            if kind != "lack" or k:
                contents.append((span, "tool_result", f"v{g}-{k if kind == 'differ' else 0}"))
            contents.append((span, "tool_arguments", f"a{k}"))
        if kind == "same" and n > 1:
            total = sum(c[4] for c in calls[-n:])
            wasted, spent, groups = want.get(name, (0, 0.0, 0))
            want[name] = (wasted + n - 1, spent + total * (n - 1) / n, groups + 1)
    assert sum(w[2] for w in want.values()) > 200
    c = spark.createDataFrame(calls, "session_id string, name string, args_hash string, span_id string, duration_ms long, args_preview string")
    x = spark.createDataFrame(contents, "span_id string, kind string, text string")
    got = {r.name: (r.wasted, r.ms, r.groups) for r in insights.repeat_waste(c, x).collect()}
    assert got == {k: (w, pytest.approx(ms, abs=0.01), n) for k, (w, ms, n) in want.items()}


def test_insights_and_review_run(spark, tmp_path):
    from sessionlake.plans import queries as q

    d = "/root/testdata/sf0.001"
    s = q.with_model(spark, d).withColumn("cwd", F.col("project"))
    parts = [q.view(spark, d, v) for v in ("fx_turns", "fx_tools", "fx_contents")]
    found = insights.insights(s, *parts, q.prices(spark), q.view(spark, d, "fx_markers"), limits=q.LIMITS)
    rows = found.collect()
    assert rows == sorted(rows, key=lambda r: (r.severity, -r.metric, r.kind, r.fingerprint)) and {"context_flood", "marathon_session"} <= {r.kind for r in rows}
    from sessionlake.sources.lake import Lake

    lake = Lake(spark, str(tmp_path))
    kept = insights.insights(s, *parts, q.prices(spark), q.view(spark, d, "fx_markers"), limits=q.LIMITS, keep=lake.pinned)
    assert kept.collect() == rows and len(lake.work) == 4
    known = kept.where("kind = 'context_flood'")
    got = review.review(s, *parts, q.prices(spark), known, q.windows(spark), q.view(spark, d, "fx_hooks"), q.NOW, limits=q.LIMITS, markers=q.view(spark, d, "fx_markers"), keep=lake.pinned)
    assert "context_flood" not in {r.kind for r in got["changes"].collect()} and got["experiments"].count() >= 2 and got["counts"].first().detected == len(rows)


def test_rebuild_plan(spark):
    s = spark.createDataFrame([("a", "x", "/a", None), ("b", "x", "/b", 3), ("c", "x", "/c", 1), ("d", "x", "/d", 4)], "session_id string, source string, file_path string, pipeline_version int")
    files = spark.createDataFrame([("/a",)], "path string")
    raw = spark.createDataFrame([("x", "b", "h", 1)], "source string, session_id string, sha256 string, captured_at_ns long")
    plan = maintain.rebuild_plan(s, files, raw, 4)
    assert {r.session_id: r.origin for r in plan.collect()} == {"a": "from_original", "b": "from_archive", "c": "missing_raw"}
    report = maintain.rebuild_report(plan, s.where("session_id = 'a'"))
    assert {r.outcome for r in report.collect()} == {"rebuilt", "yielded_nothing", "missing_raw"}
