"""Adapters, sink and ingest on small transcripts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sessionlake.sources import assemble
from sessionlake.sources.lake import Lake
from sessionlake.sources.scan import MAX_LINE, events, inventory, lines, probe
from sessionlake.streaming.ingest import one_pass, stream


def at(s, ms=0):
    return f"2026-01-01T00:{s // 60:02d}:{s % 60:02d}.{ms:03d}Z"


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def usage(i, o, read=0, new=0):
    return {"input_tokens": i, "output_tokens": o, "cache_read_input_tokens": read, "cache_creation_input_tokens": new}


CLI = [
    {"type": "user", "uuid": "u1", "timestamp": at(0), "cwd": "/home/me/Code/lab/app", "version": "2", "message": {"role": "user", "content": "  please look "}},
    {"type": "assistant", "uuid": "a1", "timestamp": at(5), "message": {"model": "alpha-large-1", "usage": usage(100, 30, 400, 10), "content": [{"type": "thinking", "thinking": "hmm"}, {"type": "text", "text": "reading"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"b": 1, "a": "x"}}]}},
    "not json",
    "[1, 2]",
    {"type": "system", "subtype": "turn_duration", "durationMs": 2000, "timestamp": at(6)},
    {"type": "user", "uuid": "u2", "timestamp": at(7), "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "abc"}, {"type": "text", "text": "de"}]}, {"type": "tool_result", "tool_use_id": "orphan", "content": "x"}]}},
    {"type": "assistant", "uuid": "a2", "timestamp": at(9), "message": {"model": "alpha-mid", "usage": usage(20, 5), "content": [{"type": "text", "text": "old"}]}},
    {"type": "assistant", "uuid": "a2", "timestamp": at(10), "message": {"model": "alpha-mid", "usage": usage(21, 6), "content": [{"type": "text", "text": "new"}]}},
]


def tables(spark, source, tmp_path, rows, name="s1"):
    write(tmp_path / f"{name}.jsonl", rows)
    return {k: [r.asDict() for r in v.orderBy(*(["session_id"] if k == "sessions" else ["session_id", "seq"] if k == "contents" else ["session_id", "started_at_ns"])).collect()] for k, v in assemble.tables(source, events(lines(spark, [str(tmp_path)])), now_ns=1).items()}


def test_cli_agent(spark, tmp_path):
    got = tables(spark, "claude-code", tmp_path, CLI)
    (s,) = got["sessions"]
    assert (s["turn_count"], s["tool_call_count"], s["input_tokens"], s["output_tokens"], s["cache_read_tokens"], s["cache_creation_tokens"]) == (2, 1, 121, 36, 400, 10)
    assert (s["active_ms"], s["thinking_blocks"], s["thinking_chars"], s["first_user_message"], s["project"], s["model"], s["wall_ms"]) == (2000, 1, 3, "please look", "lab/app", "alpha-large-1", 10_000)
    a, b = got["turns"]
    assert (a["duration_ms"], a["ended_at_ns"] - a["started_at_ns"], a["turn_index"], b["output_tokens"], b["turn_index"]) == (2000, 2 * 10**9, 0, 6, 1)
    (c,) = got["tool_calls"]
    assert (c["name"], c["duration_ms"], c["result_chars"], c["is_error"], c["args_preview"], c["turn_span_id"]) == ("Read", 2000, 6, 0, '{"a":"x","b":1}', a["span_id"])
    assert [(x["kind"], x["text"]) for x in got["contents"]] == [("user_message", "please look"), ("thinking", "hmm"), ("assistant_message", "reading"), ("tool_arguments", '{"a":"x","b":1}'), ("tool_result", "abc\nde"), ("tool_result", "x"), ("assistant_message", "new")]


def test_cli_reused_tool_id(spark, tmp_path):
    use = lambda s, n: {"type": "assistant", "uuid": f"a{s}", "timestamp": at(s), "message": {"content": [{"type": "tool_use", "id": "t", "name": n, "input": {}}]}}
    res = lambda s: {"type": "user", "timestamp": at(s), "message": {"content": [{"type": "tool_result", "tool_use_id": "t", "content": "r", "is_error": True}]}}
    got = tables(spark, "claude-code", tmp_path, [use(1, "A"), use(2, "B"), res(5), res(6)])
    assert [(c["name"], c["duration_ms"], c["is_error"]) for c in got["tool_calls"]] == [("B", 3000, 1)]


def event(s, kind, **payload):
    return {"timestamp": at(s), "type": "event_msg", "payload": {"type": kind, **payload}}


def test_rollout(spark, tmp_path):
    """A generated session, and what a loop over it makes of it."""
    r = random.Random(14)
    rows = [{"timestamp": at(0), "type": "session_meta", "payload": {"id": "gen", "cwd": "/home/me/lab", "cli_version": "9", "source": {"subagent": {"thread_spawn": {"parent_thread_id": "above"}}}}}]
    model, from_s, turns, calls, texts, waiting = None, 0, [], {}, [], []
    for s in range(1, 300):
        step = r.choice(["model", "count", "count", "none", "call", "call", "end", "output", "output", "say"]) if s > 1 else "model"
        if step == "model":
            model = r.choice(["one", "two", "three"])
            rows.append({"timestamp": at(s), "type": "turn_context", "payload": {"model": model}})
        elif step in ("count", "none"):
            fresh, kept, made = r.randrange(3), r.randrange(50), r.randrange(2)
            info = {"last_token_usage": {"input_tokens": fresh + kept, "cached_input_tokens": kept, "output_tokens": made, "reasoning_output_tokens": made}}
            rows.append(event(s, "token_count", info=info if step == "count" else None))
            if step == "count" and (fresh + kept or made):
                turns.append((from_s, s, model, fresh, kept, made))
            from_s = s
        elif step == "call":
            c, patch, text = f"c{s}", r.random() < 0.3, "arg" * r.randrange(1, 4)
            rows.append({"timestamp": at(s), "type": "response_item", "payload": {"type": "custom_tool_call", "call_id": c, "name": "apply_patch", "input": text} if patch else {"type": "function_call", "call_id": c, "name": "exec", "arguments": text}})
            calls[c] = {"at": s, "patch": patch, "ran": 0, "bad": 0, "chars": 0, "end": None}
            texts.append(text)
            waiting.append(c)
        elif step == "end" and waiting:
            c = r.choice(waiting)
            if calls[c]["end"] is None:
                ok, ms, out = r.random() < 0.6, r.randrange(1, 5000), "x" * r.randrange(9)
                if calls[c]["patch"]:
                    rows.append(event(s, "patch_apply_end", call_id=c, stdout=out, stderr="", success=ok))
                else:
                    rows.append(event(s, "exec_command_end", call_id=c, aggregated_output=out, exit_code=0 if ok else 3, duration={"secs": ms // 1000, "nanos": ms % 1000 * 10**6}))
                    calls[c]["ran"] = ms
                calls[c].update(end=s, bad=int(not ok), chars=len(out))
        elif step == "output" and waiting:
            c, out = waiting.pop(r.randrange(len(waiting))), "y" * r.randrange(1, 9)
            rows.append({"timestamp": at(s), "type": "response_item", "payload": {"type": "custom_tool_call_output" if calls[c]["patch"] else "function_call_output", "call_id": c, "output": out}})
            calls[c].update(end=s, chars=max(calls[c]["chars"], len(out)))
            texts.append(out)
        elif step == "say":
            phase = r.choice(["commentary", "final", None])
            rows.append(event(s, "agent_message", message=f"said {s}", **({"phase": phase} if phase else {})))
            texts += [f"said {s}"] if phase != "commentary" else []
    got = tables(spark, "codex", tmp_path, rows, "rollout-x")
    (one,) = got["sessions"]
    assert (one["session_id"], one["surface"], one["is_subagent"], one["parent_session_id"], one["model"], one["project"]) == ("gen", "subagent", 1, "above", turns[0][2], "lab")
    assert one["reasoning_tokens"] == sum(t[5] for t in turns)
    assert [(t["duration_ms"], t["model"], t["input_tokens"], t["cache_read_tokens"], t["output_tokens"]) for t in got["turns"]] == [((b - a) * 1000, m, *rest) for a, b, m, *rest in turns]
    assert [x["text"] for x in got["contents"]] == texts
    spans = [t["span_id"] for t in got["turns"]]
    want = []
    for c in sorted(calls.values(), key=lambda c: c["at"]):
        if c["end"] is not None:
            holds = [k for k, t in enumerate(turns) if t[0] <= c["at"] <= t[1]] + [k for k, t in enumerate(turns) if t[1] >= c["at"]] + [len(turns) - 1]
            want.append((c["ran"] or (c["end"] - c["at"]) * 1000, c["bad"], c["chars"], spans[holds[0]]))
    assert len(want) > 20
    assert [(c["duration_ms"], c["is_error"], c["result_chars"], c["turn_span_id"]) for c in got["tool_calls"]] == want


def test_harness(spark, tmp_path):
    rows = [
        {"type": "session_meta", "ts": at(0), "session_id": "h1", "model": "m", "cwd": "/home/x"},
        {"type": "user", "ts": at(1), "text": "hi"},
        {"type": "assistant", "ts": at(4), "duration_ms": 1000, "content": [{"type": "text", "text": "run"}, {"type": "tool_use", "id": "t", "name": "bash", "input": {"command": "ls"}}, {"type": "tool_use", "id": "lost", "name": "bash", "input": {}}]},
        {"type": "tool_result", "ts": at(5), "tool_use_id": "t", "duration_ms": 300, "is_error": True, "output": "bad"},
        {"type": "cli_session", "ts": at(5), "cli_session_id": "cli-9"},
        {"type": "end", "ts": at(6), "usage": usage(10, 2)},
    ]
    got = tables(spark, "harness", tmp_path, rows)
    (s,) = got["sessions"]
    assert (s["session_id"], s["project"], s["input_tokens"], s["output_tokens"], s["tool_call_count"], s["cli_session_id"]) == ("h1", "~", 10, 2, 2, "cli-9")
    assert sorted((c["duration_ms"], c["result_chars"], c["is_error"]) for c in got["tool_calls"]) == [(0, 0, 0), (300, 3, 1)]


def test_empty_and_probe(spark, tmp_path):
    write(tmp_path / "a" / "p7" / "subagents" / "agent-1.jsonl", [{"type": "user", "cwd": "/x", "isSidechain": True}])
    evs = events(lines(spark, [str(tmp_path)]))
    assert assemble.tables("claude-code", evs)["sessions"].count() == 0
    (p,) = probe(evs, "claude-code").collect()
    assert (p.parent_session_id, p.cwd, p.is_sidechain, p.session_id) == ("p7", "/x", 1, "agent-1")
    assert inventory(spark, [str(tmp_path)]).count() == 1 and MAX_LINE == 64 << 20


def snapshot(lake):
    return {t: sorted(str(r.asDict()) for r in lake.read(t).drop("ingested_at_ns").collect()) for t in ("sessions", "turns", "tool_calls", "contents")}


def test_lake_twice_is_once_and_rewrites_replace(spark, tmp_path):
    src, lake = tmp_path / "in", Lake(spark, str(tmp_path / "lake"), buckets=2)
    write(src / "s1.jsonl", CLI)
    write(src / "s2.jsonl", CLI[:2])
    later = 4_000_000_000 * 10**9
    first = {r.path.rsplit("/", 1)[1]: (r.action, r.outcome) for r in one_pass(spark, lake, "claude-code", [str(src)], now_ns=later).collect()}
    assert first == {"s1.jsonl": ("ingest", "ingested"), "s2.jsonl": ("ingest", "ingested")}
    before = snapshot(lake)
    assert {r.action for r in one_pass(spark, lake, "claude-code", [str(src)], now_ns=later + 1).collect()} == {"unchanged"}
    lake.replace(assemble.tables("claude-code", events(lines(spark, [str(src)]))))
    assert snapshot(lake) == before
    write(src / "s2.jsonl", CLI[:1])
    again = {r.path.rsplit("/", 1)[1]: r.action for r in one_pass(spark, lake, "claude-code", [str(src)], now_ns=later + 2).collect()}
    assert again == {"s1.jsonl": "unchanged", "s2.jsonl": "ingest"}
    assert {(r.session_id, r.turn_count) for r in lake.read("sessions").collect()} == {("s1", 2), ("s2", 0)}
    assert {r.session_id for r in lake.read("turns").collect()} == {"s1"}
    assert lake.read("raw_versions").count() == 3
    assert [r.value for r in lake.restore("claude-code", "s1").collect()] == [r if isinstance(r, str) else json.dumps(r) for r in CLI]
    other = assemble.tables("harness", events(lines(spark, [str(src)])))["sessions"]
    clash = lake.read("sessions").drop("bucket").withColumn("source", F.lit("other"))
    assert other.count() == 0 and lake.collisions(clash).count() == 2
    lake.delete_sessions(lake.read("sessions").where("session_id = 's1'").select("session_id", "source"))
    assert lake.read("sessions").count() == 1 and lake.sql("select count(*) as n from sessions").first().n == 1
    for text in ("drop table sessions", "with x as (select 1 as a) insert into t select * from x", "insert into t values (1)", "create table t as select 1"):
        with pytest.raises(ValueError):
            lake.sql(text)
    assert lake.reads_only("with x as (select 1 as a) select * from x") and lake.reads_only("explain select 1") and lake.reads_only("show tables")


def test_collided_session_fails_and_is_tried_again(spark, tmp_path):
    src, lake = tmp_path / "in", Lake(spark, str(tmp_path / "lake"), buckets=2)
    write(src / "s1.jsonl", CLI)
    made = assemble.tables("claude-code", events(lines(spark, [str(src)])))
    lake.replace({t: df.withColumn("source", F.lit("other")) if "source" in df.columns else df for t, df in made.items()})
    write(src / "s2.jsonl", CLI[:2])
    later = 4_000_000_000 * 10**9
    for k in range(2):
        got = {r.path.rsplit("/", 1)[1]: (r.action, r.attempts, r.outcome) for r in one_pass(spark, lake, "claude-code", [str(src)], now_ns=later + k).collect()}
        assert got["s1.jsonl"] == ("ingest", k + 1, "failed")
        assert got["s2.jsonl"] == (("ingest", 1, "ingested") if k == 0 else ("unchanged", 1, None))
    assert {(r.session_id, r.source) for r in lake.read("sessions").collect()} == {("s1", "other"), ("s2", "claude-code")}


def test_stream(spark, tmp_path):
    src, lake = tmp_path / "in", Lake(spark, str(tmp_path / "lake"), buckets=2)
    write(src / "s1.jsonl", CLI)
    stream(spark, lake, "claude-code", str(src), str(tmp_path / "cp")).awaitTermination(120)
    assert lake.read("sessions").count() == 1
    write(src / "s2.jsonl", CLI[:2])
    stream(spark, lake, "claude-code", str(src), str(tmp_path / "cp")).awaitTermination(120)
    assert {r.session_id for r in lake.read("sessions").collect()} == {"s1", "s2"}


@pytest.mark.parametrize("source", ["claude-code", "codex", "harness"])
def test_lines_are_parsed_once(spark, tmp_path, source):
    write(tmp_path / "s1.jsonl", [" {} ", "{", "[{}]", '"{}"', '\t{"type": "x"}'])
    evs = events(lines(spark, [str(tmp_path)]))
    assert evs.count() == 2
    made = assemble.tables(source, evs)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in made.values()]
    assert not any("parse_json" in p or "parseJson" in p or "variant_get" in p for p in plans)
