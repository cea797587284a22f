"""Transcripts of the three formats, written from the given events, read back by the adapters and held against SQL over the same events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.plans.fixtures import view
from sessionlake.sources import assemble
from sessionlake.sources.scan import events


def iso(ns: Column) -> Column:
    """UTC text of a time, whatever the session's time zone."""
    since = F.make_dt_interval(secs=ns.cast("decimal(19,0)") / F.lit(10**9).cast("decimal(10,0)"))
    return F.concat(F.replace((F.lit("1970-01-01").cast("timestamp_ntz") + since).cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def text(pattern: str, **values: Column) -> Column:
    """The pattern with <name> replaced by values; null where one of them is."""
    out: list[Column] = []
    rest = pattern
    while "<" in rest:
        head, _, rest = rest.partition("<")
        name, _, rest = rest.partition(">")
        out += [F.lit(head), values[name].cast("string")]
    return F.concat(*out, F.lit(rest))


def parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns and calls with their time of order and number, and the first time of each session."""
    turns = view(spark, d, "fx_turns").withColumns({"at": F.col("ended_at_ns"), "event_id": F.substring("span_id", 2, 30).cast("long"), "order_ns": F.col("started_at_ns")})
    calls = view(spark, d, "fx_tools").withColumn("order_ns", F.col("started_at_ns"))
    both = turns.select("session_id", "order_ns").unionByName(calls.select("session_id", "order_ns"))
    return turns, calls, both.groupBy("session_id").agg(F.min("order_ns").alias("order_ns"))


def written(*kinds: tuple[DataFrame, int, Column, Column]) -> DataFrame:
    """Numbered lines of each session from (rows, place among an event's lines, event, line)."""
    rows = None
    for df, k, event, value in kinds:
        some = df.select("session_id", "order_ns", event.cast("long").alias("event"), F.lit(k).alias("k"), value.alias("value"))
        rows = some if rows is None else rows.unionByName(some)
    number = F.expr("row_number() over (partition by session_id order by order_ns, event, k) - 1")
    return rows.withColumn("line_no", number).select(F.concat("session_id", F.lit(".jsonl")).alias("file"), "session_id", "line_no", "value")


USAGE = '{"input_tokens":<i>,"output_tokens":<o>,"cache_read_input_tokens":<r>,"cache_creation_input_tokens":<n>}'


def usage() -> dict[str, Column]:
    return {"i": F.col("input_tokens"), "o": F.col("output_tokens"), "r": F.col("cache_read_tokens"), "n": F.col("cache_creation_tokens")}


def of_call() -> dict[str, Column]:
    return {"id": F.col("span_id"), "t": iso(F.col("started_at_ns")), "end": iso(F.col("ended_at_ns")), "name": F.col("name"), "args": F.col("args_preview"), "bad": (F.col("is_error") == 1), "out": F.concat(F.lit("v"), F.col("event_id").cast("string")), "ms": F.col("duration_ms")}


def cli_lines(spark: SparkSession, d: str) -> DataFrame:
    """An answer and its duration for each turn; an answer that uses a tool and its result for each call."""
    turns, calls, _ = parts(spark, d)
    of_turn = {"id": F.col("span_id"), "t": iso(F.col("at")), "m": F.col("model"), "ms": F.col("duration_ms"), **usage()}
    return written(
        (turns, 0, F.col("event_id"), text('{"type":"assistant","uuid":"<id>","timestamp":"<t>","message":{"model":"<m>","usage":' + USAGE + ',"content":[{"type":"text","text":"done"}]}}', **of_turn)),
        (turns, 1, F.col("event_id"), text('{"type":"system","subtype":"turn_duration","durationMs":<ms>}', **of_turn)),
        (calls, 0, F.col("event_id"), text('{"type":"assistant","uuid":"<id>","timestamp":"<t>","message":{"content":[{"type":"tool_use","id":"<id>","name":"<name>","input":<args>}]}}', **of_call())),
        (calls, 1, F.col("event_id"), text('{"type":"user","timestamp":"<end>","message":{"content":[{"type":"tool_result","tool_use_id":"<id>","content":"<out>","is_error":<bad>}]}}', **of_call())),
    )


def rollout_lines(spark: SparkSession, d: str) -> DataFrame:
    """A header; a model and a token count for each turn; a call and its output for each call."""
    turns, calls, first = parts(spark, d)
    of_turn = {"t": iso(F.col("at")), "m": F.col("model"), **usage(), "all": F.col("input_tokens") + F.col("cache_read_tokens")}
    return written(
        (first, -1, F.lit(-1), text('{"timestamp":"<t>","type":"session_meta","payload":{"id":"<id>","cwd":"/w"}}', t=iso(F.col("order_ns")), id=F.col("session_id"))),
        (turns, 0, F.col("event_id"), text('{"type":"turn_context","payload":{"model":"<m>"}}', **of_turn)),
        (turns, 1, F.col("event_id"), text('{"timestamp":"<t>","type":"event_msg","payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":<all>,"cached_input_tokens":<r>,"output_tokens":<o>}}}}', **of_turn)),
        (calls, 0, F.col("event_id"), text('{"timestamp":"<t>","type":"response_item","payload":{"type":"function_call","call_id":"<id>","name":"<name>","arguments":<args>}}', **of_call())),
        (calls, 1, F.col("event_id"), text('{"timestamp":"<end>","type":"event_msg","payload":{"type":"exec_command_end","call_id":"<id>","aggregated_output":"<out>","exit_code":<code>}}', code=F.col("is_error"), **of_call())),
        (calls, 2, F.col("event_id"), text('{"timestamp":"<end>","type":"response_item","payload":{"type":"function_call_output","call_id":"<id>","output":"ok"}}', **of_call())),
    )


def harness_lines(spark: SparkSession, d: str) -> DataFrame:
    """A header and totals; an answer for each turn; an answer that uses a tool for each call, and its result but for every third."""
    turns, calls, first = parts(spark, d)
    of_turn = {"t": iso(F.col("at")), "m": F.col("model"), "ms": F.col("duration_ms"), **usage()}
    last = first.withColumn("order_ns", F.lit((1 << 63) - 1))
    return written(
        (first, -1, F.lit(-1), text('{"type":"session_meta","ts":"<t>","session_id":"<id>","model":"base","cwd":"/w"}', t=iso(F.col("order_ns")), id=F.col("session_id"))),
        (turns, 0, F.col("event_id"), text('{"type":"assistant","ts":"<t>","model":"<m>","duration_ms":<ms>,"usage":' + USAGE + ',"content":[{"type":"text","text":"done"}]}', **of_turn)),
        (calls, 0, F.col("event_id"), text('{"type":"assistant","ts":"<t>","content":[{"type":"tool_use","id":"<id>","name":"<name>","input":<args>}]}', **of_call())),
        (calls.where("k % 3 != 0"), 1, F.col("event_id"), text('{"type":"tool_result","ts":"<end>","tool_use_id":"<id>","duration_ms":<ms>,"is_error":<bad>,"output":"<out>"}', **of_call())),
        (last, 0, F.lit(-1), F.lit('{"type":"end","usage":{"input_tokens":10,"output_tokens":2}}')),
    )


LINES = {"claude-code": cli_lines, "codex": rollout_lines, "harness": harness_lines}


def adapted(spark: SparkSession, d: str, source: str) -> dict[str, DataFrame]:
    return assemble.tables(source, events(LINES[source](spark, d)), now_ns=1)


def session_totals(spark: SparkSession, d: str, source: str) -> DataFrame:
    parts = assemble.ADAPTERS[source].normalize(events(LINES[source](spark, d)))
    return assemble.sessions(source, parts, now_ns=1).select("session_id", "turn_count", "tool_call_count", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "active_ms", "started_at_ns")


def calls_with_turns(spark: SparkSession, d: str, source: str) -> DataFrame:
    """Calls with the end of the turn they belong to, null for none."""
    made = adapted(spark, d, source)
    owner = made["turns"].select(F.col("session_id"), F.col("span_id").alias("turn_span_id"), F.col("ended_at_ns").alias("turn_ended_ns"))
    return made["tool_calls"].join(owner, ["session_id", "turn_span_id"], "left").select("session_id", "name", "args_preview", "started_at_ns", "ended_at_ns", "duration_ms", "is_error", "result_chars", "turn_ended_ns")


#: What the adapters are to give, by source, in SQL over fx_turns and fx_tools.
SUMS = ", ".join(f"CAST(COALESCE(SUM({c}), 0) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens"))
FIRST = "(SELECT session_id, MIN(started_at_ns) AS started_at_ns FROM (SELECT session_id, started_at_ns FROM fx_turns UNION ALL SELECT session_id, started_at_ns FROM fx_tools) GROUP BY 1)"
# a call's answer is a turn without tokens that takes no time
BOTH = """bt AS (SELECT session_id, started_at_ns, ended_at_ns, duration_ms, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens FROM fx_turns
  UNION ALL SELECT session_id, started_at_ns, started_at_ns, 0, 0, 0, 0, 0 FROM fx_tools)"""
GAPS = """gp AS (SELECT session_id, COUNT(*) AS turn_count, CAST(SUM(duration_ms) AS BIGINT) AS spent, CAST(COALESCE(SUM(CASE WHEN gap > 0 AND gap <= 300000 THEN gap END), 0) AS BIGINT) AS gaps, SUMS
  FROM (SELECT *, (lead(started_at_ns) OVER (PARTITION BY session_id ORDER BY started_at_ns) - started_at_ns) // 1000000 AS gap FROM TURNS) GROUP BY 1)""".replace("SUMS", SUMS)
CALLS = "cn AS (SELECT session_id, COUNT(*) AS tool_call_count FROM fx_tools GROUP BY 1)"
TOTALS = f"""SELECT f.session_id, COALESCE(turn_count, 0) AS turn_count, COALESCE(tool_call_count, 0) AS tool_call_count, INPUT AS input_tokens, OUTPUT AS output_tokens,
  COALESCE(cache_read_tokens, 0) AS cache_read_tokens, COALESCE(cache_creation_tokens, 0) AS cache_creation_tokens, COALESCE(CASE WHEN spent > 0 THEN spent ELSE gaps END, 0) AS active_ms, f.started_at_ns
FROM {FIRST} f LEFT JOIN gp USING (session_id) LEFT JOIN cn USING (session_id)"""
PLAIN = TOTALS.replace("INPUT", "COALESCE(input_tokens, 0)").replace("OUTPUT", "COALESCE(output_tokens, 0)")
ENDED = TOTALS.replace("INPUT", "CASE WHEN input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens = 0 THEN 10 ELSE input_tokens END").replace("OUTPUT", "CASE WHEN input_tokens + output_tokens + cache_read_tokens + cache_creation_tokens = 0 THEN 2 ELSE output_tokens END")
# a rollout's turn reaches from the count before it to its own; counts without tokens close none
COUNTED = f"""ct AS (SELECT t.session_id, CAST(substring(span_id, 2) AS BIGINT) AS event_id, t.started_at_ns AS order_ns, COALESCE(lag(ended_at_ns) OVER (PARTITION BY t.session_id ORDER BY t.started_at_ns, CAST(substring(span_id, 2) AS BIGINT)), f.started_at_ns) AS started_at_ns,
  ended_at_ns, input_tokens, output_tokens, cache_read_tokens, 0 AS cache_creation_tokens FROM fx_turns t JOIN {FIRST} f USING (session_id))"""
CLOSED = "rt AS (SELECT *, greatest(ended_at_ns - started_at_ns, 0) // 1000000 AS duration_ms, row_number() OVER (PARTITION BY session_id ORDER BY order_ns, event_id) AS i FROM ct WHERE input_tokens + cache_read_tokens <> 0 OR output_tokens <> 0)"
OWNED = """ow AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY c, CASE WHEN c = 2 THEN -i ELSE i END) AS n FROM (SELECT x.event_id, t.ended_at_ns AS turn_ended_ns, t.i,
  CASE WHEN t.started_at_ns <= x.started_at_ns AND x.started_at_ns <= t.ended_at_ns THEN 0 WHEN t.ended_at_ns >= x.started_at_ns THEN 1 ELSE 2 END AS c FROM fx_tools x JOIN rt t USING (session_id)))"""
TIGHT = """replace(args_preview, '": "', '":"')"""
CHARS = "CAST(1 + length(CAST(event_id AS VARCHAR)) AS BIGINT)"
CALL = f"SELECT session_id, name, {TIGHT} AS args_preview, started_at_ns, ENDED AS ended_at_ns, SPENT AS duration_ms, ERROR AS is_error, CHARS AS result_chars, TURN AS turn_ended_ns FROM fx_tools"
TOOK = "(ended_at_ns - started_at_ns) // 1000000"


def call_sql(ended: str, spent: str, error: str, chars: str, turn: str) -> str:
    return CALL.replace("ENDED", ended).replace("SPENT", spent).replace("ERROR", error).replace("CHARS", chars).replace("TURN", turn)


SESSIONS_SQL = {"claude-code": (PLAIN, BOTH, GAPS.replace("TURNS", "bt"), CALLS), "codex": (PLAIN, COUNTED, CLOSED, GAPS.replace("TURNS", "rt"), CALLS), "harness": (ENDED, BOTH, GAPS.replace("TURNS", "bt"), CALLS)}
CALLS_SQL = {
    "claude-code": (call_sql("ended_at_ns", TOOK, "is_error", CHARS, "started_at_ns"),),
    "codex": (call_sql("ended_at_ns", TOOK, "is_error", CHARS, "turn_ended_ns") + " LEFT JOIN (SELECT event_id, turn_ended_ns FROM ow WHERE n = 1) USING (event_id)", COUNTED, CLOSED, OWNED),
    "harness": (call_sql("CASE WHEN k % 3 = 0 THEN started_at_ns ELSE ended_at_ns END", "CASE WHEN k % 3 = 0 THEN 0 ELSE duration_ms END", "CASE WHEN k % 3 = 0 THEN 0 ELSE is_error END", f"CASE WHEN k % 3 = 0 THEN 0 ELSE {CHARS} END", "started_at_ns"),),
}
