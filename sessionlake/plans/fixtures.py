"""Session tables derived from the given test tables: one SQL text for Spark and DuckDB alike.

The views are the shared prelude of FIXTURES.md. {US} is the engine's
expression for the microseconds of events.ts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("events", "conversations", "documents")

VIEWS: dict[str, str] = {
    "fx_ev": """SELECT event_id, event_type, value, {US}*1000 AS ts_ns,
  CAST(substring(props, 7, length(props)-7) AS BIGINT) AS k,
  concat('u', CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS session_id,
  user_id
FROM events""",
    "fx_turns": """SELECT concat('t', CAST(event_id AS STRING)) AS span_id, session_id,
  CASE event_id % 5 WHEN 0 THEN 'alpha-large-1' WHEN 1 THEN 'alpha-small-20250101'
    WHEN 2 THEN 'alpha-mid' WHEN 3 THEN 'beta-unlisted' ELSE '<synthetic>' END AS model,
  ts_ns AS started_at_ns,
  ts_ns + CAST(floor(value*1000) AS BIGINT)*1000000 AS ended_at_ns,
  CAST(floor(value*1000) AS BIGINT) AS duration_ms,
  CASE WHEN event_id % 5 = 4 THEN 0 ELSE event_id % 1000 END AS input_tokens,
  CASE WHEN event_id % 5 = 4 THEN 0 ELSE CAST(floor(value*100) AS BIGINT) END AS output_tokens,
  CASE WHEN event_id % 5 = 4 THEN 0 ELSE (event_id*7) % 20000 END AS cache_read_tokens,
  CASE WHEN event_id % 5 = 4 THEN 0 ELSE (event_id*3) % 5000 END AS cache_creation_tokens,
  k*10 AS text_chars, k*3 AS thinking_chars
FROM fx_ev WHERE event_type IN ('view','purchase','signup')""",
    "fx_tools": """SELECT concat('c', CAST(event_id AS STRING)) AS span_id, session_id,
  CASE k % 7 WHEN 0 THEN 'Read' WHEN 1 THEN 'Bash' WHEN 2 THEN 'Grep' WHEN 3 THEN 'Edit'
    WHEN 4 THEN 'mcp__linear__save_issue' WHEN 5 THEN 'StructuredOutput' ELSE 'Task' END AS name,
  CAST(k % 5 AS STRING) AS args_hash,
  CASE k % 7 WHEN 1 THEN concat('{"command": "', CASE WHEN k % 2 = 0 THEN 'cat' ELSE 'make' END,
      ' f', CAST(k % 5 AS STRING), '"}')
    ELSE concat('{"file_path": "/repo/f', CAST(k % 5 AS STRING), '.py"}') END AS args_preview,
  ts_ns AS started_at_ns,
  ts_ns + CAST(floor(value*1000) AS BIGINT)*1000000 AS ended_at_ns,
  CAST(floor(value*1000) AS BIGINT) AS duration_ms,
  CASE WHEN event_type='error' THEN 1 ELSE 0 END AS is_error,
  CAST(floor(value*1000) AS BIGINT) AS result_chars,
  k, event_id
FROM fx_ev WHERE event_type IN ('click','error')""",
    "fx_contents": """SELECT session_id, span_id, 'tool_arguments' AS kind, event_id*2 AS seq,
  started_at_ns AS ts_ns, args_preview AS text FROM fx_tools
UNION ALL
SELECT session_id, span_id, 'tool_result' AS kind, event_id*2+1 AS seq, ended_at_ns AS ts_ns,
  CASE WHEN is_error = 1 THEN 'same failure' ELSE concat('v', CAST(event_id AS STRING)) END AS text
FROM fx_tools""",
    "fx_sessions": """SELECT session_id,
  CASE MIN(user_id) % 3 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex' ELSE 'harness' END AS source,
  concat('team', CAST(MIN(user_id) % 4 AS STRING), '/app') AS project,
  CASE WHEN MIN(user_id) % 10 = 9 THEN 1 ELSE 0 END AS is_subagent,
  MIN(ts_ns) AS started_at_ns, MAX(ts_ns) AS ended_at_ns, COUNT(*) AS n_events
FROM fx_ev GROUP BY session_id""",
    "fx_messages": """SELECT concat('conv', CAST(conv_id AS STRING)) AS session_id,
  CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message'
    ELSE 'thinking' END AS kind,
  turn AS seq, 1704067200000000000 + turn*60000000000 AS ts_ns, text
FROM conversations""",
    "fx_msg_turns": """SELECT concat('conv', CAST(conv_id AS STRING)) AS session_id,
  concat('m', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS span_id,
  1704067200000000000 + turn*60000000000 AS started_at_ns,
  1704067200000000000 + turn*60000000000 + 30000000000 AS ended_at_ns,
  CAST(length(text) AS BIGINT) AS output_tokens
FROM conversations WHERE role = 'assistant'""",
    "fx_scripts": """SELECT session_id, span_id, concat('python3 - <<EOF import json import mod', CAST(k % 4 AS STRING),
  CASE WHEN k % 2 = 0 THEN ' Counter(x)' ELSE ' glob(x) defaultdict(x)' END) AS text
FROM fx_tools WHERE name IN ('Bash','Grep','Read')""",
    "fx_hooks": """SELECT session_id, span_id, name AS tool_name, ended_at_ns AS ts_ns,
  concat('PreToolUse:Read hook error: [python3 /h/reread-guard.py]: you already read /repo/f',
    CAST(k % 5 AS STRING), '.py this session') AS text
FROM fx_tools WHERE is_error = 1""",
    "fx_markers": """SELECT DISTINCT project AS cwd, 'f3.py' AS marker FROM fx_sessions
WHERE project IN ('team0/app','team1/app')""",
    "fx_inventory": """SELECT concat('f', CAST(doc_id AS STRING)) AS path, concat('n', CAST(n_chars AS STRING)) AS fingerprint,
  doc_id % 20 AS age_s FROM documents""",
    "fx_state": """SELECT concat('f', CAST(doc_id AS STRING)) AS path,
  CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE concat('n', CAST(n_chars AS STRING)) END AS fingerprint,
  CASE doc_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'empty' ELSE 'ingested' END AS status,
  1 AS attempts FROM documents WHERE doc_id % 3 <> 0""",
    "fx_versions": """SELECT source, concat('s', CAST(doc_id % 50 AS STRING)) AS session_id, CAST(doc_id AS STRING) AS sha256,
  n_chars AS size_bytes, 1704067200000000000 + doc_id*3600000000000 AS captured_at_ns
FROM documents""",
    "fx_family": """SELECT s.*, CASE WHEN is_subagent = 1 THEN concat('u', CAST(CAST(split_part(substring(session_id, 2), '-', 1) AS BIGINT) - 1 AS STRING), substring(session_id, 2 + length(split_part(substring(session_id, 2), '-', 1)))) END AS parent_session_id
FROM fx_sessions s""",
}


def closure(names: list[str]) -> list[str]:
    """The views that these need, themselves included, in order."""
    need: set[str] = set()
    todo = list(names)
    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += [v for v in VIEWS if v != n and re.search(rf"\b{v}\b", VIEWS[n])]
    return [v for v in VIEWS if v in need]


def oracle(select: str, *ctes: str) -> str:
    """DuckDB SQL: the views that the texts name, further CTEs, then the query."""
    named = [v for v in VIEWS if any(re.search(rf"\b{v}\b", x) for x in (select, *ctes))]
    parts = [f"{v} AS ({VIEWS[v].replace('{US}', 'epoch_us(ts)')})" for v in closure(named)]
    return "WITH " + ",\n".join([*parts, *ctes]) + "\n" + select


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet tables."""
    text = ",\n".join(f"{v} AS ({VIEWS[v].replace('{US}', 'unix_micros(CAST(ts AS TIMESTAMP))')})" for v in closure([name]))
    used = [b for b in BASE if re.search(rf"\bFROM {b}\b", text)]
    for b in used:
        text = re.sub(rf"\bFROM {b}\b", f"FROM {{{b}}}", text)
    # braces of JSON texts are doubled, as spark.sql fills in the tables by format
    body = re.sub(r"\{(?!(?:" + "|".join(BASE) + r")\})", "{{", text)
    body = re.sub(r"(?<!events)(?<!conversations)(?<!documents)\}", "}}", body)
    return spark.sql(f"WITH {body} SELECT * FROM {name}", **{b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in used})
