"""Session rows from the parts of an adapter, and the registry of adapters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.columns import class_for, project_of, trace_id
from sessionlake.operators.sessions import active_ms, with_gaps
from sessionlake.sources import cli_agent, harness, rollout
from sessionlake.sources.shared import Parts

PIPELINE_VERSION = 4


@dataclass(frozen=True)
class Adapter:
    """A source: events to parts, and its tool classes."""

    normalize: Callable[[DataFrame], Parts]
    tool_class: Callable[[], Column]


ADAPTERS: dict[str, Adapter] = {m.SOURCE: Adapter(m.normalize, lambda s=m.SOURCE: class_for(s)) for m in (cli_agent, rollout, harness)}


def register(source: str, adapter: Adapter) -> None:
    """Adds a source of the user's own."""
    ADAPTERS[source] = adapter


def sessions(source: str, parts: Parts, idle_ms: int = 300_000, now_ns: int | None = None) -> DataFrame:
    """One row for each session of the parts; a file without any timed event has none."""
    t, x = with_gaps(parts.turns), parts.contents
    c = parts.calls() if parts.times is None else parts.times
    sums = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens")
    of_turns = t.groupBy("session_id").agg(F.count("*").alias("turn_count"), *[F.sum(k).alias(k) for k in sums], F.min("started_at_ns").alias("t0"), F.max("ended_at_ns").alias("t1"), F.min_by("model", F.when(F.col("model") != "", F.struct("started_at_ns", "span_id"))).alias("first_model"), active_ms(idle_ms).alias("active_ms"))
    of_calls = c.groupBy("session_id").agg(F.count("*").alias("tool_call_count"), F.min("started_at_ns").alias("c0"), F.max("ended_at_ns").alias("c1"))
    thinking = F.col("kind") == "thinking"
    asked = (F.col("kind") == "user_message") & ~F.col("text").startswith("<")
    of_texts = x.groupBy("session_id").agg(F.sum(thinking.cast("long")).alias("thinking_blocks"), F.sum(F.when(thinking, F.length("text")).otherwise(0)).cast("long").alias("thinking_chars"), F.min_by(F.substring("text", 1, 300), F.when(asked, F.col("seq"))).alias("first_user_message"))
    rows = parts.bounds
    for other in (of_turns, of_calls, of_texts):
        rows = rows.join(other, "session_id", "left")
    # only the CLI agent's spans can reach beyond its events
    wide = source == cli_agent.SOURCE
    rows = rows.withColumn("started_at_ns", F.least("first_ns", "t0", "c0") if wide else F.col("first_ns")).withColumn("ended_at_ns", F.greatest("last_ns", "t1", "c1") if wide else F.col("last_ns"))
    zero = ("turn_count", *sums, "tool_call_count", "thinking_blocks", "thinking_chars", "active_ms")
    sub = (F.coalesce(F.col("sidechain"), F.lit(0)) == 1) | F.coalesce(F.col("surface") == "subagent", F.lit(False)) | F.col("session_id").startswith("agent-") | F.col("file").contains("/subagents/")
    stamp = F.lit(now_ns).cast("long") if now_ns is not None else F.unix_micros(F.current_timestamp()) * 1000
    link = F.col("cli_session_id") if "cli_session_id" in rows.columns else F.lit(None).cast("string")
    return rows.select("session_id", trace_id(source, F.col("session_id")).alias("trace_id"), F.lit(source).alias("source"), "surface", "cwd", project_of(F.col("cwd")).alias("project"), sub.cast("int").alias("is_subagent"), "parent_session_id", "git_branch", F.coalesce("first_model", "model").alias("model"), "version", "started_at_ns", "ended_at_ns", F.greatest(F.lit(0), F.expr("(ended_at_ns - started_at_ns) div 1000000")).alias("wall_ms"), *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in zero], "first_user_message", F.col("file").alias("file_path"), F.lit(PIPELINE_VERSION).alias("pipeline_version"), stamp.alias("ingested_at_ns"), link.alias("cli_session_id"))


def tables(source: str, evs: DataFrame, now_ns: int | None = None) -> dict[str, DataFrame]:
    """sessions, turns, tool_calls and contents of one source's events."""
    parts = ADAPTERS[source].normalize(evs)
    calls = parts.calls()
    have = parts.bounds.select("session_id")
    return {"sessions": sessions(source, parts, now_ns=now_ns), "turns": parts.turns.join(have, "session_id", "left_semi"), "tool_calls": calls.join(have, "session_id", "left_semi"), "contents": parts.contents.join(have, "session_id", "left_semi")}


def empty_files(evs_files: DataFrame, sessions_made: DataFrame) -> DataFrame:
    """Files that gave no session; these are empty, not failed."""
    return evs_files.select(F.col("path").alias("file_path")).join(sessions_made.select("file_path"), "file_path", "left_anti")
