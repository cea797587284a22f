"""Hook denials in tool results, and whether the agent heeded them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.columns import HOOK


def hook_results(contents: DataFrame, calls: DataFrame) -> DataFrame:
    """Tool results (session_id, span_id, tool_name, ts_ns, text) of the content table, with the names of their calls; null where the call is unknown."""
    results = contents.where("kind = 'tool_result'").select("session_id", "span_id", "ts_ns", "text")
    return results.join(calls.select("session_id", "span_id", F.col("name").alias("tool_name")).dropDuplicates(["session_id", "span_id"]), ["session_id", "span_id"], "left")


def hook_events(results: DataFrame, calls: DataFrame, session_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Events parsed from tool results (session_id, span_id, tool_name, ts_ns, text): event, matcher, hook, message, outcome.

    Marks that only quote a hook do not name the tool of the call in their matcher and are left out. The outcome of a guard against rereading is `bypassed` if the session reads the denied file later without an error, else `heeded`.
    """
    rows = results.where(F.col("text").ilike("%hook error:%"))
    if session_id is not None:
        rows = rows.where(F.col("session_id") == session_id)
    group = lambda i: F.regexp_extract("text", HOOK, i)
    rows = rows.withColumns({"event": group(1), "matcher": group(2), "kind": group(3), "command": group(4), "message": F.substring(F.trim(F.regexp_replace(group(5), r"\s+", " ")), 1, 200)}).where("kind = 'error'")
    rows = rows.where(F.col("tool_name").isNull() | F.array_contains(F.split("matcher", r"\|"), F.col("tool_name")))
    words = F.split(F.trim(F.col("command")), r"\s+")
    script: Column = F.element_at(F.split(F.element_at(words, -1), "/"), -1)
    rows = rows.withColumn("hook", F.when(script == "", F.lit("?")).otherwise(script)).withColumn("denied", F.nullif(F.regexp_extract("message", r"you already read (\S+)", 1), F.lit("")))
    guarded = rows.where(F.col("hook").contains("reread-guard") & F.col("denied").isNotNull() & F.col("ts_ns").isNotNull())
    later = calls.where("name = 'Read' and is_error = 0").select("session_id", F.col("started_at_ns").alias("at"), "args_preview")
    # the denied paths of a session meet each later read once; only the last read of a path counts
    denied = guarded.groupBy("session_id").agg(F.collect_set(F.lower("denied")).alias("paths"), F.min("ts_ns").alias("from_ns"))
    read = later.join(denied, "session_id").where("at > from_ns").select("session_id", "at", F.explode(F.filter("paths", lambda p: F.contains(F.lower("args_preview"), p))).alias("path"))
    last = read.groupBy("session_id", "path").agg(F.max("at").alias("at"))
    again = guarded.select("session_id", "span_id", "ts_ns", F.lower("denied").alias("path")).join(last, ["session_id", "path"]).where("at > ts_ns").select("span_id").distinct().withColumn("again", F.lit(True))
    outcome = F.when(F.col("hook").contains("reread-guard") & F.col("denied").isNotNull() & F.col("ts_ns").isNotNull(), F.when(F.col("again"), "bypassed").otherwise("heeded"))
    got = rows.join(again, "span_id", "left").select("session_id", "span_id", "ts_ns", "event", "matcher", "hook", "message", outcome.alias("outcome"))
    return got if limit is None else got.orderBy(F.desc("ts_ns"), "span_id").limit(limit)


def hook_summary(events: DataFrame) -> DataFrame:
    is_ = lambda v: F.sum(F.when(F.col("outcome") == v, 1).otherwise(0)).cast("long")
    return events.groupBy("hook").agg(F.count("*").alias("events"), F.countDistinct("session_id").alias("sessions"), is_("heeded").alias("heeded"), is_("bypassed").alias("bypassed"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))
