"""Adapter of the CLI agent's transcripts: one event for each line, messages as lists of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.columns import is_string, ns_of, span_id
from sessionlake.functions.places import kept
from sessionlake.sources.scan import filled, first_of, long_at, text_at
from sessionlake.sources.shared import Parts, block_items, call_rows, chars, content_rows, item, turn_rows

SOURCE = "claude-code"


def normalize(evs: DataFrame) -> Parts:
    # what the tables need of a line is read from its JSON once, and kept
    evs = evs.withColumns({"type": text_at("ev", "$.type"), "content": F.try_variant_get("ev", "$.message.content", "variant")})
    kind, content = F.col("type"), F.col("content")
    spoken = kind.isin("assistant", "user")
    usage = lambda k: F.when(kind == "assistant", long_at("ev", f"$.message.usage.{k}"))
    e = evs.select(
        "file", "session_id", "line_no", "type", filled(text_at("ev", "$.uuid")).alias("uuid"), ns_of(text_at("ev", "$.timestamp")).alias("ts"), text_at("ev", "$.entrypoint").alias("entrypoint"), text_at("ev", "$.version").alias("version"), text_at("ev", "$.gitBranch").alias("branch"), text_at("ev", "$.cwd").alias("cwd"), F.coalesce(F.try_variant_get("ev", "$.isSidechain", "boolean"), F.lit(False)).cast("int").alias("sidechain"),
        F.when((kind == "system") & (text_at("ev", "$.subtype") == "turn_duration"), long_at("ev", "$.durationMs")).alias("ms"), F.when(kind == "assistant", text_at("ev", "$.message.model")).alias("model"), usage("input_tokens").alias("input_tokens"), usage("output_tokens").alias("output_tokens"), usage("cache_read_input_tokens").alias("cache_read_tokens"), usage("cache_creation_input_tokens").alias("cache_creation_tokens"),
        F.when(spoken & is_string(content), F.try_variant_get(content, "$", "string")).alias("said"), F.when(spoken, block_items(content)).alias("items"),
    )
    e = kept(e, "cli-events", wide=True)
    timed = F.when(F.col("ts").isNotNull(), F.col("line_no"))
    bounds = e.groupBy("session_id").agg(F.min("file").alias("file"), F.min_by("ts", timed).alias("first_ns"), F.max_by("ts", timed).alias("last_ns"), first_of(F.col("entrypoint")).alias("surface"), first_of(F.col("version")).alias("version"), first_of(F.col("branch")).alias("git_branch"), first_of(F.col("cwd")).alias("cwd"), F.max("sidechain").alias("sidechain")).where("first_ns is not null")
    bounds = bounds.withColumn("parent_session_id", filled(F.regexp_extract("file", r"/([^/]+)/subagents/", 1))).withColumn("model", F.lit(None).cast("string"))

    turn_id = span_id(SOURCE, F.col("session_id"), F.concat(F.lit("turn:"), F.coalesce("uuid", F.col("ts").cast("string"))))
    # a duration event belongs to the last turn before it; of several, the last positive one counts
    is_turn = (F.col("type") == "assistant") & F.col("ts").isNotNull()
    order = Window.partitionBy("session_id").orderBy("line_no")
    marked = e.where(is_turn | (F.col("ms") > 0)).withColumn("turn_line", F.last(F.when(is_turn, F.col("line_no")), ignorenulls=True).over(order))
    spent = F.max_by("ms", F.when(F.col("ms") > 0, F.col("line_no"))).over(Window.partitionBy("session_id", "turn_line"))
    turns = marked.withColumn("ms", spent).where(is_turn).select(
        "session_id", "line_no", turn_id.alias("span_id"), "model", (F.col("ts") - F.coalesce("ms", F.lit(0)) * 1_000_000).alias("started_at_ns"), F.col("ts").alias("ended_at_ns"), F.coalesce("ms", F.lit(0)).alias("duration_ms"),
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", chars(F.col("items"), "thinking").alias("thinking_chars"), chars(F.col("items"), "text").alias("text_chars"),
    )

    # uses and results of one tool id in order: a result right after a use is a pair
    b = e.where("ts is not null and type in ('assistant', 'user')").select("session_id", "line_no", "type", "ts", turn_id.alias("turn"), F.posexplode("items").alias("pos", "b"))
    use = (F.col("type") == "assistant") & (F.col("b.kind") == "tool_use")
    result = (F.col("type") == "user") & (F.col("b.kind") == "tool_result")
    b = b.select("session_id", "line_no", "pos", "ts", use.alias("use"), F.when(use, filled(F.col("b.id"))).when(result, F.col("b.result_id")).alias("id"), F.when(use, F.struct("ts", "turn", "b.name", F.col("b.input").alias("arguments"))).alias("u"), F.col("b.bad").alias("is_error"), F.length("b.result").alias("result_chars")).where("id is not null")
    of_id = Window.partitionBy("session_id", "id").orderBy("line_no", "pos")
    paired = b.withColumn("u", F.lag("u").over(of_id)).where(~F.col("use") & F.col("u").isNotNull())
    calls = paired.select("session_id", "id", "line_no", "pos", span_id(SOURCE, F.col("session_id"), F.concat(F.lit("tool:"), F.col("id"))).alias("span_id"), F.col("u.turn").alias("turn_span_id"), "u.name", "u.arguments", F.col("u.ts").alias("started_at_ns"), F.col("ts").alias("ended_at_ns"), F.expr("(ts - u.ts) div 1000000").alias("duration_ms"), "is_error", "result_chars")

    # an event logged again replaces the earlier one and keeps its place
    key = F.coalesce(F.col("uuid"), F.concat(F.lit("#"), F.col("line_no").cast("string")))
    again = Window.partitionBy("session_id", "key")
    settled = e.withColumn("key", key).withColumn("first_line", F.min("line_no").over(again)).withColumn("last_line", F.max("line_no").over(again)).where("line_no = last_line").withColumn("line_no", F.col("first_line"))
    turn = F.when(F.col("type") == "assistant", turn_id)
    tool = lambda x: span_id(SOURCE, F.col("session_id"), F.concat(F.lit("tool:"), x))

    def of_block(x):
        assistant = F.when(x.kind == "thinking", item("thinking", x.thinking, turn)).when(x.kind == "text", item("assistant_message", F.trim(x.text), turn)).when((x.kind == "tool_use") & x.id.isNotNull(), item("tool_arguments", x.input, tool(x.id)))
        user = F.when(x.plain.isNotNull(), item("user_message", F.trim(x.plain))).when((x.kind == "tool_result") & x.result_id.isNotNull(), item("tool_result", x.result, tool(x.result_id))).when(x.kind == "text", item("user_message", F.trim(x.text)))
        return F.when(F.col("type") == "assistant", assistant).otherwise(user)

    whole = F.array(item(F.when(F.col("type") == "assistant", "assistant_message").otherwise("user_message"), F.trim("said"), turn))
    parts = F.when(F.col("said").isNotNull(), whole).otherwise(F.transform("items", of_block))
    contents = settled.where(F.col("type").isin("assistant", "user")).select("session_id", "line_no", F.col("ts").alias("ts_ns"), F.posexplode(parts).alias("pos", "c")).select("session_id", "line_no", "pos", "ts_ns", "c.*")
    return Parts(bounds, turn_rows(turns), call_rows(calls, "id"), content_rows(contents))
