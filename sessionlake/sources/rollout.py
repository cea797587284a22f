"""Adapter of rollout transcripts: {timestamp, type, payload} lines, turns closed by token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.columns import is_string, ns_of, span_id
from sessionlake.functions.intervals import with_owner
from sessionlake.functions.places import kept
from sessionlake.sources.scan import filled, long_at, text_at
from sessionlake.sources.shared import Parts, call_rows, content_rows, item, last_line, turn_rows

SOURCE = "codex"


def normalize(evs: DataFrame) -> Parts:
    # what the tables need of a line is read from its JSON once, and kept with its file's session
    evs = evs.withColumns({"type": text_at("ev", "$.type"), "kind": text_at("ev", "$.payload.type")})
    kind, type_ = F.col("kind"), F.col("type")
    of = lambda kinds, value: F.when(kind.isin(*kinds), value)
    begun, ended, out = ("function_call", "custom_tool_call"), ("exec_command_end", "patch_apply_end"), ("function_call_output", "custom_tool_call_output")
    at = lambda path: F.try_variant_get("ev", path, "variant")
    text = lambda v: F.when(is_string(v), F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    header = {"id": "id", "source": "source", "version": "cli_version", "cwd": "cwd", "parent": "source.subagent.thread_spawn.parent_thread_id"}
    usage = {"total": "input_tokens", "cached": "cached_input_tokens", "output_tokens": "output_tokens", "reasoning_tokens": "reasoning_output_tokens"}
    ran = F.when(kind == "exec_command_end", text_at("ev", "$.payload.aggregated_output")).otherwise(F.concat(F.coalesce(text_at("ev", "$.payload.stdout"), F.lit("")), F.coalesce(text_at("ev", "$.payload.stderr"), F.lit(""))))
    e = evs.select(
        "file", F.col("session_id").alias("stem"), "line_no", "type", "kind", ns_of(text_at("ev", "$.timestamp")).alias("ts"), *[F.when(type_ == "session_meta", text_at("ev", f"$.payload.{k}")).alias(c) for c, k in header.items()], F.when(type_ == "session_meta", at("$.payload.source.subagent").isNotNull()).alias("nested"),
        F.when(type_ == "turn_context", filled(text_at("ev", "$.payload.model"))).alias("context"), *[of(("token_count",), long_at("ev", f"$.payload.info.last_token_usage.{k}")).alias(c) for c, k in usage.items()], F.when(kind.isin(*begun, *ended) | kind.endswith("_output"), text_at("ev", "$.payload.call_id")).alias("call_id"),
        of(begun, F.coalesce(text_at("ev", "$.payload.name"), F.lit("?"))).alias("name"), of(begun, text(F.when(kind == "function_call", at("$.payload.arguments")).otherwise(at("$.payload.input")))).alias("arguments"), F.when(kind.endswith("_output"), text(at("$.payload.output"))).alias("output"), of(ended, F.length(ran)).alias("ran_chars"),
        of(("exec_command_end",), long_at("ev", "$.payload.duration.secs") * 1_000_000_000 + long_at("ev", "$.payload.duration.nanos")).alias("ran_ns"), of(("exec_command_end",), F.try_variant_get("ev", "$.payload.exit_code", "long")).alias("exit_code"), of(("patch_apply_end",), F.coalesce(F.try_variant_get("ev", "$.payload.success", "boolean"), F.lit(False))).alias("success"),
        of(("user_message", "agent_message"), F.trim(F.coalesce(text_at("ev", "$.payload.message"), F.lit("")))).alias("message"), of(("agent_message",), text_at("ev", "$.payload.phase")).alias("phase"),
    )
    meta = F.when(F.col("type") == "session_meta", F.col("line_no"))
    file = Window.partitionBy("stem", "file")
    e = kept(e.withColumns({"session_id": F.coalesce(filled(F.min_by("id", meta).over(file)), F.col("stem")), "opening_ns": F.min_by("ts", "line_no").over(file), "first_model": F.min_by("context", F.when(F.col("context").isNotNull(), F.col("line_no"))).over(file)}), "rollout-events", wide=True)
    timed = F.when(F.col("ts").isNotNull(), F.col("line_no"))
    bounds = e.groupBy("file", "stem").agg(F.first("session_id").alias("session_id"), F.min_by("ts", timed).alias("first_ns"), F.max_by("ts", timed).alias("last_ns"), F.when(F.min_by("nested", meta), "subagent").otherwise(F.min_by("source", meta)).alias("surface"), F.min_by("version", meta).alias("version"), F.lit(None).cast("string").alias("git_branch"), F.min_by("cwd", meta).alias("cwd"), F.first("first_model").alias("model"), F.min_by("parent", meta).alias("parent_session_id"), F.lit(0).alias("sidechain")).where("first_ns is not null").drop("stem")

    # every timed token count moves the boundary; those with usage close a turn
    order = Window.partitionBy("session_id").orderBy("line_no")
    counts = e.where("context is not null or (kind = 'token_count' and ts is not null)").withColumn("model", F.coalesce(F.last("context", ignorenulls=True).over(order), F.col("first_model")))
    counts = counts.where("kind = 'token_count' and ts is not null").withColumn("from", F.coalesce(F.lag("ts").over(order), F.col("opening_ns")))
    used = counts.where((F.col("total") != 0) | (F.col("output_tokens") != 0)).where("`from` is not null")
    turns = used.withColumn("i", F.row_number().over(order) - 1).select("session_id", "line_no", "i", span_id(SOURCE, F.col("session_id"), F.concat(F.lit("turn:"), F.col("i").cast("string"))).alias("span_id"), "model", F.col("from").alias("started_at_ns"), F.col("ts").alias("ended_at_ns"), F.greatest(F.col("total") - F.col("cached"), F.lit(0)).alias("input_tokens"), "output_tokens", F.col("cached").alias("cache_read_tokens"), "reasoning_tokens")

    # a call, what ended it and its output, in order by call id: each call starts a new group
    calls = e.where("ts is not null and call_id is not null").where(F.col("kind").isin(*begun, *ended, *out))
    is_call = F.col("kind").isin("function_call", "custom_tool_call")
    is_output = F.col("kind").endswith("_output")
    of_id = Window.partitionBy("session_id", "call_id").orderBy("line_no")
    # a call that a new call of the same id replaces is lost, and so is what comes after an output
    calls = calls.withColumn("g", F.sum(is_call.cast("int")).over(of_id)).where("g > 0")
    calls = calls.withColumn("done", F.coalesce(F.sum(is_output.cast("int")).over(Window.partitionBy("session_id", "call_id", "g").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("done = 0")
    calls = calls.withColumn("groups", F.max("g").over(Window.partitionBy("session_id", "call_id")))
    pick = lambda kinds, value: F.max_by(value, F.when(F.col("kind").isin(*kinds), F.col("line_no")))
    one = calls.groupBy("session_id", "call_id", "g").agg(
        F.max("groups").alias("groups"), F.max("line_no").alias("line_no"), pick(begun, "ts").alias("started_at_ns"), pick(begun, "name").alias("name"), pick(begun, F.coalesce("arguments", F.lit(""))).alias("arguments"), pick(begun, "kind").alias("begun_as"),
        pick(ended, "ts").alias("end_ts"), pick(("exec_command_end",), "ran_ns").alias("ran_ns"), pick(("exec_command_end",), "exit_code").alias("exit_code"), pick(("patch_apply_end",), "success").alias("success"), pick(ended, "ran_chars").alias("ran_chars"),
        pick(out, "ts").alias("out_ts"), pick(out, F.length("output")).alias("out_chars"),
    )
    # an output closes a call; an end event alone does so for the last call of its id
    one = one.withColumn("ended_at_ns", F.coalesce("out_ts", F.when(F.col("g") == F.col("groups"), F.col("end_ts")))).where("ended_at_ns is not null")
    error = F.coalesce(F.col("exit_code") != 0, F.lit(False)) | ((F.col("begun_as") == "custom_tool_call") & (F.coalesce("success", F.lit(True)) == F.lit(False)))
    one = one.withColumns({"span_id": span_id(SOURCE, F.col("session_id"), F.concat(F.lit("tool:"), F.col("call_id"))), "duration_ms": F.when(F.col("ran_ns") > 0, F.expr("ran_ns div 1000000")).otherwise(F.greatest(F.lit(0), F.expr("(ended_at_ns - started_at_ns) div 1000000"))), "is_error": error, "result_chars": F.greatest(F.coalesce("out_chars", F.lit(0)), F.coalesce("ran_chars", F.lit(0)))})

    def placed() -> DataFrame:
        """The first turn that holds the call, else the first that ends later, else the last, else the root."""
        t = turns.select("session_id", "i", F.col("span_id").alias("turn_span_id"), F.col("started_at_ns").alias("t0"), F.col("ended_at_ns").alias("t1"))
        owned = with_owner(last_line(one, "call_id"), "started_at_ns", t, "t0", "t1", "i", "session_id", "owner")
        root = span_id(SOURCE, F.col("session_id"), F.lit("root"))
        return call_rows(owned.withColumn("turn_span_id", F.coalesce("owner.turn_span_id", root)))

    tool = span_id(SOURCE, F.col("session_id"), F.concat(F.lit("tool:"), F.col("call_id")))
    has_id = F.col("call_id").isNotNull()
    said = F.when(F.col("kind") == "user_message", item("user_message", F.col("message")))
    said = said.when((F.col("kind") == "agent_message") & (F.col("phase").isNull() | (F.col("phase") == "final")), item("assistant_message", F.col("message")))
    said = said.when(is_call & has_id, item("tool_arguments", F.col("arguments"), tool))
    said = said.when(is_output & has_id, item("tool_result", F.col("output"), tool))
    contents = e.select("session_id", "line_no", F.lit(0).alias("pos"), F.col("ts").alias("ts_ns"), said.alias("c")).where("c is not null").select("session_id", "line_no", "pos", "ts_ns", "c.*")
    return Parts(bounds, turn_rows(turns), placed, content_rows(contents), last_line(one, "call_id").select("session_id", "started_at_ns", "ended_at_ns"))
