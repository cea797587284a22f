"""Adapter of harness transcripts: session_meta, user, assistant, tool_result, cli_session and end lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.columns import ns_of, span_id
from sessionlake.functions.places import kept
from sessionlake.sources.scan import filled, first_of, long_at, text_at
from sessionlake.sources.shared import Parts, block_items, call_rows, chars, content_rows, item, turn_rows

SOURCE = "harness"
USAGE = {"input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_input_tokens", "cache_creation_tokens": "cache_creation_input_tokens"}


def normalize(evs: DataFrame) -> Parts:
    # what the tables need of a line is read from its JSON once, and kept with its file's session
    evs = evs.withColumns({"type": text_at("ev", "$.type"), "content": F.try_variant_get("ev", "$.content", "variant")})
    kind, content = F.col("type"), F.col("content")
    of = lambda k, value: F.when(kind == k, value)
    usage = of("assistant", F.lit(True)) | of("end", F.try_variant_get("ev", "$.usage", "variant").isNotNull())
    e = evs.select(
        "file", F.col("session_id").alias("stem"), "line_no", "type", ns_of(text_at("ev", "$.ts")).alias("ts"), *[of("session_meta", text_at("ev", f"$.{k}")).alias(c) for c, k in (("id", "session_id"), ("version", "harness_version"), ("cwd", "cwd"), ("git_branch", "git_branch"), ("named", "model"))], of("cli_session", text_at("ev", "$.cli_session_id")).alias("cli_session_id"),
        of("assistant", text_at("ev", "$.model")).alias("model"), F.when(kind.isin("assistant", "tool_result"), long_at("ev", "$.duration_ms")).alias("ms"), *[F.when(usage, long_at("ev", f"$.usage.{k}")).alias(c) for c, k in USAGE.items()], of("assistant", block_items(content)).alias("items"),
        of("tool_result", F.coalesce(text_at("ev", "$.tool_use_id"), F.lit(""))).alias("result_id"), of("tool_result", F.coalesce(F.try_variant_get("ev", "$.is_error", "boolean"), F.lit(False))).alias("bad"), of("tool_result", text_at("ev", "$.output")).alias("output"), of("user", F.trim(text_at("ev", "$.text"))).alias("said"),
    )
    meta = F.when(F.col("type") == "session_meta", F.col("line_no"))
    file = Window.partitionBy("stem", "file")
    e = kept(e.withColumns({"session_id": F.coalesce(filled(F.min_by("id", meta).over(file)), F.col("stem")), "meta_model": F.min_by("named", meta).over(file)}), "harness-events", wide=True)
    bounds = e.groupBy("file", "stem").agg(F.first("session_id").alias("session_id"), F.min("ts").alias("first_ns"), F.max("ts").alias("last_ns"), F.lit(SOURCE).alias("surface"), *[F.min_by(c, meta).alias(c) for c in ("version", "git_branch", "cwd")], F.first("meta_model").alias("model"), F.lit(None).cast("string").alias("parent_session_id"), F.lit(0).alias("sidechain"), first_of(F.col("cli_session_id")).alias("cli_session_id")).where("first_ns is not null").drop("stem")

    # turns are numbered over all assistant events, with or without a time
    order = Window.partitionBy("session_id").orderBy("line_no")
    spoken = F.col("type") == "assistant"
    numbered = lambda rows: rows.withColumn("turn", span_id(SOURCE, F.col("session_id"), F.concat(F.lit("turn:"), (F.sum(spoken.cast("long")).over(order) - 1).cast("string"))))
    # where no turn carries usage, the run's totals go on the last one
    timed = spoken & F.col("ts").isNotNull()
    every = Window.partitionBy("session_id")
    total = F.sum(F.when(timed, sum((F.col(c) for c in USAGE), F.lit(0)))).over(every)
    last = F.col("line_no") == F.max(F.when(timed, F.col("line_no"))).over(every)
    turns = numbered(e.where(spoken | ((F.col("type") == "end") & F.col("input_tokens").isNotNull()))).withColumns({"bare": (total == 0) & last} | {f"end_{c}": F.min_by(c, F.when(~spoken, F.col("line_no"))).over(every) for c in USAGE}).where(timed)
    turns = turns.withColumns({c: F.when(F.col("bare"), F.coalesce(f"end_{c}", F.col(c))).otherwise(F.col(c)) for c in USAGE}).select("session_id", "line_no", F.col("turn").alias("span_id"), F.coalesce("model", "meta_model").alias("model"), (F.col("ts") - F.col("ms") * 1_000_000).alias("started_at_ns"), F.col("ts").alias("ended_at_ns"), F.col("ms").alias("duration_ms"), *USAGE, chars(F.col("items"), "thinking").alias("thinking_chars"), chars(F.col("items"), "text").alias("text_chars"))

    # a call without a result stays; the last result of an id counts
    a = numbered(e.where(spoken))
    uses = a.where("ts is not null").select("session_id", "line_no", "turn", "ts", F.posexplode("items").alias("pos", "b")).where("b.kind = 'tool_use'").withColumn("id", F.coalesce("b.id", F.lit("")))
    results = e.where("type = 'tool_result'").groupBy("session_id", F.col("result_id").alias("id")).agg(F.max_by(F.struct(F.col("ts").alias("r_ts"), F.col("ms").alias("r_ms"), F.col("bad").alias("r_error"), F.coalesce(F.length("output"), F.lit(0)).alias("r_chars")), "line_no").alias("r"))
    tool = span_id(SOURCE, F.col("session_id"), F.concat(F.lit("tool:"), F.col("id")))
    calls = uses.join(results, ["session_id", "id"], "left").select("session_id", "id", "line_no", "pos", tool.alias("span_id"), F.col("turn").alias("turn_span_id"), "b.name", F.col("b.input").alias("arguments"), F.col("ts").alias("started_at_ns"), F.coalesce("r.r_ts", "ts").alias("ended_at_ns"), F.coalesce("r.r_ms", F.lit(0)).alias("duration_ms"), F.coalesce("r.r_error", F.lit(False)).alias("is_error"), F.coalesce("r.r_chars", F.lit(0)).alias("result_chars"))

    def of_block(x):
        call = span_id(SOURCE, F.col("session_id"), F.concat(F.lit("tool:"), F.coalesce(x.id, F.lit(""))))
        return F.when(x.kind == "thinking", item("thinking", F.trim(x.thinking), F.col("turn"))).when(x.kind == "text", item("assistant_message", F.trim(x.text), F.col("turn"))).when(x.kind == "tool_use", item("tool_arguments", x.input, call))

    said = a.select("session_id", "line_no", F.col("ts").alias("ts_ns"), F.posexplode(F.transform("items", of_block)).alias("pos", "c")).select("session_id", "line_no", "pos", "ts_ns", "c.*")
    result_of = span_id(SOURCE, F.col("session_id"), F.concat(F.lit("tool:"), F.col("result_id")))
    other = e.where(F.col("type").isin("user", "tool_result")).select("session_id", "line_no", F.lit(0).alias("pos"), F.col("ts").alias("ts_ns"), F.when(F.col("type") == "user", "user_message").otherwise("tool_result").alias("kind"), F.coalesce("said", "output").alias("text"), F.when(F.col("type") == "tool_result", result_of).alias("span_id"))
    return Parts(bounds, turn_rows(turns), call_rows(calls, "id"), content_rows(said.unionByName(other)))
