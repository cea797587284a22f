"""What the source adapters share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.columns import is_string, result_text, short_hash, span_id
from sessionlake.sources.scan import text_at

MAX_ARGUMENTS = 60_000
MAX_TEXT = 50_000_000


@dataclass
class Parts:
    """What an adapter makes of the events of one source."""

    bounds: DataFrame  # one row for each session: session_id, file, first_ns, last_ns, surface, version, git_branch, cwd, model, parent_session_id
    turns: DataFrame
    tool_calls: DataFrame | Callable[[], DataFrame]  # a function, where finding the calls' turns is a step of its own
    contents: DataFrame
    times: DataFrame | None = None  # session_id, started_at_ns and ended_at_ns of the calls, where tool_calls is a function

    def calls(self) -> DataFrame:
        return self.tool_calls() if callable(self.tool_calls) else self.tool_calls


def blocks(v: Column) -> Column:
    """The blocks of a content list; an empty array for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def block_items(v: Column) -> Column:
    """What calls, results and texts need of the blocks of a content list, each value read once: kind, id, result_id, name, input (JSON), bad, result, text, thinking and, of a block that is a string, plain."""

    def of(b: Column) -> Column:
        kind = F.try_variant_get(b, "$.type", "string")
        use, result = kind == "tool_use", kind == "tool_result"
        return F.struct(
            kind.alias("kind"), F.when(use, text_at(b, "$.id")).alias("id"), F.when(result, text_at(b, "$.tool_use_id")).alias("result_id"), F.when(use, F.coalesce(text_at(b, "$.name"), F.lit("?"))).alias("name"), F.when(use, json_of(b, "$.input")).alias("input"),
            F.when(result, F.coalesce(F.try_variant_get(b, "$.is_error", "boolean"), F.lit(False))).alias("bad"), F.when(result, result_text(F.try_variant_get(b, "$.content", "variant"))).alias("result"),
            F.when(kind == "text", F.coalesce(text_at(b, "$.text"), F.lit(""))).alias("text"), F.when(kind == "thinking", F.coalesce(text_at(b, "$.thinking"), F.lit(""))).alias("thinking"), F.when(kind.isNull() & is_string(b), F.try_variant_get(b, "$", "string")).alias("plain"),
        )

    return F.transform(blocks(v), of)


def chars(items: Column, kind: str) -> Column:
    """Characters of the blocks of one type, of block_items()."""
    return F.aggregate(F.transform(items, lambda b: F.coalesce(F.length(b[kind]), F.lit(0))), F.lit(0), lambda a, x: a + x).cast("long")


def json_of(v: Column, path: str) -> Column:
    """JSON with sorted keys of what is at a path; {} for nothing."""
    return F.coalesce(F.to_json(F.try_variant_get(v, path, "variant")), F.lit("{}"))


def last_line(rows: DataFrame, by: str = "span_id") -> DataFrame:
    """Of the rows of a span, that of the last line; `by` may be another column that tells the spans of a session apart, one by which the rows lie together already."""
    order = [F.desc("line_no"), F.desc("pos")] if "pos" in rows.columns else [F.desc("line_no")]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("session_id", by).orderBy(*order))).where("__n = 1").drop("__n")


def turn_rows(rows: DataFrame) -> DataFrame:
    """Fixed columns of a turn; where no duration is given, it is the time between start and end."""
    have = set(rows.columns)
    zero = [c for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens", "thinking_chars", "text_chars") if c not in have]
    rows = last_line(rows).withColumns({c: F.lit(0).cast("long") for c in zero})
    spent = F.expr("(ended_at_ns - started_at_ns) div 1000000")
    rows = rows.withColumn("duration_ms", F.coalesce(F.nullif(F.col("duration_ms"), F.lit(0)), F.greatest(spent, F.lit(0))) if "duration_ms" in have else F.greatest(spent, F.lit(0)))
    w = Window.partitionBy("session_id").orderBy("started_at_ns", "span_id")
    return rows.withColumn("turn_index", F.row_number().over(w) - 1).select("session_id", "span_id", "turn_index", "model", "started_at_ns", "ended_at_ns", F.col("duration_ms").cast("long").alias("duration_ms"), "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens", "thinking_chars", "text_chars")


def call_rows(rows: DataFrame, by: str = "span_id") -> DataFrame:
    """Fixed columns of a tool call; `arguments` is the whole text. For `by` see last_line."""
    args = F.substring("arguments", 1, MAX_ARGUMENTS)
    return last_line(rows, by).select("session_id", "span_id", "turn_span_id", "name", short_hash(args).alias("args_hash"), F.substring(args, 1, 500).alias("args_preview"), "started_at_ns", "ended_at_ns", F.col("duration_ms").cast("long").alias("duration_ms"), F.col("is_error").cast("int").alias("is_error"), F.col("result_chars").cast("long").alias("result_chars"))


def content_rows(rows: DataFrame, most: int = MAX_TEXT) -> DataFrame:
    """Rows (session_id, line_no, pos, span_id, kind, text, ts_ns) with a running seq; empty texts go, oversized ones end in a note."""
    w = Window.partitionBy("session_id").orderBy("line_no", "pos")
    note = F.concat(F.substring("text", 1, most), F.lit("\n[cut: "), (F.length("text") - most).cast("string"), F.lit(" more characters]"))
    kept = rows.where(F.coalesce(F.col("text"), F.lit("")) != "")
    return kept.select("session_id", "span_id", "kind", (F.row_number().over(w) - 1).alias("seq"), "ts_ns", F.when(F.length("text") > most, note).otherwise(F.col("text")).alias("text"))


def item(kind: Column | str, text: Column, span: Column | None = None) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text.alias("text"), (F.lit(None).cast("string") if span is None else span).alias("span_id"))


__all__ = ["Parts", "block_items", "blocks", "call_rows", "chars", "content_rows", "item", "json_of", "last_line", "result_text", "span_id", "turn_rows"]
