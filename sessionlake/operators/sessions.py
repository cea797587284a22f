"""Session, turn and tool-call questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.intervals import with_latest
from sessionlake.functions.columns import ratio, tool_kind, tool_vendor

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens")


def session_filter(sessions: DataFrame, source: str | None = None, surface: str | None = None, cwd: str | None = None, since_ns: int | None = None) -> DataFrame:
    """The filter that all lists share; cwd is a substring, whatever its case."""
    for name, value in (("source", source), ("surface", surface)):
        if value is not None:
            sessions = sessions.where(F.col(name) == value)
    if cwd is not None:
        sessions = sessions.where(F.lower("cwd").contains(cwd.lower()))
    return sessions if since_ns is None else sessions.where(F.col("started_at_ns") >= since_ns)


def roll_up(sessions: DataFrame, turns: DataFrame, calls: DataFrame) -> DataFrame:
    """Sessions with turn counts, tool-call counts and token sums."""
    t = turns.groupBy("session_id").agg(F.count("*").alias("turn_count"), *[F.sum(c).alias(c) for c in turns.columns if c in TOKENS])
    c = calls.groupBy("session_id").agg(F.count("*").alias("tool_call_count"))
    got = sessions.join(t, "session_id", "left").join(c, "session_id", "left")
    sums = ["turn_count", "tool_call_count", *(x for x in turns.columns if x in TOKENS)]
    return got.withColumns({x: F.coalesce(x, F.lit(0)).cast("long") for x in sums})


def overview(sessions: DataFrame, pipeline_version: int | None = None) -> DataFrame:
    """One row of totals over rolled-up sessions."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    extra = []
    if pipeline_version is not None:
        extra = [total(is_stale(pipeline_version).cast("int")).alias("stale")]
    return sessions.agg(F.count("*").alias("sessions"), total("is_subagent").alias("subagents"), total("turn_count").alias("turns"), total("tool_call_count").alias("tool_calls"), *[total(c).alias(c) for c in TOKENS if c in sessions.columns], *extra, F.min("started_at_ns").alias("first_ns"), F.max("ended_at_ns").alias("last_ns"))


def by_source(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("source").agg(F.count("*").alias("sessions"), F.sum("turn_count").cast("long").alias("turns"), F.sum("tool_call_count").cast("long").alias("tool_calls"), F.sum("output_tokens").cast("long").alias("output_tokens"))


def token_stats(turns: DataFrame, sessions: DataFrame, by: str = "source") -> DataFrame:
    """Token sums by source, surface, model or session_id, and the share of input that came from the cache."""
    joined = turns.join(sessions.select("session_id", *[c for c in ("source", "surface") if c in sessions.columns]), "session_id")
    sums = joined.groupBy(F.col(by).alias("key")).agg(F.count("*").alias("turns"), *[F.sum(c).cast("long").alias(c) for c in TOKENS if c in turns.columns])
    read, fresh, written = (F.col(c) for c in ("cache_read_tokens", "input_tokens", "cache_creation_tokens"))
    return sums.withColumn("cache_hit", ratio(read, read + fresh + written, 4))


def list_sessions(sessions: DataFrame, top_level: bool = True, limit: int = 50, **scope) -> DataFrame:
    """Newest sessions with their number of direct children."""
    children = sessions.where("parent_session_id is not null").groupBy(F.col("parent_session_id").alias("session_id")).agg(F.count("*").alias("children"))
    chosen = session_filter(sessions, **scope)
    if top_level:
        chosen = chosen.where("parent_session_id is null")
    return chosen.join(children, "session_id", "left").withColumn("children", F.coalesce("children", F.lit(0)).cast("long")).orderBy(F.desc("started_at_ns"), "session_id").limit(limit)


def session_detail(session_id: str, sessions: DataFrame, turns: DataFrame, calls: DataFrame) -> dict[str, DataFrame]:
    """A session's row, turns, calls, children and family totals."""
    mine = F.col("session_id") == session_id
    return {"session": sessions.where(mine), "turns": turns.where(mine).orderBy("started_at_ns", "span_id"), "tool_calls": calls.where(mine).orderBy("started_at_ns", "span_id"), "children": sessions.where(F.col("parent_session_id") == session_id), "family": family(sessions).where(F.col("root") == session_id)}


def family(sessions: DataFrame) -> DataFrame:
    """Totals of each session that has direct children, with them; one level."""
    sums = [c for c in ("turn_count", "tool_call_count", *TOKENS, "thinking_blocks", "thinking_chars", "active_ms") if c in sessions.columns]
    below = sessions.where("parent_session_id is not null").select(F.col("parent_session_id").alias("root"), *sums)
    own = sessions.join(below.select(F.col("root").alias("session_id")).distinct(), "session_id", "left_semi").select(F.col("session_id").alias("root"), *sums)
    return own.unionByName(below).groupBy("root").agg(F.count("*").alias("members"), *[F.sum(c).cast("long").alias(c) for c in sums])


def session_contents(contents: DataFrame, session_id: str, kinds: list[str] | None = None) -> DataFrame:
    rows = contents.where(F.col("session_id") == session_id)
    return (rows.where(F.col("kind").isin(*kinds)) if kinds else rows).orderBy("seq", "span_id")


def taxonomy(calls: DataFrame) -> DataFrame:
    """Calls with kind, vendor and estimated result tokens."""
    return calls.withColumns({"tool_kind": tool_kind(), "vendor": tool_vendor(), "result_tokens": F.expr("result_chars div 4")})


def tool_stats(calls: DataFrame) -> DataFrame:
    """Calls, errors, times and result sizes by tool."""
    return calls.groupBy("name").agg(F.count("*").alias("calls"), F.sum("is_error").cast("long").alias("errors"), F.sum("duration_ms").cast("long").alias("total_ms"), F.round(F.avg("duration_ms"), 2).alias("avg_ms"), F.max("duration_ms").cast("long").alias("max_ms"), F.sum("result_chars").cast("long").alias("total_chars"))


def repeated_calls(calls: DataFrame, limit: int | None = 25) -> DataFrame:
    """The groups of one session's calls of a tool with the same arguments, the most frequent first; without a limit all of them, in no order."""
    groups = calls.groupBy("session_id", "name", "args_hash").agg(F.count("*").alias("calls"), F.sum("duration_ms").cast("long").alias("total_ms"), F.min("args_preview").alias("args_preview"))
    groups = groups.where("calls > 1")
    return groups if limit is None else groups.orderBy(F.desc("calls"), F.desc("total_ms"), "session_id", "name", "args_hash").limit(limit)


def audit_repeats(calls: DataFrame, contents: DataFrame, limit: int | None = 200) -> DataFrame:
    """Repeated calls with the number of different result texts. Only the kept groups' results are read, and compared by hash."""
    top = repeated_calls(calls, limit)
    keys = ["session_id", "name", "args_hash"]
    kept = top.select(*keys)
    members = calls.select(*keys, "span_id").join(kept if limit is None else F.broadcast(kept), keys, "left_semi")
    results = contents.where("kind = 'tool_result'").select("span_id", F.sha2("text", 256).alias("h"))
    kinds = members.join(results, "span_id", "left").groupBy(*keys).agg(F.countDistinct("h").alias("distinct_results"), F.count("h").alias("results"))
    same = (F.col("distinct_results") == 1) & (F.col("results") == F.col("calls"))
    return top.join(kinds, keys, "left").withColumn("byte_identical", same.cast("int"))


def slowest(calls: DataFrame, limit: int = 10) -> DataFrame:
    return calls.orderBy(F.desc("duration_ms"), "span_id").limit(limit)


def largest(calls: DataFrame, limit: int = 10) -> DataFrame:
    return calls.orderBy(F.desc("result_chars"), "span_id").limit(limit)


def big_reads(calls: DataFrame, sessions: DataFrame, least_chars: int = 20_000, limit: int = 50) -> DataFrame:
    """Large results of Read calls that asked for no range."""
    whole = calls.where((F.col("name") == "Read") & (F.col("result_chars") >= least_chars) & ~F.col("args_preview").ilike('%"offset"%') & ~F.col("args_preview").ilike('%"limit"%'))
    return whole.join(sessions.select("session_id", "source", "project"), "session_id").orderBy(F.desc("result_chars"), "span_id").limit(limit)


def tool_arguments(contents: DataFrame, calls: DataFrame, sessions: DataFrame, names: list[str], like: str | None = None, source: str | None = None, since_ns: int | None = None) -> DataFrame:
    """Argument texts of some tools."""
    texts = contents.where("kind = 'tool_arguments'").select("span_id", "text")
    if like is not None:
        texts = texts.where(F.lower("text").contains(like.lower()))
    some = calls.where(F.col("name").isin(*names)).select("span_id", "session_id", "name")
    return texts.join(some, "span_id").join(session_filter(sessions, source=source, since_ns=since_ns).select("session_id", "source"), "session_id")


def with_gaps(turns: DataFrame) -> DataFrame:
    """Turns with `gap`, the milliseconds to the start of the session's next turn."""
    return turns.withColumn("gap", F.expr("(lead(started_at_ns) over (partition by session_id order by started_at_ns, span_id) - started_at_ns) div 1000000"))


def active_ms(idle_ms: int = 300_000) -> Column:
    """Of the turns of with_gaps(): the sum of their durations, or without any, of the gaps that are no longer than idle_ms."""
    spent, gap = F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("long"), F.col("gap")
    return F.when(spent > 0, spent).otherwise(F.coalesce(F.sum(F.when((gap > 0) & (gap <= idle_ms), gap)), F.lit(0)).cast("long"))


def active_time(turns: DataFrame, idle_ms: int = 300_000) -> DataFrame:
    """Active milliseconds of a session: its turns' durations, or without any, the gaps between turn starts that are no longer than idle_ms."""
    return with_gaps(turns).groupBy("session_id").agg(active_ms(idle_ms).alias("active_ms"))


def last_wins(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of the rows of a key, the last in order."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def turn_index(turns: DataFrame) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("started_at_ns", "span_id")
    return turns.withColumn("turn_index", (F.row_number().over(w) - 1).cast("long"))


def prompts(contents: DataFrame, turns: DataFrame, calls: DataFrame, cut: int = 300) -> DataFrame:
    """What each user prompt of a session led to: turns, calls and tokens from the prompt up to the next one, and the time to the end of its last turn. A prompt has a text that does not start with `<` and a time; of prompts with the same time, the first counts."""
    said = contents.where("kind = 'user_message' and ts_ns is not null and text <> '' and not startswith(text, '<')")
    first = last_wins(said, ["session_id", "ts_ns"], -F.col("seq"))
    w = Window.partitionBy("session_id").orderBy("ts_ns")
    spans = first.select("session_id", F.col("ts_ns").alias("from_ns"), F.row_number().over(w).alias("prompt"), F.substring("text", 1, cut).alias("text"))
    begins = spans.select("session_id", "prompt", "from_ns")
    led = lambda rows: with_latest(rows, "started_at_ns", begins, "from_ns", "session_id", "led").where("led is not null").withColumn("prompt", F.col("led.prompt"))
    sums = [c for c in (*TOKENS, "thinking_chars") if c in turns.columns]
    t = led(turns).groupBy("session_id", "prompt").agg(F.count("*").alias("turns"), F.max("ended_at_ns").alias("end_ns"), *[F.sum(c).cast("long").alias(c) for c in sums])
    c = led(calls).groupBy("session_id", "prompt").agg(F.count("*").alias("tool_calls"))
    got = spans.join(t, ["session_id", "prompt"], "left").join(c, ["session_id", "prompt"], "left")
    zero = {x: F.coalesce(x, F.lit(0)).cast("long") for x in ("turns", "tool_calls", *sums)}
    return got.withColumns(zero).withColumn("duration_ms", F.coalesce(F.expr("(end_ns - from_ns) div 1000000"), F.lit(0)).cast("long")).drop("end_ns")


def is_stale(version: int) -> Column:
    """Whether a session was written by an older pipeline, or by one that left no version."""
    return F.col("pipeline_version").isNull() | (F.col("pipeline_version") < version)


def stale_sessions(sessions: DataFrame, version: int) -> DataFrame:
    return sessions.where(is_stale(version))
