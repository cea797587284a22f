"""Detectors. Each gives findings: kind, fingerprint, severity, title, detail, metric, unit, action, evidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.operators.audit import script_clusters
from sessionlake.operators.cost import is_premium
from sessionlake.operators.navtime import nav_shares, nav_summary
from sessionlake.operators.search import padded
from sessionlake.operators.sessions import audit_repeats, session_filter


@dataclass(frozen=True)
class Limits:
    """Thresholds of the detectors."""

    script_sessions: int = 5
    wasted_calls: int = 5
    schema_errors: int = 10
    least_calls: int = 20
    error_rate: float = 0.10
    flood_chars: int = 200_000
    idle_s: int = 300
    churn_tokens: int = 5_000_000
    marathon_turns: int = 200
    grind_calls: int = 150
    index_calls: int = 30
    index_sessions: int = 3
    nav_sessions: int = 5
    nav_least_s: float = 300
    nav_share: float = 0.15
    premium_tokens: int = 1_000_000
    invisible: float = 0.75


DEFAULT = Limits()


def finding(rows: DataFrame, kind: str, fingerprint: Column, severity: Column | int, title: Column, detail: Column, metric: Column, unit: str, action: str, evidence: Column | None = None) -> DataFrame:
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    proof = F.lit(None).cast("string") if evidence is None else F.substring(F.to_json(evidence), 1, 4000)
    return rows.select(F.lit(kind).alias("kind"), fingerprint.cast("string").alias("fingerprint"), sev.cast("int").alias("severity"), title.alias("title"), detail.alias("detail"), F.round(metric.cast("double"), 2).alias("metric"), F.lit(unit).alias("unit"), F.lit(action).alias("action"), proof.alias("evidence"))


def s(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("?"))


def error_hotspots(calls: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    rows = calls.groupBy("name").agg(F.count("*").alias("calls"), F.sum("is_error").cast("long").alias("errors"))
    return rows.where((F.col("calls") >= limits.least_calls) & (F.col("errors") / F.col("calls") > limits.error_rate)).orderBy(F.desc("errors"), "name").limit(5)


def context_floods(calls: DataFrame, sessions: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    big = calls.where(F.col("result_chars") > limits.flood_chars).join(sessions.select("session_id", "source"), "session_id")
    return big.groupBy("name", "source").agg(F.count("*").alias("calls"), F.sum("result_chars").cast("long").alias("chars"), F.max("result_chars").cast("long").alias("worst")).orderBy(F.desc("chars"), "name", "source").limit(5)


def idle_gaps(turns: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """One row: gaps between a turn and the one before it that are longer than idle_s, and the cache tokens written after them."""
    w = Window.partitionBy("session_id").orderBy("started_at_ns", "span_id")
    gap = F.col("started_at_ns") - F.lag("ended_at_ns").over(w)
    return turns.withColumn("gap", gap).where(F.col("gap") > limits.idle_s * 10**9).agg(F.count("*").alias("gaps"), F.coalesce(F.sum("cache_creation_tokens"), F.lit(0)).cast("long").alias("rewrite_tokens"))


def marathons(sessions: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    return sessions.where((F.col("is_subagent") == 0) & (F.col("turn_count") > limits.marathon_turns)).orderBy(F.desc("cache_read_tokens"), "session_id").limit(3)


def premium_grind(sessions: DataFrame, prices: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Top-level sessions (with a model) of premium models and many tool calls."""
    busy = sessions.where((F.col("is_subagent") == 0) & (F.col("tool_call_count") > limits.grind_calls))
    return busy.join(F.broadcast(is_premium(busy, prices)), "model", "left_semi").orderBy(F.desc("tool_call_count"), "session_id").limit(3)


def repeat_waste(calls: DataFrame, contents: DataFrame, limits: Limits = DEFAULT, among: int | None = None) -> DataFrame:
    """Calls of each tool that repeated an earlier one with the same result, over all groups of repeats, or `among` so many of the most frequent."""
    same = audit_repeats(calls, contents, among).where("byte_identical = 1")
    per = same.groupBy("name").agg(F.sum(F.col("calls") - 1).cast("long").alias("wasted"), F.round(F.sum(F.col("total_ms") * (F.col("calls") - 1) / F.col("calls")), 2).alias("ms"), F.count("*").alias("groups"))
    return per.where(F.col("wasted") >= limits.wasted_calls).orderBy(F.desc("wasted"), "name")


def schema_loops(calls: DataFrame, sessions: DataFrame, contents: DataFrame, limits: Limits = DEFAULT, all_calls: DataFrame | None = None, all_sessions: DataFrame | None = None) -> DataFrame:
    """Projects with many failed structured outputs, and their newest error text. The sample comes from all sessions, whatever the scope."""
    failed = (F.col("name") == "StructuredOutput") & (F.col("is_error") == 1)
    errors = calls.where(failed).join(sessions.select("session_id", "project"), "session_id").groupBy("project").agg(F.count("*").alias("errors"), F.countDistinct("session_id").alias("sessions"), F.max("session_id").alias("example_session"))
    top = errors.where(F.col("errors") >= limits.schema_errors).orderBy(F.desc("errors"), "project").limit(5)
    # only sessions of the few projects that are reported give samples
    named = top.select(F.col("project").alias("kept"))
    homes = (all_sessions or sessions).select("session_id", F.col("project").alias("p")).join(named, F.col("p").eqNullSafe(F.col("kept")), "left_semi")
    where_from = (all_calls or calls).where(failed).select("span_id", "session_id").join(homes, "session_id")
    texts = contents.where("kind = 'tool_result'").select("span_id", "ts_ns", F.substring("text", 1, 200).alias("text")).join(where_from, "span_id")
    sample = texts.groupBy("p").agg(F.max_by("text", F.struct("ts_ns", "span_id")).alias("sample"))
    return top.join(sample, F.col("project").eqNullSafe(F.col("p")), "left").drop("p")


def thinking_volume(sessions: DataFrame, turns: DataFrame, contents: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: premium output tokens of top-level sessions, and the shares that are visible prose, tool arguments (of all top-level sessions, whatever their model) and neither."""
    top = sessions.where("is_subagent = 0").select("session_id")
    premium = turns.join(F.broadcast(is_premium(turns, prices)), "model", "left_semi").join(top, "session_id", "left_semi")
    out = premium.agg(F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("out_tokens"), F.coalesce(F.sum("text_chars"), F.lit(0)).cast("long").alias("text_chars"))
    args = contents.where("kind = 'tool_arguments'").join(top, "session_id", "left_semi").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("arg_chars"))
    four = F.col("out_tokens") * 4
    part = lambda c: F.when(four > 0, F.col(c) / four).otherwise(0.0)
    both = out.crossJoin(args)  # one row each
    return both.select("out_tokens", F.round(part("text_chars"), 4).alias("visible"), F.round(part("arg_chars"), 4).alias("arguments"), F.round(F.greatest(F.lit(0.0), 1 - part("text_chars") - part("arg_chars")), 4).alias("invisible"))


def index_ignored(sessions: DataFrame, contents: DataFrame, markers: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Busy sessions in places that have an index marker (cwd, marker), with whether any of their contents names one of all markers."""
    busy = sessions.where((F.col("tool_call_count") > limits.index_calls) & F.col("cwd").isNotNull())
    there = busy.join(markers.select("cwd").distinct(), "cwd", "left_semi").select("session_id", "project")
    # the names of indexes are a hand-written list: one row holds them, and each text meets it once
    names = markers.agg(F.collect_set(padded(F.col("marker"))).alias("names"))
    texts = contents.join(there.select("session_id"), "session_id", "left_semi").select("session_id", padded(F.col("text")).alias("text"))
    used = texts.crossJoin(names).where(F.exists("names", lambda m: F.contains("text", m))).select("session_id").distinct().withColumn("used", F.lit(1))
    return there.join(used, "session_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))


def insights(sessions: DataFrame, turns: DataFrame, calls: DataFrame, contents: DataFrame, prices: DataFrame, markers: DataFrame | None = None, since_ns: int | None = None, source: str | None = None, limits: Limits = DEFAULT, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The findings of all detectors, by severity and metric. Scope is set on the session's start, also for its turns and calls; sessions are rolled up (see roll_up).

    About ten detectors read the tables in scope. `keep` is given each of these once, and may write it and give it back as read again (see Lake.pinned); as it stands, each detector cuts them out for itself.
    """
    chosen = keep(session_filter(sessions, source=source, since_ns=since_ns))
    ids = chosen.select("session_id")
    t, c, x = (keep(df.join(ids, "session_id", "left_semi")) for df in (turns, calls, contents))
    fp = F.lit(source or "all")
    scripts = x.where("kind = 'tool_arguments'").join(c.where(F.col("name").isin("Bash", "exec_command")).select("span_id"), "span_id", "left_semi").select("session_id", "span_id", "text")
    found = [
        finding(script_clusters(scripts, limits.script_sessions, 5), "toolgap", F.concat_ws("|", "imports", "operations"), F.when(F.col("sessions") >= 30, 1).otherwise(2), F.concat(F.lit("One inline script shape in "), s("sessions"), F.lit(" sessions ("), F.col("imports"), F.lit(")")), F.concat(F.lit("Example: "), F.substring("example", 1, 200)), F.col("sessions"), "sessions", "Make it a tool and say where agents look for tools.", F.struct("session_ids")),
        finding(repeat_waste(c, x, limits), "repeat_waste", F.col("name"), 2, F.concat(F.col("name"), F.lit(": "), s("wasted"), F.lit(" calls repeated with identical results ("), s("groups"), F.lit(" groups)")), F.concat(F.lit("Minutes of tool time: "), F.round(F.col("ms") / 60000, 0).cast("long").cast("string")), F.col("wasted"), "wasted calls", "Fix the prompt or schema that asks again, or guard the tool."),
        finding(schema_loops(c, chosen, x, limits, calls, sessions), "schema_loop", s("project"), F.when(F.col("errors") >= 50, 1).otherwise(2), F.concat(F.lit("Structured output failed "), s("errors"), F.lit(" times in "), s("project"), F.lit(", "), s("sessions"), F.lit(" sessions")), F.concat(F.lit("Newest error: "), s("sample")), F.col("errors"), "failed calls", "Name the schema's required keys in the prompt."),
        finding(error_hotspots(c, limits), "error_hotspot", F.col("name"), 2, F.concat(F.col("name"), F.lit(" fails "), F.expr("errors * 100 div calls").cast("string"), F.lit("% of its calls")), F.concat(s("errors"), F.lit(" of "), s("calls")), F.col("errors"), "failed calls", "Look at the failing arguments; fix schema, description or environment."),
        finding(context_floods(c, chosen, limits), "context_flood", F.concat_ws(":", "source", "name"), F.when(F.col("chars") > 50_000_000, 1).otherwise(2), F.concat(F.col("name"), F.lit(" ("), s("source"), F.lit("): "), s("calls"), F.lit(" oversized results")), F.concat(F.lit("Largest: "), s("worst"), F.lit(" characters")), F.col("chars") / 1e6, "MB", "Bound what the command prints, or read ranges."),
        finding(idle_gaps(t, limits).where(F.col("rewrite_tokens") >= limits.churn_tokens), "idle_gap_churn", fp, F.when(F.col("rewrite_tokens") >= 50_000_000, 1).otherwise(2), F.concat(s("gaps"), F.lit(" idle gaps made the cache be written again")), F.concat(s("rewrite_tokens"), F.lit(" tokens")), F.col("rewrite_tokens") / 1e6, "M tokens", "End sessions when leaving; answer in batches."),
        finding(marathons(chosen, limits), "marathon_session", F.col("session_id"), 2, F.concat(F.lit("A session of "), s("turn_count"), F.lit(" turns in "), s("project")), F.concat(s("cache_read_tokens"), F.lit(" tokens read from the cache")), (F.col("cache_read_tokens") + F.col("input_tokens")) / 1e9, "B ctx tokens", "One task for each session."),
        finding(premium_grind(chosen, prices, limits), "premium_grind", F.col("session_id"), 3, F.concat(F.col("model"), F.lit(" ran "), s("tool_call_count"), F.lit(" tool calls")), F.concat(F.lit("Project: "), s("project")), F.col("tool_call_count"), "tool calls", "Leave mechanical work to a cheaper model."),
    ]
    if markers is not None:
        ignored = index_ignored(chosen, x, markers, limits).agg(F.count("*").alias("n"), F.sum(1 - F.col("used")).alias("ignored"), F.slice(F.sort_array(F.collect_set(F.when(F.col("used") == 0, s("project")))), 1, 5).alias("projects"))
        found.append(finding(ignored.where(F.col("ignored") >= limits.index_sessions), "index_ignored", fp, 3, F.concat(s("ignored"), F.lit(" of "), s("n"), F.lit(" busy sessions never looked at the index")), F.concat(F.lit("Projects: "), F.concat_ws(", ", "projects")), F.col("ignored"), "sessions", "Point the instructions at the index, or renew it."))
    shares = nav_shares(chosen, t, c, limits.idle_s)
    nav = nav_summary(shares, limits.nav_least_s).where((F.col("sessions") >= limits.nav_sessions) & (F.col("nav_share_median") >= limits.nav_share))
    found.append(finding(nav, "nav_share", fp, F.when(F.col("nav_share_median") >= 0.3, 2).otherwise(3), F.concat(F.lit("Navigation takes "), F.round(F.col("nav_share_median") * 100).cast("int").cast("string"), F.lit("% of active time")), F.concat(s("nav_hours"), F.lit(" of "), s("active_hours"), F.lit(" hours")), F.col("nav_share_median") * 100, "% of active time", "Give busy repositories an index.", F.struct("nav_share_mean", "nav_calls")))
    think = thinking_volume(chosen, t, x, prices).where((F.col("out_tokens") >= limits.premium_tokens) & (F.col("invisible") >= limits.invisible))
    found.append(finding(think, "thinking_volume", fp, F.when(F.col("invisible") >= 0.85, 2).otherwise(3), F.concat(F.round(F.col("invisible") * 100).cast("int").cast("string"), F.lit("% of premium output is thinking")), F.concat(F.lit("Prose "), s("visible"), F.lit(", arguments "), s("arguments")), F.col("invisible") * 100, "% of output tokens", "Lower the effort where judgement is not needed."))
    return reduce(DataFrame.unionByName, found).orderBy("severity", F.desc("metric"), "kind", "fingerprint")
