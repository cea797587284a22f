"""Sums that are kept by (source, bucket), so that overviews and costs need not scan all turns.

Each row of a kept table sums up the sessions, or the turns, of one bucket; a
pass works out again only the buckets it touched (see Lake.refresh). What is
asked of them is a sum of these sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.columns import day_of, ratio
from sessionlake.operators.cost import RATES, dollars
from sessionlake.operators.sessions import TOKENS

MEASURES = ("turn_count", "tool_call_count", *TOKENS)


def held(df: DataFrame, names: Sequence[str] = TOKENS) -> list[str]:
    """Those of the columns that df has: some sources count no reasoning tokens."""
    return [c for c in names if c in df.columns]


def session_sums(sessions: DataFrame) -> DataFrame:
    """Counts, sums and bounds of the sessions of each source, bucket, surface and pipeline version."""
    return sessions.groupBy("source", "bucket", "surface", "pipeline_version").agg(F.count("*").alias("sessions"), F.sum("is_subagent").cast("long").alias("subagents"), *(F.sum(c).cast("long").alias(c) for c in held(sessions, MEASURES)), F.min("started_at_ns").alias("first_ns"), F.max("ended_at_ns").alias("last_ns"))


def usage_sums(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Turns and tokens of each source, bucket, surface, project, model and UTC day of the turns that have a session."""
    of = sessions.select("session_id", "surface", "project")
    joined = turns.select("source", "bucket", "session_id", "model", day_of("started_at_ns").cast("string").alias("day"), *held(turns)).join(of, "session_id")
    return joined.groupBy("source", "bucket", "surface", "project", "model", "day").agg(F.count("*").alias("n"), *(F.sum(c).cast("long").alias(c) for c in held(turns)))


def overview(sums: DataFrame, pipeline_version: int | None = None) -> DataFrame:
    """As sessions.overview, from session_sums."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    stale = F.when(F.col("pipeline_version").isNull() | (F.col("pipeline_version") < F.lit(pipeline_version)), F.col("sessions")).otherwise(0)
    extra = [] if pipeline_version is None else [total(stale).alias("stale")]
    return sums.agg(total("sessions").alias("sessions"), total("subagents").alias("subagents"), total("turn_count").alias("turns"), total("tool_call_count").alias("tool_calls"), *(total(c).alias(c) for c in held(sums)), *extra, F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"))


def by_source(sums: DataFrame) -> DataFrame:
    """As sessions.by_source, from session_sums."""
    return sums.groupBy("source").agg(F.sum("sessions").cast("long").alias("sessions"), F.sum("turn_count").cast("long").alias("turns"), F.sum("tool_call_count").cast("long").alias("tool_calls"), F.sum("output_tokens").cast("long").alias("output_tokens"))


def cost(sums: DataFrame, prices: DataFrame, by: str = "model", as_model: str | None = None, source: str | None = None) -> DataFrame:
    """As cost.cost by model, day or project, from usage_sums."""
    rows = sums if source is None else sums.where(F.col("source") == source)
    return dollars(rows.groupBy(F.col(by).alias("grp"), "model").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in RATES)), prices, as_model)


def token_report(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Tokens in all, and by source, surface and model, in one scan of the turns: by (all, source, surface, model), key, turns, token sums and the share of input that came from the cache."""
    joined = turns.join(sessions.select("session_id", "source", "surface"), "session_id")
    cut = [F.col(c) for c in ("source", "surface", "model")]
    sums = joined.groupingSets([[], *([c] for c in cut)], *cut).agg(F.grouping_id().alias("set"), F.count("*").alias("turns"), *(F.sum(c).cast("long").alias(c) for c in held(turns)))
    # a bit of the number is set where the column is not part of the set
    name = F.when(F.col("set") == 7, "all").when(F.col("set") == 3, "source").when(F.col("set") == 5, "surface").otherwise("model")
    read, fresh, written = (F.col(c) for c in ("cache_read_tokens", "input_tokens", "cache_creation_tokens"))
    return sums.select(name.alias("by"), F.coalesce(*cut).alias("key"), "turns", *held(turns), ratio(read, read + fresh + written, 4).alias("cache_hit"))
