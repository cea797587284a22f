"""Tracked findings and the periodic review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.columns import growth
from sessionlake.operators.experiments import baseline, compare, members, tagged
from sessionlake.operators.hooks import hook_events, hook_summary
from sessionlake.operators.insights import DEFAULT, Limits, insights


def merged(runs: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Findings from the append-only log of runs (run_ns and a finding's columns): first and last seen, occurrences, and the newest wording. state: what merged() gave for earlier runs."""
    own = [c for c in runs.columns if c not in ("run_ns", "kind", "fingerprint")]
    rows = runs.select("kind", "fingerprint", F.col("run_ns").alias("first_seen_ns"), F.col("run_ns").alias("last_seen_ns"), F.lit(1).cast("long").alias("occurrences"), *own)
    rows = rows if state is None else rows.unionByName(state)
    newest = [F.max_by(c, "last_seen_ns").alias(c) for c in own]
    return rows.groupBy("kind", "fingerprint").agg(F.min("first_seen_ns").alias("first_seen_ns"), F.max("last_seen_ns").alias("last_seen_ns"), F.sum("occurrences").alias("occurrences"), *newest)


def listed(findings: DataFrame, kind: str | None = None, since_ns: int | None = None, limit: int = 50) -> DataFrame:
    if kind is not None:
        findings = findings.where(F.col("kind") == kind)
    if since_ns is not None:
        findings = findings.where(F.col("last_seen_ns") >= since_ns)
    return findings.orderBy("severity", F.desc("metric"), "kind", "fingerprint").limit(limit)


def new_and_grown(current: DataFrame, known: DataFrame, least_growth: float = 0.25, severity_max: int = 2) -> DataFrame:
    """The findings that were not known, or whose metric grew by least_growth or more: kind, fingerprint, severity, metric, previous_metric, change, status."""
    prior = known.select("kind", "fingerprint", F.col("metric").alias("previous_metric"), F.lit(True).alias("seen"))
    both = current.where(F.col("severity") <= severity_max).join(prior, ["kind", "fingerprint"], "left").withColumn("change", growth(F.col("previous_metric"), F.col("metric")))
    status = F.when(F.col("seen").isNull(), "new").when(F.col("change") >= least_growth, "grown")
    return both.withColumn("status", status).where("status is not null").drop("seen")


def review(sessions: DataFrame, turns: DataFrame, calls: DataFrame, contents: DataFrame, prices: DataFrame, known: DataFrame, experiments: DataFrame, hook_results: DataFrame, now_ns: int, since_ns: int | None = None, source: str | None = None, severity_max: int = 2, least_growth: float = 0.25, baseline_days: int = 30, least_sessions: int = 10, limits: Limits = DEFAULT, markers: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """The parts of a review, each a DataFrame: findings (to be appended to the log after `known` was read), changes, comparison of the active experiments (directional if the weaker arm measured fewer than least_sessions), hooks and counts. Several parts come from the findings; `keep` may write these and the tables they come from once (see Lake.pinned)."""
    found = keep(insights(sessions, turns, calls, contents, prices, markers, since_ns, source, limits, keep))
    changes = new_and_grown(found, known, least_growth, severity_max)
    tags = tagged(sessions, experiments)
    # active experiments are few rows of a hand-written table
    arms = []
    for e in experiments.where(F.col("end_ns").isNull() | (F.col("end_ns") >= now_ns)).collect():
        for arm, rows in (("arm", members(tags, e["name"])), ("baseline", baseline(tags, e["name"], e["start_ns"], e["scope"], baseline_days))):
            arms.append(rows.withColumn("grp", F.lit(f"{e['name']}/{arm}")))
    parts = {"findings": found.withColumn("run_ns", F.lit(now_ns)), "changes": changes, "hooks": hook_summary(hook_events(hook_results, calls))}
    if arms:
        compared = [compare(a, turns, calls, contents, limits.idle_s) for a in arms]
        both = compared[0]
        for c in compared[1:]:
            both = both.unionByName(c)
        weakest = both.groupBy(F.split_part("grp", F.lit("/"), F.lit(1)).alias("name")).agg((F.min("measured") < least_sessions).alias("directional"))
        parts["experiments"] = both.withColumn("name", F.split_part("grp", F.lit("/"), F.lit(1))).join(weakest, "name")
    parts["counts"] = found.agg(F.count("*").alias("detected"), F.coalesce(F.sum((F.col("severity") <= severity_max).cast("long")), F.lit(0)).alias("considered"))
    return parts
