"""Retention, raw versions and rebuilds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.functions.periods import duration_ns
from sessionlake.operators.sessions import is_stale

FOREVER = "forever"


def policy(spark: SparkSession, default: Mapping[str, str], overrides: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """(source, raw_ttl_ns, analyzed_ttl_ns), source null for the default; a null time is forever. `default` and each override have the keys raw and analyzed, as durations or `forever`; an override that lacks one takes the default's."""
    ns = lambda v: None if v in (None, FOREVER) else duration_ns(v)
    rows = [(None, ns(default.get("raw")), ns(default.get("analyzed")))]
    for source, o in (overrides or {}).items():
        both = dict(default) | dict(o)
        rows.append((source, ns(both.get("raw")), ns(both.get("analyzed"))))
    return spark.createDataFrame(rows, "source string, raw_ttl_ns long, analyzed_ttl_ns long")


def with_ttl(rows: DataFrame, policies: DataFrame, tier: str) -> DataFrame:
    """Rows with ttl_ns by their source, the default's for other sources; null is forever."""
    named = policies.where("source is not null").select("source", F.col(f"{tier}_ttl_ns").alias("own"), F.lit(True).alias("has_override"))
    default = policies.where("source is null").select(F.col(f"{tier}_ttl_ns").alias("default_ttl")).limit(1)
    got = rows.join(F.broadcast(named), "source", "left").crossJoin(F.broadcast(default))
    return got.withColumn("ttl_ns", F.when(F.col("has_override"), F.col("own")).otherwise(F.col("default_ttl"))).drop("own", "has_override", "default_ttl")


def expired(rows: DataFrame, policies: DataFrame, tier: str, now_ns: int, at: str) -> DataFrame:
    """Rows older than their source's time to live. Deleting is a rewrite of the touched partitions without them."""
    return with_ttl(rows, policies, tier).where(F.col(at) < F.lit(now_ns) - F.col("ttl_ns"))


def retention_report(sessions: DataFrame, versions: DataFrame, policies: DataFrame, now_ns: int) -> DataFrame:
    """What would go, by tier and source."""
    raw = expired(versions, policies, "raw", now_ns, "captured_at_ns").groupBy("source").agg(F.count("*").alias("deleted"), F.sum("size_bytes").cast("long").alias("freed_bytes"))
    done = expired(sessions, policies, "analyzed", now_ns, "ended_at_ns").groupBy("source").agg(F.count("*").alias("deleted"), F.lit(0).cast("long").alias("freed_bytes"))
    return raw.withColumn("tier", F.lit("raw")).unionByName(done.withColumn("tier", F.lit("analyzed")))


def raw_stats(versions: DataFrame) -> DataFrame:
    return versions.groupBy("source").agg(F.count("*").alias("versions"), F.countDistinct("session_id").alias("sessions"), F.sum("size_bytes").cast("long").alias("bytes"), F.min("captured_at_ns").alias("oldest_ns"), F.max("captured_at_ns").alias("newest_ns"))


def session_versions(versions: DataFrame, session_id: str, source: str | None = None) -> DataFrame:
    """Versions of a session, oldest first."""
    rows = versions.where(F.col("session_id") == session_id)
    return (rows if source is None else rows.where(F.col("source") == source)).orderBy("captured_at_ns", "sha256")


def latest_versions(versions: DataFrame) -> DataFrame:
    w = Window.partitionBy("source", "session_id").orderBy(F.desc("captured_at_ns"), F.desc("sha256"))
    return versions.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def decide(inventory: DataFrame, state: DataFrame, quiet_s: int = 5, max_attempts: int | None = None) -> DataFrame:
    """What to do with each file: path, action, attempts.

    vanished: known, but no longer there. active: changed within quiet_s. ingest: new, changed (attempts start again) or failed before, with attempts left where `max_attempts` is set. unchanged: everything else, also files that were empty.
    """
    both = inventory.select("path", "fingerprint", "age_s").join(state.select("path", F.col("fingerprint").alias("known"), "status", "attempts"), "path", "full")
    changed = F.col("known").isNull() | (F.col("known") != F.col("fingerprint"))
    retry = (F.col("status") == "failed") & (F.lit(True) if max_attempts is None else F.col("attempts") < max_attempts)
    action: Column = F.when(F.col("fingerprint").isNull(), "vanished").when(F.col("age_s") < quiet_s, "active").when(changed | retry | (F.col("status") == "pending"), "ingest").otherwise("unchanged")
    attempts = F.when(action == "ingest", F.when(changed, 0).otherwise(F.col("attempts")) + 1).otherwise(F.coalesce("attempts", F.lit(0)))
    return both.select("path", action.alias("action"), attempts.cast("long").alias("attempts"))


def summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("action").agg(F.count("*").alias("files"))


def rebuild_plan(sessions: DataFrame, inventory: DataFrame, versions: DataFrame, version: int) -> DataFrame:
    """Where each stale session's lines come from: its original file, else its newest raw version, else nowhere. Raw versions are known by the file's stem (raw_id), which some sources' session ids differ from; a session without a file by its id."""
    name = F.regexp_extract("file_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    stale = sessions.where(is_stale(version)).select("session_id", "source", "file_path", F.when(name != "", name).otherwise(F.col("session_id")).alias("raw_id"))
    there = inventory.select(F.col("path").alias("file_path"), F.lit(True).alias("on_disk"))
    raw = latest_versions(versions).select("source", F.col("session_id").alias("raw_id"), "sha256")
    got = stale.join(there, "file_path", "left").join(raw, ["source", "raw_id"], "left")
    return got.withColumn("origin", F.when(F.col("on_disk"), "from_original").when(F.col("sha256").isNotNull(), "from_archive").otherwise("missing_raw")).drop("on_disk")


def rebuild_report(planned: DataFrame, rebuilt: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Counts of the plan's origins, of sessions rebuilt, of those that yielded nothing and of those that failed."""
    ids = rebuilt.select("session_id").distinct().withColumn("ok", F.lit(True))
    bad = (planned.select("session_id").limit(0) if failed is None else failed.select("session_id").distinct()).withColumn("bad", F.lit(True))
    rows = planned.join(ids, "session_id", "left").join(bad, "session_id", "left")
    outcome = F.when(F.col("origin") == "missing_raw", "missing_raw").when(F.col("bad"), "failed").when(F.col("ok"), "rebuilt").otherwise("yielded_nothing")
    return rows.groupBy(outcome.alias("outcome"), "origin").agg(F.count("*").alias("sessions"))
