"""Attribution of active time to tool classes.

A cycle runs from one turn's start to the next one's. Its seconds go in equal
parts to the calls that start in it, or to generation if there are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.columns import navigation_bits, source_bit
from sessionlake.functions.medians import medians
from sessionlake.functions.places import kept


def nav_shares(sessions: DataFrame, turns: DataFrame, calls: DataFrame, idle_s: float = 300) -> DataFrame:
    """session_id, project, active_s, nav_s, nav_share, generation_s, nav_calls of top-level sessions with timed cycles; longer cycles than idle_s are the user's.

    Sessions, turns and calls meet in one sort by session and time, of short rows: a call brings one bit for each source that it is navigation in, a session says which bit counts. Running counts at two turns one after the other give the calls between them, so no second sort, join or table of cycles adds to a task's memory.
    """
    row = lambda at, kind, bits, project: (F.col("session_id"), at.cast("long").alias("at"), F.lit(kind).alias("kind"), bits.cast("int").alias("bits"), project.cast("string").alias("project"))
    none = F.lit(None)
    top = sessions.where("is_subagent = 0").select(*row(none, 0, source_bit(), F.col("project")))
    begun = turns.where("started_at_ns is not null").select(*row(F.col("started_at_ns"), 1, none, none))
    called = calls.where("started_at_ns is not null").select(*row(F.col("started_at_ns"), 2, navigation_bits(), none))
    # a session comes before its rows, a turn before the calls of its instant
    so_far = Window.partitionBy("session_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    of_top = lambda c: F.max(F.when(F.col("kind") == 0, F.col(c))).over(so_far)
    rows = top.union(begun).union(called).where("session_id is not null").withColumns({"bit": of_top("bits"), "project": of_top("project")}).where("bit is not null and kind > 0")
    is_call = F.col("kind") == 2
    counted = rows.withColumns({"k": F.count(F.when(is_call, 1)).over(so_far), "n": F.count(F.when(is_call & (F.getbit("bits", F.col("bit")) == 1), 1)).over(so_far)})
    before = Window.partitionBy("session_id").orderBy("at", "kind")
    since = lambda c: F.col(c) - F.lag(c).over(before)
    cycles = counted.where("kind = 1").select("session_id", "project", (since("at") / 1e9).alias("s"), since("k").alias("k"), since("n").alias("n")).where(F.col("s") <= idle_s)
    nav = F.when(F.col("k") > 0, F.col("s") * F.col("n") / F.col("k")).otherwise(0.0)
    gen = F.when(F.col("k") == 0, F.col("s")).otherwise(0.0)
    sums = cycles.groupBy("session_id").agg(F.max("project").alias("project"), F.sum("s").alias("active"), F.sum(nav).alias("nav"), F.sum(gen).alias("gen"), F.sum("n").alias("nav_calls")).where("active > 0")
    return sums.select("session_id", "project", F.round("active", 1).alias("active_s"), F.round("nav", 1).alias("nav_s"), F.round(F.col("nav") / F.col("active"), 4).alias("nav_share"), F.round("gen", 1).alias("generation_s"), "nav_calls")


def nav_summary(shares: DataFrame, least_s: float = 300) -> DataFrame:
    """One row: sessions, hours, and the exact median and mean share of the sessions with least_s active seconds. The shares are worked out once and kept in the shared folder."""
    rows = kept(shares.where(F.col("active_s") >= least_s).select("active_s", "nav_s", "nav_share", "nav_calls"), "nav-shares")
    sums = rows.agg(F.count("*").alias("sessions"), F.round(F.coalesce(F.sum("active_s"), F.lit(0.0)) / 3600, 1).alias("active_hours"), F.round(F.coalesce(F.sum("nav_s"), F.lit(0.0)) / 3600, 1).alias("nav_hours"), F.round(F.avg("nav_share"), 4).alias("nav_share_mean"), F.coalesce(F.sum("nav_calls"), F.lit(0)).cast("long").alias("nav_calls"))
    middle = medians(rows, [], "nav_share", "m").agg(F.round(F.max("m"), 4).alias("nav_share_median"))  # one row, also of none
    return sums.crossJoin(middle).select("sessions", "active_hours", "nav_hours", "nav_share_median", "nav_share_mean", "nav_calls")
