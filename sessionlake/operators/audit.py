"""Scripts that are written again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.functions.columns import imports, is_script, operations


def script_clusters(scripts: DataFrame, least_sessions: int = 3, limit: int = 30) -> DataFrame:
    """Inline scripts (session_id, span_id, text) by their imports and operations, where at least `least_sessions` sessions wrote them: sessions, the first ten session ids, and an example."""
    shaped = scripts.where(is_script()).select("session_id", "span_id", imports().alias("imports"), operations().alias("operations"), F.substring("text", 1, 300).alias("text")).where("imports <> ''")
    # one row for each session first, so no list of a cluster's sessions is ever gathered whole
    by_session = shaped.groupBy("imports", "operations", "session_id").agg(F.min_by("text", "span_id").alias("text"), F.min("span_id").alias("span_id"))
    counted = by_session.groupBy("imports", "operations").agg(F.count("*").alias("sessions"), F.min_by("text", F.struct("session_id", "span_id")).alias("example")).where(F.col("sessions") >= least_sessions)
    top = counted.orderBy(F.desc("sessions"), "imports", "operations").limit(limit)
    ranked = by_session.join(F.broadcast(top.select("imports", "operations")), ["imports", "operations"], "left_semi").selectExpr("imports", "operations", "session_id", "row_number() over (partition by imports, operations order by session_id) as n").where("n <= 10")
    ids = ranked.groupBy("imports", "operations").agg(F.sort_array(F.collect_list("session_id")).alias("session_ids"))
    return top.join(ids, ["imports", "operations"])
