"""Incremental ingest, as repeatable batches or as an availableNow stream."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionlake.operators.maintain import decide, rebuild_plan, rebuild_report, summary
from sessionlake.sources import assemble
from sessionlake.sources.lake import Lake
from sessionlake.sources.scan import MAX_LINE, completeness, counted, events, existing, identity, inventory, lines, literal
from sessionlake.streaming.changes import FileChanges

#: What a pass reports of the lines of each file.
COUNTS = ("lines", "bytes", "blank", "malformed", "not_object")


def one_pass(spark: SparkSession, lake: Lake, source: str, roots: Sequence[str], quiet_s: int = 5, max_attempts: int | None = None, now_ns: int | None = None, dry_run: bool = False) -> DataFrame:
    """One pass over the roots: decides for each file, captures the raw lines of those to ingest, and replaces their sessions. Returns path, action, attempts, outcome (ingested, empty, failed or null) and what the scan found in each file read (see counted; long_bytes: bytes of over-long lines, left out).

    Change detection comes from the stored state, so a file that was rewritten is read again as a whole, which a file stream would not do. Only files of another length or time than the state knows are hashed, only those to ingest are read, and files still being written are not opened. A file that vanishes or can't be read between listing and reading is `failed`, as is one whose session id another source has; the others are ingested, and it is tried again. A pass may be repeated at any time: ids are deterministic and sessions are replaced.
    """
    return taken(spark, lake, source, inventory(spark, roots), lake.state(), quiet_s, max_attempts, now_ns or time.time_ns(), dry_run)


def taken(spark: SparkSession, lake: Lake, source: str, files: DataFrame, state: DataFrame | None, quiet_s: int, max_attempts: int | None, now_ns: int, dry_run: bool = False) -> DataFrame:
    """The pass over these files (path, length, modified) against this part of the stored state; files that only the state has are vanished."""
    files = files.withColumn("age_s", (F.lit(now_ns) - F.unix_micros("modified") * 1000) / 1e9)
    quiet = F.col("age_s") >= quiet_s
    known = lake.pinned(identity(spark, files.where(quiet), state).unionByName(files.where(~quiet).withColumn("fingerprint", F.lit("unread"))))
    nothing = {n: F.lit(None).cast("long") for n in (*COUNTS, "long_bytes")}
    decided = lake.log(decide(known, state if state is not None else lake.observe(known, now_ns).limit(0), quiet_s, max_attempts), "ingest_log", now_ns)
    paths = [literal(r.path) for r in decided.where("action = 'ingest'").select("path").toLocalIterator()]
    if dry_run or not paths:
        lake.tidy()
        return decided.withColumns({"outcome": F.lit(None).cast("string"), **nothing})
    rows = lines(spark, paths) if existing(spark, paths[:1]) or existing(spark, paths) else None
    if rows is None:  # all of them went
        rows = spark.createDataFrame([], "file string, session_id string, line_no long, value string")
    found = lake.pinned(counted(rows))
    # a file that gave fewer bytes than it has failed: what came of it is left out
    seen = known.select("path", "length").join(found.withColumnRenamed("file", "path"), "path", "left").withColumn("state", completeness())
    seen = lake.pinned(seen.withColumn("long_bytes", F.when(F.col("length") - F.col("bytes") > MAX_LINE, F.col("length") - F.col("bytes")).otherwise(F.when(F.col("lines") > 0, 0)).cast("long")))
    whole = seen.where("state = 'whole'").select(F.col("path").alias("file"))
    good = rows.join(whole, "file", "left_semi")
    lake.capture(good, source, now_ns, found.join(whole, "file", "left_semi"))
    made = assemble.tables(source, events(good), now_ns)
    # a session whose id another source has is left out; its file failed and is tried again
    collided = lake.collisions(made["sessions"]).select(F.col("file_path").alias("path"))
    rejected = lake.pinned(collided.unionByName(seen.where("state <> 'whole'").select("path")).distinct().withColumn("rejected", F.lit(True)))
    lake.replace(made)
    have = lake.read("sessions")
    ingested = made["sessions"] if have is None else have.where(F.col("ingested_at_ns") == now_ns)
    ingested = ingested.select(F.col("file_path").alias("path")).distinct().withColumn("made", F.lit(True))
    outcome = F.when(F.col("rejected"), "failed").when(F.col("made"), "ingested").otherwise("empty")
    done = decided.join(ingested, "path", "left").join(rejected, "path", "left").withColumn("outcome", F.when(F.col("action") == "ingest", outcome)).drop("made", "rejected")
    done = lake.log(done.join(seen.select("path", *nothing), "path", "left"), "ingest_outcomes", now_ns)
    outcomes = done.where("outcome is not null").select("path", F.col("outcome").alias("o"), F.col("attempts").alias("a"))
    after = lake.observe(known.where(quiet), now_ns).join(outcomes, "path", "left")
    lake.save_state(after.select("path", "fingerprint", "length", "modified", F.coalesce("o", "status").alias("status"), F.coalesce("a", "attempts").alias("attempts"), "seen_ns"))
    lake.tidy()
    return done


def rebuild(spark: SparkSession, lake: Lake, source: str, roots: Sequence[str], version: int = assemble.PIPELINE_VERSION, now_ns: int | None = None, dry_run: bool = False) -> DataFrame:
    """Normalises the stale sessions of a source again, from their files where these are still under the roots, else from their newest raw version, and replaces them. Returns outcome, origin and the number of sessions. Sessions whose lines no longer give one stay as they were (yielded_nothing), as do those without lines (missing_raw); a dry run gives the planned origins with a null outcome."""
    have, versions = lake.read("sessions"), lake.read("raw_versions")
    if have is None:
        return spark.createDataFrame([], "outcome string, origin string, sessions long")
    if versions is None:
        versions = spark.createDataFrame([], "source string, session_id string, sha256 string, captured_at_ns long, day date")
    plan = lake.pinned(rebuild_plan(have.where(F.col("source") == source), inventory(spark, roots), versions, version))
    if dry_run:
        return plan.groupBy(F.lit(None).cast("string").alias("outcome"), "origin").agg(F.count("*").alias("sessions"))
    rows = None
    paths = [literal(r.file_path) for r in plan.where("origin = 'from_original'").select("file_path").distinct().toLocalIterator()]
    if paths:
        rows = lines(spark, paths)
        lake.capture(rows, source, now_ns or time.time_ns())
    kept = lake.read("raw_lines")
    if kept is not None:
        chosen = plan.where("origin = 'from_archive'").select("raw_id", "sha256", F.coalesce("file_path", "raw_id").alias("file")).distinct()
        mine = kept.where(F.col("source") == source).select(F.col("session_id").alias("raw_id"), "sha256", "line_no", "value").dropDuplicates(["raw_id", "sha256", "line_no"])
        old = mine.join(chosen, ["raw_id", "sha256"]).select("file", F.col("raw_id").alias("session_id"), "line_no", "value")
        rows = old if rows is None else rows.unionByName(old)
    made = None if rows is None else assemble.tables(source, events(lake.pinned(rows)), now_ns)
    if made is None:
        done = rebuild_report(plan, plan.limit(0))
    else:
        stale = lake.pinned(made["sessions"].join(plan.select("session_id"), "session_id", "left_semi"))
        lake.replace({**made, "sessions": stale})
        done = rebuild_report(plan, stale)
    done = spark.createDataFrame(done.collect(), done.schema)  # a row for each outcome and origin
    lake.tidy()
    return done


def passes(spark: SparkSession, lake: Lake, source: str, roots: Sequence[str], every_s: float, times: int, policies: DataFrame | None = None, **options) -> list[DataFrame]:
    """Repeated passes, each with its summary. Where policies are given, what they let expire is deleted after each pass, or none of it in a dry run."""
    out = []
    for k in range(times):
        if k:
            time.sleep(every_s)
        out.append(summary(one_pass(spark, lake, source, roots, **options)))
        if policies is not None:
            lake.retain(policies, options.get("now_ns") or time.time_ns(), options.get("dry_run", False))
    return out


def stream(spark: SparkSession, lake: Lake, source: str, roots: Sequence[str] | str, checkpoint: str, quiet_s: int = 0, max_attempts: int | None = None, on_pass: Callable[[DataFrame], None] | None = None, fold_after: int = 10) -> StreamingQuery:
    """An availableNow stream over the roots: it takes what changed since its checkpoint (new, grown, rewritten and vanished files, see FileChanges) and leaves the tables and the state as one_pass would. A micro-batch that is repeated after a failure changes nothing. on_pass gets the report of each batch."""
    spark.dataSource.register(FileChanges)
    source_of = spark.readStream.format("file_changes").option("roots", json.dumps([roots] if isinstance(roots, str) else list(roots))).option("log", f"{checkpoint.rstrip('/')}/inventory")
    changes = source_of.option("quiet_s", quiet_s).option("fold_after", fold_after).load()

    def write(batch: DataFrame, _: int) -> None:
        rows = lake.pinned(batch)
        if rows.isEmpty():
            lake.tidy()
            return
        there = rows.where("change <> 'vanished'").select("path", "length", F.timestamp_millis(F.expr("modified_ns div 1000000")).alias("modified"))
        state = lake.state()
        part = None if state is None else state.join(rows.select("path"), "path", "left_semi")
        report = taken(spark, lake, source, there, part, 0, max_attempts, time.time_ns())
        if on_pass:
            on_pass(report)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
