"""The lake: raw versions, session tables, ingest state and the log of findings, as Parquet folders."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions.columns import day_of
from sessionlake.functions.sql import register
from sessionlake.operators.maintain import expired, retention_report
from sessionlake.operators.review import merged
from sessionlake.operators.totals import session_sums, usage_sums
from sessionlake.sources.scan import checksum, counted

TABLES = ("turns", "tool_calls", "contents", "sessions")  # sessions last: children of a session that is half written stay unseen


class Lake:
    """Folders under a root that all executors can reach. Session tables are partitioned by source and by a bucket of the session, raw ones by source and by the UTC day of capture, so that retention drops days."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.work: list[str] = []

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, table: str) -> DataFrame | None:
        """The table, or None while it has no rows."""
        if not self.exists(table):
            return None
        try:
            return self.spark.read.option("mergeSchema", True).parquet(self.path(table))
        except AnalysisException as e:
            if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # a folder that was emptied
                return None
            raise

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("session_id"), F.lit(self.buckets)).cast("int").alias("bucket")

    # raw

    def capture(self, lines: DataFrame, source: str, now_ns: int, files: DataFrame | None = None) -> DataFrame:
        """Keeps the lines (file, session_id, line_no, value) of versions that are not there yet, before anything is parsed; returns the new versions. A version is known by source, session and the hash of its lines, so capturing twice adds nothing, and lines that were lost are captured again. Kept lines are looked at only on the days of versions that come again. files: counted() of the lines, where that is known."""
        files = counted(lines) if files is None else files
        made = files.groupBy("session_id").agg(checksum().alias("sha256"), F.sum("bytes").alias("size_bytes"))
        made = self.pinned(made.withColumn("source", F.lit(source)).withColumn("captured_at_ns", F.lit(now_ns).cast("long")).withColumn("day", day_of("captured_at_ns").cast("string")))
        key = ["source", "session_id", "sha256"]
        known = self.read("raw_versions")
        if known is not None:
            again = self.pinned(known.join(made.select(key), key, "left_semi").select(*key, F.col("day").cast("string").alias("day")))
            kept = None if again.isEmpty() else self.read("raw_lines")
            if kept is not None:
                whole = again.join(kept.select(*key, F.col("day").cast("string").alias("day")), [*key, "day"], "left_semi")
                made = self.pinned(made.join(whole, key, "left_anti"))  # what follows must not see itself
        rows = lines.select("session_id", "line_no", "value").join(made.select("session_id", "sha256", "source", "day"), "session_id")
        rows.write.mode("append").partitionBy("source", "day").parquet(self.path("raw_lines"))
        made.write.mode("append").partitionBy("source", "day").parquet(self.path("raw_versions"))
        return made

    def restore(self, source: str, session_id: str, sha256: str | None = None, index: int = -1) -> DataFrame:
        """The lines of a version, in order: the one named by its hash, else the index-th from the oldest (negative: from the newest). Raises LookupError where there is none, and ValueError where its lines no longer have its hash."""
        mine = (F.col("source") == source) & (F.col("session_id") == session_id)
        versions = self.read("raw_versions")
        found = [] if versions is None else versions.where(mine).orderBy("captured_at_ns", "sha256").select("sha256", F.col("day").cast("string").alias("day")).collect()
        found = [v for v in found if sha256 in (None, v.sha256)]
        if not -len(found) <= index < len(found):
            raise LookupError(f"no such version of {source} {session_id}")
        chosen, kept = found[index], self.read("raw_lines")
        if kept is not None:
            got = kept.where(mine & (F.col("sha256") == chosen.sha256) & (F.col("day") == F.lit(chosen.day))).dropDuplicates(["line_no"]).select("line_no", "value")
            sums = counted(got.withColumns({"file": F.lit(""), "session_id": F.lit(session_id)}))
            if sums.agg(checksum().alias("h")).first().h == chosen.sha256:
                return got.orderBy("line_no")
        raise ValueError(f"lines of version {chosen.sha256} are damaged")

    def delete_versions(self, gone: DataFrame) -> None:
        """Rewrites the days of these raw versions (source, session_id, sha256, day) without them."""
        gone = self.pinned(gone.select("source", "session_id", "sha256", "day"))
        for table in ("raw_versions", "raw_lines"):  # a version that is listed has its lines
            self.without(table, gone, ["source", "session_id", "sha256", "day"], "day")

    def retain(self, policies: DataFrame, now_ns: int, dry_run: bool = False) -> DataFrame:
        """Deletes raw versions and sessions that are older than their source's policy allows; returns what went, or would go, by tier and source."""
        versions, sessions = self.read("raw_versions"), self.read("sessions")
        raw = expired(versions, policies, "raw", now_ns, "captured_at_ns") if versions is not None else None
        done = expired(sessions, policies, "analyzed", now_ns, "ended_at_ns") if sessions is not None else None
        raw_schema, done_schema = "source string, size_bytes long, captured_at_ns long", "source string, ended_at_ns long"
        report = retention_report(sessions if sessions is not None else self.spark.createDataFrame([], done_schema), versions if versions is not None else self.spark.createDataFrame([], raw_schema), policies, now_ns)
        report = self.spark.createDataFrame(report.collect(), report.schema)  # a row for each tier and source
        if not dry_run:
            if raw is not None:
                self.delete_versions(raw)
            if done is not None:
                self.delete_sessions(done)
            self.tidy()
        return report

    # sessions

    def pinned(self, df: DataFrame) -> DataFrame:
        """df as it is now, in a folder of its own: the tables it came from are about to change."""
        path = f"{self.path('work')}/{uuid.uuid4().hex}"
        self.work.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def tidy(self) -> None:
        """Deletes what this object has pinned so far; frames that read it must not be used any more."""
        while self.work:
            self.remove(self.work.pop())

    def remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def collisions(self, sessions: DataFrame) -> DataFrame:
        """New sessions whose id another source already has."""
        have = self.read("sessions")
        if have is None:
            return sessions.limit(0)
        return sessions.join(have.select("session_id", F.col("source").alias("other")), "session_id").where(F.col("other") != F.col("source")).drop("other")

    def replace(self, new: dict[str, DataFrame]) -> None:
        """Puts the sessions of `new` in place of any rows these sessions had. Only the partitions they live in are rewritten, and doing it twice changes nothing. Sessions that collide are left out."""
        sessions = new["sessions"]
        if self.exists("sessions"):
            sessions = sessions.join(self.collisions(sessions).select("session_id"), "session_id", "left_anti")
        ids = self.pinned(sessions.select("session_id", "source", self.bucket()))
        touched = ids.select("source", "bucket").distinct()
        self.forget(touched)
        for table in TABLES:
            rows = sessions if table == "sessions" else new[table].join(ids.select("session_id", "source"), "session_id")
            rows = rows.withColumn("bucket", self.bucket())
            have = self.read(table)
            if have is not None:
                # what else lives in the touched partitions stays
                kept = have.join(F.broadcast(touched), ["source", "bucket"], "left_semi").join(ids.select("session_id"), "session_id", "left_anti")
                rows = rows.unionByName(kept, allowMissingColumns=True)
            self.overwrite(table, rows, touched if have is not None else None, "bucket")
        self.refresh(touched)

    # kept sums

    def refresh(self, touched: DataFrame) -> None:
        """Works out the kept sums of these buckets (source, bucket) again, from these buckets only."""
        buckets = {}
        for r in touched.select("source", "bucket").distinct().collect():  # at most one for each source and bucket
            buckets.setdefault(r.source, []).append(r.bucket)
        here = F.lit(False)
        for source, numbers in buckets.items():
            here = here | ((F.col("source") == source) & F.col("bucket").isin(numbers))
        sessions, turns = self.read("sessions"), self.read("turns")
        if not buckets:
            return
        for table, rows in (("session_sums", None if sessions is None else session_sums(sessions.where(here))), ("usage_sums", None if sessions is None or turns is None else usage_sums(turns.where(here), sessions.where(here)))):
            if rows is not None:
                self.overwrite(table, rows, touched if self.exists(table) else None, "bucket")
            elif self.exists(table):
                for source, numbers in buckets.items():
                    for b in numbers:
                        self.remove(f"{self.path(table)}/source={source}/bucket={b}")

    def sums(self, table: str) -> DataFrame | None:
        """session_sums or usage_sums; buckets whose sums a lost run left undone are worked out first."""
        sessions = self.read("sessions")
        if sessions is None:
            return None
        there = sessions.select("source", "bucket").distinct()
        kept = self.read("session_sums")
        missing = there if kept is None else there.join(kept.select("source", "bucket").distinct(), ["source", "bucket"], "left_anti")
        if not missing.isEmpty():
            self.refresh(self.pinned(missing))
        return self.read(table)

    def overwrite(self, table: str, rows: DataFrame, touched: DataFrame | None, part: str) -> None:
        """Puts the rows in place of the touched partitions (source and `part`); those that get no row vanish, as an overwrite would leave them."""
        gone = []
        if touched is not None:  # at most one for each source and bucket or day
            gone = touched.join(rows.select("source", part).distinct(), ["source", part], "left_anti").collect()
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", part).parquet(self.path(table))
        for r in gone:
            self.remove(f"{self.path(table)}/source={r.source}/{part}={r[part]}")

    def without(self, table: str, gone: DataFrame, keys: Sequence[str], part: str) -> None:
        """Rewrites the partitions of the rows in `gone` without rows of their keys."""
        have = self.read(table)
        if have is None:
            return
        touched = gone.select("source", part).distinct()
        self.overwrite(table, have.join(touched, ["source", part], "left_semi").join(gone.select(*keys), list(keys), "left_anti"), touched, part)

    def delete_sessions(self, ids: DataFrame) -> None:
        """Rewrites the partitions of these sessions (session_id, source) without them."""
        ids = self.pinned(ids.select("session_id", "source", self.bucket()))
        self.forget(ids.select("source", "bucket").distinct())
        for table in reversed(TABLES):
            self.without(table, ids, ["session_id"], "bucket")
        self.refresh(ids)

    def forget(self, touched: DataFrame) -> None:
        """Removes the kept sums of buckets that are about to change, so that a run that is lost meanwhile leaves none that are wrong."""
        for r in touched.collect():  # at most one for each source and bucket
            for table in ("session_sums", "usage_sums"):
                self.remove(f"{self.path(table)}/source={r.source}/bucket={r.bucket}")

    # ingest state and findings

    def observe(self, inventory: DataFrame, now_ns: int) -> DataFrame:
        """The state of all files after seeing the inventory (path, fingerprint, length, modified): new and changed files are pending with no attempts, others as they were."""
        state = self.state()
        seen = inventory.select("path", "fingerprint", "length", "modified")
        if state is None:
            return seen.select("*", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempts"), F.lit(now_ns).cast("long").alias("seen_ns"))
        both = seen.toDF("path", "now", "length_now", "modified_now").join(state, "path", "full")
        there = F.col("now").isNotNull()
        changed = there & (F.col("fingerprint").isNull() | (F.col("now") != F.col("fingerprint")))
        return both.select("path", F.coalesce("now", "fingerprint").alias("fingerprint"), F.coalesce("length_now", "length").alias("length"), F.coalesce("modified_now", "modified").alias("modified"), F.when(changed, "pending").otherwise(F.col("status")).alias("status"), F.when(changed, 0).otherwise(F.col("attempts")).cast("long").alias("attempts"), F.when(there, F.lit(now_ns)).otherwise(F.col("seen_ns")).cast("long").alias("seen_ns"))

    def state(self) -> DataFrame | None:
        """The stored state of all files. Where a run was lost while it replaced the state, the second folder is whole and takes its place."""
        if self.exists("ingest_state_next/_SUCCESS") and not self.exists("ingest_state/_SUCCESS"):
            self.spark.read.parquet(self.path("ingest_state_next")).write.mode("overwrite").parquet(self.path("ingest_state"))
        return self.read("ingest_state")

    def save_state(self, state: DataFrame) -> None:
        """Overwrites the state by way of a second folder, as the new state may read the old one; one of the two is whole at any time (see state)."""
        state.write.mode("overwrite").parquet(self.path("ingest_state_next"))
        self.spark.read.parquet(self.path("ingest_state_next")).write.mode("overwrite").parquet(self.path("ingest_state"))

    def log(self, rows: DataFrame, table: str, now_ns: int) -> DataFrame:
        """Keeps the rows of a pass and returns them as kept."""
        path = f"{self.path(table)}/pass={now_ns}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def log_findings(self, findings: DataFrame) -> None:
        """Puts one run's findings (with run_ns) into the log, in place of what the log has of that run. Snapshots that are not older than the run no longer hold, and go."""
        rows = self.pinned(findings.withColumn("run", F.col("run_ns")))
        first = rows.agg(F.min("run_ns")).first()[0]
        if first is None:
            return
        for upto in self.snapshots():
            if upto >= first:
                self.remove(f"{self.path('finding_state')}/upto={upto}")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(self.path("finding_runs"))

    def snapshots(self) -> list[int]:
        """The runs up to which whole snapshots of the findings exist."""
        if not self.exists("finding_state"):
            return []
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path('finding_state')}/upto=*/_SUCCESS")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p)
        return sorted(int(f.getPath().getParent().getName().removeprefix("upto=")) for f in found)

    def findings(self) -> DataFrame | None:
        """The current findings: the newest snapshot merged with the runs since; runs before it are not read."""
        runs, upto = self.read("finding_runs"), max(self.snapshots(), default=None)
        if upto is None:
            return None if runs is None else merged(runs.drop("run"))
        state = self.spark.read.parquet(f"{self.path('finding_state')}/upto={upto}")
        return state if runs is None else merged(runs.where(F.col("run") > upto).drop("run"), state)

    def compact_findings(self, delete_runs: bool = False) -> None:
        """A snapshot of the current findings, in place of older ones; the runs it holds may be deleted."""
        now, runs = self.findings(), self.read("finding_runs")
        newest = None if runs is None else runs.agg(F.max("run")).first()[0]
        old = self.snapshots()
        if now is None or newest is None or newest in old:
            return
        now.write.mode("overwrite").parquet(f"{self.path('finding_state')}/upto={newest}")
        for upto in old:
            self.remove(f"{self.path('finding_state')}/upto={upto}")
        if delete_runs:
            for r in runs.where(F.col("run") <= newest).select("run").distinct().toLocalIterator():
                self.remove(f"{self.path('finding_runs')}/run={r.run}")

    def views(self) -> None:
        """Temporary views of all tables and the column functions, for ad-hoc SQL."""
        for table in (*TABLES, "raw_versions", "finding_runs"):
            if (df := self.read(table)) is not None:
                df.createOrReplaceTempView(table)
        register(self.spark)

    def reads_only(self, text: str) -> bool:
        plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        if plan.getClass().getSimpleName().startswith(("Explain", "Show", "Describe")):
            return True
        command = self.spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
        nodes = [plan]
        while nodes:
            node = nodes.pop()
            if command.isInstance(node) or node.getClass().getSimpleName().startswith("Insert"):
                return False
            below = node.children()
            nodes += [below.apply(i) for i in range(below.size())]
        return True

    def sql(self, text: str, limit: int = 1000) -> DataFrame:
        """A read-only query over the views, of at most `limit` rows. The parsed statement decides: nothing in it may be a command or an insert, but for the ones that only tell about tables and plans."""
        if not self.reads_only(text):
            raise ValueError("only queries are allowed")
        self.views()
        return self.spark.sql(text).limit(limit)
