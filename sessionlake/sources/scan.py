"""Reading transcripts: files, lines, events."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from sessionlake.functions.columns import is_string

#: Longer lines vanish at the reader; lines next to them stay.
MAX_LINE = 64 << 20

#: The fingerprint of a file that was listed and could not be read.
UNREADABLE = "unreadable"


def plain(path: Column) -> Column:
    """A file's path as people write it: the readers' metadata give it with escapes like %20."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def literal(path: str) -> str:
    """A path for the readers that means this one file, whatever pattern signs it holds."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of the paths (patterns too) that name something."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if len(path(p).getFileSystem(conf).globStatus(path(p)) or [])]


def loaded(spark: SparkSession, reader: DataFrameReader, kind: str, paths: Sequence[str]) -> DataFrame:
    """What a reader of files gives, without those that went since they were listed, or that can't be read."""
    reader = reader.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    try:
        return reader.format(kind).load(list(paths))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND" or not (left := existing(spark, paths)):
            raise
        return reader.format(kind).load(left)


def inventory(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """path, length and modified (timestamp) of all *.jsonl under the roots, each once. File contents are not read. Files of no bytes count as absent, as the reader leaves them out."""
    files = loaded(spark, spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl"), "binaryFile", roots)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).distinct()


def lines(spark: SparkSession, paths: Sequence[str], max_line: int = MAX_LINE) -> DataFrame:
    """file, session_id (the file's stem), line_no (from 0, by place in the file) and value of all lines under the paths. Files that went since they were listed, or that can't be read, give none."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("mapreduce.input.linerecordreader.line.maxlength", max_line)
    raw = loaded(spark, reader, "text", paths)
    raw = raw.select("value", plain(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    return numbered(raw).withColumn("session_id", stem("file")).select("file", "session_id", "line_no", "value")


def numbered(raw: DataFrame) -> DataFrame:
    """Line numbers: the lines of the blocks before, added up over the blocks of a file, and the place in the block. No task holds more lines of a file than a block has."""
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("file", "at").agg(F.count("*").alias("n")).select("file", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("file", "at").orderBy("id")) - 1
    return raw.withColumn("line_no", inside).join(blocks.toDF("file", "at", "first"), ["file", "at"]).withColumn("line_no", F.col("first") + F.col("line_no")).drop("first")


def counted(rows: DataFrame) -> DataFrame:
    """What each file of the lines holds, in one scan: lines, bytes (a line end each), blank lines, malformed ones, ones that hold other JSON than an object, and the two sums that make up a version's hash (see checksum)."""
    blank = F.trim("value") == ""
    ev = F.try_parse_json("value")
    malformed = ~blank & ev.isNull()
    other = ~blank & ev.isNotNull() & ~F.schema_of_variant(ev).startswith("OBJECT")
    many = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return rows.groupBy("file", "session_id").agg(F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).cast("long").alias("bytes"), many(blank).alias("blank"), many(malformed).alias("malformed"), many(other).alias("not_object"), *(F.sum(F.xxhash64(*seed, "line_no", "value").cast("decimal(38,0)")).alias(n) for n, seed in (("sum_a", []), ("sum_b", [F.lit(1)]))))


def checksum() -> Column:
    """The hash of a version's lines, by number and value, from the sums of counted()."""
    return F.sha2(F.concat(F.sum("lines").cast("string"), F.lit(":"), F.sum("sum_a").cast("decimal(38,0)").cast("string"), F.lit(":"), F.sum("sum_b").cast("decimal(38,0)").cast("string")), 256)


def completeness(max_line: int = MAX_LINE) -> Column:
    """What became of a file of `length` bytes that gave `lines` lines of `bytes` bytes, line ends included: `unread` where it gave none, `partial` where bytes are missing that no over-long line, two-byte line ends or byte order mark explain, else `whole`. Over-long lines vanish at the reader."""
    missing = F.col("length") - F.col("bytes")
    return F.when(F.coalesce("lines", F.lit(0)) == 0, "unread").when((missing > F.col("lines") + 4) & (missing <= max_line), "partial").otherwise("whole")


def stem(path: str) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def events(rows: DataFrame) -> DataFrame:
    """Lines that hold a JSON object, as a variant `ev`; blank and malformed ones and other values are dropped."""
    # JSON is an object if it starts like one; as a generator's output a line is parsed once, not again by a filter
    objects = rows.where(F.startswith(F.ltrim("value", F.lit(" \t\r\n")), F.lit("{")))
    return objects.select(*[c for c in rows.columns if c != "value"], F.explode(F.array_compact(F.array(F.try_parse_json("value")))).alias("ev"))


def text_at(v: Column | str, path: str) -> Column:
    """The string at a path, null if it is none."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(is_string(x), F.try_variant_get(v, path, "string"))


def filled(c: Column) -> Column:
    return F.when(c != "", c)


def long_at(v: Column | str, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "long"), F.lit(0))


def first_of(c: Column) -> Column:
    """The first non-empty value of a file's lines."""
    return F.min_by(filled(c), F.when(filled(c).isNotNull(), F.col("line_no")))


#: Where discovery finds each field, by source.
FIELDS: dict[str, dict[str, str]] = {
    "claude-code": {"cwd": "$.cwd", "version": "$.version", "git_branch": "$.gitBranch", "entrypoint": "$.entrypoint", "permission_mode": "$.permissionMode", "user_type": "$.userType", "prompt_id": "$.promptId", "agent_id": "$.agentId", "slug": "$.slug"},
    "codex": {"cwd": "$.payload.cwd", "version": "$.payload.cli_version", "originator": "$.payload.originator", "model_provider": "$.payload.model_provider", "surface": "$.payload.source", "parent_session_id": "$.payload.source.subagent.thread_spawn.parent_thread_id", "model": "$.payload.model", "effort": "$.payload.effort"},
    "harness": {"cwd": "$.cwd", "version": "$.harness_version", "backend": "$.backend", "model": "$.model", "effort": "$.effort", "cli_session_id": "$.cli_session_id"},
}


def probe(evs: DataFrame, source: str, head: int = 200) -> DataFrame:
    """Metadata of each file from its first `head` lines; the parent session comes from the path where that names it."""
    top = evs.where(F.col("line_no") < head)
    got = top.groupBy("file", "session_id").agg(*[first_of(text_at("ev", p)).alias(n) for n, p in FIELDS[source].items()], F.max(F.coalesce(F.try_variant_get("ev", "$.isSidechain", "boolean"), F.lit(False)).cast("int")).alias("is_sidechain"))
    from_path = filled(F.regexp_extract("file", r"/([^/]+)/subagents/", 1))
    return got.withColumn("parent_session_id", F.coalesce(F.col("parent_session_id"), from_path) if "parent_session_id" in got.columns else from_path)


def fingerprints(spark: SparkSession, paths: Sequence[str], largest_binary: int = 1 << 30) -> DataFrame:
    """path and fingerprint of these files. Those that a binary column can hold are known by sha256 and size; larger ones by a sum of line hashes, under a prefix of its own, as no row could hold them."""
    if not paths:
        return spark.createDataFrame([], "path string, fingerprint string")
    files = loaded(spark, spark.read, "binaryFile", [literal(p) for p in paths])
    small = files.where(F.col("length") <= largest_binary).select("path", F.concat_ws(":", F.lit("sha256"), F.sha2("content", 256), F.lit("size"), F.col("length").cast("string")).alias("fingerprint"))
    large = files.where(F.col("length") > largest_binary).select("path", "length")
    long_ones = [literal(r.path) for r in large.select("path").toLocalIterator()]
    if not long_ones:
        return small
    sums = lines(spark, long_ones).groupBy(F.col("file").alias("path")).agg(F.sum(F.xxhash64("line_no", "value").cast("decimal(38,0)")).alias("h"))
    large = large.join(sums, "path", "left").select("path", F.concat_ws(":", F.lit("lines"), F.col("h").cast("string"), F.lit("size"), F.col("length").cast("string")).alias("fingerprint"))
    return small.unionByName(large)


def identity(spark: SparkSession, files: DataFrame, state: DataFrame | None, largest_binary: int = 1 << 30) -> DataFrame:
    """The files (path, length, modified and more columns) with their fingerprint, `unreadable` for those that gave none. Only files whose length or time the state does not know are read; the others keep the fingerprint it has. The paths of those to read pass through the driver, where the reader lists them anyway."""
    if state is None:
        known = files.withColumn("kept", F.lit(None).cast("string"))
    else:
        known = files.join(state.select("path", "length", "modified", F.nullif("fingerprint", F.lit(UNREADABLE)).alias("kept")), ["path", "length", "modified"], "left")
    paths = [r.path for r in known.where("kept is null").select("path").toLocalIterator()]
    got = known.join(fingerprints(spark, paths, largest_binary), "path", "left")
    return got.withColumn("fingerprint", F.coalesce("kept", "fingerprint", F.lit(UNREADABLE))).drop("kept")
