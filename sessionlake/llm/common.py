"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where the session has none, it is an error on a cluster; on one machine, as in tests, a temporary folder is made and remembered."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-sessionlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage is cut there, and a lost executor costs no more than the tasks that read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like staged(), but dealt into buckets of the key, so that a later grouping by it reads the table without a shuffle."""
    spark = df.sparkSession
    table = f"{name}-{uuid.uuid4().hex}".replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def crc_mod(column: str, k: int) -> Column:
    """crc32 of a key as text, modulo k; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(k))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that Python objects exist for one piece at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def portions(batches: Iterator[pa.RecordBatch], column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces that hold about `size` bytes of the string column, or one longer string."""
    for batch in batches:
        stop = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(stop, (int(stop[at - 1]) if at else 0) + size, "right")))
            yield batch.slice(at, to - at)
            at = to


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, seed: int) -> list[tuple[bytes, int]]:
    """At most `rows` whole texts with their label, chosen by a hash of the key among the rows where `learn` holds. Ties and repeated rows: a document with several labels takes the smallest, one with several texts the smallest; null keys, texts and labels teach nothing."""
    marks = labels.select("doc_id", label).dropna().groupBy("doc_id").agg(F.min(label).alias("y"))
    ids = docs.select("doc_id").where(learn).dropna().distinct().join(marks, "doc_id")
    few = ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)
    got = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").where("text is not null").groupBy("doc_id", "y").agg(F.min("text").alias("t")).collect()
    return [(r.t.encode(), int(r.y)) for r in sorted(got, key=lambda r: r.doc_id)]
