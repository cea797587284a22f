"""Where tables stand that outlive one plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Where the session names none, it is an error on a cluster; on one machine, as in tests, a temporary folder is made and remembered."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-sessionlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Fixed value: bytes of bytecode beyond which HotSpot leaves a method uncompiled.
COMPILED = "8000"


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Spark fuses no operators into methods that the JVM would run uncompiled, as a line's many columns do; it evaluates these by smaller methods."""
    key = "spark.sql.codegen.hugeMethodLimit"
    was = spark.conf.get(key)
    spark.conf.set(key, COMPILED)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def kept(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """df worked out once, into a folder of its own, and read from there: what is used several times costs once, and a lost executor costs no more than its tasks. `wide` is for rows of many long expressions (see compiled)."""
    path = shared_folder(df.sparkSession, name)
    with compiled(df.sparkSession) if wide else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
