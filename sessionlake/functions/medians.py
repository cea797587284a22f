"""Exact medians of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.places import kept, shared_folder


def medians(rows: DataFrame, by: Sequence[str], value: str, name: str, most: int = 100_000, cuts: int = 64) -> DataFrame:
    """(by..., name): the exact median of `value` (null and NaN left out) of each group, as F.median gives it; groups without a value have no row.

    A group is cut at `cuts` of its approximate percentiles, the values between two cuts and on each are counted exactly, and only those between the cuts around the middle ranks go on, until at most `most` are left of each group, or one value. So no task ever sorts or holds a whole group. The rows are written once to the shared folder, as each step reads them.
    """
    spark, keys = rows.sparkSession, [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    path = shared_folder(spark, "medians")
    rows.select(F.struct(*keys, F.lit(0).alias("one")).alias("k"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)").write.parquet(path)
    rows = spark.read.parquet(path)
    # lo and hi are the middle ranks, from 0, among the values left; a group has one row for each of them
    sizes = rows.groupBy("k").agg(F.count("*").alias("n"))
    want = sizes.select("k", "n", F.explode(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))).alias("rank"), F.lit(None).cast("double").alias("over"), F.lit(None).cast("double").alias("upto"), F.lit(False).alias("done")).distinct()
    want = kept(want, "medians-want")
    while want.where((F.col("n") > most) & ~F.col("done")).limit(1).count():
        wide, rest = want.where((F.col("n") > most) & ~F.col("done")), want.where((F.col("n") <= most) | F.col("done"))
        left = inside(rows, wide)
        edges = left.groupBy("k", "rank").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", [i / cuts for i in range(1, cuts)] + [1.0], 50 * cuts))).alias("edges"))
        # the values between two cuts, and those equal to a cut, so that what goes on shrinks whatever the ties
        cell = (2 * F.size(F.filter("edges", lambda e: e < F.col("v"))) + F.array_contains("edges", F.col("v")).cast("int")).alias("cell")
        counts = left.join(edges, ["k", "rank"]).groupBy("k", "rank", cell).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("n").over(Window.partitionBy("k", "rank").orderBy("cell")) - F.col("n")
        chosen = counts.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        # what is left lies from `low` to `high`
        chosen = chosen.select("k", "n", (F.col("rank") - F.col("before")).alias("rank"), F.col("low").alias("over"), F.col("high").alias("upto"), (F.col("low") == F.col("high")).alias("done"))
        want = kept(rest.unionByName(chosen), "medians-want")
    found = want.where("done").select("k", F.col("over").alias("v"))
    small = inside(rows, want.where("not done")).groupBy("k", "rank", "v").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("k", "rank").orderBy("v")) - F.col("n")
    picked = small.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).select("k", "v")
    both = found.unionByName(picked).groupBy("k").agg(F.avg("v").alias(name))
    return both.select(*(F.col(f"k.k{i}").alias(c) for i, c in enumerate(by)), name)


def inside(rows: DataFrame, want: DataFrame) -> DataFrame:
    """k, rank and v of the values that are left of each (k, rank)."""
    return rows.join(want.select("k", "rank", "over", "upto"), "k").where("over is null or (v >= over and v <= upto)").select("k", "rank", "v")
