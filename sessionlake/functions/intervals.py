"""Which interval a row falls into, without a join of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.functions.places import kept


def with_latest(rows: DataFrame, at: str, marks: DataFrame, mark_at: str, key: str, name: str) -> DataFrame:
    """rows with a column `name`: the struct of the latest mark of the same key whose time is not after the row's, null where there is none. Marks of one key have different times. One sort by key and time serves all rows, so the work is linear in rows and marks."""
    left = rows.withColumns({"__at": F.col(at), "__row": F.lit(1), name: F.lit(None).cast(marks.select(F.struct("*")).schema[0].dataType)})
    right = marks.select(key, F.col(mark_at).alias("__at"), F.lit(0).alias("__row"), F.struct("*").alias(name))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__at", "__row").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last(name, ignorenulls=True).over(w)).where("__row = 1").drop("__at", "__row")


def with_owner(points: DataFrame, at: str, spans: DataFrame, start: str, end: str, order: str, key: str, name: str) -> DataFrame:
    """points with a column `name`: the struct of the span of the same key that owns the point. That is the first span, by `order`, whose closed interval holds it; else the first that ends at or after it; else the last one; null where the key has no span. Of spans of a key, no two have the same order.

    One sort of points and span ends by time gives the first span that ends at or after each point, as a running minimum from the latest time on. Where that span starts at or before the point, it is the owner, and where starts rise with the order no later span can hold the point either. Only the points left over in keys whose starts fall somewhere look for a holder, by the cells of a binary tree over the times' ranks: a span covers a few cells on each level, a point lies in one of each, so they meet by equality. Spans and the first answers, which for most points are the last, are kept in the shared folder, as they are used several times.
    """
    fell = F.coalesce(F.lag(start).over(Window.partitionBy(key).orderBy(order)) > F.col(start), F.lit(False))
    span = F.struct(F.col(order).alias("__o"), F.col(start).alias("__s"), F.col(end).alias("__e"), F.struct("*").alias("it"))
    marks = kept(spans.select(key, F.col(end).alias("__t"), F.lit(0).alias("__point"), span.alias("__span"), fell.alias("__fell")), "owner-spans")
    kind = marks.schema["__span"].dataType
    asks = points.withColumns({"__t": F.col(at), "__point": F.lit(1), "__span": F.lit(None).cast(kind), "__fell": F.lit(False), "__id": F.monotonically_increasing_id()})
    later = Window.partitionBy(key).orderBy(F.desc("__t"), "__point").rowsBetween(Window.unboundedPreceding, 0)
    all_of = Window.partitionBy(key)
    both = asks.unionByName(marks, allowMissingColumns=True)
    first = F.min_by("__span", "__span.__o").over(later)
    got = both.withColumns({"__ahead": first, "__last": F.max_by("__span", "__span.__o").over(all_of), "__fell": F.max("__fell").over(all_of)}).where("__point = 1").drop("__span", "__point")
    unsure = F.coalesce(F.col("__fell") & (F.col("__ahead.__s") > F.col("__t")), F.lit(False))
    got = kept(got.select("*", unsure.alias("__unsure"), F.coalesce("__ahead.it", "__last.it").alias(name)).drop("__ahead", "__last", "__fell"), "owner-points")
    left = got.where("__unsure")
    keys = left.select(key).distinct()
    holder = held_by(left.select(key, "__id", "__t"), marks.join(keys, key, "left_semi").select(key, "__span"), key)
    held = left.join(holder, [key, "__id"], "left").withColumn(name, F.coalesce("__holder.it", name)).drop("__holder")
    return got.where("not __unsure").unionByName(held).drop("__t", "__id", "__unsure")


def held_by(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """key, __id and __holder: the span (struct __span of __o, __s, __e, it) of the lowest __o that holds the point (__id, __t), for points that one holds."""
    times = points.select(key, F.col("__t").alias("t")).union(spans.select(key, "__span.__s")).union(spans.select(key, "__span.__e")).distinct()
    ranks = times.withColumns({"r": F.row_number().over(Window.partitionBy(key).orderBy("t")) - 1, "levels": F.ceil(F.log2(F.count("*").over(Window.partitionBy(key)) + 1)).cast("int")})
    rank = lambda n: ranks.select(key, F.col("t").alias(f"__t{n}"), F.col("r").alias(f"__r{n}"), F.col("levels").alias(f"__n{n}"))
    proper = spans.where("__span.__s <= __span.__e").withColumns({"__ta": F.col("__span.__s"), "__tb": F.col("__span.__e")}).join(rank("a"), [key, "__ta"]).join(rank("b"), [key, "__tb"])
    # on each level, what is left of the ranks [a, b + 1) after the levels below took their odd ends
    cells = proper.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("__na")))).withColumns({"lo": F.expr("ceil(__ra / power(2, level))").cast("long"), "hi": F.expr("floor((__rb + 1) / power(2, level))").cast("long")}).where("lo < hi")
    ends = F.array_distinct(F.array_compact(F.array(F.when(F.col("lo") % 2 == 1, F.col("lo")), F.when(F.col("hi") % 2 == 1, F.col("hi") - 1))))
    best = cells.select(key, "level", F.explode(ends).alias("cell"), "__span").groupBy(key, "level", "cell").agg(F.min_by("__span", "__span.__o").alias("__span"))
    asks = points.withColumnRenamed("__t", "__tp").join(rank("p"), [key, "__tp"]).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("__np")))).withColumn("cell", F.expr("shiftright(__rp, level)").cast("long"))
    return asks.join(best, [key, "level", "cell"]).groupBy(key, "__id").agg(F.min_by("__span", "__span.__o").alias("__holder"))
