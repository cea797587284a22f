"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents of a source fall into permuted blocks by a hash of their key. A
source gives all its blocks once for each full pass its target pays for, and a
prefix of its permuted blocks for the rest, the last one trimmed, so the words
it gives meet the target exactly. Which output shard takes which draw is
decided by a tree: the vector of block quotas is split in two, again and again,
each time by a multivariate-hypergeometric draw, until each leaf is a shard.
A shard finds its own leaf by walking down from the root, so the tree is never
stored. Each shard takes disjoint runs of draws and shuffles them locally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.llm.common import WORD, staged


def word_count(text: str = "text") -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds `weight` (repeating, by code point of the source, null last) and `target` to (source, source_size, docs).

    target = min(most * size, level * weight), with the level at which the targets share `share` times all words; this is where resharing the excess by weight ends. As a source reaches its cap at level most * size / weight, the level follows from running sums in that order. One row for each source, so the windows over all rows stay small.
    """
    # binary order of UTF-8 is code point order
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(order - 1, F.lit(len(weights))) + 1).cast("int"))
    by_cap = Window.orderBy("full_at", "weight", F.col("source").isNull(), F.col("source").cast("binary"))
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    got = sources.withColumn("weight", w).withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    got = got.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    got = got.withColumn("level", (share * F.sum("source_size").over(everything) - F.col("capped")) / F.col("open"))
    # the first source in that order whose own cap is not below its level fixes the level of all that follow
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everything)["level"]
    return got.withColumn("target", F.when(level.isNull() | (F.col("full_at") <= level), F.col("cap")).otherwise(level * F.col("weight"))).drop("cap", "full_at", "capped", "open", "level")


#: From this total on, numpy's hypergeometric draws refuse.
LARGE = 10**9


def hypergeometric(good: int, bad: int, take: int, rng: np.random.Generator) -> int:
    """How many of `take` draws without replacement are good, for any sizes. Beyond numpy's limit, by inversion over 40 standard deviations on both sides of the mode, outside of which no double holds a chance."""
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, take))
    total = good + bad
    mean, spread = take * good / total, math.sqrt(take * (good / total) * (bad / total) * ((total - take) / max(1, total - 1)))
    lo, hi = max(0, take - bad, int(mean - 40 * spread) - 40), min(good, take, int(mean + 40 * spread) + 40)
    k = np.arange(lo, hi, dtype=np.float64)
    # log chance of k + 1 less that of k
    step = np.log(good - k) + np.log(take - k) - np.log(k + 1) - np.log(bad - take + k + 1)
    chance = np.concatenate([[0.0], np.cumsum(step)])
    chance = np.cumsum(np.exp(chance - chance.max()))
    return lo + int(np.searchsorted(chance, rng.random() * chance[-1], "right"))


def split(quotas: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate-hypergeometric draw of `take` among the quotas."""
    rest, out = int(quotas.sum()), np.zeros_like(quotas)
    if 0 < rest < LARGE:
        return rng.multivariate_hypergeometric(quotas, take, method="marginals")
    for i, q in enumerate(quotas.tolist()):
        out[i] = hypergeometric(q, rest - q, take, rng) if q and take else 0
        rest, take = rest - q, take - int(out[i])
    return out


def leaf(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first draw, number of draws) of each source for one shard, by walking down the splitting tree. Every shard makes the same draw at the same node, so shards agree without talking."""
    lo, hi, start, q = 0, shards, np.zeros_like(quotas), quotas.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        take = int(q.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = split(q, take, rng)
        if shard < mid:
            hi, q = mid, left
        else:
            lo, start, q = mid, start + left, q - left
    return start, q


#: Blocks of a source in a run; sums over blocks go by runs first, then inside each.
RUN = 256


def plan(docs: DataFrame, keep: Sequence[str] = ("doc_id", "source"), weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_docs: int = 16, shard_blocks: int = 256, seed: int = 17) -> DataFrame:
    """For each row of docs: a struct `row` of its columns `keep`, order (a hash of the row), size, source_size, target, block, first and second (words taken in the full passes and in the partial one, `most` <= 2), first_shard and second_shard (null where nothing is taken).

    What a row gives is what the shards draw of its block: words that no shard draws are not taken. A null text has size 0; null sources are one source, last in order; rows need no key, and repeated rows count each; a source without words has target 0; an empty table gives an empty table; columns of any name may be kept. Sources are labels of corpora: their table (one row each) is the only thing collected.
    """
    if not 0 < most <= 2:
        raise ValueError("most must be over 0 and at most 2")
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    rows = docs.select(row, "source", word_count().alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("order"))
    sized = staged(rows, "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, share, most)
    sources = sources.withColumn("blocks", F.ceil(F.col("docs") / block_docs).cast("long"))
    sources = staged(sources.withColumn("passes", F.floor(F.col("target") / F.greatest("source_size", F.lit(1)) + 1e-12).cast("long")).withColumn("rest", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("passes") * F.col("source_size"))).withColumn("k", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1), "mix-sources")
    placed = sized.join(sources.drop("weight", "docs"), sized.source.eqNullSafe(sources.source)).select(sized["*"], "source_size", "target", "blocks", "passes", "rest", "k").withColumn("block", F.pmod(F.col("order"), F.col("blocks")))
    # words of the blocks before each block, in two steps
    per_block = staged(placed.groupBy("k", "block", "passes", "rest").agg(F.sum("size").alias("words")).withColumn("run", F.floor(F.col("block") / RUN)), "mix-blocks")
    ahead = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    runs = per_block.groupBy("k", "run").agg(F.sum("words").alias("words")).withColumn("run_before", F.coalesce(F.sum("words").over(ahead("k", by="run")), F.lit(0))).drop("words")
    blocks = per_block.join(runs, ["k", "run"]).withColumn("before", F.col("run_before") + F.coalesce(F.sum("words").over(ahead("k", "run", by="block")), F.lit(0)))
    blocks = blocks.withColumn("part", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before"))))
    blocks = staged(blocks.select("k", "block", "passes", "part"), "mix-parts")
    quota = blocks.groupBy("k").agg(F.sum(F.when(F.col("passes") > 0, 1).otherwise(0)).alias("full"), F.sum(F.when(F.col("part") > 0, 1).otherwise(0)).alias("more"))
    counts = {r.k: (r.full, r.more) for r in quota.collect()}
    q = np.array([sum(counts[k]) for k in sorted(counts)], dtype=np.int64)
    number = {k: i for i, k in enumerate(sorted(counts))}
    shards = max(1, -(-int(q.sum()) // shard_blocks))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(sorted(number), dtype=np.int64)
        for pdf in frames:
            for s in pdf.id:
                start, n = leaf(q, shards, int(s), seed)
                k = np.repeat(np.arange(len(q)), n)
                yield pd.DataFrame({"k": names[k], "draw": np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + start[k], "shard": int(s)})

    drawn = spark.range(0, shards, numPartitions=min(shards, 64)).mapInPandas(walk, "k int, draw long, shard long")
    # draws of a source: its full pass in block order, then the blocks of the partial pass
    taking = blocks.where("passes > 0 or part > 0")
    seen = lambda flag: F.sum(F.when(flag, 1).otherwise(0))
    taking = taking.withColumn("run", F.floor(F.col("block") / RUN))
    per_run = taking.groupBy("k", "run").agg(seen(F.col("passes") > 0).alias("f"), seen(F.col("part") > 0).alias("p"))
    per_run = per_run.withColumn("f0", F.coalesce(F.sum("f").over(ahead("k", by="run")), F.lit(0))).withColumn("p0", F.coalesce(F.sum("p").over(ahead("k", by="run")), F.lit(0))).withColumn("all_f", F.sum("f").over(Window.partitionBy("k"))).drop("f", "p")
    numbered = taking.join(per_run, ["k", "run"])
    numbered = numbered.withColumn("i", F.col("f0") + F.coalesce(seen(F.col("passes") > 0).over(ahead("k", "run", by="block")), F.lit(0))).withColumn("j", F.col("all_f") + F.col("p0") + F.coalesce(seen(F.col("part") > 0).over(ahead("k", "run", by="block")), F.lit(0)))
    draws = numbered.select("k", "block", "passes", "part", F.explode(F.array(F.struct(F.lit(1).alias("pass"), F.when(F.col("passes") > 0, F.col("i")).alias("draw")), F.struct(F.lit(2).alias("pass"), F.when(F.col("part") > 0, F.col("j")).alias("draw")))).alias("d")).select("k", "block", "passes", "part", "d.*").where("draw is not null")
    # the table of draws grows with the blocks, though the planner takes it for small
    met = draws.join(drawn.hint("merge"), ["k", "draw"])
    taken = lambda p, x: F.max(F.when(F.col("pass") == p, F.col(x)))
    shards_of = staged(met.groupBy("k", "block").agg(taken(1, "passes").alias("times"), taken(2, "part").alias("given"), taken(1, "shard").alias("first_shard"), taken(2, "shard").alias("second_shard")), "mix-draws")
    got = placed.join(shards_of, ["k", "block"], "left")
    inside = Window.partitionBy("k", "block").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead_in = F.coalesce(F.sum("size").over(inside), F.lit(0))
    got = got.withColumn("second", F.greatest(F.lit(0), F.least(F.col("size"), F.coalesce("given", F.lit(0)) - ahead_in)).cast("long")).withColumn("first", (F.col("size") * F.coalesce("times", F.lit(0))).cast("long"))
    return got.select("row", "order", "size", "source_size", "target", "block", "first", "second", "first_shard", "second_shard")


def mix(planned: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: shard, place (by which the shard is shuffled), row, size and words (the first `words` of the row's `size` are taken), one row for each taking of words. Shards are disjoint; each is one sorted run of a partition."""
    size = F.greatest("size", F.lit(1))
    one = lambda p, shard, words: F.struct(F.lit(p).alias("pass"), F.col(shard).alias("shard"), words.alias("words"))
    full = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("first") / size).cast("int"))), lambda p: F.struct(p.alias("pass"), F.col("first_shard").alias("shard"), F.when(F.col("first") > 0, F.col("size")).otherwise(0).cast("long").alias("words")))
    takes = planned.select("row", "order", "size", F.explode(F.concat(full, F.array(one(0, "second_shard", F.col("second"))))).alias("t")).select("row", "order", "size", "t.*").where("words > 0")
    placed = takes.withColumn("place", F.xxhash64("order", "pass", F.lit(seed)))
    return placed.repartition("shard").sortWithinPartitions("shard", "place").select("shard", "place", "row", "size", "words")
