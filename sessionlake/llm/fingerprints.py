"""Document fingerprints by consistent weighted sampling, in Spark SQL only.

A document is a bag of words weighted by their counts. For a sample, each word
draws r and c from Gamma(2, 1) and b from U(0, 1), all from hashes of the word
and the sample's number; with t = floor(ln(weight) / r + b), the word with the
smallest ln(c) - r (t - b + 1) is the sample. Two documents draw the same
(word, t) with a probability equal to the generalised Jaccard similarity of
their weights, sum(min) / sum(max). As r (t - b) is ln(weight) less r times
the fraction of ln(weight) / r + b, t itself is not computed; of one word, the
key tells different t apart.

One shuffle moves the texts: by a range of doc_id, which also brings each
document next to its successor. All later groupings keep that partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.llm.common import WORD


#: ln of the product of two numbers of 25 bits is at most this.
TOP = 50 * math.log(2)


def product(h: Column) -> Column:
    """The product of two numbers of 25 bits from the upper part of a hash, both moved up by one half."""
    return (F.shiftrightunsigned(h, 39) + F.lit(0.5)) * (F.shiftrightunsigned(h, 14).bitwiseAND(F.lit((1 << 25) - 1)) + F.lit(0.5))


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """One long: the term's key in sample k in its upper bits, 32 bits of the term in its lower ones; the smallest wins. One hash gives r and b, another c."""
    h, g = F.xxhash64(F.lit(2 * k), term), F.xxhash64(F.lit(2 * k + 1), term)
    r = F.lit(TOP) - F.log(product(h))
    beta = (h.bitwiseAND(F.lit((1 << 14) - 1)) + F.lit(0.5)) * F.lit(2.0**-14)
    key = F.log(F.lit(TOP) - F.log(product(g))) - log_weight - r * (1 - F.pmod(log_weight / r + beta, F.lit(1.0)))
    # keys of any weight lie above -1024 and under ln 35
    return F.shiftleft(((key + 1024) * F.lit(float(1 << 20))).cast("long"), 32).bitwiseOR(term.bitwiseAND(F.lit(0xFFFFFFFF)))


def ranges(docs: DataFrame, rows_per_range: int = 1000, most: int = 65_536) -> list:
    """Cut points of doc_id that split the rows into ranges of about `rows_per_range` (or `most` ranges), as a list."""
    n = docs.count()
    parts = min(most, max(1, n // rows_per_range))
    at = [i / parts for i in range(1, parts)]
    cuts = docs.select(F.percentile_approx("doc_id", F.array(*[F.lit(x) for x in at]), 10 * parts).alias("c")).first().c if at else []
    return sorted(set(cuts or []))


def with_next(docs: DataFrame, rows_per_range: int = 1000) -> DataFrame:
    """range, doc_id, text, next_text, ghost: each document with the text of the next one by descending doc_id (after the last: the first; null last of all, ties by text). Ghosts are second copies of the first document of a range, put at the end of the range before, where the documents there find their successor."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = ranges(docs, rows_per_range)
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63))) if docs.schema["doc_id"].dataType.typeName() == "long" else F.col("doc_id")
    where = F.lit(0)
    if cuts:
        # the number of cut points below the key: first among every n-th, then among the n that follow
        n = math.isqrt(len(cuts)) + 1
        below = lambda points: F.size(F.filter(points, lambda c: c < key))
        coarse = below(F.array(*[F.lit(c) for c in cuts[n - 1 :: n]])) if len(cuts) >= n else F.lit(0)
        where = n * coarse + below(F.slice(F.array(*[F.lit(c) for c in cuts]), n * coarse + 1, F.lit(n)))
    placed = docs.withColumn("range", where.cast("int")).withColumn("__key", key)
    heads = placed.groupBy("range").agg(F.max("__key").alias("head"), F.count("*").alias("n")).orderBy(F.desc("range")).collect()  # one row for each range
    follows = {h.range: heads[i - 1].range for i, h in enumerate(heads)}  # the range before in descending order, at whose end a range's first document is the ghost
    ghost_of = F.create_map(*[x for h in heads for x in (F.lit(h.range), F.lit(follows[h.range]))]) if heads else F.create_map(F.lit(0), F.lit(0))
    head_of = F.create_map(*[x for h in heads for x in (F.lit(h.range), F.lit(h.head))]) if heads else F.create_map(F.lit(0), F.lit(0))
    homes = F.when(F.try_element_at(head_of, F.col("range")) == F.col("__key"), F.array(F.struct(F.col("range"), F.lit(False).alias("ghost")), F.struct(F.try_element_at(ghost_of, F.col("range")).alias("range"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("ghost"))))
    both = placed.withColumn("home", F.explode(homes)).select("home.range", "home.ghost", "doc_id", "text")
    w = Window.partitionBy("range").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    return both.withColumn("next_text", F.lead("text").over(w)).withColumn("place", F.row_number().over(w))


def fingerprints(docs: DataFrame, samples: int = 32, rows_per_range: int = 1000) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document. A fingerprint has 8 hex digits for each of its `samples`, all 0 without words. Likeness is the share of equal samples; its standard error is sqrt(j (1 - j) / samples). Two texts without words are alike (1), one with and one without are not (0).

    doc_id is an integer. Null texts count as empty; texts of any length are read whole; a null doc_id comes after all others, ties go by text; repeated rows each give a row; the next of an only document is itself; an empty table gives an empty table; columns other than doc_id and text are ignored.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = with_next(docs, rows_per_range).withColumn("edited", F.when(~F.col("ghost"), F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.coalesce("next_text", "text"), F.lit(1), half))))
    # one pass takes all that is needed of the texts, as strings: words, and numbers of their own kinds for what is not sampled
    split = lambda c: F.split(F.col(c), r"[\x20\x09-\x0D]+")
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    quarters = [F.conv(F.substring(sha, 1 + 16 * i, 16), 16, -10) for i in range(4)]
    kinds = [split("text"), split("edited"), F.array(n.cast("string")), F.array(F.col("doc_id").cast("string")), *[F.array(x) for x in quarters]]
    items = F.array(*[F.struct(F.lit(i).alias("which"), x.alias("w")) for i, x in enumerate(kinds)])
    # one number for place and kind keeps the grouping keys short
    texts = pairs.select("range", "place", F.explode(F.filter(items, lambda x: x["w"].isNotNull() & x["w"][0].isNotNull())).alias("x")).select("range", (8 * F.col("place") + F.col("x.which")).cast("long").alias("key"), F.explode("x.w").alias("w")).where("w <> ''")
    words = texts.select("range", "key", F.when(F.pmod("key", F.lit(8)) < 2, F.xxhash64("w")).otherwise(F.col("w").cast("long")).alias("term"))
    counted = words.groupBy("range", "key", "term").agg(F.count("*").alias("n")).withColumn("weight", F.log(F.col("n").cast("double")))
    one = [F.min(sample(F.col("term"), F.col("weight"), k)).alias(f"s{k}") for k in range(samples)]
    drawn = counted.groupBy("range", "key").agg(F.max("term").alias("value"), *one)
    signed = drawn.select("range", F.floor(F.col("key") / 8).cast("int").alias("place"), F.pmod("key", F.lit(8)).alias("which"), "value", F.array(*[F.xxhash64(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(samples)]).alias("sig"))
    value = lambda i: F.max(F.when(F.col("which") == i, F.col("value")))
    signature = lambda i: F.max(F.when(F.col("which") == i, F.col("sig")))
    lined = signed.groupBy("range", "place").agg(signature(0).alias("a"), signature(1).alias("b"), value(2).alias("n_chars"), value(3).alias("doc_id"), *[value(4 + i).alias(f"q{i}") for i in range(4)])
    by_place = Window.partitionBy("range").orderBy("place")
    # ghosts have no edited text; the last row of an only range follows itself
    following = F.lead(F.struct("a", "place")).over(by_place)
    lined = lined.withColumn("next", F.when(following.isNull(), F.col("a")).otherwise(following["a"])).where("q0 is not null")
    lined = lined.withColumn("edited_sha256", F.lower(F.concat(*[F.lpad(F.hex(f"q{i}"), 16, "0") for i in range(4)])))

    def near(x: str, y: str) -> Column:
        same = F.size(F.filter(F.zip_with(x, y, lambda u, v: u == v), lambda e: e)) / F.lit(float(samples))
        return F.when(F.col(x).isNull() & F.col(y).isNull(), 1.0).when(F.col(x).isNull() | F.col(y).isNull(), 0.0).otherwise(same)

    def digits(x: str) -> Column:
        return F.coalesce(F.array_join(F.transform(x, lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), ""), F.lit("0" * 8 * samples))

    return lined.select("doc_id", "n_chars", "edited_sha256", digits("a").alias("fingerprint"), digits("b").alias("edited_fingerprint"), near("a", "b").alias("near_edited"), near("a", "next").alias("near_next"))
