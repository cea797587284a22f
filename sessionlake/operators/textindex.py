"""A positional inverted index over texts, as Parquet tables.

Postings hold a term, the text's key, the places where the term stands in it,
and the text's number of terms. They lie in folders by a hash of the term's
first character and are sorted by term inside, so a term or a prefix is found
by one folder and by Parquet's statistics of its terms; a frequent term spreads
over several files, by text. A query reads the postings of its terms once, brings those of
a text together, and intersects places for phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.operators.search import Item, parsed, tokens

K1, B = 1.2, 0.75
#: Fixed value: files that a folder of postings is dealt to, by text.
SLICES = 8
Slot = tuple[str, bool]  # a term, and whether it may go on


def part_of(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 1)), F.lit(parts)).cast("int")


def build(texts: DataFrame, path: str, keys: Sequence[str] = ("session_id", "seq"), parts: int = 64) -> None:
    """Writes the index of (keys, text) under the path. Keys name one text each; null and empty texts have no terms. Other columns are left out."""
    rows = texts.select(*keys, tokens(F.coalesce("text", F.lit(""))).alias("terms"))
    rows.select(*keys, F.size("terms").cast("long").alias("n")).write.parquet(f"{path}/texts")
    # dealt by hash, as bounds of ranges would take a second pass over the texts
    postings(rows, keys, parts).repartition("part", F.pmod(F.xxhash64(*keys), F.lit(SLICES))).sortWithinPartitions("part", "term", *keys).write.partitionBy("part").parquet(f"{path}/postings")


def postings(rows: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """term, keys, places, n and part of (keys, terms): a text's terms meet in its own row, sorted, without a shuffle."""
    placed = rows.select(*keys, F.size("terms").cast("long").alias("n"), F.array_sort(F.transform("terms", lambda t, i: F.struct(t.alias("term"), i.alias("place")))).alias("placed"))
    firsts = F.filter(F.transform("placed", lambda x, i: F.when((i == 0) | (x.term != F.get("placed", F.greatest(i - 1, F.lit(0))).term), i)), lambda i: i.isNotNull())
    runs = placed.withColumn("firsts", firsts)
    posting = lambda i, k: F.struct(F.get("placed", i).term.alias("term"), F.transform(F.slice("placed", i + 1, F.coalesce(F.get("firsts", k + 1), F.size("placed")) - i), lambda x: x.place).alias("places"))
    return runs.select(*keys, "n", F.explode(F.transform("firsts", posting)).alias("posting")).select("posting.term", *keys, "posting.places", "n").withColumn("part", part_of(F.col("term"), parts))


@dataclass(frozen=True)
class TextIndex:
    """An index written by build(), with its keys and number of parts."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...] = ("session_id", "seq")
    parts: int = 64

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def postings(self, slots: Sequence[Slot]) -> DataFrame:
        """The postings of these terms and prefixes, from their folders only."""
        rows = self.spark.read.parquet(f"{self.path}/postings") if self.texts().where("n > 0").limit(1).count() else None
        if rows is None:
            kind = self.texts().schema
            fields = ", ".join(f"{k} {kind[k].dataType.simpleString()}" for k in self.keys)
            rows = self.spark.createDataFrame([], f"term string, {fields}, places array<int>, n long, part int")
        folders = self.spark.createDataFrame([(w[0],) for w, _ in slots], "c string").select(part_of(F.col("c"), self.parts).alias("p")).distinct().collect()  # at most one for each term of the query
        return rows.where(F.col("part").isin([r.p for r in folders]) & reduce(Column.__or__, (fits(s) for s in slots)))

    def found(self, query: str) -> tuple[DataFrame, list[Item]]:
        """Texts that match, with `n` and, for each item that is not negated, how often it stands there (f0, f1, ...)."""
        alternatives = parsed(query)
        items = list(dict.fromkeys(i for part in alternatives for _, i in part if i.terms))
        slots = list(dict.fromkeys(s for i in items for s in i.slots()))
        sure = all(any(not negate and i.terms for negate, i in part) for part in alternatives)
        none = F.array().cast("array<int>")
        if slots:
            held = self.postings(slots).groupBy(*self.keys).agg(F.first("n").alias("n"), *(F.flatten(F.collect_list(F.when(fits(s), F.col("places")))).alias(f"s{k}") for k, s in enumerate(slots)))
        if not sure:  # something matches without any of its terms
            every = self.texts()
            held = every.join(held.drop("n"), list(self.keys), "left").select(*self.keys, "n", *(F.coalesce(f"s{k}", none).alias(f"s{k}") for k in range(len(slots)))) if slots else every
        hits = held.withColumns({f"f{k}": self.times(i, slots) for k, i in enumerate(items)})
        has = {i: F.col(f"f{k}") > 0 for k, i in enumerate(items)}
        match = F.lit(False)
        for part in alternatives:
            every = F.lit(True)
            for negate, i in part:
                hit = has[i] if i.terms else F.lit(True)
                every = every & (~hit if negate else hit)
            match = match | every
        wanted = {i for part in alternatives for negate, i in part if i.terms and not negate}
        kept = [k for k, i in enumerate(items) if i in wanted]
        return hits.where(match).select(*self.keys, "n", *(f"f{k}" for k in kept)).toDF(*self.keys, "n", *(f"f{j}" for j in range(len(kept)))), [items[k] for k in kept]

    def times(self, item: Item, slots: Sequence[Slot]) -> Column:
        """How often an item stands in a text: places of its first term after which the others follow."""
        first, *rest = (F.col(f"s{slots.index(s)}") for s in item.slots())
        for k, other in enumerate(rest, 1):
            first = F.array_intersect(first, F.transform(other, before(k)))
        return F.size(first).cast("long")

    def matching(self, query: str) -> DataFrame:
        """The keys of the texts that search.predicate() finds."""
        return self.found(query)[0].select(*self.keys)

    def ranked(self, query: str, limit: int | None = 50) -> DataFrame:
        """Keys and score of the texts that match, the most relevant first, ties by key. The score adds up idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / average n)) over the items that are not negated, with idf = ln((N - df + 0.5) / (df + 0.5) + 1), k1 = 1.2 and b = 0.75, rounded to four digits."""
        hits, items = self.found(query)
        total = self.texts().agg(F.count("*").alias("texts"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean")).first()
        alone = [self.found(i.text())[0].agg(F.count("*").alias("df")).withColumn("k", F.lit(k)) for k, i in enumerate(items)]
        df = {r.k: r.df for r in reduce(DataFrame.unionByName, alone).collect()} if alone else {}  # a row for each item of the query
        score = F.lit(0.0)
        for k in range(len(items)):
            tf = F.col(f"f{k}").cast("double")
            idf = F.log(F.lit((total.texts - df[k] + 0.5) / (df[k] + 0.5) + 1))
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.lit(total.mean or 1.0)))
        rows = hits.select(*self.keys, F.round(score, 4).alias("score")).orderBy(F.desc("score"), *self.keys)
        return rows if limit is None else rows.limit(limit)


def before(k: int) -> Callable[[Column], Column]:
    return lambda place: place - k


def fits(slot: Slot) -> Column:
    term, goes_on = slot
    return F.col("term").startswith(term) if goes_on else F.col("term") == term
