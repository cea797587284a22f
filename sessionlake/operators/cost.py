"""Prices and token cost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.functions.columns import day_of


@dataclass(frozen=True)
class Price:
    """Dollars for a million tokens; cache rates are multiples of the input rate."""

    input: float
    output: float
    cache_read: float = 0.1
    cache_write: float = 1.25


def price_book(given: Mapping[str, Price | Sequence[float] | Mapping[str, float]], defaults: Mapping[str, Price] | None = None) -> dict[str, Price]:
    """`given` over `defaults`. A price is a Price, a pair (input, output), or a table with the keys input and output."""
    book = dict(defaults or {})
    for model, p in given.items():
        if isinstance(p, Mapping):
            if missing := {"input", "output"} - set(p):
                raise ValueError(f"price of {model} lacks {sorted(missing)}")
            p = Price(**p)
        elif not isinstance(p, Price):
            if len(p) != 2:
                raise ValueError(f"price of {model} is not (input, output)")
            p = Price(*p)
        book[model] = p
    return book


def prices_frame(spark: SparkSession, book: Mapping[str, Price]) -> DataFrame:
    """One row for each model prefix; a price list is a hand-written table."""
    rows = [(k, float(p.input), float(p.output), float(p.cache_read), float(p.cache_write)) for k, p in sorted(book.items())]
    return spark.createDataFrame(rows, "prefix string, input_rate double, output_rate double, read_multiple double, write_multiple double")


def price_of(models: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Each distinct model with the price of its longest prefix, null columns if none."""
    names = models.select(model).where(F.col(model).isNotNull()).distinct()
    hit = names.join(F.broadcast(prices), F.col(model).startswith(F.col("prefix")))
    best = hit.groupBy(model).agg(F.max_by(F.struct(*prices.columns), F.length("prefix")).alias("p"))
    return names.join(best, model, "left").select(model, "p.*")


RATES = ("input_tokens", "cache_read_tokens", "cache_creation_tokens", "output_tokens")


def cost(turns: DataFrame, sessions: DataFrame, prices: DataFrame, by: str = "model", as_model: str | None = None, since_ns: int | None = None, source: str | None = None) -> DataFrame:
    """Dollars of each token class by model, day, project or session.

    Tokens are summed by (group, model) before models meet prices, so the prefix match sees one row for each model. Turns of unpriced models count in `unpriced`, unless their group has no tokens of that model. Group keys null and '' merge into '?'. as_model prices all turns as if of that model.
    """
    s = sessions
    if since_ns is not None:
        s = s.where(F.col("started_at_ns") >= since_ns)
    if source is not None:
        s = s.where(F.col("source") == source)
    keys: dict[str, Column] = {"model": F.col("model"), "day": day_of("started_at_ns").cast("string"), "project": F.col("project"), "session": F.col("session_id")}
    joined = turns.join(s.select("session_id", "project"), "session_id")
    sums = joined.groupBy(keys[by].alias("grp"), "model").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in RATES])
    return dollars(sums, prices, as_model)


def dollars(sums: DataFrame, prices: DataFrame, as_model: str | None = None) -> DataFrame:
    """The rows of cost() from sums (grp, model, n and tokens)."""
    if as_model:
        priced_as = prices.where(F.lit(as_model).startswith(F.col("prefix"))).orderBy(F.length("prefix").desc()).limit(1)
        if priced_as.isEmpty():
            raise ValueError(f"no price for {as_model}")
        priced = sums.crossJoin(F.broadcast(priced_as))
    else:
        priced = sums.join(F.broadcast(price_of(sums, prices)), "model", "left")
    used = sum((F.col(c) for c in RATES), F.lit(0)) > 0
    rate = F.col("input_rate")
    usd = {
        "input_usd": F.col("input_tokens") * rate,
        "cache_read_usd": F.col("cache_read_tokens") * rate * F.col("read_multiple"),
        "cache_write_usd": F.col("cache_creation_tokens") * rate * F.col("write_multiple"),
        "output_usd": F.col("output_tokens") * F.col("output_rate"),
    }
    rows = priced.select(F.coalesce(F.nullif("grp", F.lit("")), F.lit("?")).alias("key"), "n", F.when(used & F.col("prefix").isNull(), F.col("n")).otherwise(0).alias("unpriced_n"), *[F.coalesce(v / 1e6, F.lit(0.0)).alias(k) for k, v in usd.items()])
    total = sum((F.sum(k) for k in usd), F.lit(0.0))
    return rows.groupBy("key").agg(F.sum("n").cast("long").alias("turns"), F.sum("unpriced_n").cast("long").alias("unpriced"), *[F.round(F.sum(k), 8).alias(k) for k in usd], F.round(total, 8).alias("usd"))


def is_premium(models: DataFrame, prices: DataFrame, threshold: float = 20.0) -> DataFrame:
    """Models whose longest prefix has an output rate of `threshold` or more."""
    return price_of(models, prices).where(F.col("output_rate") >= threshold).select("model")
