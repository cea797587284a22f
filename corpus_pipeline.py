"""A corpus pipeline of five stages: quality, toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sessionlake.llm import mixing, packing, quality, simhash, toxicity
from sessionlake.llm.common import WORD, crc_mod, staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier gives a probability of 0.7 or more. Null texts are scored like empty ones; equal texts share a fate, whatever their keys; each repeated row is judged; an empty table stays empty; columns may have any name."""
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 4) != 2)
    name = free_name(docs)
    return quality.score(docs, net, docs.columns, name).where(F.col(name) >= 0.7).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose probability of being toxic is under 0.5. Null and empty texts are not toxic; equal texts share a fate, whatever their keys; each repeated row is judged; an empty table stays empty; columns may have any name."""
    bag = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 5) != 0)
    name = free_name(docs)
    return toxicity.score(docs, bag, docs.columns, name, spans=None).where(F.col(name) < 0.5).select(docs.columns)


def free_name(docs: DataFrame) -> str:
    """A column name that docs does not have, in any case of its letters."""
    return "score_" + "_" * max(len(c) for c in docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity of 0.8 or more): that of the smallest doc_id, null last. Null and empty texts are one group; different texts under one key, or under none, both stay; an empty table stays empty; columns may have any name."""
    return simhash.keep_one(docs)


@F.pandas_udf(StringType())
def first_words(text: pd.Series, words: pd.Series) -> pd.Series:
    """Each text up to the end of its n-th word."""
    word = re.compile(WORD)

    def cut(t: str | None, n: int) -> str | None:
        if t is None:
            return None
        for k, m in enumerate(word.finditer(t), 1):
            if k == n:
                return t[: m.end()]
        return t

    return pd.Series([cut(t, n) for t, n in zip(text, words, strict=True)], dtype=object)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, shard by shard and shuffled inside each: a row comes once for each taking. Where the target cuts through a text, it ends after the last word that is taken, and n_chars follows.

    Rows go through with their takings, so null and repeated keys lose nothing; texts without words give no taking; null sources are one source; an empty table stays empty; columns may have any name.
    """
    mixed = mixing.mix(mixing.plan(docs, docs.columns))
    whole, text = F.col("words") >= F.col("size"), F.col("row.text")
    short = F.when(whole, text).otherwise(first_words(F.when(~whole, text), F.col("words")))
    cut = {"text": short, "n_chars": F.when(whole, F.col("row.n_chars")).otherwise(F.length(short))} if "n_chars" in docs.columns else {"text": short}
    return mixed.select(*(cut.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows and their places in sequences of 1024 tokens. A null text is one piece that holds the end alone; repeated rows and keys each have pieces; an empty table gives an empty table; other columns are left out."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and seeded draws decide which rows stay; tests compare with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
