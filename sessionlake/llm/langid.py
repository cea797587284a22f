"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of 0 to `order` bytes with counts
that are frozen after training. The code length of a byte is found at the
longest context that has seen it; every longer context that is known but has
not seen the byte adds the cost of its escape (method C: distinct / (total +
distinct)); under the empty context, any byte takes 8 bits. As statistics are
frozen, the code length of each (context, byte) that some language has seen is
worked out once, for all languages; these, and the escapes of the contexts, are
hashed by depth, so a text is scored by look-ups from the deepest level up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import slices

#: Bytes of a text that are scored at a time.
PIECE = 1 << 17
UNUSED = np.uint64(2**64 - 1)


class Table:
    """Places of 64-bit keys by open addressing, for many keys at once."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys, self.at = np.full(self.mask + 1, UNUSED), np.zeros(self.mask + 1, np.int32)
        left = np.arange(len(keys))
        slot = self.slot(keys)
        while len(left):
            free = self.keys[slot] == UNUSED
            self.at[slot[free]] = left[free]  # the last one of a slot stays
            won = free & (self.at[slot] == left)
            self.keys[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is unknown."""
        out, left, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self.slot(keys)
        while len(left):
            have = self.keys[slot]
            hit = have == keys[left]
            out[left[hit]] = self.at[slot[hit]]
            on = ~hit & (have != UNUSED)
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out


def keys_of(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each place, as a number."""
    out = np.zeros(len(at), np.uint64)
    for j in range(n - 1, -1, -1):
        out = (out << np.uint64(8)) | x[at - j]
    return out


@dataclass
class Ppm:
    langs: list[str]
    order: int
    grams: list[np.ndarray]  # by depth d: sorted keys of (d bytes, the next byte) that some language has seen
    costs: list[np.ndarray]  # (keys, languages): bits of that byte after that context
    contexts: list[np.ndarray]  # by depth: sorted keys of contexts
    escapes: list[np.ndarray]  # (contexts, languages): bits of the escape; 0 where a language does not know the context
    tables: list[tuple[Table, Table]] = field(default_factory=list)  # built where the model is used

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": []}

    def bits(self, text: bytes) -> np.ndarray:
        """Exact code length of the whole text under each language."""
        if not self.tables:
            self.tables = [(Table(g), Table(c)) for g, c in zip(self.grams, self.contexts, strict=True)]
        total, whole = np.zeros(len(self.langs)), b"\n" * self.order + text
        for lo in range(0, len(text), PIECE):
            x = np.frombuffer(whole[lo : lo + PIECE + self.order], np.uint8).astype(np.uint64)
            at = np.arange(self.order, len(x))
            for d in range(self.order, -1, -1):
                grams, contexts = self.tables[d]
                row = grams.find(keys_of(x, at, d + 1))
                total += self.costs[d].take(row[row >= 0], axis=0).sum(0, dtype=np.float64)
                at = at[row < 0]
                known = contexts.find(keys_of(x, at - 1, d))
                total += self.escapes[d].take(known[known >= 0], axis=0).sum(0, dtype=np.float64)
            total += 8.0 * len(at)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of least code length, and its posterior probability under equal priors; `und` without a letter."""
        if text is None or not any(map(str.isalpha, text)) or not self.langs:
            return "und", 0.0
        b = self.bits(text.lower().encode())
        k = int(b.argmin())
        return self.langs[k], float(1 / np.exp2(np.maximum(b[k] - b, -1000)).sum())


def train(rows: list[tuple[str, str]], order: int = 4) -> Ppm:
    """From (language, text) rows: whole texts, all 256 bytes, every context of up to `order` (at most 6) bytes. Each text begins after `order` line ends."""
    langs = sorted({k for k, _ in rows})
    pad = np.full(order, 10, np.uint64)
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    for k in langs:
        texts = [np.frombuffer(t.lower().encode(), np.uint8).astype(np.uint64) for j, t in rows if j == k]
        x = np.concatenate([y for t in texts for y in (pad, t)])
        stop = np.cumsum([order + len(t) for t in texts])
        at = np.concatenate([np.arange(z - len(t), z) for z, t in zip(stop, texts, strict=True)])
        seen.append((x, at))
    model = Ppm(langs, order, [], [], [], [])
    for d in range(order + 1):
        counted = [np.unique(keys_of(x, at, d + 1), return_counts=True) for x, at in seen]
        grams = np.unique(np.concatenate([g for g, _ in counted])) if counted else np.zeros(0, np.uint64)
        contexts, ctx = np.unique(grams >> np.uint64(8), return_inverse=True)
        costs, escapes = np.zeros((len(grams), len(langs)), np.float32), np.zeros((len(contexts), len(langs)), np.float32)
        lower = model.costs[-1][np.searchsorted(model.grams[-1], grams & np.uint64((1 << 8 * d) - 1))] if d else np.full((len(grams), len(langs)), 8.0)
        for i, (g, n) in enumerate(counted):
            count = np.zeros(len(grams))
            count[np.searchsorted(grams, g)] = n
            total, kinds = np.bincount(ctx, weights=count, minlength=len(contexts)), np.bincount(ctx, weights=count > 0, minlength=len(contexts))
            known = total > 0
            escapes[known, i] = -np.log2(kinds[known] / (total + kinds)[known])
            costs[:, i] = np.where(count > 0, -np.log2(np.maximum(count, 1) / np.maximum(total + kinds, 1)[ctx]), escapes[ctx, i] + lower[:, i])
        model.grams.append(grams)
        model.costs.append(costs)
        model.contexts.append(contexts)
        model.escapes.append(escapes)
    return model


def fit(docs: DataFrame, learn: Column, per_lang: int = 300, seed: int = 8) -> Ppm:
    """Trains on the whole texts of at most `per_lang` documents of each language, chosen by a hash of the key. Rows without key, language or text teach nothing; of several texts under one key, the smallest does."""
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    few = docs.select("doc_id", "lang").where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).withColumn("__n", F.row_number().over(by_hash)).where(F.col("__n") <= per_lang).select("doc_id").distinct()
    got = docs.select("doc_id", "lang", "text").join(F.broadcast(few), "doc_id").where("text is not null and lang is not null").groupBy("doc_id").agg(F.min(F.struct("lang", F.col("text").alias("t"))).alias("x")).select("x.*").collect()
    return train(sorted((r.lang, r.t) for r in got))


def predict(docs: DataFrame, model: Ppm, keep: list[str]) -> DataFrame:
    """The columns `keep`, lang_pred and score of each row's whole text. Null, empty and letterless texts are `und` with score 0; texts of any length are read whole, in pieces; languages that tie go by name; repeated rows get equal results; an empty table gives an empty table; lang_pred and score must not be among `keep`, other columns may have any name."""
    kept = docs.select(*keep)
    names = list(kept.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = shared.value
        for b in slices(batches):
            got = [ppm.predict(t) for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array([k for k, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64())], names=[*names, "lang_pred", "score"])

    source = docs.select(*keep, F.col("text").alias("__text"))
    return source.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
