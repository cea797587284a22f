"""Ranked lexical search by hybrid term-at-a-time and document-at-a-time evaluation.

1. Every text is split once, on its bytes: a document keeps its number of terms
   and the counts of those that queries hold. Totals and document frequencies
   are sums over these rows.
2. A task takes its documents in segments and turns each into posting lists by
   document, with a bound on the score of every list and window of documents.
3. For a query, short lists are summed term at a time into accumulators. These
   then act as one more list, with a bound of its own, in a document-at-a-time
   pass: windows and documents whose bounds fall short of the k-th best score
   so far are skipped, the lists with the lowest bounds are only looked up for
   documents that can still get there.
4. The k best of each query and task are merged.

Scores are whole numbers, and only documents strictly below the k-th best are
skipped, so nothing is approximate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.llm.common import portions, staged

#: Which bytes belong to terms (ASCII letters and digits, and all of characters beyond ASCII), in lower case; 0 elsewhere.
TERM = np.array([b + 32 * (65 <= b <= 90) if b >= 128 or chr(b).isalnum() else 0 for b in range(256)], np.uint8)
WINDOW = 4096
NO_ID = np.iinfo(np.int64).max


def split(texts: pa.Array) -> tuple[np.ndarray, pa.BinaryArray]:
    """(text, term): the number of its text for each term of the texts, and the terms, A-Z lower-cased. A null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(offsets) else np.zeros(0, np.uint8)
    low = TERM[raw]
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = (offsets - offsets[0])[:-1]
    first = edges[edges < len(raw)]
    begins[first] |= inside[first]
    starts = np.flatnonzero(begins)
    place = np.concatenate([np.cumsum(inside) - inside, [inside.sum()]])
    ends = np.append(place[starts], place[-1]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[inside])])
    return np.searchsorted(edges, starts, "right") - 1, terms


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the whole text), t and tf (places in the vocabulary and counts of the terms it holds) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.binary())
        for b in portions(batches, 1):
            doc, terms = split(b.column(1))
            n = np.bincount(doc, minlength=b.num_rows)
            at = pc.index_in(terms, known)
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            pair, tf = np.unique(doc[hit] * np.int64(max(1, len(known))) + at.drop_null().to_numpy(), return_counts=True)
            who = pair // max(1, len(known))
            offsets = pa.array(np.searchsorted(who, np.arange(b.num_rows + 1)).astype(np.int32))
            t = pa.ListArray.from_arrays(offsets, pa.array((pair % max(1, len(known))).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n), t, pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], names=["doc_id", "n", "t", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, t array<int>, tf array<int>")


@dataclass
class Best:
    """The k best documents so far, by score, then doc_id (null last)."""

    k: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    doc: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    null: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def least(self) -> int:
        """What a document needs to take part."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.null, null])
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


class Segment:
    """Posting lists of some documents, by term, then document; bounds of each term and window of documents."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int, terms: int):
        by = np.lexsort((ids, null))
        self.ids, self.null = ids[by], null[by]
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        m = 25 + 75 * n * docs // max(1, terms)
        part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        doc = place[doc]
        order = np.lexsort((doc, term))
        self.doc, self.part, term = doc[order], part[order], term[order]
        self.edge = np.searchsorted(term, np.arange(len(weight) + 1))
        self.windows = -(-len(ids) // WINDOW)
        cell = term * self.windows + self.doc // WINDOW
        begins = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell, self.most = cell[begins], np.maximum.reduceat(self.part, begins) if len(begins) else self.part
        self.cut = np.append(begins, len(cell))

    def bounds(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The highest score of a term in each window, and where its postings of the window begin and end."""
        lo, hi = np.searchsorted(self.cell, [term * self.windows, (term + 1) * self.windows])
        most, begin, end = np.zeros((3, self.windows), np.int64)
        w = self.cell[lo:hi] - term * self.windows
        most[w], begin[w], end[w] = self.most[lo:hi], self.cut[lo:hi], self.cut[lo + 1 : hi + 1]
        return most, begin, end

    def accumulated(self, lists: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(document, sum) of some whole lists, term at a time."""
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        doc = np.concatenate([self.doc[self.edge[t] : self.edge[t + 1]] for t, _ in lists])
        part = np.concatenate([self.part[self.edge[t] : self.edge[t + 1]] * times for t, times in lists])
        order = np.argsort(doc, kind="stable")
        doc, part = doc[order], part[order]
        begins = np.flatnonzero(np.diff(doc, prepend=-1))
        return doc[begins], np.add.reduceat(part, begins) if len(begins) else part

    def search(self, query: list[tuple[int, int]], best: Best, short: int) -> int:
        """Takes the documents of a query (term, times) into `best`; returns how many postings of long lists it looked at."""
        held = [(t, times) for t, times in query if self.edge[t + 1] > self.edge[t]]
        size = {t: int(self.edge[t + 1] - self.edge[t]) for t, _ in held}
        acc, total = self.accumulated([(t, times) for t, times in held if size[t] <= short])
        if len(total) >= best.k:
            # scores only grow, so the k-th best accumulator is a bound already
            floor = max(best.least(), int(np.partition(total, len(total) - best.k)[len(total) - best.k]))
        else:
            floor = best.least()
        lists = []
        for t, times in held:
            if size[t] > short:
                most, begin, end = self.bounds(t)
                lists.append((most * times, begin, end, times))
        acc_edge = np.searchsorted(acc, np.arange(self.windows + 1) * WINDOW)
        acc_most = np.zeros(self.windows, np.int64)
        full = np.flatnonzero(np.diff(acc_edge))
        if len(full):
            acc_most[full] = np.maximum.reduceat(total, acc_edge[full])
        reach = acc_most + sum((x[0] for x in lists), np.zeros(self.windows, np.int64))
        seen = 0
        for w in np.flatnonzero(reach >= floor).tolist():
            floor = max(floor, best.least())
            if reach[w] < floor:
                continue
            # lists by their bound here; those that can't reach the floor together are only looked up
            here = sorted(((int(x[0][w]), int(x[1][w]), int(x[2][w]), x[3]) for x in lists if x[0][w]), key=lambda x: x[0])
            below, split_at = 0, 0
            while split_at < len(here) and below + here[split_at][0] < floor:
                below += here[split_at][0]
                split_at += 1
            dense = np.zeros(WINDOW, np.int64)
            a, b = acc_edge[w], acc_edge[w + 1]
            dense[acc[a:b] - w * WINDOW] = total[a:b]
            for _, lo, hi, times in here[split_at:]:
                dense[self.doc[lo:hi] - w * WINDOW] += self.part[lo:hi] * times
                seen += hi - lo
            doc = np.flatnonzero((dense > 0) & (dense + below >= floor))
            score = dense[doc]
            for bound, lo, hi, times in reversed(here[:split_at]):
                if not len(doc):
                    break
                below -= bound
                there = self.doc[lo:hi]
                at = np.searchsorted(there, doc + w * WINDOW)
                hit = there[np.minimum(at, len(there) - 1)] == doc + w * WINDOW
                score[hit] += self.part[lo:hi][at[hit]] * times
                seen += len(doc)
                keep = score + below >= floor
                doc, score = doc[keep], score[keep]
            keep = score >= floor
            doc = doc[keep] + w * WINDOW
            best.add(score[keep], self.ids[doc], self.null[doc])
        return seen


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and joined values of a list column."""
    return pc.list_value_length(column).to_numpy(), column.flatten().to_numpy().astype(np.int64)


def ranked(docs: DataFrame, words: list[bytes], weight: np.ndarray, queries: list[list[tuple[int, int]]], n: int, terms: int, k: int, segment: int, short: float) -> DataFrame:
    """(item, doc_id, score): the k best documents of each query in each task."""
    shared = docs.sparkSession.sparkContext.broadcast((weight, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, asked = shared.value
        best = [Best(k) for _ in asked]
        held: list[pa.RecordBatch] = []
        rows = postings = 0

        def flush() -> None:
            ids = pa.chunked_array([b.column(0) for b in held])
            null = ids.is_null().to_numpy()
            length = np.concatenate([b.column(1).to_numpy() for b in held])
            (count, t), (_, tf) = (tuple(np.concatenate(x) for x in zip(*(flat(b.column(c)) for b in held), strict=True)) for c in (2, 3))
            seg = Segment(ids.fill_null(NO_ID).to_numpy(), null, length, np.repeat(np.arange(len(length)), count), t, tf, weights, n, terms)
            for query, b in zip(asked, best, strict=True):
                seg.search(query, b, max(16, int(short * len(length))))

        for big in batches:
            for at in range(0, big.num_rows, 1024):
                b = big.slice(at, 1024)
                held.append(b)
                rows, postings = rows + b.num_rows, postings + int(pc.sum(pc.list_value_length(b.column(2))).as_py() or 0)
                if rows >= segment or postings >= 32 * segment:
                    flush()
                    held, rows, postings = [], 0, 0
        if held:
            flush()
        item = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        doc, null, score = (np.concatenate([getattr(b, name) for b in best] or [np.zeros(0, np.int64)]) for name in ("doc", "null", "score"))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=null.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"])

    return docs.where(F.size("t") > 0).mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 1 << 20, segment: int = 32_768, short: float = 1 / 32) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of (doc_id, text) with the highest scores above 0 for each row of items (item_id, text), ties by ascending doc_id, null last.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased. N documents hold a term, L terms in all, a document n; a term that df documents hold weighs w = floor(1000 ln((2N+2) / (2df+1))), and a document that holds it tf times scores w * (10^9 tf div (1000 tf + 8 m)) with m = 25 + 75 n N div L, for each time that the item names it.

    Items are taken in blocks of about `block_terms` terms, by a hash of their text, so what the driver and a broadcast hold is bounded; a block reads all documents. Lists of up to `short` of a segment's documents are short. Null and empty texts have no terms; every row of docs is a document, repeated ones too; equal rows of items count once, and items that share an id are ranked one by one; an empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    held = staged(items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct(), "lexical-items")
    letters = held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-letters // (4 * block_terms)))  # a term and what follows it take four characters or more, but for the shortest
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        mine = held.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        who, terms = split(pa.array([r.text for r in mine], pa.string()))
        numbered = terms.dictionary_encode()
        words = [w.as_py() for w in numbered.dictionary]
        if not words:
            continue
        pair, times = np.unique(who * np.int64(len(words)) + numbered.indices.to_numpy(), return_counts=True)
        queries: list[list[tuple[int, int]]] = [[] for _ in mine]
        for p, c in zip(pair.tolist(), times.tolist(), strict=True):
            queries[p // len(words)].append((p % len(words), c))
        rows = staged(counted(docs, words), "lexical-docs")
        total = rows.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = np.zeros(len(words), np.int64)
        for r in rows.select(F.explode("t").alias("t")).groupBy("t").count().toLocalIterator():
            df[r.t] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        found = ranked(rows, words, weight, queries, total.docs, total.terms, k, segment, short)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(mine)], "item long, item_id long")
        out = out.unionByName(top.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
