"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to floor((a . x + b) / w) for each of its Gaussian
directions a. A query visits its own bucket and then perturbed ones (one or
more coordinates moved by one), in the order of their estimated success: the
sum of squared distances to the walls that are crossed. Vectors of the visited
buckets of all tables are candidates; exact distances rank them.

Equal vectors are one class; only the k + 1 smallest ids of a class can ever be
among a query's k nearest, so a vector held by a third of all rows costs one
row. Buckets are joined in blocks of bounded size, within which the distances
are blocks of a matrix product; only the best k of each query and block leave
the task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.llm.common import slices, staged


@dataclass
class Index:
    a: np.ndarray  # (tables, hashes, dimension)
    b: np.ndarray  # (tables, hashes)
    width: float

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket coordinates (tables, n, hashes) and the distances to the lower walls, in widths."""
        z = np.einsum("thd,nd->tnh", self.a, x, optimize=True) / self.width + self.b[:, None]
        cell = np.floor(z)
        return cell.astype(np.int64), z - cell

    @staticmethod
    def key(cells: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the coordinates, over the last axis."""
        h = np.full(cells.shape[:-1], 1469598103934665603, np.uint64)
        for j in range(cells.shape[-1]):
            h = (h ^ cells[..., j].astype(np.uint64)) * np.uint64(1099511628211)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)


def perturbations(hashes: int, most: int) -> list[list[int]]:
    """The `most` best sets of positions 0..2 hashes - 1 (walls by rising distance; a set never holds both walls of a coordinate) by their expected score: after Lv et al. 2007, sets grow from {0} by shifting or extending their largest member."""
    m = hashes
    expected = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    expected += [1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(m + 1, 2 * m + 1)]
    heap, out = [(expected[0], [0])], []
    while heap and len(out) < most:
        score, s = heapq.heappop(heap)
        # the j-th smallest wall and the j-th largest belong to one coordinate
        if len({min(j, 2 * m - 1 - j) for j in s}) == len(s):
            out.append(s)
        last = s[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - expected[last] + expected[last + 1], [*s[:-1], last + 1]))
            heapq.heappush(heap, (score + expected[last + 1], [*s, last + 1]))
    return out


def fit(sample: np.ndarray, rows: int, tables: int, width: float, seed: int) -> Index:
    """Directions, offsets and the width of a cell, `width` standard deviations of the sample along a direction. The number of directions of a table grows with the logarithm of the rows, so buckets do not grow with the table."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] if len(sample) else 1
    hashes = max(4, round(0.65 * math.log2(max(2, rows))))
    a = rng.normal(size=(tables, hashes, dim))
    spread = float(np.median((sample @ a.reshape(-1, dim).T).std(0))) if len(sample) > 1 else 1.0
    return Index(a, rng.uniform(size=(tables, hashes)), width * (spread or 1.0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def length(d: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows; those whose squares overflow or vanish are worked out from rows divided by their largest component."""
    out = np.sqrt((d * d).sum(1))
    odd = np.flatnonzero(~((out > 1e-150) & (out < np.inf)))
    if len(odd):
        most = np.abs(d[odd]).max(1, initial=0)
        some = most > 0
        part = d[odd[some]] / most[some, None]
        out[odd] = 0
        out[odd[some]] = most[some] * np.sqrt((part * part).sum(1))
    return out


def measured(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of the pairs (q[i], p[j]), from differences and in pieces."""
    return np.concatenate([length(q[i[s : s + 16384]] - p[j[s : s + 16384]]) for s in range(0, len(i), 16384)] or [np.zeros(0)])


def best_of(who: np.ndarray, d: np.ndarray, first: np.ndarray, take: int) -> np.ndarray:
    """Positions of the `take` smallest (d, first) of each `who`."""
    order = np.lexsort((first, d, who))
    m = who[order]
    return order[np.arange(len(m)) - np.searchsorted(m, m) < take]


def pairs_of(p: np.ndarray, first: np.ndarray, keys: np.ndarray, q: np.ndarray, visits: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, distance): for each query row and the points of the bucket it visits, the nearest `take`, ties to the smaller `first`.

    A matrix product ranks them in blocks. Every point that its rounding error could place among the nearest is measured, so ties at the edge are decided by exact distance and id.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        return ranked_pairs(p, first, keys, q, visits, take)


def ranked_pairs(p: np.ndarray, first: np.ndarray, keys: np.ndarray, q: np.ndarray, visits: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pairs_of(), where overflow is looked after."""
    by, order = np.argsort(keys, kind="stable"), np.argsort(visits, kind="stable")
    sq, sq_q, out = (p * p).sum(1), (q * q).sum(1), []
    slack = 4 * (p.shape[1] + 4) * np.finfo(float).eps
    ks, vs = keys[by], visits[order]
    for key in np.intersect1d(ks, vs):
        mine = by[np.searchsorted(ks, key) : np.searchsorted(ks, key, "right")]
        asking = order[np.searchsorted(vs, key) : np.searchsorted(vs, key, "right")]
        n = min(take, len(mine))
        for at in range(0, len(asking), 1024):
            who = asking[at : at + 1024]
            near = sq[mine][None] - 2 * (q[who] @ p[mine].T)
            edge = np.partition(near, n - 1, axis=1)[:, n - 1] + slack * (sq_q[who] + sq[mine].max())
            row, col = np.nonzero(~(near > edge[:, None]))  # where squares overflow, nothing is ruled out
            i, j = who[row], mine[col]
            d = measured(p, q, i, j)
            keep = best_of(row, d, first[j], take)
            out.append((i[keep], j[keep], d[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j, d = (np.concatenate(c) for c in zip(*out, strict=True))
    return i, j, d


def nearest_in(k: int, left: pa.Table, right: pa.Table) -> pa.Table:
    """The k nearest ids of each query of `right` among the classes of `left` whose key it visits, by exact distance, ties to smaller ids."""
    frame = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    if left.num_rows and right.num_rows:
        p, q = matrix(left["x"]), matrix(right["x"])
        if p.shape[1] != q.shape[1]:
            raise ValueError("vectors differ in length")
        ids = left["ids"].combine_chunks()
        starts, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        first = flat[starts[:-1]]
        i, j, d = pairs_of(p, first, left["key"].to_numpy(), q, right["key"].to_numpy(), k + 1)
        me = right["vec_id"].to_numpy()[i]
        order = np.lexsort((first[j], d, me))
        order = order[np.concatenate([[True], (np.diff(me[order]) != 0) | (np.diff(j[order]) != 0)])] if len(order) else order
        # only k + 1 classes of a query can matter
        m = me[order]
        place = np.arange(len(m)) - np.searchsorted(m, m)
        order = order[place <= k]
        n = (starts[1:] - starts[:-1])[j[order]]
        at = np.repeat(starts[j[order]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        frame = pd.DataFrame({"query_id": np.repeat(me[order], n), "vec_id": flat[at], "score": np.repeat(d[order], n)})
        frame = frame[frame.query_id != frame.vec_id].sort_values(["query_id", "score", "vec_id"]).drop_duplicates()
        frame = frame[frame.groupby("query_id").cumcount() < k]
    return pa.Table.from_pandas(frame, preserve_index=False)


def search(vectors: DataFrame, is_query: Column, k: int = 10, tables: int = 6, probes: int = 64, width: float = 3.0, block: int = 2048, shard_rows: int = 50_000, sample: int = 4096, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest rows found for each row of (vec_id, embedding) where the Column is_query holds.

    score is the Euclidean distance in double precision. Ties go to the smaller vec_id. Rows with a query's own vec_id are no candidates for it; repeated rows count once. Rows whose id or vector is null, empty, all zero, or holds null or non-finite components take no part. Vectors must have one length, else an error says so; components may be of any finite size. Where the buckets give a query fewer than k rows, it searches all rows in blocks, so it gets min(k, all) of them. An empty table gives an empty table; other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType
    held = "float" if kind.typeName() == "float" else "double"
    x = F.col("embedding").cast(f"array<{held}>")
    sane = F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), is_query.alias("q")).where(sane)
    # of equal vectors, the k + 1 smallest ids, once repeated rows are one: the window keeps that many of each before the shuffle
    hashed = valid.select("vec_id", "x", F.xxhash64("x").alias("h")).distinct().withColumn("n", F.row_number().over(Window.partitionBy("h", "x").orderBy("vec_id")))
    classes = staged(hashed.where(F.col("n") <= k + 1).groupBy("h", "x").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("c"), "x", "ids"), "ann-classes")
    asked = staged(valid.where("q").groupBy("vec_id").agg(F.min("x").alias("x")), "ann-queries")
    rows = classes.count()
    few = classes.orderBy(F.xxhash64("c", F.lit(seed)), "c").limit(sample).select("x").collect()
    index = fit(np.array([r.x for r in few], dtype=float) if few else np.zeros((0, 1)), rows, tables, width, seed)
    shared = spark.sparkContext.broadcast((index, perturbations(index.a.shape[1], probes)))

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, _ = shared.value
        for b in slices(batches, 1024):
            cells, _ = idx.place(matrix(b.column(1)))
            keys = idx.key(cells)
            for t in range(len(keys)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(keys[t]), *b.columns], names=["t", "bucket", *b.schema.names])

    def probe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, steps = shared.value
        for b in slices(batches, 256):
            cells, frac = idx.place(matrix(b.column(1)))
            m = cells.shape[-1]
            # walls by distance; the two walls of a coordinate stand at mirrored places, as their distances add up to one
            order = np.argsort(np.concatenate([frac, 1 - frac], -1), -1, kind="stable")
            for t in range(len(cells)):
                for s in [[], *steps]:
                    moved = cells[t].copy()
                    for j in s:
                        w = order[t][:, j]
                        moved[np.arange(len(w)), w % m] += np.where(w < m, -1, 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(idx.key(moved)), *b.columns], names=["t", "bucket", *b.schema.names])

    data = classes.mapInArrow(hash_rows, f"t int, bucket long, c long, x array<{held}>, ids array<long>")
    # large buckets are dealt in blocks, and (bucket, block) keys to shards of about shard_rows rows
    sizes = staged(data.groupBy("t", "bucket").agg(F.count("*").alias("size")).select("t", "bucket", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "ann-buckets")
    shards = max(8, -(-rows * tables // shard_rows))
    key = F.xxhash64("t", "bucket", "block").alias("key")
    placed = data.join(sizes.toDF("t", "bucket", "blocks"), ["t", "bucket"]).withColumn("block", F.pmod(F.col("c"), F.col("blocks")).cast("int")).select(key, "x", "ids")
    visits = asked.mapInArrow(probe_rows, f"t int, bucket long, vec_id long, x array<{held}>").join(sizes.toDF("t", "bucket", "blocks"), ["t", "bucket"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(key, "vec_id", "x")
    shard = F.pmod("key", F.lit(shards)).alias("shard")

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        return nearest_in(k, left, right)

    found_schema = "query_id long, vec_id long, score double"
    found = placed.groupBy(shard).cogroup(visits.groupBy(shard)).applyInArrow(nearest, found_schema).distinct()
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = staged(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "ann-found")
    # queries whose buckets held fewer than k rows search everything, in blocks
    full = ranked.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    poor = asked.join(full, "vec_id", "left_anti")
    if poor.limit(1).count():
        n_blocks = max(1, -(-rows // block))
        everywhere = poor.withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
        blocks = classes.select(F.pmod(F.col("c"), F.lit(n_blocks)).alias("key"), "x", "ids")
        more = blocks.groupBy("key").cogroup(everywhere.select("key", "vec_id", "x").groupBy("key")).applyInArrow(nearest, found_schema)
        both = ranked.join(poor.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select("query_id", "vec_id", "score").unionByName(more)
        ranked = both.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def recall(found: pd.DataFrame, exact: pd.DataFrame) -> float:
    """Share of the exact neighbours (query_id, vec_id) that were found."""
    return len(found.merge(exact, on=["query_id", "vec_id"])) / max(1, len(exact))
