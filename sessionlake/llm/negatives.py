"""Hard negatives by exact integer products of anchor and candidate tiles.

Components become whole numbers, floor(256 x). Anchors and candidates are dealt
into tiles; a task multiplies one tile of each by Strassen's recursion on int64
(odd sizes padded with zeros). Additions wrap around, which is exact modulo
2^64, so every score that fits a long comes out right whatever the intermediate
sums. A task keeps, of each anchor, a heap of its best positives; heaps of all
tiles merge by (score, vec_id). A second product fills a heap for each anchor
and positive with the negatives inside its score window.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.llm.ann import matrix
from sessionlake.llm.common import staged

#: A score that no heap takes.
NONE = np.iinfo(np.int64).min
LIMIT = (2**63 - 1) // 100


def even(x: np.ndarray) -> np.ndarray:
    """x with a row and a column of zeros where it has an odd number of them."""
    return np.pad(x, [(0, n % 2) for n in x.shape]) if any(n % 2 for n in x.shape) else x


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 16) -> np.ndarray:
    """a @ b of int64 matrices, modulo 2^64."""
    if min(*a.shape, b.shape[1]) <= leaf:
        return a @ b
    rows, cols = a.shape[0], b.shape[1]
    a, b = even(a), even(b)
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    p, q, r, s = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    t, u, v, w = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    x1, x2, x3 = strassen(p + s, t + w, leaf), strassen(r + s, t, leaf), strassen(p, u - w, leaf)
    x4, x5, x6 = strassen(s, v - t, leaf), strassen(p + q, w, leaf), strassen(r - p, t + u, leaf)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = x1 + x4 - x5 + strassen(q - s, v + w, leaf)
    out[:m, n:] = x3 + x5
    out[m:, :n] = x2 + x4
    out[m:, n:] = x1 - x2 + x3 + x6
    return out[:rows, :cols]


def whole(v: float) -> int:
    """floor(256 v), of any size."""
    return math.floor(256 * v) if abs(v) < 2.0**53 else 256 * int(v)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a with those of b, from doubles. NONE stands where 100 times the score fits no long. Rows whose products could be that large go through Python's integers, all others through Strassen's recursion."""
    small = math.isqrt(LIMIT // max(1, a.shape[1]))
    large_a, large_b = (np.abs(x).max(1, initial=0) >= small / 256 - 1 for x in (a, b))
    left, right = (np.floor(256 * np.where(large[:, None], 0, x)).astype(np.int64) for x, large in ((a, large_a), (b, large_b)))
    out = strassen(left, np.ascontiguousarray(right.T))
    if large_a.any() or large_b.any():
        wide_a, wide_b = ([[whole(v) for v in row] for row in x.tolist()] for x in (a, b))
        for i, j in np.argwhere(large_a[:, None] | large_b[None]).tolist():
            exact = sum(p * q for p, q in zip(wide_a[i], wide_b[j], strict=True))
            out[i, j] = exact if abs(exact) <= LIMIT else NONE
    return out


def top(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, ties to the left; those that are NONE are left out."""
    n = min(k, s.shape[1])
    if not n or not s.shape[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
    row, col = np.nonzero((s >= edge[:, None]) & (s != NONE))
    order = np.lexsort((col, -s[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def sorted_by_id(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """vec_id, label and vectors, by vec_id."""
    table = table.take(np.argsort(table["vec_id"].to_numpy(), kind="stable"))
    return table["vec_id"].to_numpy(), table["label"].to_numpy(), matrix(table["x"])


def best_positives(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """(anchor_id, positive_id, positive_score): the k best rows of the anchor's label in this tile."""
    out = [pa.table([pa.array([], pa.int64())] * 3, names=["anchor_id", "positive_id", "positive_score"])]
    if anchors.num_rows and rows.num_rows:
        ids, labels, x = sorted_by_id(rows)
        me, mine, q = sorted_by_id(anchors)
        for s in range(0, len(me), 256):
            at = slice(s, s + 256)
            score = scores(q[at], x)
            score[(mine[at, None] != labels) | (me[at, None] == ids)] = NONE
            r, c = top(score, k)
            out.append(pa.table([pa.array(me[at][r]), pa.array(ids[c]), pa.array(score[r, c])], names=out[0].schema.names))
    return pa.concat_tables(out)


def best_negatives(anchors: pa.Table, rows: pa.Table, k: int, low: int) -> pa.Table:
    """(anchor_id, positive_id, positive_score, negative_id, negative_score): the k best rows of another label in the window of each of the anchor's positives."""
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    out = [pa.table([pa.array([], pa.int64())] * 5, names=names)]
    if anchors.num_rows and rows.num_rows:
        ids, labels, x = sorted_by_id(rows)
        for s in range(0, anchors.num_rows, 256):
            some = anchors.slice(s, 256)
            me, mine, found = some["vec_id"].to_numpy(), some["label"].to_numpy(), some["positives"].to_pylist()
            score = scores(matrix(some["x"]), x)
            score[(mine[:, None] == labels) | (me[:, None] == ids)] = NONE
            for p in range(max(map(len, found))):
                has = np.array([i for i, f in enumerate(found) if len(f) > p])
                pid, ps = (np.array([found[i][p][n] for i in has], np.int64) for n in ("positive_id", "positive_score"))
                at = score[has]
                # low * ps <= 100 * score, without going over a long
                least = -(-low * ps // 100)
                at = np.where((at >= least[:, None]) & (at <= ps[:, None]), at, NONE)
                r, c = top(at, k)
                out.append(pa.table([pa.array(me[has][r]), pa.array(pid[r]), pa.array(ps[r]), pa.array(ids[c]), pa.array(at[r, c])], names=names))
    return pa.concat_tables(out)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, tile: int = 8192) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: for each anchor (rows of (vec_id, label, embedding) where the Column holds) and each of its best `positives` other rows of the same label, the best `negatives` rows of another label whose score is at least `low` percent of the positive's and not above it.

    label: what counts as the label, if not the column itself. Higher scores come first, ties by smaller vec_id. Rows whose vec_id, label or embedding is null, whose embedding is empty or holds null or non-finite components, take no part. Of different rows under one vec_id the one of the smallest (label, embedding) stands for all; equal rows count once. Vectors of different length don't meet. Pairs whose score, times 100, fits no long are left out. Anchors without positives, and positives with an empty window, give no row; an empty table gives an empty table; other columns are ignored.
    """
    x = F.col("embedding").cast("array<double>")
    sane = (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = F.col("embedding") if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else x
    rows = vectors.where("vec_id is not null and label is not null").withColumn("x", kept).where(sane)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), "x", is_anchor.alias("anchor")).where("label is not null")
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x", "anchor")).alias("r")).select("vec_id", "r.*", F.size("r.x").alias("dim"))
    rows = staged(rows, "negatives-rows")
    counts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("anchor").cast("long")), F.lit(0)).alias("a")).first()
    across, down = max(1, -(-counts.n // tile)), max(1, -(-counts.a // tile))
    spot = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("vec_id", "label", "x", "dim", spot(across, 1).alias("col")).withColumn("row", every(down)).groupBy("dim", "row", "col")
    anchors = rows.where("anchor").select("vec_id", "label", "x", "dim", spot(down, 2).alias("row"))

    def over_tiles(left: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        return left.withColumn("col", every(across)).groupBy("dim", "row", "col").cogroup(candidates).applyInArrow(work, schema)

    def near(a: pa.Table, b: pa.Table) -> pa.Table:
        return best_positives(a, b, positives)

    def hard(a: pa.Table, b: pa.Table) -> pa.Table:
        return best_negatives(a, b, negatives, low)

    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = over_tiles(anchors, near, "anchor_id long, positive_id long, positive_score long").withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives)
    heaps = staged(found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")), "negatives-positives")
    sought = anchors.join(heaps, "vec_id")
    sought = sought.toDF(*sought.columns)  # new names, as both sides come from the same rows
    inside = over_tiles(sought, hard, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return inside.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
