"""SimHash near-duplicates with vantage-point trees.

1. A fingerprint of 64 majority bits for each document (Arrow batches).
2. Equal fingerprints collapse to one class, so copies cost nothing further.
3. A few vantage points split the classes into shards by Hamming distance.
   Every class lies in one shard and visits each shard that its ball of the
   link radius reaches.
4. In a shard, a vantage-point tree is split and searched at once, for all
   visitors together, with the triangle bounds; links go into a union-find, of
   which only a spanning forest leaves the task.
5. Forests of bounded groups of links, then large-star/small-star rounds over
   these, give the components.

Near duplicates by a Jaccard similarity (similar_groups, keep_one) need a wide
radius: at 0.8, two fingerprints differ in 15 % of their bits. Balls that wide
cross every shell of a tree over a whole corpus, so there the shards are views:
texts that share the smallest remixed hashes of one of several orders meet, and
the trees stand inside these shards, over fingerprints of 1,024 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import slices, staged

LEAF = 96


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, repeats included, as an unsigned integer."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and exactly the six white-space characters
    if not words:
        return 0
    k = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    h = [xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops[k - 1 :], strict=False)]
    return int.from_bytes(majority(np.array(h, dtype=">u8")[:, None]).tobytes(), "big")


def majority(h: np.ndarray) -> np.ndarray:
    """Packed majority bits of rows of 8-byte hashes; bytes add up without overflow in runs of 255 rows."""
    raw, ones = h.view(np.uint8), np.zeros(8 * h.shape[1] * 8, np.int64)
    for i in range(0, len(raw), 255):
        ones += np.add.reduce(np.unpackbits(raw[i : i + 255], axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(raw))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row. Null and empty texts get 0, like any text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())]))


class Forest:
    """Union-find over positions; the smaller position becomes the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self.find(i), self.find(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)


def tree_links(home: np.ndarray, fp: np.ndarray, radius: int, forest: Forest) -> None:
    """Links every home fingerprint with every fingerprint within `radius` of it. home: positions in fp. The tree's nodes are split on the way, so no tree is kept; a branch is entered only by those fingerprints whose ball crosses its shell."""
    stack = [(home, np.arange(len(fp)))]
    while stack:
        data, seek = stack.pop()
        if len(data) == 0 or len(seek) == 0:
            continue
        x, q = fp[data], fp[seek]
        if len(data) > LEAF:
            v = x[len(x) // 2]
            d = np.bitwise_count(x ^ v)
            mid = int(np.median(d))
            inside = d <= mid
            if 0 < inside.sum() < len(data):
                e = np.bitwise_count(q ^ v)
                stack += [(data[inside], seek[e <= mid + radius]), (data[~inside], seek[e > mid - radius])]
                continue
            if 2 * int(d.max()) <= radius:  # any two of these are near each other
                forest.link(np.full(len(data), data[0]), data)
        for i in range(0, len(seek), 4096):
            for j in range(0, len(data), 512):
                a, b = np.nonzero(np.bitwise_count(q[i : i + 4096, None] ^ x[None, j : j + 512]) <= radius)
                u, w = seek[i + a], data[j + b]
                new = u != w
                forest.link(u[new], w[new])


def routes(sample: np.ndarray, shards: int) -> list[tuple[int, int, int, int]]:
    """The top of the vantage-point tree, fitted on a sample: (vantage, radius, inner, outer) for each node; a negative child -1 - s is shard s."""
    nodes: list[list[int]] = []
    done = 0

    def grow(x: np.ndarray, want: int) -> int:
        nonlocal done
        if want <= 1 or len(x) < 2:
            done += 1
            return -done
        v = x[len(x) // 2]
        d = np.bitwise_count(x ^ v)
        at = len(nodes)
        nodes.append([int(v), int(np.median(d)), 0, 0])
        inside = d <= nodes[at][1]
        nodes[at][2] = grow(x[inside], (want + 1) // 2)
        nodes[at][3] = grow(x[~inside], want // 2)
        return at

    grow(sample, shards)
    return [tuple(n) for n in nodes]


def visits(fp: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, position, is home) of all visits of the fingerprints."""
    if not nodes:
        return np.zeros(len(fp), np.int32), np.arange(len(fp)), np.ones(len(fp), bool)
    out, stack = [], [(0, np.arange(len(fp)), np.ones(len(fp), bool))]
    while stack:
        at, i, home = stack.pop()
        if at < 0:
            out.append((np.full(len(i), -1 - at, np.int32), i, home))
            continue
        v, mid, inner, outer = nodes[at]
        d = np.bitwise_count(fp[i] ^ np.uint64(v)).astype(np.int64)
        near, far = d <= mid + radius, d > mid - radius
        stack += [(inner, i[near], (home & (d <= mid))[near]), (outer, i[far], (home & (d > mid))[far])]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def links(classes: DataFrame, radius: int, shard_size: int = 100_000, least_shards: int = 16, sample: int = 20_000) -> DataFrame:
    """A spanning forest (a, b), a < b, of the links within each shard of the distinct fingerprints fp."""
    spark = classes.sparkSession
    n = classes.count()
    few = classes.orderBy(F.xxhash64("fp", F.lit(3)), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    nodes = routes(few, max(least_shards, -(-n // shard_size)))
    shared = spark.sparkContext.broadcast(nodes)  # at most one node for each shard_size fingerprints

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8192):
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            shard, i, home = visits(fp.view(np.uint64), shared.value, radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[i]), pa.array(home)], names=["shard", "fp", "home"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fp", "home"], kind="stable")
        fp = pdf.fp.to_numpy(np.int64)
        forest = Forest(len(fp))
        tree_links(np.flatnonzero(pdf.home.to_numpy(bool)), fp.view(np.uint64), radius, forest)
        moved = np.flatnonzero(forest.up != np.arange(len(fp)))
        roots = np.array([forest.find(i) for i in moved.tolist()], dtype=np.int64)
        return pd.DataFrame({"a": fp[roots], "b": fp[moved]})

    visited = classes.select("fp").mapInArrow(route, "shard int, fp long, home boolean")
    return visited.groupBy("shard").applyInPandas(search, "a long, b long")


def smallest(edges: DataFrame, low: DataFrame, key: str, many: int) -> DataFrame:
    """edges with `m`, the smallest neighbour in low (key, m, n) of their node. Edges of a node with more than `many` meet their answer by a broadcast of these few nodes, the others by a shuffle of the key, so no task gets all edges of a hot node."""
    hot = F.broadcast(low.where(F.col("n") > many).select(F.col(key).alias("__hot"), F.col("m").alias("__m")))
    marked = edges.join(hot, F.col(key) == F.col("__hot"), "left")
    cold = marked.where("__hot is null").drop("__hot", "__m").join(low.where(F.col("n") <= many).drop("n"), key)
    return cold.unionByName(marked.where("__hot is not null").drop("__hot").withColumnRenamed("__m", "m").select(cold.columns))


def forest_edges(table: pa.Table) -> pa.Table:
    """The edges (u, v) of a table as a spanning forest: each node but the smallest of its tree, with this smallest one."""
    node, at = np.unique(np.concatenate([table["u"].to_numpy(), table["v"].to_numpy()]), return_inverse=True)
    forest = Forest(len(node))
    forest.link(*at.reshape(2, -1))
    moved = np.flatnonzero(forest.up != np.arange(len(node)))
    roots = np.array([forest.find(i) for i in moved.tolist()], np.int64)
    return pa.table({"u": node[moved], "v": node[roots]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def components(edges: DataFrame, rounds: int = 60, group: int = 1_000_000) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component.

    Edges are dealt evenly, whatever their nodes, into groups of about `group`, of each of which a spanning forest goes on. One group is the answer already; forests of several are joined by large-star and small-star rounds (each joins all neighbours of a node to the smallest one) until nothing changes. Each round is written to the shared folder.
    """
    now = staged(edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v").distinct(), "edges")

    def summary(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r.n, r.h

    groups = -(-now.count() // group)
    if groups:
        now = staged(now.groupBy(F.pmod(F.xxhash64("u", "v"), F.lit(groups)).alias("g")).applyInArrow(forest_edges, "u long, v long"), "edges")
    if groups < 2:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    now = staged(now.distinct(), "edges")
    before = summary(now)
    for _ in range(rounds):
        # a node of more neighbours than this is answered without moving its edges; there are at most 1,000 of them, or 64 edges each
        many = max(64, before[0] // 500)
        both = now.union(now.select("v", "u")).toDF("x", "y")
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"), F.count("*").alias("n"))
        large = smallest(both.where("y > x"), low, "x", many).select(F.col("y").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = smallest(large, least, "u", many).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = staged(small.where("u <> v").distinct(), "edges")
        after = summary(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, name: str = "simhash") -> DataFrame:
    """One row for each row of docs: doc_id, fp (signed long), component_id (smallest doc_id that chains of links within `radius` bits reach, its own included).

    Null and empty texts have fingerprint 0 and are linked like any other; a null doc_id keeps its row and never names a component unless all its members are null; repeated rows stay; an empty table gives an empty table; columns other than doc_id and text are ignored.
    """
    prints = staged(fingerprints(docs, shingle), f"{name}-fp")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), f"{name}-classes")
    joined = components(links(classes, radius))
    marked = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = staged(marked, f"{name}-roots")
    lowest = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = named.join(lowest, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp") -> Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


#: Bits of the long fingerprint, and the views of a text: each is the key of VIEW smallest remixed shingle hashes.
BITS, VIEWS, VIEW = 1024, 12, 5
_rng = np.random.default_rng(29)
SPREAD = _rng.integers(1, 1 << 63, BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
REMIX = _rng.integers(1, 1 << 63, (2, VIEWS * VIEW), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the word shingles; fewer words are one shingle, no words none. Words as in fingerprint()."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[:-1].tolist()], (ends - 1).tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops[k - 1 :], strict=False)], np.uint64))


def remixed(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each hash under each multiplier, with the high bits stirred into the low ones."""
    z = h[:, None] * by[None]
    z ^= z >> np.uint64(32)
    return z * np.uint64(0x9E3779B97F4A7C15 | 1)


def sketch(h: np.ndarray) -> tuple[bytes, list[int]]:
    """The long fingerprint of a set of shingles (majority bits of remixed hashes) and its view keys. Long sets go through in runs."""
    if not len(h):
        return bytes(BITS // 8), []
    ones, low = np.zeros(BITS, np.int64), np.full(VIEWS * VIEW, 2**64 - 1, np.uint64)
    for i in range(0, len(h), 255):
        part = h[i : i + 255]
        ones += np.add.reduce(np.unpackbits(remixed(part, SPREAD).view(np.uint8), axis=1), axis=0, dtype=np.uint8)
        low = np.minimum(low, ((part[:, None] ^ REMIX[0]) * REMIX[1]).min(0))
    keys = [xxhash.xxh3_64_intdigest(v.tobytes(), i) for i, v in enumerate(low.reshape(VIEWS, VIEW))]
    return np.packbits(2 * ones > len(h)).tobytes(), np.array(keys, np.uint64).view(np.int64).tolist()


def bits_at(similarity: float, bits: int = BITS) -> float:
    """Expected differing bits of two sets of equal size with this Jaccard similarity: their cosine is 2 s / (1 + s)."""
    return bits * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, h1, h2 (128 bits of the text), same (digest of its set of shingles), fp (BITS bits), views (keys) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(t, shingle) for t in b.column(3).to_pylist()]
            got = [sketch(h) for h in sets]
            same = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(same, pa.binary()), pa.array([f for f, _ in got], pa.binary()), pa.array([v for _, v in got], pa.list_(pa.int64()))], names=["doc_id", "h1", "h2", "same", "fp", "views"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", *text_hash(), "text").mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, same binary, fp binary, views array<long>")


def text_hash() -> list[Column]:
    """Two 64-bit hashes of the text; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def words_of(fp: pa.ChunkedArray) -> np.ndarray:
    """A column of fingerprints as a matrix of 64-bit words."""
    return np.frombuffer(b"".join(fp.to_pylist()), np.uint64).reshape(len(fp), -1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def near_pairs(data: np.ndarray, seek: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(seeker, other, distance) of all pairs within `radius`, by the splits and bounds of a vantage-point tree over `data`; fp: rows of 64-bit words."""
    stack = [(data, seek)]
    while stack:
        d, s = stack.pop()
        if not len(d) or not len(s):
            continue
        if len(d) > LEAF:
            v = fp[d[len(d) // 2]]
            e = apart(fp[d], v)
            mid = int(np.median(e))
            inside = e <= mid
            if 0 < inside.sum() < len(d):
                q = apart(fp[s], v)
                near, far = s[q <= mid + radius], s[q > mid - radius]
                if len(near) + len(far) < 2 * len(s):  # else the shells are no narrower than the radius, and a split only costs
                    stack += [(d[inside], near), (d[~inside], far)]
                    continue
        for i in range(0, len(s), 128):
            for j in range(0, len(d), 512):
                dist = apart(fp[s[i : i + 128], None], fp[None, d[j : j + 512]])
                a, b = np.nonzero(dist <= radius)
                yield s[i + a], d[j + b], dist[a, b]


def group_links(ids: np.ndarray, fp: np.ndarray, first: np.ndarray, sure: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) links of a spanning forest of the pairs of one group within `sure` bits, and the positions that no vantage point of `first` (positions) reaches. Vantage points link all that are near them; only who is left over searches the tree."""
    forest, left, edges = Forest(len(ids)), np.arange(len(ids)), []
    queue = first.tolist()
    while len(left):
        v = queue.pop(0) if queue else int(left[0])
        hit = np.flatnonzero(apart(fp, fp[v]) <= sure)
        edges += joined(forest, np.full(len(hit), v), hit)
        before, left = len(left), np.setdiff1d(left, hit, assume_unique=True)
        if not queue and before - len(left) < max(2, before // 16):
            break
    for a, b, _ in near_pairs(np.arange(len(ids)), left, fp, sure):
        edges += joined(forest, a, b)
    ends = np.array(edges, np.int64).reshape(-1, 2)
    return ids[ends[:, 0]], ids[ends[:, 1]], left


def joined(forest: Forest, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links these pairs; returns those that joined two parts."""
    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        p, q = forest.find(i), forest.find(j)
        if p != q:
            forest.up[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def links_table(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINK)


def similar_links(classes: DataFrame, sure: int, group: int = 20_000, pivots: int = 16) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between classes (c, fp, views) within `sure` bits, enough of them to join all that such links join, and the classes that meet: (key, part, parts, c, fp). Shards are the views: classes that share a view key meet. A key that more than `group` classes share is cut into parts; all parts link to the same few vantage points, and classes that none of these reaches search all parts, in blocks."""
    keys = staged(classes.select("c", F.explode("views").alias("key")), "dedup-views")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / group).cast("int")
    met = keys.join(sizes, "key").select("key", "c", parts.alias("parts")).join(classes.select("c", "fp"), "c")
    met = staged(met.withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")).withColumn("lead", F.lit(False)), "dedup-met")
    hot = met.where("parts > 1")
    any_hot = hot.limit(1).count() > 0
    if any_hot:
        # the window keeps `pivots` rows of each key before the shuffle
        lead = hot.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("c"), "c"))).where(F.col("__n") <= pivots).drop("__n")
        everywhere = lead.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("lead", F.lit(True))
        met_parts = met.unionByName(everywhere.select(met.columns))
    else:
        met_parts = met
    shards = max(16, -(-met.count() // group))

    def search(table: pa.Table) -> pa.Table:
        """All groups (key, part) of a shard; classes that no vantage point of a hot key reaches come with a null partner."""
        table = table.sort_by([("key", "ascending"), ("part", "ascending"), ("c", "ascending"), ("lead", "descending")])
        key, part, c, lead = (table[n].to_numpy() for n in ("key", "part", "c", "lead"))
        fp = words_of(table["fp"])
        new = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(part) != 0), [True]])
        edge, got = np.flatnonzero(new), []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            i = np.arange(lo, hi)
            i = i[np.concatenate([[True], np.diff(c[i]) != 0])]  # a lead stands in its own part too
            a, b, rest = group_links(c[i], fp[i], np.flatnonzero(lead[i]), sure)
            got.append(links_table(a, b))
            if lead[i].any():
                got.append(pa.table([pa.array(c[i][rest]), pa.nulls(len(rest), pa.int64())], schema=LINK))
        return pa.concat_tables(got)

    shard = F.pmod(F.xxhash64("key", "part"), F.lit(shards)).alias("shard")
    found = staged(met_parts.groupBy(shard).applyInArrow(search, "a long, b long"), "dedup-links")
    links = found.where("b is not null")
    if any_hot:
        rest = found.where("b is null").select(F.col("a").alias("c")).distinct()
        asks = hot.join(rest, "c", "left_semi").withColumnRenamed("part", "mine").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        here = asks.select("key", "part", "mine").distinct()

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            """A spanning forest between left-over classes of one part and all classes of another."""
            if not left.num_rows or not right.num_rows:
                return LINK.empty_table()
            c = np.concatenate([left["c"].to_numpy(), right["c"].to_numpy()])
            fp = np.concatenate([words_of(left["fp"]), words_of(right["fp"])])
            n = left.num_rows
            forest, edges = Forest(len(c)), []
            for a, b, _ in near_pairs(np.arange(n, len(c)), np.arange(n), fp, sure):
                edges += joined(forest, a, b)
            ends = np.array([e for e in edges if c[e[0]] != c[e[1]]], np.int64).reshape(-1, 2)
            return links_table(c[ends[:, 0]], c[ends[:, 1]])

        by, slim = ["key", "part", "mine"], ["key", "part", "mine", "c", "fp"]
        members = hot.join(here, ["key", "part"]).select(slim).toDF(*slim)
        asks = asks.select(slim).toDF(*slim)
        links = staged(links.unionByName(asks.groupBy(*by).cogroup(members.groupBy(*by)).applyInArrow(meet, "a long, b long")), "dedup-links")
    return links, met.drop("lead")


def runs_of(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of each run of rows that are equal in all these sorted columns."""
    change = np.any([np.diff(c) != 0 for c in columns], axis=0)
    edge = np.flatnonzero(np.concatenate([[True], change, [True]])).tolist()
    return zip(edge[:-1], edge[1:], strict=True)


def meeting_here(pairs: Iterator[tuple[np.ndarray, ...]], key: int, label: np.ndarray, views: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of (a, b, distance), the pairs of different labels whose first common view is this key, so that a pair is looked at in one group only."""
    for a, b, d in pairs:
        new = label[a] != label[b]
        a, b, d = a[new], b[new], d[new]
        if len(a):
            before = int(np.argmax(views[a[0]] == key))
            first = ~(views[a, :before] == views[b, :before]).any(1)
            yield a[first], b[first], d[first]


def unsure_members(met: DataFrame, named: DataFrame, most: int, group: int) -> DataFrame:
    """(key, c, seeks): the members of each key in a pair of different labels within `most` bits; seeks tells on which side. Seekers are the members of a key that do not have its most frequent label; they visit all parts of the key. named: c, label, views. At most two rows of each member and part, whatever the number of pairs."""
    rows = met.join(named, "c")
    tops = rows.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    slim = ["key", "part", "c", "fp", "label", "views"]
    members = staged(rows.join(tops, "key").select(*slim, "parts", (F.col("label") != F.col("top")).alias("seeks")), "dedup-members")
    visits = members.where("seeks").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*slim, "seeks")
    rows = members.select(*slim, F.lit(False).alias("seeks")).unionByName(visits)
    shards = max(16, -(-members.count() // group))

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("part", "ascending")])
        key, part, label, seeks = (table[n].to_numpy() for n in ("key", "part", "label", "seeks"))
        fp, views, used = words_of(table["fp"]), view_matrix(table["views"]), np.zeros(len(key), bool)
        for lo, hi in runs_of(key, part):
            seek, data = lo + np.flatnonzero(seeks[lo:hi]), lo + np.flatnonzero(~seeks[lo:hi])
            for a, b, _ in meeting_here(near_pairs(data, seek, fp, most), key[lo], label, views):
                used[a] = used[b] = True
        return table.select(["key", "c", "seeks"]).filter(pa.array(used))

    shard = F.pmod(F.xxhash64("key", "part"), F.lit(shards)).alias("shard")
    return rows.groupBy(shard).applyInArrow(search, "key long, c long, seeks boolean").distinct()


def view_matrix(views: pa.ChunkedArray) -> np.ndarray:
    """A column of view keys, a row each; all of its lists are full."""
    return np.concatenate([x.flatten().to_numpy() for x in views.chunks]).reshape(-1, VIEWS)


def alike(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether each of the others has at least this exact Jaccard similarity with one; sorted sets, none empty."""
    sizes = np.array([len(o) for o in others])
    every = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both >= similarity * (len(one) + sizes - both) - 1e-9


def exact_links(docs: DataFrame, classes: DataFrame, named: DataFrame, unsure: DataFrame, most: int, shingle: int, similarity: float, block: int = 1 << 25, members: int = 4000) -> DataFrame:
    """Links (a, b) that join the labels of the unsure members (key, c, seeks) wherever two of them within `most` bits have an exact similarity of `similarity` or more.

    The sets of shingles of these members, and of no others, go to their keys, and only a forest over the labels leaves a task. A key is cut into blocks of about `block` bytes of sets and `members` members, and each block of seekers meets each block of members.
    """
    kind = "c long, set binary"

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, shingle).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["c", "set"])

    ends = unsure.select("c").distinct().join(classes.select("c", "t"), "c").select("c", "t.h1", "t.h2")
    texts = docs.select(*text_hash(), "text").join(ends, ["h1", "h2"]).groupBy("c").agg(F.min("text").alias("text"))
    sets = staged(texts.select("c", "text").mapInArrow(sets_of, kind), "dedup-sets").withColumn("size", F.octet_length("set"))
    cut = F.ceil(F.greatest(F.sum("size") / block, F.count("*") / members)).cast("int")
    placed = unsure.join(sets.select("c", "size"), "c")
    blocks = placed.groupBy("key").agg(cut.alias("blocks"))
    placed = placed.join(blocks, "key").withColumn("mine", F.pmod(F.xxhash64("c", F.lit(5)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = lambda yes, no: F.when(F.col("seeks"), F.col(yes)).otherwise(F.col(no))
    tasks = staged(placed.select("key", "c", "seeks", "size", side("mine", "other").alias("i"), side("other", "mine").alias("j")), "dedup-tasks")
    shards = max(16, -(-(tasks.agg(F.sum("size")).first()[0] or 0) // block))
    rows = tasks.drop("size").join(classes.select("c", "fp").join(named, "c").join(sets.drop("size"), "c"), "c")

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending")])
        key, i, j, c, seeks = (table[n].to_numpy() for n in ("key", "i", "j", "c", "seeks"))
        fp, views = words_of(table["fp"]), view_matrix(table["views"])
        sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
        label = np.unique(table["label"].to_numpy(), return_inverse=True)[1]
        forest, got = Forest(len(c)), []
        for lo, hi in runs_of(key, i, j):
            seek, data = lo + np.flatnonzero(seeks[lo:hi]), lo + np.flatnonzero(~seeks[lo:hi])
            for a, b, d in meeting_here(near_pairs(data, seek, fp, most), key[lo], label, views):
                got += label_links(a, b, d, sets, label, forest, similarity)
        x, y = np.array(got, np.int64).reshape(-1, 2).T
        return links_table(c[x], c[y])

    shard = F.pmod(F.xxhash64("key", "i", "j"), F.lit(shards)).alias("shard")
    return staged(rows.groupBy(shard).applyInArrow(search, "a long, b long"), "dedup-links")


def label_links(a: np.ndarray, b: np.ndarray, d: np.ndarray, sets: list[np.ndarray], label: np.ndarray, forest: Forest, similarity: float, run: int = 32) -> list[tuple[int, int]]:
    """Of the pairs (a, b), those that join two trees of labels in the forest and are alike, found by looking at each a's nearest partners first, and at no pair whose labels are joined already."""
    out = []
    order = np.lexsort((b, d, a))
    for lo, hi in runs_of(a[order]) if len(a) else ():
        s, rest = int(a[order[lo]]), b[order[lo:hi]].tolist()
        while rest:
            root = forest.find(label[s])
            now = [x for x in rest[:run] if forest.find(label[x]) != root]
            rest = rest[run:]
            if now:
                for x, like in zip(now, alike(sets[s], [sets[x] for x in now], similarity).tolist(), strict=True):
                    p, q = forest.find(label[s]), forest.find(label[x])
                    if like and p != q:
                        forest.up[max(p, q)] = min(p, q)
                        out.append((s, x))
    return out


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, margin: float = 0.08, group: int = 20_000) -> DataFrame:
    """One row for each distinct (doc_id, text) of docs: doc_id, h1, h2 (see text_hash), n (rows), component (a number of its group of near duplicates).

    Texts are linked when their sets of word shingles have a Jaccard similarity of `similarity` or more; groups are chains of links. The estimate from 1,024 bits has a standard error of about 0.026; pairs within `margin` of the threshold are checked exactly on their sets of shingles, unless others link them already: these sets go where the texts met, so that pairs never leave a task. Candidates share one of 12 views (5 smallest remixed hashes each), which pairs at 0.8 do in 99 of 100 cases, at 0.9 in all but one of 100,000.

    Null, empty and wordless texts are one group; texts of fewer words than a shingle are one shingle; rows with null doc_id take part like others; an empty table gives an empty table; other columns are ignored.
    """
    rows = staged(sketches(docs, shingle), "dedup-rows")
    one = rows.groupBy("same", "doc_id", "h1", "h2").agg(F.count("*").alias("n"), F.min("fp").alias("fp"), F.min("views").alias("views"))
    distinct = staged(one, "dedup-texts")
    grouped = distinct.groupBy("same").agg(F.min("fp").alias("fp"), F.min("views").alias("views"), F.min(F.struct("h1", "h2")).alias("t"))
    classes = staged(grouped.withColumn("c", F.monotonically_increasing_id()), "dedup-classes")
    sure, most = int(bits_at(min(1.0, similarity + margin))), int(bits_at(similarity - margin))
    links, met = similar_links(classes, sure, group)
    joined = components(links)
    # of two groups in a key, the members of one at least seek the other's
    labels = classes.select("c", "views").join(joined.withColumnRenamed("node", "c"), "c", "left").select("c", F.coalesce("root", "c").alias("label"), "views")
    unsure = staged(unsure_members(met, labels, most, group), "dedup-unsure")
    more = exact_links(docs, classes, labels, unsure, most, shingle, similarity, members=max(1, group // 5))
    # what is joined already stays joined to its root
    joined = components(joined.toDF("a", "b").unionByName(more))
    named = classes.select("same", "c").join(joined.withColumnRenamed("node", "c"), "c", "left").select("same", F.coalesce("root", "c").alias("component"))
    return staged(distinct.join(named, "same").select("doc_id", "h1", "h2", "n", "component"), "dedup-named")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, group: int = 20_000) -> DataFrame:
    """One row of each group of similar_groups(): that of the smallest doc_id (null last), then of the smallest text hash. All columns of docs, whatever their names. A text that is like no other stays, even beside another text under the same doc_id or under a null one; of equal rows, one stays."""
    groups = similar_groups(docs, shingle, similarity, group=group)
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2", "n")).alias("r")).select("r.*")
    first = staged(first.select(F.col("doc_id").alias("__id"), F.col("h1").alias("__1"), F.col("h2").alias("__2"), "n"), "dedup-kept")
    hashed = docs.select("*", *(h.alias(f"__h{i}") for i, h in enumerate(text_hash())))
    is_it = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h0") == F.col("__1")) & (F.col("__h1") == F.col("__2"))
    alone = hashed.join(first.where("n = 1"), is_it, "left_semi")
    several = hashed.join(first.where("n > 1"), is_it, "left_semi").dropDuplicates(["doc_id", "__h0", "__h1"])
    return alone.unionByName(several).drop("__h0", "__h1")
