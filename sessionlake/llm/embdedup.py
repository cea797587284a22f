"""Near-duplicate embeddings by randomised-rotation binary codes.

A unit vector o is rotated at random (three rounds of random signs and a
Hadamard transform); the signs of the rotated vector are its code, the unit
vector c of +-1/sqrt(bits). With the stored factor f = <c, o>, <c, q> / f is an
unbiased estimate of the cosine <o, q> of any other unit vector q, and its error
has a standard deviation of at most sqrt(1 - f^2) / f / sqrt(bits - 1) times
sqrt(1 - <o, q>^2). A pair whose estimate lies more than `sigmas` of these below
the threshold is not looked at again; all others are computed exactly. (One bit
a component can't prove a pair to be above the threshold, so none is linked
without that.)

1. Equal vectors of a label are one class.
2. The first bits of the code name a class's shard, as many as its label needs
   for shards of bounded size. A class visits, besides its own, the shards that
   a partner at the threshold falls into, most probable first, until they hold
   all but `miss` of the probability; of two shards, the higher one's classes
   visit, so a pair meets once.
3. Only codes and factors visit, in tiles of bounded size, where they meet the
   full vectors at home. Visitors with an unsure pair come again with their
   vectors; the exact cosines give each class's number of links, and a spanning
   forest is all that leaves a tile besides.
4. Star rounds join the forests into components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.ann import matrix
from sessionlake.llm.common import slices, staged
from sessionlake.llm.simhash import Forest, components


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component under one: cosines stay, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Unit vectors under a random rotation, padded with zeros to a power of two of at least 64 components before it."""
    n, dim = x.shape
    bits = 1 << max(6, (dim - 1).bit_length())
    y = np.zeros((n, bits))
    y[:, :dim] = unit(x)
    rng = np.random.default_rng((seed, dim))
    for _ in range(3):
        y *= rng.choice((-1.0, 1.0), bits)
        h = 1
        while h < bits:
            z = y.reshape(n, -1, 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2)
            h *= 2
        y = y.reshape(n, bits) / math.sqrt(bits)
    return y


def encode(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of rotated unit vectors, and the factors f."""
    return np.packbits(y >= 0, axis=1), np.abs(y).sum(1) / math.sqrt(y.shape[1])


def estimates(y: np.ndarray, code: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the cosines (one row for each code) with the rotated unit vectors y."""
    bits = y.shape[1]
    signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
    return signs @ (y / math.sqrt(bits)).astype(np.float32).T / factor[:, None].astype(np.float32)


def least_estimate(factor: np.ndarray, bits: int, cosine: float, sigmas: float) -> np.ndarray:
    """What a pair of at least this cosine reaches in its estimate, but for errors beyond `sigmas` deviations."""
    spread = np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(bits - 1)
    return cosine - sigmas * spread * math.sqrt(1 - cosine**2) - 1e-5  # the last: single precision


def visited(y: np.ndarray, s: int, cosine: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard): the shards (numbers of s bits) that hold the partners of each row, but for `miss` of the probability. A partner at the threshold differs by a vector of random direction and length sqrt(2 - 2 * cosine), so a coordinate's sign turns with a known probability."""
    n, bits = y.shape
    z = np.abs(y[:, :s]) * math.sqrt(bits / max(1e-12, 2 - 2 * cosine))
    turn = np.vectorize(lambda v: 0.5 * math.erfc(v / math.sqrt(2)), otypes=[float])(z) if n and s else np.zeros((n, s))
    home = homes(y, s)
    rows, shards = [], []
    todo, least = np.arange(n), miss / 64
    while len(todo):
        r, m, p = todo, home[todo], np.ones(len(todo))
        for i in range(s):
            q = turn[r, i]
            r, m, p = np.concatenate([r, r]), np.concatenate([m, m ^ (1 << i)]), np.concatenate([p * (1 - q), p * q])
            keep = p >= least
            r, m, p = r[keep], m[keep], p[keep]
        held = np.bincount(r, p, n)
        done = held[r] >= 1 - miss
        order = np.lexsort((-p, r))
        r, m, p, done = r[order], m[order], p[order], done[order]
        before = np.cumsum(p) - p
        before -= before[np.searchsorted(r, r)]
        use = done & (before < 1 - miss)
        rows.append(r[use])
        shards.append(m[use])
        todo = todo[held[todo] < 1 - miss]
        least /= 8
    return (np.concatenate(rows), np.concatenate(shards)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def homes(y: np.ndarray, s: int) -> np.ndarray:
    """The number that the first s signs make."""
    return ((y[:, :s] >= 0) << np.arange(s)).sum(1, dtype=np.int64)


def tiles(table: pa.Table) -> Iterator[pa.Table]:
    """The rows of each (g, i, j) of a table."""
    keys = [table[n].to_numpy() for n in ("j", "i", "g")]
    order = np.lexsort(keys)
    table = table.take(order)
    j, i, g = (k[order] for k in keys)
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(g) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0), [True]])) if len(g) else []
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        yield table.slice(int(lo), int(hi - lo))


def parted(tile: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The rows at home in a tile, and its visitors."""
    visits = tile["visits"].to_numpy()
    return tile.take(np.flatnonzero(~visits)), tile.take(np.flatnonzero(visits))


def meets(home: pa.Table, guest: pa.Table, at: slice) -> np.ndarray:
    """Which pairs (guest, home) are this tile's: of one shard, those whose guest has the higher class number; of two, all."""
    same = guest["home"].to_numpy()[at, None] == home["home"].to_numpy()[None]
    return ~same | (guest["c"].to_numpy()[at, None] > home["c"].to_numpy()[None])


NEW = pa.schema([("g", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("c", pa.int64())])
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def unsure_visitors(table: pa.Table, cosine: float, sigmas: float, seed: int) -> pa.Table:
    """(g, i, j, c) of the visitors with a pair that their codes can't rule out."""
    out = [NEW.empty_table()]
    for tile in tiles(table):
        home, guest = parted(tile)
        if not home.num_rows or not guest.num_rows:
            continue
        y = rotated(matrix(home["x"]), seed)
        code, factor = np.frombuffer(b"".join(guest["code"].to_pylist()), np.uint8).reshape(guest.num_rows, -1), guest["f"].to_numpy()
        unsure = np.zeros(guest.num_rows, bool)
        for s in range(0, guest.num_rows, 512):
            at = slice(s, s + 512)
            near = estimates(y, code[at], factor[at]) >= least_estimate(factor[at], y.shape[1], cosine, sigmas)[:, None]
            unsure[at] = (near & meets(home, guest, at)).any(1)
        out.append(guest.take(np.flatnonzero(unsure)).select(NEW.names).cast(NEW))
    return pa.concat_tables(out)


def exact_links(table: pa.Table, cosine: float, sigmas: float, seed: int) -> pa.Table:
    """Of the pairs that codes can't rule out, those of at least this cosine in double precision: (class, null, vectors linked) and the links (a, b, null) of a spanning forest."""
    out = [FOUND.empty_table()]
    for tile in tiles(table):
        home, guest = parted(tile)
        if not home.num_rows or not guest.num_rows:
            continue
        x, z = scaled(matrix(home["x"])), scaled(matrix(guest["x"]))
        long_x, long_z = np.sqrt((x * x).sum(1)), np.sqrt((z * z).sum(1))
        y = rotated(x, seed)
        code, factor = encode(rotated(z, seed))
        n_home, n_guest = home["n"].to_numpy(), guest["n"].to_numpy()
        links_home, links_guest = np.zeros(len(x), np.int64), np.zeros(len(z), np.int64)
        forest = Forest(len(x) + len(z))
        edges = []
        for s in range(0, len(z), 512):
            at = slice(s, s + 512)
            near = estimates(y, code[at], factor[at]) >= least_estimate(factor[at], y.shape[1], cosine, sigmas)[:, None]
            v, h = np.nonzero(near & meets(home, guest, at))
            v += s
            for k in range(0, len(v), 16384):
                a, b = v[k : k + 16384], h[k : k + 16384]
                hit = np.einsum("ij,ij->i", z[a], x[b]) / (long_z[a] * long_x[b]) >= cosine
                a, b = a[hit], b[hit]
                np.add.at(links_guest, a, n_home[b])
                np.add.at(links_home, b, n_guest[a])
                for i, j in zip((a + len(x)).tolist(), b.tolist(), strict=True):
                    p, q = forest.find(i), forest.find(j)
                    if p != q:
                        forest.up[max(p, q)] = min(p, q)
                        edges.append((i, j))
        c = np.concatenate([home["c"].to_numpy(), guest["c"].to_numpy()])
        links = np.concatenate([links_home, links_guest])
        some = np.flatnonzero(links)
        ends = np.array(edges, np.int64).reshape(-1, 2)
        out.append(pa.table([pa.array(c[some]), pa.nulls(len(some), pa.int64()), pa.array(links[some])], schema=FOUND))
        out.append(pa.table([pa.array(c[ends[:, 0]]), pa.array(c[ends[:, 1]]), pa.nulls(len(ends), pa.int64())], schema=FOUND))
    return pa.concat_tables(out)


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, sigmas: float = 4.5, miss: float = 0.001, shard: int = 4096, block: int = 4096, guests: int = 16_384, task_rows: int = 40_000, seed: int = 17) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id that chains of links reach, the own included), kept (vec_id = component_id) of each vector of (vec_id, label, embedding). Vectors are linked where their labels are equal and their cosine, in double precision, is at least `cosine` (above 0, up to 1).

    Equal rows are one vector; rows of one vec_id that differ in label or embedding are vectors of their own. Rows whose label or embedding is null, whose embedding is empty or all zero or holds null or non-finite components, link with nothing; neither do vectors of different length. A null vec_id links with nothing and is kept: its component_id is null. An empty table gives an empty table; other columns are ignored. Any finite size of components is fine.

    No pair within a shard is lost but by an error of more than `sigmas` deviations (4.5: 3 in a million); a pair right at the threshold whose vectors fall into different shards is missed with a probability of at most about `miss`, nearer ones far less.
    """
    spark = vectors.sparkSession
    held = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    x = F.col("embedding").cast(f"array<{held}>")
    sane = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("x")).distinct().withColumn("sane", F.coalesce(sane, F.lit(False)))
    rows = staged(rows, "near-rows")
    part = rows.where("sane")
    classes = part.groupBy("label", "x").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).withColumn("dim", F.size("x"))
    classes = staged(classes.withColumn("c", F.monotonically_increasing_id()), "near-classes")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("many") / shard))).cast("int")
    per_label = classes.groupBy("label", "dim").agg(F.count("*").alias("many")).select("label", "dim", bits.alias("s"))
    codes = "c long, label_hash long, s int, n long, home long, shards array<long>, code binary, f float, x array<" + held + ">"

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            s_of, dims = b.column(2).to_numpy(), b.column(3).to_numpy()
            for s, dim in {*zip(s_of.tolist(), dims.tolist(), strict=True)}:
                mine = b.take(np.flatnonzero((s_of == s) & (dims == dim)))
                y = rotated(matrix(mine.column(5)), seed)
                code, factor = encode(y)
                row, to = visited(y, s, cosine, miss)
                home = homes(y, s)
                down = to <= home[row]  # of two shards, the higher one's rows visit
                row, to = row[down], to[down]
                order = np.lexsort((to, row))
                offsets = np.searchsorted(row[order], np.arange(len(y) + 1)).astype(np.int32)
                shards = pa.ListArray.from_arrays(offsets, pa.array(to[order]))
                packed = pa.array([r.tobytes() for r in code], pa.binary())
                arrays = [mine.column(0), mine.column(1), mine.column(2), mine.column(4), pa.array(home), shards, packed, pa.array(factor.astype(np.float32)), mine.column(5)]
                yield pa.RecordBatch.from_arrays(arrays, names=["c", "label_hash", "s", "n", "home", "shards", "code", "f", "x"])

    put = classes.join(per_label, ["label", "dim"]).select("c", F.xxhash64("label", "dim").alias("label_hash"), "s", "dim", "n", "x")
    put = staged(put.mapInArrow(coded, codes), "near-codes")
    g = lambda shard: F.xxhash64("label_hash", "s", shard).alias("g")
    visits = put.withColumn("to", F.explode("shards")).select(g("to"), "c", "home", "code", "f")
    # tiles of a shard: blocks of its own rows by blocks of its visitors
    own = put.groupBy(g("home")).agg(F.ceil(F.count("*") / block).cast("int").alias("rows"))
    come = visits.groupBy("g").agg(F.ceil(F.count("*") / guests).cast("int").alias("cols"))
    grid = staged(own.join(come, "g"), "near-grid")
    spot = lambda n, salt: F.pmod(F.xxhash64("c", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at_home = put.select(g("home"), "c", "home", "n", "x").join(grid.toDF("g", "rows", "cols"), "g").withColumn("i", spot("rows", 1)).withColumn("j", every("cols"))
    abroad = visits.join(grid.toDF("g", "rows", "cols"), "g").withColumn("j", spot("cols", 2)).withColumn("i", every("rows"))
    no = lambda kind: F.lit(None).cast(kind)
    first = at_home.select("g", "i", "j", "c", "home", F.lit(False).alias("visits"), no("binary").alias("code"), no("float").alias("f"), "x").unionByName(abroad.select("g", "i", "j", "c", "home", F.lit(True).alias("visits"), "code", "f", no(f"array<{held}>").alias("x")))
    tasks = max(8, -(-put.select(F.sum(F.size("shards") + 1)).first()[0] // task_rows)) if put.limit(1).count() else 1
    task = F.pmod(F.xxhash64("g", "i", "j"), F.lit(tasks)).alias("task")

    def look(table: pa.Table) -> pa.Table:
        return unsure_visitors(table, cosine, sigmas, seed)

    def decide(table: pa.Table) -> pa.Table:
        return exact_links(table, cosine, sigmas, seed)

    unsure = staged(first.groupBy(task).applyInArrow(look, "g long, i int, j int, c long"), "near-unsure")
    needed = unsure.select("g", "i", "j").distinct()
    whole = put.select("c", "home", "n", "x")
    second = at_home.join(needed.toDF("g", "i", "j"), ["g", "i", "j"], "left_semi").select("g", "i", "j", "c", "home", "n", "x", F.lit(False).alias("visits"))
    second = second.unionByName(unsure.join(whole.toDF(*whole.columns), "c").select("g", "i", "j", "c", "home", "n", "x", F.lit(True).alias("visits")))
    found = staged(second.groupBy(task).applyInArrow(decide, "a long, b long, links long"), "near-links")
    roots = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    marked = classes.select("c", "label", "x", "least", "n").join(links, "c", "left").join(roots.withColumnRenamed("node", "c"), "c", "left")
    marked = staged(marked.select("label", "x", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "c").alias("root")), "near-marked")
    lowest = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = marked.join(lowest, "root").select("label", "x", "n_links", "component_id")
    linked = part.select("vec_id", "label", "x").join(named, ["label", "x"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sane").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
