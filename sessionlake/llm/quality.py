"""Quality classifier: a byte-level convolutional network in numpy.

Filters of a few bytes slide over the whole document. Their responses are
max-pooled over overlapping chunks; the mean and the maximum of the chunk
features go through one logistic unit. A filter is a table (width, 256), so a
convolution is a sum of table look-ups and needs no one-hot input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.common import labelled_sample, slices

#: Positions that are pooled into one block; a chunk is two neighbouring blocks, so chunks overlap by half.
BLOCK = 512


@dataclass
class ConvNet:
    filters: np.ndarray  # (width, 256, F)
    bias: np.ndarray  # (F,)
    out: np.ndarray  # (2 F,)
    out_bias: float

    def blocks(self, text: bytes) -> np.ndarray:
        """Largest response of each filter in each block of BLOCK positions; every byte of the text is covered."""
        width = len(self.filters)
        x = np.frombuffer(text.ljust(width, b"\0"), np.uint8)
        n, rows = len(x) - width + 1, []
        for at in range(0, n, BLOCK * 8):
            m = min(BLOCK * 8, n - at)
            z = self.filters[0].take(x[at : at + m], axis=0)
            for j in range(1, width):
                z += self.filters[j].take(x[at + j : at + j + m], axis=0)
            rows.append(np.maximum.reduceat(z, np.arange(0, m, BLOCK), axis=0))
        return np.concatenate(rows)

    def score(self, text: bytes) -> float:
        b = self.blocks(text)
        chunks = np.maximum(np.maximum(b[:-1], b[1:]) if len(b) > 1 else b, -self.bias) + self.bias
        z = float(np.concatenate([chunks.mean(0), chunks.max(0)]) @ self.out + self.out_bias)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(rows: list[tuple[bytes, int]], filters: int = 16, width: int = 6, epochs: int = 4, rate: float = 0.02, seed: int = 7) -> ConvNet:
    """Fits by Adam on all chunks of each row. Without rows of both labels, the score is the share of label 1 (one half with no rows)."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.1, (width, 256, filters)).astype(np.float32), np.zeros(filters, np.float32), rng.normal(0, 0.1, 2 * filters).astype(np.float32), np.zeros(1, np.float32)]
    y = np.array([v for _, v in rows], np.float32)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(rows) else 0.5
    p[3][0] = np.log(share / (1 - share))
    if not len(rows) or y.min() == y.max():
        p[2][:] = 0
        return ConvNet(*p[:3], float(p[3][0]))
    size = 2 * BLOCK + width - 1
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 32):
            pick = order[lo : lo + 32]
            x, owner = [], []
            for k, i in enumerate(pick):
                t = rows[i][0]
                for s in range(0, max(1, len(t) - width + 1), BLOCK):
                    x.append(np.frombuffer(t[s : s + size].ljust(size, b"\0"), np.uint8))
                    owner.append(k)
            x, owner = np.stack(x), np.array(owner)
            n = size - width + 1
            at, top = np.empty((len(x), filters), np.int64), np.empty((len(x), filters), np.float32)
            for k in range(0, len(x), 64):  # responses exist for a few chunks at a time; their maxima are all that is kept
                part = x[k : k + 64]
                z = p[0][0][part[:, :n]]
                for j in range(1, width):
                    z += p[0][j][part[:, j : j + n]]
                at[k : k + 64] = z.argmax(1)
                top[k : k + 64] = np.take_along_axis(z, at[k : k + 64, None], 1)[:, 0] + p[1]
            a, count = np.maximum(top, 0), np.bincount(owner, minlength=len(pick))
            first = np.concatenate([[0], np.cumsum(count)[:-1]])
            mean, most = np.add.reduceat(a, first) / count[:, None], np.maximum.reduceat(a, first)
            f = np.concatenate([mean, most], 1)
            q = 1 / (1 + np.exp(-np.clip(f @ p[2] + p[3], -40, 40)))
            d = (q - y[pick]) / len(pick)
            df = d[:, None] * p[2]
            da = df[owner, :filters] / count[owner][:, None] + df[owner, filters:] * (a == most[owner])
            da *= top > 0
            g = [np.zeros_like(p[0]), da.sum(0), f.T @ d + 1e-4 * p[2], np.array([d.sum()], np.float32)]
            ks = np.broadcast_to(np.arange(filters), at.shape)
            for j in range(width):
                np.add.at(g[0][j], (np.take_along_axis(x, at + j, 1), ks), da)
            step += 1
            for k in range(4):
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return ConvNet(*p[:3], float(p[3][0]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = 3000, seed: int = 5) -> ConvNet:
    """Trains on the whole texts of a bounded sample of `rows` labelled documents; see labelled_sample."""
    return train(labelled_sample(docs, labels, "quality", learn, rows, seed))


def score(docs: DataFrame, net: ConvNet, keep: list[str], name: str = "score") -> DataFrame:
    """The columns `keep` and the probability of label 1 of each row's whole text. A null text counts as empty and gets the score of the empty text; texts of any length are read whole, in pieces; ties and repeated rows get equal scores; an empty table gives an empty table; `name` must not be among `keep`, other columns may have any name."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    kept = docs.select(*keep)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)
    names = list(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches):
            texts = b.column(len(names)).cast(pa.binary()).to_pylist()
            got = pa.array([model.score(t or b"") for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], got], names=[*names, name])

    source = docs.select(*keep, F.col("text").alias("__text"))
    return source.mapInArrow(run, StructType([*kept.schema.fields, StructField(name, DoubleType())]))
