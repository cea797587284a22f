"""Toxicity by multiple-instance learning.

Only documents carry labels. A sentence's score is a logistic function of its
words and their beginnings; a document's score is the noisy-or of its sentences, 1 - prod(1 - p).
Training pushes the document loss through the noisy-or down to the words, so
that at scoring time the offending sentences can be located.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import labelled_sample, slices

SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"[^\W\d_]+")


def features(sentence: str) -> set[str]:
    """Lower-cased words, and the first five letters of longer ones (marked, so that they are not words)."""
    words = set(TOKEN.findall(sentence.lower()))
    return words | {"^" + w[:5] for w in words if len(w) > 5}


@dataclass
class Bag:
    weights: dict[str, float]  # of features that matter; others weigh nothing
    bias: float

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Start, end and logit of each sentence."""
        get = self.weights.get
        for m in SENTENCE.finditer(text):
            yield m.start(), m.end(), self.bias + sum(get(w, 0.0) for w in features(m[0]))

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and the sentences of probability 0.5 or more. An empty text has no sentence and scores 0."""
        found = list(self.sentences(text))
        z = np.array([s for _, _, s in found])
        p = -np.expm1(-np.logaddexp(0, z).sum())
        return float(p), [(a, b, float(1 / (1 + np.exp(-s)))) for a, b, s in found if s >= 0]


def train(rows: list[tuple[bytes, int]], least: int = 3, strength: float = 14.0, epochs: int = 300, rate: float = 0.1, decay: float = 0.1) -> Bag:
    """Full-batch Adam over the features that at least `least` toxic documents of the sample hold and that tell the labels apart (a likelihood ratio of `strength` or more); rarer ones would only learn the sample by heart. `least` is at most 255. Without rows of both labels, nothing is toxic."""
    y = np.array([v for _, v in rows], float)
    if not len(rows) or y.min() == y.max():
        return Bag({}, -12.0)
    # how many toxic documents hold a feature, at least, by its hash; only features that may reach `least` get a number
    mask = (1 << 22) - 1
    held = bytearray(mask + 1)
    for t, v in rows:
        if v > 0:
            for k in {hash(w) & mask for m in SENTENCE.finditer(t.decode(errors="replace")) for w in features(m[0])}:
                held[k] = min(255, held[k] + 1)
    ids: dict[str, int] = {}
    pos, tot, base = array("i"), array("i"), y.mean()
    for t, v in rows:
        for w in {w for m in SENTENCE.finditer(t.decode(errors="replace")) for w in features(m[0]) if held[hash(w) & mask] >= least}:
            if (k := ids.setdefault(w, len(ids))) == len(tot):
                tot.append(0)
                pos.append(0)
            tot[k] += 1
            pos[k] += v > 0
    pos, tot = np.array(pos, float), np.array(tot, float)
    rate_pos = np.clip(pos / np.maximum(tot, 1), 1e-9, 1 - 1e-9)
    ratio = 2 * (pos * np.log(rate_pos / base) + (tot - pos) * np.log((1 - rate_pos) / (1 - base)))
    good = (pos >= least) & (rate_pos > base) & (ratio >= strength)
    names = sorted(w for w, k in ids.items() if good[k])
    kept = np.array([ids[w] for w in names], np.int64)
    number = {w: i for i, w in enumerate(names)}
    sent_of, word_of, owner = array("i"), array("i"), array("i")
    for d, (t, _) in enumerate(rows):
        for m in SENTENCE.finditer(t.decode(errors="replace")):
            for i in sorted(number[w] for w in features(m[0]) if w in number):
                sent_of.append(len(owner))
                word_of.append(i)
            owner.append(d)
    owner, sent, word = (np.array(x, np.int64) for x in (owner, sent_of, word_of))
    n_sent, n_doc = len(owner), len(rows)
    n_word = len(kept)
    # starts from the features' log odds between the two labels
    w = np.log((pos[kept] + 0.5) / (tot[kept] - pos[kept] + 0.5) / (base / (1 - base)))
    p = np.concatenate([w, [np.log(base / 10 / max(1, n_sent / n_doc))]])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, epochs + 1):
        z = p[-1] + np.bincount(sent, weights=p[word], minlength=n_sent)
        total = np.bincount(owner, weights=np.logaddexp(0, z), minlength=n_doc)
        # the loss of label 0 is the total itself, that of label 1 is -log(1 - exp(-total))
        d_total = np.where(y > 0, -np.exp(-total) / np.maximum(-np.expm1(-total), 1e-6), 1.0) / n_doc
        d_z = d_total[owner] / (1 + np.exp(-z))
        g = np.concatenate([np.bincount(word, weights=d_z[sent], minlength=n_word) + decay / n_doc * p[:-1], [d_z.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.9 * v + 0.1 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.9**step)) + 1e-9)
    return Bag({w: float(p[i]) for i, w in enumerate(names)}, float(p[-1]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = 6000, seed: int = 6) -> Bag:
    """Trains on the whole texts of a bounded sample of `rows` labelled documents; see labelled_sample."""
    return train(labelled_sample(docs, labels, "toxic", learn, rows, seed))


def score(docs: DataFrame, bag: Bag, keep: list[str], name: str = "score", spans: str | None = "offending") -> DataFrame:
    """The columns `keep`, the probability `name` that the whole text is toxic, and `spans` (None: left out): start, length (code points) and probability of the sentences that reach one half. Texts of any length are read whole; null and empty ones score 0 and have no spans; ties and repeated rows get equal results; an empty table gives an empty table; `name` and `spans` must not be among `keep`, other columns may have any name."""
    kept = docs.select(*keep)
    names = list(kept.columns)
    shared = docs.sparkSession.sparkContext.broadcast(bag)
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches):
            got = [model.score(t or "") for t in b.column(len(names)).to_pylist()]
            where = [] if spans is None else [pa.array([[{"start": a, "length": z - a, "score": p} for a, z, p in s] for _, s in got], span)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array([p for p, _ in got], pa.float64()), *where], names=[*names, name, *([spans] if where else [])])

    source = docs.select(*keep, F.col("text").alias("__text"))
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("score", T.DoubleType())]))
    return source.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType()), *([] if spans is None else [T.StructField(spans, kind)])]))
