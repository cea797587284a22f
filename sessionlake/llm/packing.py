"""Best-fit packing with bounded space.

Texts become token ids; longer documents are cut into full sequences and one
shorter first piece. Each task packs the pieces it reads: a fixed number of
bins is open, kept in a bitset keyed by free space. A piece goes into the
fullest bin that still holds it; where none does and all bins are open, the
fullest closes first.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import zip_longest
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import portions, staged

#: A space that white space stands before. It ends no piece of which the ids could be looked up on their own.
BEFORE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "


class Tokens:
    """Ids of texts by byte-level BPE.

    A space after a character that is no white space always starts a new pre-token, so a text's ids are those of its space-separated words, one after the other. Arrow splits a batch of texts and numbers its distinct words; only words that are not known yet meet the encoder. Ids of up to `most` words are kept in arrays that grow by doubling, and numpy puts the texts together. Added tokens of the vocabulary (the .json file beside the ranks) have ids of their own wherever they stand in a text; what stands between them is encoded on its own.
    """

    def __init__(self, ranks_file: str, most: int = 250_000):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks_file).read_bytes().splitlines())}
        self.bpe = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        whole = Path(ranks_file).with_suffix(".json")
        self.added = {x["content"]: x["id"] for x in json.loads(whole.read_bytes())["added_tokens"]} if whole.exists() else {}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)  # bytes of each id
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.of: dict[str, int] = {}
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.ends, self.words = np.zeros(1 << 16, np.int64), 0

    def add(self, words: list[str], whole: bool) -> None:
        """Keeps the ids of new words. Those that start with a space are encoded in one run, which falls into words again by the ids' bytes; `whole`: each on its own."""
        if whole:
            each = [self.bpe.encode_ordinary(w) for w in words]
            ids, stops = np.array([i for x in each for i in x], np.uint32), np.cumsum([len(x) for x in each])
        else:
            ids = np.array(self.bpe.encode_ordinary("".join(words)), np.uint32)
            stops = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(w.encode()) for w in words])) + 1
        stop, last = self.used + len(ids), self.words + len(words)
        if stop > len(self.ids):
            self.ids = np.resize(self.ids, 2 * stop)
        if last >= len(self.ends):
            self.ends = np.resize(self.ends, 2 * last)
        self.ids[self.used : stop] = ids
        self.ends[self.words + 1 : last + 1] = self.used + stops
        self.of.update(zip(words, range(self.words, last), strict=True))
        self.used, self.words = stop, last

    def numbers(self, words: list[str], whole: bool = False) -> np.ndarray:
        got = list(map(self.of.get, words))
        if None in got:
            self.add(list(dict.fromkeys(w for w, k in zip(words, got, strict=True) if k is None)), whole)
            got = list(map(self.of.__getitem__, words))
        return np.array(got, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, as unsigned 32-bit numbers, and where each text ends. A null text counts as empty."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, BEFORE)
        for mark in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, mark))
        apart = {i: self.one(texts[i].as_py()) for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist()}
        if self.words > self.most:
            self.forget()
        split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        names = split.flatten().dictionary_encode()
        offsets -= offsets[0]
        # the first word of a text has no space before it; an empty one is nothing
        rest = self.numbers(pc.binary_join_element_wise(" ", names.dictionary, "").to_numpy(zero_copy_only=False).tolist())
        k = rest[names.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)
        at = offsets[:-1]
        k[at] = self.numbers(names.dictionary.take(names.indices.take(pa.array(at))).to_pylist(), True)
        lo = self.ends[k]
        n = self.ends[k + 1] - lo
        stop = np.cumsum(n)
        ids = self.ids[np.arange(int(stop[-1]) if len(n) else 0) + np.repeat(lo - (stop - n), n)]
        ends = stop[offsets[1:] - 1] if len(texts) else stop
        if apart:
            parts = [apart[i] if i in apart else ids[a:b] for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))]
            return np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return ids, ends

    def one(self, text: str) -> np.ndarray:
        """Ids of one text that words cannot be looked up for."""
        ids: list[int] = []
        marks = [self.added[m] for m in self.marks.findall(text)]
        for part, mark in zip_longest(self.marks.split(text), marks):
            ids += self.bpe.encode_ordinary(part)
            if mark is not None:
                ids.append(mark)
        return np.array(ids, np.uint32)


@lru_cache(maxsize=1)
def tokens(ranks_file: str) -> Tokens:
    return Tokens(ranks_file)


class Packer:
    """Open bins by free space. Each call of put() gives (bin, offset)."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bits, self.bins, self.open, self.made = 0, {}, 0, 0

    def put(self, n: int) -> tuple[int, int]:
        fit = self.bits >> n
        if fit and n:
            free = n + (fit & -fit).bit_length() - 1
            bin_ = self.pop(free)
        else:
            if self.open >= self.most:
                self.pop((self.bits & -self.bits).bit_length() - 1)
            free, bin_, self.made = self.size, self.made, self.made + 1
        left = free - n
        if left:
            self.bins.setdefault(left, []).append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.size - free

    def pop(self, free: int) -> int:
        bins = self.bins[free]
        bin_ = bins.pop()
        self.open -= 1
        if not bins:
            self.bits &= ~(1 << free)
        return bin_


def pieces(docs: DataFrame, size: int = 1024, end: int = 2, ranks_file: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces: its ids, then `end`. Up to `size` ids are one piece; more are cut into pieces of `size`, of which the first may be shorter. A null text counts as empty: one piece that holds `end` alone. Repeated rows each give pieces."""
    file = ranks_file or str(public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens(file)
        for b in portions(batches, 1):
            ids, ends = bpe.encode(b.column(1))
            n = np.diff(ends, prepend=0) + 1
            ids = np.insert(ids, ends, end)  # each text, then its end
            first, count = (n - 1) % size + 1, (n - 1) // size + 1
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = np.where(piece > 0, first[row] + (piece - 1) * size, 0)
            length = np.where(piece > 0, size, first[row])
            raw, at = memoryview(ids.astype("<u4").tobytes()), 4 * (np.repeat(np.cumsum(n) - n, count) + start)
            crc = [zlib.crc32(raw[i : i + k]) for i, k in zip(at.tolist(), (4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    fields = [docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def pack(cut: DataFrame, size: int = 1024, open_bins: int = 4096, per_task: int = 50_000) -> DataFrame:
    """Adds sequence_id and offset to pieces. Each task packs about `per_task` pieces that a hash of their place has dealt to it, so what stays unfilled is at most the open bins of each task."""
    parts = max(1, -(-cut.count() // per_task))
    names = [*cut.columns, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, task = Packer(size, open_bins), None
        for b in batches:
            if b.num_rows == 0:
                continue
            if task is None:
                task = b.column(b.num_columns - 1)[0].as_py()
            got = np.array([packer.put(n) for n in b.column(3).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array((np.int64(task) << 40) + got[:, 0]), pa.array(got[:, 1])], names=names)

    dealt = cut.repartition(parts, F.xxhash64(*[c for c in cut.columns if c in ("doc_id", "piece", "start", "length", "ids_crc32")])).sortWithinPartitions(F.desc("length"), "doc_id", "piece").withColumn("task", F.spark_partition_id())
    fields = [*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return dealt.mapInArrow(run, T.StructType(fields))


def packed(docs: DataFrame, size: int = 1024, end: int = 2, open_bins: int = 4096, ranks_file: str | None = None) -> DataFrame:
    """Pieces of all documents with their places. An empty table gives an empty table; columns other than doc_id and text are ignored."""
    return pack(staged(pieces(docs, size, end, ranks_file), "pieces"), size, open_bins)
