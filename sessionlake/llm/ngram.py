"""Language-model scoring with sharded Elias-Fano n-gram tries.

The model is a trigram model learnt from all training rows. Unigrams are
add-one smoothed; bigrams and trigrams seen at least twice are kept, with
absolute discounting, and interpolated with the shorter context. Its size grows
with the corpus, so it is never gathered in one place:

1. Each task turns its texts into blocks: numbers of words, and a word list.
2. Word lists are dealt by word hash; a word shard adds up the counts of its
   words and answers each block with counts and global numbers. Numbers rise
   as words get rarer.
3. Each block computes its unigram sums and deals its word triples by the
   middle word (the nearest context).
4. A context shard builds its trie from the training triples and scores all
   triples with it; sums by document go back to their block.
5. A context so frequent that it would fill shards by itself is counted instead:
   each block asks with its distinct n-grams and their counts, bigrams dealt by
   parts of the context's successors, trigrams by their first two words. Shards
   add up the counts of all blocks and answer with them and with the masses of
   what is kept; each block, numbered again, puts the same probabilities together from these as
   a trie over the whole corpus would hold.

In a trie, each level is a monotone sequence in Elias-Fano coding: contexts,
pointers, and successors. A trigram's last word is stored as its place among
the successors of the bigram context, so it is looked up relative to it.
Probabilities and back-off weights are 16-bit codes. Levels are laid out in one
memory-mapped file that vanishes with its task.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import bucketed, slices, staged

#: Codes are -log10(p) in steps of 1 / STEP, up to 16.
STEP = 4095
RARE, START = 0, 1  # numbers of all words seen less than twice, and of what stands before the first word
DISCOUNT = 0.75


def code(p: np.ndarray) -> np.ndarray:
    return np.round(np.clip(-np.log10(np.maximum(p, 1e-300)), 0, 16) * STEP).astype(np.uint16)


def prob(c: np.ndarray) -> np.ndarray:
    return 10.0 ** (-c.astype(np.float64) / STEP)


def pack(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes, in which the rarely used high bytes cost little."""
    return zstandard.ZstdCompressor(level=5).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"")


def unpack(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def select(words: np.ndarray, before: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Positions of the k-th set bits (from 0) of big-endian 64-bit words; before: set bits ahead of each word."""
    at = np.searchsorted(before, k, "right") - 1
    x, r = words[at].astype(np.uint64), (k - before[at]).astype(np.uint64)
    out = np.zeros(len(k), np.uint64)
    for half in (32, 16, 8, 4, 2, 1):
        # the upper half of what is left, then the side that holds the bit
        high = x >> np.uint64(64 - half)
        n = np.bitwise_count(high).astype(np.uint64)
        right = r >= n
        r = np.where(right, r - n, r)
        out += np.where(right, np.uint64(half), np.uint64(0))
        x = np.where(right, x << np.uint64(half), x)
    return at * 64 + out.astype(np.int64)


class EliasFano:
    """A monotone sequence: low bits packed, high bits as unary gaps. Values are read and searched in bulk where they lie; only bit counts by 64-bit word are kept beside them."""

    def __init__(self, values: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None, n: int = 0, bits: int = 0):
        if low is None:
            v = values.astype(np.uint64)
            n = len(v)
            bits = min(56, max(0, int((int(v[-1]) + 1) // n).bit_length() - 1)) if n else 0
            low = self.bit_rows(v, bits)
            unary = np.zeros(-(-(n + (int(v[-1]) >> bits) + 1) // 64) * 64 if n else 0, np.uint8)
            unary[(v >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
            high = np.packbits(unary)
        self.low, self.high, self.n, self.bits = low, high, n, bits
        self.words = high.view(">u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.ones = np.cumsum(ones) - ones
        self.zeros = np.arange(len(ones)) * 64 - self.ones

    @staticmethod
    def bit_rows(v: np.ndarray, bits: int) -> np.ndarray:
        """The low bits of all values, one after the other, highest bit first; 8 bytes follow, so that any value lies within 8 bytes."""
        parts = [np.packbits(((v[i : i + 65536, None] >> np.arange(bits, dtype=np.uint64)[::-1]) & np.uint64(1)).astype(np.uint8)) for i in range(0, len(v), 65536)] if bits else []
        return np.concatenate([*parts, np.zeros(8, np.uint8)])

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        eight = self.low[(at >> 3)[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)
        return (eight << (at & 7).astype(np.uint64)) >> np.uint64(64 - self.bits)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at many places."""
        high = select(self.words, self.ones, i) - i
        return (high << self.bits) | self.lows(i).astype(np.int64)

    def decode(self) -> np.ndarray:
        """All values, in order."""
        return self.get(np.arange(self.n))

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of many values, -1 where there is none: the high bits give the few successors to search, whose low bits are compared by halving."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        top = int(self.get(np.array([self.n - 1]))[0])
        on = np.flatnonzero((values >= 0) & (values <= top))
        high = values[on] >> self.bits
        # the h-th zero ends the run of values with high part h
        end = select(~self.words.astype(np.uint64), self.zeros, np.maximum(high - 1, 0)) + 1 - high
        lo = np.where(high > 0, end, 0)
        last = int(top >> self.bits)
        hi = np.where(high < last, select(~self.words.astype(np.uint64), self.zeros, np.minimum(high, max(last - 1, 0))) - high, self.n) if last else np.full(len(on), self.n)
        want, stop = (values[on] & ((1 << self.bits) - 1)).astype(np.uint64), hi.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            less = self.lows(mid) < want[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
        got = np.flatnonzero(lo < stop)
        same = self.lows(lo[got]) == want[got]
        out[on[got[same]]] = lo[got[same]]
        return out


class Trie:
    """Bigrams and trigrams of one shard, as levels in a memory-mapped file."""

    NAMES = ("contexts", "pointers", "words", "pairs", "thirds")

    def __init__(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, base: np.ndarray, min_count: int = 2):
        """From the training triples and the codes of their last words' unigram probabilities."""
        order = np.lexsort((w3, w2))
        w1, w2, w3, base = (x[order].astype(np.int64) for x in (w1, w2, w3, base))
        ctx, start, total = np.unique(w2, return_index=True, return_counts=True)
        at = np.repeat(np.arange(len(ctx)), total)
        new = np.concatenate([[True], (np.diff(at) != 0) | (np.diff(w3) != 0)])[: len(w2)]
        gram = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        count = np.bincount(gram, minlength=len(first))
        kept = (count >= min_count) & (w3[first] != RARE)
        # contexts without a kept bigram tell nothing that the unigrams do not
        mass = np.bincount(at[first][kept], weights=count[kept] - DISCOUNT, minlength=len(ctx))
        live = mass > 0
        place = np.cumsum(live) - 1
        self.span = int(max(w3.max(initial=0), w1.max(initial=0))) + 1
        left = 1 - mass / np.maximum(total, 1)
        k = first[kept]
        p2 = (count[kept] - DISCOUNT) / total[at[k]] + left[at[k]] * prob(base[k])
        words = place[at[k]] * self.span + w3[k]
        pointers = np.searchsorted(place[at[k]], np.arange(live.sum() + 1))
        # trigrams over kept bigrams; a pair context is (place of w2, w1)
        row_of = np.full(len(first), -1)
        row_of[kept] = np.arange(kept.sum())
        use = live[at] & (w1 != RARE)
        pair_key = place[at[use]] * self.span + w1[use]
        pairs, pair_at, pair_total = np.unique(pair_key, return_inverse=True, return_counts=True)
        row = row_of[gram[use]]
        self.reach = int(np.max(np.diff(pointers), initial=0)) + 1
        full = pair_at[row >= 0] * self.reach + (row[row >= 0] - pointers[place[at[use]][row >= 0]])
        thirds, t_first, t_count = np.unique(full, return_index=True, return_counts=True)
        good = t_count >= min_count
        thirds, t_row, t_count = thirds[good], row[row >= 0][t_first[good]], t_count[good]
        owner = thirds // self.reach
        p_mass = np.bincount(owner, weights=t_count - DISCOUNT, minlength=len(pairs))
        p_live = p_mass > 0
        p_place = np.cumsum(p_live) - 1
        p_left = 1 - p_mass / np.maximum(pair_total, 1)
        q2 = code(p2)
        p3 = (t_count - DISCOUNT) / pair_total[owner] + p_left[owner] * prob(q2[t_row])
        levels = [EliasFano(x) for x in (ctx[live], pointers, words, pairs[p_live], p_place[owner] * self.reach + thirds % self.reach)]
        self.open(levels, [q2, code(left[live]), code(p3), code(p_left[p_live])])

    def open(self, levels: list[EliasFano], codes: list[np.ndarray]) -> None:
        """Lays the levels out in an unlinked temporary file and maps it."""
        arrays = [a for e in levels for a in (e.low, e.high)] + [c.view(np.uint8) for c in codes]
        ends = np.cumsum([len(a) + (-len(a) % 8) for a in arrays])
        self.bytes = int(ends[-1])
        with tempfile.TemporaryFile() as f:
            for a in arrays:
                f.write(a.tobytes() + bytes(-len(a) % 8))
            f.write(b"\0")
            f.flush()
            m = np.memmap(f, np.uint8, "r")
        got = [m[int(z) - len(a) - (-len(a) % 8) : int(z) - (-len(a) % 8)] for a, z in zip(arrays, ends, strict=True)]
        for i, (name, e) in enumerate(zip(self.NAMES, levels, strict=True)):
            setattr(self, name, EliasFano(np.zeros(0), got[2 * i], got[2 * i + 1], e.n, e.bits))
        self.p2, self.left2, self.p3, self.left3 = (g.view(np.uint16) for g in got[10:])

    def score(self, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, base: np.ndarray) -> np.ndarray:
        """log10 probabilities of many triples. Each level is searched in the mapped file, once for each different context, bigram and pair."""
        w1, w2, w3 = (x.astype(np.int64) for x in (w1, w2, w3))

        def find(level: EliasFano, value: np.ndarray) -> np.ndarray:
            distinct, at = np.unique(value, return_inverse=True)
            return level.find(distinct)[at]

        out = -base.astype(np.float64) / STEP
        ctx = find(self.contexts, w2)
        on = np.flatnonzero(ctx >= 0)
        if not len(on):
            return out
        c = ctx[on]
        out[on] -= self.left2[c] / STEP
        row = find(self.words, np.where((w3[on] < self.span) & (w3[on] != RARE), c * self.span + w3[on], -1))
        hit = row >= 0
        out[on[hit]] = -self.p2[row[hit]].astype(np.float64) / STEP
        pair = find(self.pairs, np.where((w1[on] < self.span) & (w1[on] != RARE), c * self.span + w1[on], -1))
        two = pair >= 0
        out[on[two]] -= self.left3[pair[two]] / STEP
        both = two & hit
        # the word's place among the successors of the bigram context
        rel = row[both] - self.pointers.get(c[both])
        third = find(self.thirds, pair[both] * self.reach + rel)
        seen = third >= 0
        out[on[both][seen]] = -self.p3[third[seen]].astype(np.float64) / STEP
        return out


def bundle(kind: int, number: int, *arrays: np.ndarray, rising: tuple[int, ...] = ()) -> bytes:
    """A message of one kind: a number and packed arrays. Arrays at the places `rising` go as differences (modulo 2^32), which are small where they are sorted."""
    packed = [pack(np.diff(x, prepend=x.dtype.type(0)) if i in rising else x) for i, x in enumerate(arrays)]
    return bytes([kind]) + np.array([number, *map(len, packed)], np.int64).tobytes() + b"".join(packed)


def unbundle(data: bytes, *types: type, rising: tuple[int, ...] = ()) -> tuple[int, list[np.ndarray]]:
    head = np.frombuffer(data, np.int64, len(types) + 1, 1)
    ends = 9 + 8 * len(types) + np.cumsum(head[1:])
    arrays = [unpack(data[int(z - n) : int(z)], k) for z, n, k in zip(ends, head[1:], types, strict=True)]
    return int(head[0]), [np.cumsum(x, dtype=x.dtype) if i in rising else x for i, x in enumerate(arrays)]


#: Kinds of messages: triples for a trie, sums by document, bigrams and trigrams of frequent contexts (questions and answers).
TRIPLES, SUMS, BIGRAMS, TRIGRAMS = range(4)
#: Which arrays of these messages are sorted, one within the other.
SORTED = {TRIPLES: (1, 2), BIGRAMS: (0, 1), TRIGRAMS: (0, 1)}


def mixed(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    return (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before it."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def questions(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, doc: np.ndarray, learns: np.ndarray, base: np.ndarray, uses: np.ndarray, shards: int, shard_tokens: int) -> tuple[list[tuple[int, int, list[np.ndarray]]], list[np.ndarray]]:
    """(shard, kind, arrays) of a block's triples after frequent contexts, which have `uses` uses in training, and what puts the answers together. The codes `base` count for last words other than RARE."""
    out = []
    ctx, first, at = np.unique(w2, return_index=True, return_inverse=True)
    total = uses[first].astype(np.int64)
    parts = 1 + 2 * total // shard_tokens
    # every shard that holds a part of a context is asked for the part's mass, by a bigram that ends in RARE
    c = np.repeat(np.arange(len(ctx)), parts)
    part = np.arange(len(c)) - np.repeat(np.cumsum(parts) - parts, parts)
    lead = np.unique((mixed(ctx[c], part) % np.uint64(shards)).astype(np.int64) * len(ctx) + c)
    known = np.flatnonzero(w3 != RARE)
    grams, g_first, g_at = np.unique(w2[known].astype(np.uint64) << np.uint64(32) | w3[known], return_index=True, return_inverse=True)
    g_ctx, g_w3 = at[known[g_first]], w3[known[g_first]]
    g_to = mixed(ctx[g_ctx], mixed(g_w3) % parts[g_ctx].astype(np.uint64)) % np.uint64(shards)
    e_to = np.concatenate([lead // len(ctx), g_to.astype(np.int64)])
    e_ctx = np.concatenate([lead % len(ctx), g_ctx])
    e_w3 = np.concatenate([np.zeros(len(lead), np.uint32), g_w3])
    e_n = np.concatenate([np.zeros(len(lead), np.uint32), np.bincount(g_at, weights=learns[known], minlength=len(grams)).astype(np.uint32)])
    e_base = np.concatenate([np.zeros(len(lead), np.uint16), base[known[g_first]]])
    order = np.lexsort((e_w3, e_ctx, e_to))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    e_to, e_ctx, e_w3, e_n, e_base = (x[order] for x in (e_to, e_ctx, e_w3, e_n, e_base))
    entry = np.empty(len(w3), np.uint32)  # of each triple's bigram
    entry[known] = place[len(lead) + g_at]
    some = np.empty(len(ctx), np.int64)
    some[lead % len(ctx)] = place[: len(lead)]
    entry[w3 == RARE] = some[at[w3 == RARE]]
    del grams, g_at, known, at
    edge = np.searchsorted(e_to, np.arange(shards + 1))
    for s in range(shards):
        i = slice(edge[s], edge[s + 1])
        if edge[s] < edge[s + 1]:
            out.append((s, BIGRAMS, [ctx[e_ctx[i]], e_w3[i], e_n[i]]))
    # trigrams; those whose first word is RARE stand last and are not asked for
    to = np.where(w1 == RARE, shards, (mixed(w2, w1.astype(np.uint64) + np.uint64(1)) % np.uint64(shards)).astype(np.int64)).astype(np.uint32)
    order = np.lexsort((w3, w1, w2, to))
    new = changes(*(x[order] for x in (to, w2, w1, w3)))
    which = np.empty(len(order), np.uint32)
    which[order] = np.cumsum(new) - 1
    n = np.bincount(which, weights=learns).astype(np.uint32)
    t = order[new]
    del order, new
    edge = np.searchsorted(to[t], np.arange(shards + 1, dtype=np.uint32))
    for s in range(shards):
        i = t[edge[s] : edge[s + 1]]
        if len(i):
            out.append((s, TRIGRAMS, [w1[i], w2[i], w3[i], n[edge[s] : edge[s + 1]]]))
    asked = t[: edge[shards]]
    pair = changes(to[asked], w2[asked], w1[asked])
    return out, [total, e_ctx, e_w3 == RARE, e_base, entry[t], pair, which]


def bigram_answers(asked: list[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """For each question (w2, w3, counts): the counts of all questions, or the part's kept count for a bigram that ends in RARE, of which also how many bigrams are kept."""
    w2, w3, n = (np.concatenate(x) for x in zip(*asked, strict=True))
    grams, at = np.unique(w2.astype(np.uint64) << np.uint64(32) | w3, return_inverse=True)
    count = np.bincount(at, weights=n).astype(np.int64)
    ctx = np.cumsum(changes(grams >> np.uint64(32))) - 1
    kept = (count >= 2) & ((grams & np.uint64(0xFFFFFFFF)) != RARE)
    mass, kinds = (np.bincount(ctx, weights=x).astype(np.uint64) for x in (np.where(kept, count, 0), kept))
    lo = 0
    for _, last, _ in asked:
        g = at[lo : lo + len(last)]
        lo += len(last)
        yield [np.where(last == RARE, mass[ctx[g]], count[g].astype(np.uint64)), kinds[ctx[g[last == RARE]]]]


def trigram_answers(asked: list[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """For each question (w1, w2, w3, counts): the kept counts of all questions, and for each of its pairs (w1, w2) the uses, the kept count and how many trigrams are kept."""
    w1, w2, w3, n = (np.concatenate(x) for x in zip(*asked, strict=True))
    order = np.lexsort((w3, w1, w2))
    at = np.empty(len(order), np.int64)
    new = changes(w2[order], w1[order], w3[order])
    at[order] = np.cumsum(new) - 1
    first = order[new]
    count = np.bincount(at, weights=n).astype(np.int64)
    pair = np.cumsum(changes(w2[first], w1[first])) - 1
    count_kept = np.where((count >= 2) & (w3[first] != RARE), count, 0).astype(np.uint64)
    total, mass, kinds = (np.bincount(pair, weights=x).astype(np.uint64) for x in (count, count_kept, count_kept > 0))
    total[kinds == 0] = 0
    lo = 0
    for a, b, _, _ in asked:
        t = at[lo : lo + len(a)]
        lo += len(a)
        p = pair[t[changes(b, a)]]
        yield [count_kept[t], total[p], mass[p], kinds[p]]


def put_together(kept: list[np.ndarray], doc: np.ndarray, docs: int, bigrams: list[bytes], trigrams: list[bytes]) -> np.ndarray:
    """Sums by document of a block's triples after frequent contexts, in steps, from the layout of its questions and the answers of all shards."""

    def joined(messages: list[bytes], n: int) -> list[np.ndarray]:
        got = sorted((unbundle(m, *[np.uint64] * n) for m in messages), key=lambda x: x[0])
        return [np.concatenate([np.zeros(0, np.int64), *(g[k].astype(np.int64) for _, g in got)]) for k in range(n)]

    total, ctx, lead, base, entry, pair, which = kept
    count, kinds = joined(bigrams, 2)
    mass = np.bincount(ctx[lead], weights=count[lead], minlength=len(total)) - DISCOUNT * np.bincount(ctx[lead], weights=kinds, minlength=len(total))
    left = 1 - mass / np.maximum(total, 1)
    have = (count >= 2) & ~lead
    q2 = code((count - DISCOUNT) / total[ctx] + left[ctx] * prob(base))
    cost = np.where(have, q2, code(left)[ctx].astype(np.int64) + base)
    count, uses, mass, kinds = joined(trigrams, 4)
    left = 1 - (mass - DISCOUNT * kinds) / np.maximum(uses, 1)
    of = np.cumsum(pair, dtype=np.int64) - 1
    out = cost[entry]
    out[: len(of)] = np.where(count >= 2, code((count - DISCOUNT) / np.maximum(uses, 1)[of] + left[of] * prob(q2[entry[: len(of)]])), out[: len(of)] + code(left)[of])
    return -np.bincount(doc, weights=out[which], minlength=docs).astype(np.int64)


@dataclass
class Block:
    """A block's triples in global numbers, by token, and its sums by document."""

    words: np.ndarray  # of each document, without the end
    learns: np.ndarray
    doc: np.ndarray
    w1: np.ndarray
    w2: np.ndarray
    w3: np.ndarray
    codes: np.ndarray  # of the last word's unigram probability
    uses: np.ndarray  # of the context, in training
    hot: np.ndarray  # after a context that is too frequent for one shard
    known: np.ndarray
    base: np.ndarray
    alone: np.ndarray  # codes of what needs no shard

    def questions(self, shards: int, shard_tokens: int) -> tuple[list[tuple[int, int, list[np.ndarray]]], list[np.ndarray]]:
        h = self.hot
        return questions(self.w1[h], self.w2[h], self.w3[h], self.doc[h], self.learns[self.doc[h]], self.codes[h], self.uses[h], shards, shard_tokens)


class Numbers(dict):
    """Words to numbers, in the order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks_of(docs: DataFrame, learn: Column, block_bytes: int) -> DataFrame:
    """One row for each block of texts: doc_id (list), learns (list), words (counts of words by document), tokens (numbers of all words), hashes, tops (their upper 16 bits) and counts (of the word list; counts in training rows; the last entry is the end of a text)."""
    kind = docs.schema["doc_id"].dataType

    def close(ids: list, learns: list[bool], rows: list[np.ndarray], names: Numbers) -> dict:
        tokens = np.concatenate([*rows, np.zeros(0, np.uint32)]).astype(np.uint32)
        sizes = np.array([len(r) for r in rows], np.int64)
        train = np.repeat(np.array(learns, bool), sizes)
        total, known = np.bincount(tokens, minlength=len(names)), np.bincount(tokens[train], minlength=len(names))
        order = np.argsort(-total, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        hashes = np.append(np.array([xxhash.xxh3_64_intdigest(w) for w in names] or [], np.uint64)[order], np.uint64(xxhash.xxh3_64_intdigest(b"\n")))
        return {"doc_id": ids, "learns": learns, "words": sizes, "tokens": pack(rank[tokens]), "hashes": pack(hashes), "tops": pack((hashes >> np.uint64(48)).astype(np.uint16)), "counts": pack(np.append(known[order], sum(learns)).astype(np.uint32)), "n": len(names) + 1}

    schema = T.StructType([T.StructField("doc_id", T.ArrayType(kind)), T.StructField("learns", T.ArrayType(T.BooleanType())), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("tokens", T.BinaryType()), T.StructField("hashes", T.BinaryType()), T.StructField("tops", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("n", T.LongType())])
    types = [("learns", pa.list_(pa.bool_())), ("words", pa.list_(pa.int64())), ("tokens", pa.binary()), ("hashes", pa.binary()), ("tops", pa.binary()), ("counts", pa.binary()), ("n", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, learns, rows, names, size, id_type = [], [], [], Numbers(), 0, None

        def flush() -> pa.RecordBatch:
            got = close(ids, learns, rows, names)
            return pa.RecordBatch.from_arrays([pa.array([got["doc_id"]], pa.list_(id_type)), *(pa.array([got[n]], t) for n, t in types)], names=["doc_id", *(n for n, _ in types)])

        for b in slices(batches):
            id_type = b.column(0).type
            for i, t, y in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = (t or b"").lower().split()
                ids.append(i)
                learns.append(bool(y))
                rows.append(np.fromiter(map(names.__getitem__, found), np.uint32, len(found)))
                size += len(t or b"")
                if size >= block_bytes:
                    yield flush()
                    ids, learns, rows, names, size = [], [], [], Numbers(), 0
        if ids:
            yield flush()

    return docs.select("doc_id", "text", learn.alias("learns")).mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())


def score(docs: DataFrame, learn: Column, block_bytes: int = 8 << 20, shard_words: int = 1_000_000, shard_tokens: int = 700_000) -> DataFrame:
    """One row for each row of docs: doc_id, learns, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text under the unigram model and under the trie).

    The model learns from the rows where `learn` holds (null: does not). A null text is empty: its one token is the end. Repeated rows each count and are each scored; without training rows every word has the same probability; an empty table gives an empty table; columns other than doc_id and text (and those of `learn`) are ignored.
    """
    blocks = bucketed(blocks_of(docs, learn, block_bytes), "lm-blocks", "block")
    size = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("tokens")).first()
    word_shards, shards = min(1 << 16, max(1, -(-size.words // shard_words))), max(1, -(-size.tokens // shard_tokens))

    def shard_of(top: np.ndarray) -> np.ndarray:
        """The word shard of each word, by the upper 16 bits of its hash."""
        return top.astype(np.int64) * word_shards >> 16

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            h, n = unpack(b.column(1)[0].as_py(), np.uint64), unpack(b.column(2)[0].as_py(), np.uint32)
            to = shard_of(h >> np.uint64(48))
            for s in range(word_shards):
                mine = to == s
                if mine.any():
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), b.column(0), pa.array([pack(h[mine])], pa.binary()), pa.array([pack(n[mine])], pa.binary())], names=["shard", "block", "hashes", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        s = table["shard"][0].as_py()
        h = [unpack(x.as_py(), np.uint64) for x in table["hashes"]]
        n = [unpack(x.as_py(), np.uint32) for x in table["counts"]]
        _, at = np.unique(np.concatenate(h), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(n)).astype(np.int64)
        rank = np.empty(len(total), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        number = np.where(total > 1, rank * word_shards + s + 2, RARE).astype(np.uint32)
        stop = np.cumsum([len(x) for x in h])
        parts = [at[b - len(x) : b] for x, b in zip(h, stop, strict=True)]
        out = {"block": [-1, *table["block"].to_pylist()], "shard": [s] * (len(parts) + 1), "counts": [b"", *(pack(total[p].astype(np.uint64)) for p in parts)], "numbers": [b"", *(pack(number[p]) for p in parts)], "sum": [int(total.sum()), *[0] * len(parts)], "kinds": [int((total > 0).sum()), *[0] * len(parts)]}
        return pa.table(out, schema=pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("counts", pa.binary()), ("numbers", pa.binary()), ("sum", pa.int64()), ("kinds", pa.int64())]))

    asked = blocks.select("block", "hashes", "counts").mapInArrow(ask, "shard int, block long, hashes binary, counts binary")
    answers = staged(asked.groupBy("shard").applyInArrow(answer, "block long, shard int, counts binary, numbers binary, sum long, kinds long"), "lm-words")
    totals = answers.agg(F.coalesce(F.sum("sum"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).first()
    n_train, divisor = totals.n, totals.n + totals.v + 1
    id_type = docs.schema["doc_id"].dataType
    lists = [("learns", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType())]

    def numbered(row: pa.Table, words: list[tuple[int, bytes, bytes]]) -> Block:
        """A block from its row and the answers of the word shards."""
        to = shard_of(unpack(row["tops"][0].as_py(), np.uint16))
        count, number = np.zeros(len(to), np.int64), np.zeros(len(to), np.uint32)
        for s, c, m in words:
            mine = to == s
            count[mine], number[mine] = unpack(c, np.uint64).astype(np.int64), unpack(m, np.uint32)
        learns, words = np.array(row["learns"][0].as_py(), bool), np.array(row["words"][0].as_py(), np.int64)
        # each document's words, then the end
        stop = np.cumsum(words + 1)
        local = np.full(int(stop[-1]), len(to) - 1, np.int64)
        inner = np.ones(len(local), bool)
        inner[stop - 1] = False
        local[inner] = unpack(row["tokens"][0].as_py(), np.uint32)
        doc = np.repeat(np.arange(len(words), dtype=np.int32), words + 1)
        c, w3 = count[local], number[local]
        log_p = np.log10((c + 1) / divisor)
        begins = stop - words - 1
        w2 = np.concatenate([[START], w3[:-1]]).astype(np.uint32)
        w2[begins] = START
        w1 = np.concatenate([[RARE], w2[:-1]]).astype(np.uint32)
        w1[begins] = RARE
        codes = code(10.0**log_p)
        uses = np.concatenate([[0], c[:-1]])
        uses[begins] = count[-1]
        hot = (2 * uses >= shard_tokens) & (w2 != RARE)
        # after a rare word only the unigram counts, and so it does for a rare word after a frequent context (to which put_together adds the rest)
        alone = np.bincount(doc, weights=np.where((w2 == RARE) | (hot & (w3 == RARE)), codes, 0), minlength=len(words))
        known = np.bincount(doc, weights=c > 0, minlength=len(words)).astype(np.int64)
        return Block(words, learns, doc, w1, w2, w3, codes, uses, hot, known, np.bincount(doc, weights=log_p, minlength=len(words)), alone)

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        """The triples of a block by context shard."""
        head = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("triples", pa.binary())])
        if not left.num_rows:
            return head.empty_table()
        block = left["block"][0].as_py()
        b = numbered(left, list(zip(right["shard"].to_pylist(), right["counts"].to_pylist(), right["numbers"].to_pylist(), strict=True)))
        rows = []
        if b.hot.any():
            rows += [{"shard": s, "block": block, "triples": bundle(kind, s, *arrays, rising=SORTED[kind])} for s, kind, arrays in b.questions(shards, shard_tokens)[0]]
        by = (mixed(b.w2) % np.uint64(shards)).astype(np.uint32)
        order = np.lexsort((b.w3, b.w2, by))
        order = order[(b.w2[order] != RARE) & ~b.hot[order]]
        edge = np.searchsorted(by[order], np.arange(shards + 1, dtype=np.uint32))
        mark = (b.doc * 2 + b.learns[b.doc]).astype(np.uint32)
        for s in range(shards):
            i = order[edge[s] : edge[s + 1]]
            if len(i):
                rows.append({"shard": s, "block": block, "triples": bundle(TRIPLES, len(b.words), *(x[i] for x in (b.w1, b.w2, b.w3, mark, b.codes)), rising=SORTED[TRIPLES])})
        return pa.Table.from_pylist(rows, schema=head)

    def judge(table: pa.Table) -> pa.Table:
        """Builds the shard's trie and gives sums by document for each block, and answers questions about frequent contexts."""
        out, parts, at = [], [], []
        asked: dict[int, list[tuple[int, int, list[np.ndarray]]]] = {BIGRAMS: [], TRIGRAMS: []}
        for block, t in zip(table["block"].to_pylist(), table["triples"].to_pylist(), strict=True):
            if t[0] == TRIPLES:
                docs_in, arrays = unbundle(t, np.uint32, np.uint32, np.uint32, np.uint32, np.uint16, rising=SORTED[TRIPLES])
                parts.append(arrays)
                at.append((block, docs_in))
            else:
                asked[t[0]].append((block, *unbundle(t, *[np.uint32] * (3 if t[0] == BIGRAMS else 4), rising=SORTED[t[0]])))
        if parts:
            w1, w2, w3, mark, base = (np.concatenate(x) for x in zip(*parts, strict=True))
            sizes = [len(p[0]) for p in parts]
            del parts
            train = (mark & 1) > 0
            trie = Trie(w1[train], w2[train], w3[train], base[train])
            steps, lo = np.rint(trie.score(w1, w2, w3, base) * STEP), 0  # whole codes, so sums are exact
            for (block, docs_in), n in zip(at, sizes, strict=True):
                hi = lo + n
                out.append({"block": block, "sums": bundle(SUMS, 0, np.bincount(mark[lo:hi] >> 1, weights=steps[lo:hi], minlength=docs_in).astype(np.int64))})
                lo = hi
            del w1, w2, w3, mark, base, train, trie, steps
        for kind, reply in ((BIGRAMS, bigram_answers), (TRIGRAMS, trigram_answers)):
            mine = asked.pop(kind)
            if mine:
                out += [{"block": block, "sums": bundle(kind, s, *arrays)} for (block, s, _), arrays in zip(mine, reply([x for _, _, x in mine]), strict=True)]
        return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int64()), ("sums", pa.binary())]))

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        """The rows of a block's documents: it is numbered again, which costs less than to move its layout through two shuffles."""
        kind = left.schema.field("doc_id").type.value_type
        head = pa.schema([("doc_id", kind), ("learns", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
        if not left.num_rows:
            return head.empty_table()
        sums = right["sums"].to_pylist()
        b = numbered(left, [(s, c, m) for s, c, m, t in zip(right["shard"].to_pylist(), right["counts"].to_pylist(), right["numbers"].to_pylist(), sums, strict=True) if t is None])
        got: dict[int, list[bytes]] = {SUMS: [], BIGRAMS: [], TRIGRAMS: []}
        for t in sums:
            if t is not None:
                got[t[0]].append(t)
        total = -b.alone.astype(np.int64)
        for t in got[SUMS]:
            total = total + unbundle(t, np.int64)[1][0]
        if b.hot.any():
            total = total + put_together(b.questions(shards, shard_tokens)[1], b.doc[b.hot], len(b.words), got[BIGRAMS], got[TRIGRAMS])
        return pa.table([left["doc_id"].combine_chunks().flatten(), pa.array(b.learns), pa.array(b.words + 1), pa.array(b.known), pa.array(b.base), pa.array(total / STEP)], schema=head)

    answered = answers.where("block >= 0").select("block", "shard", "counts", "numbers")
    kept = blocks.select("block", "doc_id", "learns", "words", "tokens", "tops")
    dealt = kept.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(deal, "shard int, block long, triples binary")
    judged = dealt.groupBy("shard").applyInArrow(judge, "block long, sums binary")
    replies = answered.withColumn("sums", F.lit(None).cast("binary")).unionByName(judged, allowMissingColumns=True)
    again = kept.toDF(*kept.columns)
    rows = again.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(gather, T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, t) for n, t in lists)]))
    return rows.select("doc_id", "learns", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
