"""Language-model scoring by online logistic context mixing.

A text is a sequence of binary decisions.  A word among the ``HEAD`` most frequent
ones and the end of a text go down a Huffman tree, where a leaf of its own stands for
any other word.  Every decision has three hashed contexts with counts of zeros and ones
(its node alone, after the word before, after the last common word).  A gate, the
depth of the decision and how well the contexts are known, selects the weights that
add up the three predictions in the logistic domain; an adaptive map of (place, mixed
prediction) refines the sum.  The product of all decisions is the text's probability.

The other words are as many as the corpus has: their counts stay a distributed table that
the texts' words find by a join.  Such a word has the share of its count; what
Good and Turing leave for words never seen is spelled: the bytes and a zero byte by
a Huffman code, decided in the same way after one, two and four bytes.  The words
seen once, as new ones will be, teach how these look.

Learning: word counts are one Spark sum.  The context counts of all training
texts are summed by partition and added in blocks, in rounds.  Weights and map
are learned online in a pass over all tokens of all training texts, each decision's
own occurrence left out of its counts.  For that pass the texts are dealt by hash into
shards of some ``SHARD_TOKENS`` tokens, whose number follows the corpus and not the
cluster; a shard is learned in the order of its hashes, and the shards' results are
averaged by their size.  So the partitions do not matter.  The context tables grow with
the corpus up to ``MAX_BITS``; beyond that contexts share slots.

Edge cases: null and empty texts are the end token alone; words and texts of any
length; equal rows get equal scores; without training texts the counts are zero
and every decision has probability one half or what the map says; an empty table
gives an empty result; the text itself is not among the columns of the result; other
columns of the input named like an added one are replaced.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import checkpoint, map_batches, release

#: Ranked words (each of at most HEAD_BYTES bytes, which bounds what is sent); rank 0 is any other word, rank 1 the end of a text.
HEAD, HEAD_BYTES = (1 << 17) - 2, 48
MIN_BITS, MAX_BITS, BYTE_BITS = 18, 21, 19
#: The gates' depths of decisions in ranked words, then in spelled ones; the last places of the map are the spelled ones' depths.
RANK_DEPTHS, BYTE_DEPTHS = 32, 16
GATES, MAP_PLACES, MAP_STEPS = (RANK_DEPTHS + BYTE_DEPTHS) * 16, 4096, 25
#: Words of a rank up to this are common; counts start at PRIOR.
COMMON, PRIOR = 40, 0.2
#: Texts are worked on some CHUNK_BYTES together, where equal tokens with equal contexts are worked on once; their
#: decisions in portions that fit a processor's cache.
CHUNK_TOKENS, CHUNK_BYTES, WORD_BYTES, BLOCK, FAN_IN = 8_000, 3_000_000, 20_000, 1 << 16, 64
#: Words are ranked some RANK_BYTES together: each look-up first makes a table of all ranked words.
RANK_BYTES = 12_000_000
COUNT_BYTES = 16_000_000
SHARD_TOKENS = 1_000_000
END = b"\x00"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_LOWER).split()


def slices(column: pa.Array, size: int) -> Iterator[pa.Array]:
    """A column of texts in parts of some ``size`` bytes; no text is cut."""
    parts = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(column)]
    for a, b in zip(edges[:-1], edges[1:]):
        if a < b:
            yield column.slice(a, b - a)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The words of texts in lower case, with the number of the text of each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = lists.flatten()
    real = pc.not_equal(words, "")
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return doc[real.to_numpy(zero_copy_only=False)], words.filter(real)


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [0], np.uint64)


def short_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of up to seven bytes as numbers, bytes and length, which are found far faster than strings; which words these
    are, the others' numbers are zero."""
    ends = np.frombuffer(words.buffers()[1] or bytes(4), np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    length = np.minimum(np.diff(ends), 8)
    raw = np.concatenate([np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    short = length < 8
    return np.where(short, eight[ends[:-1] - ends[0]] & _LOW_BYTES.take(length) | length.astype(np.uint64) << np.uint64(56), np.uint64(0)), short


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of a column of texts, added up in parts of some COUNT_BYTES before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0), COUNT_BYTES):
                yield pa.RecordBatch.from_arrays(split_words(part)[1].value_counts().flatten(), ["word", "c"])
        release()

    return texts.mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def look_up(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The values at places that are all within them: without the test for that, which takes a quarter of the time."""
    return values.take(places, mode="wrap")


def scattered(key: np.ndarray) -> np.ndarray:
    """32 hash bits of 64-bit numbers."""
    key = (key ^ (key >> np.uint64(31))) * _A
    key = (key ^ (key >> np.uint64(29))) * _B
    return (key >> np.uint64(32)).astype(np.uint32)


class Code:
    """A Huffman code: the decisions of symbol s are node[k], bit[k] for k from starts[s], length[s] of them; the root is node 0."""

    def __init__(self, weights: np.ndarray):
        n = len(weights)
        order = np.lexsort((np.arange(n), weights))
        leaves, names, sums, i, j = weights[order].tolist(), order.tolist(), [], 0, 0
        up, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
        for k in range(n - 1):  # the two lightest of the leaves and the nodes made so far
            total = 0
            for bit in (0, 1):
                if i < n and (j >= k or leaves[i] <= sums[j]):
                    item, total, i = names[i], total + leaves[i], i + 1
                else:
                    item, total, j = n + j, total + sums[j], j + 1
                up[item], side[item] = k, bit
            sums.append(total)
        leaf, at, steps = np.arange(n), np.arange(n), []
        while len(leaf):  # from all leaves to the root at once
            k = up[at]
            steps.append((leaf, n - 2 - k, side[at]))
            leaf, at = leaf[k < n - 2], n + k[k < n - 2]
        self.length = np.zeros(n, np.int64)
        for own, _, _ in steps:
            self.length[own] += 1
        self.starts = np.cumsum(self.length) - self.length
        self.node, self.bit = np.zeros(int(self.length.sum()), np.int32), np.zeros(int(self.length.sum()), np.int8)
        for level, (own, node, bit) in enumerate(steps):
            place = self.starts[own] + self.length[own] - 1 - level
            self.node[place], self.bit[place] = node, bit
        self.hash = scattered(self.node.astype(np.uint64) + _C)

    def decisions(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all decisions of the symbols: place in the code's lists, depth, number of the symbol."""
        own = self.length.take(symbols)
        before = np.cumsum(own) - own
        depth = np.arange(int(own.sum())) - np.repeat(before, own)
        return depth + np.repeat(self.starts.take(symbols), own), depth, np.repeat(np.arange(len(symbols)), own)


class Layout:
    """Where the regions of the count table lie: nodes, word before, common word, one byte, two bytes, four bytes."""

    def __init__(self, bits: int):
        self.bits = bits
        sizes = [HEAD + 2, 1 << bits, 1 << bits, 1 << 16, 1 << BYTE_BITS, 1 << BYTE_BITS]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.size = int(self.starts[-1])

    def hashed(self, region: int, key: np.ndarray) -> np.ndarray:
        """Slots of 32-bit hashes."""
        return (key >> np.uint32(32 - (self.bits if region < 3 else BYTE_BITS))) + self.starts[region]


#: Three slots, gate depth, bit, token, place in the map of each decision.
Rows = tuple


class Coder:
    """Turns tokens into decisions."""

    def __init__(self, head: list[bytes], weights: np.ndarray, layout: Layout):
        """``weights`` of the leaves: other words, the end, the words of ``head``."""
        self.head = pa.array(head, pa.string())
        keys, short = short_words(self.head)
        self.short, self.short_rank = pd.Index(keys[short]), np.append(np.flatnonzero(short) + 2, 0)
        self.long, self.long_rank = self.head.filter(pa.array(~short)), np.append(np.flatnonzero(~short) + 2, 0)
        self.layout, self.code = layout, Code(np.maximum(weights, 1))
        self.letters = Code(np.bincount(np.frombuffer(END.join(head) + END, np.uint8), minlength=256) + 1)

    def tokens(self, texts: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """For all tokens of the texts: text number, rank, and code (the rank, or Spark's xxhash64 of a word without
        one); the distinct words without rank, and which one each token without rank is."""
        doc, words = split_words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        return self.coded(len(texts), doc, words, self.ranks(words))

    def ranks(self, words: pa.Array) -> np.ndarray:
        """Ranks of words, 0 for other words."""
        keys, short = short_words(words)
        rank = self.short_rank.take(self.short.get_indexer(keys))
        places = pc.fill_null(pc.index_in(words.filter(pa.array(~short)), self.long), -1).to_numpy(zero_copy_only=False)
        rank[~short] = self.long_rank.take(places)
        return rank

    def portions(self, texts: pa.Array) -> Iterator[tuple]:
        """The tokens of texts, some CHUNK_BYTES of them together, as ``tokens`` gives them; the texts are in front."""
        for some in slices(texts, RANK_BYTES):
            doc, words = split_words(some)
            rank, start = self.ranks(words), 0
            for part in slices(some, CHUNK_BYTES):
                a, b = np.searchsorted(doc, [start, start + len(part)])
                yield part, self.coded(len(part), doc[a:b] - start, words.slice(a, b - a), rank[a:b])
                start += len(part)

    def coded(self, n: int, doc: np.ndarray, words: pa.Array, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """The tokens of ``n`` texts from their words and the words' ranks, 0 for other words."""
        others = words.filter(pa.array(rank == 0)).dictionary_encode()
        kinds, which = raw_bytes(others.dictionary), others.indices.to_numpy(zero_copy_only=False)
        code = rank.astype(np.uint64)
        code[rank == 0] = np.array([xxhash.xxh64_intdigest(w, 42) for w in kinds], np.uint64).take(which)
        at = np.arange(len(doc)) + doc  # every text ends with an end
        all_doc = np.repeat(np.arange(n), np.bincount(doc, minlength=n) + 1)
        all_rank, all_code = np.ones(len(doc) + n, np.int64), np.ones(len(doc) + n, np.uint64)
        all_rank[at], all_code[at] = rank, code
        return all_doc, all_rank, all_code, kinds, which

    def ranked(self, rank: np.ndarray, one: np.ndarray, common: np.ndarray) -> Rows:
        """Decisions of ranks, given the 32-bit hashes of the word before and of the last common word."""
        at, depth, token = self.code.decisions(rank)
        node, key = look_up(self.code.node, at).astype(np.int64), look_up(self.code.hash, at)
        own = self.code.length.take(rank)
        a, b = self.layout.hashed(1, key ^ np.repeat(one, own)), self.layout.hashed(2, key ^ np.repeat(common, own))
        return node, a, b, np.minimum(depth, RANK_DEPTHS - 1), look_up(self.code.bit, at), token, np.minimum(node, MAP_PLACES - BYTE_DEPTHS - 1)

    def spelt(self, words: list[bytes]) -> Rows:
        """Decisions of the bytes of words."""
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        flat = np.frombuffer(END.join(words) + END, np.uint8).astype(np.int64)
        inside = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        back = [np.where(inside >= k, np.concatenate([np.zeros(k, np.int64), flat])[: len(flat)], 0) for k in range(1, 5)]
        at, depth, byte = self.letters.decisions(flat)
        node, key = self.letters.node.take(at).astype(np.int64), self.letters.hash.take(at)
        two = back[0] << 8 | back[1]
        four = two << 16 | back[2] << 8 | back[3]
        depth = np.minimum(depth, BYTE_DEPTHS - 1)
        return (
            self.layout.starts[3] + (back[0].take(byte) << 8 | node), self.layout.hashed(4, key ^ scattered(two.astype(np.uint64)).take(byte)),
            self.layout.hashed(5, key ^ scattered(four.astype(np.uint64) + _B).take(byte)), RANK_DEPTHS + depth, self.letters.bit.take(at),
            np.repeat(np.arange(len(words)), lengths).take(byte), MAP_PLACES - BYTE_DEPTHS + depth,
        )

    @staticmethod
    def contexts(rank: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the hash of the word before and the rank of the last common word."""
        one = np.concatenate([scattered(np.ones(1, np.uint64)), scattered(code)])[: len(code)]  # before the first word of a text stands an end
        # the last common word or end before each token; an end stands for no word yet
        last = np.maximum.accumulate(np.where((rank > 0) & (rank <= COMMON), np.arange(1, len(rank) + 1), 0))
        last = np.concatenate([[0], last])[: len(rank)]
        return one, np.concatenate([[1], rank])[last]

    def distinct(self, rank: np.ndarray, code: np.ndarray, places: bool = True) -> tuple[np.ndarray, ...]:
        """The distinct (rank, hash of the word before, hash of the last common word) of the tokens; for each token which
        one it is (with ``places``, which takes a slower sort), and how many tokens each one has."""
        one, common = self.contexts(rank, code)
        key = rank << 38 | common << 32 | one.astype(np.int64)
        if places:
            key, which, times = np.unique(key, return_inverse=True, return_counts=True)
        else:
            which, (key, times) = None, np.unique(key, return_counts=True)
        return key >> 38, (key & 0xFFFFFFFF).astype(np.uint32), self.common_hash(key >> 32 & 63), which, times

    @staticmethod
    def common_hash(common: np.ndarray) -> np.ndarray:
        return scattered(common.astype(np.uint64) + _A)

    def chunks(self, rank: np.ndarray, one: np.ndarray, common: np.ndarray) -> Iterator[tuple[Rows, np.ndarray]]:
        """The decisions of ranked tokens in bounded portions, with the token number of each."""
        for k in range(0, len(rank), CHUNK_TOKENS):
            part = slice(k, k + CHUNK_TOKENS)
            rows = self.ranked(rank[part], one[part], common[part])
            yield rows, rows[5] + k

    def spelled(self, words: list[bytes]) -> Iterator[tuple[Rows, np.ndarray]]:
        """The decisions of spelled words, some WORD_BYTES of them together, with the word number of each."""
        held, size, start = [], 0, 0
        for k, w in enumerate(words):
            held.append(w)
            size += len(w) + 1
            if size >= WORD_BYTES or k + 1 == len(words):
                rows = self.spelt(held)
                yield rows, rows[5] + start
                held, size, start = [], 0, k + 1


class Counter:
    """Counts the decisions of texts in a table (slot, bit).  A region's counts depend on its own context alone: a word
    before is counted with the rank after it, and ranks after common words are decided once at the end."""

    def __init__(self, coder: Coder):
        self.coder, self.table = coder, np.zeros((coder.layout.size, 2), np.uint32)
        self.flat, self.ranks = self.table.reshape(-1), len(coder.code.length)
        self.pairs = np.zeros((COMMON + 1) * self.ranks, np.uint32)  # by last common word and rank
        self.held: list[np.ndarray] = []

    def add(self, texts: pa.Array) -> None:
        for _, (_, rank, code, _, _) in self.coder.portions(texts):
            one, common = self.coder.contexts(rank, code)
            np.add.at(self.pairs, common * self.ranks + rank, np.uint32(1))
            self.held.append(rank << 32 | one.astype(np.int64))
            if len(self.held) * CHUNK_BYTES >= RANK_BYTES:
                self.words_before()

    def words_before(self) -> None:
        keys, times = np.unique(np.concatenate([np.zeros(0, np.int64), *self.held]), return_counts=True)
        self.held = []
        self.region(1, keys >> 32, (keys & 0xFFFFFFFF).astype(np.uint32), times)

    def region(self, region: int, rank: np.ndarray, context: np.ndarray, times: np.ndarray) -> None:
        code, times = self.coder.code, times.astype(np.uint32)
        for k in range(0, len(rank), CHUNK_TOKENS):
            part = slice(k, k + CHUNK_TOKENS)
            own = code.length.take(rank[part])
            at, _, _ = code.decisions(rank[part])
            if region:
                slot = self.coder.layout.hashed(region, look_up(code.hash, at) ^ np.repeat(context[part], own))
            else:
                slot = look_up(code.node, at).astype(np.int64)
            np.add.at(self.flat, slot * 2 + look_up(code.bit, at), np.repeat(times[part], own))

    def spell(self, words: pa.Array) -> None:
        for part in portions(words):
            for rows, _ in self.coder.spelled(part):
                for k in range(3):
                    np.add.at(self.flat, rows[k] * 2 + rows[4], np.uint32(1))

    def counts(self) -> np.ndarray:
        self.words_before()
        found = np.flatnonzero(self.pairs)
        self.region(2, found % self.ranks, self.coder.common_hash(found // self.ranks), self.pairs[found])
        times = self.pairs.reshape(-1, self.ranks).sum(0, dtype=np.uint32)
        rank = np.flatnonzero(times)
        self.region(0, rank, np.zeros(0, np.uint32), times[rank])
        self.pairs = np.zeros(0, np.uint32)
        return self.table


class Model:
    """The summed counts, the gates' weights and the map."""

    def __init__(self, layout: Layout, counts: np.ndarray | None, weights: np.ndarray | None = None, map_counts: np.ndarray | None = None, others: np.ndarray | None = None):
        """``counts``: zeros and ones of each slot, two bytes each; ``others``: what ``without_own`` makes of them, which is
        all that learning reads."""
        self.layout, self.counts, self.others = layout, None if counts is None else np.ascontiguousarray(counts, np.uint16), others
        self.weights = np.tile([0.4, 0.3, 0.3, 0.0], (GATES, 1)) if weights is None else weights
        self.map_counts = np.zeros((MAP_PLACES * MAP_STEPS, 2)) if map_counts is None else map_counts

    #: 0 to 3, by a slot's number of decisions.
    known = np.array([0, 1, 1, *[2] * 13, 3], np.uint32)

    @classmethod
    def logits(cls, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Of slots with these counts; how well a slot is known stands in the two last bits: one look-up for both."""
        logit = np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))
        return ((logit.view(np.uint32) & np.uint32(0xFFFFFFFC)) | cls.known.take(np.minimum(zeros + ones, 16).astype(np.uint8))).view(np.float32)

    @classmethod
    def without_own(cls, counts: np.ndarray) -> np.ndarray:
        """The logits of all slots for a decision that was a zero, then for one that was a one, each left out of its counts."""
        out = np.empty((2, len(counts)), np.float32)
        for k in range(0, len(counts), BLOCK):
            zeros, ones = counts[k : k + BLOCK].T.astype(np.float32)
            out[0, k : k + BLOCK] = cls.logits(np.maximum(zeros - 1, 0), ones)
            out[1, k : k + BLOCK] = cls.logits(zeros, np.maximum(ones - 1, 0))
        return out

    def freeze(self) -> Model:
        """Makes the tables that scoring reads, in place of the counts."""
        self.logit = self.logits(self.counts[:, 0].astype(np.float32), self.counts[:, 1].astype(np.float32))
        self.columns = [np.ascontiguousarray(self.weights[:, k], np.float32) for k in range(4)]
        middle = (np.arange(MAP_STEPS) - MAP_STEPS // 2) / 1.5
        prior = 1 / (1 + np.exp(-np.tile(middle, MAP_PLACES)))
        p = (self.map_counts[:, 1] + 12 * prior) / (self.map_counts.sum(1) + 12)
        self.map_logit = (np.log(p) - np.log1p(-p)).astype(np.float32)
        self.counts = self.others = self.map_counts = None
        return self

    @staticmethod
    def step(place: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lower of the two map cells around a prediction, and the share of the upper."""
        x = np.clip(z * np.float32(1.5) + np.float32(MAP_STEPS // 2), np.float32(0), np.float32(MAP_STEPS - 1.001))
        low = x.astype(np.int64)
        return place * MAP_STEPS + low, x - low.astype(np.float32)

    def log_probability(self, rows: Rows) -> np.ndarray:
        """Natural logarithm of the probability of each decision's bit."""
        x = [look_up(self.logit, rows[k]) for k in range(3)]
        known = (x[1].view(np.uint32) & np.uint32(3)) << np.uint32(2) | (x[2].view(np.uint32) & np.uint32(3))
        g = rows[3] * 16 + known
        z = look_up(self.columns[3], g)
        for k in range(3):
            z += look_up(self.columns[k], g) * x[k]
        cell, share = self.step(rows[6], z)
        low = look_up(self.map_logit, cell)
        z += low + share * (look_up(self.map_logit, cell + 1) - low)
        z *= np.float32(0.5) - rows[4].astype(np.float32)
        return -(np.maximum(z, 0) + np.log(1 + np.exp(-np.abs(z))))

    def learn(self, rows: Rows, times: np.ndarray, squares: np.ndarray) -> None:
        """One online step of the weights and the map, with the decisions' own occurrences left out; ``times``: how often
        each decision was made."""
        if self.others is None:
            self.others = self.without_own(self.counts)
        bit, size = rows[4].astype(np.float32), self.others.shape[1]
        others, own = self.others.reshape(-1), rows[4].astype(np.int64) * size
        x = [look_up(others, rows[k] + own) for k in range(3)]
        known = rows[3] * 16 + ((x[1].view(np.uint32) & np.uint32(3)) << np.uint32(2) | (x[2].view(np.uint32) & np.uint32(3)))
        columns = self.weights.T.astype(np.float32, order="C")
        z = look_up(columns[3], known)
        for k in range(3):
            z += look_up(columns[k], known) * x[k]
        times = times.astype(np.float32)
        off = np.exp(-np.clip(z, -30, 30))
        off += 1
        np.divide(1, off, out=off)
        np.subtract(bit, off, out=off)
        off *= times
        step = np.stack([*[np.bincount(known, off * x[k], GATES) for k in range(3)], np.bincount(known, off, GATES)], 1)
        squares += step**2
        self.weights += 0.15 * step / np.sqrt(squares + 1e-6)
        cell, share = self.step(rows[6], z)
        flat, upper = self.map_counts.reshape(-1), (share * times).astype(np.float64)
        cell = cell * 2 + rows[4]
        flat += np.bincount(cell, times - upper, len(flat))
        flat[2:] += np.bincount(cell, upper, len(flat))[:-2]


def raw_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null is empty: some ten times as fast as by ``to_pylist``."""
    return column.fill_null("").cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def portions(column: pa.Array) -> Iterator[list[bytes]]:
    """Texts of a column, some CHUNK_BYTES together."""
    held, size = [], 0
    for k in range(0, len(column), 256):
        for raw in raw_bytes(column.slice(k, 256)):
            held.append(raw)
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def decided(coder: Coder, texts: pa.Array, words: pa.Array) -> Iterator[tuple[Rows, np.ndarray]]:
    """The decisions of a batch of rows, texts and words that are spelled, and how often each is made; portions do not
    follow the ranks, for an online learner."""
    for _, tokens in coder.portions(texts.filter(pc.invert(words))):
        rank, one, common, _, times = coder.distinct(*tokens[1:3], places=False)
        parts = -(-len(rank) // CHUNK_TOKENS)  # every portion has words of all ranks
        order = np.concatenate([np.arange(k, len(rank), parts) for k in range(parts)])
        rank, one, common, times = rank[order], one[order], common[order], times[order]
        for rows, owner in coder.chunks(rank, one, common):
            yield rows, times.take(owner)
    for part in portions(texts.filter(words)):
        for rows, owner in coder.spelled(part):
            yield rows, np.ones(len(owner), np.int64)


def pack(values: np.ndarray) -> bytes:
    """Eight bytes a number, or four where all are small whole numbers."""
    kind = np.uint32 if values.max(initial=0) < 1 << 32 and not (values % 1).any() else np.float64
    return (b"u" if kind is np.uint32 else b"f") + zlib.compress(values.astype(kind).tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), np.uint32 if raw[:1] == b"u" else np.float64).astype(np.float64)


def add_up(rows: DataFrame, parts: int) -> DataFrame:
    """Sums (part, block, sums) over parts in their order: FAN_IN arrays of a block at most in one task, in rounds."""

    def add(own: pd.DataFrame) -> pd.DataFrame:
        total = sum((unpack(x) for x in own.sort_values("part")["sums"]), np.float64(0))
        return pd.DataFrame({"part": [own["part"].iat[0] // FAN_IN], "block": [own["block"].iat[0]], "sums": [pack(total)]})

    while parts > 1:
        parts = -(-parts // FAN_IN)
        rows = rows.groupBy(F.expr(f"part div {FAN_IN}"), "block").applyInPandas(add, _SUMS)
    return rows


def learning_tasks(docs: DataFrame) -> tuple[DataFrame, int]:
    """The texts in fewer, longer tasks where there are very many partitions: each sends one table."""
    parts, cores = docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(parts, max(4 * cores, parts // 16)))
    return (docs.coalesce(tasks) if tasks < parts else docs), tasks


_SUMS = "part long, block long, sums binary"
_SUMS_ARROW = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("sums", pa.binary())])


def learn(train: DataFrame, words: DataFrame, coder_of, layout: Layout, tokens: int) -> Model:
    """The model of the training texts (``text``, and ``key``: a hash that spreads them) and of the words to be
    spelled (one column); ``coder_of`` makes the coder; ``tokens``: how many the texts have."""
    spelled = words.select(F.col(words.columns[0]).alias("text"), F.lit(True).alias("word"))
    counted, tasks = learning_tasks(train.select("text", F.lit(False).alias("word")).unionByName(spelled))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(coder_of())
        for batch in batches:
            counter.add(batch.column(0).filter(pc.invert(batch.column(1))))
            counter.spell(batch.column(0).filter(batch.column(1)))
        table, part = counter.counts(), TaskContext.get().partitionId()
        for k in range(0, layout.size, BLOCK):
            if table[k : k + BLOCK].any():
                yield pa.RecordBatch.from_pydict({"part": [part], "block": [k // BLOCK], "sums": [pack(table[k : k + BLOCK].ravel())]}, _SUMS_ARROW)
        del counter, table
        release()

    small = np.zeros((layout.size, 2), np.uint16)
    for row in add_up(counted.mapInArrow(count, _SUMS), tasks).toLocalIterator():
        own = unpack(row.sums).reshape(-1, 2)
        halve = np.maximum(1, own.max(1, keepdims=True) / 60_000)  # two bytes a count
        small[row.block * BLOCK : row.block * BLOCK + len(own)] = np.rint(own / halve)

    # a broadcast of its own: in a function it would stay in each worker a second time, as the function's bytes
    others = train.sparkSession.sparkContext.broadcast(Model.without_own(small))
    shards = -(-tokens // SHARD_TOKENS) or 1
    mixed = train.select("text", F.lit(False).alias("word"), F.pmod("key", F.lit(shards)).alias("shard"), "key")
    own_key = F.xxhash64("text")
    mixed = mixed.unionByName(spelled.select("text", "word", (F.pmod(own_key, F.lit(shards)) + shards).alias("shard"), own_key.alias("key")))

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, model, at, squares, seen = coder_of(), None, None, None, 0

        def sums() -> pa.RecordBatch:
            values = np.concatenate([model.weights.ravel() * seen, [seen], model.map_counts.ravel()])
            return pa.RecordBatch.from_pydict({"part": [at], "block": [0], "sums": [pack(values)]}, _SUMS_ARROW)

        for batch in batches:
            shard = batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(shard)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if at != shard[a]:  # a shard begins
                    if seen:
                        yield sums()
                    at, model, squares, seen = int(shard[a]), Model(layout, None, others=others.value), np.zeros((GATES, 4)), 0
                for rows, times in decided(coder, batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)):
                    model.learn(rows, times, squares)
                    seen += int(times.sum())
        if seen:
            yield sums()
        del coder, model
        release()

    dealt = mixed.repartition("shard").sortWithinPartitions("shard", "key").select("text", "word", "shard")
    total = np.zeros(GATES * 4 + 1 + MAP_PLACES * MAP_STEPS * 2)
    for row in add_up(dealt.mapInArrow(mix, _SUMS), 2 * shards).toLocalIterator():
        total += unpack(row.sums)
    others.unpersist()
    seen = total[GATES * 4]
    weights = total[: GATES * 4].reshape(GATES, 4) / seen if seen else None
    return Model(layout, small, weights, total[GATES * 4 + 1 :].reshape(-1, 2))


ADDS = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_tokens", "__bytes", "__head_known")]
    + [T.StructField(c, T.DoubleType()) for c in ("__head_log", "__score")]
    + [T.StructField("__tail", T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("novel", T.DoubleType())])))]
)


#: What a worker process keeps for its next partitions: the last coder.
_CODERS: dict[bytes, Coder] = {}


def score_texts(docs: DataFrame, trains: Column, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (add-one words), ``score``
    (log10 of the model's probability) and ``bits_per_byte``, all learned from the rows for which ``trains`` holds."""
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    plain = [F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, T.AtomicType)]
    train = docs.where(trains).select(own.alias("text"), F.xxhash64(*plain).alias("key"))  # copies of a text lie in different shards
    counts = checkpoint(word_counts(train.select("text")))
    n_docs = train.count()
    sums = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")
    ).first()
    total, kinds = sums.n + n_docs, sums.v + (n_docs > 0)
    # words seen once are no ranked words, as new words will not be
    top = counts.where((F.octet_length("word") <= HEAD_BYTES) & (F.col("c") > 1)).orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    head, head_c = [w.encode() for w in top.column("word").to_pylist()], np.concatenate([[0, n_docs], top.column("c").to_numpy()]).astype(np.int64)
    weights = head_c.copy()
    weights[0] = total - head_c.sum()
    layout = Layout(int(np.clip(math.ceil(math.log2(2 * total + 1)), MIN_BITS, MAX_BITS)))
    code_name = hashlib.blake2b(END.join(head) + weights.tobytes() + bytes([layout.bits])).digest()

    def coder_of() -> Coder:
        if code_name not in _CODERS:
            _CODERS.clear()
            _CODERS[code_name] = Coder(head, weights, layout)
        return _CODERS[code_name]

    # what the functions carry: ranked words, four bytes for each context, weights and map
    shared = docs.sparkSession.sparkContext.broadcast(learn(train, counts.where("c = 1").select("word"), coder_of, layout, total).freeze())
    logs, known = np.log10(head_c + 1.0), head_c > 0
    # the mass of the other words: words never seen, as many as were seen once; those seen once by those seen twice; the rest by their counts
    new = sums.once + 1.0
    once = min(0.9, (2.0 * sums.twice + 0.5) / new)
    mass = new + sums.once * once + max(0, int(weights[0]) - sums.once)

    def make():
        coder, model = coder_of(), shared.value

        def run(texts, trained) -> list:
            columns: list[list] = [[], [], [], [], []]
            hashed, novel, lengths = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(1, np.int64)]
            trained, start = np.array(trained.to_pylist(), bool), 0
            for part, (doc, rank, code, kinds, kind) in coder.portions(texts):
                n = len(part)
                at = np.flatnonzero(rank == 0)
                own_rank, one, common, which, _ = coder.distinct(rank, code)
                by_token = np.zeros(len(own_rank))
                for rows, owner in coder.chunks(own_rank, one, common):
                    own_logs = np.bincount(rows[5], model.log_probability(rows))
                    by_token[owner[0] : owner[0] + len(own_logs)] = own_logs
                score = np.bincount(doc, by_token[which], n)
                # words of training texts are never new
                fresh = ~trained[start : start + n][doc[at]]
                used, use = np.unique(kind[fresh], return_inverse=True)
                spelled = np.zeros(len(used))
                for rows, owner in coder.spelled([kinds[k] for k in used]):
                    spelled += np.bincount(owner, model.log_probability(rows), len(spelled))
                new_logs = np.zeros(len(at))
                new_logs[fresh] = spelled[use] / math.log(10)
                hashed.append(code[at].view(np.int64))
                novel.append(new_logs)
                lengths.append(np.bincount(doc[at], minlength=n))
                ranked = rank > 0
                columns[0] += np.bincount(doc, minlength=n).tolist()
                columns[1] += pc.fill_null(pc.binary_length(part), 0).to_pylist()
                columns[2] += np.bincount(doc[ranked], known[rank[ranked]], n).astype(np.int64).tolist()
                columns[3] += np.bincount(doc[ranked], logs[rank[ranked]], n).tolist()
                columns[4] += (score / math.log(10)).tolist()
                start += n
            ends = np.cumsum(np.concatenate(lengths)).astype(np.int32)
            tail = pa.StructArray.from_arrays([pa.array(np.concatenate(hashed)), pa.array(np.concatenate(novel))], ["h", "novel"])
            return [*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tail)]

        return run

    added = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
    names = [c for c in docs.columns if c.lower() not in added and c.lower() != text.lower()]
    read = docs.select(*[f"`{c}`" for c in names], F.col(f"`{text}`").alias("__text"), F.coalesce(trains, F.lit(False)).alias("__trains"))
    scored = map_batches(read, make, ["__text", "__trains"], ADDS, back=False)
    # the other words find their counts by a join on a 64-bit hash; one row for each document keeps its columns
    one = F.struct(*[F.col(f"`{c}`") for c in names], "n_tokens", "__bytes", "__head_known", "__head_log", "__score")
    rows = scored.select(F.monotonically_increasing_id().alias("__row"), one.alias("__doc"), "__tail")
    # the entry in front holds the columns; its own key spreads it and counts nothing
    first = F.array(F.struct(F.col("__row").alias("h"), F.lit(0.0).alias("novel")))
    rows = rows.select("__row", "__doc", F.posexplode(F.concat(first, "__tail")).alias("__k", "__w"))
    rows = rows.select("__row", F.when(F.col("__k") == 0, F.col("__doc")).alias("__doc"), F.col("__w.h").alias("__h"), F.col("__w.novel").alias("__novel"))
    by_hash = counts.groupBy(F.xxhash64("word").alias("__h")).agg(F.sum("c").alias("c"))
    joined = rows.join(by_hash, "__h", "left")
    word = F.col("__doc").isNull()
    c = F.when(word, F.coalesce("c", F.lit(0))).otherwise(0)
    share = F.when(c == 0, F.col("__novel") + F.lit(math.log10(new / mass))).when(c == 1, F.lit(math.log10(once / mass))).otherwise(F.log10(c / F.lit(float(mass))))
    by_doc = joined.groupBy("__row").agg(
        F.first("__doc", ignorenulls=True).alias("__doc"), F.sum(F.log10(c + 1.0)).alias("__tail_log"), F.sum((c > 0).cast("long")).alias("__tail_known"),
        F.sum(F.when(word, share).otherwise(0.0)).alias("__tail_score"),
    )
    floor = math.log10(total + kinds + 1)
    score = F.col("__doc.__score") + F.col("__tail_score")
    return by_doc.select(
        *[F.col(f"__doc.`{x}`").alias(x) for x in names], F.col("__doc.n_tokens").alias("n_tokens"),
        (F.col("__doc.__head_known") + F.col("__tail_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("__doc.__head_log") + F.col("__tail_log") - F.col("__doc.n_tokens") * F.lit(floor)).alias("base_score"),
        score.alias("score"), (score * F.lit(-math.log2(10)) / F.greatest(F.col("__doc.__bytes"), F.lit(1))).alias("bits_per_byte"),
    )
