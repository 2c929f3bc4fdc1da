"""Benchmark decontamination by FM-indexes over the training text.

A batch of documents is a shard.  Its words become numbers of the benchmark's
vocabulary; word pairs that no benchmark text has end a run, and runs shorter
than the shortest window go, which loses no match.  What is left is indexed:
suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix
for ranks, and every ``SAMPLE``-th suffix position.  All windows of the benchmark
are searched backwards at once; occurrences are located by walking to the next
sampled position and merged into spans.

A window is ``WINDOW`` consecutive words of an item; a shorter item is one window.
The benchmark is used in blocks of at most ``BLOCK_BYTES`` of text, one pass over
the documents for each, so what is sent to the executors is bounded.

Edge cases: null and wordless texts, of documents or items, have no windows;
item ids repeated in the benchmark are one item; a null item id is the item
"null"; equal rows get equal results; texts have any length; empty tables
give no hits or no rows; added columns replace those of the same name.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import checkpoint, map_batches, raw_texts

WINDOW, SAMPLE, BLOCK_BYTES = 10, 32, 4_000_000
#: Words of the indexed text of a shard; a batch with more is split between documents.
SHARD_WORDS = 1_000_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to a-z, and everything that ends a word to a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else (b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256)
)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text`` (a suffix that ends is less), by prefix doubling."""
    n = len(text)
    rank, step = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        second = np.full(n, -1, np.int64)
        second[:-step or None] = rank[step:] if step < n else second[: n - step]
        key = rank * (n + max(int(rank.max()), 1) + 2) + second + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank, step = fresh, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class WaveletMatrix:
    """Ranks and access over a sequence of numbers: a level for each bit, zeros of a level before its ones."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for k in range(self.bits - 1, -1, -1):
            bit = (values >> k & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(values) - int(bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        start, end = np.zeros_like(at), at
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            start, end = (np.where(bit, zeros + ones[x], x - ones[x]) for x in (start, end))
        return end - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its occurrences before the place."""
        start, symbol = np.zeros_like(at), np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] > ones[at]
            symbol = symbol << 1 | bit
            start, at = (np.where(bit, zeros + ones[x], x - ones[x]) for x in (start, at))
        return symbol, at - start


class FMIndex:
    def __init__(self, text: np.ndarray, top: int):
        """text: numbers from 1 to ``top``; 0 is put at its end."""
        text = np.append(text, 0)
        order = suffix_array(text)
        self.n = len(text)
        self.wavelet = WaveletMatrix(text[order - 1], top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        sampled = order % SAMPLE == 0
        self.sampled, self.samples = np.concatenate([[0], np.cumsum(sampled)]), order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix array that start with each pattern (all of one length): first and past the last."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        for symbol in patterns.T[::-1]:
            s = symbol[alive]
            lo = self.before[s] + self.wavelet.rank(s, low[alive])
            hi = self.before[s] + self.wavelet.rank(s, high[alive])
            low[alive], high[alive] = lo, hi
            alive = alive[hi > lo]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: steps back to a sampled position, counted."""
        found, steps, left = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.astype(np.int64)
        while len(left):
            hit = self.sampled[rows + 1] > self.sampled[rows]
            found[left[hit]] = self.samples[self.sampled[rows[hit]]] + steps
            left, rows, steps = left[~hit], rows[~hit], steps + 1
            if len(left):
                symbol, before = self.wavelet.access(rows)
                rows = self.before[symbol] + before
        return found


class Phrases:
    """The windows of a block of benchmark items, as numbers of the block's vocabulary."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.items = sorted({name for name, _ in items})
        place = {name: k for k, name in enumerate(self.items)}
        by_window: dict[tuple[int, ...], set[int]] = {}
        pairs = set()
        for name, raw in items:
            ids = [self.number.setdefault(w, len(self.number) + 2) for w in words_of(raw)]
            pairs.update(zip(ids, ids[1:]))
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1) if size else ():
                by_window.setdefault(tuple(ids[k : k + size]), set()).add(place[name])
        self.top = len(self.number) + 1  # 1 separates runs
        self.by_length = {
            size: (np.array(own), [np.array(sorted(by_window[w])) for w in own])
            for size in sorted({len(w) for w in by_window})
            if (own := [w for w in by_window if len(w) == size])
        }
        self.shortest = min(self.by_length, default=0)
        self.pair_bits = np.zeros(1 << 22, bool)  # hashed; a chance hit only keeps a run longer
        if pairs:
            a, b = np.array(sorted(pairs)).T
            self.pair_bits[self.pair_hash(a, b)] = True

    @staticmethod
    def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA6B >> 7) & ((1 << 22) - 1)

    def find(self, docs: list[np.ndarray]) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
        """For each document (numbers of its words, 0 for others): merged hit spans in words, and items found."""
        spans: list[list] = [[] for _ in docs]
        found: list[list[str]] = [[] for _ in docs]
        if not self.shortest or not docs:
            return spans, found
        lengths = np.array([len(d) for d in docs])
        flat = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)
        ends = np.cumsum(lengths)
        if not len(flat):
            return spans, found
        # a run goes on where the next word is in the same document and the pair is in the benchmark
        joined = np.zeros(len(flat), bool)
        joined[:-1] = self.pair_bits[self.pair_hash(flat[:-1], flat[1:])] & (flat[:-1] > 0) & (flat[1:] > 0)
        joined[ends[ends > 0] - 1] = False
        first = np.flatnonzero((flat > 0) & ~np.concatenate([[False], joined[:-1]]))
        last = np.flatnonzero((flat > 0) & ~joined)
        long = last - first + 1 >= self.shortest
        first, size = first[long], (last - first + 1)[long]
        edges = np.zeros(len(flat) + 1, np.int64)
        seen: set[tuple[int, int]] = set()
        done = 0
        while done < len(first):
            take = max(1, int(np.searchsorted(np.cumsum(size[done:] + 1), SHARD_WORDS, "right")))
            self.search(flat, first[done : done + take], size[done : done + take], ends, edges, seen)
            done += take
        hit = np.cumsum(edges[:-1]) > 0
        starts = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
        stops = np.flatnonzero(hit & ~np.concatenate([hit[1:], [False]])) + 1
        for d, s, e in zip(np.searchsorted(ends, starts, "right"), starts, stops):
            while s < e:  # spans of neighbouring documents may touch
                cut = min(e, int(ends[d]))
                offset = int(ends[d] - lengths[d])
                if cut > s:
                    spans[d].append((int(s) - offset, cut - offset))
                s, d = max(s, cut), d + 1
        for d, k in sorted(seen):
            found[d].append(self.items[k])
        return spans, found

    def search(self, flat, first, size, ends, edges, seen) -> None:
        """Index these runs, search all windows, mark hit words in ``edges`` and (document, item) in ``seen``."""
        offset = np.cumsum(size + 1) - (size + 1)
        text = np.ones(int((size + 1).sum()), np.int64)
        inside = np.arange(len(text)) - np.repeat(offset, size + 1)
        origin = np.repeat(first, size + 1) + inside
        real = inside < np.repeat(size, size + 1)
        text[real] = flat[origin[real]]
        index = FMIndex(text, self.top)
        for length, (patterns, items) in self.by_length.items():
            low, high = index.search(patterns)
            count = high - low
            which = np.flatnonzero(count)
            step = max(1, SHARD_WORDS // max(1, int(count.max(initial=1))))
            for k in range(0, len(which), step):
                part = which[k : k + step]
                n = count[part]
                rows = np.repeat(low[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                at = origin[index.locate(rows)]
                np.add.at(edges, at, 1)
                np.add.at(edges, at + length, -1)
                doc = np.searchsorted(ends, at, "right")
                for p, d in np.unique(np.stack([np.repeat(part, n), doc], 1), axis=0):
                    seen.update((int(d), int(i)) for i in items[p])


def merge_spans(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDS = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))]
)


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """Items (item, raw), and in how many blocks of a bounded size of text they are used."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").alias("raw")).where("raw IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("raw") + 16), F.lit(0)).alias("n")).first().n
    return items, max(1, -(-size // block_bytes))


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (merged, in words) and ``hit_items`` (item ids as text, sorted)."""
    items, blocks = item_blocks(benchmark, block_bytes)
    for k in range(blocks):
        # rows of a block: a fraction of a bounded size of text
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "raw"), F.lit(blocks)) == k)
        rows = [(r.item, r.raw.encode()) for r in block.toLocalIterator()]
        docs = _one_block(docs, rows, text, window, k > 0)
    return docs


def _one_block(docs: DataFrame, items: list[tuple[str, bytes]], text: str, window: int, more: bool) -> DataFrame:
    def make():
        phrases = Phrases(items, window)
        number = phrases.number.get

        def run(texts, old_spans=None, old_items=None) -> list:
            numbers, counts = [], []
            for raw in raw_texts(texts):
                own = words_of(raw)
                counts.append(len(own))
                numbers.append(np.array([number(w, 0) for w in own], np.int64))
            spans, found = phrases.find(numbers)
            if more:
                spans = [merge_spans([(x["start"], x["end"]) for x in a], b) for a, b in zip(old_spans.to_pylist(), spans)]
                found = [sorted({*a, *b}) for a, b in zip(old_items.to_pylist(), found)]
            return [counts, [[{"start": s, "end": e} for s, e in x] for x in spans], found]

        return run

    return map_batches(docs, make, [text, *(["hit_spans", "hit_items"] if more else [])], ADDS)


def cut_words(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``spans`` and what stands between words of one span."""
    if not spans:
        return raw
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD).replace(b" ", b"\x00"))]
    out, done = [], 0
    for start, end in spans:
        out.append(raw[done : at[start][0]])
        done = at[end - 1][1]
    return b"".join([*out, raw[done:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with hit passages cut from ``text``; other columns as they are.

    What stood around a passage may join to a window of its own: a text is searched again until nothing hits.
    """
    clean, names, kept = T.StructType([T.StructField(text, T.StringType())]), docs.columns, [F.col(f"`{c}`") for c in docs.columns]
    items, blocks = item_blocks(benchmark)
    if blocks > 1:  # what one block's cut joins may be another block's window

        def cut(texts, spans) -> list:
            return [[
                t.as_py() if not s else cut_words(t.as_py().encode(), [(x["start"], x["end"]) for x in s]).decode()
                for t, s in zip(texts, spans.to_pylist())
            ]]

        while True:
            hits = checkpoint(find_hits(docs, benchmark, text))
            if hits.where("size(hit_spans) > 0").isEmpty():
                return hits.select(*kept)
            docs = map_batches(hits, lambda: cut, [text, "hit_spans"], clean).select(*kept)
    rows = [(r.item, r.raw.encode()) for r in items.toLocalIterator()]

    def make():
        phrases = Phrases(rows, WINDOW)
        number = phrases.number.get

        def run(texts) -> list:
            raws, left = raw_texts(texts), range(len(texts))
            changed: dict[int, bytes] = {}
            while left:
                spans, _ = phrases.find([np.array([number(w, 0) for w in words_of(changed.get(k, raws[k]))], np.int64) for k in left])
                hit = [(k, own) for k, own in zip(left, spans) if own]
                changed.update((k, cut_words(changed.get(k, raws[k]), own)) for k, own in hit)
                left = [k for k, _ in hit]
            return [[changed[k].decode() if k in changed else t.as_py() for k, t in enumerate(texts)]]

        return run

    return map_batches(docs, make, [text], clean).select(*[F.col(f"`{c}`") for c in names])
