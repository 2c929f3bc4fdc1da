"""Quality rules: hand-set limits, then gradient-boosted trees over document statistics.

The statistics of a whole text are one pass over its bytes.  The trees are
fitted with numpy on a bounded sample of labelled rows and flattened into node
arrays (feature, threshold, children, value), so that a batch of documents is
scored by a few array steps.  Chosen features are monotone: more symbols,
repeated lines, repeated windows or capitals can only lower a score.

Edge cases: null and empty texts have no words and fail the base rules; texts
may have any length; equal rows get equal results; an empty table gives an
empty result; without labels of both kinds the base rules alone decide.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import BLANKS, map_rows, raw_texts

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Base rules: fewer words, or a larger share of repeated words in per cent, fail.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: At most so many labelled rows are used for fitting: those with the least hash of their id.
MAX_LABELLED = 12_000
#: A text with a lower probability of label 1 is rejected.
THRESHOLD = 0.5

BASE = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
)
#: Name and direction: -1 where a larger value may only lower the score, 0 where it is free.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "pipe_share": -1,
    "shout_share": -1, "capital_share": -1, "digit_share": 0, "stop_share": 0, "distinct_share": 0, "same_next_share": -1,
    "words_per_line": 0, "letter_share": 0, "open_line_share": 0, "short_word_share": 0,
}
_ODD = np.random.default_rng(17).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)
_STOP = re.compile(rb"[.!?]")


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, the first occurrence included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    wide = ids.astype(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed += (wide[k : k + n] + np.uint64(1)) * _ODD[k % WINDOW]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():
        return 0
    # some hash repeats: name the windows exactly, by pairs of names of shorter ones
    names, length = ids.astype(np.int64), 1
    while length < window:
        step = min(length, window - length)
        _, names = np.unique(names[:-step] * (names.max() + 1) + names[step:], return_inverse=True)
        length += step
    twice = np.bincount(names)[names] > 1
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(raw: bytes) -> tuple[tuple, list[float]]:
    """The base counts of ``BASE`` and the features of ``FEATURES`` of a whole UTF-8 text."""
    words = raw.split()
    if not words:
        return (0, 0, 0, 0, 0), [0.0] * len(FEATURES)
    packed = raw.translate(None, BLANKS)
    data = np.frombuffer(packed, np.uint8)
    kinds = np.bincount(data, minlength=256)
    word_chars = len(packed) - int(kinds[0x80:0xC0].sum())
    symbols = int(kinds[list(SYMBOLS)].sum())
    seen: set[bytes] = set()
    lines = dup = open_lines = 0
    for line in raw.split(b"\n"):
        bare = line.strip(BLANKS)
        if bare:
            lines += 1
            dup += line in seen
            seen.add(line)
            open_lines += not _STOP.match(bare[-1:])
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    n = len(words)
    repeat = repeated_words(ids)
    upper, lower = int(kinds[65:91].sum()), int(kinds[97:123].sum())
    wide = int(kinds[0xC0:].sum())
    return (n, word_chars, symbols, dup, repeat), [
        np.log1p(n), word_chars / n, symbols / word_chars, dup / lines, repeat / n, int(kinds[124]) / n,
        int(kinds[33]) / n, upper / (upper + lower + 1), int(kinds[48:58].sum()) / word_chars, int(kinds[46]) / n,
        len(names) / n ** 0.8, float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, n / lines,
        (upper + lower + wide) / word_chars, open_lines / lines, sum(len(w) < 3 for w in words) / n,
    ]


@dataclass
class Trees:
    """A sum of regression trees as flat node arrays; a leaf points to itself."""

    base: float = 0.0
    depth: int = 0
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            goes_left = np.take_along_axis(x, self.feature[at], 1) <= self.threshold[at] if at.size else at > 0
            at = np.where(goes_left, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit_trees(
    x: np.ndarray, y: np.ndarray, directions: list[int], n_trees: int = 80, depth: int = 3, rate: float = 0.15,
    bins: int = 64, l2: float = 2.0, least: float = 2.0,
) -> Trees:
    """Second-order boosting on the log loss over quantile bins.

    A monotone feature is only split where the children's values keep its
    direction, and the children inherit their mid value as a bound, so the
    direction holds for whole trees and their sum.  One class only: a constant.
    """
    share = np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base=base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    total, roots, nodes = np.full(len(y), base), [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        roots.append(len(nodes))
        nodes.append(None)
        stack = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while stack:
            at, rows, level, low, high = stack.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value = float(np.clip(gs / (hs + l2), low, high))
            best = None
            if level < depth and hs > 2 * least:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]
                    gr, hr = gs - gl, hs - hl
                    vl, vr = np.clip(gl / (hl + l2), low, high), np.clip(gr / (hr + l2), low, high)
                    gain = gl * vl - (hl + l2) * vl**2 / 2 + gr * vr - (hr + l2) * vr**2 / 2
                    gain[(hl < least) | (hr < least) | (directions[j] * (vr - vl) < 0)] = -np.inf
                    k = int(gain.argmax())
                    if best is None or gain[k] > best[0]:
                        best = (gain[k], j, k, vl[k], vr[k])
            if best is None or best[0] <= gs * value - (hs + l2) * value**2 / 2 + 1e-6:
                nodes[at] = (0, 0.0, at, at, rate * value)
                total[rows] += rate * value
                continue
            _, j, k, vl, vr = best
            left, right = len(nodes), len(nodes) + 1
            nodes += [None, None]
            nodes[at] = (j, float(edges[j][k]), left, right, 0.0)
            mid, on_left = (vl + vr) / 2, binned[rows, j] <= k
            bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}
            for child, part, (lo, hi) in zip((left, right), (rows[on_left], rows[~on_left]), bounds[directions[j]]):
                stack.append((child, part, level + 1, lo, hi))
    f, t, a, b, v = zip(*nodes, strict=True)
    return Trees(base, depth, np.array(roots, np.int32), np.array(f, np.int32), np.array(t), np.array(a, np.int32), np.array(b, np.int32), np.array(v))


def labelled(docs: DataFrame, labels: DataFrame, target: str, most: int) -> DataFrame:
    """``docs`` of at most ``most`` labelled ids, those of least hash, with the label as ``__label``.

    The chosen ids are broadcast: ``most`` rows of two numbers bound their size.
    """
    chosen = (
        labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max(F.col(target).cast("double")).alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(most)
    )
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).drop("__id")


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Trees:
    """Trees for ``labels.quality`` from at most ``most`` labelled rows; only their features reach the driver."""
    wanted = T.StructType([T.StructField("__x", T.ArrayType(T.DoubleType()))])
    sample = labelled(docs.select("doc_id", "text"), labels, "quality", most).select("text", "__label")
    rows = map_rows(sample, lambda t: [[statistics(r)[1] for r in raw_texts(t)]], ["text"], wanted)
    # a repeated doc_id could multiply the sample; the bound holds for rows as well
    got = rows.select("__x", "__label").orderBy(F.xxhash64("__x", "__label")).limit(most).toArrow()
    x = np.array(got.column("__x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_trees(x, np.array(got.column("__label").to_pylist(), float), list(FEATURES.values()))


def quality_rules(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``quality_score`` and ``kept``."""
    adds = T.StructType(
        [*BASE, T.StructField("base_failed", T.BooleanType()), T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    )

    def score(texts) -> list:
        got = [statistics(r) for r in raw_texts(texts)]
        counts = np.array([c for c, _ in got], np.int64).reshape(-1, 5)
        p = model.probability(np.array([x for _, x in got], float).reshape(-1, len(FEATURES)))
        failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
        return [*counts.T, failed, p, ~failed & (p >= threshold)]

    return map_rows(docs, score, ["text"], adds)
