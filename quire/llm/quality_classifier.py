"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network.

A token (a run of letters, or of other characters) has a fixed sparse index
vector, drawn from its hash.  The vector of a token is the sum of the index
vectors of its neighbours over all documents; tokens share ``BUCKETS`` vectors by
hash, which bounds the model however large the corpus is.  Every partition sums
its own documents; the sums are added in blocks, in rounds, so no task gets more
than ``FAN_IN`` of them.

A document is the mean vector of its tokens, the mean of its distinct tokens, and
three sizes.  A two-layer numpy network is fitted on a bounded sample of labelled
rows; its temperature is set on a part of them that the fitting does not see.

Edge cases: null and empty texts are the zero document and get its score; texts
may have any length; equal rows get equal scores; without labels of both kinds
every score is the share of label 1 (0.5 without labels); an empty table gives an
empty result; added columns replace those of the same name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import map_rows, raw_texts
from quire.llm.quality_rules import labelled

BUCKETS, DIMS, REACH = 1 << 14, 48, 2
#: Rows of the vector table that travel together, and how many partial sums of a block a task adds.
BLOCK, FAN_IN = 1024, 64
#: At most so many labelled rows are used for fitting: those with the least hash of their id.
MAX_LABELLED = 12_000
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[^\x00-\x20A-Za-z\x80-\xff]+")
CHUNK = 1 << 20


def token_hashes(raw: bytes) -> np.ndarray:
    return np.array([zlib.crc32(t) for t in TOKEN.findall(raw)], np.int64)


def add_contexts(table: np.ndarray, texts: list[np.ndarray]) -> None:
    """Adds, for each token, the index vectors of the tokens up to ``REACH`` places away in its document."""
    if not texts:
        return
    h = np.concatenate(texts)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    # an index vector has two places, of opposite sign
    base, plus, minus = h % BUCKETS * DIMS, (h >> 8) % DIMS, (h >> 16) % DIMS
    for reach in range(1, REACH + 1):
        same = doc[reach:] == doc[:-reach]
        a, b = np.flatnonzero(same), np.flatnonzero(same) + reach
        for one, other in ((a, b), (b, a)):
            table += np.bincount(base[one] + plus[other], minlength=BUCKETS * DIMS)
            table -= np.bincount(base[one] + minus[other], minlength=BUCKETS * DIMS)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """``BUCKETS`` x ``DIMS`` unit vectors learned from every document."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, waiting, size = np.zeros(BUCKETS * DIMS, np.int64), [], 0
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                waiting.append(token_hashes(raw))
                size += len(waiting[-1])
                if size >= CHUNK:
                    add_contexts(table, waiting)
                    waiting, size = [], 0
        add_contexts(table, waiting)
        blocks = table.reshape(-1, BLOCK * DIMS)
        full = [k for k in range(len(blocks)) if blocks[k].any()]
        yield pa.RecordBatch.from_pydict(
            {"part": [TaskContext.get().partitionId()] * len(full), "block": full, "sums": [blocks[k].tobytes() for k in full]}, schema
        )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.int64) for x in rows["sums"]], axis=0)
        return pd.DataFrame({"part": [rows["part"].iat[0]], "block": [rows["block"].iat[0]], "sums": [total.tobytes()]})

    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("sums", pa.binary())])
    kind = "part long, block long, sums binary"
    sums, parts = docs.select(f"`{text}`").mapInArrow(partial, kind), docs.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        sums = sums.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part", "block").applyInPandas(add, kind)
    table = np.zeros((BUCKETS, DIMS))
    for row in sums.toLocalIterator():  # the whole table: BUCKETS x DIMS numbers
        table[row.block * BLOCK : (row.block + 1) * BLOCK] += np.frombuffer(row.sums, np.int64).reshape(-1, DIMS)
    return (table / (np.linalg.norm(table, axis=1, keepdims=True) + 4.0)).astype(np.float32)


def pooled(raw: bytes, vectors: np.ndarray) -> np.ndarray:
    h = token_hashes(raw)
    if not len(h):
        return np.zeros(2 * DIMS + 3, np.float32)
    kinds, counts = np.unique(h, return_counts=True)
    own = vectors[kinds % BUCKETS]
    return np.concatenate([counts @ own / len(h), own.mean(0), [np.log1p(len(h)) / 8, len(kinds) / len(h) ** 0.8, np.log1p(counts.max()) / 8]]).astype(np.float32)


@dataclass
class Network:
    """Two layers: tanh units, then one logistic unit divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, units: int = 24, epochs: int = 40, batch: int = 64, rate: float = 3e-3, l2: float = 1e-4, seed: int = 5) -> Network:
    """Adam on the log loss over 85 % of the rows, and the temperature of least log loss on the others."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    if n == 0 or y.min() == y.max():
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    order = rng.permutation(n)
    held, rows = order[: max(1, n * 15 // 100)], order[max(1, n * 15 // 100) :]
    net = Network(x[rows].mean(0), x[rows].std(0) + 1e-3, rng.normal(0, d**-0.5, (d, units)), np.zeros(units), rng.normal(0, units**-0.5, units), 0.0)
    z = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // batch)):
            hidden = np.tanh(z[part] @ params[0] + params[1])
            off = (1 / (1 + np.exp(-(hidden @ params[2] + params[3]))) - y[part]) / len(part)
            back = off[:, None] * params[2] * (1 - hidden**2)
            grads = [z[part].T @ back + l2 * params[0], back.sum(0), hidden.T @ off + l2 * params[2], off.sum(keepdims=True)]
            t += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits, sign = net.logit(x[held]), 2 * y[held] - 1
    net.temperature = float(min(np.geomspace(0.3, 6, 60), key=lambda k: np.logaddexp(0, -sign * logits / k).mean()))
    return net


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.network.probability(np.array([pooled(t, self.vectors) for t in texts], float).reshape(-1, 2 * DIMS + 3))


def fit(docs: DataFrame, labels: DataFrame, learn=None, most: int = MAX_LABELLED) -> Classifier:
    """Vectors from all ``docs``; the network from at most ``most`` labelled rows for which ``learn`` (a condition) holds."""
    vectors = word_vectors(docs)
    rows = docs.select("doc_id", "text")
    sample = labelled(rows, labels if learn is None else labels.where(learn), "quality", most).select("text", "__label")
    wanted = T.StructType([T.StructField("__x", T.ArrayType(T.FloatType()))])
    got = map_rows(sample, lambda t: [[pooled(r, vectors) for r in raw_texts(t)]], ["text"], wanted)
    got = got.select("__x", "__label").orderBy(F.xxhash64("__x", "__label")).limit(most).toArrow()
    x = np.array(got.column("__x").to_pylist(), float).reshape(-1, 2 * DIMS + 3)
    return Classifier(vectors, fit_network(x, np.array(got.column("__label").to_pylist(), float)))


def classify(docs: DataFrame, model: Classifier, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""
    adds = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(texts) -> list:
        p = model.score(raw_texts(texts))
        return [p, (p >= threshold).astype(np.int32)]

    return map_rows(docs, run, [text], adds)
