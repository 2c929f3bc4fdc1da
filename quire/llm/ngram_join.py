"""N-gram Jaccard join by chosen paths: near duplicates on sets of word shingles.

A text is the set of its 5-word shingles (64-bit hashes).  Texts with equal sets
are one node.  In each of ``RUNS`` runs a set of size s picks each of its tokens
with chance 1/(SHARE*s), by a hash that all sets share; nodes that pick the same
token meet in a bucket.  A bucket with more than ``SMALL`` nodes is split again by
one more token (the sets' least one under a hash that only this bucket's path and
level have), so pairs that share only a passage fall apart while near duplicates
stay together; up to ``DEPTH`` levels, or until its nodes are alike, when splitting
cannot separate them.  In buckets, pairs are pruned by 64-byte minwise sketches and
checked exactly.  A pair with Jaccard 0.8 or more shares 1.33 paths a run on average,
18 in ``RUNS`` of 14, and stays together in a split with probability 0.8 or more; as
every path has hashes of its own, what one path parts another still holds.  A pair is
found with 0.99999999 where a bucket of it is small at once, and with 0.9999 where
all of them are split three times.

No pair is written out: a pair is counted in the least bucket that both nodes
are in, a bucket gives each node its number of links and one link to the bucket's
least connected node, and classes are connected components of these.  Buckets of
more than ``BLOCK`` nodes are checked by pairs of blocks in separate tasks.
Copies of a text never leave the first sum.

Edge cases: null texts and texts without words are in no link and are classes of
their own; a text of fewer than five words is one shingle; words are split at
ASCII blanks and compared as they are; equal rows are copies; a null id has the
class of its text; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import checkpoint, join_checked, map_rows, raw_texts, release

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5  # five words, similarity 4/5
RUNS, SHARE, SMALL, DEPTH, BLOCK, SKETCH = 14, 0.6, 200, 4, 1024, 64
#: Texts are made into sets and sent back in parts of some so many bytes: a set takes more than its text, and Python and the JVM hold a part each.
TEXT_BYTES = 2_000_000
#: Bits of each split's token; those of a path's DEPTH - 1 splits are one number.
SPLIT_BITS = 63 // (DEPTH - 1)
#: Nodes of a bucket are alike if two of them have the same least token with this probability.
ALIKE = 0.3
#: Pairs with fewer equal sketch values than this cannot have the similarity (binomial tail under 1e-7).
SKETCH_LEAST = 32

_RNG = np.random.default_rng(8)
_FOLD = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_RUN = _RNG.integers(1, 2**63, RUNS, dtype=np.uint64)
_MIN = _RNG.integers(1, 2**63, SKETCH, dtype=np.uint64) | np.uint64(1)
_LEVEL = _RNG.integers(1, 2**63, DEPTH - 1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; none without words."""
    own = raw.split()
    if not own:
        return np.zeros(0, np.uint64)
    names: dict[bytes, int] = {}
    for w in own:
        if w not in names:
            names[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array([names[w] for w in own], np.uint64)
    n = len(h) - words + 1
    if n < 1:
        return mix(np.array([np.add.reduce(h * _FOLD[: len(h)]) + np.uint64(len(h))], np.uint64))
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total += h[k : k + n] * _FOLD[k]
    return np.unique(mix(total))


def picked(tokens: np.ndarray, seed: np.uint64) -> np.ndarray:
    """The next paths of a set: under the seed's hash each token is picked with chance 1/(SHARE*size)."""
    values = mix(tokens ^ seed)
    chosen = values < np.uint64(min(1.0, 1 / (SHARE * len(tokens))) * 0xFFFFFFFFFFFFF000)
    return mix(values[chosen] ^ mix(np.array([seed], np.uint64)))


def least_tokens(tokens: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The set's least token under the hash of each odd factor."""
    least = np.full(len(factors), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(0, len(tokens), 4096):
        values = tokens[k : k + 4096, None] * factors
        np.minimum(least, (values ^ (values >> np.uint64(32))).min(0), out=least)
    return mix(least)


def sampled(tokens: np.ndarray, paths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The sketch of a set, and for each of its paths the tokens that split the path's bucket, level by level."""
    factors = mix(paths[:, None] ^ _LEVEL) | np.uint64(1)
    least = least_tokens(tokens, np.concatenate([_MIN, factors.ravel()]))
    own = least[SKETCH:].reshape(factors.shape) >> np.uint64(64 - SPLIT_BITS)
    splits = np.bitwise_or.reduce(own << (np.arange(DEPTH - 1) * SPLIT_BITS).astype(np.uint64), axis=1)
    return (least[:SKETCH] >> np.uint64(56)).astype(np.uint8).tobytes(), signed(splits)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


PATHS = T.ArrayType(T.StructType([T.StructField("path", T.LongType()), T.StructField("splits", T.LongType())]))
LIGHT = T.StructType(
    [T.StructField("set_key", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("least", T.LongType()), T.StructField("paths", PATHS)]
    + [T.StructField("sketch", T.BinaryType())]
)


def light_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """For each document: ids of its text and set, the set's size and least token, its first paths and their splits."""

    def run(texts) -> list:
        columns: list[list] = [[], [], [], []]
        paths, splits, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
        for raw in raw_texts(texts):
            tokens = shingles(raw)
            own = np.unique(np.concatenate([picked(tokens, s) for s in _RUN])) if len(tokens) else tokens
            marks, own_splits = sampled(tokens, own) if len(tokens) else (b"", signed(own))
            columns[3].append(marks)
            paths.append(signed(own))
            splits.append(own_splits)
            ends.append(ends[-1] + len(own))
            columns[0].append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
            columns[1].append(len(tokens))
            columns[2].append(int(signed(mix(tokens)[:1] if not len(tokens) else mix(tokens).min(keepdims=True))[0]) if len(tokens) else 0)
        both = pa.StructArray.from_arrays([pa.array(np.concatenate(paths)), pa.array(np.concatenate(splits))], ["path", "splits"])
        return [*columns[:3], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both), columns[3]]

    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), text_key(F.col(f"`{text}`")).alias("text_key"))
    return map_rows(own, run, ["text"], LIGHT, TEXT_BYTES).drop("text")


def text_key(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal first column, which the rows are sorted by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        if held and held[-1].column(0)[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts[:-1], starts[1:]):
            held.append(batch.slice(a, b - a))
            if b < len(key):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)
    release()


def owned(path: int, lists: list[list[int]], side: np.ndarray, cross: bool) -> np.ndarray | None:
    """Which pairs of a bucket's nodes have no lesser bucket in common; None if there is no such pair."""
    n = len(lists)
    free = side[:, None] != side[None, :] if cross else np.ones((n, n), bool)
    np.fill_diagonal(free, False)
    before = [[p for p in own if p < path] for own in lists]
    flat = np.array([p for own in before for p in own], np.int64)
    if len(flat):
        rows = np.repeat(np.arange(n), [len(x) for x in before])
        _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        if counts.max() == n:
            return None
        # lesser buckets, the most common first, 64 at a time as bits; only nodes with open pairs go on
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        shared = counts[inverse] > 1
        rows, column = rows[shared], rank[inverse[shared]]
        for k in range(0, int((counts > 1).sum()), 64):
            part = (column >= k) & (column < k + 64)
            bits = np.zeros(n, np.uint64)
            np.bitwise_or.at(bits, rows[part], np.uint64(1) << (column[part] - k).astype(np.uint64))
            has = np.flatnonzero(bits)
            own = bits[has]
            for j in range(0, len(has), 256):
                at = has[j : j + 256]
                free[at[:, None], has] &= (own[j : j + 256, None] & own) == 0
            if k % 512 == 0 and not free.any():
                return None
    return free if free.any() else None


#: Rows of a bucket's matrix of pairs that are worked on at once: only its bits are held as a whole.
STRIPE = 128


def stripes(n: int) -> Iterator[slice]:
    return (slice(k, k + STRIPE) for k in range(0, n, STRIPE))


def keep_close_sizes(pairs: np.ndarray, size: np.ndarray) -> None:
    for part in stripes(len(size)):
        own = size[part, None]
        pairs[part] &= np.minimum(own, size) * DENOMINATOR >= np.maximum(own, size) * NUMERATOR


def alike_sketches(pairs: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    out = np.zeros_like(pairs)
    own = np.flatnonzero(pairs.any(1))  # nodes with open pairs
    marks = sketches[own]
    for k in range(0, len(own), 32):
        alike = (marks[k : k + 32, None] == marks).sum(2, dtype=np.uint8) >= SKETCH_LEAST
        out[own[k : k + 32, None], own] = pairs[own[k : k + 32, None], own] & alike
    return out


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, path, side, cross, node, size, sketch, paths) of a bucket -> those with a partner worth checking."""
    for bucket in groups(batches):
        if bucket.num_rows < 2:
            continue
        path, cross = bucket.column("path")[0].as_py(), bucket.column("cross")[0].as_py()
        pairs = owned(path, bucket.column("finals").to_pylist(), bucket.column("side").to_numpy(), cross)
        if pairs is None:
            continue
        keep_close_sizes(pairs, bucket.column("size").to_numpy())
        sketches = np.frombuffer(b"".join(bucket.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        keep = alike_sketches(pairs, sketches).any(1) if pairs.any() else np.zeros(len(pairs), bool)
        if keep.any():
            yield from bucket.filter(pa.array(keep)).select(["bucket", "path", "side", "cross", "node"]).combine_chunks().to_batches()


def common_tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of membership matrices over slices of the tokens that repeat."""
    n = len(sets)
    flat = np.concatenate(sets)
    flat.sort()
    repeats = np.unique(flat[1:][flat[1:] == flat[:-1]])  # without the places of all tokens, which take several times their memory
    del flat
    rows, column = [], []
    for k, own in enumerate(sets):
        at = np.searchsorted(repeats, own)
        at = at[(at < len(repeats)) & (repeats.take(at, mode="clip") == own)] if len(repeats) else at[:0]
        rows.append(np.full(len(at), k, np.int32))
        column.append(at.astype(np.int32))
    rows, column, total, both = np.concatenate(rows), np.concatenate(column), len(repeats), np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for k in range(0, total, 2048):
        a, b = np.searchsorted(column, [k, k + 2048])
        part = np.zeros((n, min(2048, total - k)), np.float32)
        part[rows[a:b], column[a:b] - k] = 1
        both += part @ part.T
    return both


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket with their sets and weights -> (node, links, root)."""
    for bucket in groups(batches):
        if bucket.num_rows < 2:
            continue
        path, cross = bucket.column("path")[0].as_py(), bucket.column("cross")[0].as_py()
        pairs = owned(path, bucket.column("finals").to_pylist(), bucket.column("side").to_numpy(), cross)
        if pairs is None:
            continue
        sets = [np.frombuffer(x, np.uint64) for x in bucket.column("tokens").to_pylist()]
        size = np.array([len(s) for s in sets])
        both = common_tokens(sets)
        weight, links = bucket.column("weight").to_numpy(), np.zeros(len(sets), np.int64)
        for part in stripes(len(sets)):
            shared = both[part].astype(np.int64)  # counts below 2 ** 24 are whole in four bytes
            pairs[part] &= DENOMINATOR * shared >= NUMERATOR * (size[part, None] + size - shared)
            links[part] = pairs[part] @ weight
        del sets, both
        nodes = bucket.column("node").to_pylist()
        root = np.arange(len(nodes))
        by_name = sorted(range(len(nodes)), key=nodes.__getitem__)
        done = np.zeros(len(nodes), bool)
        for k in by_name:  # the least node of each connected part
            if done[k] or not pairs[k].any():
                continue
            part = np.zeros(len(nodes), bool)
            part[k], front = True, np.array([k])
            while len(front):
                reached = pairs[front].any(0) & ~part
                part |= reached
                front = np.flatnonzero(reached)
            root[part], done = k, done | part
        found = np.flatnonzero(links > 0)
        if len(found):
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[k] for k in found], pa.binary()), pa.array(links[found], pa.int64()), pa.array([nodes[root[k]] for k in found], pa.binary())],
                ["node", "links", "root"],
            )


def by_bucket(rows: DataFrame, run, schema: str) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def sized(rows: DataFrame) -> DataFrame:
    """Path rows (path, node, least) of paths with company, with ``n`` nodes and ``alike``."""
    kinds = rows.groupBy("path", "least").agg(F.count("*").alias("k"))
    buckets = kinds.groupBy("path").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("q")).where("n > 1")
    buckets = buckets.select(F.col("path"), "n", (F.col("q") >= F.lit(ALIKE) * F.col("n") * F.col("n")).alias("alike"))
    return joined_loosely(rows, buckets, "path")


def loose(name: str):
    """The column as a join key of its own, so that the join shuffles and Spark may split a large partition."""
    return F.concat(F.col(name), F.lit(b""))


def joined_loosely(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """An inner join on a key that may have very many rows in ``big`` and has one in ``small``."""
    other = small.withColumnRenamed(key, "__other")
    return big.join(other, loose(key) == loose("__other")).drop("__other")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) rows with root <= node -> every node that is in a row with the least node of its component."""
    state = checkpoint(edges.where("node <> root").distinct())
    while True:
        least = state.groupBy("node").agg(F.min("root").alias("least"))
        # neighbours below a node join its least one; a node goes on to the parent of its parent
        joined = state.join(least, "node")
        hooks = joined.where("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        parent = least.select(F.col("node").alias("__p"), F.col("least").alias("__up"))
        jumped = least.join(parent, loose("least") == loose("__p"), "left")
        moved = jumped.select("node", F.coalesce("__up", "least").alias("root"), F.col("__up").isNotNull().alias("moved"))
        new = moved.unionByName(hooks.withColumn("moved", F.lit(True))).groupBy("node", "root").agg(F.max("moved").alias("moved"))
        new = checkpoint(new)
        if new.where("moved").isEmpty():
            return new.select("node", "root")
        state = new.select("node", "root")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: ``doc_id``, ``class_id`` (the least id of its class), ``n_links``: other texts
    with similarity 0.8 or more, copies not counted, and ``text_key`` (MD5 of the text)."""
    return rooted(docs, doc_id, text).drop("root")


def rooted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``near_duplicates`` with ``root``, the key of the class; null for texts without words."""
    light = checkpoint(light_rows(docs, doc_id, text))
    own = ["size", "least", "paths", "sketch"]
    texts = light.where("set_key IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("set_key", *own)])
    nodes = checkpoint(
        texts.groupBy("set_key").agg(F.min("text_key").alias("node"), F.min("first_id").alias("first_id"), F.count("*").alias("weight"), *[F.first(c).alias(c) for c in own])
    )
    level, finals = checkpoint(sized(nodes.select(F.inline("paths"), "node", "least"))), []
    for depth in range(1, DEPTH + 1):
        done = F.lit(True) if depth == DEPTH else (F.col("n") <= SMALL) | F.col("alike")
        finals.append(level.where(done).select("path", "node", "n"))
        if depth == DEPTH or level.where(~done).isEmpty():
            break
        token = F.shiftrightunsigned("splits", SPLIT_BITS * (depth - 1)).bitwiseAND(F.lit((1 << SPLIT_BITS) - 1))
        level = checkpoint(sized(level.where(~done).select(F.xxhash64("path", token).alias("path"), "node", "least", "splits")))
    final = reduce(DataFrame.unionByName, finals)

    about = final.groupBy("node").agg(F.collect_list("path").alias("finals"))
    info = nodes.select("node", "size", "weight", "sketch").join(about, "node")
    # buckets over BLOCK nodes: one task for each pair of blocks
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    mine = F.pmod(F.xxhash64("node", "path"), blocks)
    rows = final.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select(
        F.xxhash64("path", F.least("mine", "other"), F.greatest("mine", "other")).alias("bucket"), "path",
        (F.col("mine") > F.col("other")).cast("long").alias("side"), (F.col("mine") != F.col("other")).alias("cross"), "node",
    )
    kept = checkpoint(by_bucket(
        rows.join(info.select("node", "size", "sketch", "finals"), "node").select("bucket", "path", "side", "cross", "node", "size", "sketch", "finals"),
        candidates, "bucket long, path long, side long, cross boolean, node binary",
    ))

    # sets of the nodes with candidates, from their texts
    wanted = checkpoint(kept.select("node").distinct())
    keyed = docs.select(F.col(f"`{text}`").alias("text"), text_key(F.col(f"`{text}`")).alias("node"))
    chosen = join_checked(keyed, wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = map_rows(chosen, lambda column: [[shingles(raw).tobytes() for raw in raw_texts(column)]], ["text"], T.StructType([T.StructField("tokens", T.BinaryType())]), TEXT_BYTES)
    full = kept.join(info.select("node", "weight", "finals"), "node").join(sets.select("node", "tokens"), "node")
    links = checkpoint(by_bucket(full.select("bucket", "path", "side", "cross", "node", "weight", "finals", "tokens"), verified, "node binary, links long, root binary"))

    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links.select("node", "root"))
    placed = nodes.select("set_key", "node", "first_id", "weight").join(counted, "node", "left").join(roots, "node", "left")
    placed = checkpoint(placed.select("set_key", "first_id", F.coalesce("root", "node").alias("root"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    classes = placed.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = joined_loosely(placed, classes, "root").select("set_key", "root", "class_id", "n_links")
    out = light.select("doc_id", "text_key", F.col("set_key").alias("__k")).join(named, loose("__k") == loose("set_key"), "left")
    return out.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_key", "root"
    )


def row_key(doc_id, text_key):
    """Equal for rows with the same text and id."""
    return F.concat(text_key, F.coalesce(F.concat(F.lit("i"), doc_id.cast("string")), F.lit("")).cast("binary"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the class's least id, of its rows the first by text, of rows with
    the same id and text any one.  Rows without words are classes of their own and all stay."""
    words = F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    found = rooted(docs, doc_id, text).where(F.col("root").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_id")))
    keep = found.groupBy("root").agg(F.min("doc_id").alias("id"), F.min("text_key").alias("key")).select(row_key(F.col("id"), F.col("key")).alias("__row"))
    rows = docs.where(words).withColumn("__row", row_key(F.col(f"`{doc_id}`"), text_key(F.col(f"`{text}`"))))
    # both steps are dealt by the same key: one shuffle
    chosen = rows.join(keep, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
    return chosen.unionByName(docs.where(~words))
