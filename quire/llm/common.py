"""What the operators of this package share: table access, Arrow row functions, held-out folds."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six bytes that separate words: space and 0x09 to 0x0D, what ``bytes.split()`` splits at.
BLANKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; null ids have fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(buckets), F.lit(0).cast("long"))


def map_rows(df: DataFrame, fn: Callable[[list], list[tuple]], reads: list[str], adds: T.StructType, size: int | None = None) -> DataFrame:
    """``df`` with the columns of ``adds``, which ``fn`` computes from the columns ``reads`` of a batch.

    ``fn`` gets one ``pyarrow`` array for each name in ``reads`` and returns one
    array or list for each field of ``adds``.  The other columns pass through
    untouched; a column of ``df`` with the name of an added one is replaced.
    Rows stay where they are: no shuffle, and one batch in memory at a time.
    """
    return map_batches(df, lambda: fn, reads, adds, size=size)


def map_batches(df: DataFrame, make: Callable[[], Callable], reads: list[str], adds: T.StructType, back: bool = True, size: int | None = None) -> DataFrame:
    """``map_rows`` for functions with state: ``make`` is called once for each partition, and at its end the
    function's attribute ``end``, where it has one.  Unless ``back``, the columns read are not in the result.  With ``size``
    a batch is worked on and sent back in parts of some ``size`` bytes of the first column read."""
    names = {f.name.lower() for f in adds} | (set() if back else {c.lower() for c in reads})
    kept = [f for f in df.schema if f.name.lower() not in names]
    schema = T.StructType(kept + list(adds))
    # what is read but replaced travels under names of its own
    inner = df.select(
        *[df[f"`{f.name}`"] for f in kept], *[df[f"`{c}`"].alias(f"__in_{k}") for k, c in enumerate(reads)]
    )
    n_kept, n_reads, types = len(kept), len(reads), [arrow_type(f.dataType) for f in adds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches if size is None else parts_of(batches, n_kept, size):
            out = fn(*[batch.column(n_kept + k) for k in range(n_reads)])
            cols = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_kept], *cols], [*batch.schema.names[:n_kept], *[f.name for f in adds]]
            )
        getattr(fn, "end", lambda: None)()
        del fn
        release()

    return inner.mapInArrow(run, schema)


def parts_of(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches in parts of some ``size`` bytes of a column of texts; no row is cut."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = np.cumsum(lengths) // size
        edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a < b:
                yield batch.slice(a, b - a)
        del batch


def release() -> None:
    """Gives a worker's unused memory back to the machine: workers live on and share an executor with its JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` where every executor can read it again and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``.  Where none is set one is made beside the warehouse on a local
    master (tests on one machine); on a cluster that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
            where = os.path.join(warehouse, "_checkpoints")
        sc.setCheckpointDir(where)
    return df.checkpoint()


#: What a join may send to every executor: rows, and bytes where rows are of unbounded size.
SEND_ROWS, SEND_BYTES = 2_000_000, 16_000_000


def join_checked(big: DataFrame, small: DataFrame, key: str, how: str, size: Column | None = None) -> DataFrame:
    """Joins on ``key``; ``small`` is broadcast if it is within the bounds, which is measured first, else both are
    shuffled, by a key that is no partitioning of either side, so that Spark may split large partitions.

    ``small`` is read twice and should be a checkpoint; ``size`` is the bytes of a row where these are unbounded.
    """
    n, total = small.agg(F.count("*"), F.coalesce(F.sum(F.lit(16) if size is None else size), F.lit(0))).first()
    if n <= SEND_ROWS and total <= 2 * SEND_BYTES:
        return big.join(F.broadcast(small), key, how)
    nothing = F.lit(b"") if dict(small.dtypes)[key] == "binary" else F.lit("")
    other = small.withColumnRenamed(key, "__other")
    joined = big.join(other, F.concat(F.col(key), nothing) == F.concat(F.col("__other"), nothing), how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("__other")
