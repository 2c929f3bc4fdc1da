"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; the rank over the
source's size is a row's place between 0 and 1.  Sorted by that place the
sources interleave in proportion, and cuts of equal length are shards that all
have the corpus's mixture.  The law kept is ``rows``: counts differ by one at most.

No window runs over a whole source or the whole table: ranks are counted inside
small hash ranges, to which the counts of the ranges before are added.  A source
with a third of all rows is spread over as many ranges as its rows need.

Edge cases: a null source is a source of its own; null texts have size 1; equal
rows are separate rows in an undefined mutual order, each with a slot of its own;
an empty table gives an empty result; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS, SEED = 8, 20
#: Rows that a range of hashes or places holds on average.
RANGE_ROWS = 20_000


def shuffle_key(seed: int, *cols: Column) -> Column:
    """Seeded pseudo-random hex text of the given columns, the same in any engine that has md5."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).cast("binary"))


def positions(df: DataFrame, source: str, key: str, ties: list[str]) -> DataFrame:
    """``df`` with ``__pos``: the 0-based place of each row in the interleaved order, and ``__total``."""
    total = df.agg(F.count("*").alias("n")).first().n
    ranges = max(1, -(-total // RANGE_ROWS))
    share = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    df = df.withColumn("__src", F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit(""))).withColumn("__r", F.floor(share * ranges).cast("int"))
    sizes = df.groupBy("__src", "__r").agg(F.count("*").alias("__n"))
    over = Window.partitionBy("__src")
    before = sizes.select(
        "__src", "__r",
        (F.sum("__n").over(over.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"),
        F.sum("__n").over(over).alias("__of"),
    )
    inside = Window.partitionBy("__src", "__r").orderBy(key, *ties)
    ranked = df.withColumn("__k", F.row_number().over(inside)).join(before, ["__src", "__r"])
    # places of equal value come from sources of equal size; the hash decides between them
    place = ((F.col("__before") + F.col("__k")).cast("double") - 0.5) / F.col("__of")
    ranked = ranked.withColumn("__place", place).withColumn("__q", F.least(F.floor(place * ranges), F.lit(ranges - 1)).cast("int"))
    sizes = ranked.groupBy("__q").agg(F.count("*").alias("__n"))
    # one row for each range: total / RANGE_ROWS rows in this window
    before = sizes.select("__q", (F.sum("__n").over(Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__ahead"))
    inside = Window.partitionBy("__q").orderBy("__place", key, "__src", *ties)
    out = ranked.withColumn("__i", F.row_number().over(inside)).join(F.broadcast(before) if ranges < 100_000 else before, "__q")
    pos = (F.col("__ahead") + F.col("__i") - 1).alias("__pos")
    return out.select(*[c for c in df.columns if c not in ("__src", "__r")], pos, F.lit(total).cast("long").alias("__total"))


def interleave(df: DataFrame, shards: int = SHARDS, seed: int = SEED, source: str = "source", ids: tuple[str, ...] = ("doc_id",), ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``shard`` and ``slot``; every shard has the mixture of sources of the whole.

    ``ids`` seed the shuffle, ``ties`` order rows of equal ids.  Columns of ``df``
    named shard or slot are replaced.  Shard s holds places ceil(s*n/shards) on.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    keyed = df.select(*[f"`{c}`" for c in kept], shuffle_key(seed, *[F.col(f"`{c}`") for c in ids]).alias("__key"))
    placed = positions(keyed, source, "__key", [*ids, *ties])
    pos, n = F.col("__pos"), F.col("__total")
    shard = F.expr(f"(__pos * {shards}) div __total")
    placed = placed.withColumn("shard", shard.cast("int"))
    start = F.expr(f"(shard * __total + {shards - 1}) div {shards}")
    return placed.select(*[f"`{c}`" for c in kept], "shard", (pos - start).cast("long").alias("slot"))
