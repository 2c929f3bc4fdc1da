"""Page batches: tiling, manifests with resume, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_batches(pages: DataFrame, size: int = 5) -> DataFrame:
    """Inclusive page ranges of each document (doc_id, page_count); documents without pages have none."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    starts = F.explode(F.when(F.col("page_count") > 0, F.sequence(F.lit(1), F.col("page_count").cast("int"), F.lit(size))))
    rows = pages.select("doc_id", "page_count", starts.alias("page_start"))
    return rows.select(
        "doc_id", F.format_string("batch_%03d", F.expr(f"(page_start - 1) div {size} + 1")).alias("batch_id"), "page_start",
        F.least(F.col("page_start") + size - 1, F.col("page_count")).cast("int").alias("page_end"),
    )


def with_batch(blocks: DataFrame, size: int = 5) -> DataFrame:
    """The range join of blocks and batches: batches tile the pages, so a block's batch follows from its page."""
    return blocks.withColumn("batch_id", F.format_string("batch_%03d", F.expr(f"(page_number - 1) div {size} + 1")))


def batch_status(blocks: DataFrame, size: int = 5) -> DataFrame:
    """One row for each batch of blocks (status, warnings, translated_text): counts, state, warnings in order."""
    done = F.col("status").isin("translated", "skipped", "pending")
    rows = with_batch(blocks, size).groupBy("doc_id", "batch_id").agg(
        F.count("*").alias("blocks_count"), F.count_if(F.trim("translated_text") != "").alias("translated_blocks_count"),
        F.bool_or(F.col("status") == "failed").alias("__failed"), F.bool_or(F.col("status") == "needs_review").alias("__review"), F.bool_and(done).alias("__done"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "warnings"))), lambda x: x["warnings"]))).alias("__w"),
    )
    state = F.when(F.col("__failed"), "failed").when(F.col("__review"), "needs_review").when(F.col("__done"), "completed").otherwise("pending")
    return rows.select("doc_id", "batch_id", "blocks_count", "translated_blocks_count", state.alias("status"), F.array_join("__w", ",").alias("warnings"))


def batch_summary(manifests: DataFrame) -> DataFrame:
    return manifests.groupBy("doc_id").agg(
        F.count("*").alias("total_batches"), F.count_if(F.col("status") == "completed").alias("completed_batches"), F.count_if(F.col("status") == "failed").alias("failed_batches")
    )


def upsert_manifests(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Planned batches with the state that is known already, ``pending`` else."""
    known = existing.select("doc_id", "batch_id", F.col("status").alias("__status"))
    return planned.join(known, ["doc_id", "batch_id"], "left").withColumn("status", F.coalesce("__status", F.lit("pending"))).drop("__status")


def open_batches(planned: DataFrame, manifests: DataFrame) -> DataFrame:
    """Planned batches that are not completed: what a resumed run has to do."""
    return planned.join(manifests.where(F.col("status") == "completed"), ["doc_id", "batch_id"], "left_anti")


def renumber(blocks: DataFrame) -> DataFrame:
    """Document-wide ``block_id`` and per-page ``reading_order`` after a merge."""
    whole, page = Window.partitionBy("doc_id").orderBy("page_number", "y0", "x0", "pos"), Window.partitionBy("doc_id", "page_number").orderBy("y0", "x0", "pos")
    return blocks.withColumn("block_id", F.format_string("block_%03d", F.row_number().over(whole))).withColumn("reading_order", F.row_number().over(page))


def merge(batches: list[DataFrame]) -> DataFrame:
    """All blocks of the batches, renumbered."""
    if not batches:
        raise ValueError("no batch to merge")
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return renumber(out)


def payload_warnings(batches: DataFrame) -> DataFrame:
    """Warnings of a document's batches (doc_id, batch_id, warnings), each once, in the order of the first batch that has it."""
    rows = batches.select("doc_id", "batch_id", F.posexplode("warnings").alias("k", "warning"))
    first = rows.groupBy("doc_id", "warning").agg(F.min(F.struct("batch_id", "k")).alias("at"))
    return first.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "warning"))), lambda x: x["warning"]), ",").alias("warnings"))


#: What a stored batch without these values has (fixed values).
PAYLOAD_DEFAULTS = {"source_language": "en", "target_language": "fr", "domain": "general"}


def payloads(manifests: DataFrame) -> DataFrame:
    """Payloads of completed batches from their manifests: absent or null languages and domain by default, counts 0."""
    own = {c: (F.coalesce(F.col(c), F.lit(v)) if c in manifests.columns else F.lit(v)) for c, v in PAYLOAD_DEFAULTS.items()}
    done = F.coalesce(F.col("translated_blocks_count"), F.lit(0)) if "translated_blocks_count" in manifests.columns else F.lit(0)
    return manifests.where("status = 'completed'").withColumns({**own, "translated_blocks_count": done})


def progress(manifests: DataFrame) -> DataFrame:
    """Share of the work done: from 20, 60 points over the batches in order, 90 when all are complete."""
    s = batch_summary(manifests)
    return s.select("doc_id", F.when(F.col("completed_batches") == F.col("total_batches"), 90).otherwise(F.expr("20 + (60 * completed_batches) div total_batches")).cast("int").alias("progress"))
