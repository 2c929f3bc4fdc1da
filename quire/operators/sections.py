"""Sections: titles open them, blocks belong to the last one opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire import lexicon as L
from quire.functions import text as X


def sectioned(blocks: DataFrame) -> DataFrame:
    """Title, paragraph and list blocks with ``section_no`` (from 1, gapless in a document) and ``section_title``."""
    order = Window.partitionBy("doc_id").orderBy("page_number", "pos")
    own = blocks.where(F.col("type").isin(*L.SECTION_TYPES)).withColumn("opened", F.sum((F.col("type") == "title").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # content before the first title is a section of its own
    lead = F.max((F.col("opened") == 0).cast("int")).over(Window.partitionBy("doc_id"))
    title = F.first(F.when(F.col("type") == "title", X.normalize("source_text")), ignorenulls=True).over(Window.partitionBy("doc_id", "opened"))
    return own.withColumn("section_no", F.col("opened") + lead).withColumn("section_title", F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled section"))).drop("opened")


def sections(blocks: DataFrame) -> DataFrame:
    """One row for each section: id, title, pages, block positions in order, their number."""
    rows = sectioned(blocks).groupBy("doc_id", "section_no", "section_title").agg(
        F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"),
        F.array_join(F.transform(F.array_sort(F.collect_set("pos")), lambda x: x.cast("string")), ",").alias("block_ids"), F.countDistinct("pos").alias("blocks_count"),
    )
    return rows.select("doc_id", F.format_string("section_%03d", "section_no").alias("section_id"), F.col("section_title").alias("title"), "page_start", "page_end", "block_ids", "blocks_count")


def neighbours(blocks: DataFrame) -> DataFrame:
    """Source of the eligible block before and after in the same section, empty at its ends."""
    from quire.operators.translate import should_translate

    order = Window.partitionBy("doc_id", "section_no").orderBy("page_number", "pos")
    own = sectioned(blocks).where(should_translate("type", "source_text"))
    return own.select("doc_id", "pos", "section_no", *[F.coalesce(f("source_text").over(order), F.lit("")).alias(n) for f, n in ((F.lag, "previous_text"), (F.lead, "next_text"))])


def section_lookup(blocks: DataFrame) -> DataFrame:
    """Every block with its section's title, empty outside sections: windows over all blocks, so that they are worked out once."""
    order = Window.partitionBy("doc_id").orderBy("page_number", "pos")
    opened = F.sum((F.col("type") == "title").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    title = F.first(F.when(F.col("type") == "title", X.normalize("source_text")), ignorenulls=True).over(Window.partitionBy("doc_id", "__opened"))
    named = F.when(F.col("type").isin(*L.SECTION_TYPES), F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled section")))
    return blocks.withColumn("__opened", F.coalesce(opened, F.lit(0))).withColumn("section_title", F.coalesce(named, F.lit(""))).drop("__opened")


def contained_in_section(blocks: DataFrame) -> DataFrame:
    """Texts of one to three words that stand as whole words in a longer text of their section: a left semi join on document
    and section, of the short texts only."""
    own = sectioned(blocks).withColumn("__n", X.semantic_form("source_text")).withColumn("__w", X.word_count("__n"))
    longer = own.select("doc_id", "section_no", F.col("pos").alias("__pos"), F.col("__n").alias("__m"), F.col("__w").alias("__v"))
    short = own.where((F.col("__n") != "") & (F.col("__w") <= 3))
    inside = F.regexp_like("__m", F.concat(F.lit(r"(?U)\b\Q"), "__n", F.lit(r"\E\b")))
    test = (F.col("pos") != F.col("__pos")) & (F.col("__v") > F.col("__w")) & F.col("__m").contains(F.col("__n")) & inside
    same = [short[c] == longer[c] for c in ("doc_id", "section_no")]
    return short.join(longer, [*same, test], "left_semi").drop("__n", "__w")


def rebuilt_sections(batches: list[DataFrame]) -> DataFrame:
    """The sections of a merged document, with the block ids that the merge gave."""
    from quire.operators.batches import merge

    own = sectioned(merge(batches)).groupBy("doc_id", "section_no", "section_title").agg(
        F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "pos", "block_id"))), lambda x: x["block_id"]), ",").alias("block_ids"),
    )
    return own.select("doc_id", F.format_string("section_%03d", "section_no").alias("section_id"), F.col("section_title").alias("title"), "page_start", "page_end", "block_ids")
