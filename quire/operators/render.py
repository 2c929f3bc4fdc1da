"""Render operations: what a document writer has to do, as rows in order; masks and texts laid over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import lexicon as L
from quire.functions import geometry as G
from quire.functions import text as X
from quire.functions.text import among

MARKER = r"^\s*([-*•‣▪]|\d+[.)]|[A-Za-z][.)])\s+"


def output_text():
    return F.coalesce(F.nullif(F.trim("translated_text"), F.lit("")), F.trim("source_text"))


def document_ops(blocks: DataFrame, captions: bool = False) -> DataFrame:
    """Rows (doc_id, seq, op, text, level): headings, bullets without their marker, small print; captions only on wish."""
    kind = F.col("type")
    repeated = F.coalesce(F.col("role").startswith("repeating_"), F.lit(False)) if "role" in blocks.columns else F.lit(False)
    op = (
        F.when(kind == "title", "heading").when(among(kind, ["header", "footer"]) & ~repeated, "discreet").when(kind == "list_item", "bullet")
        .when(kind == "footnote", "footnote").when(among(kind, ["paragraph", "unknown"]), "paragraph").when((kind == "caption") & F.lit(captions), "paragraph")
    )
    text = F.when(kind == "list_item", F.regexp_replace(output_text(), MARKER, "")).otherwise(output_text())
    rows = blocks.withColumn("op", op).withColumn("text", text).where(F.col("op").isNotNull() & (F.col("text") != ""))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "pos"))
    return rows.select("doc_id", seq.alias("seq"), "page_number", "op", "text", F.when(F.col("op") == "heading", F.when(F.col("size") >= 18, 1).otherwise(2)).alias("level"))


def quality_ok():
    short = (F.size(X.words_split("source_text")) <= 4) & ((F.col("size") >= 12) | F.forall(X.words_split("source_text"), X.starts_upper)) & (F.col("type") == "title")
    fine = F.coalesce(F.col("translation_quality") >= 0.35, F.lit(True))
    meant = short | (~among(F.col("semantic_category"), ["probable_fragment", "semantic_noise"]) & F.coalesce(F.col("semantic_confidence") >= 0.45, F.lit(True)))
    return fine & meant


def should_mask():
    return among(F.col("type"), [*L.SCORED_TYPES, "table"]) & ~F.array_contains("warnings", "noise_block") & (F.trim("source_text") != "") & (F.col("x1") - F.col("x0") >= 2) & (F.col("y1") - F.col("y0") >= 2)


def should_write():
    bad = F.array_contains("warnings", "english_residual") | F.array_contains("warnings", "noise_block")
    return among(F.col("type"), L.SCORED_TYPES) & ~bad & quality_ok() & (F.trim("translated_text") != "")


def overlay_ops(scored: DataFrame, width: float = 595.0, height: float = 842.0, pad: float = 1.5) -> DataFrame:
    """Mask, write and fallback operations: a mask without a write gets its translation with a note, or a note alone."""
    box = F.struct(*[F.round(x, 2).alias(c) for x, c in zip(G.expand(G.box(), F.lit(pad), F.lit(width), F.lit(height)), ("x0", "y0", "x1", "y1"))])
    rows = scored.withColumn("box", box).withColumn("mask", should_mask()).withColumn("write", should_write())
    has = F.trim("translated_text") != ""
    one = lambda op, text, warning: F.struct(F.lit(op).alias("op"), text.alias("text"), F.lit(warning).cast("string").alias("warning"))
    ops = F.array_compact(F.array(
        F.when(F.col("mask"), one("mask", F.lit(""), None)), F.when(F.col("write"), one("write", F.trim("translated_text"), None)),
        F.when(F.col("mask") & ~F.col("write") & has, one("fallback", F.trim("translated_text"), "overlay_written_with_review")),
        F.when(F.col("mask") & ~F.col("write") & ~has, one("fallback", F.lit("[review]"), "masked_without_translation")),
    ))
    return rows.select("doc_id", "page_number", "pos", "size", "box", F.explode(ops).alias("o")).select("doc_id", "page_number", "pos", "size", "box.*", "o.*")


def fitted(ops: DataFrame) -> DataFrame:
    """The largest whole size from the block's (7 to 18) down to 7 at which the text's lines fit the box."""
    w, h, start = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.greatest(F.least(F.col("size"), F.lit(18.0)), F.lit(7.0)).cast("int")
    sizes = F.filter(F.sequence(F.lit(7), start), lambda s: X.line_count("text", w, s.cast("double")) * s * 1.2 <= h)
    return ops.withColumn("font_size", F.coalesce(F.array_max(sizes), F.lit(7))).withColumn("overflow", F.size(sizes) == 0)


def mask_zones(ops: DataFrame) -> DataFrame:
    """All masks of a page together, in order: what a writer clears in one pass before it writes; pictures and lines stay."""
    zone = F.struct("pos", "x0", "y0", "x1", "y1")
    return ops.where("op = 'mask'").groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(zone)), lambda z: F.array(z["x0"], z["y0"], z["x1"], z["y1"])).alias("zones"))


def cell_text() -> Column:
    return F.coalesce(F.nullif(F.trim("translated_text"), F.lit("")), F.col("source_text"), F.lit(""))


def table_rows(cells: DataFrame) -> DataFrame:
    """Rows of each table in order, as a document writer fills them: texts of the columns, translated where they are."""
    cell = F.struct("column_index", cell_text().alias("text"))
    return cells.groupBy("doc_id", "page_number", "table_no", "row_index").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["text"]).alias("texts"))


def table_overlay(cells: DataFrame, weak: DataFrame, width: float = 595.0, height: float = 842.0, pad: float = 0.75, most: float = 9.0) -> DataFrame:
    """Writing operations of tables: one for each filled cell, with a note where its translation is missing; a table whose
    grid is too unsure (``weak``: doc_id, page_number, table_no, is_weak) is one block of lines instead."""
    own = ["doc_id", "page_number", "table_no"]
    judged = cells.join(weak.select(*own, "is_weak"), own, "left").withColumn("is_weak", F.coalesce("is_weak", F.lit(False)))
    has, source = F.trim(F.coalesce("translated_text", F.lit(""))), F.trim(F.coalesce("source_text", F.lit("")))
    box = lambda margin: [F.round(x, 2).alias(c) for x, c in zip(G.expand(G.box(), F.lit(margin), F.lit(width), F.lit(height)), ("x0", "y0", "x1", "y1"))]
    sure = judged.where(~F.col("is_weak") & ~F.col("empty_cell") & ((has != "") | (source != "")))
    sure = sure.select(*own, "row_index", "column_index", F.when(has != "", has).otherwise(F.lit("[review]")).alias("text"), F.when(has == "", "masked_without_translation").alias("warning"), *box(pad))
    lines = table_rows(judged.where("is_weak")).where(F.exists("texts", lambda t: F.trim(t) != ""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", F.array_join("texts", " | ").alias("t")))), lambda x: x["t"]), "\n")
    extent = judged.where("is_weak").groupBy(*own).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    plain = extent.join(lines.groupBy(*own).agg(text.alias("text")), own, "left")
    plain = plain.select(*own, F.lit(0).alias("row_index"), F.lit(0).alias("column_index"), F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("[review]")).alias("text"), F.lit("weak_table_grid_detection").alias("warning"), *box(1.5))
    return fitted(sure.unionByName(plain).withColumn("size", F.lit(10.0))).withColumn("font_size", F.least(F.col("font_size").cast("double"), F.lit(most))).drop("size")


def gates(blocks: DataFrame) -> DataFrame:
    """Why a document cannot be laid over yet: one conditional count each, the first that fails.  Only blocks whose status is
    translated count as done; ratios are of text blocks, tables only save a document from being not ready."""
    on, none = among(F.col("type"), L.SCORED_TYPES), F.coalesce(F.trim("translated_text"), F.lit("")) == ""
    done = ~none & (F.col("status") == "translated")
    t = blocks.groupBy("doc_id").agg(
        F.count_if(on).alias("n"), F.count_if(on & done).alias("done"), F.count_if((F.col("type") == "table") & done).alias("tables"), F.count_if(on & none & ~among(F.col("status"), ["skipped", "needs_review"])).alias("empty"),
        F.count_if(on & (F.col("status") == "needs_review") & F.coalesce(F.col("warning") == "english_residual", F.lit(False))).alias("residual"),
    )
    gate = F.when((F.col("done") == 0) & (F.col("tables") == 0), "TRANSLATION_NOT_READY").when(F.col("empty") > 0.2 * F.col("n"), "TRANSLATION_INCOMPLETE").when(F.col("residual") > 0.3 * F.col("n"), "TRANSLATION_QUALITY_FAILED").otherwise("READY")
    return t.select("doc_id", "n", "done", gate.alias("gate"))
