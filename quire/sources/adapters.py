"""Documents and web pages as layout blocks, row by row: no shuffle.

A line of a text is a block; five lines are a page.  Places on the page, sizes and
stand-in translations follow from position and length alone, so that any engine can
repeat them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import classify

LINES_A_PAGE, PAGE_WIDTH, PAGE_HEIGHT = 5, 595.0, 842.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def line_blocks(documents: DataFrame) -> DataFrame:
    """One row for each line: doc_id, pos, page_number, source_text, x0..y1, size, bold, page_avg, type."""
    lines = documents.select("doc_id", F.split("text", "\n", -1).alias("ls"))
    lines = lines.selectExpr("doc_id", "ls", "transform(ls, x -> 12 + if(length(x) % 3 = 0, 30, 2)) AS steps")
    rows = lines.selectExpr(
        "doc_id",
        """posexplode(transform(ls, (x, i) -> named_struct('source_text', x,
             'y0', 100D + aggregate(slice(steps, int(i - i % 5 + 1), int(i % 5)), 0, (a, s) -> a + s),
             'full', size(filter(slice(ls, int(i - i % 5 + 1), 5), y -> trim(y) <> '')),
             'head', i < 5 AND trim(ls[0]) <> ''))) AS (pos, b)""",
    )
    rows = rows.selectExpr(
        "doc_id", "pos", "int(pos div 5 + 1) AS page_number", "b.source_text AS source_text", "72D AS x0",
        "72D + least(451, 5 * length(b.source_text)) AS x1", "b.y0 AS y0", "b.y0 + 12 AS y1", "if(pos = 0, 16D, 11D) AS size", "pos = 0 AS bold",
        "if(b.full = 0, 0D, (11D * b.full + if(b.head, 5D, 0D)) / b.full) AS page_avg",
    )
    return rows.withColumn("type", classify("source_text", "size", "page_avg", "y0", "y1", "bold", F.lit(PAGE_HEIGHT)))


def untranslated(blocks: DataFrame) -> DataFrame:
    """The blocks that ``stand_in`` leaves without a translation."""
    return blocks.where(F.col("pos") % 11 == 7)


def stand_in(blocks: DataFrame) -> DataFrame:
    """``translated_text`` by position: absent (pos % 11 = 7), a copy of the source (pos % 3 = 1), else the mock provider's."""
    from quire.operators.translate import mock_translate

    text = F.when(F.col("pos") % 11 == 7, F.lit("")).when(F.col("pos") % 3 == 1, F.col("source_text")).otherwise(mock_translate(F.col("source_text")))
    return blocks.withColumn("translated_text", text)


def web_blocks(pages: DataFrame) -> DataFrame:
    """Navigation (header), headings, paragraphs, list items and footers of a page, in order of kind, tags stripped.

    A paragraph ends at the next tag that is not an inline one, as many are not closed.
    """
    inline = F.regexp_replace(F.regexp_replace("html", "<br[^>]*>", " "), "</?(?:a|b|i|u|em|strong|span|code|small|sub|sup)(?: [^>]*)?>", "")

    def found(pattern: str, kind: str):
        parts = F.regexp_extract_all(inline if kind == "paragraph" else F.col("html"), F.lit(pattern), F.lit(1))
        return F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("type"), i.alias("k"), _plain(x).alias("source_text")))

    both = F.concat(found(r"(?s)<nav>(.*?)</nav>", "header"), found(r"(?s)<h1>(.*?)</h1>", "title"), found(r"<p>([^<]*)", "paragraph"), found(r"(?s)<li>(.*?)</li>", "list_item"), found(r"(?s)<footer>(.*?)</footer>", "footer"))
    return pages.select("page_id", F.posexplode(both).alias("pos", "b")).select("page_id", "pos", F.col("b.type").alias("type"), F.col("b.source_text").alias("source_text"))


def _plain(x):
    return F.trim(F.regexp_replace(F.replace(F.regexp_replace(x, "<[^>]*>", " "), F.lit("&amp;"), F.lit("&")), r"\s+", " "))
