"""Sources: page spans, raw documents with admission checks, stored documents."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from quire.settings import Settings

SPANS = (
    "document_id STRING, page_number INT, page_width DOUBLE, page_height DOUBLE, block_no INT, line_no INT, span_no INT, text STRING, font STRING, "
    "size DOUBLE, flags INT, color INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
)
BLOCK = (
    "id: STRING, page_number: INT, type: STRING, role: STRING, confidence_score: DOUBLE, source_text: STRING, translated_text: STRING, bbox: ARRAY<DOUBLE>, "
    "reading_order: INT, style: STRUCT<font: STRING, size: DOUBLE, bold: BOOLEAN, italic: BOOLEAN, color: STRING, alignment: STRING>, status: STRING, "
    "warnings: ARRAY<STRING>"
)
DOCUMENT = (
    "document_id STRING, source_language STRING, target_language STRING, domain STRING, pages ARRAY<STRUCT<page_number: INT, width: DOUBLE, height: DOUBLE, "
    f"blocks: ARRAY<STRUCT<{BLOCK}>>>>, warnings ARRAY<STRING>"
)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.first, self.last = path, 1, 1 << 31

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Page ranges are applied here; everything else stays with Spark."""
        for f in filters:
            if f.attribute == ("page_number",) and isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual)):
                if not isinstance(f, LessThanOrEqual):
                    self.first = max(self.first, f.value)
                if not isinstance(f, GreaterThanOrEqual):
                    self.last = min(self.last, f.value)
            else:
                yield f

    def partitions(self) -> list[_File]:
        if os.path.isdir(self.path):
            return [_File(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if n.endswith(".jsonl")]
        return [_File(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        names = [c.split()[0] for c in SPANS.split(", ")]
        with open(partition.path, encoding="utf-8") as lines:
            for line in lines:
                row = json.loads(line)
                if self.first <= row["page_number"] <= self.last:
                    yield tuple(row.get(n) for n in names)


class SpanSource(DataSource):
    """``format("page_spans")``: JSON lines of spans, a file a partition, page ranges pushed into the reader."""

    @classmethod
    def name(cls) -> str:
        return "page_spans"

    def schema(self) -> str:
        return SPANS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Stored documents, one JSON object a file or line, by their fixed schema."""
    return spark.read.schema(DOCUMENT).json(path)


def flat_blocks(documents: DataFrame) -> DataFrame:
    """One row for each block of nested documents, boxes as four columns."""
    rows = documents.select("document_id", F.explode("pages").alias("p")).select("document_id", F.col("p.height").alias("page_height"), F.posexplode("p.blocks").alias("pos", "b"))
    return rows.select("document_id", "page_height", "pos", "b.*").withColumns({c: F.col("bbox")[k] for k, c in enumerate(("x0", "y0", "x1", "y1"))}).drop("bbox")


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def admission(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Each file (path, mime, length, content) with ``code`` and ``http_status`` of what refuses it; null if it is admitted."""
    name = F.lower("path").endswith(".pdf") & (F.col("mime") == "application/pdf")
    magic = F.coalesce(F.substring("content", 1, 4) == F.lit(b"%PDF"), F.lit(False))
    code = F.when(~name, "INVALID_FILE_TYPE").when(F.col("length") > settings.max_file_size_mb * 1024 * 1024, "FILE_TOO_LARGE").when(~magic, "INVALID_FILE_TYPE")
    return files.withColumn("code", code).withColumn("http_status", F.when(F.col("code") == "FILE_TOO_LARGE", 413).when(F.col("code").isNotNull(), 400))


def page_limits(blocks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Documents with their page count and the code that refuses them: too many pages, or no text on any."""
    most = settings.batch_max_pages if settings.batch_mode else settings.max_pages
    t = blocks.groupBy("doc_id").agg(F.max("page_number").alias("page_count"), F.max(F.length(F.trim("source_text"))).alias("__longest"))
    code = F.when(F.col("page_count") > most, "TOO_MANY_PAGES").when(F.col("__longest") == 0, "NO_SELECTABLE_TEXT")
    return t.select("doc_id", "page_count", code.alias("code"))


def existing(wanted: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wanted documents that are stored, and the others with their error code."""
    keys = stored.select("doc_id")
    return wanted.join(keys, "doc_id", "left_semi"), wanted.join(keys, "doc_id", "left_anti").withColumn("code", F.lit("DOCUMENT_NOT_FOUND"))


def write(df: DataFrame, path: str, replace: bool = True) -> None:
    """Parquet in full; without ``replace`` an existing store is an error."""
    df.write.mode("overwrite" if replace else "errorifexists").parquet(path)


def export_json(documents: DataFrame, path: str) -> None:
    documents.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def register(spark: SparkSession) -> None:
    """Makes ``format("page_spans")`` known and lets page ranges reach its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SpanSource)
