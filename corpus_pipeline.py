"""The corpus pipeline over ``documents``: quality rules, line dedup, near duplicates, benchmark
decontamination, byte-level BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept; all but the last return the columns of ``documents``.  ``n_chars`` follows
the text.  Edge cases are those of the operators (see their modules): null texts
fail the quality rules; an empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality_rules
from quire.llm.common import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now."""
    length = F.length("text").cast("long")
    return docs.select("doc_id", "text", "lang", "source", length.alias("n_chars"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the rules or the trees reject go."""
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(docs.select(*COLUMNS), model).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: boilerplate lines of a source go."""
    return _documents(line_dedup.line_dedup(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each class of near duplicates stays."""
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: benchmark passages are cut from the texts."""
    return _documents(decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token ids of each text, and digests of the ids and of the text decoded from them."""
    return byte_bpe.encode_texts(docs.select(*COLUMNS), digests=True).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontaminate", benchmark), ("byte_bpe", encode)]

#: The trees of the first stage have no SQL form; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
