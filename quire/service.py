"""What a caller of the engine needs around its queries: where results lie, ids, time, health."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def storage_root(path: str | None = None) -> str:
    """The folder that results are written below: the path given, else QUIRE_STORAGE_ROOT; any store that Spark reads."""
    root = path or os.environ.get("QUIRE_STORAGE_ROOT")
    if not root:
        raise ValueError("no storage root: give a path that all executors share, or set QUIRE_STORAGE_ROOT")
    return root.rstrip("/")


def document_id() -> Column:
    """A new random id for each row.  Write the rows before using it twice."""
    return F.concat(F.lit("doc_"), F.replace(F.uuid(), F.lit("-"), F.lit("")))


def now_utc() -> str:
    """The time in UTC, to the second, as ISO 8601 with a Z."""
    return datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def health(spark: SparkSession) -> dict[str, str]:
    """Whether the session still runs jobs."""
    return {"status": "ok" if spark.range(1).count() == 1 else "error", "version": spark.version}


#: Messages of the codes that admission and gates give (fixed values are the codes).
MESSAGES = {
    "UNSUPPORTED_FILE_TYPE": "The file is not a PDF.", "FILE_TOO_LARGE": "The file is larger than the limit.", "EMPTY_FILE": "The file is empty.",
    "TOO_MANY_PAGES": "The document has more pages than the limit.", "NO_SELECTABLE_TEXT": "The document has no text that can be selected.",
    "DOCUMENT_NOT_FOUND": "The document is not there.", "RESULT_NOT_READY": "The result is not there yet.", "PROCESS_ALREADY_RUNNING": "The document is being processed.",
    "TRANSLATION_NOT_READY": "The document is not translated yet.", "TRANSLATION_INCOMPLETE": "Too many blocks are not translated.",
    "TRANSLATION_QUALITY_FAILED": "Too many blocks need a review.", "INTERNAL_ERROR": "Something went wrong.",
}


def error(code: Column, details: Column | None = None) -> Column:
    """struct(code, message, details) of a code column; null where there is no code."""
    known = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    body = F.struct(code.alias("code"), F.coalesce(known[code], F.lit(MESSAGES["INTERNAL_ERROR"])).alias("message"), (details if details is not None else F.lit(None).cast("string")).alias("details"))
    return F.when(code.isNotNull(), body)
