"""Line dedup by site-relative frequency, in built-in Spark functions only.

A line's frequency is the share of its host's pages that contain it.  Lines
above ``max_ratio`` on at least ``min_pages`` pages of the host are boilerplate
and go from every page of that host; all others stay, in order.

The pages of a line are counted from lines made distinct inside their page
first, so counting is one sum with partial sums on the map side: a line or host
that holds a third of all rows arrives as one row for each map task.  A host
has at most (lines a page / max_ratio) boilerplate lines, whatever its number of
pages; these come back to the pages as one list for each host: broadcast if their
measured size is within a bound, else by an outer join that Spark splits.

Edge cases: lines compare without blanks at their ends; blank lines are never
counted or dropped; a null text stays null and counts as a page of its host;
null hosts are one host; equal rows are separate pages; an empty table gives an
empty result; a column of the input with the name of an added one is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpoint, join_checked

#: A line on more than this share of its host's pages is boilerplate (lines that meet by chance stay far below),
MAX_RATIO = 0.01
#: if at least so many pages have it.
MIN_PAGES = 5
BLANKS = " \t\x0b\x0c\r"


def host_of(url):
    """Host of an absolute URL, lower case, without user and port; null for other texts."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row for each host with boilerplate: ``__host``, ``__bad`` (its lines)."""
    rows = pages.select(_host(host), F.explode(F.array_distinct(_lines(text))).alias("__line")).where("__line <> ''")
    counts = rows.groupBy("__host", "__line").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_pages)
    totals = pages.select(_host(host)).groupBy("__host").agg(F.count("*").alias("__pages"))
    bad = counts.join(totals, "__host").where(F.col("__n") > F.lit(max_ratio) * F.col("__pages"))
    return bad.groupBy("__host").agg(F.collect_list("__line").alias("__bad"))


def _host(host: str):
    return F.coalesce(F.concat(F.lit("h"), F.col(f"`{host}`").cast("string")), F.lit("")).alias("__host")


def _lines(text: str):
    return F.transform(F.split(F.col(f"`{text}`"), "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)))


def line_dedup(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``, and ``n_lines``, ``n_dropped``: lines before, and dropped."""
    bad = checkpoint(boilerplate(pages, host, text, max_ratio, min_pages))
    kept = [c for c in pages.columns if c.lower() not in ("n_lines", "n_dropped")]
    size = F.aggregate("__bad", F.octet_length("__host").cast("long"), lambda n, x: n + F.octet_length(x) + 16)
    joined = join_checked(pages.select(*[F.col(f"`{c}`") for c in kept], _host(host)), bad, "__host", "left", size)
    lines = F.split(F.col(f"`{text}`"), "\n", -1)
    left = F.filter(lines, lambda x: ~F.array_contains("__bad", F.trim(x, F.lit(BLANKS))))
    joined = joined.withColumn("__left", F.when(F.col("__bad").isNotNull(), left))
    before, after = F.coalesce(F.size(lines), F.lit(0)), F.size("__left")
    return joined.select(
        *[F.coalesce(F.array_join("__left", "\n"), F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in kept],
        F.when(F.col(f"`{text}`").isNull(), F.lit(0)).otherwise(before).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("__left").isNotNull(), before - after), F.lit(0)).cast("long").alias("n_dropped"),
    )
