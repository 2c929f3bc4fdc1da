"""Streams of job events: running counts in time windows, and the last state of each document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.jobs import event_status


def read_events(spark: SparkSession, folder: str, schema, files_a_trigger: int = 1) -> DataFrame:
    """Event files as a stream; times without a zone are taken in the session's, as watermarks need an instant."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def status_windows(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events of each status in windows of event time; rows later than the watermark are left out."""
    rows = events.withWatermark("ts", late).withColumn("status", event_status())
    return rows.groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "status", "n")


def _transition(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Guarded transitions of one document: a queue request while it is queued or processing is refused."""
    status, seen = state.get if state.exists else ("uploaded", 0)
    out = []
    for rows in batches:
        for row in rows.sort_values(["ts", "event_id"]).itertuples():
            refused = row.status == "queued" and status in ("queued", "processing")
            out.append((key[0], row.event_id, row.status, status, "PROCESS_ALREADY_RUNNING" if refused else None))
            status, seen = (status if refused else row.status), seen + 1
    state.update((status, seen))
    yield pd.DataFrame(out, columns=["doc_id", "job_id", "requested", "before", "code"])


def transitions(events: DataFrame) -> DataFrame:
    """Each event with the state it met and the code that refuses it; the state of a document is its status and count."""
    rows = events.select(F.col("user_id").alias("doc_id"), "event_id", "ts", event_status().alias("status"))
    return rows.groupBy("doc_id").applyInPandasWithState(
        _transition, "doc_id long, job_id long, requested string, before string, code string", "status string, seen long", "append", "NoTimeout"
    )
