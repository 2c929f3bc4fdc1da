"""Job states: last value of a document, refused starts, the steps of a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Step and progress of a run, in order.
STEPS = [("analysis", 20), ("extraction", 60), ("translation", 80), ("validation_report", 90), ("done", 100)]


def event_status(event_type: str = "event_type") -> Column:
    """Status that an event of the driver's stream stands for."""
    kinds = F.col(event_type)
    return F.when(kinds == "signup", "uploaded").when(kinds == "view", "queued").when(kinds == "click", "processing").when(kinds == "purchase", "completed").otherwise("failed")


def log(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("job_id"), event_status().alias("status"), F.col("ts").alias("updated_at"))


def latest(rows: DataFrame) -> DataFrame:
    """Last state of each document by time, then job; one partial maximum, no window."""
    last = F.max_by(F.struct("status", "job_id"), F.struct("updated_at", "job_id"))
    return rows.groupBy("doc_id").agg(last.alias("s"), F.count("*").alias("n_events")).select("doc_id", F.col("s.status").alias("status"), F.col("s.job_id").alias("job_id"), "n_events")


def conflicts(rows: DataFrame) -> DataFrame:
    """Queue requests that come while the document's last state is queued or processing."""
    before = F.lag("status").over(Window.partitionBy("doc_id").orderBy("updated_at", "job_id"))
    return rows.withColumn("before", before).where((F.col("status") == "queued") & F.col("before").isin("queued", "processing")).select("doc_id", "job_id", "before", F.lit("PROCESS_ALREADY_RUNNING").alias("code"))


def healed(documents: DataFrame, states: DataFrame) -> DataFrame:
    """Every document with its state; ``uploaded`` where none was written."""
    return documents.select("doc_id").join(states, "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("uploaded")))


def run(document_id: str, stages: dict[str, Callable[[], object]], tell: Callable[[dict], None]) -> bool:
    """Runs the stages in the order of ``STEPS``, telling each state; an error ends the run with progress 0."""
    said = lambda status, step, progress, error=None: tell({"document_id": document_id, "status": status, "current_step": step, "progress": progress, "error": error})
    for step, points in STEPS[:-1]:
        said("processing", step, points)
        try:
            if step in stages:
                stages[step]()
        except Exception as e:  # the state keeps the error; a report's failure does not end a run
            if step != "validation_report":
                said("failed", "done", 0, {"code": type(e).__name__, "message": str(e)[:500]})
                return False
    said("completed", "done", 100)
    return True
