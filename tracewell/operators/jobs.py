"""Jobs as folds over their events: states, cancellation between documents, ordered replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "partial", "failed", "cancelled")
#: The state an event puts a job in; other events leave it.
STATES = {"ingest_submitted": "submitted", "ingest_queued": "queued", "ingest_started": "running", "cancellation_requested": "cancellation_requested", "ingest_completed": "completed", "ingest_partial": "partial", "ingest_failed": "failed", "ingest_cancelled": "cancelled"}


def _state(event: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])[event]


def states(events: DataFrame) -> DataFrame:
    """job_id, owner_id, state, documents, cancel_refused, last_sequence from events (job_id, owner_id, sequence, event).

    The first terminal event ends a job; what comes later changes nothing, and a
    cancellation asked for then is counted as refused.
    """
    rows = events.withColumn("s_", _state(F.col("event")))
    end = F.min(F.when(F.col("s_").isin(*TERMINAL), F.col("sequence"))).over(Window.partitionBy("job_id"))
    rows = rows.withColumn("end_", end).withColumn("live_", F.col("end_").isNull() | (F.col("sequence") <= F.col("end_")))
    return rows.groupBy("job_id").agg(
        F.min_by("owner_id", "sequence").alias("owner_id"), F.max_by("s_", F.when(F.col("live_") & F.col("s_").isNotNull(), F.col("sequence"))).alias("state"),
        F.count_if((F.col("event") == "document_ingested") & F.col("live_")).alias("documents"), F.count_if((F.col("event") == "cancellation_requested") & ~F.col("live_")).alias("cancel_refused"), F.max("sequence").alias("last_sequence"),
    )


def cancelled_documents(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Documents of jobs (job_id, ord, started) with ``runs``: those that start after their job's first cancellation do not."""
    asked = events.where("event = 'cancellation_requested'").groupBy(F.col("job_id").alias("j_")).agg(F.min("sequence").alias("asked_"))
    rows = documents.join(asked, F.col("job_id") == F.col("j_"), "left")
    return rows.withColumn("runs", F.col("asked_").isNull() | (F.col("started") < F.col("asked_"))).drop("j_", "asked_")


def replay(events: DataFrame, owner: str, after: int = 0) -> DataFrame:
    """The events of one owner's jobs after a sequence number, with their place in their job."""
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("sequence"))
    return events.withColumn("place", place).where((F.col("owner_id") == owner) & (F.col("sequence") > after))
