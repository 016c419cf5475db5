"""Streams: landed retention events folded into state, followers with a cursor, intake of documents.

Streams read files and end when they have read what is there; running them again
goes on where they ended, from the checkpoint in the folder the caller names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators.retention import retention_state

SCHEMA = "event_sequence bigint, artifact_id bigint, event_type string, reference_id string, ts timestamp"


def landed(spark: SparkSession, folder: str, schema: str = SCHEMA, lateness: str = "1 day") -> DataFrame:
    """A stream of landed events, each sequence number once within the lateness."""
    events = spark.readStream.schema(schema).parquet(folder)
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_sequence"])


def append_log(events: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to the log table, once each, and stop when nothing new is there."""
    return events.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def state_of(spark: SparkSession, log: str) -> DataFrame:
    """The state after all events of the log; an event that landed twice counts once."""
    return retention_state(spark.read.schema(SCHEMA).parquet(log).dropDuplicates(["event_sequence"]))


def follow(spark: SparkSession, log: str, cursor: int) -> DataFrame:
    """Events of the log above the cursor, in order."""
    return spark.read.schema(SCHEMA).parquet(log).where(F.col("event_sequence") > cursor).orderBy("event_sequence")


def windowed(events: DataFrame, width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Events per window and type, final once the watermark has passed."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("since"), "event_type", "n")


def intake(spark: SparkSession, folder: str, target: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Append new documents with their text's hash; files that came before are not read again."""
    docs = spark.readStream.schema(schema).parquet(folder).withColumn("sha256", F.sha2("text", 256))
    return docs.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
