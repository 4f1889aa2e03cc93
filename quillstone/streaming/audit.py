"""An optional stream over appended audit lines; the batch operators do not need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def denied_counts(events: DataFrame, ts: str = "ts", status: str = "status", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """window, n_denied, n_events per window of event time; works on a stream (late events within the watermark) and on a table."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width)).agg(F.count_if(F.col(status) == "DENIED").alias("n_denied"), F.count("*").alias("n_events")).select(F.col("window.start").alias("window_start"), "n_denied", "n_events")


def audit_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Audit lines of a folder as a stream with an event time."""
    schema = "timestamp_utc string, request_id string, user_id_demo string, action string, status string"
    return spark.readStream.schema(schema).json(folder).withColumn("ts", F.to_timestamp("timestamp_utc"))


#: A line of the audit log.
LINE = "timestamp_utc string, request_id string, user_id_demo string, user_role array<string>, action string, query string, retrieval_method string, retrieved_document_ids array<string>, retrieved_chunk_ids array<string>, citation_ids array<string>, n_candidates_rejected_by_rbac int, status string, extra map<string,string>"


def once(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    """A stream of events with an event time `ts`, each request_id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """A micro-batch in the folder of its own number: a replayed batch replaces itself and adds nothing."""
    rows.drop("ts").write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch_id}")


def append_stream(events: DataFrame, path: str, checkpoint: str, late: str = "30 minutes"):
    """A started query that appends audit events to the log; its checkpoint numbers the batches."""
    writer = once(events, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(lambda rows, n: write_batch(rows, n, path)).trigger(availableNow=True).start()
