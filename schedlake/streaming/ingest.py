"""Trigger streams: exactly-once ingest, quarantine, enrichment, deduplication."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from schedlake.plans.event_dispatch import MESSAGE_KEY, enrich_triggers, event_rows
from schedlake.schemas import DEFAULT_TOPIC
from schedlake.sources.tables import append_executions
from schedlake.sources.triggers import quarantine


def enrich_trigger_stream(stream: DataFrame, defs: DataFrame, **options) -> DataFrame:
    """Stream-static join: the definitions are read anew for every micro-batch."""
    return enrich_triggers(stream, defs, **options)


def batch_folder(dest: str, run: str, batch_id: int) -> str:
    return f"{dest}/run={run}/batch={batch_id}"


def not_yet_stored(batch: DataFrame, dest: str) -> DataFrame:
    """Rows of a batch whose id the history does not hold.

    Only the day folders of the batch are listed and read, and of these only the id column.
    """
    days = [str(r[0]) for r in batch.select(F.to_date("created_at")).distinct().collect()]
    if not days:
        return batch
    try:
        stored = batch.sparkSession.read.schema("id long").parquet(f"{dest}/created_date={{{','.join(days)}}}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return batch
    return batch.join(stored, "id", "left_anti")


def exactly_once_append(batch: DataFrame, dest: str) -> None:
    """Appends a micro-batch to the history once however often it is replayed, from whichever checkpoint.

    A message has the same id whenever it is read, so a replay adds only what an earlier attempt did not store. One
    query at a time may append the messages of a topic.
    """
    append_executions(not_yet_stored(batch, dest), dest)


def trigger_ingest(stream: DataFrame, defs: DataFrame, dest: str, bad: str, checkpoint: str,
                   available_now: bool = True, topics: list[str] | None = None, **options) -> StreamingQuery:
    """Parses, enriches and appends triggers to the history ``dest``; bad messages go to the quarantine with a reason.

    The checkpoint commits offsets only after both sinks are written, and both sinks are idempotent, so every message
    lands exactly once. The quarantine has a folder per batch of a run, which is named after its checkpoint.
    """
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def land(batch: DataFrame, batch_id: int) -> None:
        # Two sinks read one batch: keep the parsed rows instead of parsing twice.
        enriched = enrich_triggers(batch, defs, **options).drop("params_map").persist()
        try:
            parts = event_rows(enriched, topics or [DEFAULT_TOPIC])
            exactly_once_append(parts.created, dest)
            quarantine(parts.quarantined, batch_folder(bad, run, batch_id), mode="overwrite")
        finally:
            enriched.unpersist()

    writer = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_ingested(spark: SparkSession, dest: str, schema: T.StructType) -> DataFrame:
    """Everything ingested so far, with the message keys."""
    return spark.read.schema(schema).parquet(dest)


def read_quarantined(spark: SparkSession, bad: str) -> DataFrame:
    return spark.read.parquet(bad).select(*MESSAGE_KEY, "ts", "value", "reason")


def dedupe_triggers(stream: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """One message per key within the watermark delay; state older than that is dropped."""
    timed = stream.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(keys).drop("event_time")
