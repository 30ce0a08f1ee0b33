"""Missed deadlines by a join of two streams, with the limits that definitions set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schedlake.schemas import DEFAULT_TIMEOUT_SECONDS, TIMEOUT_MESSAGE, TIMEOUT_RANGE


def deadlines_by_definition(started: DataFrame, ended: DataFrame, defs: DataFrame, delay: str = "10 minutes",
                            longest: int = TIMEOUT_RANGE[1]) -> DataFrame:
    """TIMEOUT transitions for runs that have no end within the timeout of their definition, in event time.

    ``started`` is a stream of ``id, job_id, started_at``, ``ended`` one of ``id, finished_at``; ``defs`` is a table, read
    anew for each micro-batch. A run without a definition, or one without a limit, has the default. Spark keeps runs and
    ends as join state until the watermark, the smaller of both streams' largest times less ``delay``, is ``longest``
    seconds past them: then a run that no end was joined to is given out. No limit counts for more than ``longest``. Rows behind the
    watermark are dropped. An end counts for every run of its id that it lies in time for, so a run that is started again
    has a deadline of its own; ends at the start itself count, those after the deadline do not.
    """
    limits = defs.select(F.col("id").alias("_job"), "timeout_seconds")
    runs = started.filter("started_at IS NOT NULL").withColumn("event_time", F.col("started_at").cast("timestamp")).withWatermark("event_time", delay)
    runs = runs.join(limits, F.col("job_id") == F.col("_job"), "left").select(
        F.col("id").alias("execution_id"), "event_time",
        F.timestamp_add("SECOND", F.least(F.coalesce("timeout_seconds", F.lit(DEFAULT_TIMEOUT_SECONDS)), F.lit(longest)),
                        F.col("event_time")).alias("deadline"))
    ends = ended.filter("finished_at IS NOT NULL").select(
        F.col("id").alias("_ended"), F.col("finished_at").cast("timestamp").alias("_end")).withWatermark("_end", delay)
    in_time = ((F.col("execution_id") == F.col("_ended")) & (F.col("_end") >= F.col("event_time")) & (F.col("_end") <= F.col("deadline"))
               & (F.col("_end") <= F.col("event_time") + F.expr(f"INTERVAL {longest} SECONDS")))
    missed = runs.join(ends, in_time, "left_outer").filter("_ended IS NULL")
    return missed.select(
        "execution_id", F.col("event_time").cast("timestamp_ntz").alias("started_at"), F.col("deadline").cast("timestamp_ntz").alias("deadline"),
        F.lit("timeout").alias("kind"), F.lit(TIMEOUT_MESSAGE).alias("error_message"))
