"""Trigger messages to PENDING executions, for batches and for each micro-batch of a stream."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlake.functions.params import EMPTY_MAP, as_map, encode_params, merge_params, parse_trigger, unwrap
from schedlake.operators.dispatch import resolve_handler
from schedlake.operators.joins import spread_join
from schedlake.schemas import DEFAULT_TOPIC, EXECUTION_SCHEMA, PENDING

MESSAGE_KEY = ["msg_topic", "msg_partition", "msg_offset"]
#: Ids of event executions: above all numbered ones, then 8 bits for the topic, 14 for the partition, 40 for the offset.
EVENT_IDS, TOPIC_SHIFT, PARTITION_SHIFT = 1 << 62, 54, 40


def event_id(topics: list[str]) -> Column:
    """The id of a message's execution: the same however often the message is read.

    ``topics`` gives each topic its number and may only be added to; at most 256. A message of another topic, or one
    whose partition or offset does not fit, is an error.
    """
    if not 0 < len(topics) <= 256:
        raise ValueError("between 1 and 256 topics")
    slot = F.array_position(F.array(*[F.lit(t) for t in topics]), F.col("msg_topic")) - 1
    fits = (slot >= 0) & (F.col("msg_partition") < 1 << (TOPIC_SHIFT - PARTITION_SHIFT)) & (
        F.col("msg_offset") < 1 << PARTITION_SHIFT)
    number = F.shiftleft(slot.cast("long"), TOPIC_SHIFT) + F.shiftleft(
        F.col("msg_partition").cast("long"), PARTITION_SHIFT) + F.col("msg_offset")
    return F.when(fits, F.lit(EVENT_IDS) + number).otherwise(
        F.raise_error(F.concat(F.lit("no event id for a message of "), F.col("msg_topic"))).cast("bigint"))


class Ingest(NamedTuple):
    """Execution rows with their message key, and quarantined messages with a reason."""

    created: DataFrame
    quarantined: DataFrame


def enrich_triggers(triggers: DataFrame, defs: DataFrame, merge_when_job_id_given: bool = False) -> DataFrame:
    """Triggers with handler, job, merged ``params`` and ``reason`` (NULL where the message can run).

    Both joins leave the choice of strategy to Spark: definitions are broadcast only below its size
    threshold, and a handler that most messages name is split by adaptive execution.
    """
    parsed = resolve_handler(parse_trigger(triggers), defs, MESSAGE_KEY)
    given = defs.select(F.col("id").alias("_given"), F.col("handler_params").alias("_given_params"))
    joined = spread_join(parsed, given, "job_id", "_given", "left", MESSAGE_KEY)
    base_text = "coalesce(base_params, _given_params)" if merge_when_job_id_given else "base_params"
    joined = joined.withColumn("_base_text", F.expr(unwrap(base_text)))
    joined = joined.withColumn("_base", F.expr(f"coalesce({as_map('_base_text')}, {EMPTY_MAP})"))
    joined = joined.withColumn("_params", F.expr(merge_params("_base", "event_params")))
    reason = F.coalesce(F.col("reason"), F.when(
        F.col("job_id").isNotNull() & F.col("_given").isNull(), "unknown_job_id"))
    return joined.select(
        *triggers.columns, "handler_name", F.coalesce("job_id", "resolved_id").alias("job_id"),
        F.expr(encode_params("_params")).alias("params"), F.col("_params").alias("params_map"),
        reason.alias("reason"))


def event_rows(enriched: DataFrame, topics: list[str]) -> Ingest:
    """Splits enriched triggers into rows to append and messages to quarantine."""
    good = enriched.filter("reason IS NULL").select(
        event_id(topics).alias("id"), "job_id", "handler_name", F.col("ts").alias("scheduled_time"),
        F.lit(PENDING).alias("status"), "params", F.lit("event").alias("param_source"),
        F.lit(None).cast("timestamp_ntz").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        F.lit(0).alias("retry_count"), F.lit(None).cast("string").alias("error_message"),
        F.lit(None).cast("string").alias("result"), F.col("ts").alias("created_at"), *MESSAGE_KEY)
    bad = enriched.filter("reason IS NOT NULL").select(*MESSAGE_KEY, "ts", "value", "reason")
    return Ingest(good.select(*EXECUTION_SCHEMA.fieldNames(), *MESSAGE_KEY), bad)


def ingest(triggers: DataFrame, defs: DataFrame, merge_when_job_id_given: bool = False,
           topics: list[str] | None = None) -> Ingest:
    return event_rows(enrich_triggers(triggers, defs, merge_when_job_id_given), topics or [DEFAULT_TOPIC])
