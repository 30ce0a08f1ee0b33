"""Trigger messages from Kafka or from files, and the quarantine for bad ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.schemas import TRIGGER_SCHEMA


# Bounds of a micro-batch, and with it of what a stateful task orders at once.
MAX_OFFSETS = 5_000_000
MAX_FILES = 100


def kafka_options(servers: str, topic: str, start: str = "earliest", max_offsets: int = MAX_OFFSETS,
                  group: str | None = None) -> dict[str, str]:
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start,
               "maxOffsetsPerTrigger": str(max_offsets)}
    if group is not None:
        options["kafka.group.id"] = group
    return options


def from_kafka(records: DataFrame) -> DataFrame:
    """Kafka records in the trigger schema; the message time is kept in UTC."""
    return records.select(
        F.col("topic").alias("msg_topic"), F.col("partition").alias("msg_partition"),
        F.col("offset").alias("msg_offset"), F.to_utc_timestamp(
            "timestamp", F.current_timezone()).cast("timestamp_ntz").alias("ts"),
        F.col("value").cast("string").alias("value"))


def read_triggers(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """The trigger topic as a stream (needs the Kafka connector on the class path)."""
    return from_kafka(spark.readStream.format("kafka").options(**options).load())


def read_trigger_files(spark: SparkSession, folder: str, max_files: int = MAX_FILES) -> DataFrame:
    """The same schema as a stream of Parquet files."""
    return spark.readStream.schema(TRIGGER_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(folder)


def quarantine(df: DataFrame, dest: str, mode: str = "append") -> None:
    """Keeps messages that cannot run, one folder per reason."""
    df.write.mode(mode).partitionBy("reason").parquet(dest)
