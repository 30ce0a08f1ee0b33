"""Both tables in PostgreSQL or MySQL through Spark's JDBC source; the driver must be on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000


def read_jdbc(spark: SparkSession, url: str, table: str, low: int, high: int, partitions: int,
              properties: dict | None = None) -> DataFrame:
    """A table by ranges of its id, one per task."""
    return spark.read.jdbc(url, table, column="id", lowerBound=low, upperBound=high, numPartitions=partitions,
                           properties=properties or {})


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None) -> None:
    df.write.option("batchsize", BATCH_ROWS).jdbc(url, table, mode="append", properties=properties or {})
