"""Reading and appending the two tables as Parquet."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schedlake.schemas import DEFINITION_SCHEMA, EXECUTION_COLUMNS, EXECUTION_SCHEMA, INCOMPLETE, TERMINAL, ntz


def typed_definitions(df: DataFrame) -> DataFrame:
    """Definitions with the column types of the schema; flags stored as 0/1 become booleans."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DEFINITION_SCHEMA.fields])


def read_definitions(spark: SparkSession, src: str, fmt: str = "parquet") -> DataFrame:
    """The definition table ordered by id."""
    return typed_definitions(spark.read.format(fmt).load(src)).orderBy("id")


def read_stored(spark: SparkSession, src: str) -> DataFrame:
    """The stored history with its partition column."""
    stored = T.StructType([*EXECUTION_SCHEMA.fields, T.StructField("created_date", T.DateType())])
    return spark.read.schema(stored).parquet(src)


def read_executions(spark: SparkSession, src: str, from_date=None, to_date=None) -> DataFrame:
    """History created in ``[from_date, to_date)``; whole days outside are pruned as partitions."""
    rows = read_stored(spark, src)
    if from_date is not None:
        rows = rows.filter((F.col("created_date") >= ntz(from_date).cast("date"))
                           & (F.col("created_at") >= ntz(from_date)))
    if to_date is not None:
        rows = rows.filter((F.col("created_date") <= ntz(to_date).cast("date"))
                           & (F.col("created_at") < ntz(to_date)))
    return rows.select(*EXECUTION_COLUMNS)


def day_of() -> Column:
    """The day folder of an execution."""
    return F.to_date("created_at")


def _laid_out(df: DataFrame) -> DataFrame:
    """Rows by day in files of even size (adaptive rebalancing splits a busy day and joins quiet ones),
    sorted by status and job inside a file so that readers skip row groups."""
    dated = df.withColumn("created_date", day_of())
    return dated.hint("rebalance", "created_date").sortWithinPartitions("created_date", "status", "job_id")


def append_executions(df: DataFrame, dest: str) -> None:
    """Appends execution rows, one folder per day."""
    _laid_out(df).write.mode("append").partitionBy("created_date").parquet(dest)


def drop_days(spark: SparkSession, dest: str, days: list[date]) -> None:
    """Removes whole day folders of a history, and nothing else; days that are not there are passed over.

    The files' own addresses name the store they lie in; one folder a day comes to the driver.
    """
    held = read_stored(spark, dest).filter(F.col("created_date").isin(days))
    folder = F.regexp_extract("_metadata.file_path", "^(.*/created_date=[^/]+)/[^/]+$", 1)
    for row in held.select(folder.alias("folder")).distinct().collect():
        store, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", row.folder))
        store.delete_dir(path)


def _days_with(rows: DataFrame) -> list[date]:
    """Their number is bounded by the calendar."""
    return sorted(r.created_date for r in rows.select("created_date").distinct().collect())


def rewrite_days(spark: SparkSession, dest: str, days: list[date], change: Callable[[DataFrame], DataFrame]) -> None:
    """Applies a change to the rows of some days. Each day is replaced when the job commits; days that the change
    leaves empty are dropped then. Files of other days are not touched."""
    if not days:
        return
    part = read_stored(spark, dest).filter(F.col("created_date").isin(days)).select(*EXECUTION_COLUMNS)
    kept = change(part)
    left = _days_with(kept.select(day_of().alias("created_date")))
    if left:
        _laid_out(kept).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "created_date").parquet(dest)
    drop_days(spark, dest, [d for d in days if d not in left])


def change_days(spark: SparkSession, dest: str, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
    """Applies a change (claim, outcomes, retry, reset, delete) by rewriting only the days that hold the given
    ids; the rest of the history is not read beyond its id column."""
    stored = read_stored(spark, dest)
    hit = stored.select("id", "created_date").join(ids.select("id"), "id", "left_semi")
    rewrite_days(spark, dest, _days_with(hit), change)


def retain_days(spark: SparkSession, dest: str, before) -> None:
    """Drops the terminal rows created before an instant. Days that hold nothing else are dropped without being read;
    only days with waiting or running rows, and the day of the instant, are rewritten."""
    old = read_stored(spark, dest).filter(F.col("created_date") <= ntz(before).cast("date"))
    days = _days_with(old)
    mixed = set(_days_with(old.filter(
        F.col("status").isin(*INCOMPLETE) | (F.col("created_date") == ntz(before).cast("date")))))
    drop_days(spark, dest, [d for d in days if d not in mixed])
    gone = (F.col("created_at") < ntz(before)) & F.col("status").isin(*TERMINAL)
    rewrite_days(spark, dest, sorted(mixed), lambda part: part.filter(~gone))
