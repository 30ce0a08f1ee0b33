"""Versioned snapshots: where the result of a bulk change lands."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer has published a version in the meantime."""


def _latest(spark: SparkSession, dest: str) -> tuple[int, str | None]:
    try:
        pointers = spark.read.schema("version string, n long").parquet(f"{dest}/pointers")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None
    n, version = pointers.agg(F.max("n"), F.max_by("version", "n")).first()
    return (0, None) if n is None else (n, version)


def publish_snapshot(df: DataFrame, dest: str, based_on: str | None = None) -> str:
    """Writes the table as a new version, then points readers at it.

    Readers of the old version are not disturbed, so the new one may be computed from it. A failed write
    leaves no pointer. ``based_on`` is the version that the table was computed from: if another one is
    current, or two writers reach for the same number, it is a :class:`Conflict` and nothing changes for readers.
    """
    spark = df.sparkSession
    n, current = _latest(spark, dest)
    if based_on is not None and based_on != current:
        raise Conflict(f"{dest}: {based_on} is not the current version")
    version = uuid.uuid4().hex
    df.write.mode("errorifexists").parquet(f"{dest}/versions/{version}")
    pointer = spark.createDataFrame([(version,)], "version string").coalesce(1)
    try:
        pointer.write.mode("errorifexists").parquet(f"{dest}/pointers/n={n + 1}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise Conflict(f"{dest}: number {n + 1} is taken") from error
    return version


def current_version(spark: SparkSession, dest: str) -> str:
    version = _latest(spark, dest)[1]
    if version is None:
        raise ValueError(f"nothing is published at {dest}")
    return version


def read_snapshot(spark: SparkSession, dest: str) -> DataFrame:
    return spark.read.parquet(f"{dest}/versions/{current_version(spark, dest)}")
