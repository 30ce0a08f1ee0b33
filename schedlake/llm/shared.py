"""Helpers of the operators in this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from schedlake.session import run_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_BYTES = 16 << 20


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


#: Spark then drops an execution's shuffle files at its end, not when the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that Spark hands to Python at once.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes after which Spark closes such a batch; one row may be larger.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session's setting for as long as something is run."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """Drops the tables that ``written`` made inside it, once nothing reads them any more.

    ``with Scratch(spark)`` drops them at its end; what must stay is written by ``outlive``. ``recording`` only takes
    down their names, and ``drop`` comes later.
    """

    open: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    @contextmanager
    def recording(self) -> Iterator[Scratch]:
        Scratch.open.append(self)
        try:
            yield self
        finally:
            Scratch.open.remove(self)

    def __enter__(self) -> Scratch:
        Scratch.open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch.open.remove(self)
        self.drop()

    def outlive(self, df: DataFrame, name: str) -> DataFrame:
        """``written``, as if outside."""
        place = Scratch.open.index(self)
        Scratch.open.remove(self)
        try:
            return written(df, name)
        finally:
            Scratch.open.insert(place, self)

    def drop(self, spark: SparkSession | None = None) -> None:
        """Empties the folders, through Spark as any store allows."""
        for folder in self.folders:
            (spark or self.spark).range(0).write.mode("overwrite").parquet(folder)
        self.folders = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and still there when executors are lost."""
    spark = df.sparkSession
    folder = run_folder(spark, name)
    if Scratch.open:
        Scratch.open[-1].folders.append(folder)
    with setting(spark, DROP_SHUFFLES, "true"):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def small_batches(batches: Iterable[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices that hold about ``most`` bytes of a column; a longer text stands alone."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if texts.nbytes <= most:
            yield batch
            continue
        begin, held = 0, 0
        for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
            if held + n > most and i > begin:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)
