"""What the days of a stored history hold: which ids and jobs, and how many rows in which minutes.

The index tells which days to open, for a change of some rows or of all rows of some jobs, and for a page far back. It lies
beside the history, in day folders of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlake.operators.changes import cascade_delete
from schedlake.operators.views import filter_executions
from schedlake.schemas import EXECUTION_COLUMNS, MAX_PAGE_SIZE, ntz
from schedlake.sources.tables import append_executions, day_of, read_stored, rewrite_days

#: Ids that share an entry of a day: ids are given out in order, so a day holds few such ranges.
ID_RANGE = 1024
INDEX_SCHEMA = "kind string, value bigint, created_date date"
ID, JOB = "id", "job"


def index_folder(dest: str) -> str:
    return f"{dest.rstrip('/')}_index"


def _entries(rows: DataFrame) -> DataFrame:
    """The distinct id ranges and jobs of each day; rows without a job have no entry for one."""
    entry = F.explode(F.array(F.struct(F.lit(ID).alias("kind"), F.floor(F.col("id") / ID_RANGE).alias("value")),
                              F.struct(F.lit(JOB).alias("kind"), F.col("job_id").alias("value")))).alias("e")
    return rows.select(day_of().alias("created_date"), entry).select("e.kind", "e.value", "created_date").filter(
        "value IS NOT NULL").distinct()


def append_indexed(df: DataFrame, dest: str) -> None:
    """``append_executions`` with the index kept. Entries are written first: one without its rows costs a look at a day,
    rows without an entry would be missed."""
    _entries(df).write.mode("append").partitionBy("created_date").parquet(index_folder(dest))
    append_executions(df, dest)


def rebuild_index(spark: SparkSession, dest: str) -> None:
    """Reads a whole history's ids and jobs anew, for one that was written without an index or has shrunk a lot."""
    _entries(read_stored(spark, dest)).write.mode("overwrite").partitionBy("created_date").parquet(index_folder(dest))


def _days_of(spark: SparkSession, dest: str, kind: str, values: DataFrame) -> list:
    """Days that may hold some values; their number is bounded by the calendar."""
    index = spark.read.schema(INDEX_SCHEMA).parquet(index_folder(dest)).filter(F.col("kind") == kind)
    found = index.join(values.distinct(), "value", "left_semi").select("created_date").distinct()
    return sorted(r.created_date for r in found.collect())


def change_indexed_days(spark: SparkSession, dest: str, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
    """``change_days`` that reads the ids of those days only which may hold some of the given ones.

    A change keeps ids, jobs and days as they are, or removes rows: entries stay true either way.
    """
    ranges = ids.select(F.floor(F.col("id") / ID_RANGE).alias("value"))
    days = _days_of(spark, dest, ID, ranges)
    if days:
        held = read_stored(spark, dest).filter(F.col("created_date").isin(days)).select("id", "created_date")
        hit = held.join(ids.select("id"), "id", "left_semi").select("created_date").distinct()
        rewrite_days(spark, dest, sorted(r.created_date for r in hit.collect()), change)


def cascade_days(spark: SparkSession, dest: str, deleted: DataFrame) -> None:
    """Removes the executions of deleted definitions (``id``) from a stored history: only days with runs of theirs are
    read and rewritten, days that hold nothing else go."""
    days = _days_of(spark, dest, JOB, deleted.select(F.col("id").alias("value")))
    rewrite_days(spark, dest, days, lambda part: cascade_delete(part, deleted))


def _span(counts: list[tuple], offset: int, size: int) -> tuple[list, int]:
    """Of ``(key, rows)`` in order, the keys that the rows from ``offset`` on lie in, and how many rows to skip there."""
    at, keys, skip = 0, [], 0
    for key, n in counts:
        if at < offset + size and at + n > offset:
            if not keys:
                skip = offset - at
            keys.append(key)
        at += n
    return keys, skip


def history_page(spark: SparkSession, src: str, page: int = 1, size: int = MAX_PAGE_SIZE, **filters) -> DataFrame:
    """A page of a stored history, newest first, ids break ties; ``filters`` as in ``filter_executions``.

    Counts per day locate the page's days, counts per minute in these its minutes; only rows of those are sorted, so a page
    far back costs no more than one at the front. Without filters, days are counted from file footers. A page beyond the
    end is empty.
    """
    if page < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page must be >= 1 and size 1..{MAX_PAGE_SIZE}")
    rows = filter_executions(read_stored(spark, src), **filters)
    counts = sorted(((r[0], r[1]) for r in rows.groupBy("created_date").count().collect()), reverse=True)
    days, skip = _span(counts, (page - 1) * size, size)
    rows = rows.filter(F.col("created_date").isin(days) if days else F.lit(False))
    if days:
        minute = F.date_trunc("minute", "created_at").cast("timestamp_ntz")
        counts = sorted(((r[0], r[1]) for r in rows.groupBy(minute.alias("minute")).count().collect()), reverse=True)
        minutes, skip = _span(counts, skip, size)
        first, last = min(minutes), max(minutes) + timedelta(minutes=1)
        rows = rows.filter((F.col("created_at") >= ntz(first)) & (F.col("created_at") < ntz(last)))
    return rows.select(*EXECUTION_COLUMNS).orderBy(F.desc("created_at"), F.desc("id")).offset(skip).limit(size)

