"""Filters, lookups, definition joins, paging and top-n over definitions and executions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schedlake.operators.joins import spread_join
from schedlake.schemas import (
    DEFAULT_MAX_RETRY, DEFAULT_PAGE_SIZE, DEFAULT_TIMEOUT_SECONDS, INCOMPLETE, MAX_PAGE_SIZE, PENDING, RETRYABLE,
    TERMINAL, ntz)

# Column sets of the three history views.
RUN_COLUMNS = ["id", "job_id", "status", "started_at", "finished_at", "retry_count", "error_message", "result",
               "created_at"]
LISTING_COLUMNS = ["id", "job_id", "cron_name", "handler_name", "scheduled_time", "status", "started_at",
                   "finished_at", "retry_count", "error_message", "result", "created_at"]
DETAIL_COLUMNS = ["id", "job_id", "handler_name", "scheduled_time", "status", "params", "param_source", "started_at",
                  "finished_at", "retry_count", "error_message", "result", "created_at", "max_retry",
                  "timeout_seconds"]


# Filters

def enabled(defs: DataFrame) -> DataFrame:
    return defs.filter("is_enabled").orderBy("id")


def defs_by_enabled(defs: DataFrame, flag: bool) -> DataFrame:
    return defs.filter(F.col("is_enabled") == flag).orderBy(F.desc("id"))


def filter_executions(execs: DataFrame, job_id: int | None = None, status: str | None = None,
                      from_date=None, to_date=None) -> DataFrame:
    """Optional predicates; ``created_at`` is half-open and also prunes a date-partitioned table."""
    out = execs
    if job_id:
        out = out.filter(F.col("job_id") == job_id)
    if status:
        out = out.filter(F.col("status") == status)
    if from_date is not None:
        out = out.filter(F.col("created_at") >= ntz(from_date))
        if "created_date" in execs.columns:
            out = out.filter(F.col("created_date") >= ntz(from_date).cast("date"))
    if to_date is not None:
        out = out.filter(F.col("created_at") < ntz(to_date))
        if "created_date" in execs.columns:
            out = out.filter(F.col("created_date") <= ntz(to_date).cast("date"))
    return out


def pending(execs: DataFrame) -> DataFrame:
    return execs.filter(F.col("status") == PENDING)


def incomplete(execs: DataFrame) -> DataFrame:
    return execs.filter(F.col("status").isin(*INCOMPLETE))


def terminal(execs: DataFrame) -> DataFrame:
    return execs.filter(F.col("status").isin(*TERMINAL))


def since(execs: DataFrame, ts) -> DataFrame:
    return execs.filter(F.col("created_at") >= ntz(ts))


def not_retryable_reason() -> Column:
    """Why an execution cannot be retried, NULL where it can."""
    return F.when(~F.col("status").isin(*RETRYABLE), F.concat(
        F.lit("Cannot retry job with status '"), F.col("status"),
        F.lit("'. Only FAILED or TIMEOUT jobs can be retried.")))


def retryable(execs: DataFrame) -> DataFrame:
    """All rows with ``reason``, which is NULL for those that may be retried."""
    return execs.withColumn("reason", not_retryable_reason())


# Lookups

def lookup(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys``."""
    names = [on] if isinstance(on, str) else on
    return df.join(keys.select(*names).distinct(), names, "left_semi")


# Definition joins

def with_definition(execs: DataFrame, defs: DataFrame, how: str = "left") -> DataFrame:
    """Adds ``cron_name``, ``job_name``, ``max_retry`` and ``timeout_seconds`` of the definition.

    A left join fills the defaults in; an inner join drops rows without a definition.
    """
    right = defs.select(F.col("id").alias("_def_id"), F.col("name").alias("cron_name"),
                        F.col("max_retry").alias("_retry"), F.col("timeout_seconds").alias("_timeout"))
    if how == "inner":
        joined = execs.join(right, F.col("job_id") == F.col("_def_id"), "inner")
    else:
        joined = spread_join(execs, right, "job_id", "_def_id", how, ["id"])
    return joined.select(
        *execs.columns, "cron_name",
        F.coalesce("cron_name", "handler_name").alias("job_name"),
        F.coalesce("_retry", F.lit(DEFAULT_MAX_RETRY)).alias("max_retry"),
        F.coalesce("_timeout", F.lit(DEFAULT_TIMEOUT_SECONDS)).alias("timeout_seconds"))


def history_projection(execs: DataFrame, kind: str, defs: DataFrame | None = None) -> DataFrame:
    """The ``run``, ``listing`` or ``detail`` columns; the last two need the definitions."""
    if kind == "run":
        return execs.select(*RUN_COLUMNS)
    columns = {"listing": LISTING_COLUMNS, "detail": DETAIL_COLUMNS}[kind]
    return with_definition(execs, defs).select(*columns)


# Paging and top-n; every order ends in id so that it is total

def page(df: DataFrame, order: list, page: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    if page < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page must be >= 1 and size 1..{MAX_PAGE_SIZE}")
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def list_executions(execs: DataFrame, defs: DataFrame, page_no: int = 1, size: int = DEFAULT_PAGE_SIZE,
                    **filters) -> DataFrame:
    """One page of the filtered history, newest id first. Only the page itself meets the definitions."""
    rows = page(filter_executions(execs, **filters), [F.desc("id")], page_no, size)
    return history_projection(rows, "listing", defs).orderBy(F.desc("id"))


def executions_of(execs: DataFrame, job_id: int, limit: int, offset: int = 0) -> DataFrame:
    rows = execs.filter(F.col("job_id") == job_id).select(*RUN_COLUMNS)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def latest_per_job(execs: DataFrame, n: int) -> DataFrame:
    """The n newest executions of every job. Spark trims each job before the shuffle (window group limit)."""
    w = Window.partitionBy("job_id").orderBy(F.desc("created_at"), F.desc("id"))
    rows = execs.filter("job_id IS NOT NULL").select(*RUN_COLUMNS)
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def recent(execs: DataFrame, defs: DataFrame, n: int) -> DataFrame:
    rows = with_definition(execs.select(*RUN_COLUMNS, "handler_name"), defs, "inner")
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(n).select(
        "id", "job_id", "job_name", "status", "started_at", "finished_at", "retry_count", "error_message", "result",
        "created_at")


def pending_fifo(execs: DataFrame, defs: DataFrame, n: int | None = None) -> DataFrame:
    """PENDING rows oldest first. With n, event rows count too and only the n winners meet the definitions."""
    columns = ["id", "job_id", "handler_name", "scheduled_time", "params", "param_source", "retry_count",
               "created_at", "job_name", "max_retry", "timeout_seconds"]
    waiting = pending(execs).select(*columns[:8])
    if n is None:
        return with_definition(waiting, defs, "inner").select(*columns).orderBy("created_at", "id")
    first = waiting.orderBy("created_at", "id").limit(n)
    return with_definition(first, defs).select(*columns).orderBy("created_at", "id")
