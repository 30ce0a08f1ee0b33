"""Cron dispatch: which definitions get a PENDING execution at an instant."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schedlake.operators.dispatch import insert_if_absent, overlap_guard
from schedlake.operators.occurrences import due_of, with_fires
from schedlake.operators.validate import cron_verdict
from schedlake.operators.views import incomplete
from schedlake.schemas import (
    DEFAULT_MIN_INTERVAL_SECONDS, DEFAULT_POLL_INTERVAL_SECONDS, PENDING, execution_defaults, ntz)


class Dispatch(NamedTuple):
    """New PENDING rows (without ids) and the definitions whose cron expression was rejected."""

    created: DataFrame
    rejected: DataFrame


def pending_rows(due_defs: DataFrame, as_of) -> DataFrame:
    """Execution rows for due definitions; parameters are copied as they are."""
    rows = due_defs.select(
        F.lit(None).cast("bigint").alias("id"), F.col("id").alias("job_id"), "handler_name", "scheduled_time",
        F.lit(PENDING).alias("status"), F.col("handler_params").alias("params"), F.lit("cron").alias("param_source"))
    return execution_defaults(rows, as_of)


def dispatch(defs: DataFrame, execs: DataFrame, as_of, poll_interval: int = DEFAULT_POLL_INTERVAL_SECONDS,
             min_interval: int = DEFAULT_MIN_INTERVAL_SECONDS, catch_up: bool = False) -> Dispatch:
    """Enabled and valid definitions that are due, may run and have no execution for the tick yet.

    The due set is small next to the history, so it leads: the history is read for the incomplete jobs
    (job and status columns) and for the ticks of the poll window (a pushed-down time range) only.
    """
    now = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    active = defs.filter("is_enabled")
    # The check and the due ticks come from one search per distinct expression.
    searched = with_fires(active, as_of, 2, window_seconds=poll_interval)
    checked = searched.selectExpr("*", *cron_verdict(min_interval))
    ready = due_of(checked.filter("reason IS NULL"), defs.columns, catch_up)
    runnable = overlap_guard(ready, incomplete(execs))
    window = execs.filter((F.col("scheduled_time") >= ntz(now - timedelta(seconds=poll_interval)))
                          & (F.col("scheduled_time") < ntz(now)))
    created = insert_if_absent(pending_rows(runnable, as_of), window, order=["handler_name"])
    rejected = checked.filter("reason IS NOT NULL").select(
        "id", "name", "cron_expression", "reason", "interval_seconds")
    return Dispatch(created, rejected)
