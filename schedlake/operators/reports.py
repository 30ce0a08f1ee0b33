"""Counts, statistics, concurrency and latency over executions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schedlake.functions.clock import elapsed_micros, truncate
from schedlake.operators.views import filter_executions, since as created_since

STATUS_COUNTS = {"success_count": "SUCCESS", "failed_count": "FAILED", "running_count": "RUNNING",
                 "pending_count": "PENDING", "timeout_count": "TIMEOUT"}


def _stats() -> list[Column]:
    return [F.count("*").alias("total")] + [
        F.count_if(F.col("status") == status).alias(name) for name, status in STATUS_COUNTS.items()]


def execution_stats(execs: DataFrame, since) -> DataFrame:
    """One row: total and count per status since an instant; zeros over no rows."""
    return created_since(execs, since).agg(*_stats())


def execution_stats_by(execs: DataFrame, keys: list[str], since=None, sets: str = "group") -> DataFrame:
    """Statistics per key combination; ``sets`` is ``group``, ``rollup`` or ``cube``.

    The key ``hour`` stands for the hour of ``created_at``. With grouping sets, ``level`` tells which
    keys a row sums over, so that a NULL job and a total stay apart.
    """
    rows = created_since(execs, since) if since is not None else execs
    if "hour" in keys:
        rows = rows.withColumn("hour", truncate("hour", "created_at"))
    if sets == "group":
        return rows.groupBy(*keys).agg(*_stats())
    grouped = rows.rollup(*keys) if sets == "rollup" else rows.cube(*keys)
    return grouped.agg(*_stats(), F.grouping_id().alias("level"))


def count_definitions(defs: DataFrame, enabled: bool | None = None) -> DataFrame:
    rows = defs if enabled is None else defs.filter(F.col("is_enabled") == enabled)
    return rows.agg(F.count("*").alias("cnt"))


def count_executions(execs: DataFrame, job_id: int | None = None, status: str | None = None) -> DataFrame:
    return filter_executions(execs, job_id, status).agg(F.count("*").alias("cnt"))


def execution_counts(execs: DataFrame) -> DataFrame:
    """All four counts (overall, per job, per status, per both) in one pass."""
    return execs.cube("job_id", "status").agg(F.count("*").alias("cnt"), F.grouping_id().alias("level"))


def page_summary(rows: DataFrame, size: int) -> DataFrame:
    """Total rows and number of pages."""
    pages = F.ceil(F.col("total") / F.lit(size)) if size > 0 else F.lit(0)
    return rows.agg(F.count("*").alias("total")).select("total", pages.cast("bigint").alias("pages"))


#: Width of the slices in which durations are counted.
SLICE_MICROS = 60_000_000


def concurrency(execs: DataFrame, slice_unit: str = "hour") -> DataFrame:
    """Runs in progress after each start or finish, as ``(ts, running, next_ts)``.

    Starts and finishes at the same instant are netted before any shuffle. Running sums are taken per
    hour (``slice_unit``) and shifted by the total of the hours before, so no task sees the whole history;
    the table of hours is bounded by the calendar.
    """
    marks = execs.filter("started_at IS NOT NULL").select(F.explode(F.array(
        F.struct(F.col("started_at").alias("ts"), F.lit(1).alias("delta")),
        F.struct(F.col("finished_at").alias("ts"), F.lit(-1).alias("delta")))).alias("mark")).select("mark.*")
    net = marks.filter("ts IS NOT NULL").groupBy("ts").agg(F.sum("delta").alias("delta"))
    net = net.withColumn("_hour", truncate(slice_unit, "ts"))
    by_hour = Window.partitionBy("_hour").orderBy("ts")
    local = net.select("_hour", "ts", F.sum("delta").over(by_hour).alias("_running"),
                       F.lead("ts").over(by_hour).alias("_next"))
    hours = net.groupBy("_hour").agg(F.sum("delta").alias("_total"), F.min("ts").alias("_first"))
    over_hours = Window.orderBy("_hour")
    carry = hours.select(
        F.col("_hour"),
        F.coalesce(F.sum("_total").over(over_hours.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(
            "_before"),
        F.lead("_first").over(over_hours).alias("_next_first"))
    return local.join(carry, "_hour").select(
        "ts", (F.col("_running") + F.col("_before")).alias("running"),
        F.coalesce("_next", "_next_first").alias("next_ts"))


def pool_load(execs: DataFrame, pool_size: int, slice_unit: str = "hour") -> DataFrame:
    """Peak concurrency and seconds spent above a pool size."""
    over = F.when(F.col("running") > pool_size, elapsed_micros("ts", "next_ts"))
    return concurrency(execs, slice_unit).agg(
        F.max("running").alias("peak"),
        (F.coalesce(F.sum(over), F.lit(0)) / F.lit(1_000_000.0)).alias("seconds_above"),
        F.count_if(F.col("running") > pool_size).alias("marks_above"))


def latency_summary(execs: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """Wait (created to started) and run (started to finished) times per handler.

    Percentiles are exact: rows first collapse to a histogram of distinct times per handler, whose running counts are
    taken per minute of duration and shifted by the minutes before, so that a handler with many runs is not one task.
    """
    shares = shares or {"p50_seconds": 0.5, "p95_seconds": 0.95}
    timed = execs.select("handler_name", F.explode(F.array(
        F.struct(F.lit("wait").alias("metric"), elapsed_micros("created_at", "started_at").alias("micros")),
        F.struct(F.lit("run").alias("metric"), elapsed_micros("started_at", "finished_at").alias("micros")),
    )).alias("m")).select("handler_name", "m.*").filter("micros IS NOT NULL")
    histogram = timed.groupBy("handler_name", "metric", "micros").agg(F.count("*").alias("n"))
    histogram = histogram.withColumn("_slice", F.expr(f"micros div {SLICE_MICROS}"))
    keys = ["handler_name", "metric"]
    slices = histogram.groupBy(*keys, "_slice").agg(F.sum("n").alias("_held"))
    w = Window.partitionBy(*keys)
    slices = slices.select(*keys, "_slice", F.sum("_held").over(w).alias("total"), F.coalesce(F.sum("_held").over(
        w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("n").over(Window.partitionBy(*keys, "_slice").orderBy("micros"))
    ranked = histogram.withColumn("_inside", inside).join(slices, [*keys, "_slice"]).withColumn(
        "upto", F.col("_inside") + F.col("_before"))
    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("runs"),
        F.round(F.sum(F.col("micros") * F.col("n")) / F.sum("n") / F.lit(1e6), 6).alias("avg_seconds"),
        (F.max("micros") / F.lit(1e6)).alias("max_seconds"),
        *[(F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * F.lit(p)), F.col("micros"))) / F.lit(1e6)).alias(name)
          for name, p in shares.items()])


def error_classes(execs: DataFrame) -> DataFrame:
    """Failures per error class, taken from the prefix of the message."""
    prefix = F.regexp_extract(
        "error_message",
        r"^(Handler not found|Invalid params|Connection pool exhausted|Database error|Execution timed out)", 1)
    return execs.filter("error_message IS NOT NULL").groupBy(
        F.when(prefix == "", "other").otherwise(prefix).alias("error_class")).agg(F.count("*").alias("failures"))
