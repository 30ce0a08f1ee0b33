"""Checks on definitions, cron intervals, names and execution rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schedlake.operators.occurrences import with_fires
from schedlake.schemas import (
    CRON_LENGTH, DEFAULT_MIN_INTERVAL_SECONDS, DESCRIPTION_MAX_LENGTH, HANDLER_LENGTH, MAX_RETRY_RANGE, NAME_LENGTH,
    STATUSES, TIMEOUT_RANGE)


def _length_error(column: str, low: int, high: int) -> str:
    return f"IF(coalesce(length({column}) BETWEEN {low} AND {high}, false), NULL, '{column}')"


def _range_error(column: str, low: int, high: int) -> str:
    return f"IF({column} NOT BETWEEN {low} AND {high}, '{column}', NULL)"


def validate_definitions(defs: DataFrame) -> DataFrame:
    """Definitions with ``errors``: the names of the columns that break their limits."""
    checks = [
        _length_error("name", *NAME_LENGTH),
        f"IF(length(description) > {DESCRIPTION_MAX_LENGTH}, 'description', NULL)",
        _length_error("cron_expression", *CRON_LENGTH),
        _length_error("handler_name", *HANDLER_LENGTH),
        _range_error("max_retry", *MAX_RETRY_RANGE),
        _range_error("timeout_seconds", *TIMEOUT_RANGE),
    ]
    return defs.withColumn("errors", F.expr(f"array_compact(array({', '.join(checks)}))"))


def cron_verdict(min_interval: int) -> list[str]:
    """SQL columns ``interval_seconds`` and ``reason`` from ``cron_error`` and the next two ``fires``."""
    gap = "CASE WHEN size(fires) = 2 THEN timestampdiff(SECOND, fires[0], fires[1]) END"
    return [f"{gap} AS interval_seconds", f"""CASE WHEN cron_error IS NOT NULL THEN 'parse_error'
        WHEN size(fires) = 0 THEN 'never_fires' WHEN {gap} < {min_interval} THEN 'too_short' END AS reason"""]


def validate_cron(defs: DataFrame, as_of, min_interval: int = DEFAULT_MIN_INTERVAL_SECONDS) -> DataFrame:
    """Definitions with ``reason`` (``parse_error``, ``never_fires``, ``too_short`` or NULL) and the
    ``interval_seconds`` between the next two fires."""
    return with_fires(defs, as_of, 2).selectExpr(*defs.columns, *cron_verdict(min_interval))


def duplicate_names(defs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose name belongs to another definition (``taken``) or occurs twice (``repeated``).

    ``id`` is NULL for a new definition and set for a rename. Names are counted by partial aggregation.
    """
    owners = defs.select(F.col("name").alias("_name"), F.col("id").alias("_owner"))
    counts = incoming.groupBy(F.col("name").alias("_counted")).agg(F.count("*").alias("_n"))
    out = incoming.join(owners, F.col("name") == F.col("_name"), "left").join(
        counts, F.col("name") == F.col("_counted"), "left")
    reason = F.when(F.col("_owner").isNotNull() & ~F.col("_owner").eqNullSafe(F.col("id")), "taken").when(
        F.col("_n") > 1, "repeated")
    return out.withColumn("reason", reason).select(*incoming.columns, "reason").filter("reason IS NOT NULL")


def schema_violations(execs: DataFrame, defs: DataFrame) -> DataFrame:
    """``(id, violation)`` for every broken constraint of the execution table."""
    row_checks = F.expr(f"""array_compact(array(
        IF(status IS NULL OR NOT status IN {STATUSES}, 'status', NULL),
        IF(handler_name IS NULL, 'handler_name', NULL),
        IF(scheduled_time IS NULL, 'scheduled_time', NULL)))""")
    simple = execs.select("id", F.explode(row_checks).alias("violation"))
    keyed = execs.filter("job_id IS NOT NULL").select("id", "job_id", "scheduled_time")
    known = defs.select(F.col("id").alias("job_id"))
    orphans = keyed.join(known, "job_id", "left_anti").select("id", F.lit("orphan_job_id").alias("violation"))
    repeated = keyed.groupBy("job_id", "scheduled_time").agg(F.count("*").alias("n")).filter("n > 1")
    copies = keyed.join(repeated, ["job_id", "scheduled_time"], "left_semi").select(
        "id", F.lit("duplicate_key").alias("violation"))
    return simple.unionByName(orphans).unionByName(copies)
