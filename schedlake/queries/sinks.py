"""Sinks and connectors: written to the shared folder and read back."""

from pyspark.sql import functions as F

from schedlake import fixtures as fx
from schedlake.fixtures import with_ctes
from schedlake.operators.changes import delete_executions, retry, toggle_definitions
from schedlake.plans.event_dispatch import ingest
from schedlake.queries.payloads import BAD_SQL
from schedlake.queries.registry import query
from schedlake.session import run_folder
from schedlake.sources.day_index import append_indexed, cascade_days, change_indexed_days, history_page
from schedlake.sources.snapshots import publish_snapshot, read_snapshot
from schedlake.sources.tables import append_executions, change_days, read_definitions, read_executions, retain_days
from schedlake.sources.triggers import quarantine

HIT = "status = 'TIMEOUT' AND day(created_at) < 8"


@query(with_ctes("executions", """SELECT * FROM executions WHERE created_at >= TIMESTAMP '2024-01-10 06:00:00'
    AND created_at < TIMESTAMP '2024-01-20 00:00:00'"""))
def appended_executions(spark, sf):
    folder = run_folder(spark, "executions")
    execs = fx.executions(spark, sf)
    append_executions(execs.filter("param_source = 'cron'"), folder)
    append_executions(execs.filter("param_source = 'event'"), folder)
    return read_executions(spark, folder, "2024-01-10 06:00:00", "2024-01-20 00:00:00")


@query(with_ctes("executions", f"""SELECT * REPLACE (CASE WHEN {HIT} THEN 'PENDING' ELSE status END AS status,
    CASE WHEN {HIT} THEN NULL ELSE started_at END AS started_at,
    CASE WHEN {HIT} THEN NULL ELSE finished_at END AS finished_at,
    CASE WHEN {HIT} THEN NULL ELSE error_message END AS error_message,
    CASE WHEN {HIT} THEN NULL ELSE result END AS result) FROM executions"""))
def changed_days(spark, sf):
    """A retry that rewrites only the stored days it touches."""
    folder = run_folder(spark, "executions")
    append_executions(fx.executions(spark, sf), folder)
    ids = fx.executions(spark, sf).filter(HIT).select("id")
    change_days(spark, folder, ids, lambda part: retry(part, ids).table)
    return read_executions(spark, folder)


@query(with_ctes("executions", f"""SELECT * FROM executions WHERE NOT (created_at < TIMESTAMP '{fx.SINCE}'
    AND status IN ('SUCCESS', 'FAILED', 'TIMEOUT'))"""))
def retained_days(spark, sf):
    folder = run_folder(spark, "executions")
    append_executions(fx.executions(spark, sf), folder)
    retain_days(spark, folder, fx.SINCE)
    return read_executions(spark, folder)


@query(with_ctes("executions", """SELECT * FROM executions WHERE NOT (day(created_at) IN (3, 4)
    OR (day(created_at) = 9 AND status = 'FAILED'))"""))
def deleted_days(spark, sf):
    """Deletes that leave two days empty and rewrite a third."""
    folder = run_folder(spark, "executions")
    execs = fx.executions(spark, sf)
    append_executions(execs, folder)
    ids = execs.filter("day(created_at) IN (3, 4) OR (day(created_at) = 9 AND status = 'FAILED')").select("id")
    change_days(spark, folder, ids, lambda part: delete_executions(part, ids).table)
    return read_executions(spark, folder)


def _indexed(spark, sf):
    folder = run_folder(spark, "executions")
    execs = fx.executions(spark, sf)
    append_indexed(execs.filter("param_source = 'cron'"), folder)
    append_indexed(execs.filter("param_source = 'event'"), folder)
    return folder


@query(with_ctes("executions", "SELECT * FROM executions WHERE job_id IS NULL OR job_id % 10 <> 3"))
def cascaded_days(spark, sf):
    """The runs of deleted definitions leave a stored history, in the days that its index names."""
    folder = _indexed(spark, sf)
    cascade_days(spark, folder, fx.definitions(spark, sf).filter("id % 10 = 3").select("id"))
    return read_executions(spark, folder)


@query(with_ctes("executions", "SELECT * FROM executions WHERE NOT (id BETWEEN 300 AND 420 OR id % 997 = 0)"))
def changed_indexed_days(spark, sf):
    """Deletes by id that open the days of their id ranges only."""
    folder = _indexed(spark, sf)
    ids = fx.executions(spark, sf).filter("id BETWEEN 300 AND 420 OR id % 997 = 0").select("id")
    change_indexed_days(spark, folder, ids, lambda part: delete_executions(part, ids).table)
    return read_executions(spark, folder)


DEEP_PAGE = 9


@query(with_ctes("executions", f"SELECT * FROM executions ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET {100 * (DEEP_PAGE - 1)}"))
def deep_page(spark, sf):
    """A page of a stored history far from its end."""
    return history_page(spark, _indexed(spark, sf), DEEP_PAGE, 100)


@query(with_ctes("executions", """SELECT * FROM executions WHERE status = 'FAILED'
    ORDER BY created_at DESC, id DESC LIMIT 40 OFFSET 80"""))
def deep_page_of_status(spark, sf):
    return history_page(spark, _indexed(spark, sf), 3, 40, status="FAILED")


@query(with_ctes("definitions", f"""SELECT * REPLACE (
    CASE WHEN max_retry = 4 THEN NOT is_enabled ELSE is_enabled END AS is_enabled,
    CASE WHEN max_retry = 4 THEN TIMESTAMP '{fx.AS_OF}' ELSE updated_at END AS updated_at) FROM definitions"""))
def published_definitions(spark, sf):
    folder = run_folder(spark, "definitions")
    version = publish_snapshot(fx.definitions(spark, sf), folder)
    first = read_snapshot(spark, folder)
    publish_snapshot(toggle_definitions(first, first.filter("max_retry = 4"), fx.AS_OF).table, folder, based_on=version)
    return read_snapshot(spark, folder)


@query(with_ctes("definitions", "SELECT * FROM definitions"))
def stored_definitions(spark, sf):
    folder = run_folder(spark, "stored")
    fx.definitions(spark, sf).withColumns({c: F.col(c).cast("int") for c in ("is_enabled", "allow_overlap")}).write.parquet(
        folder)
    return read_definitions(spark, folder)


@query(with_ctes("triggers definitions", BAD_SQL))
def quarantined_triggers(spark, sf):
    folder = run_folder(spark, "quarantine")
    quarantine(ingest(fx.triggers(spark, sf), fx.definitions(spark, sf)).quarantined, folder)
    return spark.read.parquet(folder)
