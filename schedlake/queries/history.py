"""Scans, filters, lookups, definition joins, paging."""

from pyspark.sql import functions as F

from schedlake import fixtures as fx
from schedlake.fixtures import with_ctes
from schedlake.operators import views as v
from schedlake.operators.joins import missing
from schedlake.plans.named_queries import NamedQueries
from schedlake.queries.registry import query
from schedlake.schemas import definition_defaults, empty_executions, execution_defaults
from schedlake.sources.tables import typed_definitions

JOINED = """LEFT JOIN definitions d ON e.job_id = d.id"""


@query(with_ctes("definitions", "SELECT * FROM definitions ORDER BY id"))
def scan_definitions(spark, sf):
    return typed_definitions(fx.definitions(spark, sf)).orderBy("id")


@query(with_ctes("executions", "SELECT * FROM executions"))
def scan_executions(spark, sf):
    return fx.executions(spark, sf)


@query(with_ctes("executions", f"""SELECT id, job_id, handler_name, scheduled_time, 'PENDING' AS status,
    CAST(NULL AS VARCHAR) AS params, 'cron' AS param_source, CAST(NULL AS TIMESTAMP) AS started_at,
    CAST(NULL AS TIMESTAMP) AS finished_at, CAST(0 AS INT) AS retry_count, CAST(NULL AS VARCHAR) AS error_message,
    CAST(NULL AS VARCHAR) AS result, TIMESTAMP '{fx.AS_OF}' AS created_at FROM executions"""))
def execution_bootstrap(spark, sf):
    bare = fx.executions(spark, sf).select("id", "job_id", "handler_name", "scheduled_time")
    return empty_executions(spark).unionByName(execution_defaults(bare, fx.AS_OF))


@query(with_ctes("definitions", f"""SELECT id, name, CAST(NULL AS VARCHAR) AS description, cron_expression,
    handler_name, CAST(NULL AS VARCHAR) AS handler_params, true AS is_enabled,
    coalesce(CASE WHEN id % 2 = 0 THEN allow_overlap END, true) AS allow_overlap, CAST(3 AS INT) AS max_retry,
    coalesce(CASE WHEN id % 3 = 0 THEN timeout_seconds END, 3600) AS timeout_seconds,
    TIMESTAMP '{fx.AS_OF}' AS created_at, TIMESTAMP '{fx.AS_OF}' AS updated_at FROM definitions"""))
def definition_bootstrap(spark, sf):
    bare = fx.definitions(spark, sf).select(
        "id", "name", "cron_expression", "handler_name",
        F.when(F.col("id") % 2 == 0, F.col("allow_overlap")).alias("allow_overlap"),
        F.when(F.col("id") % 3 == 0, F.col("timeout_seconds")).alias("timeout_seconds"))
    return definition_defaults(bare, fx.AS_OF)


@query(with_ctes("definitions", "SELECT * FROM definitions WHERE is_enabled"))
def enabled_definitions(spark, sf):
    return v.enabled(fx.definitions(spark, sf))


@query(with_ctes("definitions", "SELECT * FROM definitions WHERE NOT is_enabled"))
def disabled_definitions(spark, sf):
    return v.defs_by_enabled(fx.definitions(spark, sf), False)


@query(with_ctes("definitions executions", """SELECT * FROM definitions
    WHERE id IN (SELECT job_id FROM executions WHERE status = 'FAILED' AND retry_count = 3)"""))
def lookup_definitions(spark, sf):
    keys = fx.executions(spark, sf).filter("status = 'FAILED' AND retry_count = 3").select(F.col("job_id").alias("id"))
    return v.lookup(fx.definitions(spark, sf), keys, "id")


@query(with_ctes("definitions executions", """SELECT e.id, e.job_id, e.handler_name FROM executions e
    WHERE e.handler_name IN (SELECT handler_name FROM definitions WHERE max_retry = 4 AND NOT allow_overlap)"""))
def lookup_executions_by_handler(spark, sf):
    keys = fx.definitions(spark, sf).filter("max_retry = 4 AND NOT allow_overlap")
    return v.lookup(fx.executions(spark, sf).select("id", "job_id", "handler_name"), keys, "handler_name")


@query(with_ctes("definitions executions", """SELECT DISTINCT handler_name FROM executions
    WHERE handler_name NOT IN (SELECT handler_name FROM definitions WHERE is_enabled AND max_retry = 4 AND NOT allow_overlap)"""))
def missing_handlers(spark, sf):
    keys = fx.executions(spark, sf).select("handler_name").distinct()
    return missing(keys, fx.definitions(spark, sf).filter("is_enabled AND max_retry = 4 AND NOT allow_overlap"), "handler_name")


@query(with_ctes("executions", "SELECT * FROM executions WHERE job_id = 8 AND status = 'FAILED'"))
def executions_of_job_with_status(spark, sf):
    return v.filter_executions(fx.executions(spark, sf), job_id=8, status="FAILED")


@query(with_ctes("executions", "SELECT * FROM executions WHERE job_id = 8"))
def executions_of_job(spark, sf):
    return v.filter_executions(fx.executions(spark, sf), job_id=8)


@query(with_ctes("executions", """SELECT * FROM executions WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00'
    AND created_at < TIMESTAMP '2024-01-12 12:00:00'"""))
def executions_between_dates(spark, sf):
    return v.filter_executions(fx.executions(spark, sf), from_date="2024-01-10 00:00:00",
                               to_date="2024-01-12 12:00:00")


@query(with_ctes("executions", "SELECT * FROM executions WHERE status = 'PENDING'"))
def pending_executions(spark, sf):
    return v.pending(fx.executions(spark, sf))


@query(with_ctes("executions", "SELECT * FROM executions WHERE status IN ('PENDING', 'RUNNING')"))
def incomplete_executions(spark, sf):
    return v.incomplete(fx.executions(spark, sf))


@query(with_ctes("executions", "SELECT * FROM executions WHERE status IN ('SUCCESS', 'FAILED', 'TIMEOUT')"))
def terminal_executions(spark, sf):
    return v.terminal(fx.executions(spark, sf))


@query(with_ctes("executions", """SELECT id, status, CASE WHEN status NOT IN ('FAILED', 'TIMEOUT') THEN
    concat('Cannot retry job with status ''', status, '''. Only FAILED or TIMEOUT jobs can be retried.') END AS reason
    FROM executions"""))
def retryable_executions(spark, sf):
    return v.retryable(fx.executions(spark, sf)).select("id", "status", "reason")


@query(with_ctes("executions", f"SELECT * FROM executions WHERE created_at >= TIMESTAMP '{fx.SINCE}'"))
def executions_since(spark, sf):
    return v.since(fx.executions(spark, sf), fx.SINCE)


@query(with_ctes("executions", f"SELECT {', '.join(v.RUN_COLUMNS)} FROM executions"))
def run_projection(spark, sf):
    return v.history_projection(fx.executions(spark, sf), "run")


@query(with_ctes("executions definitions", f"""SELECT e.id, e.job_id, d.name AS cron_name, e.handler_name,
    e.scheduled_time, e.status, e.started_at, e.finished_at, e.retry_count, e.error_message, e.result, e.created_at
    FROM executions e {JOINED}"""))
def listing_projection(spark, sf):
    return v.history_projection(fx.executions(spark, sf), "listing", fx.definitions(spark, sf))


@query(with_ctes("executions definitions", f"""SELECT e.*, coalesce(d.max_retry, 3) AS max_retry,
    coalesce(d.timeout_seconds, 3600) AS timeout_seconds FROM executions e {JOINED}"""))
def detail_projection(spark, sf):
    return v.history_projection(fx.executions(spark, sf), "detail", fx.definitions(spark, sf))


@query(with_ctes("executions definitions", f"""SELECT e.id, e.job_id, d.name AS cron_name,
    coalesce(d.name, e.handler_name) AS job_name, coalesce(d.max_retry, 3) AS max_retry,
    coalesce(d.timeout_seconds, 3600) AS timeout_seconds FROM executions e {JOINED}"""))
def executions_with_definition(spark, sf):
    return v.with_definition(fx.executions(spark, sf), fx.definitions(spark, sf)).select(
        "id", "job_id", "cron_name", "job_name", "max_retry", "timeout_seconds")


@query(with_ctes("executions definitions", """SELECT e.id, e.job_id, d.name AS job_name, d.max_retry
    FROM executions e JOIN definitions d ON e.job_id = d.id"""))
def executions_with_definition_only(spark, sf):
    return v.with_definition(fx.executions(spark, sf), fx.definitions(spark, sf), "inner").select(
        "id", "job_id", "job_name", "max_retry")


@query(with_ctes("definitions", "SELECT * FROM definitions ORDER BY id DESC LIMIT 20 OFFSET 40"))
def definitions_page(spark, sf):
    return v.page(fx.definitions(spark, sf), [F.desc("id")], fx.PAGE, fx.PAGE_SIZE)


@query(with_ctes("executions definitions", f"""SELECT e.id, e.job_id, d.name AS cron_name, e.handler_name,
    e.scheduled_time, e.status, e.started_at, e.finished_at, e.retry_count, e.error_message, e.result, e.created_at
    FROM executions e {JOINED} WHERE e.status = 'FAILED' ORDER BY e.id DESC LIMIT 20 OFFSET 40"""))
def executions_page(spark, sf):
    return v.list_executions(fx.executions(spark, sf), fx.definitions(spark, sf), fx.PAGE, fx.PAGE_SIZE,
                             status="FAILED")


@query(with_ctes("executions", f"""SELECT {', '.join(v.RUN_COLUMNS)} FROM executions WHERE job_id = 8
    ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 5"""))
def history_of_job(spark, sf):
    return v.executions_of(fx.executions(spark, sf), 8, 20, 5)


@query(with_ctes("executions", f"""SELECT * FROM (SELECT {', '.join(v.RUN_COLUMNS)}, CAST(row_number() OVER (
    PARTITION BY job_id ORDER BY created_at DESC, id DESC) AS INT) AS rn FROM executions WHERE job_id IS NOT NULL)
    WHERE rn <= 5"""))
def latest_runs_per_job(spark, sf):
    return v.latest_per_job(fx.executions(spark, sf), 5)


@query(with_ctes("executions definitions", """SELECT e.id, e.job_id, d.name AS job_name, e.status, e.started_at,
    e.finished_at, e.retry_count, e.error_message, e.result, e.created_at FROM executions e
    JOIN definitions d ON e.job_id = d.id ORDER BY e.created_at DESC, e.id DESC LIMIT 50"""))
def recent_executions(spark, sf):
    return v.recent(fx.executions(spark, sf), fx.definitions(spark, sf), 50)


PENDING_SQL = """SELECT e.id, e.job_id, e.handler_name, e.scheduled_time, e.params, e.param_source, e.retry_count,
    e.created_at, coalesce(d.name, e.handler_name) AS job_name, coalesce(d.max_retry, 3) AS max_retry,
    coalesce(d.timeout_seconds, 3600) AS timeout_seconds
    FROM executions e {} JOIN definitions d ON e.job_id = d.id WHERE e.status = 'PENDING'
    ORDER BY e.created_at, e.id"""


@query(with_ctes("executions definitions", PENDING_SQL.format("LEFT") + " LIMIT 100"))
def pending_queue(spark, sf):
    return v.pending_fifo(fx.executions(spark, sf), fx.definitions(spark, sf), 100)


@query(with_ctes("executions definitions", PENDING_SQL.format("")))
def pending_queue_with_definition(spark, sf):
    return v.pending_fifo(fx.executions(spark, sf), fx.definitions(spark, sf))


def _views(spark, sf):
    return {"executions": fx.executions(spark, sf), "definitions": fx.definitions(spark, sf)}


@query(with_ctes("executions definitions", f"""SELECT e.id, e.handler_name, e.created_at,
    coalesce(d.name, e.handler_name) AS job_name FROM executions e {JOINED}
    WHERE e.status = 'PENDING' AND e.created_at >= TIMESTAMP '{fx.SINCE}' ORDER BY e.created_at, e.id LIMIT 30"""))
def named_waiting_runs(spark, sf):
    return NamedQueries().run(spark, "waiting_runs", _views(spark, sf), since=fx.SINCE, n=30)


@query(with_ctes("executions", f"""SELECT status, param_source, count(*) AS runs FROM executions
    WHERE created_at >= TIMESTAMP '{fx.SINCE}' GROUP BY ALL"""))
def named_status_totals(spark, sf):
    return NamedQueries().run(spark, "status_totals", _views(spark, sf), since=fx.SINCE)


@query(with_ctes("executions", """SELECT id, status, scheduled_time, started_at, finished_at FROM executions
    WHERE job_id = 2 AND status = 'SUCCESS'"""))
def named_job_history(spark, sf):
    return NamedQueries().run(spark, "job_history", _views(spark, sf), job_id=2, status="SUCCESS")
