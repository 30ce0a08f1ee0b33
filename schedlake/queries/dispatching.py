"""Insert-if-absent, overlap guard, dispatch, poll replay, reconciliation."""

from pyspark.sql import functions as F

from schedlake import fixtures as fx
from schedlake.fixtures import with_ctes
from schedlake.functions.params import parse_trigger
from schedlake.operators import dispatch as d
from schedlake.operators.changes import assign_ids
from schedlake.operators.occurrences import cron_occurrences, due
from schedlake.plans.cron_dispatch import dispatch
from schedlake.plans.event_dispatch import ingest
from schedlake.queries.registry import query
from schedlake.queries.payloads import CREATED_SQL


def _ticks(spark, sf):
    return cron_occurrences(fx.definitions(spark, sf), fx.RANGE_START, fx.RANGE_END)


@query(with_ctes("executions", """WITH incoming AS (SELECT * FROM executions
    UNION ALL SELECT id + 1000000000, * EXCLUDE (id) FROM executions WHERE id % 2 = 0),
existing AS (SELECT * FROM executions WHERE id % 5 = 0),
firsts AS (SELECT *, row_number() OVER (PARTITION BY job_id, scheduled_time ORDER BY id) AS rn FROM incoming)
SELECT id, job_id, scheduled_time, status FROM firsts f WHERE job_id IS NULL OR (rn = 1 AND NOT EXISTS (
    SELECT 1 FROM existing e WHERE e.job_id = f.job_id AND e.scheduled_time = f.scheduled_time))"""))
def insert_if_absent(spark, sf):
    execs = fx.executions(spark, sf)
    incoming = execs.unionByName(execs.filter("id % 2 = 0").withColumn("id", F.col("id") + 1000000000))
    return d.insert_if_absent(incoming, execs.filter("id % 5 = 0")).select("id", "job_id", "scheduled_time", "status")


@query(with_ctes("ticks executions", """SELECT t.id AS job_id, t.tick AS scheduled_time FROM ticks t
    WHERE EXISTS (SELECT 1 FROM executions e WHERE e.job_id = t.id AND e.scheduled_time = t.tick)"""))
def existing_executions(spark, sf):
    keys = _ticks(spark, sf).select(F.col("id").alias("job_id"), F.col("tick").alias("scheduled_time"))
    return d.exists_executions(keys, fx.executions(spark, sf))


#: What the guard reads of a definition; each of its due ticks carries these.
DUE = ["id", "cron_expression", "allow_overlap"]


@query(with_ctes("ticks executions", f"""WITH due AS (SELECT d.id, d.allow_overlap, t.tick AS scheduled_time
    FROM definitions d JOIN ticks t ON t.id = d.id WHERE t.tick < TIMESTAMP '{fx.AS_OF}'
    AND t.tick >= TIMESTAMP '{fx.AS_OF}' - INTERVAL 2 DAY),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scheduled_time) AS rn FROM due)
SELECT id, scheduled_time FROM ranked r WHERE allow_overlap OR (rn = 1 AND id NOT IN (
    SELECT job_id FROM executions WHERE job_id IS NOT NULL AND status IN ('PENDING', 'RUNNING') AND job_id % 3 = 0))"""))
def overlap_guard(spark, sf):
    """Over the whole history, in which the runs of two thirds of the jobs have ended."""
    due_rows = due(fx.definitions(spark, sf).select(*DUE), fx.AS_OF, 2 * 86400, catch_up=True)
    ended = F.when(F.col("job_id") % 3 == 0, F.col("status")).otherwise("SUCCESS")
    execs = fx.executions(spark, sf).withColumn("status", ended)
    return d.overlap_guard(due_rows, execs).select("id", "scheduled_time")


@query(with_ctes("ticks executions", f"""WITH due AS (SELECT d.id, d.allow_overlap, t.tick AS scheduled_time
    FROM definitions d JOIN ticks t ON t.id = d.id WHERE t.tick < TIMESTAMP '{fx.AS_OF}'
    AND t.tick >= TIMESTAMP '{fx.AS_OF}' - INTERVAL 2 DAY),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scheduled_time) AS rn FROM due)
SELECT id, scheduled_time FROM ranked r WHERE allow_overlap OR (rn = 1 AND id NOT IN (
    SELECT job_id FROM executions WHERE job_id IS NOT NULL AND status IN ('PENDING', 'RUNNING')))"""))
def overlap_guard_whole_history(spark, sf):
    due_rows = due(fx.definitions(spark, sf).select(*DUE), fx.AS_OF, 2 * 86400, catch_up=True)
    return d.overlap_guard(due_rows, fx.executions(spark, sf)).select("id", "scheduled_time")


@query(with_ctes("triggers definitions", """WITH owners AS (SELECT handler_name, min(id) AS id FROM definitions
    GROUP BY handler_name), parsed AS (SELECT msg_partition, msg_offset,
    CASE WHEN value LIKE '{%' THEN coalesce(json_extract_string(value, '$.handler_name'),
        json_extract_string(value, '$.handler')) END AS handler_name,
    CASE WHEN value LIKE '{%' THEN CAST(json_extract_string(value, '$.job_id') AS BIGINT) END AS job_id FROM triggers)
SELECT p.msg_partition, p.msg_offset, p.handler_name, p.job_id, o.id AS resolved_id, d.handler_params AS base_params
FROM parsed p LEFT JOIN owners o ON p.job_id IS NULL AND o.handler_name = p.handler_name
    LEFT JOIN definitions d ON d.id = o.id"""))
def handler_resolution(spark, sf):
    parsed = parse_trigger(fx.triggers(spark, sf)).select("msg_partition", "msg_offset", "handler_name", "job_id")
    return d.resolve_handler(parsed, fx.definitions(spark, sf), ["msg_partition", "msg_offset"])


@query(with_ctes("ticks polls", """SELECT p.poll_ts, t.id, max(t.tick) AS scheduled_time FROM polls p
    JOIN ticks t ON t.tick < p.poll_ts AND t.tick >= p.poll_ts - INTERVAL 60 SECOND GROUP BY p.poll_ts, t.id"""))
def due_at_polls(spark, sf):
    return d.due_definitions_at_polls(fx.definitions(spark, sf), fx.polls(spark, sf), fx.RANGE_START, fx.RANGE_END)


@query(with_ctes("ticks executions", """WITH made AS (SELECT job_id, scheduled_time, count(*) AS executions
    FROM executions WHERE job_id IS NOT NULL GROUP BY ALL)
SELECT coalesce(t.id, m.job_id) AS job_id, coalesce(t.tick, m.scheduled_time) AS scheduled_time,
    coalesce(m.executions, 0) AS executions,
    CASE WHEN m.job_id IS NULL THEN 'missed' WHEN t.id IS NULL THEN 'unscheduled' ELSE 'matched' END AS outcome
FROM (SELECT * FROM ticks WHERE id IN (SELECT id FROM definitions WHERE is_enabled)) t
    FULL OUTER JOIN made m ON t.id = m.job_id AND t.tick = m.scheduled_time"""))
def reconciliation(spark, sf):
    defs = fx.definitions(spark, sf)
    return d.reconcile_definitions(defs, fx.executions(spark, sf), fx.RANGE_START, fx.RANGE_END)


@query(with_ctes("ticks executions", """WITH made AS (SELECT job_id, scheduled_time, count(*) AS executions
    FROM executions WHERE job_id IS NOT NULL GROUP BY ALL),
kept AS (SELECT * FROM made WHERE day(scheduled_time) % 3 = 0),
fired AS (SELECT id, tick, 1 AS one FROM ticks WHERE id IN (SELECT id FROM definitions WHERE is_enabled)),
found AS (SELECT job_id, scheduled_time, sum(executions) AS executions FROM (SELECT * FROM kept UNION ALL
    SELECT id, tick, one FROM fired WHERE day(tick) % 3 <> 0) GROUP BY ALL)
SELECT coalesce(t.id, m.job_id) AS job_id, coalesce(t.tick, m.scheduled_time) AS scheduled_time,
    CAST(coalesce(m.executions, 0) AS BIGINT) AS executions, CASE WHEN m.job_id IS NULL THEN 'missed' ELSE 'unscheduled' END AS outcome
FROM fired t FULL OUTER JOIN found m ON t.id = m.job_id AND t.tick = m.scheduled_time WHERE t.id IS NULL OR m.job_id IS NULL"""))
def reconciliation_differences(spark, sf):
    """A history that follows the schedule on two days of three: those days are compared by count and hash only."""
    defs, execs = fx.definitions(spark, sf), fx.executions(spark, sf).select("job_id", "scheduled_time")
    ticks = cron_occurrences(defs.filter("is_enabled"), fx.RANGE_START, fx.RANGE_END)
    made = execs.filter(F.day("scheduled_time") % 3 == 0).unionByName(ticks.filter(F.day("tick") % 3 != 0).select(
        F.col("id").alias("job_id"), F.col("tick").alias("scheduled_time")))
    return d.reconcile_differences(defs, made, fx.RANGE_START, fx.RANGE_END)


# Executions before the dispatch instant: at a small scale nearly every job has something incomplete.
DISPATCH_SQL = f"""WITH past AS (SELECT * FROM executions WHERE created_at < TIMESTAMP '{{}}'),
ahead AS (SELECT id, date_diff('second', min(tick), arg_min(tick, -n)) AS gap FROM (
    SELECT id, tick, row_number() OVER (PARTITION BY id ORDER BY tick) AS n FROM wide_ticks
    WHERE tick > TIMESTAMP '{fx.AS_OF}') WHERE n <= 2 GROUP BY id),
due AS (SELECT id, max(tick) AS scheduled_time FROM ticks WHERE tick < TIMESTAMP '{fx.AS_OF}'
    AND tick >= TIMESTAMP '{fx.AS_OF}' - INTERVAL 60 SECOND GROUP BY id)
SELECT d.id AS job_id, d.handler_name, u.scheduled_time, 'PENDING' AS status, d.handler_params AS params,
    'cron' AS param_source, CAST(0 AS INT) AS retry_count, TIMESTAMP '{fx.AS_OF}' AS created_at
FROM definitions d JOIN due u ON u.id = d.id JOIN ahead a ON a.id = d.id
WHERE d.is_enabled AND a.gap >= 60
    AND (d.allow_overlap OR d.id NOT IN (SELECT job_id FROM past WHERE job_id IS NOT NULL
        AND status IN ('PENDING', 'RUNNING')))
    AND NOT EXISTS (SELECT 1 FROM past e WHERE e.job_id = d.id AND e.scheduled_time = u.scheduled_time)"""
DISPATCHED = ["job_id", "handler_name", "scheduled_time", "status", "params", "param_source", "retry_count",
              "created_at"]


@query(with_ctes("ticks wide_ticks executions", DISPATCH_SQL.format(fx.AS_OF)))
def cron_dispatch(spark, sf):
    execs = fx.executions(spark, sf).filter(F.col("created_at") < fx.ntz(fx.AS_OF))
    return dispatch(fx.definitions(spark, sf), execs, fx.AS_OF).created.select(*DISPATCHED)


@query(with_ctes("ticks wide_ticks executions", f"""WITH created AS ({DISPATCH_SQL.format(fx.AS_OF)})
SELECT row_number() OVER (ORDER BY md5(concat(job_id, '|', strftime(scheduled_time, '%Y-%m-%d %H:%M:%S'))), job_id)
    + (SELECT max(id) FROM executions) AS id, job_id, scheduled_time, status FROM created"""))
def cron_dispatch_with_ids(spark, sf):
    execs = fx.executions(spark, sf)
    past = execs.filter(F.col("created_at") < fx.ntz(fx.AS_OF))
    created = dispatch(fx.definitions(spark, sf), past, fx.AS_OF).created
    return assign_ids(created, ["job_id", "scheduled_time"], execs.agg(F.max("id")).scalar()).select(
        "id", "job_id", "scheduled_time", "status")


@query(with_ctes("definitions", f"""SELECT id, name, cron_expression,
    CASE (id - 1) % 12 WHEN 10 THEN 'never_fires' ELSE 'parse_error' END AS reason FROM definitions
    WHERE is_enabled AND (id - 1) % 12 IN (10, 11)"""))
def cron_dispatch_rejected(spark, sf):
    execs = fx.executions(spark, sf).filter(F.col("created_at") < fx.ntz(fx.AS_OF))
    return dispatch(fx.definitions(spark, sf), execs, fx.AS_OF).rejected.drop("interval_seconds")


@query(with_ctes("ticks wide_ticks executions triggers", f"""WITH cron_rows AS ({DISPATCH_SQL.format(fx.AS_OF)}), event_rows AS ({CREATED_SQL})
SELECT job_id, handler_name, scheduled_time, status, params, param_source FROM cron_rows
UNION ALL SELECT job_id, handler_name, scheduled_time, status, params, param_source FROM event_rows"""))
def all_dispatched(spark, sf):
    defs = fx.definitions(spark, sf)
    execs = fx.executions(spark, sf).filter(F.col("created_at") < fx.ntz(fx.AS_OF))
    columns = ["job_id", "handler_name", "scheduled_time", "status", "params"]
    return d.union_sources(dispatch(defs, execs, fx.AS_OF).created.select(*columns),
                           ingest(fx.triggers(spark, sf), defs).created.select(*columns))
