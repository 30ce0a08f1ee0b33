"""Counts, statistics, concurrency, latency."""

from pyspark.sql import functions as F

from schedlake import fixtures as fx
from schedlake.fixtures import with_ctes
from schedlake.functions.clock import to_display_tz
from schedlake.operators import reports as r
from schedlake.operators.occurrences import upcoming
from schedlake.queries.registry import query

COUNTS = """count(*) AS total, count(*) FILTER (status = 'SUCCESS') AS success_count,
    count(*) FILTER (status = 'FAILED') AS failed_count, count(*) FILTER (status = 'RUNNING') AS running_count,
    count(*) FILTER (status = 'PENDING') AS pending_count, count(*) FILTER (status = 'TIMEOUT') AS timeout_count"""


@query(with_ctes("executions", f"SELECT {COUNTS} FROM executions WHERE created_at >= TIMESTAMP '{fx.SINCE}'"))
def execution_stats(spark, sf):
    return r.execution_stats(fx.executions(spark, sf), fx.SINCE)


@query(with_ctes("executions", f"""SELECT job_id, {COUNTS} FROM executions
    WHERE created_at >= TIMESTAMP '{fx.SINCE}' GROUP BY job_id"""))
def execution_stats_by_job(spark, sf):
    return r.execution_stats_by(fx.executions(spark, sf), ["job_id"], fx.SINCE)


@query(with_ctes("executions", f"""SELECT handler_name, param_source, CAST(grouping_id(handler_name, param_source)
    AS BIGINT) AS level, {COUNTS} FROM executions GROUP BY CUBE (handler_name, param_source)"""))
def execution_stats_cube(spark, sf):
    return r.execution_stats_by(fx.executions(spark, sf), ["handler_name", "param_source"], sets="cube")


@query(with_ctes("executions", f"""SELECT handler_name, hour, CAST(grouping_id(handler_name, hour) AS BIGINT) AS level,
    {COUNTS} FROM (SELECT *, date_trunc('hour', created_at) AS hour FROM executions)
    GROUP BY ROLLUP (handler_name, hour)"""))
def execution_stats_rollup(spark, sf):
    return r.execution_stats_by(fx.executions(spark, sf), ["handler_name", "hour"], sets="rollup")


@query(with_ctes("definitions", """SELECT 'all' AS scope, count(*) AS cnt FROM definitions
    UNION ALL SELECT 'enabled', count(*) FROM definitions WHERE is_enabled
    UNION ALL SELECT 'disabled', count(*) FROM definitions WHERE NOT is_enabled"""))
def definition_counts(spark, sf):
    defs = fx.definitions(spark, sf)
    parts = [r.count_definitions(defs, flag).select(F.lit(name).alias("scope"), "cnt")
             for name, flag in (("all", None), ("enabled", True), ("disabled", False))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(with_ctes("executions", """SELECT job_id, status, count(*) AS cnt,
    CAST(grouping_id(job_id, status) AS BIGINT) AS level FROM executions GROUP BY CUBE (job_id, status)"""))
def execution_counts(spark, sf):
    return r.execution_counts(fx.executions(spark, sf))


@query(with_ctes("executions", "SELECT count(*) AS cnt FROM executions WHERE job_id = 8 AND status = 'TIMEOUT'"))
def execution_count_filtered(spark, sf):
    return r.count_executions(fx.executions(spark, sf), 8, "TIMEOUT")


@query(with_ctes("executions", """SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages
    FROM executions WHERE status = 'FAILED'"""))
def page_summary(spark, sf):
    return r.page_summary(fx.executions(spark, sf).filter("status = 'FAILED'"), fx.PAGE_SIZE)


@query(with_ctes("ticks", f"""SELECT handler_name, min(first_tick) AS next_tick, CAST(sum(fires) AS BIGINT) AS fire_count,
    count(*) AS job_count FROM definitions JOIN (SELECT id, min(tick) AS first_tick, count(*) AS fires FROM ticks
        WHERE tick > TIMESTAMP '{fx.AS_OF}' AND tick <= TIMESTAMP '{fx.AS_OF}' + INTERVAL 7 DAY GROUP BY id) USING (id)
    WHERE is_enabled GROUP BY handler_name"""))
def upcoming_by_handler(spark, sf):
    return upcoming(fx.definitions(spark, sf), fx.AS_OF, 7 * 86400, ["handler_name"])


RUNNING_SQL = """WITH marks AS (
    SELECT started_at AS ts, 1 AS delta FROM executions WHERE started_at IS NOT NULL
    UNION ALL SELECT finished_at, -1 FROM executions WHERE started_at IS NOT NULL AND finished_at IS NOT NULL),
net AS (SELECT ts, sum(delta) AS delta FROM marks GROUP BY ts),
run AS (SELECT ts, CAST(sum(delta) OVER (ORDER BY ts) AS BIGINT) AS running, lead(ts) OVER (ORDER BY ts) AS next_ts
    FROM net)
"""


@query(with_ctes("executions", RUNNING_SQL + "SELECT * FROM run"))
def concurrency(spark, sf):
    return r.concurrency(fx.executions(spark, sf))


@query(with_ctes("executions", RUNNING_SQL + f"""SELECT max(running) AS peak,
    CAST(coalesce(sum(CASE WHEN running > {fx.POOL_SIZE} THEN date_diff('microsecond', ts, next_ts) END), 0) AS DOUBLE)
        / 1000000.0 AS seconds_above,
    count(*) FILTER (running > {fx.POOL_SIZE}) AS marks_above FROM run"""))
def pool_load(spark, sf):
    return r.pool_load(fx.executions(spark, sf), fx.POOL_SIZE)


@query(with_ctes("executions", """WITH timed AS (
    SELECT handler_name, 'wait' AS metric, date_diff('microsecond', created_at, started_at) AS micros FROM executions
    UNION ALL SELECT handler_name, 'run', date_diff('microsecond', started_at, finished_at) FROM executions),
ranked AS (SELECT *, row_number() OVER (PARTITION BY handler_name, metric ORDER BY micros) AS rn,
    count(*) OVER (PARTITION BY handler_name, metric) AS n FROM timed WHERE micros IS NOT NULL)
SELECT handler_name, metric, count(*) AS runs,
    round(CAST(sum(micros) AS DOUBLE) / count(*) / 1000000.0, 6) AS avg_seconds,
    CAST(max(micros) AS DOUBLE) / 1000000.0 AS max_seconds,
    CAST(min(micros) FILTER (rn >= ceil(n * 0.5)) AS DOUBLE) / 1000000.0 AS p50_seconds,
    CAST(min(micros) FILTER (rn >= ceil(n * 0.95)) AS DOUBLE) / 1000000.0 AS p95_seconds
FROM ranked GROUP BY handler_name, metric"""))
def latency_summary(spark, sf):
    return r.latency_summary(fx.executions(spark, sf))


@query(with_ctes("executions", """SELECT CASE WHEN error_message LIKE 'Execution timed out%'
    THEN 'Execution timed out' ELSE 'other' END AS error_class, count(*) AS failures
    FROM executions WHERE error_message IS NOT NULL GROUP BY 1"""))
def error_classes(spark, sf):
    return r.error_classes(fx.executions(spark, sf))


@query(with_ctes("executions", """SELECT id, scheduled_time + INTERVAL 9 HOUR AS scheduled_time,
    created_at + INTERVAL 9 HOUR AS created_at FROM executions"""))
def display_times(spark, sf):
    return to_display_tz(fx.executions(spark, sf).select("id", "scheduled_time", "created_at"),
                         ["scheduled_time", "created_at"])
