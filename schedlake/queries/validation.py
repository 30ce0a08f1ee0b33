"""Checks on definitions and executions."""

from pyspark.sql import functions as F

from schedlake import fixtures as fx
from schedlake.fixtures import with_ctes
from schedlake.operators import validate as val
from schedlake.queries.registry import query

ODD_SQL = """SELECT id, CASE WHEN id % 5 = 0 THEN repeat(name, 6) ELSE name END AS name,
    CASE WHEN id % 6 = 0 THEN repeat('x', 501) ELSE description END AS description,
    CASE WHEN id % 4 = 0 THEN substring(cron_expression, 1, 8) ELSE cron_expression END AS cron_expression,
    CASE WHEN id % 9 = 0 THEN '' ELSE handler_name END AS handler_name, CAST(max_retry * 3 AS INT) AS max_retry,
    CAST(timeout_seconds * 200 AS INT) AS timeout_seconds FROM definitions"""


@query(with_ctes("definitions", f"""WITH odd AS ({ODD_SQL}) SELECT id, concat_ws(',',
    CASE WHEN length(name) NOT BETWEEN 1 AND 100 THEN 'name' END,
    CASE WHEN length(description) > 500 THEN 'description' END,
    CASE WHEN length(cron_expression) NOT BETWEEN 9 AND 100 THEN 'cron_expression' END,
    CASE WHEN length(handler_name) NOT BETWEEN 1 AND 100 THEN 'handler_name' END,
    CASE WHEN max_retry NOT BETWEEN 0 AND 10 THEN 'max_retry' END,
    CASE WHEN timeout_seconds NOT BETWEEN 60 AND 86400 THEN 'timeout_seconds' END) AS errors FROM odd"""))
def definition_errors(spark, sf):
    odd = fx.definitions(spark, sf).withColumns({
        "name": F.expr("IF(id % 5 = 0, repeat(name, 6), name)"),
        "description": F.expr("IF(id % 6 = 0, repeat('x', 501), description)"),
        "cron_expression": F.expr("IF(id % 4 = 0, substring(cron_expression, 1, 8), cron_expression)"),
        "handler_name": F.expr("IF(id % 9 = 0, '', handler_name)"),
        "max_retry": F.expr("max_retry * 3"), "timeout_seconds": F.expr("timeout_seconds * 200")})
    return val.validate_definitions(odd).select("id", F.array_join("errors", ",").alias("errors"))


CRON_SQL = f"""WITH ahead AS (SELECT id, tick, row_number() OVER (PARTITION BY id ORDER BY tick) AS n
    FROM wide_ticks WHERE tick > TIMESTAMP '{fx.AS_OF}'),
pairs AS (SELECT id, date_diff('second', max(tick) FILTER (n = 1), max(tick) FILTER (n = 2)) AS interval_seconds
    FROM ahead WHERE n <= 2 GROUP BY id)
SELECT d.id, p.interval_seconds, CASE WHEN (d.id - 1) % 12 = 11 THEN 'parse_error' WHEN p.id IS NULL THEN 'never_fires'
    WHEN p.interval_seconds < {{}} THEN 'too_short' END AS reason
FROM definitions d LEFT JOIN pairs p ON d.id = p.id"""


@query(with_ctes("wide_ticks", CRON_SQL.format(60)))
def cron_checks(spark, sf):
    return val.validate_cron(fx.definitions(spark, sf), fx.AS_OF).select("id", "interval_seconds", "reason")


@query(with_ctes("wide_ticks", CRON_SQL.format(3600)))
def cron_checks_hourly(spark, sf):
    return val.validate_cron(fx.definitions(spark, sf), fx.AS_OF, 3600).select("id", "interval_seconds", "reason")


@query(with_ctes("definitions", """WITH incoming AS (
    SELECT CASE WHEN id % 2 = 0 THEN id + 1 END AS id,
        CASE WHEN id % 3 = 0 THEN name WHEN id % 3 = 1 THEN 'shared' ELSE concat(name, '_new') END AS name
    FROM definitions)
SELECT i.id, i.name, CASE WHEN d.id IS NOT NULL AND d.id IS DISTINCT FROM i.id THEN 'taken' ELSE 'repeated' END AS reason
FROM incoming i LEFT JOIN definitions d ON d.name = i.name
WHERE (d.id IS NOT NULL AND d.id IS DISTINCT FROM i.id)
    OR i.name IN (SELECT name FROM incoming GROUP BY name HAVING count(*) > 1)"""))
def name_clashes(spark, sf):
    defs = fx.definitions(spark, sf)
    incoming = defs.select(
        F.expr("IF(id % 2 = 0, id + 1, NULL)").alias("id"),
        F.expr("CASE WHEN id % 3 = 0 THEN name WHEN id % 3 = 1 THEN 'shared' ELSE concat(name, '_new') END")
        .alias("name"))
    return val.duplicate_names(defs, incoming)


@query(with_ctes("definitions executions", """WITH bad AS (SELECT id, job_id,
        CASE WHEN id % 7 = 0 THEN NULL ELSE handler_name END AS handler_name,
        CASE WHEN id % 11 = 0 THEN NULL ELSE scheduled_time END AS scheduled_time,
        CASE WHEN id % 13 = 0 THEN 'LOST' ELSE status END AS status FROM executions
    UNION ALL SELECT id + 1000000000, job_id, handler_name, scheduled_time, status FROM executions WHERE id % 2 = 0),
known AS (SELECT id FROM definitions WHERE id % 9 <> 0)
SELECT id, 'status' AS violation FROM bad WHERE status NOT IN ('PENDING', 'RUNNING', 'SUCCESS', 'FAILED', 'TIMEOUT')
UNION ALL SELECT id, 'handler_name' FROM bad WHERE handler_name IS NULL
UNION ALL SELECT id, 'scheduled_time' FROM bad WHERE scheduled_time IS NULL
UNION ALL SELECT id, 'orphan_job_id' FROM bad WHERE job_id IS NOT NULL AND job_id NOT IN (SELECT id FROM known)
UNION ALL SELECT b.id, 'duplicate_key' FROM bad b JOIN (SELECT job_id, scheduled_time FROM bad
    WHERE job_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1) k
    ON b.job_id = k.job_id AND b.scheduled_time = k.scheduled_time"""))
def execution_violations(spark, sf):
    execs = fx.executions(spark, sf)
    bad = execs.withColumns({
        "handler_name": F.expr("IF(id % 7 = 0, NULL, handler_name)"),
        "scheduled_time": F.expr("IF(id % 11 = 0, NULL, scheduled_time)"),
        "status": F.expr("IF(id % 13 = 0, 'LOST', status)"),
    }).unionByName(execs.filter("id % 2 = 0").withColumn("id", F.col("id") + 1000000000))
    return val.schema_violations(bad, fx.definitions(spark, sf).filter("id % 9 <> 0"))
